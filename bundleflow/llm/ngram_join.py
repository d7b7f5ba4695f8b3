"""Exact Jaccard join of word-shingle sets through a token-group matrix.

Documents with equal sets are one class (``sid``).  Classes are partitioned into groups of about ``GROUP`` similar ones:
classes of like size that share the smallest hash among the tokens they have in common with any other.  The matrix holds, for every token, the groups in whose union
it occurs.  A class q can only link to a member of group G if enough of q's tokens occur in G's union; groups that pass
this bound are opened, and q is compared with their members.

How pairs are found without comparing all of them, and without losing one:

* Tokens have one global order: first those that are not frequent, by hash, then frequent ones by their count.  Counts
  come from all documents, by sketches.  The order decides cost, never results.
* Two linked sets share a token among the first ``n - ceil(0.75 n) + 1`` of either (prefix filter).  Only such tokens
  enter the matrix, and only if two classes share them.
* Each group compares its own members first, exactly.  The parts of a group that is too large also hold some of its
  classes in common (pivots), so a large group of near copies becomes one provisional component in this round, at a cost
  linear in its members.  From here on a unit of the matrix is such a component, or the unlinked rest of a group: pairs
  inside a unit are connected or compared already, and a token of a thousand near copies meets one unit, not their parts.
* For q and a member d, overlap <= common prefix tokens + tokens behind a prefix.  With the number of q's prefix tokens
  in the union of a unit and the sizes in it this bounds the overlap with any of its members.  Of two units only the
  classes of the one with fewer are tested against the other, so a token of a large component and many small units costs
  the members of the small ones; those that pass are compared with the members of the larger unit.
* Opened units test the same with full unions, then exact intersections.

A query links to one member of each component it reaches, so no task emits all pairs of a group.  Components follow from
the links by star contraction.

Defined results: a null or wordless text has an empty set and links with nothing; repeated rows are copies; a row
without id belongs to its class and never names it, and a class of such rows has a null component unless it links to one
with an id; an empty table gives no rows; extra columns are ignored; very long texts are read whole, by one task each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import chunks, set_id

GROUP = 64
PIVOTS = 8
QUERIES_AT_ONCE = 1024
SKETCH_BITS = 22
RANGE_BITS = 16  # buckets of one row of the rank table
SALTS = 8
PAIRS_PER_BUCKET = 1 << 17
FLUSH_PAIRS = 1 << 20
MATRIX_CELLS = 32 << 20


def needed(n: int) -> int:
    """Smallest overlap of a set of n tokens with any set it links to."""
    return -(-3 * n // 4)


def _survey(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row per document (doc_id, mark, n, sid), and rows (bucket, hits) of locally frequent tokens.

    ``mark`` is a hash of the text.  A bucket is a stretch of the hash range.
    """
    names = ("doc_id", "mark", "n", "sid", "bucket", "hits")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = np.zeros(1 << SKETCH_BITS, np.int32), np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            sizes, sids = [], []
            for _, sets in chunks(batch.column(2)):
                for own in sets:
                    sizes.append(len(own))
                    sids.append(set_id(own))
                    counts[(own >> shift).astype(np.int64)] += 1  # distinct tokens seldom share a bucket
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()),
                 none, none], schema=schema)
        mean = counts.sum(dtype=np.int64) / len(counts)
        often = np.flatnonzero(counts > mean + 4 * math.sqrt(mean) + 1)  # in a small task two may be many
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(often), pa.array(counts[often].astype(np.int64))],
                                             schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"),
                       F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def prefix(own: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The tokens of a sorted set that the prefix filter needs, in the global order."""
    size = len(own) - needed(len(own)) + 1
    place = rank[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    if not place.any():
        return own[:size]
    return own[np.lexsort((own, place))[:size]]


def _ranks(survey: DataFrame) -> np.ndarray:
    """How frequent each bucket of the sketch is, one byte each (eighths of a power of two); 0: not frequent.

    Packed on Spark; the driver gets at most 2**(SKETCH_BITS - RANGE_BITS) rows of 2**RANGE_BITS bytes, whatever the data.
    """
    def pack(counts: pa.Table) -> pa.Table:
        level = np.zeros(1 << RANGE_BITS, np.uint8)
        bucket = counts["bucket"].to_numpy()
        level[bucket & ((1 << RANGE_BITS) - 1)] = np.minimum(8 * np.log2(counts["hits"].to_numpy()) + 1, 255)
        return pa.table({"stretch": [int(bucket[0]) >> RANGE_BITS], "levels": pa.array([level.tobytes()], pa.binary())})

    hits = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits"))
    rows = (hits.groupBy(F.shiftright("bucket", RANGE_BITS).alias("stretch"))
            .applyInArrow(pack, "stretch long, levels binary").collect())
    rank = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        begin = r["stretch"] << RANGE_BITS
        rank[begin:begin + (1 << RANGE_BITS)] = np.frombuffer(r["levels"], np.uint8)
    return rank


def _prefix_pairs(docs: DataFrame, text: str, rank: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, tokens, sids): prefix tokens with their classes, many to a row."""
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("sids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sids: list[tuple[int, int]] = []
        held, seen = 0, set()

        def dealt() -> pa.RecordBatch:
            t = np.concatenate(tokens)
            s = np.repeat(np.array([x for x, _ in sids], np.int64), [k for _, k in sids])
            bucket = (t % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, s, bucket = t[order], s[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stop = np.append(first[1:], len(t))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.array([t[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary()),
                 pa.array([s[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())], schema=schema)

        for batch in batches:
            for _, sets in chunks(batch.column(0)):
                for own in sets:
                    if not len(own) or (sid := set_id(own)) in seen:
                        continue
                    seen.add(sid)
                    tokens.append(prefix(own, rank))
                    sids.append((sid, len(tokens[-1])))
                    held += len(tokens[-1])
                if held >= FLUSH_PAIRS:
                    yield dealt()
                    tokens, sids, held = [], [], 0
                    seen = set()  # copies further apart meet in their bucket
        if held:
            yield dealt()

    return docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        run, "bucket long, tokens binary, sids binary")


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared(table: pa.Table) -> pa.Table:
    """(token, sid) of one bucket, for tokens that two classes share."""
    tokens, sids = _joined(table["tokens"], np.uint64), _joined(table["sids"], np.int64)
    order = np.lexsort((sids, tokens))
    tokens, sids = tokens[order], sids[order]
    new_token = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    new_pair = new_token | np.concatenate([[True], sids[1:] != sids[:-1]])
    tokens, sids, new_token = tokens[new_pair], sids[new_pair], new_token[new_pair]
    owner = np.cumsum(new_token) - 1
    keep = np.bincount(owner)[owner] > 1
    return pa.table({"token": tokens[keep].view(np.int64), "sid": sids[keep]})


def groups_of(survey: DataFrame, shared: DataFrame, group: int = GROUP) -> DataFrame:
    """(sid, n, at, gid, home): the classes that share a token, and their groups.

    ``at`` names a row of the class by (mark, id).  A class that shares no prefix token can't link.  Pivots of a divided
    group are in all of its parts; ``home`` tells a class's own part.
    """
    lowest = shared.groupBy("sid").agg(F.min(F.xxhash64("token")).alias("low"))
    classes = (survey.where("n > 0")
               .groupBy("sid").agg(F.first("n").alias("n"),
                                   F.min(F.struct("mark", F.coalesce("doc_id", F.lit(-2**63)).alias("id"))).alias("at"))
               .join(lowest, "sid")
               .withColumn("key", F.xxhash64("low", F.floor(F.log("n") / math.log(1.15)))))
    large = classes.groupBy("key").count().where(F.col("count") > group)
    zero = F.lit(0).cast("long")
    parts = F.coalesce(F.ceil(F.col("count") / group), F.lit(1))
    dealt = (classes.join(large, "key", "left")
             .withColumn("own", F.pmod(F.xxhash64("sid"), parts))
             .withColumn("pivot", F.pmod(F.xxhash64("sid", F.lit(1)), F.coalesce("count", zero + 1)) < PIVOTS)
             .withColumn("part", F.explode(F.when(F.col("pivot") & F.col("count").isNotNull(), F.sequence(zero, parts - 1))
                                           .otherwise(F.array("own")))))
    return stored(dealt.select("sid", "n", "at", F.xxhash64("key", "part").alias("gid"), (F.col("part") == F.col("own")).alias("home")),
                  "groups")


def _bounded(met: DataFrame) -> DataFrame:
    """The rows (n, common, least, most) whose class can link to a set of ``least`` to ``most`` tokens."""
    low = F.greatest(F.col("least").cast("double"), F.col("n") * 0.75)
    high = F.least(F.col("most").cast("double"), F.col("n") / 0.75)

    def short(d):
        return (F.col("n") + d) * (3 / 7) - F.greatest(F.col("n").cast("double"), d) * 0.75

    # the bound is concave in the member's size, so its least value lies at an end of the range
    return met.where(F.col("common") >= F.least(short(low), short(high)) - 1e-6)


_FITS = "most * 4 >= n * 3 and least * 3 <= n * 4"  # sizes that do not fit are dropped at once


def own_members(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(sid, gid): the classes that may link inside their group."""
    member = shared.join(groups.select("sid", "n", "gid"), "sid")
    matrix = (member.groupBy("token", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("holders"))
              .where("holders > 1").drop("holders"))
    met = (member.join(matrix, ["token", "gid"]).where(_FITS).groupBy("sid", "n", "gid")
           .agg(F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most")))
    return _bounded(met).select("sid", "gid")


def reach(shared: DataFrame, units: DataFrame) -> DataFrame:
    """(sid, unit, other): the larger units (of equal ones those named later) that a class of ``unit`` may reach."""
    sizes = units.groupBy("unit").agg(F.count("*").alias("size"))
    member = shared.join(units.join(sizes, "unit").select("sid", "n", "unit", "size"), "sid")
    matrix = (member.groupBy("token", F.col("unit").alias("other"), F.col("size").alias("other_size"))
              .agg(F.min("n").alias("least"), F.max("n").alias("most")))
    met = (member.join(matrix, "token").where("size < other_size or size = other_size and unit < other").where(_FITS)
           .groupBy("sid", "n", "unit", "other")
           .agg(F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most")))
    return _bounded(met).select("sid", "unit", "other")


def roles_of(reached: DataFrame, units: DataFrame) -> DataFrame:
    """(sid, gid, comp, is_query): who is compared where.  A unit's members are dealt to parts of ``GROUP``, its queries
    to parts of ``QUERIES_AT_ONCE``; each pair of parts is a ``gid``."""
    queries = reached.select("sid", F.col("other").alias("unit"))
    members = units.select("sid", "unit").join(queries.select("unit").distinct(), "unit", "left_semi")

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("unit").agg(F.ceil(F.count("*") / size).cast("long").alias(name))

    dealt = parts(queries, QUERIES_AT_ONCE, "calls").join(parts(members, GROUP, "parts"), "unit")
    zero = F.lit(0).cast("long")

    def placed(rows: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine = rows.join(dealt, "unit").withColumn("mine", F.pmod(F.xxhash64("sid", F.lit(2)), own)).withColumn(
            "theirs", F.explode(F.sequence(zero, F.col(other) - 1)))
        place = ["mine", "theirs"] if is_query else ["theirs", "mine"]
        return mine.select("sid", F.xxhash64("unit", *place).alias("gid"), F.lit(is_query).alias("is_query"))

    both = placed(members, "parts", "calls", False).unionByName(placed(queries, "calls", "parts", True))
    return stored(both.join(units.select("sid", "comp"), "sid"), "roles")


def _sets(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame) -> DataFrame:
    """(sid, tokens) of the classes whose ``at`` is wanted; texts are read again for these alone."""
    key = [F.xxhash64(text).alias("mark"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-2**63)).alias("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["sid", "tokens"])

    rows = docs.select(*key, F.coalesce(text, F.lit("")).alias("text")).join(wanted, ["mark", "id"], "left_semi")
    return rows.select("text").mapInArrow(run, "sid long, tokens binary")


def linked(inter: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= 75 * (a + b - inter)


class _Members:
    """The sets of one opened group and their union."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        self.union, entry = np.unique(np.concatenate(sets), return_inverse=True)
        self.matrix = None
        if len(sets) * len(self.union) <= MATRIX_CELLS:
            self.matrix = np.zeros((len(self.union), len(sets)), np.uint8)
            self.matrix[entry, np.repeat(np.arange(len(sets)), self.sizes)] = 1

    def linked_to(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.union, own)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == own]
        if 4 * len(at) < 3 * len(own):  # the union's bound: no member can link
            return np.empty(0, np.int64)
        if self.matrix is not None:
            inter = self.matrix[at].sum(0, dtype=np.int64)
        else:
            inter = np.array([len(np.intersect1d(own, s, assume_unique=True)) for s in self.sets])
        return np.flatnonzero(linked(inter, len(own), self.sizes))


def _edges(left: list[int], right: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _open_own(table: pa.Table) -> pa.Table:
    """Links that connect what links among the members of a group."""
    names = table["sid"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    if len(names) < 2:
        return _edges([], [])
    members = _Members(sets)
    root = np.arange(len(names))
    for i, own in enumerate(sets):
        for j in members.linked_to(own).tolist():
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    more = np.flatnonzero(root != np.arange(len(names))).tolist()
    return _edges([names[root[i]] for i in more], [names[i] for i in more])


def _open_to_queries(table: pa.Table) -> pa.Table:
    """A link from each query to one member of every component that it reaches."""
    sids, comps, is_query = (np.asarray(table[c]) for c in ("sid", "comp", "is_query"))
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    at = np.flatnonzero(~is_query)
    if not len(at) or len(at) == len(sids):
        return _edges([], [])
    members = _Members([sets[i] for i in at])
    left: list[int] = []
    right: list[int] = []
    for i in np.flatnonzero(is_query).tolist():
        reached = at[members.linked_to(sets[i])]
        for j in reached[np.unique(comps[reached], return_index=True)[1]].tolist():
            if comps[j] != comps[i]:
                left.append(int(sids[i]))
                right.append(int(sids[j]))
    return _edges(left, right)


def links(docs: DataFrame, groups: DataFrame, roles: DataFrame, text: str, doc_id: str, compare) -> DataFrame:
    """(a, b): the links that ``compare`` finds in each group of ``roles``."""
    wanted = groups.where("home").join(roles.select("sid").distinct(), "sid").select("at.mark", "at.id")
    sets = _sets(docs, text, doc_id, wanted).dropDuplicates(["sid"])
    return roles.join(sets, "sid").groupBy("gid").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    Every round hangs a node's larger neighbours, then all its neighbours, on the smallest one; it ends when the links
    are stars.  A node's least neighbour is found from partial minima; its links are dealt to ``SALTS`` places, each of
    which has a copy of the node's least, so the links of a node with very many never meet in one task.
    """
    def hung(pairs: DataFrame, both_ways: bool) -> DataFrame:
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
        ways = ways.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        least = (ways.groupBy("a", "salt").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"))
                 .withColumn("m", F.least("m", "a")))
        copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = ways.join(copies, ["a", "salt"])
        if both_ways:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(least.select("a", F.col("m").alias("b"))).where("a != b"))

    # a is always the larger end
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "links")
    state = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = size
        if not size[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        spread = hung(now, True)
        now = stored(hung(spread.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), False)
                     .distinct(), "links")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP) -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component_id, root (the component itself; null without shingles)."""
    survey = stored(_survey(docs, text, doc_id), "survey")
    rows = survey.where("n is not null")
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, math.ceil(tokens / 4 / PAIRS_PER_BUCKET))
    shared = stored(_prefix_pairs(docs, text, _ranks(survey), buckets).groupBy("bucket")
                    .applyInArrow(_shared, "token long, sid long"), "shared")
    groups = groups_of(rows, shared, group)
    own = stored(own_members(shared, groups), "own")
    inside = components(links(docs, groups, own, text, doc_id, _open_own))
    # a component, or what no link has reached of a group
    units = groups.where("home").join(inside, F.col("sid") == F.col("node"), "left").select(
        "sid", "n", F.coalesce("root", "sid").alias("comp"), F.coalesce("root", "gid").alias("unit"))
    units = stored(units, "units")
    roles = roles_of(stored(reach(shared, units), "reach"), units)
    across = links(docs, groups, roles, text, doc_id, _open_to_queries)
    found = components(inside.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = (classes.join(found, classes.sid == found.node, "left")
             .select("sid", "least", F.coalesce("root", "sid").alias("root")))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("sid", "component_id", "root")
    return (rows.join(by_class, "sid", "left")
            .select("doc_id", "mark", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "root"))
