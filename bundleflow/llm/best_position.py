"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt by a hash into shards of about ``SHARD_POSTINGS`` postings, items into blocks of ``ITEMS`` items; a
(shard, block) pair is one group, which builds its own impact lists: for each term of the block the shard's documents by
falling impact.  Postings of terms that no item has leave in the stage that reads the texts; a posting goes to the blocks
whose items have its term, so the stated query set meets all documents in blocks.  Each group returns at most ``BEST``
documents an item, and the best of these over all shards are the answer, since shards share no document.

Within a group an item reads its lists in parallel, some positions a round (sorted access).  A document seen for the
first time is looked up in all other lists at once (direct access), which gives its score and its position there; those
positions count as seen too.  Each list's *best position* is the last of the unbroken row of seen positions from its
top.  A document not seen yet stands below it in every list, so its score is at most the sum of the impacts next below the
best positions.  Reading stops where this bound is strictly below the score of the last place: at equality an unseen
document could still tie and have the smaller id.

The score is integer arithmetic (see :func:`impacts`); only the terms' weights use a logarithm, in doubles.

Defined results: a null text and one without terms is no document; documents that share no term with an item are not
returned; equal scores go by ascending id, rows without id last; repeated rows, and rows that share an id, are documents
of their own; rows of one item_id are one item that has the terms of all of them; an item without terms has no rows, nor
has an empty table; long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BEST = 10
ITEMS = 512
SHARD_POSTINGS = 1 << 19
ROUND = 32  # positions read per list in the first round; doubles

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
LENGTH = ""  # no term: its row holds a document's number of terms


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return text.lower().translate(_SPACED).split()  # bytes.lower knows ASCII only


def _postings(docs: DataFrame, text: str) -> DataFrame:
    """(row, doc_id, n, term, tf) of every document; ``LENGTH`` stands for the document itself."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.string()),
                        ("tf", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = batch.column(0), batch.column(1)
            a, texts = 0, batch.column(2).cast(pa.binary())
            while a < len(texts):
                own: list[int] = []
                length: list[int] = []
                term: list[bytes] = []
                tf: list[int] = []
                while a < len(texts) and len(term) < 1 << 16:
                    if counts := Counter(terms_of(texts[a].as_py() or b"")):
                        n = counts.total()
                        own += [a] * (len(counts) + 1)
                        length += [n] * (len(counts) + 1)
                        term.append(LENGTH.encode())
                        term += counts
                        tf.append(n)
                        tf += counts.values()
                    a += 1
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [row.take(at), doc_id.take(at), pa.array(length, pa.int64()),
                     pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], schema=schema)

    return docs.mapInArrow(work, "row long, doc_id long, n long, term string, tf long")


def item_terms(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, term): each item's terms, once each."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def impacts(postings: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(block, row, doc_id, term, impact) with a term's part of a document's score, once for each block that has the term.

    impact = w * ((1000000000 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2 N + 2) / (2 df + 1))),
    m = 100 - 90 + ((90 * n * N) div L).
    """
    m = F.expr(f"100 - 90 + ((90L * n * {n_docs}L) div {n_terms}L)")
    part = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    return (postings.join(weights, "term").withColumn("m", m)
            .select("block", "row", "doc_id", "term", (F.col("w") * part).alias("impact")).where("impact > 0"))


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * df + 1))).cast("long")


class Lists:
    """The impact lists of one shard: per term its documents by falling impact, and their positions by document."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((document, -impact, term))
        ends = np.cumsum(np.bincount(term, minlength=n_terms))
        self.bounds = np.concatenate([[0], ends])
        self.document, self.impact = document[order], impact[order]
        by_document = np.lexsort((self.document, term[order]))
        self.by_id = self.document[by_document]  # per term: documents in order ...
        self.position = by_document - np.repeat(self.bounds[:-1], np.diff(self.bounds))  # ... and where they stand

    def best(self, terms: list[int], order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest score, ties by ``order``, and their scores."""
        spans = [(int(self.bounds[t]), int(self.bounds[t + 1])) for t in terms]
        spans = [(a, b) for a, b in spans if b > a]
        seen = [np.zeros(b - a + 1, bool) for a, b in spans]  # the place past the end stays unseen
        best_position = [0] * len(spans)  # how many positions from the top are seen without a gap
        documents, scores, known = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(order), bool)
        depth, step = 0, ROUND
        while True:
            # sorted access
            read = [self.document[min(a + depth, b):min(a + depth + step, b)] for a, b in spans]
            depth, step = depth + step, 2 * step
            new = np.unique(np.concatenate(read)) if read else documents
            new = new[~known[new]]
            known[new] = True
            # direct access
            total = np.zeros(len(new), np.int64)
            for (a, b), marks in zip(spans, seen, strict=True):
                at = a + np.searchsorted(self.by_id[a:b], new)
                there = at < b
                there[there] = self.by_id[at[there]] == new[there]
                place = self.position[at[there]]
                marks[place] = True
                total[there] += self.impact[a + place]
            documents, scores = np.concatenate([documents, new]), np.concatenate([scores, total])
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -1
            bound = 0
            for i, ((a, b), marks) in enumerate(zip(spans, seen, strict=True)):
                best_position[i] += int(marks[best_position[i]:].argmin())
                if a + best_position[i] < b:
                    bound += int(self.impact[a + best_position[i]])
            if bound < kth or not bound:
                break
        top = np.lexsort((order[documents], -scores))[:k]
        return documents[top], scores[top]


_FOUND = pa.schema([("item_id", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def group(postings: pa.Table, items: pa.Table) -> pa.Table:
        if not postings.num_rows or not items.num_rows:
            return _FOUND.empty_table()
        coded = postings["term"].combine_chunks().dictionary_encode()
        number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        rows = postings["row"].to_numpy()
        _, at, document = np.unique(rows, return_index=True, return_inverse=True)
        ids = postings["doc_id"].take(pa.array(at)).combine_chunks()
        filled = ids.fill_null(0).to_numpy()
        order = np.empty(len(at), np.int64)
        order[np.lexsort((rows[at], filled, ~np.asarray(ids.is_valid())))] = np.arange(len(at))
        lists = Lists(document.astype(np.int64), coded.indices.to_numpy().astype(np.int64), postings["impact"].to_numpy(),
                      len(number))
        found: list[pa.Table] = []
        for item, terms in zip(items["item_id"].to_pylist(), items["terms"].to_pylist(), strict=True):
            documents, scores = lists.best([number[t] for t in terms if t in number], order, k)
            if len(documents):
                found.append(pa.table([pa.array([item] * len(documents), pa.int64()), pa.array(rows[at[documents]]),
                                       ids.take(pa.array(documents)), pa.array(scores)], schema=_FOUND))
        return pa.concat_tables(found) if found else _FOUND.empty_table()
    return group


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
           item_text: str = "text", k: int = BEST, shard_postings: int = SHARD_POSTINGS, block_items: int = ITEMS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    wanted = stored(item_terms(items, item_text, item_id).withColumn("item_id", F.col("item_id").cast("long")), "terms")
    blocks = -(-wanted.agg(F.count_distinct(F.coalesce("item_id", F.lit(-1)))).first()[0] // block_items)
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    vocabulary = wanted.select("term").distinct().unionByName(
        docs.sparkSession.range(1).select(F.lit(LENGTH).alias("term")))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                           F.col(text).alias("text"))
    postings = stored(_postings(numbered, text).join(vocabulary, "term", "left_semi"), "postings")
    n_docs, n_terms = postings.where(F.col("term") == LENGTH).agg(F.count(F.lit(1)), F.sum("tf")).first()
    n_postings = postings.count()
    own = postings.where(F.col("term") != LENGTH)
    weights = own.groupBy("term").agg(weight(F.count(F.lit(1)), n_docs).alias("w"))
    # a term's weight with the blocks that look for it
    weights = stored(wanted.select("term", "block").distinct().join(weights, "term"), "weights")
    shards = max(1, -(-n_postings // shard_postings))
    place = [F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "block"]
    left = impacts(own, weights, n_docs, n_terms or 1).select(*place, "row", "doc_id", "term", "impact")
    asked = wanted.groupBy("block", "item_id").agg(F.collect_list("term").alias("terms"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _search(k), "item_id long, row long, doc_id long, score long")
    by_rank = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return (found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
