"""Document fingerprints by order MinHash.

A text's elements are its k-mers of code points, each with its occurrence number, so that repeated k-mers count as often
as they stand.  Each of ``SLOTS`` hash functions selects the ``PICKED`` elements of least value, puts them back into text
order and hashes the tuple; the fingerprint is the list of these hashes.  Two texts agree in a slot if both select the
same elements in the same order, so the share of equal slots falls with edits and with moved text alike: it is sensitive
to edit distance where plain MinHash sees sets only.

The next document of each document (:func:`with_next`) needs one exchange of the texts: documents go to blocks of an order
by id, each block's first document also to the end of the block before, and a task walks its blocks row by row.  Block
bounds come from a sample of (id, text hash) keys, taken by a hash of the key, of at most some ``16 * BLOCKS`` rows
whatever the size of the table; bounds decide where work is done, never results.

Defined results: a null text counts as empty; texts of fewer than ``GRAM`` code points are one element; all empty texts
share one fingerprint; ids descend, rows without id come last, equal ids are ordered by a hash of their texts; repeated
rows are documents of their own, next to each other; the document after the last is the first, so a single document
follows itself; an empty table gives no rows; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

GRAM = 8
SLOTS = 64
PICKED = 2
BLOCK_ROWS = 1024
BLOCKS = 1 << 14
CELLS = 1 << 18  # hash values computed at once
FLUSH_CHARS = 1 << 20

_rng = np.random.default_rng(20190701)
_FACTOR = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def elements(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's k-mers with their occurrence numbers, in text order."""
    size = min(GRAM, len(points))
    if not size:
        return np.empty(0, np.uint64)
    n = len(points) - size + 1
    grams = np.full(n, np.uint64(size))
    for i in range(size):
        grams = grams * _P + points[i:n + i]
    grams = mix(grams)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return grams
    at = np.arange(n)
    seen = np.empty(n, np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(seen > 0, mix(grams + seen * _P), grams)


def fingerprint(text: str) -> np.ndarray:
    """``SLOTS`` hashes of 32 bits."""
    found = elements(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    if len(found) < PICKED:
        picked = np.zeros((SLOTS, PICKED), np.uint64)
        picked[:, :len(found)] = found
    else:
        low = (found >> np.uint64(32)).astype(np.uint32)
        picked = np.empty((SLOTS, PICKED), np.uint64)
        step = max(1, CELLS // len(low))
        for a in range(0, SLOTS, step):
            values = low * _FACTOR[a:a + step, None] + _SHIFT[a:a + step, None]
            rows = np.arange(len(values))
            places = np.empty((len(values), PICKED), np.int64)
            for k in range(PICKED):  # of equal values the first in the text
                places[:, k] = values.argmin(1)
                values[rows, places[:, k]] = np.iinfo(np.uint32).max
            places.sort(1)  # back in text order
            picked[a:a + step] = found[places]
    total = np.arange(SLOTS, dtype=np.uint64)
    for k in range(PICKED):
        total = mix(total * _P + picked[:, k])
    return (total >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots in which two fingerprints agree."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the following text's begin, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _order(doc_id: str, text: str) -> Column:
    """Ascending in this order is descending in ids: rows without id last, equal ids by the text's hash."""
    key = F.col(doc_id).cast("long")
    return F.struct(F.isnull(key).cast("long").alias("a"), F.coalesce(F.bitwise_not(key), F.lit(0).cast("long")).alias("b"),
                    F.xxhash64(F.coalesce(text, F.lit(""))).alias("c"))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(block, tail, doc_id, text) sorted within partitions: a document is followed by the next one, where need be by a
    copy (tail) of another block's first."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
                        _order(doc_id, text).alias("at"))
    total, first = keyed.agg(F.count(F.lit(1)), F.min("at")).first()
    blocks = min(BLOCKS, -(-total // BLOCK_ROWS))
    bounds = [] if first is None else [tuple(first)]
    if blocks > 1:
        one_in = max(1, total // (16 * blocks))
        taken = sorted(tuple(r["at"]) for r in keyed.where(F.pmod(F.xxhash64("at"), F.lit(one_in)) == 0).select("at").collect())
        bounds = sorted({tuple(first), *(taken[i * len(taken) // blocks] for i in range(blocks) if taken)})

    place = _places(bounds)
    dealt = keyed.withColumn("place", F.explode(place("at.a", "at.b", "at.c")))
    dealt = dealt.select(F.shiftright("place", 1).alias("block"), (F.col("place") % 2 == 1).alias("tail"), "at", "doc_id",
                         "text")
    parts = max(1, min(len(bounds), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return (dealt.repartition(parts, "block").sortWithinPartitions("block", "tail", "at")
            .select("block", "tail", "doc_id", "text"))


def _places(bounds: list[tuple[int, int, int]]):
    """Twice a key's block and, for a block's first key, also the end of the block before: twice that block plus one."""
    def places(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for key in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
            block = bisect.bisect_right(bounds, key) - 1
            own = [2 * block]
            if bounds[block] == key:
                own.append(2 * ((block or len(bounds)) - 1) + 1)
            out.append(own)
        return pd.Series(out)
    return F.pandas_udf(places, "array<long>")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, text and edited_text (by the next document), fingerprint and edited_fingerprint
    (binary, ``SLOTS`` unsigned 32-bit numbers, little-endian), near_edited and near_next (share of equal slots)."""
    names = ("doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        before = None  # the document that waits for its next
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2)]
            for block, tail, key, own in zip(*columns, batch.column(3), strict=True):
                if before is None and tail:
                    continue  # further copies of the next block's first
                own = own.as_py()
                mark = fingerprint(own)
                if before is not None:
                    changed = edited(before[1], own)
                    other = fingerprint(changed)
                    out.append((*before[:2], changed, before[2].tobytes(), other.tobytes(), likeness(before[2], other),
                                likeness(before[2], mark)))
                    size += len(changed)
                    if size > FLUSH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema=schema)
                        out, size = [], 0
                before = None if tail else (key, own, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema=schema)

    return with_next(docs, text, doc_id).mapInArrow(
        walk, "doc_id long, text string, edited_text string, fingerprint binary, edited_fingerprint binary, "
              "near_edited double, near_next double")


def digest(found: DataFrame) -> DataFrame:
    """The columns of op13 from :func:`fingerprints`."""
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                        F.lower(F.hex("fingerprint")).alias("fingerprint"),
                        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
