"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Test items give word n-grams, the seeds.  One pass over the texts meets them with every text: where n-grams of an item
   occur, the passage around them (at most four item lengths of words) is taken.
2. A passage can match no more words than it shares with its item, each counted as often as both have it.  Passages
   that cannot be reported by that bound leave; how often an n-gram or a copy occurs decides nothing.
3. The others are aligned with their item, word by word (match 2, mismatch and gap -1).  The score is the best local
   alignment over that of the whole item; pairs that reach ``THRESHOLD`` are reported, if the alignment is worth
   ``LEAST_WORDS`` words, or the whole of a shorter item.
4. A part of a long item counts for itself: pairs are also reported, with that same score, where a local alignment less 1
   for each item word it spans is worth ``PASSAGE`` words: 13 words in a row, or a longer stretch with edits.

So every text in which three words of an item stand in a row is judged by its alignment alone; edits that leave no such
three words are not seen.  ``threshold`` is that of the whole item; parts are reported at any threshold.

Test items are taken in blocks of at most ``BLOCK_CHARS`` characters (one item more at most), each block a pass of its
own, so what a task holds of the benchmark is bounded.

Defined results: null or empty texts and items with fewer than ``N`` words match nothing; repeated rows of a document
give one pair; documents without id are reported with a null id; an empty table gives no rows; an item's words are
compared in lower case without punctuation; repeated item ids with different texts are compared each, the best score
counts; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 3
THRESHOLD = 0.5
#: Aligned words of an item that are a copy, however long the item is.
PASSAGE = 13
#: An alignment worth fewer words is a phrase, unless it is the whole item; THRESHOLD asks as much of items twice as long.
LEAST_WORDS = 7
BLOCK_CHARS = 4_000_000
#: Words of passages that are held before they are aligned, and cells of one alignment grid.
HELD_WORDS = 500_000
GAP = 1.0

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """A block of test items as word numbers and sorted n-gram keys."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], np.int64)
                      for _, t in rows]
        self.counted = [np.unique(w, return_counts=True) for w in self.words]
        grams: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            for key in np.unique(self.keys(w)).tolist():
                grams.setdefault(key, []).append(k)
        self.sorted = np.array(sorted(grams), np.int64)
        self.holders = [grams[g] for g in self.sorted.tolist()]

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """One number per n-gram of a word sequence without unknown words."""
        size = len(self.vocabulary) + 1
        n = len(numbers) - N + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key = numbers[:n].copy()
        for k in range(1, N):
            key = key * size + numbers[k:n + k]
        return key

    def shared(self, item: int, numbers: np.ndarray) -> int:
        """Words that an item and a passage have in common, each as often as both have it."""
        own, often = self.counted[item]
        place = np.searchsorted(own, numbers)
        place[place == len(own)] = 0
        here = np.bincount(place[own[place] == numbers], minlength=len(own))
        return int(np.minimum(here, often).sum())


def _passages(found: Iterator[int], length: int) -> Iterator[tuple[int, int]]:
    """(first, last): places of one item's n-grams gathered in stretches of at most two item lengths."""
    first = last = None
    for at in found:
        if first is not None and (at - last > length or at - first > 2 * length):
            yield first, last
            first = None
        if first is None:
            first = at
        last = at
    if first is not None:
        yield first, last


def align(item: np.ndarray, passages: np.ndarray, span: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of passages (rows padded with -2) with an item, and the last passage word of each.

    Every item word that an alignment spans costs ``span``.  All rows advance together; within a row of the score matrix a running maximum stands for the gap along it.
    """
    rows, width = passages.shape
    above = np.zeros((rows, width + 1))
    slope = GAP * np.arange(1, width + 1)
    best, where = np.zeros(rows), np.zeros(rows, np.int64)
    real = passages != -2
    for w in item:
        here = np.maximum(above[:, :-1] + np.where(passages == w, 2.0 - span, -1.0 - span), above[:, 1:] - GAP - span)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here[~real] = 0
        top = here.argmax(1)
        score = here[np.arange(rows), top]
        better = score > best
        best[better], where[better] = score[better], top[better]
        above[:, 1:] = here
    return best, where


def _least(length: int, threshold: float) -> float:
    """What the best alignment with an item of that many words must reach."""
    return max(threshold * 2.0 * length, 2.0 * min(length, LEAST_WORDS))


def _judged(items: Items, item: int, passages: list[np.ndarray], threshold: float) -> Iterator[tuple[int, float, int]]:
    """(place in the list, score, last word) of the passages that count as copies of an item or of a part."""
    own = items.words[item]
    step = max(1, HELD_WORDS // max(map(len, passages)))
    for a in range(0, len(passages), step):
        part = passages[a:a + step]
        grid = np.full((len(part), max(map(len, part))), -2, np.int64)
        for k, p in enumerate(part):
            grid[k, :len(p)] = p
        score, where = align(own, grid)
        copied = score >= _least(len(own), threshold)
        # PASSAGE matches span as many item words, so the full score is 2 * PASSAGE at least
        perhaps = np.flatnonzero(~copied & (score >= 2 * PASSAGE))
        if len(perhaps):
            copied[perhaps] = align(own, grid[perhaps], 1.0)[0] >= PASSAGE
        for k in np.flatnonzero(copied).tolist():
            yield a + k, float(score[k] / (2.0 * len(own))), int(where[k])


def _pairs(docs: DataFrame, items: Items, text: str, doc_id: str, threshold: float) -> DataFrame:
    """(doc_id, mark, item_id, score, end_word): passages of the texts around n-grams of items that align with the item."""
    columns = "doc_id long, mark string, item_id long, score double, end_word long"
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.string()), ("item_id", pa.int64()),
                        ("score", pa.float64()), ("end_word", pa.int64())])
    number = items.vocabulary.get
    size = len(items.vocabulary) + 1

    def aligned(held: dict[int, list[tuple]]) -> pa.RecordBatch:
        out = [(of[k][0], of[k][1], items.ids[item], score, of[k][2] + where) for item, of in held.items()
               for k, score, where in _judged(items, item, [o[3] for o in of], threshold)]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[c] for o in out], f.type) for c, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        waiting = 0
        for batch in batches:
            for row, value in enumerate(batch.column(2)):
                said = words(value.as_py())
                numbers = np.fromiter(map(number, said, itertools.repeat(-1)), np.int64, len(said))
                n = len(numbers) - N + 1
                if n <= 0:
                    continue
                known = numbers >= 0
                all_known = known[:n].copy()
                for k in range(1, N):
                    all_known &= known[k:n + k]
                at = np.flatnonzero(all_known)
                if not len(at):
                    continue
                key = numbers[at]
                for k in range(1, N):
                    key = key * size + numbers[at + k]
                place = np.searchsorted(items.sorted, key)
                place[place == len(items.sorted)] = 0
                hit = items.sorted[place] == key
                by_item: dict[int, list[int]] = {}
                for p, g in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
                    for item in items.holders[g]:
                        by_item.setdefault(item, []).append(p)
                for item, found in by_item.items():
                    length = len(items.words[item])
                    fewest = min(_least(length, threshold) / 2, PASSAGE)
                    for first, last in _passages(iter(found), length):
                        start = max(0, first - length)
                        passage = numbers[start:last + N + length]
                        if items.shared(item, passage) < fewest:
                            continue
                        held.setdefault(item, []).append(
                            (batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), start, passage.astype(np.int32)))
                        waiting += len(passage)
                        if waiting >= HELD_WORDS:
                            yield aligned(held)
                            held, waiting = {}, 0
        if held:
            yield aligned(held)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(text, 256).alias("mark"),
                       F.col(text).alias("text")).mapInArrow(run, columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, mark, item_id, score, end_word): pairs of documents and test items; ``mark`` is the text's SHA-256."""
    listed = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    parts = []
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks).cast("long")) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in own.toLocalIterator()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        items = Items([r for r in rows if len(words(r[1])) >= N])
        parts.append(_pairs(docs, items, text, doc_id, threshold))
    pairs = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("score", "end_word")).alias("best")
    return (pairs.groupBy("doc_id", "mark", "item_id").agg(best)
            .select("doc_id", "mark", "item_id", "best.score", "best.end_word"))
