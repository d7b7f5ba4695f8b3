"""Periodic runs of words, found by seeds on diagonals.

A run is a stretch of consecutive words that repeats with smallest period q, is at least ``max(least, 3 q)`` words long,
and loses that period if a neighbouring word joins it.  On the diagonal of lag q (word i against word i + q) such a run is
an unbroken match of at least ``max(least - q, 2 q)`` words: the minimum guaranteed overlap.

* *Index.*  Lags up to 16 are served by grams of 16 words (24 - 8, the smallest overlap any lag guarantees), lags from
  2**s to 2**(s+1) by grams of 2**(s+1) words, so a gram is never longer than the overlap of the lags that it serves, nor
  shorter than their period.  Grams get exact names by doubling (a gram of 2k words is the pair of its halves); a
  position whose gram occurs once in its document leaves at once, since no longer gram there can repeat.
* *Enumerate.*  A gram's occurrences in a document are paired with the next one only.  That is enough: were there an
  occurrence between i and i + q inside a run of smallest period q, the run would have a smaller period, as the gram is
  at least q words long.  So each position gives one pair per gram length, however often a passage repeats.
* *Extend.*  Seeds are taken by lag and position and extended over their diagonal in both directions.  A table holds, for
  each lag, the furthest position covered so far; seeds before it are suppressed.

Every seed is a square in the word sequence, so the extended stretches are at most as many as the words.  Work is
n log n in the words of a text; a text is worked on as a whole, by one task, many short ones together.

Defined results: a null, empty or wordless text has no words and no runs; repeated rows are judged each for itself; an
empty table gives no rows; no result depends on ids or on order, so ties cannot occur outside :func:`digest`, which
breaks them by start, then period; very long texts are never cut; extra columns stay out of sight except those named in
``keep``, which are handed through under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LEAST = 24      # words of the shortest run
REPEATS = 3     # periods of the shortest run
SEED = 16       # words of the shortest seed: the overlap that LEAST and REPEATS guarantee at any lag
AT_ONCE = 1 << 18  # words of short texts worked on together
WORD = r"[^\x20\x09-\x0D]+"


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    if not len(first):
        return first
    return np.unique(first * (second.max() + 1) + second, return_inverse=True)[1].astype(np.int64)


def _repeated(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose name occurs more than once, with their names."""
    keep = np.bincount(names, minlength=1)[names] > 1
    return at[keep], names[keep]


def _doubled(at: np.ndarray, names: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of grams of ``2 * size`` words from those of ``size``."""
    where = np.full(n + 1, -1, np.int64)
    where[at] = names
    second = where[np.minimum(at + size, n)]
    whole = second >= 0
    return _repeated(at[whole], _names(names[whole], second[whole]))


def seeds(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) of equal grams that follow each other in one document, by lag, then position."""
    n = len(words)
    at, names = _repeated(np.arange(n), _names(document, words))
    lags, places = [], []
    size = 1
    while len(at):
        if size >= SEED:
            order = np.lexsort((at, names))
            same = names[order][1:] == names[order][:-1]
            here, there = at[order][:-1][same], at[order][1:][same]
            lag = there - here
            served = lag <= size if size == SEED else (lag > size // 2) & (lag <= size)
            lags.append(lag[served])
            places.append(here[served])
        at, names = _doubled(at, names, size, n)
        size *= 2
    if not lags:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lag, place = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    done, step, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done:min(n, done + step)] != b[done:min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 4
    return n


def runs_of(words: np.ndarray, document: np.ndarray, first: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run; ``first`` and ``stop`` bound the document of each number."""
    out = []
    covered: dict[int, int] = {}
    lag, place = seeds(words, document)
    # neighbours on one diagonal are one match; its first seed speaks for all
    head = np.ones(len(lag), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    for q, i in zip(lag[head].tolist(), place[head].tolist(), strict=True):
        if i < covered.get(q, 0):
            continue
        d = document[i]
        low, high = int(first[d]), int(stop[d])
        start = i - _agree(words[low:i][::-1], words[low + q:i + q][::-1])
        end = i + q + _agree(words[i:high - q], words[i + q:high])
        covered[q] = end - q
        if end - start >= max(LEAST, REPEATS * q):
            out.append((start, end - start, q))
    return out


def _worked(texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs by start, then period, kept words joined by a space) of each text."""
    split = [(t or b"").split() for t in texts]  # on the six ASCII separators
    sizes = np.array([len(s) for s in split], np.int64)
    stop = np.cumsum(sizes)
    first = stop - sizes
    document = np.repeat(np.arange(len(split)), sizes)
    flat = pa.array([w for s in split for w in s], pa.large_binary())
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.empty(0, np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, length, q in runs_of(words, document, first, stop):
        d = int(document[start])
        found[d].append((start - int(first[d]), length, q))
    for own, runs in zip(split, found, strict=True):
        n = len(own)
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            edge = np.zeros(n + 1, np.int64)
            for start, length, q in runs:
                edge[start + q] += 1
                edge[start + length] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
        yield n, runs, b" ".join(own)


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of ``keep``, n_words, runs array<struct<start, length, period>> by start, then
    period, and collapsed: the text's words without those that a run holds after its first period, one space between."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            a = 0
            while a < len(texts):
                held, size, b = [], 0, a
                while b < len(texts) and size < 8 * AT_ONCE:  # a word takes some eight bytes
                    held.append(texts[b].as_py())
                    size += len(held[-1] or b"")
                    b += 1
                counts, runs, left = [], [], []
                for n, own, collapsed in _worked(held):
                    counts.append(n)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    left.append(collapsed)
                out = [pa.array(counts, pa.int64()), pa.array(runs, schema[1].type), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], ["kept", *schema.names])
                a = b

    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("kept")
    rows = docs.select(kept, F.col(f"`{text}`").alias("text"))
    kind = ",".join(f"c{i}:{docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(work, f"kept struct<{kind}>, n_words long, "
                                "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)], *schema.names)


def repeated_text(text: Column, doc_id: Column) -> Column:
    """The text whose words from a place on repeat, for ids whose checksum ends in 0; otherwise the text itself.

    With n words, h the CRC-32 of the id in decimal and g = h div 10: each word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + (n - a) div (3 + g % 8).  A row without id keeps its text.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def changed(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)

        def from_place(place: Column) -> Column:
            a = place.cast("int")
            p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("int")
            return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p)))
        return F.array_join(let(g % n, from_place), " ")

    return F.when((h % 10 == 0) & text.rlike(WORD), let(words, changed)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The columns of op11 from :func:`find_runs` (doc_id, n_words, runs, collapsed).

    The best run has the greatest exact length / period; of equal ones the smallest start, then period.
    """
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    # runs come by start, then period: only a greater quotient replaces the best so far
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r)
                       .otherwise(b))
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
                    F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
