"""Which texts of a folder hold one of its numbers, or lie inside one.

The numbers of a folder are looked up, never tried one by one.  *Number in text*: the text's substrings of just the
lengths that the folder's numbers have meet a hashed set.  *Text in number*: a text inside a number begins one of its
suffixes, so it is a stretch of the sorted suffixes.  Work per text follows from its length, the lengths and the hits,
and not from how many numbers there are.

That is for folders with more than ``FEW`` numbers or ``TEXTS`` texts.  They are dealt to groups by a hash; the texts of a
folder with more than ``TEXTS`` are split over several groups, each of which has the folder's numbers.  In any other folder
each text meets the few numbers by a join on the folder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import cut_lineage

TEXTS = 1 << 16  # of one group
FEW = 8          # numbers of a folder that every text may meet
_AFTER = "~"     # sorts behind letters and digits


class Numbers:
    """The numbers of one folder: ``digits`` are compared with digit runs, ``norms`` (a-z, 0-9) by containment."""

    def __init__(self, digits: list[str], norms: list[str]):
        self.digits = set(digits)
        self.by_length: dict[int, set[str]] = {}
        for norm in norms:
            self.by_length.setdefault(len(norm), set()).add(norm)
        self.suffixes = sorted((norm[i:], norm) for norm in set(norms) for i in range(len(norm)))

    def same_digits(self, runs: list[str]) -> set[str]:
        return self.digits.intersection(runs)

    def around(self, text: str) -> set[str]:
        """The norms that ``text`` holds or lies in; every norm holds the empty text."""
        found = {text[i:i + size] for size in self.by_length if size <= len(text)
                 for i in range(len(text) - size + 1) if text[i:i + size] in self.by_length[size]}
        begin = bisect_left(self.suffixes, (text,))
        end = bisect_left(self.suffixes, (text + _AFTER,))
        found.update(norm for _, norm in self.suffixes[begin:end])
        return found


_HITS = pa.schema([("folder", pa.string()), ("sheet_idx", pa.int32()), ("sheet_name", pa.string()),
                   ("digits", pa.string()), ("norm", pa.string())])


def _hits(texts: pa.Table, numbers: pa.Table) -> pa.Table:
    own: dict[str, tuple[list[str], list[str]]] = {}
    for folder, digits, norm in zip(*(numbers[c].to_pylist() for c in ("folder", "digits", "norm")), strict=True):
        digit_list, norm_list = own.setdefault(folder, ([], []))
        if digits is not None:
            digit_list.append(digits)
        if norm is not None:
            norm_list.append(norm)
    index = {folder: Numbers(*lists) for folder, lists in own.items()}

    def rows() -> Iterator[tuple]:
        for folder, sheet, name, norm, runs in zip(
                *(texts[c].to_pylist() for c in ("folder", "sheet_idx", "sheet_name", "norm", "runs")), strict=True):
            if (known := index.get(folder)) is None:
                continue
            for digits in known.same_digits(runs):
                yield folder, sheet, name, digits, None
            if known.suffixes:
                for hit in known.around(norm):
                    yield folder, sheet, name, None, hit
    found = list(dict.fromkeys(rows()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), _HITS)], schema=_HITS) if found else _HITS.empty_table()


def hits(texts: DataFrame, numbers: DataFrame, at_once: int = TEXTS) -> DataFrame:
    """Distinct ``folder, sheet_idx, sheet_name, digits, norm``: which number (by digits or by norm) each sheet has.

    ``texts(folder, sheet_idx, sheet_name, norm, runs)``: letters and digits of a cell, and its digit runs;
    ``numbers(folder, digits, norm)``: distinct, one of the two null.
    """
    texts, numbers = cut_lineage(texts), cut_lineage(numbers)
    many = cut_lineage(texts.groupBy("folder").count().where(F.col("count") > at_once).select("folder").unionByName(
        numbers.groupBy("folder").count().where(F.col("count") > FEW).select("folder")).distinct())
    if many.isEmpty():
        return _met(texts, numbers).distinct()
    small = _met(*(df.join(many, "folder", "left_anti") for df in (texts, numbers)))
    return small.unionByName(_looked_up(*(df.join(many, "folder", "left_semi") for df in (texts, numbers)), at_once)).distinct()


def _met(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """The same for folders with few numbers."""
    text, wanted = F.col("norm"), F.col("_wanted")
    fits = F.array_contains("runs", F.col("digits")) | F.contains(text, wanted) | F.contains(wanted, text)
    return (texts.join(numbers.withColumnRenamed("norm", "_wanted"), "folder").where(fits)
            .select("folder", "sheet_idx", "sheet_name", "digits", wanted.alias("norm")))


def _looked_up(texts: DataFrame, numbers: DataFrame, at_once: int) -> DataFrame:
    """The same for folders with any number of texts and numbers."""
    zero = F.lit(0).cast("long")
    total = texts.count()
    groups = max(-(-total // at_once), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = (texts.groupBy("folder").count().where(F.col("count") > at_once)
             .select("folder", F.ceil(F.col("count") / at_once).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    group = F.pmod(F.xxhash64("folder", "part"), F.lit(groups)).alias("group")
    left = (texts.join(large, "folder", "left").withColumn("part", F.pmod(F.xxhash64("sheet_idx", "norm", "runs"), parts))
            .select(group, *texts.columns))
    right = (numbers.join(large, "folder", "left").withColumn("part", F.explode(F.sequence(zero, parts - 1)))
             .select(group, "folder", "digits", "norm"))
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(
        _hits, "folder string, sheet_idx int, sheet_name string, digits string, norm string")
