"""Shared storage, row keys and small column helpers of the text-corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; local sessions without that setting get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="bundleflow-llm-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: computed once, lineage cut, safe when executors go."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<s, e, size>>: start, end (code points, exclusive)
    and the length of ``group``.

    The pieces between matches give the gaps.  Offsets are summed in blocks of 512 matches, so a text with very
    many matches costs neither a quadratic copy nor a window.
    """
    block = 512

    def placed(gaps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(gaps) - 1) / block).cast("int")),
                             lambda b: F.slice(gaps, b * block + 1, F.lit(block)))

        def with_offsets(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, g: a + g.gap + g.len))
            offsets = F.aggregate(sums, F.array(F.lit(0)),
                                  lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

            def placed_block(p: Column, at: Column) -> Column:
                empty = F.expr("cast(array() as array<struct<s:int,e:int,size:int>>)")
                return F.aggregate(
                    p, F.struct(at.alias("at"), empty.alias("out")),
                    lambda a, g: F.struct(
                        (a.at + g.gap + g.len).alias("at"),
                        F.concat(a.out, F.array(F.struct((a.at + g.gap).alias("s"), (a.at + g.gap + g.len).alias("e"),
                                                         g["size"].alias("size")))).alias("out")),
                    lambda a: a.out)
            return let(offsets, lambda o: F.flatten(F.transform(parts, lambda p, i: placed_block(p, o[i]))))
        return let(blocks, with_offsets)

    pieces = F.split(text, pattern, -1)
    gaps = F.zip_with(
        F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                   F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                   lambda whole, part: F.struct(F.length(whole).alias("len"), F.length(part).alias("size"))),
        pieces,
        lambda m, p: F.struct(F.length(p).alias("gap"), m.len.alias("len"), m["size"].alias("size")))
    # the piece after the last match has no match beside it
    return let(F.filter(gaps, lambda g: g.len.isNotNull()), placed)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
