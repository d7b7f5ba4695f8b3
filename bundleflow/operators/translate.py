"""Translations from a user's translator, each name sent once.

A translator is a function from a list of names to a list of translations (None where it has none).  It runs in the
tasks, a batch of names per call.  What it answers is kept in a memo table, one folder per run; names that the memo knows
are never sent again.  A task that is repeated after the loss of its executor sends its own names again, and its answers
replace those of the lost attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

Translator = Callable[[list[str]], list[str | None]]
_MEMO = "src string, dst string, run string"


class Memo:
    """``src, dst, run`` of every name sent so far, below ``path``."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def read(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(_MEMO).parquet(self.path).select("src", "dst", "run")
        except Exception as e:  # nothing sent yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], _MEMO)

    def add(self, run: str, answers: DataFrame) -> None:
        """Replaces what an earlier attempt of this run left."""
        answers.select("src", "dst").write.mode("overwrite").parquet(f"{self.path}/run={run}")


def _call(translate: Translator, size: int):
    schema = pa.schema([("src", pa.string()), ("raw", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a in range(0, len(names), size):
                part = names[a:a + size]
                answers = translate(part)
                if len(answers) != len(part):
                    raise ValueError(f"the translator gave {len(answers)} answers to {len(part)} names")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(answers, pa.string())], schema=schema)
    return work


def translate_new(names: DataFrame, name: str, memo: Memo, run: str, translate: Translator, size: int = 64) -> DataFrame:
    """``translations(src, dst)`` of all names with non-ASCII characters; those the memo lacks are sent, once each.

    Answers are cleaned; an empty one stands for its name.
    """
    spark = names.sparkSession
    wanted = names.select(F.col(name).alias("src")).where(text.non_ascii("src")).distinct()
    earlier = memo.read(spark).where(F.col("run") != run)
    missed = wanted.join(earlier.select("src"), "src", "left_anti")
    answers = missed.mapInArrow(_call(translate, size), "src string, raw string")
    memo.add(run, answers.select("src", text.clean_translation("raw", "src").alias("dst")))
    return memo.read(spark).join(wanted, "src", "left_semi").select("src", "dst")


def missed_names(matches: DataFrame) -> DataFrame:
    """The names of ``match_names`` output (without translations) that are worth a translation: no match, not ASCII."""
    return matches.where((F.col("method") == "no_match") & text.non_ascii("name")).select("name")
