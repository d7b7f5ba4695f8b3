"""Reports and manifests of runs, kept by run.

Every table has a folder per run.  Writing a run again replaces its own folders and leaves the others; the list of runs is
written last, so a run that is listed is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import write_report

_RUNS = "_runs"
_RUNS_SCHEMA = "table_name string, n_rows long, run string"


def _plain(df: DataFrame) -> DataFrame:
    """Column names that every format takes; :func:`titled` turns them back."""
    return df.select([F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in df.columns])


def titled(df: DataFrame, titles: list[str]) -> DataFrame:
    return df.select([F.col(f"`{t.replace(' ', '_')}`").alias(t) for t in titles])


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def write_run(spark: SparkSession, tables: dict[str, DataFrame], out: str, run: str, fmt: str = "parquet") -> None:
    """Each table to ``out/<table>/run=<run>``, then the run's lines in the list of runs."""
    out = out.rstrip("/")
    for name, df in tables.items():
        write_report(_plain(df).withColumn("run", F.lit(run)), f"{out}/{name}", fmt, by=("run",))
    lines = None
    for name in tables:
        line = _load(spark, f"{out}/{name}", fmt).where(F.col("run") == run).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(run).alias("run"))
        lines = line if lines is None else lines.unionByName(line)
    if lines is not None:
        write_report(lines.coalesce(1), f"{out}/{_RUNS}", "parquet", by=("run",))


def runs(spark: SparkSession, out: str) -> DataFrame:
    """``run, table_name, n_rows`` of every complete run."""
    return spark.read.schema(_RUNS_SCHEMA).parquet(f"{out.rstrip('/')}/{_RUNS}").select("run", "table_name", "n_rows")


def read_run(spark: SparkSession, out: str, table: str, run: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of one complete run, or of all of them."""
    done = runs(spark, out).where(F.col("table_name") == table).select("run")
    rows = _load(spark, f"{out.rstrip('/')}/{table}", fmt).join(done, "run", "left_semi")
    return rows if run is None else rows.where(F.col("run") == run)
