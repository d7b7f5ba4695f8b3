"""Incremental runs over a growing inbox.

Each micro-batch is one run: new files are picked up exactly once by the stream's
checkpoint, processed by a batch function, and written under the micro-batch's id, so
a batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Handler = Callable[[DataFrame, int], dict[str, DataFrame]]


def table_path(out: str, table: str) -> str:
    return f"{out.rstrip('/')}/{table}"


def _write(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table_path(out, table)}/stream_batch={batch_id}")


def run_inbox(source: DataFrame, out: str, checkpoint: str, handle: Handler, name: str = "inbox") -> StreamingQuery:
    """Process everything that is new, then stop (``availableNow``)."""
    def on_batch(df: DataFrame, batch_id: int) -> None:
        for table, result in handle(df, batch_id).items():
            _write(result, out, table, batch_id)

    return (source.writeStream.queryName(name).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).foreachBatch(on_batch).start())


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def mail_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New ``.eml`` files of a folder as ``path, content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return file_stream(spark, path, schema, "binaryFile", "*.[eE][mM][lL]", files_per_batch).select("path", "content")


def read_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(out, table))


# --- batch numbers that continue through a day --------------------------------
COUNTER_SCHEMA = "run_date date, invoices long, stream_batch int"


class DayCounter:
    """Next batch number of a day across runs.

    Each run leaves one row with the documents it batched.  The start of run *n* is one
    more than the sum over the day's earlier runs, so repeating a run finds the same
    start and replaces its own row.
    """

    def __init__(self, out: str):
        self.out = out

    def _rows(self, spark: SparkSession) -> DataFrame:
        try:
            stored = spark.read.schema(COUNTER_SCHEMA).parquet(table_path(self.out, "_day_counter"))
        except Exception as e:  # first run: nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], COUNTER_SCHEMA)
        return stored

    def start(self, spark: SparkSession, run_date: str, batch_id: int) -> Column:
        """Scalar column with the first number of this run.

        A micro-batch runs in a session of its own; pass that one.
        """
        day = F.lit(run_date).cast("date")
        earlier = self._rows(spark).where((F.col("run_date") == day) & (F.col("stream_batch") < batch_id))
        return earlier.agg((F.coalesce(F.sum("invoices"), F.lit(0)) + 1).alias("n")).scalar()

    def record(self, batches: DataFrame, run_date: str, batch_id: int) -> None:
        used = batches.agg(F.coalesce(F.sum("invoice_count"), F.lit(0)).cast("long").alias("invoices")).select(
            F.lit(run_date).cast("date").alias("run_date"), "invoices")
        _write(used, self.out, "_day_counter", batch_id)
