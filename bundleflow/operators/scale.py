"""Order-dependent work on groups of any size.

A window runs each of its groups in one task, so a group that holds a large share
of all rows must not become a window.  The helpers here cut an ordered group into
blocks of a fixed width, work inside the blocks, and carry one summary row per
block: every window group then has a size that follows from the block width and
the type of the order column, not from the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, NullType, StructType

BLOCK_BITS = 16   # rows of one block share order >> 16
FAN_BITS = 20     # blocks under one parent


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; make one only for local sessions."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="bundleflow-checkpoint-")
    sc.setCheckpointDir(shared)


@contextmanager
def run_stages(spark: SparkSession) -> Iterator[str]:
    """Stages stored inside the block go to a folder of their own below the checkpoint folder, which is removed at its
    end; write or collect what is to outlive them first.  One block at a time in an application."""
    checkpoint_dir(spark)
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(before)  # Spark makes a new folder of its own below it
    own = sc.getCheckpointDir()
    try:
        yield own
    finally:
        sc.setCheckpointDir(before.rpartition("/")[0])
        _remove(spark, own)


#: Spark removes the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_GROUP_BYTES = 32 << 20  # of a stored row group, which a task holds while it writes

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def _as_columns(kind: DataType) -> bool:
    """Whether a type is stored by columns.  Bytes may be whole files: thousands of those must not meet in one batch."""
    if isinstance(kind, StructType):
        names = [n.lower() for n in kind.names]
        return 0 < len(names) == len(set(names)) and all(_as_columns(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _as_columns(kind.elementType)
    if isinstance(kind, MapType):
        return _as_columns(kind.keyType) and _as_columns(kind.valueType)
    return not isinstance(kind, (BinaryType, NullType)) and "interval" not in kind.typeName()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _stored(df: DataFrame, folder: str) -> None:
    """Write ``df`` below a stage's folder and remove what it exchanged."""
    with _shuffles_removed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").option("parquet.block.size", _GROUP_BYTES).parquet(folder)


def _new_stage(spark: SparkSession) -> str:
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a stage that several outputs read, so that it is computed once and
    survives the loss of executors.

    Stages are compressed Parquet below the checkpoint folder: Spark's own checkpoint holds every row as a Java object,
    several times as large and read whole by whoever needs one column.
    """
    spark = df.sparkSession
    if not _as_columns(df.schema):
        checkpoint_dir(spark)
        return df.checkpoint()
    folder = _new_stage(spark)
    _stored(df, folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Stages stored inside the block are removed at its end; what outlives it must not read them."""
    token = _passing.set(inner := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for folder in inner:
            _remove(spark, folder)


def slices_of(df: DataFrame, rows: int) -> int:
    """How many slices of about ``rows`` rows a stored stage has."""
    return max(1, -(-df.count() // rows))


def in_slice(df: DataFrame, key: str, i: int, slices: int) -> DataFrame:
    """The rows whose ``key`` falls into the ``i``-th slice."""
    return df if slices == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)


def by_slices(spark: SparkSession, begin: Callable[[], tuple[int, Callable[[int], DataFrame]]]) -> DataFrame:
    """One stage from parts: ``begin()`` gives their number and ``make``, and ``make(0)``, ``make(1)``, ... are stored one
    after another.  What a part exchanges and stores on its way is removed before the next begins, and what ``begin``
    stored at the end, so beside the stage the whole takes the room of one part."""
    folder = _new_stage(spark)
    kept = None
    with passing_stages(spark):
        slices, make = begin()
        for i in range(slices):
            with passing_stages(spark):
                part = make(i)
                if _as_columns(part.schema):
                    _stored(part, folder)
                else:
                    part = part.checkpoint()
                    kept = part if kept is None else kept.unionByName(part)
    return spark.read.schema(part.schema).parquet(folder) if kept is None else kept


def running_total(df: DataFrame, value: Column, order: str, out: str,
                  keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Exclusive running sum of ``value`` by a non-negative BIGINT ``order`` within ``keys``.

    Sums are taken per block of 2**16 order values, per 2**20 blocks and per 2**20
    of those, which covers the 63 bits; block sums combine before the shuffle.  ``whole``
    says that no group has more rows than a block has order values: then one window does.
    Rows without a key or an order are left out.
    """
    keys = list(keys)

    def exclusive(part: list[str], by: list[str], col: str) -> Column:
        w = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(col).over(w), F.lit(0))

    if whole:
        return (df.dropna(subset=[*keys, order]).withColumn("_v", value)
                .withColumn(out, exclusive(keys, [order, *ties], "_v")).drop("_v"))
    # every level reads the rows again, so they are stored once
    work = cut_lineage(df.withColumn("_v", value)).withColumn(
        "_b0", F.shiftright(F.col(order).cast("long"), BLOCK_BITS))

    sums = [work.groupBy(*keys, "_b0").agg(F.sum("_v").alias("_s0"))]
    for i in (1, 2):
        up = sums[-1].withColumn(f"_b{i}", F.shiftright(f"_b{i-1}", FAN_BITS))
        sums[-1] = up
        sums.append(up.groupBy(*keys, f"_b{i}").agg(F.sum(f"_s{i-1}").alias(f"_s{i}")))

    offset = sums[2].select(*keys, "_b2", exclusive(keys, ["_b2"], "_s2").alias("_o2"))
    for i in (1, 0):
        offset = (sums[i].withColumn("_in", exclusive(keys + [f"_b{i+1}"], [f"_b{i}"], f"_s{i}"))
                  .join(offset, keys + [f"_b{i+1}"])
                  .select(*keys, f"_b{i}", (F.col("_in") + F.col(f"_o{i+1}")).alias(f"_o{i}")))
    return (work.withColumn("_in", exclusive(keys + ["_b0"], [order, *ties], "_v"))
            .join(offset, keys + ["_b0"])
            .withColumn(out, F.col("_in") + F.col("_o0"))
            .drop("_v", "_b0", "_in", "_o0"))
