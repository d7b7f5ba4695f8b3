"""File inventories from a listing; file contents are never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text
from ..operators.messages import attachment_type


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``), ``length``, ``modified`` of every file under ``root``."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
              .select("path", "length", F.col("modificationTime").alias("modified")))
    base = root.rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"),
                             r"^\Q" + base + r"\E/", "")
    return listed.withColumn("path", below)


def _folder(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def folder_files(files: DataFrame, root_name: str, recursive: bool = False) -> DataFrame:
    """``folder, path, kind`` for each file that belongs to a folder below the root.

    Without any subfolder the root is the only folder.  ``recursive`` gathers deeper
    files under the first folder on their path; otherwise only its direct files count.
    """
    depth = F.size(F.split("path", "/")) - 1
    deepest = files.agg(F.coalesce(F.max(depth), F.lit(0)).alias("d")).scalar()
    nested = depth >= 1 if recursive else depth == 1
    lock = F.startswith(text.base_name("path"), F.lit("~$"))
    kind = attachment_type("path")
    return (files.withColumn("_deepest", deepest)
            .where(F.when(F.col("_deepest") > 0, nested).otherwise(depth == 0))
            .where(~lock | (kind == "pdf"))
            .select(F.when(F.col("_deepest") > 0, _folder(F.col("path"))).otherwise(root_name).alias("folder"),
                    "path", F.when(kind.isin("pdf", "excel"), kind).otherwise("other").alias("kind")))


def folder_inventory(files: DataFrame, root_name: str = "root", recursive: bool = False,
                     keep_empty: bool = False) -> DataFrame:
    """Counts per folder; folders without a PDF only with ``keep_empty``."""
    kind = F.col("kind")
    counts = folder_files(files, root_name, recursive).groupBy("folder").agg(
        F.count_if(kind == "pdf").alias("pdfs"), F.count_if(kind == "excel").alias("excels"),
        F.count_if(kind == "other").alias("others"))
    return counts if keep_empty else counts.where(F.col("pdfs") > 0)


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.coalesce(F.sum("pdfs"), F.lit(0)).alias("total_pdfs"),
        F.coalesce(F.sum("excels"), F.lit(0)).alias("total_excels"), F.count(F.lit(1)).alias("total_folders"))


def mail_files(files: DataFrame) -> DataFrame:
    """Supported mail files directly in the inbox folder."""
    return files.where(F.lower(text.file_suffix("path")).isin(lx.MAIL_TYPES) & ~F.contains("path", F.lit("/")))


# --- runs ---------------------------------------------------------------------
def run_paths(runs: DataFrame, results_root: str) -> DataFrame:
    """Every run of every day with its folders and report name."""
    day = F.date_format("run_date", "yyyy-MM-dd")
    root = F.concat_ws("/", F.lit(results_root.rstrip("/")), day, "run_name")
    return (runs.where(F.startswith("run_name", F.lit("run_")))
            .select("run_date", "run_name", root.alias("run_root"),
                    F.concat(root, F.lit("/01_extracted")).alias("extracted"),
                    F.concat(root, F.lit("/02_blocked")).alias("blocked"),
                    F.concat(root, F.lit("/03_processed")).alias("processed"),
                    text.report_name("invoice_report", day, F.col("run_name")).alias("report_name"),
                    F.concat_ws("/", day, "run_name").alias("run_label")))


def latest_run(runs: DataFrame, results_root: str) -> DataFrame:
    """The last run of each day by name."""
    last = (runs.where(F.startswith("run_name", F.lit("run_")))
            .groupBy("run_date").agg(F.max("run_name").alias("run_name")))
    return run_paths(last, results_root)


# --- message metadata -----------------------------------------------------------
METADATA_SCHEMA = ("msg_path string, folder_name string, output_folder string, sender_name string, "
                   "sender_email string, subject string, received_date string, "
                   "attachments struct<pdfs:array<string>,excels:array<string>,xmls:array<string>,other:array<string>>, "
                   "groups map<string,array<string>>, blocked boolean, block_reasons array<string>, "
                   "blocked_msg_copy string, error string")
METADATA_FIELDS = [f.split()[0] for f in METADATA_SCHEMA.split(", ")]


def metadata_records(messages: DataFrame, inventory: DataFrame, reasons: DataFrame) -> DataFrame:
    """The record of each message: ``message_id`` and the fields of ``METADATA_SCHEMA``.

    ``messages`` has the columns of the schema that are one value; ``inventory(message_id, group_name, kind, path)`` its
    files, ``reasons(message_id, reason)`` why it was held back.  Lists are bounded by one mail and in order.
    """
    def paths(kind: str):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("path")))).alias(kind + ("" if kind == "other" else "s"))

    # a group's files, then a mail's groups
    grouped = inventory.groupBy("message_id", "group_name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups = grouped.groupBy("message_id").agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("group_name", "paths")))).alias("groups"))
    files = inventory.groupBy("message_id").agg(*[paths(k) for k in ("pdf", "excel", "xml", "other")]).select(
        "message_id", F.struct("pdfs", "excels", "xmls", "other").alias("attachments"))
    held = reasons.groupBy("message_id").agg(F.sort_array(F.collect_list("reason")).alias("block_reasons"))
    rows = (messages.join(files, "message_id", "left").join(groups, "message_id", "left").join(held, "message_id", "left")
            .withColumn("blocked", F.col("block_reasons").isNotNull())
            .withColumn("block_reasons", F.coalesce("block_reasons", F.array().cast("array<string>"))))
    none = F.lit(None).cast("string")
    return rows.select("message_id", *[F.col(c) if c in rows.columns else none.alias(c) for c in METADATA_FIELDS])


def write_metadata(records: DataFrame, path: str) -> None:
    """One JSON record per message, a folder per run if there is a column ``run``; a run that is written again replaces
    its own folder only."""
    writer = records.write.mode("overwrite")
    if "run" in records.columns:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("run")
    writer.json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The records that :func:`write_metadata` left, with all fields of the schema."""
    return spark.read.schema("message_id string, " + METADATA_SCHEMA + ", run string").json(path)


def load_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Message records and bodies stored beside the attachments, keyed by ``dir``."""
    def read(name):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)

    def folder(path):
        return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), r"/[^/]*$", "")

    meta = (read("email_metadata.json").schema(METADATA_SCHEMA).option("multiLine", True).json(root)
            .withColumn("dir", folder(F.col("_metadata.file_path"))))
    body = (read("email_body.txt").option("wholetext", True).text(root)
            .select(F.col("value").alias("body"), folder(F.col("_metadata.file_path")).alias("dir")))
    return meta.join(body, "dir", "left").withColumn("body", F.coalesce("body", F.lit("")))


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Message of each file: from its own folder, else from the parent folder."""
    parent = F.regexp_replace("dir", r"/[^/]*$", "")
    fields = [c for c in metadata.columns if c != "dir"]
    packed = metadata.select("dir", F.struct(*fields).alias("m"))
    own = files.withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    both = (own.join(packed.withColumnRenamed("m", "own"), "dir", "left").withColumn("dir", parent)
            .join(packed.withColumnRenamed("m", "up"), "dir", "left"))
    return both.withColumn("m", F.coalesce("own", "up")).select(*files.columns, "m.*")
