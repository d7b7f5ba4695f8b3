"""Quarantine, destinations and cumulative batch numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text
from .scale import running_total

DESTINATION = ["folder_ord", "folder", "kofax_email", "le"]


def folder_summary(documents: DataFrame, pdf_errors: DataFrame) -> DataFrame:
    """``folder, invoice_count, n_errors, n_review, quarantined`` for every folder.

    ``pdf_errors(folder, folder_ord, source_file, error)`` lists bundles that could
    not be processed; they hold no documents.
    """
    docs = documents.groupBy("folder", "folder_ord").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.count_if("needs_manual_review").alias("n_review"))
    errors = pdf_errors.groupBy("folder", "folder_ord").agg(F.count(F.lit(1)).alias("n_errors"))
    both = (docs.withColumn("n_errors", F.lit(0).cast("long"))
            .unionByName(errors.select("folder", "folder_ord", F.lit(0).cast("long").alias("invoice_count"),
                                       F.lit(0).cast("long").alias("n_review"), "n_errors")))
    return (both.groupBy("folder", "folder_ord")
            .agg(*[F.sum(c).alias(c) for c in ("invoice_count", "n_errors", "n_review")])
            .withColumn("quarantined", (F.col("n_errors") > 0) | (F.col("n_review") > 0)))


def quarantine(documents: DataFrame, pdf_errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into (clean, quarantined): one doubtful document or failed
    bundle holds back its whole folder."""
    held = (documents.where("needs_manual_review").select("folder")
            .unionByName(pdf_errors.select("folder")).distinct())
    return documents.join(held, "folder", "left_anti"), documents.join(held, "folder", "left_semi")


def tag_suffix() -> Column:
    """Aggregate: suffix from the tags of all documents in a batch."""
    def flag(cond, word):
        return F.when(F.bool_or(F.coalesce(cond, F.lit(False))), word).otherwise("")
    return F.concat(flag(F.array_contains("tags", "TELECOM"), "-TELCO"),
                    flag(F.array_contains("tags", "DD"), "-DD"),
                    flag(F.col("is_sensitive"), "-SENSITIVE"))


def assign_batches(clean: DataFrame, run_date, start: int | Column = 1,
                   config_code: str = lx.CONFIG_CODE) -> DataFrame:
    """One row per (folder, mailbox, entity) with its batch id.

    The counter of a batch is one more than all documents batched before it, in
    (folder order, mailbox, entity) order over the whole run.  Destinations without
    a mailbox or entity get no batch and do not advance the counter.
    """
    groups = (clean.groupBy(*DESTINATION)
              .agg(F.count(F.lit(1)).alias("invoice_count"), tag_suffix().alias("suffix"))
              .where((F.col("kofax_email") != "") & (F.col("le") != "")))
    numbered = running_total(groups, F.col("invoice_count"), "folder_ord", "_before", ties=("kofax_email", "le"))
    date = F.lit(run_date).cast("date") if isinstance(run_date, str) else F.lit(run_date)
    first = start if isinstance(start, Column) else F.lit(start)
    counter = F.col("_before") + first
    bid = text.batch_id("le", text.day_letter(date), counter, F.col("suffix"), config_code)
    return numbered.select(
        bid.alias("batch_id"), "kofax_email", "le", F.col("folder").alias("source_email"), "folder_ord",
        "invoice_count", counter.alias("counter"),
        F.concat_ws("/", text.sanitize_path_part("kofax_email"), bid).alias("staged_dir"))


def with_batch_id(clean: DataFrame, batches: DataFrame) -> DataFrame:
    """Stamp each clean document with its batch; null where its destination is incomplete."""
    ids = batches.select(F.col("source_email").alias("folder"), "kofax_email", "le", "batch_id")
    return clean.join(ids, ["folder", "kofax_email", "le"], "left")
