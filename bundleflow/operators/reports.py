"""Flat reports, manifests and run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .naming import unique_names


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def invoice_report(documents: DataFrame) -> DataFrame:
    """The 24-column invoice report, one row per document of a processed bundle."""
    reasons = F.array_join(F.transform("review_reasons", lambda r: r["message"]), "; ")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return documents.select(
        F.col("folder").alias("Folder"), text.base_name("source_file").alias("Source PDF"),
        _text("invoice_number").alias("Invoice #"), _text("supplier_name").alias("Supplier"),
        _text("bill_to").alias("Bill To"),
        F.coalesce(F.array_join("po_numbers", ", "), F.lit("")).alias("PO Number(s)"),
        flag("is_sensitive").alias("Is Sensitive"), _text("sensitive_name").alias("Sensitive Match"),
        F.col("sensitive_score").alias("Sensitive Score"),
        flag("sensitive_translated").alias("Sensitive Matched Via Translation"),
        _text("le").alias("LE"), _text("source_site").alias("Source Site"), _text("country").alias("LE Country"),
        _text("le_matched_name").alias("LE Matched Name"), F.col("le_score").alias("LE Score"),
        flag("le_translated").alias("LE Matched Via Translation"),
        _text("invoice_type").alias("Invoice Type"), _text("kofax_email").alias("Kofax Email"),
        _text("vn_supplier_id").alias("Vietnam Supplier ID"), _text("vn_supplier_name").alias("Vietnam Supplier Name"),
        flag("vn_renamed").alias("Vietnam Renamed"), flag("needs_manual_review").alias("Needs Review"),
        F.coalesce(reasons, F.lit("")).alias("Review Reasons"),
        text.base_name(_text("output_pdf")).alias("Output File"))


def single_bundle_report(documents: DataFrame, source_file: str) -> DataFrame:
    return invoice_report(documents.where(F.col("source_file") == source_file))


def failure_rows(held: DataFrame, pdf_errors: DataFrame) -> DataFrame:
    """One row per failed bundle and per reason of each flagged document of a
    quarantined folder."""
    failed = pdf_errors.select(
        F.col("folder").alias("source_email"), F.lit(None).cast("string").alias("invoice_number"),
        F.lit(None).cast("string").alias("supplier"),
        F.concat(F.lit("pdf_processing_error: "), "error").alias("failure_reason"))
    flagged = (held.where("needs_manual_review")
               .select("folder", "invoice_number", "supplier_name", F.explode_outer("review_reasons").alias("r")))
    why = F.coalesce(text.blank_to_null(F.col("r.code")), text.blank_to_null(F.col("r.message")),
                     F.lit("needs_manual_review (no reason recorded)"))
    return failed.unionByName(flagged.select(
        F.col("folder").alias("source_email"), "invoice_number", F.col("supplier_name").alias("supplier"),
        why.alias("failure_reason")))


def failure_sheet(failures: DataFrame) -> DataFrame:
    return failures.select(
        F.col("source_email").alias("Source Email"), F.col("invoice_number").alias("Invoice #"),
        F.col("supplier").alias("Supplier"), F.col("failure_reason").alias("Failure Reason"))


def success_sheet(folders: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per clean folder; its total counts every document of the folder.

    The batches of a folder are bounded by mailboxes times entities, so their ids fit
    one cell.
    """
    ids = batches.groupBy(F.col("source_email").alias("folder")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("counter", "batch_id"))),
                                 lambda b: b["batch_id"]), ",").alias("ids"))
    return (folders.where(~F.col("quarantined")).join(ids, "folder", "left")
            .select(F.col("invoice_count").alias("Total"), F.lit(0).alias("Delta"), F.lit("Sent").alias("Comment"),
                    F.coalesce("ids", F.lit("")).alias("Email Name"), F.col("folder").alias("Source Email")))


def outbound_manifest(batches: DataFrame, stamped: DataFrame) -> DataFrame:
    """Attachments of each outgoing message, one row each; a batch without files still
    has its message."""
    files = stamped.where(F.col("batch_id").isNotNull()).select("batch_id", "output_pdf")
    return (batches.select("batch_id", "kofax_email").join(files, "batch_id", "left")
            .select(F.col("kofax_email").alias("receiver"), F.col("batch_id").alias("subject"),
                    F.lit("").alias("body"), F.col("output_pdf").alias("attachment")))


def attention_manifest(folders: DataFrame, originals: DataFrame, failed: DataFrame, stamped: DataFrame) -> DataFrame:
    """What a person must look at: originals of quarantined folders and files of
    batches that could not be sent.  Empty when there is nothing.

    Originals of one file name are told apart by a number, in the order of a hash of
    their paths."""
    mails = (folders.where("quarantined").join(originals, "folder")
             .where(F.col("msg_path").isNotNull())
             .select(F.col("msg_path").alias("path"), text.base_name("msg_path").alias("_base")).distinct()
             .select("path", F.regexp_extract("_base", r"(\.[^.]*)?$", 0).alias("_suffix"),
                     F.regexp_replace("_base", r"\.[^.]*$", "").alias("_stem"),
                     F.shiftrightunsigned(F.xxhash64("path"), 1).alias("_ord")))
    mails = unique_names(mails, "_suffix", "_stem", "_ord", "_name").select(
        F.concat(F.lit("quarantined_source_emails/"), "_name", "_suffix").alias("entry"), "path")
    files = (stamped.join(failed.select("batch_id"), "batch_id")
             .where(F.col("output_pdf").isNotNull())
             .select(F.concat(F.lit("failed_to_send/"), "batch_id", F.lit("/"),
                              text.base_name("output_pdf")).alias("entry"), F.col("output_pdf").alias("path")))
    return mails.unionByName(files)


def failed_batches(batches: DataFrame, send_results: DataFrame) -> DataFrame:
    """Batches that were not sent; one without a result counts as not sent."""
    return (batches.join(send_results, "batch_id", "left")
            .where(~F.coalesce("email_sent", F.lit(False)))
            .select("batch_id", "kofax_email", "invoice_count", F.col("email_error").alias("error"), "staged_dir"))


def run_stats(batches: DataFrame, send_results: DataFrame, folders: DataFrame) -> DataFrame:
    """Totals of a run in one row, from one aggregation over both inputs."""
    zero = F.lit(0).cast("long")
    sent = F.coalesce("email_sent", F.lit(False))
    b = batches.join(send_results, "batch_id", "left").select(
        F.when(sent, F.col("invoice_count")).otherwise(zero).alias("ok"),
        F.when(~sent, F.col("invoice_count")).otherwise(zero).alias("unsent"),
        zero.alias("held"), F.lit(1).alias("batch"), F.lit(0).alias("mail"))
    q = folders.where("quarantined").select(
        zero.alias("ok"), zero.alias("unsent"), F.col("invoice_count").alias("held"),
        F.lit(0).alias("batch"), F.lit(1).alias("mail"))
    total = {c: F.coalesce(F.sum(c), zero) for c in ("ok", "unsent", "held", "batch", "mail")}
    return b.unionByName(q).agg(
        (total["ok"] + total["unsent"] + total["held"]).alias("total_invoices"),
        total["ok"].alias("total_successful"), (total["unsent"] + total["held"]).alias("total_failed"),
        total["held"].alias("total_quarantined_invoices"), total["unsent"].alias("total_send_failed_invoices"),
        total["batch"].alias("total_batches"), total["mail"].alias("total_quarantined_emails"))


def overview(folders: DataFrame) -> DataFrame:
    """Folders, documents, documents to review, errors."""
    return folders.agg(
        F.count(F.lit(1)).alias("folders"), F.coalesce(F.sum("invoice_count"), F.lit(0)).alias("invoices"),
        F.coalesce(F.sum("n_review"), F.lit(0)).alias("needs_review"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"))


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Write a report table; column names are kept, so use CSV or JSON for names
    with blanks where a reader needs it.  With ``by`` columns, only the folders that have new rows are replaced."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
