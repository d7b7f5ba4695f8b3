"""Attachments of a message: which count, which block it, which belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text
from .naming import unique_names
from .scale import cut_lineage


def attachment_type(name) -> Column:
    ext = F.lower(text.file_suffix(name))
    return (F.when(ext.isin(lx.PDF_TYPES), "pdf").when(ext.isin(lx.EXCEL_TYPES), "excel")
            .when(ext.isin(lx.XML_TYPES), "xml").otherwise("other"))


def usable_attachments(attachments: DataFrame) -> DataFrame:
    """Drop inline pictures by name and anything that is not binary."""
    return attachments.where(~F.lower("file_name").isin(lx.SKIP_ATTACHMENTS) & F.col("is_binary"))


def attachment_types(attachments: DataFrame) -> DataFrame:
    """Files per message and type, for the inventory of a message."""
    kind = F.col("kind")
    return (attachments.select("message_id", attachment_type("file_name").alias("kind"))
            .groupBy("message_id")
            .agg(*[F.count_if(kind == k).alias(k + "s") for k in ("pdf", "excel", "xml", "other")]))


def block_reasons(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Every reason to hold a message back, one row each: ``message_id, att_ord, reason``.

    An attachment brings its own ``block_reason`` (archives) or is a locked PDF; a
    message without any PDF is held too.
    """
    kept = usable_attachments(attachments)
    own = kept.select("message_id", "att_ord", F.coalesce(
        "block_reason", F.when(F.col("is_locked") & (attachment_type("file_name") == "pdf"),
                               F.concat(F.lit("password-protected PDF: "), text.base_name("file_name")))
    ).alias("reason")).where(F.col("reason").isNotNull())
    with_pdf = kept.where(attachment_type("file_name") == "pdf").select("message_id").distinct()
    none = messages.join(with_pdf, "message_id", "left_anti").select(
        "message_id", F.lit(None).cast("long").alias("att_ord"),
        F.lit("no PDF attachment in this message").alias("reason"))
    return own.unionByName(none)


def block_messages(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Add ``blocked`` and ``n_reasons`` to messages."""
    counts = block_reasons(messages, attachments).groupBy("message_id").agg(F.count(F.lit(1)).alias("n_reasons"))
    return (messages.join(counts, "message_id", "left")
            .withColumn("n_reasons", F.coalesce("n_reasons", F.lit(0)))
            .withColumn("blocked", F.col("n_reasons") > 0))


def message_summary(results: DataFrame) -> DataFrame:
    """Messages parsed, blocked and failed."""
    failed, blocked = F.col("error").isNotNull(), F.col("blocked")
    return results.agg(F.count_if(~failed & ~blocked).alias("parsed"), F.count_if(blocked).alias("blocked"),
                       F.count_if(failed).alias("failed"))


def _prefixes(stem: Column) -> Column:
    n = F.length(stem)
    lengths = F.sequence(F.lit(lx.MIN_STEM_FOR_PREFIX), n)
    return F.when(n >= lx.MIN_STEM_FOR_PREFIX, F.transform(lengths, lambda k: F.substring(stem, F.lit(1), k)))


def pair_attachments(attachments: DataFrame) -> DataFrame:
    """Group the attachments of each message: ``message_id, att_ord, file_name, group_name``.

    Files from an archive folder form that folder's group.  Among two or more
    top-level PDFs each opens a group, and another file joins the first PDF whose
    normalized stem equals its own, else the first where one stem begins with the
    other (four characters at least).  Anything else stays ungrouped ("").

    A prefix test is an equality on one of the longer stem's prefixes, so pairing is
    a join on (message, stem) against one row per stem; no pairs of files arise.
    """
    stem = F.regexp_replace(F.lower(text.file_stem("file_name")), "[^a-z0-9]", "")
    files = cut_lineage(attachments.select(  # names only; read by every step below
        "message_id", "att_ord", "file_name", F.coalesce("rel_dir", F.lit("")).alias("rel_dir"),
        attachment_type("file_name").alias("kind"), stem.alias("stem")))
    nested = files.where(F.col("rel_dir") != "").withColumn(
        "group_name", text.sanitize_folder(F.replace("rel_dir", F.lit("/"), F.lit("_")), "group"))
    top = files.where(F.col("rel_dir") == "")
    several = (top.where(F.col("kind") == "pdf").groupBy("message_id")
               .agg(F.count(F.lit(1)).alias("n_pdf")).where(F.col("n_pdf") > 1).select("message_id"))
    split = top.join(several, "message_id", "left_semi")
    pdfs = split.where(F.col("kind") == "pdf")
    others = split.where(F.col("kind") != "pdf")

    # Group names: the PDF's own name, made unique after the archive groups.
    wanted = pdfs.select("message_id", F.col("att_ord").cast("long").alias("ord"),
                         text.sanitize_folder(text.file_stem("file_name"), "invoice").alias("folder"))
    taken = (nested.join(several, "message_id", "left_semi").groupBy("message_id", "group_name")
             .agg(F.min("att_ord").cast("long").alias("ord"))
             .select("message_id", "ord", F.col("group_name").alias("folder")))
    offset = 1 << 40  # every archive group comes before the first PDF
    claims = (taken.unionByName(wanted.withColumn("ord", F.col("ord") + offset)))
    named = cut_lineage(  # met twice below
        unique_names(claims, "message_id", "folder", "ord", "group_name", bounded=True).where(F.col("ord") >= offset)
        .select("message_id", (F.col("ord") - offset).alias("att_ord"), "group_name"))

    # One row per stem, and per prefix of a stem: the first PDF that has it.
    first = F.min("att_ord").alias("pdf_ord")
    by_stem = pdfs.where(F.col("stem") != "").groupBy("message_id", "stem").agg(first)
    by_prefix = (pdfs.select("message_id", "att_ord", F.explode(_prefixes(F.col("stem"))).alias("stem"))
                 .groupBy("message_id", "stem").agg(first))
    keys = others.where(F.col("stem") != "").select("message_id", "stem").distinct()
    equal = keys.join(by_stem, ["message_id", "stem"]).withColumn("rank", F.lit(0))
    inside = keys.join(by_prefix, ["message_id", "stem"]).withColumn("rank", F.lit(1))
    around = (keys.select("message_id", F.col("stem").alias("own"), F.explode(_prefixes(F.col("stem"))).alias("stem"))
              .join(by_stem, ["message_id", "stem"])
              .select("message_id", F.col("own").alias("stem"), "pdf_ord", F.lit(1).alias("rank")))
    target = (equal.unionByName(inside).unionByName(around).groupBy("message_id", "stem")
              .agg(F.min(F.struct("rank", "pdf_ord"))["pdf_ord"].alias("pdf_ord")))
    paired = (others.join(target, ["message_id", "stem"], "left")
              .join(named.select("message_id", F.col("att_ord").alias("pdf_ord"), "group_name"),
                    ["message_id", "pdf_ord"], "left")
              .withColumn("group_name", F.coalesce("group_name", F.lit(""))))
    alone = top.join(several, "message_id", "left_anti").withColumn("group_name", F.lit(""))
    out = ["message_id", "att_ord", "file_name", "group_name"]
    return (nested.select(*out).unionByName(alone.select(*out)).unionByName(paired.select(*out))
            .unionByName(pdfs.join(named, ["message_id", "att_ord"]).select(*out)))
