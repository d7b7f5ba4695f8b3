"""Reference lists: cleaned, split into aliases, keyed, checked for collisions.

Every list keeps ``ref_ord``, the order in which the source listed an entry; it
decides ties later.  ``ref_ord`` packs the source row and the alias position, so no
global numbering pass is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_ALIAS_BITS = 20  # alias positions within one source row


def _ref_ord(pos) -> Column:
    return F.shiftleft(F.col("ord").cast("long"), _ALIAS_BITS) + pos


def _blank(x) -> Column:
    s = text.strip(x)
    return s.isNull() | F.lower(s).isin("", "nan", "none")


def _trimmed(x) -> Column:
    return F.coalesce(text.strip(x), F.lit(""))


# --- sensitive suppliers ----------------------------------------------------
def _sensitive_keys(raw: DataFrame) -> DataFrame:
    name = text.strip("supplier_remit_to_name")
    return (raw.select("ord", name.alias("original")).where(F.col("original") != "")
            .withColumn("norm", text.normalize_name("original")))


def sensitive_reference(raw: DataFrame) -> DataFrame:
    """One row per key with the first original: ``norm, original, ref_ord``."""
    return (_sensitive_keys(raw).where(F.col("norm") != "").groupBy("norm")
            .agg(F.min(F.struct("ord", "original")).alias("e"))
            .select("norm", "e.original", F.col("e.ord").cast("long").alias("ref_ord")))


def sensitive_reference_stats(raw: DataFrame) -> DataFrame:
    keys = _sensitive_keys(raw).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count_raw_rows"),
        F.count_if(F.col("norm") != "").alias("count_unique_normalized"),
        F.coalesce(F.sum(F.when(F.col("norm") == "", F.col("n"))), F.lit(0)).alias("skipped_unnormalizable"))


# --- legal entities ---------------------------------------------------------
def _entity_rows(raw: DataFrame, canonical) -> DataFrame:
    le, bill = _trimmed("le"), _trimmed("bill_to_name")
    status = (F.when((le == "") | _blank(bill), "blank").when(text.is_junk_entity(bill), "junk").otherwise("kept"))
    aliases = F.filter(F.transform(F.split(bill, "/"), lambda a: text.strip(a)), lambda a: a != "")
    rows = raw.select(
        "ord", le.alias("le"), _trimmed("source_site").alias("source_site"), _trimmed("country").alias("country"),
        status.alias("status"), F.posexplode_outer(F.when(status == "kept", aliases)).alias("pos", "original"))
    return rows.withColumn("norm", text.normalize_entity("original", canonical)).withColumn(
        "ref_ord", _ref_ord(F.coalesce("pos", F.lit(0))))


def entity_reference(raw: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """Alias rows ``norm, original, le, source_site, country, ref_ord``."""
    return (_entity_rows(raw, canonical).where(F.col("norm") != "")
            .select("norm", "original", "le", "source_site", "country", "ref_ord"))


def entity_reference_stats(raw: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    rows = _entity_rows(raw, canonical)
    per_key = (rows.withColumn("kept", F.col("norm") != "")
               .groupBy("kept", "norm", "status")
               .agg(F.count(F.lit(1)).alias("n"), F.count("original").alias("aliases"),
                    (F.min("le") != F.max("le")).alias("clash")))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("count_entries"),
        F.coalesce(F.sum(F.when(F.col("status") == "blank", F.col("n"))
                         .when((F.col("status") == "kept") & ~F.col("kept"), F.col("aliases"))),
                   F.lit(0)).alias("skipped_blank"),
        F.coalesce(F.sum(F.when(F.col("status") == "junk", F.col("n"))), F.lit(0)).alias("skipped_junk"),
        F.count_if(F.col("kept") & F.col("clash")).alias("collisions"))


# --- Vietnamese suppliers ---------------------------------------------------
def vn_suppliers(raw: DataFrame, translations: DataFrame) -> DataFrame:
    """One row per supplier with its Vietnamese and English name, the missing English
    side filled from ``translations(src, dst)``."""
    alt = text.strip("alt_name")
    rows = (raw.where(F.col("supplier_id").isNotNull() & F.col("supplier_name").isNotNull())
            .select("ord", text.strip("supplier_id").alias("supplier_id"),
                    text.clean_artifact("supplier_name").alias("name"),
                    F.when(~text.is_junk_alt(alt), text.blank_to_null(text.clean_artifact(alt))).alias("alt"))
            .where((F.col("supplier_id") != "") & ~_blank("name")))
    vn = F.coalesce(F.when(text.non_ascii("name"), F.col("name")), F.when(text.non_ascii("alt"), F.col("alt")))
    en = F.coalesce(F.when(~text.non_ascii("name"), F.col("name")), F.when(~text.non_ascii("alt"), F.col("alt")))
    named = rows.withColumn("vietnamese_name", vn).withColumn("en", en)
    need = F.when(F.col("en").isNull(), F.col("vietnamese_name"))
    known = translations.groupBy(F.col("src").alias("_src")).agg(F.min("dst").alias("_dst"))
    filled = named.withColumn("_src", need).join(known, "_src", "left")
    english = F.coalesce("en", "_dst", "_src")
    return filled.select(
        "ord", "supplier_id", "name", "alt", "vietnamese_name", english.alias("english_name"),
        F.col("_src").isNotNull().alias("translated"),
        text.normalize_vn("vietnamese_name").alias("normalized_vietnamese"),
        text.normalize_vn(english).alias("normalized_english"))


def vn_aliases(suppliers: DataFrame) -> DataFrame:
    """Up to four distinct spellings per supplier: ``norm, alias, supplier_id, ref_ord``."""
    pool = F.array_distinct(F.filter(
        F.array("name", "alt", "english_name", "vietnamese_name"), lambda a: a.isNotNull() & (a != "")))
    return (suppliers.select("ord", "supplier_id", F.posexplode(pool).alias("pos", "alias"))
            .withColumn("norm", text.normalize_vn("alias")).where(F.col("norm") != "")
            .select("norm", "alias", "supplier_id", _ref_ord(F.col("pos")).alias("ref_ord")))


# --- collisions -------------------------------------------------------------
def collisions(ref: DataFrame, owner: str, detail: str) -> DataFrame:
    """Entries whose key belongs to more than one owner, one row per entry.

    Two owners exist exactly when the smallest differs from the largest, which
    needs no distinct sets.
    """
    shared = (ref.groupBy("norm").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"))
              .where(F.col("lo") != F.col("hi")).select("norm"))
    return ref.join(shared, "norm", "left_semi").select("norm", owner, detail, "ref_ord")


# --- routing ----------------------------------------------------------------
ROUTE_FIELDS = ["appo", "tidecr", "nonpo", "archive", "rits"]


def routing_index(raw: DataFrame) -> DataFrame:
    """One row per key: the full site and each part between slashes.

    The last source row that claims a key supplies its mailboxes; the first one
    fixes the key's position ``key_ord``.
    """
    site = _trimmed("source_site")
    parts = F.filter(F.transform(F.split(site, r"[/\\]"), lambda p: F.lower(text.strip(p))), lambda p: p != "")
    fields = [F.coalesce(text.strip(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c)
              for c in ROUTE_FIELDS]
    rows = (raw.where(~_blank(site))
            .select("ord", F.struct(site.alias("source_site_full"), *fields).alias("entry"),
                    F.posexplode(F.concat(F.array(F.lower(site)), parts)).alias("pos", "key"))
            .withColumn("at", _ref_ord(F.col("pos"))))
    return (rows.groupBy("key").agg(F.max_by("entry", "at").alias("entry"), F.min("at").alias("key_ord"))
            .select("key", "key_ord", "entry.*"))
