"""A training corpus from raw documents: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's docs.  All stages but the last keep the columns of ``documents``.

Null texts and texts without letters leave in the first stage, so later stages see none from here; each of them handles
them all the same (see the operators).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleflow.llm import decontam, langid, ngram_join, packing, pii
from bundleflow.llm.common import stored, table
from bundleflow.session import ship

#: A document is rejected where the network tells its language by less than this many times chance.
LEAST_OVER_CHANCE = 1.2
#: ... and where fewer of its neighbouring byte pairs occur in the training snippets.  Measured on 10,000 documents with the
#: four languages given: the least share is 0.85 (a text that is mostly a token), 0.1 % lie under 0.95; Cyrillic, Greek and
#: Chinese have 0.01 to 0.03, base64 0.21, markup 0.33, JSON 0.47, C code 0.53, random letters 0.58, Polish 0.74.
LEAST_KNOWN = 0.75


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised: not ``und``, a score clearly above chance, and byte pairs as the
    learned languages have them."""
    ship(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no clash with the columns added
    net = langid.fit(docs)
    judged = langid.predict(docs.select(row, "text"), net, keep=("row",))
    least = min(1.0, LEAST_OVER_CHANCE / len(net.labels)) if net else 1.0
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
                        & (F.col("known") >= LEAST_KNOWN)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, once: that with the smallest id (none comes last), of its texts the smallest hash.

    A document is its id and its text: unlike texts under one id are judged each for itself.
    """
    ship(spark)
    found = stored(ngram_join.near_duplicates(docs).withColumn("_key", _document_key(F.col("mark"))), "components")
    first = F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "mark", "_key")).alias("first")
    grouped = found.where("root is not null")
    chosen = grouped.groupBy("root").agg(first).select("first._key")
    dropped = grouped.select("_key").distinct().join(chosen, "_key", "left_anti")
    # texts without shingles are in no group, so without id nothing tells that they are one document
    repeated = stored(found.where("doc_id is not null or root is not null").groupBy("_key").count().where("count > 1")
                      .select("_key"), "repeated")
    kept = (docs.withColumn("_key", _document_key(F.xxhash64("text")))
            .join(dropped, "_key", "left_anti"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
    return kept.join(repeated, "_key", "left_anti").select(docs.columns).unionByName(again)


def _document_key(mark: Column) -> Column:
    """A document's id and the hash of its text as one value; missing ids are equal."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), mark.cast("string"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item, copied or edited."""
    ship(spark)
    marks = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("mark").distinct()
    return docs.join(marks, F.sha2(docs["text"], 256) == marks["mark"], "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows the new text."""
    ship(spark)
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece of a document."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Networks, alignments and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
