"""Queries on written runs, mail records, translations and term evidence, with their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import reports, tagging, translate
from ..operators.scale import checkpoint_dir, run_stages
from ..sources import files, sinks
from . import oracles as O
from . import projections as P
from .catalog_batches import _RUN, _batches, _docs
from .catalog_ingest import _IN, _inbox
from .registry import query


def _folder(sql, name: str) -> str:
    checkpoint_dir(sql.spark)
    return f"{sql.spark.sparkContext.getCheckpointDir().rpartition('/')[0]}/{name}-{uuid.uuid4().hex}"


# ============================================================== written runs ====
@query(O.ctes(**_RUN) + """, b AS (SELECT batch_id, kofax_email, le, folder AS source_email, invoice_count, counter FROM batches)
SELECT 'run_2' AS run, * FROM b UNION ALL SELECT 'run_1', * FROM b WHERE invoice_count > 1""")
def run_sink(sql):
    """Batches of two runs, the first written twice; what is read back."""
    out = _folder(sql, "reports")
    with run_stages(sql.spark):
        batches = _batches(sql).select("batch_id", "kofax_email", "le", "source_email", "invoice_count", "counter")
        for run, rows in (("run_1", batches), ("run_2", batches), ("run_1", batches.where("invoice_count > 1"))):
            sinks.write_run(sql.spark, {"batches": rows}, out, run)
    return sinks.read_run(sql.spark, out, "batches")


@query(O.ctes(**_RUN) + """
SELECT 'run_1' AS run, 'success' AS table_name, (SELECT count(*) FROM fold WHERE NOT quarantined) AS n_rows
UNION ALL SELECT 'run_1', 'overview', 1 UNION ALL SELECT 'run_2', 'overview', 1""")
def run_manifest(sql):
    """The list of complete runs; reports with blanks in their titles included."""
    from ..operators import batching
    out = _folder(sql, "reports")
    with run_stages(sql.spark):
        folders = batching.folder_summary(_docs(sql), sql(P.ERRORS))
        sinks.write_run(sql.spark, {"success": reports.success_sheet(folders, _batches(sql)), "overview": reports.overview(folders)},
                        out, "run_1")
        sinks.write_run(sql.spark, {"overview": reports.overview(folders)}, out, "run_2")
    return sinks.runs(sql.spark, out)


def _paths(kind: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(path) FILTER (kind = '{kind}')), '|'), '')"


@query(O.ctes(**_IN) + f""", files_of AS (
  SELECT message_id, {_paths('pdf')} AS pdfs, {_paths('excel')} AS excels, {_paths('xml')} AS xmls, {_paths('other')} AS other
  FROM inv GROUP BY message_id),
one_group AS (SELECT message_id, group_name, array_to_string(list_sort(list(path)), '|') AS paths FROM inv GROUP BY message_id, group_name),
groups_of AS (SELECT message_id, string_agg(concat(group_name, '=', paths), ';' ORDER BY group_name) AS groups FROM one_group GROUP BY message_id),
held_of AS (SELECT message_id, array_to_string(list_sort(list(reason)), '|') AS reasons FROM why GROUP BY message_id)
SELECT message_id, subject, msg_path, free.folder AS folder_name, coalesce(pdfs, '') AS pdfs, coalesce(excels, '') AS excels,
  coalesce(xmls, '') AS xmls, coalesce(other, '') AS other, coalesce(groups, '') AS groups, reasons IS NOT NULL AS blocked,
  coalesce(reasons, '') AS reasons, 'run_1' AS run
FROM msg LEFT JOIN (SELECT message_id, folder FROM free) free USING (message_id) LEFT JOIN files_of USING (message_id)
LEFT JOIN groups_of USING (message_id) LEFT JOIN held_of USING (message_id)""")
def metadata_records(sql):
    """One JSON record per mail, written twice under its run and read back."""
    from .catalog_ingest import _MESSAGES
    out = _folder(sql, "metadata")
    with run_stages(sql.spark):
        box = _inbox(sql)
        mails = (sql(_MESSAGES).join(box.messages.select("message_id", "folder"), "message_id", "left")
                 .withColumnRenamed("folder", "folder_name"))
        records = files.metadata_records(mails, box.files, box.reasons).withColumn("run", F.lit("run_1"))
        for _ in range(2):
            files.write_metadata(records, out)
    back = files.read_metadata(sql.spark, out)

    def joined(x):
        return F.coalesce(F.array_join(x, "|"), F.lit(""))
    entries = F.transform(F.map_entries("groups"), lambda g: F.concat(g["key"], F.lit("="), F.array_join(g["value"], "|")))
    return back.select(
        F.col("message_id").cast("long").alias("message_id"), "subject", "msg_path", "folder_name",
        *[joined(f"attachments.{k}").alias(k) for k in ("pdfs", "excels", "xmls", "other")],
        F.coalesce(F.array_join(F.array_sort(entries), ";"), F.lit("")).alias("groups"), "blocked",
        joined("block_reasons").alias("reasons"), "run")


# ============================================================== translations ====
_FOREIGN = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name
  ELSE concat(replace(replace(p_name, 'a', 'á'), 'e', 'é'), ' ', CAST(p_partkey % 97 AS STRING), 'ß') END AS name FROM {part}"""


def _stand_in(names: list[str]) -> list[str | None]:
    """A translator without a model: plain letters under a label; none for some names."""
    return [None if n.startswith("b") else "Translation: " + n.replace("á", "a").replace("é", "e").replace("ß", "") for n in names]


@query(O.ctes(n=P.ansi(_FOREIGN)) + """
SELECT name AS src, CASE WHEN starts_with(name, 'b') THEN name ELSE replace(replace(replace(name, 'á', 'a'), 'é', 'e'), 'ß', '') END AS dst,
  CASE WHEN bool_or(p_partkey % 2 = 0) THEN 'run_1' ELSE 'run_2' END AS run, count(DISTINCT name) AS n_sent
FROM n WHERE p_partkey % 3 <> 0 GROUP BY name""")
def translate_names(sql):
    """Two runs with one translator: each name is sent in the first run that has it."""
    memo = translate.Memo(_folder(sql, "memo"))
    names = sql(_FOREIGN)
    translate.translate_new(names.where("p_partkey % 2 = 0"), "name", memo, "run_1", _stand_in)
    translate.translate_new(names, "name", memo, "run_2", _stand_in)
    return memo.read(sql.spark).groupBy("src").agg(F.min("dst").alias("dst"), F.min("run").alias("run"), F.count(F.lit(1)).alias("n_sent"))


# ================================================================== evidence ====
# The fixed terms, and the words of part names as terms of one more language.
_WORDS = "SELECT DISTINCT 'PART' AS tag, 'parts' AS language, explode(split(p_name, ' ')) AS term FROM {part}"
_TERM_ROWS = ", ".join(f"({O.quote(tag)}, {O.quote(language)}, {O.quote(t)})" for tag, language, t in (
    [("TELECOM", "any", t) for t in lx.TELECOM_TERMS] + [("DD", "any", t) for t in lx.DIRECT_DEBIT_TERMS]
    + [("UTILITY", language, t) for language, terms in lx.UTILITY_TERMS.items() for t in terms]))


@query(f"""WITH terms(tag, language, term) AS (SELECT DISTINCT * FROM (VALUES {_TERM_ROWS}) UNION
  SELECT DISTINCT 'PART', 'parts', unnest(string_split(p_name, ' ')) FROM part),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
hit AS (SELECT doc_id, tag, language, term, instr(t, term) - 1 AS first_place,
          (length(t) - length(replace(t, term, ''))) // length(term) AS n_places
        FROM d JOIN terms ON contains(t, term) WHERE term = lower(term) AND term <> '')
SELECT doc_id, tag, language, term, first_place, n_places FROM hit""")
def tag_evidence(sql):
    """Every term that stands in a document, with its place."""
    terms = tagging.lexicon_terms(sql.spark).unionByName(sql(_WORDS))
    return tagging.evidence(sql("SELECT doc_id, text FROM {documents}"), "doc_id", "text", terms)
