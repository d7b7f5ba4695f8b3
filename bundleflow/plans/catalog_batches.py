"""Queries on quarantine, batches, reports, attachments and sheets, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import batching, messages, naming, reports, segment, sheets, tagging
from . import oracles as O
from . import projections as P
from .catalog_pages import _equal_roles
from .registry import query

RUN_DATE = "2026-09-10"  # a Thursday


# ================================================================ batches =====
def _docs(sql) -> DataFrame:
    reason = F.when(F.col("needs_manual_review"), F.concat(
        F.array(F.struct(F.lit("le_no_match").alias("code"), F.lit("no match").alias("message"))),
        F.when(F.col("no_site"), F.array(F.struct(F.lit("routing_failed").alias("code"), F.lit("no site").alias("message"))))
        .otherwise(F.array().cast("array<struct<code:string,message:string>>"))))
    return (sql(P.DOCS).withColumn("tags", tagging.tag_array(F.col("is_telecom"), F.lit(False), F.col("is_debit")))
            .withColumn("review_reasons", F.coalesce(reason, F.array().cast("array<struct<code:string,message:string>>"))))


_RUN = {
    "docs": P.ansi(P.DOCS), "errors": P.ansi(P.ERRORS),
    "bad": "SELECT folder FROM docs WHERE needs_manual_review UNION SELECT folder FROM errors",
    "clean": "SELECT * FROM docs WHERE folder NOT IN (SELECT folder FROM bad)",
    "held": "SELECT * FROM docs WHERE folder IN (SELECT folder FROM bad)",
    "fold": """SELECT folder, folder_ord, count(doc_id) AS invoice_count,
               count(*) FILTER (needs_manual_review) AS n_review, count(*) FILTER (doc_id IS NULL) AS n_errors,
               folder IN (SELECT folder FROM bad) AS quarantined
               FROM (SELECT folder, folder_ord, doc_id, needs_manual_review FROM docs
                     UNION ALL SELECT folder, folder_ord, NULL, NULL FROM errors) GROUP BY folder, folder_ord""",
    "grp": """SELECT folder_ord, folder, kofax_email, le, count(*) AS invoice_count,
              concat(CASE WHEN bool_or(is_telecom) THEN '-TELCO' ELSE '' END, CASE WHEN bool_or(is_debit) THEN '-DD' ELSE '' END,
                     CASE WHEN bool_or(is_sensitive) THEN '-SENSITIVE' ELSE '' END) AS suffix
              FROM clean WHERE le IS NOT NULL GROUP BY folder_ord, folder, kofax_email, le""",
    "cnt": """SELECT *, 1 + coalesce(sum(invoice_count) OVER (ORDER BY folder_ord, kofax_email, le
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS counter FROM grp""",
    "batches": """SELECT *, concat(le, '.GH', CASE WHEN counter < 10 THEN '0' ELSE '' END, CAST(counter AS BIGINT), suffix)
                  AS batch_id FROM cnt""",
    "sent": "SELECT batch_id, counter % 9 <> 0 AS email_sent, CASE WHEN counter % 9 = 0 THEN 'timeout' END AS email_error FROM batches",
    "stamped": "SELECT clean.*, batch_id FROM clean LEFT JOIN batches USING (folder, kofax_email, le)"}


def _split(sql):
    return batching.quarantine(_docs(sql), sql(P.ERRORS))


def _batches(sql) -> DataFrame:
    return batching.assign_batches(_split(sql)[0], RUN_DATE)


def _sent(batches: DataFrame) -> DataFrame:
    late = F.col("counter") % 9 == 0
    return batches.select("batch_id", (~late).alias("email_sent"), F.when(late, "timeout").alias("email_error"))


@query(O.ctes(**_RUN) + """SELECT doc_id, 'clean' AS part FROM clean UNION ALL SELECT doc_id, 'held' FROM held""")
def quarantine_split(sql):
    clean, held = _split(sql)
    return clean.select("doc_id", F.lit("clean").alias("part")).unionByName(
        held.select("doc_id", F.lit("held").alias("part")))


@query(O.ctes(**_RUN) + "SELECT folder, folder_ord, invoice_count, n_errors, n_review, quarantined FROM fold")
def folder_summary(sql):
    return batching.folder_summary(_docs(sql), sql(P.ERRORS))


@query(O.ctes(**_RUN) + """
SELECT batch_id, kofax_email, le, folder AS source_email, folder_ord, invoice_count, counter,
  concat(regexp_replace(kofax_email, '[<>:"/\\\\|?*]', '_', 'g'), '/', batch_id) AS staged_dir FROM batches""")
def batch_assign(sql):
    return _batches(sql)


@query(O.ctes(**_RUN) + "SELECT doc_id, batch_id FROM stamped")
def batch_stamp(sql):
    clean, _ = _split(sql)
    return batching.with_batch_id(clean, batching.assign_batches(clean, RUN_DATE)).select("doc_id", "batch_id")


# ================================================================ reports =====
_REPORT_SQL = O.ctes(**_RUN) + """
SELECT folder AS "Folder", concat(doc_id, '.pdf') AS "Source PDF", invoice_number AS "Invoice #",
  supplier_name AS "Supplier", '' AS "Bill To", concat('3500', doc_id, ', ', '3000', doc_id) AS "PO Number(s)",
  is_sensitive AS "Is Sensitive", CASE WHEN is_sensitive THEN supplier_name ELSE '' END AS "Sensitive Match",
  90 AS "Sensitive Score", false AS "Sensitive Matched Via Translation", coalesce(le, '') AS "LE", '' AS "Source Site",
  '' AS "LE Country", '' AS "LE Matched Name", 80 AS "LE Score", false AS "LE Matched Via Translation",
  '' AS "Invoice Type", kofax_email AS "Kofax Email", '' AS "Vietnam Supplier ID", '' AS "Vietnam Supplier Name",
  false AS "Vietnam Renamed", needs_manual_review AS "Needs Review",
  CASE WHEN NOT needs_manual_review THEN '' WHEN no_site THEN 'no match; no site' ELSE 'no match' END AS "Review Reasons",
  concat('doc_', doc_id, '.pdf') AS "Output File" FROM docs"""


def _report_docs(sql) -> DataFrame:
    none = F.lit(None).cast("string")
    k = F.col("doc_id").cast("string")
    docs = _docs(sql).withColumns({
        "bill_to": none, "po_numbers": F.array(F.concat(F.lit("3500"), k), F.concat(F.lit("3000"), k)),
        "sensitive_name": F.when(F.col("is_sensitive"), F.col("supplier_name")), "sensitive_score": F.lit(90),
        "sensitive_translated": F.lit(False), "source_site": none, "country": none, "le_matched_name": none,
        "le_score": F.lit(80), "le_translated": F.lit(None).cast("boolean"), "invoice_type": none,
        "vn_supplier_id": none, "vn_supplier_name": none, "vn_renamed": F.lit(None).cast("boolean")})
    return docs


@query(_REPORT_SQL)
def invoice_report(sql):
    return reports.invoice_report(_report_docs(sql))


@query(_REPORT_SQL + " WHERE source_file = (SELECT max(source_file) FROM docs)")
def bundle_report(sql):
    """The report of one bundle: that whose path comes last."""
    docs = _report_docs(sql)
    return reports.single_bundle_report(docs, docs.agg(F.max("source_file")).first()[0])


@query(O.ctes(**_RUN) + """
SELECT invoice_count AS "Total", 0 AS "Delta", 'Sent' AS "Comment", coalesce(ids, '') AS "Email Name",
  fold.folder AS "Source Email"
FROM fold LEFT JOIN (SELECT folder, string_agg(batch_id, ',' ORDER BY counter) AS ids FROM batches GROUP BY folder) b
  USING (folder) WHERE NOT quarantined""")
def success_rows(sql):
    return reports.success_sheet(batching.folder_summary(_docs(sql), sql(P.ERRORS)), _batches(sql))


@query(O.ctes(**_RUN) + """
SELECT folder AS "Source Email", NULL AS "Invoice #", NULL AS "Supplier",
  concat('pdf_processing_error: ', error) AS "Failure Reason" FROM errors
UNION ALL SELECT folder, invoice_number, supplier_name, 'le_no_match' FROM held WHERE needs_manual_review
UNION ALL SELECT folder, invoice_number, supplier_name, 'routing_failed' FROM held WHERE needs_manual_review AND no_site""")
def failure_rows(sql):
    return reports.failure_sheet(reports.failure_rows(_split(sql)[1], sql(P.ERRORS)))


@query(O.ctes(**_RUN) + """
SELECT kofax_email AS receiver, batch_id AS subject, '' AS body, output_pdf AS attachment
FROM stamped WHERE batch_id IS NOT NULL""")
def outbound_manifest(sql):
    clean, _ = _split(sql)
    batches = batching.assign_batches(clean, RUN_DATE)
    return reports.outbound_manifest(batches, batching.with_batch_id(clean, batches))


@query(O.ctes(**_RUN) + """
SELECT concat('quarantined_source_emails/', folder, '.eml') AS entry, concat('/inbox/', folder, '.eml') AS path
FROM fold WHERE quarantined
UNION ALL SELECT concat('failed_to_send/', batch_id, '/', string_split(output_pdf, '/')[-1]), output_pdf
FROM stamped JOIN sent USING (batch_id) WHERE NOT email_sent""")
def attention_manifest(sql):
    clean, _ = _split(sql)
    batches = batching.assign_batches(clean, RUN_DATE)
    folders = batching.folder_summary(_docs(sql), sql(P.ERRORS))
    originals = folders.select("folder", F.concat(F.lit("/inbox/"), "folder", F.lit(".eml")).alias("msg_path"))
    failed = reports.failed_batches(batches, _sent(batches))
    return reports.attention_manifest(folders, originals, failed, batching.with_batch_id(clean, batches))


@query(O.ctes(**_RUN) + """
SELECT batch_id, kofax_email, invoice_count, email_error AS error,
  concat(kofax_email, '/', batch_id) AS staged_dir FROM batches JOIN sent USING (batch_id) WHERE NOT email_sent""")
def failed_batches(sql):
    batches = _batches(sql)
    return reports.failed_batches(batches, _sent(batches))


@query(O.ctes(**_RUN) + """
SELECT a + b + c AS total_invoices, a AS total_successful, b + c AS total_failed, c AS total_quarantined_invoices,
  b AS total_send_failed_invoices, d AS total_batches, e AS total_quarantined_emails FROM (SELECT
  (SELECT sum(invoice_count) FROM batches JOIN sent USING (batch_id) WHERE email_sent) AS a,
  (SELECT sum(invoice_count) FROM batches JOIN sent USING (batch_id) WHERE NOT email_sent) AS b,
  (SELECT sum(invoice_count) FROM fold WHERE quarantined) AS c,
  (SELECT count(*) FROM batches) AS d, (SELECT count(*) FROM fold WHERE quarantined) AS e)""")
def run_stats(sql):
    batches = _batches(sql)
    return reports.run_stats(batches, _sent(batches), batching.folder_summary(_docs(sql), sql(P.ERRORS)))


@query(O.ctes(**_RUN) + """
SELECT count(*) AS folders, sum(invoice_count) AS invoices, sum(n_review) AS needs_review, sum(n_errors) AS errors
FROM fold""")
def overview(sql):
    return reports.overview(batching.folder_summary(_docs(sql), sql(P.ERRORS)))


# ============================================================ attachments =====
_ATT = {
    "att": P.ansi(P.ATTACHMENTS), "msg": "SELECT c_custkey AS message_id FROM customer",
    "kept": """SELECT *, CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.xlsx'
               OR lower(file_name) LIKE '%.xls' THEN 'excel' WHEN lower(file_name) LIKE '%.xml' THEN 'xml' ELSE 'other' END
               AS kind FROM att WHERE is_binary AND lower(file_name) NOT IN
               ('image001.png', 'image002.png', 'image003.png', 'oledata.mso', 'winmail.dat')""",
    "rs": """SELECT message_id, att_ord, coalesce(block_reason, CASE WHEN is_locked AND kind = 'pdf'
             THEN concat('password-protected PDF: ', file_name) END) AS reason FROM kept
             UNION ALL SELECT message_id, NULL, 'no PDF attachment in this message' FROM msg
             WHERE message_id NOT IN (SELECT message_id FROM kept WHERE kind = 'pdf')""",
    "reasons": "SELECT * FROM rs WHERE reason IS NOT NULL"}
_MSG = "SELECT c_custkey AS message_id FROM {customer}"


@query(O.ctes(**_ATT) + "SELECT message_id, att_ord, reason FROM reasons")
def block_reasons(sql):
    return messages.block_reasons(sql(_MSG), sql(P.ATTACHMENTS))


@query(O.ctes(**_ATT) + """
SELECT message_id, (SELECT count(*) FROM reasons r WHERE r.message_id = m.message_id) AS n_reasons,
  message_id IN (SELECT message_id FROM reasons) AS blocked FROM msg m""")
def block_messages(sql):
    return messages.block_messages(sql(_MSG), sql(P.ATTACHMENTS))


@query(O.ctes(**_ATT) + """
SELECT count(*) FILTER (message_id % 50 <> 7 AND message_id NOT IN (SELECT message_id FROM reasons)) AS parsed,
  count(*) FILTER (message_id IN (SELECT message_id FROM reasons)) AS blocked,
  count(*) FILTER (message_id % 50 = 7) AS failed FROM msg""")
def message_summary(sql):
    blocked = messages.block_messages(sql(_MSG), sql(P.ATTACHMENTS))
    return messages.message_summary(blocked.withColumn("error", F.when(F.col("message_id") % 50 == 7, "broken")))


@query(O.ctes(**_ATT) + """
SELECT message_id, count(*) FILTER (kind = 'pdf') AS pdfs, count(*) FILTER (kind = 'excel') AS excels,
  count(*) FILTER (kind = 'xml') AS xmls, count(*) FILTER (kind = 'other') AS others FROM kept GROUP BY message_id""")
def attachment_types(sql):
    return messages.attachment_types(messages.usable_attachments(sql(P.ATTACHMENTS)))


# Distinct PDF names within a message, so that group names need no numbering.
_FILES_OF_MAIL = """SELECT o_custkey AS message_id, CAST(o_orderkey AS BIGINT) AS att_ord,
  concat(CASE WHEN o_orderkey % 4 = 0 THEN concat('Inv-', CAST(o_orderkey AS STRING))
              WHEN o_orderkey % 4 = 1 THEN concat('INV ', CAST(o_orderkey - o_orderkey % 10 AS STRING), ' details')
              WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey AS STRING) ELSE concat('inv', CAST(o_custkey % 10 AS STRING)) END,
         CASE WHEN o_orderkey % 4 = 0 THEN '.pdf' WHEN o_orderkey % 3 = 0 THEN '.xlsx' ELSE '.xml' END) AS file_name,
  CASE WHEN o_orderkey % 13 = 0 THEN concat('batch/', CAST(o_orderkey % 2 AS STRING)) ELSE '' END AS rel_dir
FROM {orders}"""


@query(O.ctes(
    f=P.ansi(_FILES_OF_MAIL),
    g="""SELECT *, lower(file_name) LIKE '%.pdf' AS is_pdf, regexp_replace(file_name, '\\.[a-z]+$', '') AS raw,
         regexp_replace(lower(regexp_replace(file_name, '\\.[a-z]+$', '')), '[^a-z0-9]', '', 'g') AS stem FROM f""",
    many="SELECT message_id FROM g WHERE is_pdf AND rel_dir = '' GROUP BY message_id HAVING count(*) > 1",
    pair="""SELECT o.message_id, o.att_ord, p.raw, row_number() OVER (PARTITION BY o.message_id, o.att_ord
              ORDER BY CASE WHEN o.stem = p.stem THEN 0 ELSE 1 END, p.att_ord) AS rn
            FROM g o JOIN g p ON p.message_id = o.message_id AND p.is_pdf AND p.rel_dir = ''
             AND (o.stem = p.stem OR (least(length(o.stem), length(p.stem)) >= 4
                  AND (starts_with(o.stem, p.stem) OR starts_with(p.stem, o.stem))))
            WHERE NOT o.is_pdf AND o.rel_dir = ''""") + """
SELECT g.message_id, g.att_ord, file_name, CASE WHEN rel_dir <> '' THEN replace(rel_dir, '/', '_')
  WHEN g.message_id NOT IN (SELECT message_id FROM many) THEN '' WHEN is_pdf THEN g.raw
  ELSE coalesce(pair.raw, '') END AS group_name
FROM g LEFT JOIN pair ON pair.message_id = g.message_id AND pair.att_ord = g.att_ord AND rn = 1""")
def pair_attachments(sql):
    return messages.pair_attachments(sql(_FILES_OF_MAIL))


# =========================================================== names, sheets =====
@query("""
SELECT o_orderkey, concat(o_orderpriority, CASE WHEN rn > 1 THEN '_' || rn ELSE '' END) AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)""")
def unique_names(sql):
    docs = sql("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders}")
    return naming.unique_names(docs, "o_orderstatus", "o_orderpriority", "o_orderkey", "name").select(
        "o_orderkey", "name")


@query(O.ctes(**O.roles(), hd="""
    SELECT pdf_id, invoice_index, max(CASE WHEN rule = 'main_start' THEN invoice_number END) AS num,
      coalesce(max(CASE WHEN rule = 'main_start' THEN supplier_name_on_page END), max(key_supplier)) AS sup
    FROM roles WHERE role <> 'dropped' GROUP BY pdf_id, invoice_index""", st="""
    SELECT pdf_id, invoice_index, concat(CASE WHEN sup IS NULL THEN 'unknown_supplier'
        ELSE regexp_replace(sup, '[^A-Za-z0-9._-]+', '_', 'g') END, '_', CASE WHEN num IS NULL
        THEN concat('noinv_', lpad(CAST(invoice_index AS VARCHAR), 2, '0')) ELSE regexp_replace(num, '[^A-Za-z0-9._-]+', '_', 'g')
        END) AS stem FROM hd""") + """
SELECT pdf_id, invoice_index, concat(stem, CASE WHEN rn > 1 THEN '_' || rn ELSE '' END) AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY pdf_id % 50, stem ORDER BY pdf_id, invoice_index) AS rn FROM st)""")
def output_names(sql):
    heads = segment.document_heads(_equal_roles(sql))
    stems = heads.select(
        "pdf_id", "invoice_index", F.concat(F.lit("mail_"), (F.col("pdf_id") % 50).cast("string")).alias("folder"),
        text.output_stem("supplier_name", "invoice_number", "invoice_index").alias("stem"))
    return naming.unique_names(stems, "folder", "stem", "pdf_id", "name", "invoice_index").select("pdf_id", "invoice_index", "name")


@query(O.ctes(
    c=P.ansi(P.CELLS), t=P.ansi(P.TARGETS), wb=P.ansi(P.WORKBOOKS),
    bk="""SELECT folder, count(*) AS n, min(workbook) AS workbook FROM wb WHERE workbook NOT LIKE '%/~$%' GROUP BY folder""",
    cells="""SELECT c.folder, sheet_idx, sheet_name, trim(value) AS v,
             regexp_replace(lower(trim(value)), '[^a-z0-9]', '', 'g') AS cn
             FROM c JOIN bk ON bk.folder = c.folder AND bk.workbook = c.workbook AND n = 1 WHERE trim(value) <> ''""",
    tg="SELECT *, regexp_replace(lower(invoice_number), '[^a-z0-9]', '', 'g') AS tn FROM t",
    hit="""SELECT DISTINCT pdf_id, sheet_idx, sheet_name FROM tg JOIN cells USING (folder)
           WHERE CASE WHEN regexp_full_match(tn, '[0-9]+')
                 THEN list_contains(list_transform(regexp_extract_all(v, '\\d+'),
                        lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END),
                        CASE WHEN ltrim(tn, '0') = '' THEN '0' ELSE ltrim(tn, '0') END)
                 ELSE contains(cn, tn) OR contains(tn, cn) END""",
    best="SELECT pdf_id, arg_max(sheet_name, sheet_idx) AS sheet_name, count(*) AS n_candidates FROM hit GROUP BY pdf_id") + """
SELECT t.pdf_id, t.folder, CASE WHEN n = 1 THEN workbook END AS workbook, sheet_name,
  coalesce(n_candidates, 0) AS n_candidates,
  CASE WHEN n IS NULL THEN 'no Excel file in folder' WHEN n > 1 THEN 'multiple Excel files found'
       WHEN sheet_name IS NULL THEN 'no sheet matched the invoice number' END AS reason
FROM t LEFT JOIN bk USING (folder) LEFT JOIN best USING (pdf_id)""")
def sheet_match(sql):
    return sheets.sheet_match(sql(P.TARGETS), sql(P.CELLS), sql(P.WORKBOOKS))
