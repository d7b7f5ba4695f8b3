"""Queries on inventories, mail files, archives, model responses and whole runs."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batching, reference
from ..operators.scale import checkpoint_dir
from ..sources import archives, files, mail, responses, sheets
from ..streaming import inbox
from . import oracles as O
from . import projections as P
from .catalog_batches import _RUN, RUN_DATE
from .registry import query

# ============================================================== inventories ====
_KINDS = """count(*) FILTER (kind = 'pdf') AS pdfs, count(*) FILTER (kind = 'excel') AS excels,
  count(*) FILTER (kind = 'other') AS others"""
_INV = {
    "fl": P.ansi(P.FILES),
    "k": """SELECT path, split_part(path, '/', 1) AS folder, len(string_split(path, '/')) - 1 AS depth,
            CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(path), '\\.xlsx?$') THEN 'excel'
            ELSE 'other' END AS kind, path LIKE '%/~$%' AS locked FROM fl"""}


@query(O.ctes(**_INV) + f"""SELECT * FROM (SELECT folder, {_KINDS} FROM k WHERE depth = 1 AND (NOT locked OR kind = 'pdf')
GROUP BY folder) WHERE pdfs > 0""")
def folder_inventory(sql):
    return files.folder_inventory(sql(P.FILES))


@query(O.ctes(**_INV) + f"""SELECT * FROM (SELECT folder, {_KINDS} FROM k WHERE NOT locked OR kind = 'pdf' GROUP BY folder)
WHERE pdfs > 0""")
def extracted_inventory(sql):
    return files.folder_inventory(sql(P.FILES), recursive=True)


@query(O.ctes(**_INV) + f"""SELECT sum(pdfs) AS total_pdfs, sum(excels) AS total_excels, count(*) AS total_folders
FROM (SELECT folder, {_KINDS} FROM k WHERE depth = 1 AND (NOT locked OR kind = 'pdf') GROUP BY folder)""")
def inventory_totals(sql):
    return files.inventory_totals(files.folder_inventory(sql(P.FILES), keep_empty=True))


_INBOX = """SELECT concat(CASE WHEN o_orderkey % 5 = 0 THEN 'old/' ELSE '' END, 'm', CAST(o_orderkey AS STRING),
  CASE o_orderkey % 4 WHEN 0 THEN '.eml' WHEN 1 THEN '.MSG' WHEN 2 THEN '.txt' ELSE '' END) AS path FROM {orders}"""


@query(O.ctes(f=P.ansi(_INBOX)) + """SELECT path FROM f WHERE path NOT LIKE '%/%'
  AND (lower(path) LIKE '%.eml' OR lower(path) LIKE '%.msg')""")
def mail_scan(sql):
    return files.mail_files(sql(_INBOX))


_RUNS = {"r": P.ansi(P.RUNS), "ok": "SELECT * FROM r WHERE run_name LIKE 'run!_%' ESCAPE '!'"}
_RUN_COLS = """strftime(run_date, '%Y-%m-%d') AS day, run_name,
  concat('/results/', strftime(run_date, '%Y-%m-%d'), '/', run_name, '/03_processed') AS processed,
  concat('invoice_report_', strftime(run_date, '%Y-%m-%d'), '_', substring(run_name, 5), '.xlsx') AS report_name"""


def _run_cols(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("run_date", "yyyy-MM-dd").alias("day"), "run_name", "processed", "report_name")


@query(O.ctes(**_RUNS) + f"SELECT {_RUN_COLS} FROM ok")
def list_runs(sql):
    return _run_cols(files.run_paths(sql(P.RUNS), "/results"))


@query(O.ctes(**_RUNS) + f"""SELECT {_RUN_COLS} FROM (SELECT run_date, max(run_name) AS run_name FROM ok GROUP BY run_date)""")
def latest_run(sql):
    return _run_cols(files.latest_run(sql(P.RUNS), "/results"))


_META = """SELECT concat('mail_', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '/deep' ELSE '' END) AS dir,
  c_name AS subject, c_mktsegment AS body FROM {customer}
UNION ALL SELECT concat('mail_', CAST(c_custkey AS STRING)), concat('own ', c_name), 'x' FROM {customer} WHERE c_custkey % 6 = 0"""


@query(O.ctes(fl=P.ansi(P.FILES), m=P.ansi(_META),
              d="SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM fl") + """
SELECT d.path, coalesce(a.subject, b.subject) AS subject, CASE WHEN a.dir IS NOT NULL THEN a.body ELSE b.body END AS body
FROM d LEFT JOIN m a ON a.dir = d.dir LEFT JOIN m b ON b.dir = regexp_replace(d.dir, '/[^/]*$', '') AND b.dir <> d.dir""")
def metadata_join(sql):
    return files.with_metadata(sql(P.FILES), sql(_META))


@query(O.ctes(r=P.ansi(P.ROUTES)) + "SELECT ord, source_site, appo, tidecr, NULL AS nonpo, source_site AS archive FROM r")
def resolve_columns(sql):
    titled = sql(P.ROUTES).select("ord", F.col("source_site").alias("Kofax Source Site"), F.col("appo").alias("APPO Invoice"),
                                  F.col("tidecr").alias("TIDEeCR box"), F.col("source_site").alias("My Archive"))
    return sheets.resolve_columns(titled, sheets.ROUTING_COLUMNS, sheets.ROUTING_OPTIONAL, keep=("ord",)).drop("rits")


# ===================================================================== mail ====
def _spread(sql, text: str, *keys: str) -> DataFrame:
    """One file per row, spread over tasks as a listing of real files would be."""
    return sql(text).repartition(int(sql.spark.conf.get("spark.sql.shuffle.partitions")), *keys)


def _mail_bytes(sql) -> DataFrame:
    """Every conversation turn as a mail file with its text as body and attachment."""
    t = _spread(sql, "SELECT conv_id, turn, role, text FROM {conversations}", "conv_id", "turn")
    k = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    raw = F.concat(
        F.lit('From: "'), "role", F.lit('" <'), "role", F.lit("@example.com>\nTo: in@example.com\nSubject: Turn "), k,
        F.lit('\nDate: Wed, 09 Sep 2026 10:30:00 +0200\nMIME-Version: 1.0\n'
              'Content-Type: multipart/mixed; boundary="b0undary"\n\n--b0undary\n'
              'Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), "text",
        F.lit('\n--b0undary\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="inv '), k,
        F.lit('.pdf"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.encode("text", "utf-8")),
        F.lit('\n--b0undary\nContent-Type: image/png\nContent-Disposition: inline; filename="logo.png"\n'
              'Content-Transfer-Encoding: base64\n\nAAAA\n--b0undary--\n'))
    return t.select(F.concat(F.lit("/inbox/m_"), k, F.lit(".eml")).alias("path"), F.encode(raw, "utf-8").alias("content"))


_TURN = "concat(conv_id, '_', turn)"


@query(f"""SELECT concat('/inbox/m_', {_TURN}, '.eml') AS message_id, concat('Turn ', {_TURN}) AS subject,
  md5(text) AS body_md5, role AS sender_name, concat(role, '@example.com') AS sender_email,
  '2026-09-09T10:30:00+02:00' AS received_raw, concat('Turn_', {_TURN}) AS folder_stem, 1 AS n_files FROM conversations""")
def parse_eml(sql):
    return mail.parse_eml(_mail_bytes(sql)).select(
        "message_id", "subject", F.md5(F.encode("body", "utf-8")).alias("body_md5"), "sender_name", "sender_email",
        "received_raw", "folder_stem", F.size("attachments").alias("n_files"))


@query(f"""SELECT concat('/inbox/m_', {_TURN}, '.eml') AS message_id, 1 AS att_ord, concat('inv_', {_TURN}, '.pdf') AS clean_name,
  md5(text) AS content_md5 FROM conversations""")
def mail_attachments(sql):
    return mail.attachments(mail.parse_eml(_mail_bytes(sql))).select(
        "message_id", "att_ord", "clean_name", F.md5("content").alias("content_md5"))


def _zip_texts(batches):
    """Pack each text into an archive: plain, in a folder, one level down, and for
    some a member with a parent step."""
    out = pa.schema([("message_id", pa.string()), ("att_ord", pa.int32()), ("file_name", pa.string()), ("content", pa.binary())])

    def pack(members):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
            for name, data in members:
                zf.writestr(name, data)
        return buf.getvalue()

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            k, data = r["doc_id"], r["text"].encode()
            members = [("a b.txt", data), ("sub dir/inv.pdf", data), ("in.zip", pack([("deep/x.xml", data)])),
                       ("image001.png", b"x")]
            if k % 4 == 0:
                members.append(("../evil.txt", data))
            content = b"no archive" if k % 7 == 0 else pack(members)
            rows.append({"message_id": f"m{k}", "att_ord": 1, "file_name": "All.ZIP", "content": content})
        yield pa.RecordBatch.from_pylist(rows, schema=out)


@query("""WITH d AS (SELECT concat('m', doc_id) AS message_id, md5(text) AS h, doc_id % 7 = 0 AS broken,
                     doc_id % 4 = 0 AS risky FROM documents)
SELECT message_id, 0 AS depth, '' AS rel_dir, 'a_b.txt' AS file_name, false AS unsafe, h, NULL AS reason FROM d WHERE NOT broken
UNION ALL SELECT message_id, 0, 'sub_dir', 'inv.pdf', false, h, NULL FROM d WHERE NOT broken
UNION ALL SELECT message_id, 1, 'deep', 'x.xml', false, h, NULL FROM d WHERE NOT broken
UNION ALL SELECT message_id, 0, '', 'evil.txt', true, h, NULL FROM d WHERE NOT broken AND risky
UNION ALL SELECT message_id, 0, '', NULL, true, NULL,
  'unsafe path(s) in zip All.ZIP (contained, not extracted outside): [''../evil.txt'']' FROM d WHERE NOT broken AND risky
UNION ALL SELECT message_id, 0, '', NULL, false, NULL, 'unreadable or corrupt zip: All.ZIP' FROM d WHERE broken""")
def expand_zip(sql):
    packed = _spread(sql, "SELECT doc_id, text FROM {documents}", "doc_id").mapInArrow(
        _zip_texts, "message_id string, att_ord int, file_name string, content binary")
    return archives.expand_zip(packed).select(
        "message_id", "depth", "rel_dir", "file_name", "unsafe", F.md5("content").alias("h"), "reason")


# ================================================================ responses ====
_RESPONSES = """SELECT o_orderkey AS pdf_id, CAST(o_custkey % 1000 AS INT) AS page_idx, o_orderkey % 8 AS kind, concat(
  '<think>{{"supplier_name_on_page": "draft", "po_numbers": []}}</think> note {{x}} ```json ',
  CASE o_orderkey % 8
    WHEN 0 THEN concat('{{"supplier_name_on_page": "', o_orderpriority, '", "invoice_number": ', CAST(o_orderkey AS STRING), ', "po_numbers": ["PO 3500000001", "bad"], "bill_to_client_name": "A {{b}}"}}')
    WHEN 1 THEN concat('{{"supplier_name_on_page": "', o_orderpriority, '", "invoice_number": "N/A", "po_numbers": [], "bill_to_client_name": "none"}}')
    WHEN 2 THEN '{{"supplier_name_on_page": 5, "po_numbers": [3500000001]}}'
    WHEN 3 THEN '{{"supplier_name_on_page": null, "invoice_number": "X-1", "po_numbers": null}}'
    WHEN 4 THEN '{{"supplier_name_on_page": "first"}} {{"other": 1}}'
    WHEN 5 THEN 'nothing here'
    WHEN 6 THEN '{{"supplier_name_on_page": "broken"'
    ELSE '{{"x": {{"supplier_name_on_page": "inner"}}, "invoice_number": ["a"]}}' END, '```') AS raw_text
FROM {orders}"""
# The example in the note must not disturb the braces: it is one balanced, unreadable object.


@query(O.ctes(r=P.ansi(_RESPONSES)) + """
SELECT pdf_id, page_idx, kind IN (0, 1, 3, 4) AS read_ok,
  CASE kind WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 4 THEN 'first' END AS supplier_name_on_page,
  CASE kind WHEN 0 THEN CAST(pdf_id AS VARCHAR) WHEN 3 THEN 'X-1' END AS invoice_number
FROM r JOIN orders ON o_orderkey = pdf_id""")
def parse_signals(sql):
    return responses.parse_signals(sql(_RESPONSES))


@query(O.ctes(r=P.ansi(_RESPONSES)) + """
SELECT pdf_id, page_idx, kind IN (0, 1, 4, 7) AS read_ok, CASE kind WHEN 0 THEN 'A {b}' END AS bill_to,
  CASE WHEN kind = 0 THEN '3500000001' WHEN kind IN (1, 4, 7) THEN '' END AS pos FROM r""")
def parse_fields(sql):
    return responses.parse_fields(sql(_RESPONSES)).select(
        "pdf_id", "page_idx", "read_ok", "bill_to", F.array_join("po_numbers", ",").alias("pos"))


_TRANSLATED = """SELECT p_partkey, concat('ß ', p_name, CASE WHEN p_partkey % 6 = 5 THEN '.' ELSE '' END) AS src,
  CASE p_partkey % 6 WHEN 0 THEN concat('Translation: ', p_name) WHEN 1 THEN concat('"', p_name, '"')
    WHEN 2 THEN concat('<think>hm</think> English - ', p_name, '.') WHEN 3 THEN ' ' WHEN 4 THEN NULL
    ELSE concat('translated name: ', '''', p_name, '.''') END AS raw_text FROM {part}"""


@query(O.ctes(t=P.ansi(_TRANSLATED)) + """
SELECT src, CASE p_partkey % 6 WHEN 3 THEN src WHEN 4 THEN src WHEN 5 THEN concat(p_name, '.') ELSE p_name END AS dst
FROM t JOIN part USING (p_partkey)""")
def clean_translations(sql):
    return responses.translations(sql(_TRANSLATED))


# ============================================================ stream and run ====
_DELIVERIES = 3


@query(O.ctes(**{**_RUN, "cnt": f"""SELECT *, 1 + coalesce(sum(invoice_count) OVER (ORDER BY folder_ord % {_DELIVERIES}, folder_ord,
  kofax_email, le ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS counter FROM grp"""})
       + "SELECT batch_id, kofax_email, le, folder AS source_email, invoice_count, counter FROM batches")
def inbox_stream(sql):
    """Orders arrive in deliveries of whole mails; each is one micro-batch that is quarantined, batched and numbered on."""
    spark = sql.spark
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/inbox-{uuid.uuid4()}"
    orders = spark.read.parquet(f"{sql.sf_dir.rstrip('/')}/orders.parquet")
    counter = inbox.DayCounter(base)

    def handle(new: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        run = new.sparkSession
        fixed = {t: run.read.parquet(f"{sql.sf_dir.rstrip('/')}/{t}.parquet") for t in ("customer", "nation")}
        docs = run.sql(P.DOCS, orders=new, **fixed)
        errors = run.sql(P.ERRORS, orders=new)
        tags = F.filter(F.array(F.when(F.col("is_telecom"), "TELECOM"), F.when(F.col("is_debit"), "DD")),
                        lambda t: t.isNotNull())
        clean, _ = batching.quarantine(docs.withColumn("tags", tags), errors)
        batches = batching.assign_batches(clean, RUN_DATE, counter.start(run, RUN_DATE, batch_id))
        counter.record(batches, RUN_DATE, batch_id)
        return {"batches": batches}

    for k in range(_DELIVERIES):
        orders.where(F.col("o_custkey") % _DELIVERIES == k).write.mode("append").parquet(f"{base}/new")
        source = inbox.file_stream(spark, f"{base}/new", orders.schema)
        inbox.run_inbox(source, base, f"{base}/checkpoint", handle, f"inbox_{uuid.uuid4().hex}").awaitTermination()
    return inbox.read_table(spark, base, "batches").select(
        "batch_id", "kofax_email", "le", "source_email", "invoice_count", "counter")
