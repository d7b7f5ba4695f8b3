"""Queries on page sequences, fields and text functions, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..functions import lexicon as lx
from ..operators import fields, segment
from ..sources import responses
from . import oracles as O
from . import projections as P
from .registry import query


# ============================================================ segmentation ====
def _by_equality(pages: DataFrame, cut: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Page roles with the supplier compared by equality."""
    same = F.coalesce(F.col("supplier_name_on_page") == F.col("key_supplier"), F.lit(False))
    keyed = segment.with_key_supplier(pages, cut).withColumn("supplier_ok", same)
    return segment.segment_pages(keyed, blocks=cut, keep=keep)


def _equal_roles(sql) -> DataFrame:
    return segment.by_length(segment.clean_signals(sql(P.SIGNALS)), _by_equality)


def _merged(signals: DataFrame, page_fields: DataFrame) -> DataFrame:
    """From page readings to merged documents; each bundle meets its pages and fields once."""
    return fields.by_bundle(signals, page_fields,
                            lambda pages, cut: fields.merge_read(_by_equality(pages, cut, fields.READ)))


@query(O.ctes(**O.roles()) + "SELECT pdf_id, page_idx, rule, role, invoice_index FROM roles")
def segment_pages(sql):
    return _equal_roles(sql).select("pdf_id", "page_idx", "rule", "role", "invoice_index")


_PAIRS = {
    "pp": """SELECT DISTINCT regexp_replace(lower(supplier_name_on_page), '[^a-z0-9]', '', 'g') AS a,
             regexp_replace(lower(key_supplier), '[^a-z0-9]', '', 'g') AS b FROM k
             WHERE supplier_name_on_page IS NOT NULL AND key_supplier IS NOT NULL"""}
_K = {k: v for k, v in O.roles().items() if k in ("sig", "k")}


@query(O.ctes(**_K, **_PAIRS, **O.partial_scores("pp")) + """
SELECT pdf_id, page_idx, key_supplier, coalesce(score >= 85, false) AS supplier_ok
FROM k LEFT JOIN ps ON a = regexp_replace(lower(supplier_name_on_page), '[^a-z0-9]', '', 'g')
                   AND b = regexp_replace(lower(key_supplier), '[^a-z0-9]', '', 'g')""")
def key_supplier_fuzzy(sql):
    pages = segment.with_supplier_ok(segment.with_key_supplier(segment.clean_signals(sql(P.SIGNALS))))
    return pages.select("pdf_id", "page_idx", "key_supplier", "supplier_ok")


@query(O.ctes(**O.roles()) + """
SELECT pdf_id, invoice_index, max(CASE WHEN rule = 'main_start' THEN invoice_number END) AS invoice_number,
  coalesce(max(CASE WHEN rule = 'main_start' THEN supplier_name_on_page END), max(key_supplier)) AS supplier_name,
  count(*) FILTER (role = 'main') AS n_main, count(*) FILTER (role = 'support') AS n_support,
  count(*) FILTER (NOT read_ok) AS n_unknown
FROM roles WHERE role <> 'dropped' GROUP BY pdf_id, invoice_index""")
def document_heads(sql):
    return segment.document_heads(_equal_roles(sql))


@query(O.ctes(
    **O.roles(),
    pg="""SELECT pdf_id, invoice_index, role AS kind, page_idx + 1 AS page FROM roles WHERE role <> 'dropped'
          UNION ALL SELECT pdf_id, invoice_index, 'all', page_idx + 1 FROM roles WHERE role <> 'dropped'""",
    isl="""SELECT *, page - row_number() OVER (PARTITION BY pdf_id, invoice_index, kind ORDER BY page) AS g FROM pg""",
    rng="""SELECT pdf_id, invoice_index, kind, min(page) AS lo, max(page) AS hi FROM isl
           GROUP BY pdf_id, invoice_index, kind, g""",
    txt="""SELECT pdf_id, invoice_index, kind, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR)
           ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS t FROM rng GROUP BY pdf_id, invoice_index, kind""") + """
SELECT pdf_id, invoice_index, coalesce(max(t) FILTER (kind = 'main'), '—') AS main_pages,
  coalesce(max(t) FILTER (kind = 'support'), '—') AS support_pages,
  coalesce(max(t) FILTER (kind = 'all'), '—') AS all_pages
FROM txt GROUP BY pdf_id, invoice_index""")
def page_ranges(sql):
    return segment.page_range_text(_equal_roles(sql))


@query(O.ctes(sig=P.ansi(P.SIGNALS)) + """
SELECT count(*) AS pages, count(*) FILTER (read_ok) AS read, count(*) FILTER (NOT read_ok) AS failed FROM sig""")
def signal_summary(sql):
    return segment.signal_summary(sql(P.SIGNALS))


# ================================================================== fields ====
def _fields(sql) -> DataFrame:
    return sql(P.FIELDS).withColumn("po_numbers", F.array("po_text"))


_PO = O.quote(lx.PO_PATTERN)


def _merge_sql(**readings: str) -> str:
    """Check SQL of the merged documents; ``readings`` may replace ``sig`` and ``f``."""
    return O.ctes(
        **(O.roles() | {"f": P.ansi(P.FIELDS)} | readings),
        m=f"""SELECT r.pdf_id, r.invoice_index, r.page_idx,
              CASE WHEN f.read_ok AND lower(bill_to) <> 'n/a' THEN bill_to END AS bill,
              CASE WHEN f.read_ok THEN regexp_extract_all(po_text, {_PO}, 1) ELSE [] END AS pos
              FROM roles r LEFT JOIN f USING (pdf_id, page_idx) WHERE r.role = 'main'""",
        w="""SELECT *, coalesce(bool_or(bill IS NOT NULL) OVER p, false) AS had_bill,
             coalesce(bool_or(len(pos) > 0) OVER p, false) AS had_po FROM m
             WINDOW p AS (PARTITION BY pdf_id, invoice_index ORDER BY page_idx
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        kept="SELECT * FROM w WHERE NOT (had_bill AND had_po)",
        pu="""SELECT pdf_id, invoice_index, po, min(page_idx * 1000 + seq) AS first_at FROM (
                SELECT pdf_id, invoice_index, page_idx, unnest(pos) AS po, generate_subscripts(pos, 1) AS seq FROM kept)
              GROUP BY pdf_id, invoice_index, po""",
        pl="""SELECT pdf_id, invoice_index, string_agg(po, ',' ORDER BY first_at) AS po_list FROM pu
              GROUP BY pdf_id, invoice_index""",
        b="""SELECT pdf_id, invoice_index, first(bill ORDER BY page_idx) FILTER (bill IS NOT NULL) AS bill_to
             FROM kept GROUP BY pdf_id, invoice_index""",
        c="SELECT pdf_id, invoice_index, count(*) AS n_main_pages FROM m GROUP BY pdf_id, invoice_index") + """
SELECT c.pdf_id, c.invoice_index, bill_to, coalesce(po_list, '') AS po_list, n_main_pages
FROM c LEFT JOIN b USING (pdf_id, invoice_index) LEFT JOIN pl USING (pdf_id, invoice_index)"""


@query(_merge_sql())
def early_stop_merge(sql):
    return _merged(sql(P.SIGNALS), _fields(sql)).select(
        "pdf_id", "invoice_index", "bill_to", F.array_join("po_numbers", ",").alias("po_list"), "n_main_pages")


# The same pages as model responses; some pages got none.
_ALL_PAGES = "SELECT pdf_id, page_idx FROM (" + P.SIGNALS + ")"
_SIGNAL_ANSWERS = """SELECT pdf_id, page_idx, concat('```json {{"supplier_name_on_page": "', supplier_name_on_page, '", "invoice_number": ',
  CASE WHEN invoice_number IS NULL THEN 'null' ELSE concat('"', invoice_number, '"') END, '}} ```') AS raw_text
FROM (""" + P.SIGNALS + """) WHERE read_ok AND (pdf_id + page_idx) % 13 <> 0"""
_FIELD_ANSWERS = """SELECT pdf_id, page_idx, concat('{{"bill_to_client_name": ',
  CASE WHEN bill_to IS NULL THEN 'null' ELSE concat('"', bill_to, '"') END, ', "po_numbers": [',
  CASE WHEN po_text IS NULL THEN '' ELSE concat('"', po_text, '"') END, ']}}') AS raw_text
FROM (""" + P.FIELDS + """) WHERE read_ok AND (pdf_id + page_idx) % 7 <> 0"""
_SEEN = "read_ok AND (pdf_id + page_idx) % 13 <> 0"


@query(_merge_sql(
    sig=f"""SELECT pdf_id, page_idx, {_SEEN} AS read_ok, CASE WHEN {_SEEN} THEN supplier_name_on_page END AS supplier_name_on_page,
        CASE WHEN {_SEEN} THEN invoice_number END AS invoice_number FROM ({P.ansi(P.SIGNALS)})""",
    f=f"SELECT * FROM ({P.ansi(P.FIELDS)}) WHERE (pdf_id + page_idx) % 7 <> 0"))
def documents_from_responses(sql):
    """From the raw text of model responses to merged documents; pages without a response count as failed."""
    readings = responses.page_readings(sql(_ALL_PAGES), sql(_SIGNAL_ANSWERS), sql(_FIELD_ANSWERS))
    return _merged(*readings).select(
        "pdf_id", "invoice_index", "bill_to", F.array_join("po_numbers", ",").alias("po_list"), "n_main_pages")


_PO_TEXT = """SELECT o_orderkey, concat('PO ', CAST(3500000000 + o_orderkey AS STRING), ';',
  CAST(4501000000 + o_custkey AS STRING), ' x', CAST(7000000000 + o_custkey AS STRING), ' ',
  CAST(3500000000 + o_orderkey AS STRING), '/', CAST(5906000000 + o_custkey AS STRING), ' 99',
  CAST(3000000000 + o_custkey AS STRING)) AS t,
  CASE o_orderkey % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Null' WHEN 2 THEN '' ELSE o_orderpriority END AS raw
FROM {orders}"""


@query(O.ctes(t=P.ansi(_PO_TEXT)) + f"""
SELECT o_orderkey, (SELECT string_agg(v, ',' ORDER BY seq) FROM (
    SELECT v, min(seq) AS seq FROM (SELECT unnest(regexp_extract_all(t, {_PO}, 1)) AS v,
                                         generate_subscripts(regexp_extract_all(t, {_PO}, 1), 1) AS seq) GROUP BY v)) AS pos,
  CASE WHEN lower(trim(raw)) NOT IN ('none', 'null', 'n/a', 'na', 'nil', '') THEN raw END AS cleaned
FROM t""")
def po_extract(sql):
    return sql(_PO_TEXT).select("o_orderkey", F.array_join(text.po_numbers("t"), ",").alias("pos"),
                                text.null_if_sentinel("raw").alias("cleaned"))


# ================================================================ scalars =====
@query(O.ctes(n=P.ansi(P.NAMES)) + f"""
SELECT ord, {O.name_key('name')} AS key, regexp_matches(name, '[^\\x00-\\x7F]') AS foreign_text FROM n""")
def normalize_names(sql):
    return sql(P.NAMES).select("ord", text.normalize_name("name").alias("key"),
                               text.non_ascii("name").alias("foreign_text"))


@query(O.ctes(n=P.ansi(P.NAMES)) + f"SELECT ord, {O.entity_key('name')} AS key FROM n")
def normalize_entities(sql):
    return sql(P.NAMES).select("ord", text.normalize_entity("name").alias("key"))


@query(O.ctes(n=P.ansi(P.NAMES)) + f"""
SELECT ord, {O.vn_key('name')} AS key,
  trim(regexp_replace(regexp_replace(name, '\\+[A-Z]\\d+', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM n""")
def normalize_vn_names(sql):
    return sql(P.NAMES).select("ord", text.normalize_vn("name").alias("key"),
                               text.clean_artifact("name").alias("cleaned"))


_RAW_NAMES = """SELECT page_id, url, concat(url, '.', CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PDF' ELSE 'tar.gz' END)
  AS file, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE replace(url, '/', ' ') END AS folder, page_id % 120 + 1 AS ord
FROM {pages}"""


@query(O.ctes(t=P.ansi(_RAW_NAMES), s="""SELECT *,
  trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_.') AS safe,
  trim(regexp_replace(regexp_replace(trim(folder), '[^A-Za-z0-9._\\- ]+', '_', 'g'), '[\\s_]+', '_', 'g'), '._-') AS fold,
  regexp_extract(file, '[^/](\\.[A-Za-z0-9]{1,10})$', 1) AS ext FROM t""") + """
SELECT page_id, substring(safe, 1, 60) AS result_name,
  CASE WHEN trim(folder) = '' OR fold = '' THEN 'message' ELSE substring(fold, 1, 60) END AS folder_name,
  concat(substring(trim(regexp_replace(regexp_replace(substring(file, 1, length(file) - length(ext)),
    '[^A-Za-z0-9._\\- ]+', '_', 'g'), '[\\s_]+', '_', 'g'), '._-'), 1, 60 - length(ext)), ext) AS file_name,
  regexp_replace(trim(url), '[<>:"/\\\\|?*]', '_', 'g') AS path_part,
  regexp_replace(url, '[^a-zA-Z0-9.]', '_', 'g') AS attachment_name,
  concat(substring(safe, 1, 60), '_noinv_', lpad(CAST(ord AS VARCHAR), CAST(greatest(2, length(CAST(ord AS VARCHAR))) AS INT), '0')) AS stem
FROM s""")
def sanitize_names(sql):
    return sql(_RAW_NAMES).select(
        "page_id", text.sanitize_result("url", "x").alias("result_name"),
        text.sanitize_folder("folder", "message").alias("folder_name"),
        text.sanitize_file("file", "attachment").alias("file_name"), text.sanitize_path_part("url").alias("path_part"),
        text.sanitize_attachment("url", F.lit("subject")).alias("attachment_name"),
        text.output_stem("url", F.lit(None).cast("string"), "ord").alias("stem"))


_HEADERS = """SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN concat('"', c_name, '" <', lower(c_mktsegment), '@example.com>')
    WHEN 1 THEN concat(lower(c_mktsegment), '.x@mail.example.com')
    WHEN 2 THEN concat(c_mktsegment, ' only') ELSE '' END AS sender,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('on ', o_orderpriority) ELSE concat(
    CASE WHEN o_orderkey % 2 = 0 THEN 'Wed, ' ELSE '' END,
    lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), ' ',
    substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INT), 3), ' ',
    CAST(year(o_orderdate) AS STRING), ' 10:30:', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'),
    CASE o_orderkey % 3 WHEN 0 THEN ' +0200' WHEN 1 THEN ' GMT' ELSE ' -0000' END) END AS sent
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


@query(O.ctes(h=P.ansi(_HEADERS)) + """
SELECT h.o_orderkey,
  CASE WHEN sender LIKE '%<%' THEN c_name WHEN sender LIKE '%@%' THEN '' ELSE sender END AS sender_name,
  CASE WHEN sender LIKE '%<%' THEN regexp_extract(sender, '<(.*)>', 1) WHEN sender LIKE '%@%' THEN sender ELSE '' END
    AS sender_email,
  CASE WHEN h.o_orderkey % 5 = 0 THEN sent ELSE concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:30:',
    lpad(CAST(h.o_orderkey % 60 AS VARCHAR), 2, '0'),
    CASE h.o_orderkey % 3 WHEN 0 THEN '+02:00' WHEN 1 THEN '+00:00' ELSE '' END) END AS received
FROM h JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey""")
def sender_parse(sql):
    return sql(_HEADERS).select("o_orderkey", text.parse_sender("sender").alias("s"),
                                text.date_to_iso("sent").alias("received")).select("o_orderkey", "s.*", "received")


@query("""
SELECT o_orderkey, substring('UMTWHFS', CAST(dayofweek(o_orderdate) AS INT) + 1, 1) AS letter,
  concat('LE', o_custkey % 900 + 100, '.G', substring('UMTWHFS', CAST(dayofweek(o_orderdate) AS INT) + 1, 1),
    CASE WHEN o_orderkey % 150 < 10 THEN '0' ELSE '' END, o_orderkey % 150, '-DD') AS batch_id,
  concat('batch_report_', strftime(o_orderdate, '%Y-%m-%d'), '_10-00-00.xlsx') AS report
FROM orders""")
def day_letters(sql):
    o = sql("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM {orders}")
    le = F.concat(F.lit("LE"), (F.col("o_custkey") % 900 + 100).cast("string"))
    letter = text.day_letter("d")
    return o.select("o_orderkey", letter.alias("letter"),
                    text.batch_id(le, letter, F.col("o_orderkey") % 150, F.lit("-DD")).alias("batch_id"),
                    text.report_name("batch_report", F.date_format("d", "yyyy-MM-dd"),
                                     F.lit("run_10-00-00")).alias("report"))


@query("""
SELECT page_id, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT
    CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END AS v
    FROM (SELECT unnest(regexp_extract_all(html, '\\d+')) AS d))) AS runs,
  regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '[^a-z0-9]', '', 'g') ~ '^[0-9]+$' AS pure
FROM pages""")
def digit_runs(sql):
    return sql("SELECT page_id, url, html FROM {pages}").select(
        "page_id", text.blank_to_null(F.array_join(F.sort_array(text.digit_runs("html")), ",")).alias("runs"),
        text.pure_digit_key(text.base_name("url")).isNotNull().alias("pure"))


_PAIR = "SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1"


@query(O.ctes(t=P.ansi(_PAIR), d="SELECT DISTINCT a, b FROM t", **O.ratio_scores("d"), **O.token_sort_scores("d"),
              **O.partial_scores("d"), **O.token_set_scores("d")) + """
SELECT id, round(rs.score, 4) AS ratio, round(ts.score, 4) AS token_sort, round(ps.score, 4) AS partial,
  round(tt.score, 4) AS token_set
FROM t JOIN rs USING (a, b) JOIN ts USING (a, b) JOIN ps USING (a, b) JOIN tt USING (a, b)""")
def name_similarity(sql):
    a, b = F.col("a"), F.col("b")
    return sql(_PAIR).select(
        "id", F.round(fuzzy.fuzzy_ratio(a, b), 4).alias("ratio"),
        F.round(fuzzy.fuzzy_token_sort(a, b), 4).alias("token_sort"),
        F.round(fuzzy.fuzzy_partial(a, b), 4).alias("partial"),
        F.round(fuzzy.fuzzy_token_set(a, b), 4).alias("token_set"))
