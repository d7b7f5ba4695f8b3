"""Queries on reference lists, name matching, tags and routing, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import lexicon as lx
from ..functions import text
from ..operators import match, reference, routing, tagging
from ..operators.scale import cut_lineage
from . import oracles as O
from . import projections as P
from .registry import query

# ============================================================== references ====
_SENSITIVE = """SELECT p_partkey AS ord, CASE WHEN p_size = 13 THEN '  ' ELSE concat(' ', p_type, CASE p_partkey % 5
    WHEN 0 THEN ' Machinery Inc.' WHEN 1 THEN ' machine  works' WHEN 2 THEN ' Furniture Co' WHEN 3 THEN ''
    ELSE ' Automobiles & Parts Ltd' END) END AS supplier_remit_to_name FROM {part}"""

_SENS_REF = {
    "raw": P.ansi(_SENSITIVE),
    "keyed": f"""SELECT ord, trim(supplier_remit_to_name) AS original, {O.name_key('supplier_remit_to_name')} AS norm
                 FROM raw WHERE trim(supplier_remit_to_name) <> ''""",
    "ref": """SELECT norm, arg_min(original, ord) AS original, min(ord) AS ref_ord FROM keyed WHERE norm <> ''
              GROUP BY norm"""}


@query(O.ctes(**_SENS_REF) + "SELECT norm, original, ref_ord FROM ref")
def sensitive_reference(sql):
    return reference.sensitive_reference(sql(_SENSITIVE))


@query(O.ctes(**_SENS_REF) + """
SELECT (SELECT count(*) FROM keyed) AS count_raw_rows, (SELECT count(*) FROM ref) AS count_unique_normalized,
  (SELECT count(*) FROM keyed WHERE norm = '') AS skipped_unnormalizable""")
def sensitive_reference_stats(sql):
    return reference.sensitive_reference_stats(sql(_SENSITIVE))


# A longer entity list: one row per supplier, with junk, blanks and shared names.
_LONG_LIST = """SELECT CAST(s_suppkey AS BIGINT) AS ord, CASE WHEN s_suppkey % 23 = 0 THEN ' ' ELSE
    concat('LE', CAST(100 + s_suppkey % 40 AS STRING)) END AS le,
  CASE WHEN s_suppkey % 17 = 0 THEN 'Do not scan this one' WHEN s_suppkey % 19 = 0 THEN 'nan'
       ELSE concat(n_name, ' Handel ', CAST(s_suppkey % 30 AS STRING), ' GmbH / /', n_name, ' Corp. ',
                   CAST(s_suppkey % 30 AS STRING)) END AS bill_to_name,
  concat(n_name, ' ') AS source_site, CAST(n_regionkey AS STRING) AS country
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _entity_ref(raw: str) -> dict[str, str]:
    return {
        "lraw": raw,
        "rows": """SELECT ord, trim(le) AS le, trim(source_site) AS source_site, trim(country) AS country,
                   trim(bill_to_name) AS bill FROM lraw""",
        "good": """SELECT * FROM rows WHERE le <> '' AND lower(bill) NOT IN ('', 'nan', 'none')""",
        "kept": """SELECT * FROM good WHERE NOT (contains(lower(bill), 'do not scan')
                   OR contains(lower(bill), 'send it to') OR contains(lower(bill), '@'))""",
        "al": """SELECT *, list_filter(list_transform(string_split(bill, '/'), lambda a: trim(a)), lambda a: a <> '')
                 AS names FROM kept""",
        "un": """SELECT ord, le, source_site, country, unnest(names) AS original,
                 generate_subscripts(names, 1) - 1 AS pos FROM al""",
        "ents": f"""SELECT {O.entity_key('original')} AS norm, original, le, source_site, country,
                    ord * 1048576 + pos AS ref_ord FROM un"""}


@query(O.ctes(**_entity_ref(P.ansi(_LONG_LIST))) + "SELECT * FROM ents")
def le_alias_build(sql):
    return reference.entity_reference(sql(_LONG_LIST))


_CLASH = "SELECT norm FROM ents GROUP BY norm HAVING count(DISTINCT le) > 1"


@query(O.ctes(**_entity_ref(P.ansi(_LONG_LIST))) +
       f"SELECT norm, le, original, ref_ord FROM ents WHERE norm IN ({_CLASH})")
def le_collisions(sql):
    return reference.collisions(reference.entity_reference(sql(_LONG_LIST)), "le", "original")


@query(O.ctes(**_entity_ref(P.ansi(_LONG_LIST))) + f"""
SELECT (SELECT count(*) FROM ents) AS count_entries,
  (SELECT count(*) FROM rows) - (SELECT count(*) FROM good) AS skipped_blank,
  (SELECT count(*) FROM good) - (SELECT count(*) FROM kept) AS skipped_junk,
  (SELECT count(*) FROM ({_CLASH})) AS collisions""")
def le_reference_stats(sql):
    return reference.entity_reference_stats(sql(_LONG_LIST))


_VN_REF = {
    "vraw": P.ansi(P.VN), "tr": P.ansi(P.VN_TRANSLATIONS),
    "v1": """SELECT ord, trim(supplier_id) AS supplier_id,
             trim(regexp_replace(regexp_replace(supplier_name, '\\+[A-Z]\\d+', '', 'g'), '\\s+', ' ', 'g')) AS name,
             CASE WHEN alt_name IS NULL OR length(trim(alt_name)) <= 2 OR lower(trim(alt_name)) IN
               ('.', '-', '', 'nan', 'none', 'n/a') THEN NULL ELSE trim(alt_name) END AS alt FROM vraw""",
    "v2": """SELECT *, CASE WHEN regexp_matches(name, '[^\\x00-\\x7F]') THEN name
               WHEN regexp_matches(alt, '[^\\x00-\\x7F]') THEN alt END AS vietnamese_name,
             CASE WHEN NOT regexp_matches(name, '[^\\x00-\\x7F]') THEN name
               WHEN NOT regexp_matches(alt, '[^\\x00-\\x7F]') THEN alt END AS en FROM v1""",
    "v3": """SELECT v2.*, coalesce(en, dst, vietnamese_name) AS english_name, en IS NULL AS translated
             FROM v2 LEFT JOIN tr ON en IS NULL AND src = vietnamese_name""",
    "v4": """SELECT ord, supplier_id, list_filter([name, alt, english_name, vietnamese_name], lambda a: a IS NOT NULL)
             AS pool FROM v3""",
    "v5": "SELECT ord, supplier_id, unnest(pool) AS alias, generate_subscripts(pool, 1) AS pos FROM v4",
    "v6": """SELECT supplier_id, ord, alias, row_number() OVER (PARTITION BY ord ORDER BY min(pos)) - 1 AS pos
             FROM v5 GROUP BY supplier_id, ord, alias""",
    "ali": f"SELECT {O.vn_key('alias')} AS norm, alias, supplier_id, ord * 1048576 + pos AS ref_ord FROM v6"}


@query(O.ctes(**_VN_REF) + f"""
SELECT ord, supplier_id, vietnamese_name, english_name, translated,
  {O.vn_key('vietnamese_name')} AS normalized_vietnamese, {O.vn_key('english_name')} AS normalized_english FROM v3""")
def vn_suppliers(sql):
    return reference.vn_suppliers(sql(P.VN), sql(P.VN_TRANSLATIONS)).drop("name", "alt")


@query(O.ctes(**_VN_REF) + "SELECT norm, alias, supplier_id, ref_ord FROM ali")
def vn_aliases(sql):
    return reference.vn_aliases(reference.vn_suppliers(sql(P.VN), sql(P.VN_TRANSLATIONS)))


@query(O.ctes(**_VN_REF) + """
SELECT norm, supplier_id, alias, ref_ord FROM ali
WHERE norm IN (SELECT norm FROM ali GROUP BY norm HAVING count(DISTINCT supplier_id) > 1)""")
def vn_collisions(sql):
    ref = reference.vn_aliases(reference.vn_suppliers(sql(P.VN), sql(P.VN_TRANSLATIONS)))
    return reference.collisions(ref, "supplier_id", "alias")


_ROUTE_IDX = {
    "rraw": P.ansi(P.ROUTES),
    "rk": """SELECT *, unnest(list_concat([lower(trim(source_site))], list_filter(list_transform(
               regexp_split_to_array(source_site, '[/\\\\]'), lambda f: lower(trim(f))), lambda f: f <> ''))) AS key,
             generate_subscripts(list_concat([''], regexp_split_to_array(source_site, '[/\\\\]')), 1) AS pos FROM rraw""",
    "idx": """SELECT key, min(ord * 1048576 + pos - 1) AS key_ord,
              arg_max(source_site, ord * 1048576 + pos) AS source_site_full,
              arg_max(appo, ord * 1048576 + pos) AS appo, arg_max(tidecr, ord * 1048576 + pos) AS tidecr
              FROM rk GROUP BY key"""}


@query(O.ctes(**_ROUTE_IDX) + "SELECT key, key_ord, source_site_full, appo, tidecr FROM idx")
def routing_index(sql):
    return reference.routing_index(sql(P.ROUTES)).select("key", "key_ord", "source_site_full", "appo", "tidecr")


# ================================================================ matching ====
def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n_docs"))


_BILL = {**_entity_ref(P.ansi(P.ENTITIES)), "bt": P.ansi(P.BILL_TO)}
_BILL_KEYS = {
    **_BILL,
    "nm": "SELECT bill_to, count(*) AS n_docs FROM bt GROUP BY bill_to",
    "nk": f"SELECT *, {O.entity_key('bill_to')} AS key FROM nm",
    "one": "SELECT norm, min(ref_ord) AS ref_ord FROM ents GROUP BY norm"}


@query(O.ctes(**_BILL_KEYS) + """
SELECT bill_to, n_docs, key, original, le, source_site FROM nk JOIN one ON key = one.norm JOIN ents USING (ref_ord)""")
def exact_match(sql):
    # keys are worked out once per distinct name, before the join can reach below
    names = cut_lineage(_counted(sql(P.BILL_TO), "bill_to").withColumn("key", text.normalize_entity("bill_to")))
    ref = reference.entity_reference(sql(P.ENTITIES))
    first = ref.groupBy("norm").agg(F.min_by(F.struct("original", "le", "source_site"), "ref_ord").alias("e"))
    return (names.join(first.withColumnRenamed("norm", "key"), "key")
            .select("bill_to", "n_docs", "key", "e.original", "e.le", "e.source_site"))


def _top1(threshold: int, scored: str, key: str = "key") -> dict[str, str]:
    """CTE ``hit(key, matched, score, method, ref_ord)`` from ``one`` and pair scores."""
    return {
        "exactly": f"SELECT nk.{key} AS key, one.ref_ord FROM (SELECT DISTINCT {key} FROM nk) nk JOIN one ON nk.{key} = one.norm",
        "best": f"""SELECT a AS key, max(score) AS score, arg_min(ref_ord, (-score, ref_ord)) AS ref_ord
                    FROM {scored} JOIN one ON b = norm WHERE score > 0 GROUP BY a""",
        "hit": f"""SELECT key, true AS matched, 100 AS score, 'exact' AS method, ref_ord FROM exactly
                   UNION ALL SELECT p.a, coalesce(score >= {threshold}, false), CAST(floor(coalesce(score, 0)) AS INT),
                   CASE WHEN coalesce(score, 0) >= {threshold} THEN 'fuzzy' ELSE 'no_match' END, ref_ord
                   FROM (SELECT DISTINCT a FROM pairs) p LEFT JOIN best ON best.key = p.a"""}


_ALL_PAIRS = {"pairs": """SELECT DISTINCT nk.key AS a, one.norm AS b FROM nk, one
                          WHERE nk.key <> '' AND nk.key NOT IN (SELECT norm FROM one)"""}


@query(O.ctes(**_BILL_KEYS, **_ALL_PAIRS, **O.token_sort_scores("pairs"), **_top1(lx.ENTITY_THRESHOLD, "ts")) + """
SELECT bill_to, n_docs, coalesce(matched, false) AS matched, coalesce(score, 0) AS score,
  coalesce(method, 'empty') AS method, original, le, source_site, country
FROM nk LEFT JOIN hit USING (key) LEFT JOIN ents USING (ref_ord)""")
def le_fuzzy_top1(sql):
    docs = sql(P.BILL_TO)
    ref = reference.entity_reference(sql(P.ENTITIES))
    found = match.match_entity(docs, "bill_to", ref).withColumnRenamed("name", "bill_to")
    return _counted(docs, "bill_to").join(found, "bill_to").select(
        "bill_to", "n_docs", "matched", "score", "method", "original", "le", "source_site", "country")


_SUPPLIER_NAMES = """SELECT c_custkey, concat(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END,
  CASE c_nationkey % 5 WHEN 0 THEN ' Works GmbH' WHEN 1 THEN ' Inc' WHEN 2 THEN ' Parts, Ltd.' WHEN 3 THEN '' ELSE ' Co' END,
  CASE WHEN c_custkey % 3 = 0 THEN ' Economy' ELSE '' END) AS name FROM {customer}"""


@query(O.ctes(
    **_SENS_REF, cn=P.ansi(_SUPPLIER_NAMES), nm="SELECT name, count(*) AS n_docs FROM cn GROUP BY name",
    nk=f"SELECT *, {O.name_key('name')} AS key FROM nm", one="SELECT norm, ref_ord FROM ref", **_ALL_PAIRS,
    **O.token_sort_scores("pairs"), lp=f"""SELECT a, b FROM pairs WHERE length(a) >= {lx.MIN_LEN_FOR_PARTIAL}
                                           AND length(b) >= {lx.MIN_LEN_FOR_PARTIAL}""",
    **O.partial_scores("lp"),
    joint="SELECT a, b, greatest(ts.score, coalesce(ps.score, 0)) AS score FROM ts LEFT JOIN ps USING (a, b)",
    **_top1(lx.SENSITIVE_THRESHOLD, "joint")) + """
SELECT name, n_docs, coalesce(matched, false) AS is_sensitive, coalesce(score, 0) AS score,
  coalesce(method, 'empty') AS method, original AS matched_name
FROM nk LEFT JOIN hit USING (key) LEFT JOIN ref USING (ref_ord)""")
def sensitive_match(sql):
    names = sql(_SUPPLIER_NAMES)
    found = match.match_sensitive(names, "name", reference.sensitive_reference(sql(_SENSITIVE)))
    return _counted(names, "name").join(found, "name").select(
        "name", "n_docs", F.col("matched").alias("is_sensitive"), "score", "method",
        F.col("original").alias("matched_name"))


# Supplier list and readings for translation-first matching.
_VN_LIST = """SELECT CAST(s_suppkey AS BIGINT) AS ord, CAST(1000 + s_suppkey AS STRING) AS supplier_id,
  concat(CASE s_suppkey % 3 WHEN 0 THEN 'Công ty Điện ' WHEN 1 THEN 'Electric Company ' ELSE 'Power Branch ' END,
         n_name, CASE WHEN s_suppkey % 2 = 0 THEN ' Ltd' ELSE '' END) AS supplier_name,
  CAST(NULL AS STRING) AS alt_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
_VN_TR = """SELECT concat('Công ty Điện ', n_name, ' Ltd') AS src, concat('Electric Company ', n_name, ' Ltd') AS dst FROM {nation}
UNION ALL SELECT concat('Công ty Điện ', n_name), concat('Electric Company ', n_name) FROM {nation}"""
_VN_READ = """SELECT c_custkey, concat(CASE c_custkey % 4 WHEN 0 THEN 'Công ty Điện ' WHEN 1 THEN 'electric company '
    WHEN 2 THEN 'Branch of Power ' ELSE 'Điện ' END, n_name, CASE WHEN c_custkey % 5 = 0 THEN ' Ltd' ELSE '' END) AS name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

_VN_SMALL = {**_VN_REF, "vraw": P.ansi(_VN_LIST), "tr": P.ansi(_VN_TR)}


@query(O.ctes(
    **_VN_SMALL, cn=P.ansi(_VN_READ), nm="SELECT name, count(*) AS n_docs FROM cn GROUP BY name",
    nt="""SELECT nm.*, regexp_matches(name, '[^\\x00-\\x7F]') AS translated,
          CASE WHEN regexp_matches(name, '[^\\x00-\\x7F]') THEN coalesce(dst, name) END AS translated_query
          FROM nm LEFT JOIN tr ON src = name""",
    nk=f"SELECT *, {O.vn_key('coalesce(translated_query, name)')} AS key FROM nt",
    one="SELECT norm, min(ref_ord) AS ref_ord FROM ali GROUP BY norm", **_ALL_PAIRS,
    **O.token_set_scores("pairs"), **_top1(lx.VN_THRESHOLD, "tt")) + """
SELECT name, n_docs, matched, score, method, CASE WHEN matched THEN supplier_id END AS supplier_id, alias,
  translated, translated_query
FROM nk LEFT JOIN hit USING (key) LEFT JOIN ali USING (ref_ord)""")
def vn_match(sql):
    names, tr = sql(_VN_READ), sql(_VN_TR)
    ref = reference.vn_aliases(reference.vn_suppliers(sql(_VN_LIST), tr))
    found = match.match_vn_supplier(names, "name", ref, tr)
    return _counted(names, "name").join(found, "name").select(
        "name", "n_docs", "matched", "score", "method", "supplier_id", "alias", "translated", "translated_query")


# Bill-to names in another script; half of them have a translation.
_FOREIGN = """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN concat('Торговля ', n_name)
  ELSE concat(n_name, ' Trading Ltd') END AS bill_to
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
_FOREIGN_TR = """SELECT concat('Торговля ', n_name) AS src, concat(n_name, ' Trading') AS dst FROM {nation}
WHERE n_regionkey > 1"""


@query(O.ctes(
    **_entity_ref(P.ansi(P.ENTITIES)), bt=P.ansi(_FOREIGN), tr=P.ansi(_FOREIGN_TR),
    nm="SELECT bill_to, count(*) AS n_docs FROM bt GROUP BY bill_to",
    nt=f"""SELECT nm.*, {O.entity_key('bill_to')} AS own_key,
           CASE WHEN regexp_matches(bill_to, '[^\\x00-\\x7F]') THEN coalesce(dst, bill_to) END AS other
           FROM nm LEFT JOIN tr ON src = bill_to""",
    nu=f"SELECT *, {O.entity_key('other')} AS other_key FROM nt",
    nk="SELECT DISTINCT own_key AS key FROM nu UNION SELECT other_key FROM nu WHERE other IS NOT NULL",
    one="SELECT norm, min(ref_ord) AS ref_ord FROM ents GROUP BY norm", **_ALL_PAIRS,
    **O.token_sort_scores("pairs"), **_top1(lx.ENTITY_THRESHOLD, "ts"),
    ch="""SELECT nu.*, (o.method = 'no_match' AND other IS NOT NULL) AS translated FROM nu JOIN hit o ON o.key = own_key""") + """
SELECT bill_to, n_docs, matched, score, method, le, translated, CASE WHEN translated THEN other END AS translated_query
FROM ch JOIN hit h ON h.key = CASE WHEN translated THEN other_key ELSE own_key END LEFT JOIN ents USING (ref_ord)""")
def translate_retry(sql):
    docs = sql(_FOREIGN)
    found = match.match_entity(docs, "bill_to", reference.entity_reference(sql(P.ENTITIES)), sql(_FOREIGN_TR))
    return _counted(docs, "bill_to").join(found.withColumnRenamed("name", "bill_to"), "bill_to").select(
        "bill_to", "n_docs", "matched", "score", "method", "le", "translated", "translated_query")


# =================================================================== tags ====
_MAILS = """SELECT doc_id AS folder, concat(source, CASE doc_id % 6 WHEN 0 THEN ' Your Direct  Debit is due' WHEN 1 THEN ' DD payment'
    WHEN 2 THEN ' Mehrwertsteuer 19%' ELSE '' END) AS subject, text AS body FROM {documents}"""
_MAIL_DOCS = """SELECT p_partkey AS doc_id, p_partkey % (SELECT count(*) * 2 FROM {documents}) AS folder,
  concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Wireless' WHEN 1 THEN ' Broad' ELSE '' END) AS supplier_name,
  CASE p_partkey % 3 WHEN 0 THEN 'band Co' WHEN 1 THEN '電信' ELSE NULL END AS bill_to FROM {part}"""


def _any(x: str, terms) -> str:
    terms = sorted({t.lower() for t in terms})
    return f"len(list_filter({O.strings(terms)}, lambda term: contains({x}, term))) > 0"


@query(O.ctes(
    ml=P.ansi(_MAILS), dc=P.ansi(_MAIL_DOCS),
    j="""SELECT doc_id, trim(regexp_replace(lower(concat_ws(' ', supplier_name, bill_to, subject, body)), '\\s+', ' ', 'g'))
         AS t, trim(regexp_replace(lower(concat_ws(' ', subject, body)), '\\s+', ' ', 'g')) AS m
         FROM dc LEFT JOIN ml USING (folder)""") + f"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN {_any('t', lx.TELECOM_TERMS)} THEN 'TELECOM' END,
  CASE WHEN {_any('t', [x for g in lx.UTILITY_TERMS.values() for x in g])} THEN 'UTILITY' END,
  CASE WHEN contains(m, 'direct debit') THEN 'DD' END], lambda x: x IS NOT NULL), ',') AS tags FROM j""")
def tag_documents(sql):
    tagged = tagging.derive_tags(sql(_MAIL_DOCS), sql(_MAILS), "folder")
    return tagged.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(O.ctes(c="SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations") + f"""
SELECT conv_id, turn, {_any('t', lx.TELECOM_TERMS)} AS telecom,
  {_any('t', [x for g in lx.UTILITY_TERMS.values() for x in g])} AS utility, contains(t, 'direct debit') AS debit FROM c""")
def tag_messages(sql):
    return sql("SELECT conv_id, turn, text FROM {conversations}").select(
        "conv_id", "turn", tagging.is_telecom("text").alias("telecom"), tagging.is_utility("text").alias("utility"),
        tagging.is_direct_debit(F.lit(None).cast("string"), "text").alias("debit"))


# ============================================================ SQL functions ====
_PAIRED = """SELECT DISTINCT lower(concat(n_name, ' ', CAST(s_suppkey % 7 AS STRING), ' trading')) AS a,
  lower(concat('trade ', substring(n_name, 1, 6), ' ', CAST(s_suppkey % 5 AS STRING))) AS b
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query(O.ctes(two=P.ansi(_PAIRED), **O.ratio_scores("two"), **O.token_sort_scores("two"), **O.partial_scores("two"),
              **O.token_set_scores("two")) + """
SELECT a, b, round(rs.score, 6) AS ratio, round(ts.score, 6) AS token_sort, round(ps.score, 6) AS partial, round(tt.score, 6) AS token_set
FROM rs JOIN ts USING (a, b) JOIN ps USING (a, b) JOIN tt USING (a, b)""")
def sql_functions(sql):
    """The scores as functions of SQL."""
    fuzzy.register(sql.spark)
    return sql.spark.sql("""SELECT a, b, round(fuzzy_ratio(a, b), 6) AS ratio, round(fuzzy_token_sort(a, b), 6) AS token_sort,
      round(fuzzy_partial(a, b), 6) AS partial, round(fuzzy_token_set(a, b), 6) AS token_set FROM {two}""", two=sql(_PAIRED))


# ================================================================ routing ====
_SITES = """SELECT o_orderkey AS doc_id, CASE o_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN concat(' ', lower(n_name), ' ')
    WHEN 2 THEN concat(r_name, '/', n_name) WHEN 3 THEN concat('Site ', n_name, ' West') WHEN 4 THEN substring(n_name, 3, 5)
    ELSE CASE WHEN o_custkey % 12 = 5 THEN concat('nowhere ', c_mktsegment) ELSE '' END END AS source_site,
  CASE WHEN o_orderstatus = 'F' THEN '3500000001' END AS po
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey"""
_ROUTED = {
    **_ROUTE_IDX, "st": P.ansi(_SITES),
    "ks": "SELECT DISTINCT lower(trim(source_site)) AS k FROM st WHERE source_site <> ''",
    "fit": """SELECT k, coalesce(min(key_ord) FILTER (key = k),
                                 min(key_ord) FILTER (contains(k, key) OR contains(key, k))) AS key_ord
              FROM ks, idx GROUP BY k""",
    "routed": """SELECT st.*, idx.source_site_full AS routing_site, idx.key_ord IS NOT NULL AS routed,
                 CASE WHEN idx.key_ord IS NULL THEN NULL WHEN po IS NOT NULL THEN 'APPO' ELSE 'TIDEeCR' END AS invoice_type,
                 CASE WHEN po IS NOT NULL THEN appo ELSE tidecr END AS kofax_email
                 FROM st LEFT JOIN fit ON source_site <> '' AND k = lower(trim(source_site))
                 LEFT JOIN idx USING (key_ord)"""}


def _routed(sql) -> DataFrame:
    docs = sql(_SITES).withColumn("po_numbers", F.filter(F.array("po"), lambda p: p.isNotNull()))
    return routing.route(docs, reference.routing_index(sql(P.ROUTES)))


@query(O.ctes(**_ROUTED) + "SELECT doc_id, invoice_type, kofax_email, routing_site, routed FROM routed")
def route_invoices(sql):
    return _routed(sql).select("doc_id", "invoice_type", "kofax_email", "routing_site", "routed")


@query(O.ctes(
    **_ROUTED, fl="""SELECT *, doc_id % 50 = 0 AS no_main, doc_id % 7 = 0 AS no_bill, doc_id % 11 = 0 AS bad_pages,
                     doc_id % 5 = 0 AS no_le, doc_id % 3 = 0 AS vn FROM routed""") + """
SELECT doc_id, array_to_string(list_filter([
    CASE WHEN no_main THEN 'no_main_pages' END, CASE WHEN NOT no_main AND no_bill THEN 'bill_to_not_found' END,
    CASE WHEN bad_pages THEN 'signal_extraction_failed' END, CASE WHEN no_le THEN 'le_no_match' END,
    CASE WHEN NOT routed THEN 'routing_failed' END, CASE WHEN vn THEN 'vietnam_rename_failed' END],
    lambda x: x IS NOT NULL), ',') AS codes,
  no_main OR no_bill OR bad_pages OR no_le OR NOT routed OR vn AS needs_manual_review,
  CASE WHEN no_le THEN concat('No confident Legal Entity match for bill-to ',
    CASE WHEN no_bill THEN 'None' ELSE concat('"It''s ', doc_id, '"') END,
    ' -- closest match was None (score 12, threshold 80).') END AS le_message
FROM fl""")
def review_reasons(sql):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    runs = F.array(F.struct(F.lit(1).alias("lo"), F.lit(2).alias("hi")))
    docs = _routed(sql).select(
        "doc_id", "routed", "source_site", (k % 50 != 0).cast("int").alias("n_main"),
        (k % 11 == 0).cast("int").alias("n_unknown"), runs.alias("main_runs"), runs.alias("unknown_runs"),
        F.when(k % 7 != 0, F.concat(F.lit("It's "), k.cast("string"))).alias("bill_to"),
        (k % 5 != 0).alias("le_matched"), none.alias("le_matched_name"), F.lit(12).alias("le_score"),
        F.lit(lx.VN_ENTITY).alias("le"), F.when(k % 3 == 0, "missing").alias("vn_reason"))
    out = routing.review_reasons(docs)
    return out.select("doc_id", F.array_join(F.transform("review_reasons", lambda r: r["code"]), ",").alias("codes"),
                      "needs_manual_review", F.try_element_at(F.transform(
                          F.filter("review_reasons", lambda r: r["code"] == "le_no_match"),
                          lambda r: r["message"]), F.lit(1)).alias("le_message"))
