"""Inputs of the engine derived from the driver's tables.

Each projection is one SQL text that Spark and DuckDB both run; table names stand in
braces.  Nothing is sampled: every projection reads its whole tables.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# One page per (order, line number); the aggregation makes page numbers unique.
SIGNALS = """
SELECT b.pdf_id, b.page_idx, b.read_ok,
  CASE WHEN b.read_ok THEN concat(p.p_name, CASE WHEN b.flag = 1 THEN ' GmbH' ELSE ' Ltd' END)
  END AS supplier_name_on_page,
  CASE WHEN b.read_ok AND b.tax <= 0.065
       THEN concat('INV-', CAST(b.pdf_id AS STRING), '/', CAST(b.page_idx % 3 AS STRING)) END AS invoice_number
FROM (SELECT *, CASE WHEN flag = 1 THEN part_key ELSE pdf_id % (SELECT count(*) FROM {part}) END AS name_key
      FROM (SELECT l_orderkey AS pdf_id, CAST(l_linenumber - 1 AS INT) AS page_idx,
                   max(l_discount) <= 0.095 AS read_ok, max(l_tax) AS tax, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flag,
                   min(l_partkey) AS part_key
            FROM {lineitem} GROUP BY l_orderkey, l_linenumber) g) b
JOIN {part} p ON p.p_partkey = b.name_key
"""

# Candidate order numbers as text; some are no purchase orders.
FIELDS = """
SELECT l_orderkey AS pdf_id, CAST(l_linenumber - 1 AS INT) AS page_idx, min(l_discount) <= 0.095 AS read_ok,
  CASE WHEN max(l_quantity) > 40 THEN concat('Customer ', CAST(min(l_suppkey) AS STRING), ' Trading')
       WHEN max(l_quantity) > 38 THEN 'N/A' END AS bill_to,
  CASE WHEN max(l_tax) > 0.05 THEN concat('PO#', CAST(3500000000 + min(l_partkey) AS STRING), ', ',
       CAST(4501000000 + l_orderkey % 7 AS STRING), ' / ', CAST(1234567890 + l_linenumber AS STRING)) END AS po_text
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

ENTITIES = """
SELECT CAST(n_nationkey AS INT) AS ord, concat('LE', CAST(100 + n_nationkey AS STRING)) AS le,
  concat(n_name, ' Trading Ltd / ', n_name, ' Handel GmbH') AS bill_to_name,
  n_name AS source_site, r_name AS country
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

ROUTES = """
SELECT CAST(n_nationkey AS INT) AS ord, concat(r_name, '/', n_name) AS source_site,
  concat('appo.', lower(n_name), '@example.com') AS appo,
  concat('tide.', lower(n_name), '@example.com') AS tidecr
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# One name per part: several spellings, accents, legal forms.
NAMES = """
SELECT p_partkey AS ord,
  concat(CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é')
                            WHEN 2 THEN replace(p_name, 'o', 'ö') ELSE p_name END,
         CASE p_partkey % 9 WHEN 0 THEN ' Corp.' WHEN 1 THEN ' & Co. GmbH' WHEN 2 THEN ' Tech  Svcs, Ltd'
                            WHEN 3 THEN ' S.A.' WHEN 4 THEN ' Intl. (Pvt) Ltd.' WHEN 5 THEN ' R&D K.K.'
                            WHEN 6 THEN ' Mfg z.o.o.' WHEN 7 THEN ' Đông STI' ELSE '' END,
         CASE WHEN p_partkey % 11 = 0 THEN '+B33' ELSE '' END) AS name
FROM {part}
"""

# Bill-to spellings of orders: long form, capitals, a dropped letter, the alias, a stranger.
BILL_TO = """
SELECT o_orderkey AS doc_id, o_custkey,
  CASE o_custkey % 5 WHEN 0 THEN concat(n_name, ' Trading Limited') WHEN 1 THEN concat(n_name, ' TRADING  LTD.')
    WHEN 2 THEN concat(n_name, ' Tradng Ltd') WHEN 3 THEN concat(n_name, ' handel gmbh')
    ELSE concat(c_mktsegment, ' Works ', CAST(c_nationkey AS STRING)) END AS bill_to
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

# Documents with everything the batch stage reads; a source mail is a customer.
DOCS = """
SELECT o_orderkey AS doc_id, CAST(o_custkey AS BIGINT) AS folder_ord,
  concat('mail_', CAST(o_custkey AS STRING)) AS folder,
  concat('/in/mail_', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING), '.pdf') AS source_file,
  concat('/out/mail_', CAST(o_custkey AS STRING), '/doc_', CAST(o_orderkey AS STRING), '.pdf') AS output_pdf,
  concat('INV', CAST(o_orderkey AS STRING)) AS invoice_number, c_mktsegment AS supplier_name,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('LE', CAST(100 + o_orderkey % 3 AS STRING)) END AS le,
  concat(CASE WHEN o_orderstatus = 'F' THEN 'appo.' ELSE 'tide.' END, lower(n_name), '@example.com') AS kofax_email,
  o_orderpriority = '1-URGENT' AS is_telecom, o_orderpriority = '2-HIGH' AS is_debit,
  o_totalprice BETWEEN 100000 AND 140000 AS is_sensitive,
  o_totalprice > 485000 AS needs_manual_review, o_totalprice > 492000 AS no_site
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE o_totalprice >= 6000
"""

ERRORS = """
SELECT concat('mail_', CAST(o_custkey AS STRING)) AS folder, CAST(o_custkey AS BIGINT) AS folder_ord,
  concat('/in/mail_', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING), '.pdf') AS source_file,
  concat('cannot read file of ', CAST(o_orderkey AS STRING)) AS error
FROM {orders} WHERE o_totalprice < 6000
"""

# Attachments: one per order, of a message per customer.
ATTACHMENTS = """
SELECT o_custkey AS message_id, CAST(o_orderkey AS BIGINT) AS att_ord,
  CASE WHEN o_orderkey % 29 = 0 THEN 'image001.PNG'
       ELSE concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Invoice ' ELSE 'INVOICE_' END,
                   CAST(o_orderkey % 4 AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN '-details' ELSE '' END,
                   CASE o_orderkey % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.xml'
                                       WHEN 4 THEN '.pdf' WHEN 5 THEN '.xls' ELSE '.txt' END) END AS file_name,
  CASE WHEN o_orderkey % 13 = 0 THEN concat('batch/', CAST(o_orderkey % 2 AS STRING)) ELSE '' END AS rel_dir,
  o_totalprice > 20000 AS is_binary, o_totalprice > 499000 AS is_locked,
  CASE WHEN o_totalprice BETWEEN 300000 AND 301000 THEN 'unreadable or corrupt zip: a.zip' END AS block_reason
FROM {orders}
"""

# A file listing: mail folders of customers with their files, some deeper.
FILES = """
SELECT concat('mail_', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '/deep' ELSE '' END,
              '/', CASE WHEN o_orderkey % 17 = 0 THEN '~$' ELSE '' END, 'f', CAST(o_orderkey AS STRING),
              CASE o_orderkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.xls'
                                  WHEN 4 THEN '.docx' ELSE '' END) AS path
FROM {orders}
"""

# Spreadsheet cells: line items of an order, beside the order's document.
CELLS = """
SELECT concat('f', CAST(l_orderkey AS STRING)) AS folder,
  concat('f', CAST(l_orderkey AS STRING), '/book.xlsx') AS workbook, l_linenumber AS sheet_idx,
  concat('Sheet', CAST(l_linenumber AS STRING)) AS sheet_name,
  CASE WHEN l_partkey % 6 = 0 THEN concat('INV ', CAST(l_orderkey AS STRING), ' of 01/05/2024')
       WHEN l_partkey % 6 = 1 THEN concat('Ref d', CAST(l_orderkey AS STRING), '/26 ok')
       WHEN l_partkey % 6 = 2 THEN concat('0000', CAST(l_orderkey AS STRING))
       WHEN l_partkey % 6 = 3 THEN ' '
       WHEN l_partkey % 6 = 4 THEN CASE WHEN l_quantity > 40 THEN '--' ELSE 'total' END
       ELSE CAST(l_partkey AS STRING) END AS value
FROM {lineitem}
"""

TARGETS = """
SELECT o_orderkey AS pdf_id, concat('f', CAST(o_orderkey AS STRING)) AS folder,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('00-', CAST(o_orderkey AS STRING))
       ELSE concat('D', CAST(o_orderkey AS STRING), '/26') END AS invoice_number
FROM {orders}
"""

WORKBOOKS = """
SELECT DISTINCT concat('f', CAST(l_orderkey AS STRING)) AS folder,
  concat('f', CAST(l_orderkey AS STRING), CASE WHEN l_orderkey % 10 = 0 AND l_tax > 0.04 THEN '/extra.xlsx'
                                               WHEN l_tax > 0.07 THEN '/~$book.xlsx' ELSE '/book.xlsx' END) AS workbook
FROM {lineitem}
"""

# Vietnamese supplier list: accents, artifacts, junk alternates.
VN = """
SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(1000000000 + p_partkey % 1500 AS STRING) AS supplier_id,
  concat(CASE WHEN p_partkey % 4 = 0 THEN replace(replace(p_name, 'a', 'á'), 'd', 'đ') ELSE p_name END,
         CASE p_partkey % 3 WHEN 0 THEN ' Co., Ltd' WHEN 1 THEN ' JSC' ELSE '  Corp' END,
         ' ', CAST(p_partkey % 200 AS STRING), CASE WHEN p_partkey % 10 = 0 THEN '+B33' ELSE '' END) AS supplier_name,
  CASE p_partkey % 6 WHEN 0 THEN '.' WHEN 1 THEN NULL WHEN 2 THEN 'ab'
       WHEN 3 THEN concat('Công ty ', p_name, ' ', CAST(p_partkey % 200 AS STRING))
       ELSE concat(p_name, ' Viet Nam ', CAST(p_partkey % 200 AS STRING)) END AS alt_name
FROM {part}
"""

# Translations of the accented names above (every second one is known).
VN_TRANSLATIONS = """
SELECT DISTINCT concat(replace(replace(p_name, 'a', 'á'), 'd', 'đ'),
         CASE p_partkey % 3 WHEN 0 THEN ' Co., Ltd' WHEN 1 THEN ' JSC' ELSE ' Corp' END,
         ' ', CAST(p_partkey % 200 AS STRING)) AS src,
  concat(p_name, ' Company ', CAST(p_partkey % 200 AS STRING)) AS dst
FROM {part} WHERE p_partkey % 8 = 0
"""

RUNS = """
SELECT CAST(ts AS DATE) AS run_date,
  concat(CASE WHEN event_type = 'error' THEN 'tmp_' ELSE 'run_' END, substring(CAST(ts AS STRING), 12, 2), '-',
         substring(CAST(ts AS STRING), 15, 2), '-', substring(CAST(ts AS STRING), 18, 2)) AS run_name
FROM {events}
"""


def tables_in(sql: str) -> set[str]:
    return {field for _, field, _, _ in string.Formatter().parse(sql) if field}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a projection on the parquet tables of a folder."""
    frames = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables_in(sql)}
    return spark.sql(sql, **frames)


def ansi(sql: str) -> str:
    """The same text for an engine where the tables are views."""
    return sql.format(**{t: t for t in tables_in(sql)})
