"""Bucketed references and pages: joins without an exchange on their side, nothing built twice."""
import re

import pytest
from pyspark.sql import functions as F

from bundleflow.operators import match, segment
from bundleflow.plans import flow
from bundleflow.plans.reference_store import BucketedTables, load_pages, save_pages, stored_references


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _refs(spark):
    entities = [(i, f"LE{i % 7}", f"Name {i} Trading / Other {i}", f"site {i % 5}", "x") for i in range(60)]
    return flow.build_references(
        spark.createDataFrame([(i, f"Sensitive {i} Ltd") for i in range(40)], "ord int, supplier_remit_to_name string"),
        spark.createDataFrame(entities, "ord int, le string, bill_to_name string, source_site string, country string"),
        spark.createDataFrame([(1, "77", "Công ty Điện", "Power")], "ord int, supplier_id string, supplier_name string, alt_name string"),
        spark.createDataFrame([(i, f"r/site {i}", f"a{i}@x", f"t{i}@x") for i in range(5)], "ord int, source_site string, appo string, tidecr string"),
        spark.createDataFrame([("Điện", "Power")], "src string, dst string"))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_references_are_built_once_and_joined_in_place(spark, tmp_path, no_broadcast):
    tables = BucketedTables(spark, str(tmp_path), "refs_a", 4)
    first = stored_references(tables, lambda: _refs(spark))

    def never():
        raise AssertionError("built again")
    again = stored_references(BucketedTables(spark, str(tmp_path), "refs_a", 4), never)
    # a session without the catalog's entries finds the files
    other = stored_references(BucketedTables(spark, str(tmp_path), "refs_b", 4), never)
    for t in ("sensitive", "entities", "vn", "routing", "translations"):
        rows = sorted(map(str, getattr(_refs(spark), t).collect()))
        assert rows == sorted(map(str, getattr(first, t).collect())) == sorted(map(str, getattr(again, t).collect()))
        assert rows == sorted(map(str, getattr(other, t).collect()))
    # one entry per key: no exchange; with names: an exchange of the names only
    per_key = other.entities.groupBy("norm").agg(F.min("ref_ord"))
    assert "Exchange" not in _plan(per_key)
    names = spark.createDataFrame([("name 3 trading",), ("other 8",), ("nobody",)], "key string")
    joined = names.join(other.entities, F.col("key") == F.col("norm"))
    assert _plan(joined).count("Exchange hashpartitioning") == 1
    found = {r["name"]: r["le"] for r in match.match_entity(
        spark.createDataFrame([("Name 3 Trading",), ("Other 8",)], "n string"), "n", other.entities).collect()}
    assert found == {"Name 3 Trading": "LE3", "Other 8": "LE1"}


def test_stored_pages_are_segmented_in_place(spark, tmp_path, no_broadcast):
    pages = spark.createDataFrame([(d, p, True, f"s{d % 3}", f"{p // 2}") for d in range(50) for p in range(6)],
                                  "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string")
    data = spark.createDataFrame([(d, 0, True, "b", ["3500000001"]) for d in range(50)],
                                 "pdf_id long, page_idx int, read_ok boolean, bill_to string, po_numbers array<string>")
    tables = BucketedTables(spark, str(tmp_path), "pages_a", 4)
    assert load_pages(tables) == (None, None)
    save_pages(tables, pages, data)
    signals, fields = load_pages(BucketedTables(spark, str(tmp_path), "pages_b", 4))
    keyed = segment.with_key_supplier(segment.clean_signals(signals), blocks=False)
    roles = segment.segment_pages(keyed.withColumn("supplier_ok", F.col("supplier_name_on_page") == F.col("key_supplier")), blocks=False)
    plan = _plan(roles)
    assert "Exchange" not in plan and len(re.findall(r"\bSort \[", plan)) <= 1
    assert "Exchange" not in _plan(signals.join(fields.withColumnRenamed("page_idx", "_at"), "pdf_id"))
    assert roles.count() == 300
