"""The room that stored stages and exchanges take on disk."""
import os
import time

import pytest
from pyspark.sql import functions as F

from bundleflow.operators import scale, segment
from bundleflow.plans import flow
from bundleflow.streaming.commit import Stages


def _size(folder):
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(folder) for f in files)


@pytest.fixture()
def kept(spark):
    with scale.run_stages(spark) as own:
        yield own.removeprefix("file:")


def test_a_stage_is_compressed_and_its_exchange_removed(spark, kept):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(200_000).select("id", F.concat(F.lit("Customer trading "), F.col("id") % 50).alias("name"))
    before = blocks.getAllBlocks().size()
    stage = scale.cut_lineage(rows.repartition(7, "id"))
    for _ in range(50):
        if blocks.getAllBlocks().size() <= before:
            break
        time.sleep(0.1)
    assert blocks.getAllBlocks().size() <= before
    assert _size(kept) < 4_000_000  # 12 MB of names and numbers
    assert stage.agg(F.count(F.lit(1)), F.sum("id"), F.count_distinct("name")).first()[:] == (200_000, 19999900000, 50)
    assert spark.conf.get(scale._REMOVE_SHUFFLES, "false") == "false"


@pytest.mark.parametrize("columns", [["id", "id"], ["content"], ["nothing"], ["files"]])
def test_stages_that_columns_do_not_hold(spark, columns):
    all_ = spark.range(3).select("id", F.lit(b"x").alias("content"), F.lit(None).alias("nothing"), F.array(F.struct(F.lit(b"x").alias("b"))).alias("files"))
    stage = scale.cut_lineage(all_.select(*columns))
    assert stage.columns == columns and stage.count() == 3


def test_what_is_stored_on_the_way_is_removed(spark, kept):
    def begin():
        first = scale.cut_lineage(spark.range(100))
        return 3, lambda i: scale.cut_lineage(scale.in_slice(first, "id", i, 3)).withColumn("part", F.lit(i))

    whole = scale.by_slices(spark, begin)
    assert len(os.listdir(kept)) == 1
    assert sorted(r["id"] for r in whole.collect()) == list(range(100)) and whole.select("part").distinct().count() == 3


def test_parts_of_a_stage_are_counted_together(spark):
    stages = Stages()
    for n in (4, 7):
        stages.observed(spark.range(n), "numbers", even=F.col("id") % 2 == 0).collect()
    assert stages.counts() == {"numbers.rows": 11, "numbers.even": 6}


def test_runs_of_pages_are_exchanged_before_they_stand_in_lists(spark):
    rows = [("a", i, 1, "main" if i < 5 else "support", i % 4 == 0) for i in range(9)]
    roles = spark.createDataFrame(rows, "pdf_id string, page_idx int, invoice_index int, role string, is_unknown boolean")
    plan = segment.page_runs(roles, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    for stored in (True, False):
        got = segment.page_runs(roles, stored=stored).first()
        assert [[tuple(x) for x in got[f"{k}_runs"]] for k in ("main", "support", "all", "unknown")] == [
            [(1, 5)], [(6, 9)], [(1, 9)], [(1, 1), (5, 5), (9, 9)]]


def _run(spark):
    entity = [(1, "LE1", "Acme Trading", "FRANCE", ""), (2, "LE763", "Beta Trading", "CHINA", ""), (3, "LE3", "Gamma Works", "Nowhere", "")]
    refs = flow.build_references(
        spark.createDataFrame([(1, "Listed Ltd")], "ord long, supplier_remit_to_name string"),
        spark.createDataFrame(entity, "ord long, le string, bill_to_name string, source_site string, country string"),
        spark.createDataFrame([(1, "100", "Vina Co", "."), (2, "200", "Listed Ltd", ".")], "ord long, supplier_id string, supplier_name string, alt_name string"),
        spark.createDataFrame([(1, "EUROPE/FRANCE", "a@f", "t@f"), (2, "ASIA/CHINA", "a@c", "t@c")], "ord long, source_site string, appo string, tidecr string"),
        spark.createDataFrame([], "src string, dst string"))
    ids = range(24)
    bundles = spark.createDataFrame(
        [(i, None if i == 20 else f"m{i % 5}", i % 5, i if i < 22 else 3, f"/in/{i}.pdf", "bad" if i == 9 else None) for i in ids],
        "pdf_id long, folder string, folder_ord long, pdf_ord long, source_file string, error string")
    supplier = ["Vina Co", "Listed Ltd", "Vina Ko", None]
    signals = spark.createDataFrame([(i, p, p != 4, supplier[i % 4], f"N{i % 3}-{p // 2}") for i in ids for p in range(5)],
                                    "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string")
    bill = ["Acme Trading", "Beta Tradng", "Gamma Works", "Stranger", None]
    fields = spark.createDataFrame([(i, p, True, bill[i % 5], ["PO#3500000001"] if i % 2 else []) for i in ids for p in range(5)],
                                   "pdf_id long, page_idx int, read_ok boolean, bill_to string, po_numbers array<string>")
    mails = spark.createDataFrame([("m0", "s", "direct debit", "x"), ("m1", "s", "b", "x"), ("m1", "t", "b", "x")],
                                  "folder string, subject string, body string, msg_path string")
    tables = flow.run_flow(signals, fields, bundles, mails, refs, "2026-09-10")
    return {t: sorted(map(str, tables[t].collect())) for t in ("invoices", "batches", "folders", "failures")}


def test_slices_give_the_rows_of_the_whole(spark, kept, monkeypatch):
    whole = _run(spark)
    assert len(os.listdir(kept)) <= 3  # documents, batches and what their numbers are counted from
    monkeypatch.setattr(flow, "SLICE_PAGES", 40)
    monkeypatch.setattr(flow, "SLICE_DOCUMENTS", 20)
    assert whole["invoices"] and whole["failures"] and _run(spark) == whole
