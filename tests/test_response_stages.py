"""The pages that responses are asked for are computed once for both kinds."""
from bundleflow.sources import responses


def test_pages_are_stored_for_both_kinds(spark):
    pages = spark.range(6).selectExpr("id % 3 AS pdf_id", "CAST(0 AS INT) AS page_idx")
    raw = spark.createDataFrame([(0, 0, '{"supplier_name_on_page": "a", "po_numbers": []}'), (1, 0, "`{` x")], "pdf_id long, page_idx int, raw_text string")
    signals, fields = responses.page_readings(pages, raw, raw)
    for df in (signals, fields):
        assert "Range (" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r["pdf_id"]: r["read_ok"] for r in df.collect()} == {0: True, 1: False, 2: False}
