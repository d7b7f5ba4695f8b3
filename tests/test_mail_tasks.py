"""Mails that lie in one split are parsed by many tasks."""
from pyspark.sql import functions as F

from bundleflow.sources import mail


def test_one_split_is_parsed_by_many_tasks(spark):
    rows = [(f"/in/{i}.eml" if i else None, b"Subject: s%d\n\nhello" % i) for i in range(200)]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    parsed = mail.parse_eml(files)
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sorted(r["subject"] for r in parsed.collect()) == sorted(f"s{i}" for i in range(200))
