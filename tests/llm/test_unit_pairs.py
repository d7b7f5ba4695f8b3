import numpy as np
from pyspark.sql import functions as F

from bundleflow.llm import ngram_join


def test_only_the_smaller_of_two_units_is_tested(spark):
    """A token of one unit of 300 classes and of 30 single ones: the large unit's classes meet no other unit."""
    units = spark.createDataFrame([(i, 1, i, i if i < 30 else 1000) for i in range(330)],
                                  "sid long, n long, comp long, unit long")
    shared = units.select(F.lit(7).cast("long").alias("token"), "sid")
    reached = ngram_join.reach(shared, units)
    got = {tuple(r) for r in reached.collect()}
    assert got == ({(i, i, 1000) for i in range(30)} | {(i, i, j) for i in range(30) for j in range(i + 1, 30)})

    roles = ngram_join.roles_of(reached, units).where("not is_query").select("sid").distinct()
    assert {r["sid"] for r in roles.collect()} == set(range(1, 330))


def test_a_token_of_two_documents_in_each_task_is_frequent(spark):
    rows = [(i, f"a common line of words own{i} other{i} third{i} more{i} last{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(32, "doc_id")
    rank = ngram_join._ranks(ngram_join._survey(docs, "text", "doc_id"))
    assert np.count_nonzero(rank) == 1
