"""Folders with few numbers meet their texts in a join, the others are looked up."""
from bundleflow.operators import containment


def test_few_numbers_meet_texts_by_a_join(spark):
    texts = spark.createDataFrame([("f", 1, "S1", "inv12", ["12"]), ("f", 2, "S2", "d7", []), ("g", 1, "S1", "", [])],
                                  "folder string, sheet_idx int, sheet_name string, norm string, runs array<string>")
    numbers = spark.createDataFrame([("f", "12", None), ("f", None, "xd726"), ("g", None, "ab")], "folder string, digits string, norm string")
    found = containment.hits(texts, numbers)
    want = [("f", 1, "S1", "12", None), ("f", 2, "S2", None, "xd726"), ("g", 1, "S1", None, "ab")]
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert "FlatMapCoGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, containment.hits(texts, numbers, at_once=1).collect()), key=str) == want  # f has two texts
