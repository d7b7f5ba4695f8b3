"""The corpus pipeline: decisions of its stages on planted cases, and a whole run."""
import os
import random

import corpus_pipeline as pipe
from bundleflow.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"


def _row(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), 0.5, "r")


def test_stages_decide(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(60)
    clean = [(r["text"], r["lang"]) for r in source.orderBy("doc_id").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(1)
    fresh = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200))
    rows = [_row(i, t, k) for i, (t, k) in enumerate(clean)]
    rows += [_row(100, None), _row(101, "12 34"), _row(102, fresh), _row(103, fresh + " tail"), _row(103, fresh + " tail"),
             _row(104, clean[0][0] + " " + item), _row(105, "write to me@mail.example.org " + clean[1][0][::-1]), _row(102, fresh)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = pipe.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 100 not in ids and 101 not in ids and {0, 5, 104} <= set(ids)
    one = pipe.near_duplicates(spark, docs, SF)
    ids = sorted(r["doc_id"] for r in one.collect())
    assert ids.count(102) == 1 and 103 not in ids and one.columns == docs.columns
    left = pipe.decontaminate(spark, docs, SF)
    assert left.columns == docs.columns and 104 not in {r["doc_id"] for r in left.collect()}
    masked = {r["doc_id"]: r for r in pipe.mask_personal_data(spark, docs, SF).collect()}
    assert masked[105]["text"].startswith("write to <EMAIL> ") and masked[105]["n_chars"] == len(masked[105]["text"])
    assert masked[105]["row"] == "r"
    packed = pipe.pack(spark, docs, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_unlearned_scripts_and_junk_leave(spark):
    rng = random.Random(4)
    junk = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, "人人生而自由,在尊严和权利上一律平等。" * 9,
            "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=800)),
            '<div class="a"><span id="x">1</span><a href="http://x.y/z?q=1&r=2">k</a></div>\n' * 6,
            "static int foo(struct bar *p, size_t n) {\n\tfor (size_t i = 0; i < n; ++i) {\n\t\tp->x[i] = NULL;\n\t}\n}\n" * 3]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(junk)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in pipe.language_id(spark, both, SF).collect()}
    assert kept == {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}


def test_near_duplicates_decide_by_id_and_text(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(100)) for _ in range(4))
    # 7: one text joins an older group, the other is its own; 8: two unlike texts, one of them twice; one group without ids
    rows = [_row(1, a), _row(7, a + " tail"), _row(7, b), _row(8, c), _row(8, b[::-1]), _row(8, c), _row(None, d),
            _row(None, d), _row(None, d + " tail"), _row(9, ""), _row(9, ""), _row(None, ""), _row(None, b)]
    left = [(r["doc_id"], r["text"]) for r in pipe.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), SF).collect()]
    alone = [t for i, t in left if i is None and t]
    assert len(alone) == 1 and alone[0] in (d, d + " tail")
    assert sorted(x for x in left if x[0] is not None) == sorted([(1, a), (7, b), (8, c), (8, b[::-1]), (9, "")])


def test_whole_run(spark):
    out = queries.QUERIES["pipeline"](spark, SF)
    tokens = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert tokens and all(r[1] == r[2] for r in tokens)
    assert pipe.ORACLE_SQL is None and len(pipe.STAGES) == 5
