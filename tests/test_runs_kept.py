"""Written runs, mail records, stage folders, translators and term evidence."""
import os
import random

import pytest
from pyspark.sql import functions as F

from bundleflow.functions.automaton import Patterns, Suffixes
from bundleflow.operators import match, routing, scale, tagging, translate
from bundleflow.sources import files, sinks


def test_a_run_replaces_its_own_folder_only(spark, tmp_path):
    out = str(tmp_path / "reports")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "`Source Email` string, Total int")
    for fmt in ("parquet", "json", "csv"):
        at = f"{out}_{fmt}"
        sinks.write_run(spark, {"success": df, "other": df}, at, "run_1", fmt)
        sinks.write_run(spark, {"success": df.limit(1)}, at, "run_2", fmt)
        sinks.write_run(spark, {"success": df.where("Total = 2")}, at, "run_1", fmt)
        back = sinks.titled(sinks.read_run(spark, at, "success", "run_1", fmt), df.columns)
        assert [(r[0], int(r[1])) for r in back.collect()] == [("y", 2)]
        assert sinks.read_run(spark, at, "success", fmt=fmt).count() == 2
    listed = {(r["run"], r["table_name"]): r["n_rows"] for r in sinks.runs(spark, out + "_parquet").collect()}
    assert listed == {("run_1", "success"): 1, ("run_2", "success"): 1}


def test_records_keep_every_field(spark, tmp_path):
    mails = spark.createDataFrame([(1, "/in/1.eml", "m", "o", "Jo", "j@x", "s", "2026-09-09"), (2, "/in/2.eml", None, None, None, None, "t", None)],
                                  "message_id long, msg_path string, folder_name string, output_folder string, sender_name string, "
                                  "sender_email string, subject string, received_date string")
    inventory = spark.createDataFrame([(1, "", "pdf", "m/b.pdf"), (1, "g", "pdf", "m/g/a.pdf"), (1, "g", "excel", "m/g/a.xls"),
                                       (1, "", "other", "m/n.txt")], "message_id long, group_name string, kind string, path string")
    reasons = spark.createDataFrame([(2, "no PDF"), (2, "locked")], "message_id long, reason string")
    records = files.metadata_records(mails, inventory, reasons)
    path = str(tmp_path / "meta")
    for run in ("a", "b", "a"):
        files.write_metadata(records.withColumn("run", F.lit(run)), path)
    back = files.read_metadata(spark, path)
    assert back.count() == 4 and set(files.METADATA_FIELDS) <= set(back.columns)
    one, two = back.where("run = 'a'").orderBy("message_id").collect()
    assert one["attachments"].asDict() == {"pdfs": ["m/b.pdf", "m/g/a.pdf"], "excels": ["m/g/a.xls"], "xmls": [], "other": ["m/n.txt"]}
    assert one["groups"] == {"": ["m/b.pdf", "m/n.txt"], "g": ["m/g/a.pdf", "m/g/a.xls"]} and not one["blocked"]
    assert two["blocked"] and two["block_reasons"] == ["locked", "no PDF"] and one["sender_email"] == "j@x"


def test_stages_of_a_run_are_removed(spark, tmp_path):
    with scale.run_stages(spark) as own:
        local = own.removeprefix("file:")
        kept = scale.cut_lineage(spark.range(100))
        assert kept.count() == 100 and os.listdir(local)
    assert not os.path.exists(local)
    assert scale.cut_lineage(spark.range(5)).count() == 5  # later stages have a folder again


def test_each_name_is_sent_once(spark, tmp_path):
    sent = str(tmp_path / "sent")

    def stand_in(names):
        with open(sent, "a") as f:
            f.writelines(n + "\n" for n in names)
        return [None if n == "Ödland" else "Translation: " + n.replace("é", "e") for n in names]
    memo = translate.Memo(str(tmp_path / "memo"))
    one = spark.createDataFrame([("Café",), ("Café",), ("plain",), (None,), ("Ödland",)], "n string")
    two = spark.createDataFrame([("Café",), ("Née",)], "n string")
    first = {r["src"]: r["dst"] for r in translate.translate_new(one, "n", memo, "run_1", stand_in, size=2).collect()}
    second = {r["src"]: r["dst"] for r in translate.translate_new(two, "n", memo, "run_2", stand_in).collect()}
    assert first == {"Café": "Cafe", "Ödland": "Ödland"} and second == {"Café": "Cafe", "Née": "Nee"}
    assert sorted(open(sent).read().split()) == ["Café", "Née", "Ödland"]
    translate.translate_new(two, "n", memo, "run_2", stand_in)  # the run again: it replaces its own answers
    assert memo.read(spark).count() == 3
    with pytest.raises(Exception, match="answers to"):
        translate.translate_new(spark.createDataFrame([("ä",)], "n string"), "n", memo, "run_3", lambda names: [])


def test_only_misses_are_worth_a_translation(spark):
    ref = spark.createDataFrame([("cafe nord", "Cafe Nord", 0)], "norm string, original string, ref_ord long")
    names = spark.createDataFrame([("Café Nord",), ("Größe 12",), ("plain name",)], "n string")
    missed = translate.missed_names(match.match_sensitive(names, "n", ref))
    assert [r["name"] for r in missed.collect()] == ["Größe 12"]


def test_patterns_and_suffixes_against_plain_search():
    r = random.Random(3)
    words = ["".join(r.choices("abé", k=r.randint(1, 6))) for _ in range(120)]
    numbered = [(w, i) for i, w in enumerate(words)]
    least = {w: words.index(w) for w in words}
    patterns, suffixes = Patterns(numbered), Suffixes(numbered)
    for _ in range(200):
        t = "".join(r.choices("abéc", k=r.randint(0, 40)))
        want = {(a, a + len(w), n) for w, n in least.items() for a in range(len(t)) if t.startswith(w, a)}
        assert set(patterns.places(t)) == want
        x = t[:r.randint(0, 4)]
        assert suffixes.first_with(x) == min((i for w, i in numbered if x in w), default=None)
    assert list(Patterns([]).places("abc")) == [] and Suffixes([]).first_with("a") is None


@pytest.mark.parametrize("block", [1, 3, 20_000])
def test_sites_of_any_length_fit_keys_both_ways(spark, block):
    r = random.Random(9)
    keys = ["nord west", "a", "nord", "sued/ost", "x" * 300 + "zz", "ost"]
    index = spark.createDataFrame([(k, i, f"S{i}") for i, k in enumerate(keys)], "key string, key_ord long, source_site_full string")
    sites = ["nord", "the ost side", "ue", "q", "", "x" * 40 + "zz", "".join(r.choices("bcdefgh ", k=5000)) + "ost" + "".join(r.choices("bcdefgh ", k=5000))]
    got = {x["site_key"]: x["source_site_full"] for x in routing.match_sites(
        spark.createDataFrame([(s,) for s in sites], "site_key string"), index, block=block).collect()}
    want = {}
    for s in sites:
        fits = [i for i, k in enumerate(keys) if k == s] or [i for i, k in enumerate(keys) if k in s or s in k]
        if fits:
            want[s] = f"S{fits[0]}"
    assert got == want


@pytest.mark.parametrize("block", [3, 100_000])
def test_evidence_names_terms_and_places(spark, block):
    terms = [("A", "de", "strom"), ("A", "en", "strom"), ("B", "en", "aa"), ("B", "en", "power bill"), ("C", "x", "DD"), ("C", "x", ""),
             ("A", "de", "strom"), ("D", "fr", "é")]
    texts = [(1, "Der  STROM und der strom"), (2, "aaaa a"), (3, None), (4, ""), (5, "power\n bill É"), (None, "aa"), (2, "strom " * 3000)]
    found = tagging.evidence(spark.createDataFrame(texts, "k long, t string"), "k", "t",
                             spark.createDataFrame(terms, "tag string, language string, term string"), block=block)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(1, "A", "de", "strom", 4, 2), (1, "A", "en", "strom", 4, 2), (2, "B", "en", "aa", 0, 2), (5, "B", "en", "power bill", 0, 1),
                          (5, "D", "fr", "é", 11, 1), (None, "B", "en", "aa", 0, 1), (2, "A", "de", "strom", 0, 3000), (2, "A", "en", "strom", 0, 3000)], key=str)
    tags = {(r["k"], tuple(r["tags"])) for r in tagging.evident_tags(found, "k").collect()}
    assert (5, ("B", "D")) in tags and (2, ("A", "B")) in tags
