"""Mail files in deliveries: committed micro-batches, counts of stages, and equality with one batch run."""
import pytest
from pyspark.sql import functions as F

from bundleflow.operators import ingest
from bundleflow.sources import mail
from bundleflow.streaming import commit, inbox


def _eml(subject, names):
    parts = "".join(f'--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="{n}"\n'
                    f"Content-Transfer-Encoding: base64\n\nAAEC\n" for n in names)
    return (f"From: a@x.de\nSubject: {subject}\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"b\"\n\n"
            f"--b\nContent-Type: text/plain\n\nhello\n{parts}--b--\n").encode()


MAILS = {"m1.eml": ("one", ["a.pdf", "b c.pdf"]), "m2.EML": ("two", ["x.txt"]), "m3.eml": ("one", ["bad.zip", "a.pdf"]),
         "m4.eml": ("four", ["z.pdf"]), "m5.eml": ("two", ["inv.pdf", "inv.xlsx"])}


def _handle(new, batch_id, stages):
    parsed = stages.stored(mail.parse_eml(new), "parsed", failed=F.col("error").isNotNull())
    messages, attachments, members = mail.run_tables(parsed)
    box = ingest.ingest(messages, attachments, members)
    return {"bundles": stages.stored(box.bundles, "bundles"), "reasons": stages.stored(box.reasons, "reasons")}


def _rows(df):
    return sorted((r["pdf_id"].rpartition("/")[2], r["folder_ord"], r["pdf_ord"]) for r in df.collect())


@pytest.fixture()
def inbox_of(tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()

    def deliver(*names):
        for n in names:
            (box / n).write_bytes(_eml(*MAILS[n]))
        return str(box)
    return deliver


def _run(spark, path, store, checkpoint, handle=_handle, name="mails"):
    commit.run_committed(inbox.mail_stream(spark, path), store, checkpoint, handle, name).awaitTermination()


def test_mail_files_in_deliveries(spark, tmp_path, inbox_of):
    store = commit.BatchStore(str(tmp_path / "out"))
    assert store.commits(spark).isEmpty() and not store.is_committed(spark, 0)
    for names in (["m1.eml", "m2.EML"], ["m3.eml", "m4.eml", "m5.eml"]):
        _run(spark, inbox_of(*names), store, str(tmp_path / "cp"))
    counts = {r["batch"]: dict(r["counts"]) for r in store.commits(spark).collect()}
    assert counts == {
        0: {"parsed.rows": 2, "parsed.failed": 0, "bundles.rows": 2, "reasons.rows": 1},
        1: {"parsed.rows": 3, "parsed.failed": 0, "bundles.rows": 2, "reasons.rows": 1}}
    bundles = store.read(spark, "bundles")
    assert _rows(bundles.where("stream_batch = 0")) == [("a.pdf", 0, 1), ("b_c.pdf", 0, 2)]

    # the same mails in one batch: the same bundles in all, numbered through
    once = commit.BatchStore(str(tmp_path / "once"))
    _run(spark, inbox_of(), once, str(tmp_path / "cp2"), name="once")
    assert {x[0] for x in _rows(once.read(spark, "bundles"))} == {x[0] for x in _rows(bundles)}
    assert sum(r["counts"]["bundles.rows"] for r in once.commits(spark).collect()) == bundles.count()

    # a stream that lost its marks repeats its first micro-batch: nothing changes
    before = sorted(map(str, bundles.collect())), sorted(map(str, store.commits(spark).collect()))
    calls = []
    _run(spark, inbox_of(), store, str(tmp_path / "cp3"), lambda df, b, s: calls.append(b) or _handle(df, b, s), "again")
    assert calls == [] and before == (sorted(map(str, store.read(spark, "bundles").collect())), sorted(map(str, store.commits(spark).collect())))


def test_a_lost_attempt_is_never_read(spark, tmp_path):
    store = commit.BatchStore(str(tmp_path))
    rows = spark.range(3).withColumn("n", F.lit(1))
    store.commit(spark, 0, {"t": rows})
    rows.write.parquet(str(tmp_path / "t" / "stream_batch=1"))  # no commit row
    assert store.read(spark, "t").count() == 3
    assert commit.next_number(store, spark, "t", F.sum("n"), 1) is not None
    assert spark.range(1).select(commit.next_number(store, spark, "t", F.sum("n"), 1)).first()[0] == 4
    assert spark.range(1).select(commit.next_number(store, spark, "t", F.sum("n"), 0)).first()[0] == 1
    assert spark.range(1).select(commit.next_number(store, spark, "none", F.sum("n"), 5)).first()[0] == 1
    store.commit(spark, 1, {"t": rows.limit(1)})
    assert store.read(spark, "t").count() == 4


def test_stages_are_counted_while_they_run(spark):
    stages = commit.Stages()
    even = stages.stored(spark.range(10), "numbers", even=F.col("id") % 2 == 0)
    none = stages.stored(even.where("id > 100"), "none", any=F.col("id") > 0)
    assert even.count() == 10 and none.count() == 0
    assert stages.counts() == {"numbers.rows": 10, "numbers.even": 5, "none.rows": 0, "none.any": 0}


def test_broken_mails_hold_no_message(spark):
    rows = [("/in/a.eml", _eml("s", ["a.pdf"])), ("/in/b.eml", b"\xff\xfe"), ("/in/c.eml", b"")]
    parsed = mail.parse_eml(spark.createDataFrame(rows, "path string, content binary"))
    messages, attachments, members = mail.run_tables(parsed)
    assert [r["msg_ord"] for r in messages.orderBy("message_id").collect()] == [0, 1, 2]
    assert attachments.count() == 1 and members.count() == 0
