import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bundleflow.plans import flow
from bundleflow.operators import batching, reports
from bundleflow.sources import archives, files, mail, responses, sheets
from bundleflow.streaming import inbox


@pytest.fixture()
def tree(tmp_path):
    for p in ["m1/a.pdf", "m1/b.PDF", "m1/c.xlsx", "m1/~$c.xlsx", "m1/n/d.pdf", "m2/e.docx", "m3/n/f.pdf", "top.pdf", "x.eml", "y.MSG"]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    return str(tmp_path)


def test_folder_inventory(spark, tree):
    listed = files.list_files(spark, tree)
    assert {r["folder"]: (r["pdfs"], r["excels"], r["others"]) for r in files.folder_inventory(listed).collect()} == {"m1": (2, 1, 0)}
    assert {r["folder"]: r["pdfs"] for r in files.folder_inventory(listed, recursive=True).collect()} == {"m1": 3, "m3": 1}
    every = files.folder_inventory(listed, keep_empty=True)
    assert list(files.inventory_totals(every).first()) == [2, 1, 2]
    assert {r["path"] for r in files.mail_files(listed).collect()} == {"x.eml", "y.MSG"}


def test_root_is_the_only_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    got = files.folder_inventory(files.list_files(spark, str(tmp_path)), "box").first()
    assert (got["folder"], got["pdfs"]) == ("box", 1)


def test_metadata_comes_from_own_or_parent_folder(spark, tmp_path):
    for d, subject, body in [("m1", "one", "hello"), ("m2", "two", None)]:
        (tmp_path / d / "g").mkdir(parents=True)
        (tmp_path / d / "email_metadata.json").write_text('{\n "subject": "%s",\n "msg_path": "/in/%s.eml"\n}' % (subject, d))
        if body:
            (tmp_path / d / "email_body.txt").write_text(body)
    root = str(tmp_path)
    docs = spark.createDataFrame([(f"{root}/m1/a.pdf",), (f"{root}/m1/g/b.pdf",), (f"{root}/m2/g/c.pdf",), ("/else/d.pdf",)], "path string")
    got = {r["path"].replace(root, ""): (r["subject"], r["body"]) for r in files.with_metadata(docs, files.load_metadata(spark, root)).collect()}
    assert got == {"/m1/a.pdf": ("one", "hello"), "/m1/g/b.pdf": ("one", "hello"), "/m2/g/c.pdf": ("two", ""), "/else/d.pdf": (None, None)}


EML = (b'From: "Jo X" <jo@x.de>\r\nSubject: =?utf-8?q?R=C3=A9=3A_a?=\r\nDate: Wed, 09 Sep 2026 10:30:00 +0000\r\nMIME-Version: 1.0\r\n'
       b'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain; charset=latin-1\r\n\r\nGr\xfc\xdfe\r\n'
       b'--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="in v.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n'
       b'--b\r\nContent-Type: image/png\r\nContent-Disposition: inline; filename="logo.png"\r\n\r\nx\r\n--b--\r\n')


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "b.EML").write_bytes(b"Subject: plain\n\nbody\n")
    (tmp_path / "c.txt").write_bytes(b"no mail")
    parsed = mail.parse_eml(mail.read_mail_files(spark, str(tmp_path)))
    got = {r["file_name"]: r for r in parsed.collect()}
    assert set(got) == {"a.eml", "b.EML"}
    a = got["a.eml"]
    assert (a["subject"], a["body"].strip(), a["sender_email"], a["received_raw"], a["error"]) == (
        "Ré: a", "Grüße", "jo@x.de", "2026-09-09T10:30:00+00:00", None)
    assert got["b.EML"]["body"] == "body\n" and got["b.EML"]["folder_stem"] == "plain"
    files_ = mail.attachments(parsed).collect()
    assert [(f["clean_name"], bytes(f["content"])) for f in files_] == [("in_v.pdf", b"\x00\x01\x02")]


def _zip(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for n, d in members:
            zf.writestr(n, d)
    return buf.getvalue()


def test_archives(spark):
    deep = _zip([("x.pdf", b"1")])
    for _ in range(3):
        deep = _zip([("in.zip", deep)])
    locked = bytearray(_zip([("a.pdf", b"1")]))
    locked[6] |= 1
    at = locked.find(b"PK\x01\x02")
    locked[at + 8] |= 1
    data = [("ok", "a.zip", _zip([("d 1/e/f.pdf", b"1"), ("image001.png", b"2"), ("n.zip", _zip([("g.xml", b"3")]))])),
            ("deep", "a.zip", deep), ("bad", "a.zip", b"zz"), ("locked", "a.zip", bytes(locked)),
            ("risky", "a.ZIP", _zip([("../x.pdf", b"1"), ("/abs/y.pdf", b"2")])), ("skip", "a.pdf", b"1")]
    df = spark.createDataFrame([(m, 1, n, c) for m, n, c in data], "message_id string, att_ord int, file_name string, content binary")
    rows = {}
    for r in archives.expand_zip(df).collect():
        rows.setdefault(r["message_id"], []).append((r["reason"], r["rel_dir"], r["file_name"], r["depth"], r["unsafe"]))
    assert rows["ok"] == [(None, "d_1/e", "f.pdf", 0, False), (None, "", "g.xml", 1, False)]
    assert rows["deep"] == [("zip nested deeper than 3 levels: in.zip", "", None, 3, False)]
    assert rows["bad"][0][0] == "unreadable or corrupt zip: a.zip"
    assert rows["locked"][0][0] == "password-protected zip: a.zip"
    assert {r[2] for r in rows["risky"] if r[2]} == {"x.pdf", "y.pdf"} and all(r[4] for r in rows["risky"])
    assert "skip" not in rows


def test_model_responses(spark):
    cases = [('{"supplier_name_on_page": "A", "invoice_number": 12}', (True, "A", "12")),
             ('<think>{"supplier_name_on_page": "no"}</think>```json\n{"supplier_name_on_page": "B", "invoice_number": "NULL"}\n```', (True, "B", None)),
             ('{"supplier_name_on_page": "A"} {"z": 1}', (True, "A", None)), ('{"z": {"q": 1}}', (True, None, None)),
             ('{"supplier_name_on_page": 3}', (False, None, None)), ("{bad}", (False, None, None)), (None, (False, None, None)),
             ('{"supplier_name_on_page": "A", "invoice_number": 1.5}', (False, None, None))]
    df = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(cases)], "pdf_id long, page_idx int, raw_text string")
    got = {r["pdf_id"]: (r["read_ok"], r["supplier_name_on_page"], r["invoice_number"]) for r in responses.parse_signals(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_pages_without_response_fail(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "pdf_id long, page_idx int")
    signals = spark.createDataFrame([(1, 0, '{"supplier_name_on_page": "A"}')], "pdf_id long, page_idx int, raw_text string")
    data = spark.createDataFrame([(1, 1, '{"po_numbers": ["3500000001"]}'), (9, 9, "{}")], signals.schema)
    read, found = responses.page_readings(pages, signals, data)
    assert sorted((r[0], r[1], r["read_ok"], r["supplier_name_on_page"]) for r in read.collect()) == [
        (1, 0, True, "A"), (1, 1, False, None), (2, 0, False, None)]
    assert sorted((r[0], r[1], r["read_ok"], r["po_numbers"]) for r in found.collect()) == [
        (1, 0, False, None), (1, 1, True, ["3500000001"]), (2, 0, False, None)]
    empty = pages.where("false")
    assert all(t.count() == 0 for t in responses.page_readings(empty, signals, data))


def test_columns_are_found_by_title(spark):
    df = spark.createDataFrame([(0, "LE1", "Acme", "Paris", "FR")], ["ord", " Legal Entity (LE)", "Bill to Name", "Source  Site", "Country"])
    assert sheets.resolve_columns(df, sheets.ENTITY_COLUMNS, keep=("ord",)).columns == ["ord", "le", "bill_to_name", "source_site", "country"]
    with pytest.raises(ValueError, match="appo"):
        sheets.resolve_columns(df, {"appo": lambda c: "appo" in c.lower()})
    vn = spark.createDataFrame([(0, "1", "A", "B")], ["ord", "Supplier ID", "Supplier Name", "Other"])
    assert sheets.vn_sheet(vn, "ord").first()["alt_name"] == "B"


# -------------------------------------------------------------------- stream --
DOCS = "folder string, folder_ord long, kofax_email string, le string, tags array<string>, is_sensitive boolean"


def test_batch_numbers_continue_through_the_day(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    counter = inbox.DayCounter(out)

    def handle(new, batch_id):
        batches = batching.assign_batches(new, "2026-09-10", counter.start(new.sparkSession, "2026-09-10", batch_id))
        counter.record(batches, "2026-09-10", batch_id)
        return {"batches": batches}

    def deliver(folder, n):
        spark.createDataFrame([(f"m{folder}", folder, "a@x", "LE1", [], False)] * n, DOCS).coalesce(1).write.mode("append").parquet(src)
        inbox.run_inbox(inbox.file_stream(spark, src, DOCS), out, ck, handle).awaitTermination()

    for folder, n in [(1, 3), (2, 2), (3, 1)]:
        deliver(folder, n)
    rows = sorted((r["source_email"], r["batch_id"]) for r in inbox.read_table(spark, out, "batches").collect())
    assert rows == [("m1", "LE1.GH01"), ("m2", "LE1.GH04"), ("m3", "LE1.GH06")]
    # repeating the second run replaces its own rows and keeps its numbers
    again = spark.createDataFrame([("m2", 2, "a@x", "LE1", [], False)] * 2, DOCS)
    redo = handle(again, 1)["batches"]
    assert [r["batch_id"] for r in redo.collect()] == ["LE1.GH04"]
    assert spark.read.parquet(f"{out}/_day_counter").agg(F.sum("invoices")).first()[0] == 6


# ----------------------------------------------------------------- whole run --
def test_whole_run(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)
    signals = df([(1, 0, True, "Acme Co", "A1"), (1, 1, True, "Acme Co", "A2"), (2, 0, True, "Beta", "B1"), (3, 0, False, None, None),
                  (4, 0, True, "Công ty Điện", "V1"), (5, 0, True, "Acme Co", "A1"), (6, 0, True, "Công ty Điện", "V2")],
                 "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string")
    fields = df([(1, 0, True, "Buyer Ltd", ["3500000001"]), (1, 1, True, "Buyer Limited", []), (2, 0, True, "Byer Ltd", []),
                 (3, 0, False, None, None), (4, 0, True, "Viet Buyer", ["PO 4500000001"]), (5, 0, True, "Stranger", []),
                 (6, 0, True, "Viet Buyer", ["PO 3500000009"])],
                "pdf_id long, page_idx int, read_ok boolean, bill_to string, po_numbers array<string>")
    bundles = df([(1, "m1", 1, 1, "/in/1.pdf", None), (2, "m2", 2, 1, "/in/2.pdf", None), (3, "m3", 3, 1, "/in/3.pdf", None),
                  (4, "m4", 4, 1, "/in/4.pdf", None), (5, "m1b", 5, 1, "/in/5.pdf", None), (7, "m2", 2, 2, "/in/7.pdf", None),
                  (8, "m8", 8, 1, "/in/8.pdf", "boom"), (6, "m6", 6, 1, "/in/6.pdf", None)],
                 "pdf_id long, folder string, folder_ord long, pdf_ord long, source_file string, error string")
    mails = df([("m1", "Mobile bill", "Direct debit", "/inbox/1.eml"), ("m8", "", "", "/inbox/8.eml")],
               "folder string, subject string, body string, msg_path string")
    tr = df([("Công ty Điện", "Electric Company")], "src string, dst string")
    refs = flow.build_references(
        df([(0, "Acme Company")], "ord int, supplier_remit_to_name string"),
        df([(0, "LE100", "Buyer Ltd", "Paris", "FR"), (1, "LE763", "Viet Buyer", "Hanoi", "VN")],
           "ord int, le string, bill_to_name string, source_site string, country string"),
        df([(0, "77", "Công ty Điện", None)], "ord int, supplier_id string, supplier_name string, alt_name string"),
        df([(0, "FR/Paris", "appo@x", "tide@x"), (1, "VN/Hanoi", "appo@v", "tide@v")],
           "ord int, source_site string, appo string, tidecr string"), tr)
    t = flow.run_flow(signals, fields, bundles, mails, refs, "2026-09-10")
    report = {(r["Folder"], r["Invoice #"]): r for r in t["invoice_report"].collect()}
    assert len(report) == 7
    a1 = report[("m1", "A1")]
    assert (a1["Is Sensitive"], a1["LE"], a1["Invoice Type"], a1["Kofax Email"], a1["PO Number(s)"], a1["Output File"]) == (
        True, "LE100", "APPO", "appo@x", "3500000001", "Acme_Co_A1.pdf")
    assert report[("m1", "A2")]["Kofax Email"] == "tide@x"
    assert report[("m4", "V1")]["Review Reasons"] == "LE763 invoice, but file rename failed: missing required field(s): po_number."
    v2 = report[("m6", "V2")]
    assert (v2["Vietnam Supplier ID"], v2["Vietnam Renamed"], v2["Output File"]) == ("77", True, "ESD77 PO3500000009 INVV2.pdf")
    assert "checked page(s) [1]" in report[("m3", "")]["Review Reasons"]
    stranger = report[("m1b", "A1")]
    assert stranger["Review Reasons"].startswith("No confident Legal Entity match for bill-to 'Stranger' -- closest match was ")
    batches = [(r["batch_id"], r["source_email"]) for r in t["batches"].orderBy("counter").collect()]
    assert batches == [("LE100.GH01-TELCO-DD-SENSITIVE", "m1"), ("LE100.GH02-TELCO-DD-SENSITIVE", "m1"), ("LE100.GH03", "m2"), ("LE763.GH04", "m6")]
    assert {r["Source Email"]: r["Email Name"] for r in t["success"].collect()}["m1"] == ",".join(b for b, f in batches if f == "m1")
    fails = {(r["Source Email"], r["Failure Reason"]) for r in t["failures"].collect()}
    assert ("m8", "pdf_processing_error: boom") in fails and ("m3", "bill_to_not_found") in fails and ("m4", "vietnam_rename_failed") in fails
    sent = t["batches"].select("batch_id", (F.col("source_email") != "m2").alias("email_sent"), F.lit("late").alias("email_error"))
    end = flow.close_run(t, sent, mails)
    stats = end["run_stats"].first()
    assert (stats["total_successful"], stats["total_send_failed_invoices"], stats["total_batches"], stats["total_quarantined_emails"]) == (3, 1, 4, 4)
    assert {r["entry"] for r in end["attention"].collect()} == {"quarantined_source_emails/8.eml", "failed_to_send/LE100.GH03/Beta_B1.pdf"}


def test_reports_are_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], ["Source Email", "Total"])
    for fmt in ("parquet", "json", "csv"):
        reports.write_report(df, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt)).first()
        assert (back["Source Email"], int(back["Total"])) == ("a", 1)


def test_integers_beyond_64_bits_are_numbers(spark):
    rows = [(1, 0, '{"supplier_name_on_page": "A", "invoice_number": 123456789012345678901}'),
            (2, 0, '{"supplier_name_on_page": "A", "invoice_number": 1.5}')]
    df = spark.createDataFrame(rows, "pdf_id long, page_idx int, raw_text string")
    got = {r["pdf_id"]: (r["read_ok"], r["invoice_number"]) for r in responses.parse_signals(df).collect()}
    assert got == {1: (True, "123456789012345678901"), 2: (False, None)}


def test_responses_are_typed_once(spark):
    rows = [(1, '{"po_numbers": ["3500000001", null]}'), (2, '{"po_numbers": [1]}'), (3, '{"x": {"po_numbers": [1]}, "bill_to_client_name": "A"}'),
            (4, '{"po_numbers": null}'), (5, '{"bill_to_client_name": true, "po_numbers": []}'), (6, '{"po_numbers": [], "bill_to_client_name": "\\ud800"}'),
            (7, '{"po_numbers": []} {"a": 1}'), (8, None), (9, "[1]")]
    df = spark.createDataFrame([(i, 0, t) for i, t in rows], "pdf_id long, page_idx int, raw_text string")
    got = {r["pdf_id"]: (r["read_ok"], r["bill_to"], r["po_numbers"]) for r in responses.parse_fields(df).collect()}
    assert got[1] == (True, None, ["3500000001"]) and got[3] == (True, "A", []) and got[7] == (True, None, []) and got[6][0]
    assert [k for k, v in got.items() if not v[0]] == [2, 4, 5, 8, 9]
    signals = [(1, '{"supplier_name_on_page": "x", "invoice_number": true}'), (2, '{"supplier_name_on_page": "x", "invoice_number": 1.0}'),
               (3, '{"supplier_name_on_page": "x", "invoice_number": 123456789012345678901234567890}'), (4, '{"supplier_name_on_page": 1}')]
    df = spark.createDataFrame([(i, 0, t) for i, t in signals], "pdf_id long, page_idx int, raw_text string")
    got = {r["pdf_id"]: (r["read_ok"], r["invoice_number"]) for r in responses.parse_signals(df).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, "123456789012345678901234567890"), 4: (False, None)}
    picked = spark.createDataFrame([('{"a": 1} {"b": "é"}',), ("none",)], "t string").select(responses.pick_json("a")(F.col("t")).alias("t"))
    assert [r["t"] for r in picked.collect()] == ['{"a": 1}', None]
