from pyspark.sql import functions as F

from bundleflow.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_entity_names_keep_and_spell_out_legal_forms(spark):
    pairs = {
        "Acme Corp.": "acme corporation", "ACME  CORP": "acme corporation", "STE Acme Corporation SAS": "societe acme corporation sas",
        "Acme K.K.": "acme kabushiki kaisha", "Acme z.o.o.": "acme spzoo", "R & D Acme": "research and development acme",
        "Acme S.A.": "acme sa", "Acme S.p.A.": "acme spa", "Đại Acme": "dai acme", "日本電信 株式会社": "日本電信株式会社",
        "Привет  Мир": "привет мир", "": "", "nan": "", "Acme & Söhne AB": "acme and sohne aktiebolag"}
    df = spark.createDataFrame([(k,) for k in pairs], "n string")
    got = {r["n"]: r["k"] for r in df.select("n", T.normalize_entity("n").alias("k")).collect()}
    assert got == pairs


def test_entity_canonical_names(spark):
    key = T.normalize_entity(F.lit("亞太 科技 公司"), {"亞太科技公司": "Asia Pacific Tech Ltd"})
    assert one(spark, key) == "asia pacific technology limited"


def test_sensitive_names_drop_legal_forms(spark):
    for raw, key in {"Acme Svcs, Inc.": "acme services", "Ltd": "ltd", "A&B GmbH": "a and b", "None": ""}.items():
        assert one(spark, T.normalize_name(F.lit(raw))) == key
    assert one(spark, T.normalize_name(F.lit(None).cast("string"))) == ""


def test_vietnamese_names_have_no_fallback(spark):
    assert one(spark, T.normalize_vn(F.lit("Công ty Điện Co., Ltd"))) == "cong ty dien company limited"
    assert one(spark, T.normalize_vn(F.lit("電信"))) == ""
    assert one(spark, T.clean_artifact(F.lit("Acme+B33  Co"))) == "Acme Co"


def test_order_numbers(spark):
    raw = "PO#3500510823, 13500510823 7001234567/3500510823 45010000001"
    assert one(spark, T.po_numbers(F.lit(raw))) == ["3500510823", "7001234567"]


def test_digits_and_cells(spark):
    assert sorted(one(spark, T.digit_runs(F.lit("INV00009531 dated 01/05/2024 000")))) == ["0", "1", "2024", "5", "9531"]
    assert one(spark, T.pure_digit_key(F.lit("0000-9531"))) == "9531"
    assert one(spark, T.pure_digit_key(F.lit("D073/26"))) is None


def test_file_names(spark):
    for raw, want in {"a b/c.PDF": "a_b_c.PDF", ".pdf": "pdf", "..hid": "x.hid", "x" * 80 + ".pdf": "x" * 56 + ".pdf", "  ": "x.dat"}.items():
        assert one(spark, T.sanitize_file(F.lit(raw), "x.dat")) == want
    assert one(spark, T.sanitize_result(F.lit("__a/b..__"), "f")) == "a_b"
    assert one(spark, T.sanitize_result(F.lit("///"), "f")) == "f"
    assert one(spark, T.output_stem(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(7))) == "unknown_supplier_noinv_07"
    assert one(spark, T.file_stem(F.lit("/a/b.tar.gz"))) == "b.tar"
    assert one(spark, T.sanitize_attachment(F.lit(".pdf"), F.lit("LE100.GH01"))) == "LE100..pdf"


def test_rename_needs_all_fields(spark):
    miss = T.missing_fields(F.lit(None).cast("string"), F.lit(""), F.lit("1"))
    assert one(spark, miss) == "missing required field(s): supplier_id, po_number"
    assert one(spark, T.renamed_stem(F.lit("1"), F.lit("2"), F.lit("3"))) == "ESD1 PO2 INV3"


def test_headers(spark):
    cases = {'"Jo X" <jo@x.de>': ("Jo X", "jo@x.de"), "jo@x.de (Jo)": ("(Jo)", "jo@x.de"), "Jo": ("Jo", ""), "": ("", "")}
    for raw, want in cases.items():
        assert tuple(one(spark, T.parse_sender(F.lit(raw)))) == want
    dates = {"Wed, 09 Sep 2026 10:30:00 +0000": "2026-09-09T10:30:00+00:00", "9 Sep 2026 10:30 -0000": "2026-09-09T10:30:00",
             "Wed, 39 Sep 2026 10:30:00 +0000": "Wed, 39 Sep 2026 10:30:00 +0000", "soon": "soon"}
    for raw, want in dates.items():
        assert one(spark, T.date_to_iso(F.lit(raw))) == want


def test_batch_names(spark):
    letters = [one(spark, T.day_letter(F.lit(f"2026-09-{7 + i:02d}").cast("date"))) for i in range(7)]
    assert letters == list("MTWHFSU")
    assert one(spark, T.batch_id(F.lit("LE1"), F.lit("H"), F.lit(4), F.lit("-DD"))) == "LE1.GH04-DD"
    assert one(spark, T.batch_id(F.lit("LE1"), F.lit("H"), F.lit(140), F.lit(""))) == "LE1.GH140"


def test_page_runs_text(spark):
    runs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in [(1, 3), (5, 5)]])
    assert one(spark, T.format_runs(runs)) == "1–3, 5"
    assert one(spark, T.format_runs(F.filter(runs, lambda r: F.lit(False)))) == "—"


def test_translation_cleanup(spark):
    for raw, want in {"Translation: Acme Co": "Acme Co", '"Acme"': "Acme", "<think>a</think>Acme.": "Acme", "": "src"}.items():
        assert one(spark, T.clean_translation(F.lit(raw), F.lit("src"))) == want


def test_path_safety(spark):
    for raw, want in {"a/b": False, "../a": True, "a\\..\\b": True, "/a": True, "a..b": False}.items():
        assert one(spark, T.unsafe_path(F.lit(raw))) is want


def test_zone_names_and_short_years(spark):
    cases = {"Mon, 5 Jan 2026 10:00:00 EST": "2026-01-05T10:00:00-05:00", "5 Jan 26 10:00 PDT": "2026-01-05T10:00:00-07:00",
             "5 Jan 99 10:00 GMT": "1999-01-05T10:00:00+00:00", "5 Jan 2026 10:00:00 XYZ": "2026-01-05T10:00:00"}
    for raw, want in cases.items():
        assert one(spark, T.date_to_iso(F.lit(raw))) == want
