import random
import re

import pytest
from pyspark.sql import functions as F

from bundleflow.operators import batching, containment, match, messages, naming, ordering, reference, reports, routing, scale, sheets, tagging
from bundleflow.functions import lexicon as lx


# ------------------------------------------------------------ running totals --
def test_running_total_over_the_whole_range(spark):
    r = random.Random(1)
    orders = sorted({r.randrange(1 << b) for b in (3, 10, 17, 25, 40, 62) for _ in range(40)})
    rows = [(k, o, r.randint(0, 9)) for o in orders for k in ("a", "b")]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for keys in ((), ("k",)):
        got = {(x["k"], x["o"]): x["t"] for x in scale.running_total(df, F.col("v"), "o", "t", keys, ("k",)).collect()}
        want, totals = {}, {}
        for k, o, v in sorted(rows, key=lambda x: (x[1], x[0])):
            g = k if keys else ""
            want[(k, o)] = totals.get(g, 0)
            totals[g] = totals.get(g, 0) + v
        assert got == want


def test_positions_are_dense_in_the_order(spark):
    rows = [(f"f{i * 7 % 37:02d}", i) for i in range(500)] + [(None, 1000)]
    df = spark.createDataFrame(rows, "name string, i int").repartition(11)
    got = {(r["name"], r["i"]): r["n"] for r in ordering.dense_positions(df, ["name", "i"], "n").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(got.values()) == list(range(len(rows)))
    assert ordering.dense_positions(df.limit(0), ["name"], "n").isEmpty()


def test_paths_are_numbered_in_order(spark):
    paths = [f"m{i % 5}/{'x/' if i % 3 == 0 else ''}f{i * 13 % 97}.pdf" for i in range(90)] + ["top.pdf", "m0/é.pdf"]
    got = {r["path"]: (r["folder"], r["folder_ord"], r["pdf_ord"]) for r in ordering.path_order(
        spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)).collect()}
    folders = sorted({p.rpartition("/")[0] for p in paths})
    for f in folders:
        mine = sorted(p for p in paths if p.rpartition("/")[0] == f)
        assert [got[p] for p in mine] == [(f, folders.index(f), k) for k in range(1, len(mine) + 1)]


# ------------------------------------------------------------------- naming --
def numbered(stems):
    used, out = set(), []
    for s in stems:
        name, n = s, 2
        while name in used:
            name, n = f"{s}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def test_unique_names_against_loop(spark):
    r = random.Random(2)
    dirs = {f"d{i}": [r.choice(["a", "a", "a", "b", "a_2", "a_3", "a_2_2", "b_7", "c_1", "c"]) for _ in range(r.randint(1, 25))]
            for i in range(60)}
    rows = [(d, s, i) for d, stems in dirs.items() for i, s in enumerate(stems)]
    out = naming.unique_names(spark.createDataFrame(rows, "d string, s string, o long"), "d", "s", "o", "name")
    got = {(x["d"], x["o"]): x["name"] for x in out.collect()}
    assert got == {(d, i): n for d, stems in dirs.items() for i, n in enumerate(numbered(stems))}


def test_names_follow_orders_beyond_32_bits(spark):
    rows = [("d", "a", o, t) for o in (3, 2**32, 5 * 10**9, 2**40) for t in (2, 1)]
    out = naming.unique_names(spark.createDataFrame(rows, "d string, s string, o long, t int"), "d", "s", "o", "name", "t")
    got = {(x["o"], x["t"]): x["name"] for x in out.collect()}
    want = ["a"] + [f"a_{k}" for k in range(2, 9)]
    assert [got[k] for k in sorted(got)] == want


def test_attention_entries_do_not_clash(spark):
    folders = spark.createDataFrame([("f1", True), ("f2", True), ("f3", False)], "folder string, quarantined boolean")
    mails = spark.createDataFrame([("f1", "/in/1/mail.eml"), ("f2", "/in/2/mail.eml"), ("f3", "/in/3/mail.eml")],
                                  "folder string, msg_path string")
    none = spark.createDataFrame([], "batch_id string, output_pdf string")
    got = {r["entry"]: r["path"] for r in reports.attention_manifest(folders, mails, none, none).collect()}
    assert sorted(got) == ["quarantined_source_emails/mail.eml", "quarantined_source_emails/mail_2.eml"]
    assert sorted(got.values()) == ["/in/1/mail.eml", "/in/2/mail.eml"]


def test_repeated_translations_give_one_row(spark):
    entries = spark.createDataFrame([(1, "acme trading", "Acme Trading")], "ref_ord long, norm string, original string")
    names = spark.createDataFrame([("電信公司",), ("Acme Trading",)], "n string")
    known = spark.createDataFrame([("電信公司", "Acme Trading"), ("電信公司", "Other")], "src string, dst string")
    got = match.match_sensitive(names, "n", entries, known).collect()
    assert sorted(r["name"] for r in got) == ["Acme Trading", "電信公司"]
    assert {r["name"]: r["translated_query"] for r in got}["電信公司"] == "Acme Trading"


# ------------------------------------------------------------------ pairing --
def grouped(files):
    """Names and groups of one message, read straight from the rules."""
    def stem(n):
        return re.sub("[^a-z0-9]", "", n.rsplit(".", 1)[0].lower())

    out, taken = {}, set()
    for i, (name, rel) in enumerate(files):
        if rel:
            out[i] = rel.replace("/", "_")
            taken.add(out[i])
    top = [(i, n) for i, (n, rel) in enumerate(files) if not rel]
    pdfs = [(i, n) for i, n in top if n.lower().endswith(".pdf")]
    if len(pdfs) <= 1:
        return {**out, **{i: "" for i, _ in top}}
    for i, n in pdfs:
        base = re.sub(r"[\s_]+", "_", re.sub(r"[^A-Za-z0-9._\- ]+", "_", n[:-4])).strip("._-") or "invoice"
        folder, k = base, 2
        while folder in taken:
            folder, k = f"{base}_{k}", k + 1
        taken.add(folder)
        out[i] = folder
    for i, n in top:
        if i in out:
            continue
        mine = stem(n)
        equal = [out[j] for j, p in pdfs if mine and stem(p) == mine]
        near = [out[j] for j, p in pdfs if min(len(stem(p)), len(mine)) >= 4
                and (mine.startswith(stem(p)) or stem(p).startswith(mine))]
        out[i] = (equal + near + [""])[0]
    return out


def test_pairing_against_the_rules(spark):
    r = random.Random(4)
    names = ["Inv 1.pdf", "INV_1.pdf", "inv1.xlsx", "inv-1-details.xml", "invoice.pdf", "invo.txt", "in.pdf", "in.xml",
             "invoice 77.xls", "Inv.1.PDF", "--.pdf", "abcd.pdf", "abcdef.xlsx", "abc.xml"]
    mails = {m: [(r.choice(names), r.choice(["", "", "", "z/inv 1", "Inv_1"])) for _ in range(r.randint(1, 9))] for m in range(120)}
    rows = [(m, i, n, rel.replace(" ", "_")) for m, files in mails.items() for i, (n, rel) in enumerate(files)]
    out = messages.pair_attachments(spark.createDataFrame(rows, "message_id long, att_ord int, file_name string, rel_dir string"))
    got = {(x["message_id"], x["att_ord"]): x["group_name"] for x in out.collect()}
    want = {(m, i): g for m, files in mails.items()
            for i, g in grouped([(n, rel.replace(" ", "_")) for n, rel in files]).items()}
    assert got == want


# ------------------------------------------------------------------- sheets --
def sheet_hit(number, value):
    key, v = re.sub("[^a-z0-9]", "", (number or "").lower()), value.strip()
    if not v:
        return False
    if key.isdigit():
        return (key.lstrip("0") or "0") in {d.lstrip("0") or "0" for d in re.findall(r"\d+", v)}
    cell = re.sub("[^a-z0-9]", "", v.lower())
    return bool(key) and (key in cell or cell in key)


def test_sheets_against_a_scan(spark):
    r = random.Random(6)
    numbers = ["00012", "12", "D073/26", "e1-a2", None, "--", "000"]
    values = ["INV 12", "012 x", "ref d073 26 ok", "7326", "e1", "a2410", " ", "..", "0", "E1A2 9", "13"]
    targets = [(p, f"f{p % 20}", r.choice(numbers)) for p in range(60)]
    cells = [(f"f{f}", f"f{f}/b.xlsx", s, f"S{s}", r.choice(values)) for f in range(18) for s in range(4) for _ in range(r.randint(0, 3))]
    books = [(f"f{f}", f"f{f}/b.xlsx") for f in range(18)] + [("f3", "f3/c.xlsx"), ("f4", "f4/~$b.xlsx")]
    out = sheets.sheet_match(
        spark.createDataFrame(targets, "pdf_id long, folder string, invoice_number string"),
        spark.createDataFrame(cells, "folder string, workbook string, sheet_idx int, sheet_name string, value string"),
        spark.createDataFrame(books, "folder string, workbook string"))
    for row in out.collect():
        number, f = targets[row["pdf_id"]][2], row["folder"]
        hits = sorted({s for fo, _, s, _, v in cells if fo == f and sheet_hit(number, v)})
        if f == "f3":
            assert row["reason"] == "multiple Excel files found" and row["sheet_name"] is None
        elif f in ("f18", "f19"):
            assert row["reason"] == "no Excel file in folder"
        else:
            assert (row["sheet_name"], row["n_candidates"]) == (f"S{hits[-1]}" if hits else None, len(hits))


def test_numbers_are_found_by_lookup():
    r = random.Random(4)
    norms = ["".join(r.choices("ab12", k=r.choice([3, 5, 9]))) for _ in range(400)]
    known = containment.Numbers([], norms)
    for _ in range(300):
        t = "".join(r.choices("ab12", k=r.randint(0, 14)))
        assert known.around(t) == {n for n in norms if n in t or t in n}

    class Counted(set):
        asked = 0

        def __contains__(self, x):
            Counted.asked += 1
            return super().__contains__(x)

    def lookups(n):
        index = containment.Numbers([], [f"z{i:07d}" for i in range(n)])
        index.by_length = {k: Counted(v) for k, v in index.by_length.items()}
        Counted.asked = 0
        assert index.around("invoice z0000007 of may") == {"z0000007"}
        return Counted.asked
    assert lookups(10) == lookups(5000) <= 23  # not more for more numbers


def test_one_folder_may_hold_half_of_all_cells(spark):
    cells = [("hot", i % 40, f"S{i % 40}", f"n{i % 700}x", [str(i % 90)]) for i in range(6000)]
    cells += [(f"f{i}", 0, "S0", f"n{i}x", ["7"]) for i in range(3000)]
    numbers = [("hot", None, f"n{i}x") for i in range(0, 900, 3)] + [("hot", str(i), None) for i in range(0, 200, 7)]
    numbers += [(f"f{i}", "7", None) for i in range(0, 3000, 50)] + [("f2", None, "2"), ("nobody", None, "n1x")]
    texts = spark.createDataFrame(cells, "folder string, sheet_idx int, sheet_name string, norm string, runs array<string>")
    found = containment.hits(texts, spark.createDataFrame(numbers, "folder string, digits string, norm string"), at_once=500)
    by_folder = {}
    for f, s, _, norm, runs in cells:
        by_folder.setdefault(f, set()).add((s, norm, runs[0]))
    want = {(f, s, d, n) for f, d, n in numbers for s, norm, run in by_folder.get(f, ())
            if (d is not None and d == run) or (n is not None and (n in norm or norm in n))}
    got = [(r["folder"], r["sheet_idx"], r["digits"], r["norm"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ------------------------------------------------------------------ matching --
def _entities(spark):
    raw = [(i, f"LE{i}", n, "site", "land") for i, n in enumerate(
        ["Acme Corp / Acme GmbH", "Beta Ltd", "Acme Corporation", "Gamma Services AB", "Delta & Co", "Beta Limited Partners"])]
    return reference.entity_reference(spark.createDataFrame(
        raw, "ord int, le string, bill_to_name string, source_site string, country string"))


@pytest.mark.parametrize("exchange", [{}, {"block": 1}, {"block": 2, "slices": 3}])
def test_match_does_not_depend_on_blocks(spark, exchange):
    names = spark.createDataFrame([(n,) for n in ["ACME corp", "Bta Ltd", "Beta Limited", "zzz", "Gama Services AB", "", None, "Δέλτα"]], "n string")
    tr = spark.createDataFrame([("Δέλτα", "Delta and Co")], "src string, dst string")
    got = {r["name"]: (r["method"], r["le"], r["translated"]) for r in match.match_entity(names, "n", _entities(spark), tr, **exchange).collect()}
    assert got == {"ACME corp": ("exact", "LE0", False), "Bta Ltd": ("fuzzy", "LE1", False), "Beta Limited": ("exact", "LE1", False),
                   "zzz": ("no_match", None, False), "Gama Services AB": ("fuzzy", "LE3", False), "": ("empty", None, False),
                   "Δέλτα": ("exact", "LE4", True)}


def test_near_miss_is_reported(spark):
    names = spark.createDataFrame([("Acme Holding International",)], "n string")
    r = match.match_entity(names, "n", _entities(spark)).first()
    assert r["method"] == "no_match" and not r["matched"] and r["le"] is not None and 0 < r["score"] < lx.ENTITY_THRESHOLD


def test_translation_comes_first_for_vietnamese_names(spark):
    raw = spark.createDataFrame([(0, "77", "Công ty Điện", None), (1, "78", "Power Works", "x")],
                                "ord int, supplier_id string, supplier_name string, alt_name string")
    tr = spark.createDataFrame([("Công ty Điện", "Electric Company")], "src string, dst string")
    ref = reference.vn_aliases(reference.vn_suppliers(raw, tr))
    names = spark.createDataFrame([("Công ty Điện",), ("electric company ltd",), ("Điện lạ",), ("nothing like it",)], "n string")
    got = {r["name"]: (r["matched"], r["supplier_id"], r["translated"], r["translated_query"])
           for r in match.match_vn_supplier(names, "n", ref, tr).collect()}
    assert got["Công ty Điện"] == (True, "77", True, "Electric Company")
    assert got["electric company ltd"] == (True, "77", False, None)
    assert got["Điện lạ"][2:] == (True, "Điện lạ")
    assert got["nothing like it"][:2] == (False, None)


# ------------------------------------------------------------------- tagging --
def test_tag_examples(spark):
    cases = [("Vodafone Telecom Ireland", None, "TELECOM,UTILITY"), ("City Water & Power Authority", None, "UTILITY"),
             ("Global Tasks Asesores, S.L.", None, ""), ("台灣電信股份有限公司", None, "UTILITY"),
             ("x", "Mehrwertsteuer 19% ausgewiesen", "UTILITY"), ("x", "Your Direct  Debit is due", "DD"), ("x", "DD payment", ""),
             ("Some GmbH", "Rechnung - Telekommunikation", "UTILITY"),
             ("SC Exemplu SRL", "Factura - Servicii de electricitate", "UTILITY")]
    docs = spark.createDataFrame([(i, s, None) for i, (s, _, _) in enumerate(cases)], "folder int, supplier_name string, bill_to string")
    mails = spark.createDataFrame([(i, m, "") for i, (_, m, _) in enumerate(cases) if m], "folder int, subject string, body string")
    got = {r["folder"]: ",".join(r["tags"]) for r in tagging.derive_tags(docs, mails, "folder").collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(cases)}


def test_tags_equal_a_search_of_the_whole_text(spark):
    r = random.Random(9)
    terms = [t for g in lx.UTILITY_TERMS.values() for t in g] + lx.TELECOM_TERMS + ["direct debit"]

    def pieces():  # terms torn apart at blanks, so that they meet across fields
        words = " ".join(r.sample(terms, 2) + ["xx"]).split(" ")
        cut = sorted(r.sample(range(len(words) + 1), 3)) if len(words) > 3 else [1, 1, 2]
        a, b, c = cut
        return [" ".join(words[:a]), " ".join(words[a:b]), " ".join(words[b:c]), "  ".join(words[c:])]
    data = [pieces() for _ in range(300)]
    docs = spark.createDataFrame([(i, d[0] or None, d[1]) for i, d in enumerate(data)], "folder int, supplier_name string, bill_to string")
    mails = spark.createDataFrame([(i, d[2], d[3]) for i, d in enumerate(data)], "folder int, subject string, body string")
    got = {x["folder"]: x["tags"] for x in tagging.derive_tags(docs, mails, "folder").collect()}
    for i, d in enumerate(data):
        whole = re.sub(r"\s+", " ", " ".join(p for p in d if p)).strip().lower()
        mail = re.sub(r"\s+", " ", " ".join(p for p in d[2:] if p)).strip().lower()
        want = [n for n, ok in [("TELECOM", any(t in whole for t in lx.TELECOM_TERMS)),
                                ("UTILITY", any(t.lower() in whole for g in lx.UTILITY_TERMS.values() for t in g)),
                                ("DD", "direct debit" in mail)] if ok]
        assert got[i] == want


# ------------------------------------------------------------------- routing --
def test_routing_last_row_wins_but_keeps_its_place(spark):
    raw = spark.createDataFrame([(0, "Asia/Penang/PNG", "a1", "t1"), (1, "UK\\Swindon", "a2", "t2"), (2, "Europe/Penang", "a3", "t3"),
                                 (3, " ", "x", "x")], "ord int, source_site string, appo string, tidecr string")
    idx = reference.routing_index(raw)
    rows = {r["key"]: r["appo"] for r in idx.collect()}
    assert rows["penang"] == "a3" and rows["png"] == "a1" and rows["swindon"] == "a2" and rows["uk\\swindon"] == "a2"
    docs = spark.createDataFrame([("Penang", ["1"]), ("swin", []), ("PNG plant", []), ("", ["1"]), (None, []), ("   ", []), ("qqq", [])],
                                 "source_site string, po_numbers array<string>")
    got = [(r["source_site"], r["kofax_email"], r["invoice_type"], r["routed"]) for r in routing.route(docs, idx).collect()]
    assert set(got) == {("Penang", "a3", "APPO", True), ("swin", "t2", "TIDEeCR", True), ("PNG plant", "t1", "TIDEeCR", True),
                        ("", None, None, False), (None, None, None, False), ("   ", "t1", "TIDEeCR", True), ("qqq", None, None, False)}


# ------------------------------------------------------------------- batches --
DOCS = ("folder string, folder_ord long, kofax_email string, le string, tags array<string>, is_sensitive boolean, "
        "needs_manual_review boolean, output_pdf string")
ERRORS = "folder string, folder_ord long, source_file string, error string"


def test_batch_ids(spark):
    docs = [("m1", 1, "a@x", "LE100", [], False)] * 3 + [("m1", 1, "b@x", "LE100", [], False)]
    docs += [("m2", 2, "a@x", "LE420", ["TELECOM"], False), ("m2", 2, "a@x", "LE420", ["DD", "UTILITY"], False), ("m2", 2, None, "LE1", [], False)]
    df = spark.createDataFrame([(*d, False, "f.pdf") for d in docs], DOCS)
    out = batching.assign_batches(df, "2026-09-10").orderBy("counter").collect()
    assert [r["batch_id"] for r in out] == ["LE100.GH01", "LE100.GH04", "LE420.GH05-TELCO-DD"]
    assert [r["staged_dir"] for r in out][0] == "a@x/LE100.GH01"


def test_batch_invariants_with_one_hot_folder(spark):
    r = random.Random(8)
    rows = [(f"m{k}", k, f"{r.choice('ab')}@x", r.choice(["LE1", "LE2", None]), [], r.random() < .1, k % 9 == 0 and r.random() < .5, f"{i}.pdf")
            for i, k in enumerate([7] * 700 + [r.randrange(400) for _ in range(1300)])]
    docs = spark.createDataFrame(rows, DOCS)
    errors = spark.createDataFrame([("m5", 5, "x.pdf", "bad"), ("m999", 999, "y.pdf", "bad")], ERRORS)
    clean, held = batching.quarantine(docs, errors)
    assert clean.count() + held.count() == len(rows)
    batches = batching.assign_batches(clean, "2026-09-10").orderBy("counter").collect()
    bad = {x[0] for x in rows if x[6]} | {"m5", "m999"}
    assert not bad & {b["source_email"] for b in batches}
    following = 1
    for b in batches:
        assert b["counter"] == following
        following += b["invoice_count"]
    assert following - 1 == sum(1 for x in rows if x[0] not in bad and x[3])
    order = [(b["folder_ord"], b["kofax_email"], b["le"]) for b in batches]
    assert order == sorted(order)
    folders = batching.folder_summary(docs, errors)
    assert {f["folder"] for f in folders.where("quarantined").collect()} == bad
    stats = reports.run_stats(batching.assign_batches(clean, "2026-09-10"), spark.createDataFrame([], "batch_id string, email_sent boolean, email_error string"), folders).first()
    assert stats["total_successful"] == 0 and stats["total_batches"] == len(batches)
    assert stats["total_quarantined_invoices"] == sum(1 for x in rows if x[0] in bad)


def test_empty_run(spark):
    docs, errors = spark.createDataFrame([], DOCS), spark.createDataFrame([], ERRORS)
    folders = batching.folder_summary(docs, errors)
    batches = batching.assign_batches(docs, "2026-09-10")
    sent = spark.createDataFrame([], "batch_id string, email_sent boolean, email_error string")
    assert batches.count() == 0
    assert list(reports.run_stats(batches, sent, folders).first()) == [0] * 7
    assert list(reports.overview(folders).first()) == [0] * 4


# -------------------------------------------------------------------- plans --
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_pairs_whole_sides(spark):
    from bundleflow.plans.catalog import QUERIES
    for name in ["le_fuzzy_top1", "route_invoices", "pair_attachments", "sheet_match", "run_stats", "tag_documents", "batch_assign"]:
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_segmentation_sorts_and_shuffles_pages_once(spark):
    from bundleflow.operators import segment
    pages = spark.createDataFrame([(1, 0, True, "a", "1")], "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string")
    keyed = segment.with_key_supplier(segment.clean_signals(pages), blocks=False)
    plan = _plan(segment.segment_pages(keyed.withColumn("supplier_ok", F.col("supplier_name_on_page") == F.col("key_supplier")), blocks=False))
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    # Python scores hide the partitioning, so spelling tolerance costs a second shuffle and no more
    assert _plan(segment.segment(pages, blocks=False)).count("Exchange hashpartitioning") == 2


def test_short_bundles_are_read_and_exchanged_once(spark, tmp_path):
    from bundleflow.operators import segment
    from bundleflow.plans.catalog_pages import _by_equality
    columns = "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string"
    spark.createDataFrame([(d, p, True, "a", str(p // 2)) for d in range(9) for p in range(5)], columns).write.parquet(str(tmp_path / "p"))
    pages = segment.clean_signals(spark.read.parquet(str(tmp_path / "p")))
    plan = _plan(segment.by_length(pages, _by_equality))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    far = pages.unionByName(pages.limit(1).withColumn("page_idx", F.lit(segment.PAGES_PER_BLOCK)))
    assert segment.by_length(far, _by_equality).count() == 46


def test_names_of_a_large_family(spark):
    """Many arrivals of one stem and many stems that are its numbered forms, in mixed order."""
    r = random.Random(8)
    stems = ["a"] * 3000 + [f"a_{k}" for k in range(2, 2500)] * 1 + ["a_7"] * 50 + ["a_7_3"] * 4
    r.shuffle(stems)
    rows = [("d", s, i) for i, s in enumerate(stems)]
    out = naming.unique_names(spark.createDataFrame(rows, "d string, s string, o long").repartition(9), "d", "s", "o", "name")
    assert {x["o"]: x["name"] for x in out.collect()} == dict(enumerate(numbered(stems)))


def test_fields_and_segments_share_one_exchange(spark):
    from bundleflow.operators import fields
    from bundleflow.plans.catalog_pages import _by_equality
    signals = spark.createDataFrame([(1, 0, True, "a", "1")], "pdf_id long, page_idx int, read_ok boolean, supplier_name_on_page string, invoice_number string")
    data = spark.createDataFrame([(1, 0, True, "b", ["3500000001"])], "pdf_id long, page_idx int, read_ok boolean, bill_to string, po_numbers array<string>")
    rows = fields.take_fields(fields.beside_signals(signals, data), False)
    plan = _plan(fields.merge_read(_by_equality(rows, False, fields.READ)))
    assert plan.count("Exchange hashpartitioning") == 1
