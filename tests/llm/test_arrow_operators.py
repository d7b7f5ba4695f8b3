"""Operators with numpy inside their tasks, against brute force, exact round trips and held-out accuracy."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bundleflow.llm import ann, decontam, langid, ngram_join, packing, pii, shingles, warc

DOCS = "doc_id long, text string, mark string, spans string, score double"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "m", "s", 0.0) for i, t in rows], DOCS)


# packing

def _best_cost(places, penalty, window, last):
    best = {0: 0.0}
    for j in range(1, len(places)):
        costs = []
        for i in range(j):
            size = places[j] - places[i]
            if size <= window:
                free = j == len(places) - 1 and (not last or size & (size - 1) == 0)
                costs.append(best[i] + (0 if free else window - size))
        best[j] = min(costs) + penalty[j]
    return best[len(places) - 1]


@pytest.mark.parametrize("last", [True, False])
def test_cuts_are_least_cost(last):
    rng = np.random.default_rng(1)
    for _ in range(60):
        window, total = 16, int(rng.integers(1, 90))
        docs = np.unique(rng.integers(1, total + 1, 4))
        ends = np.unique(rng.integers(1, total + 1, 8))
        places, penalty = packing.candidates(total, np.append(docs, total), ends, window, 2.0, 5.0)
        where = packing.cuts(places, penalty, window, last)
        assert where[0] == 0 and where[-1] == total and max(np.diff(where)) <= window
        pen = dict(zip(places.tolist(), penalty.tolist(), strict=True))
        cost = 0.0
        for a, b in zip(where, where[1:], strict=False):
            size = b - a
            free = b == total and (not last or size & (size - 1) == 0)
            cost += (0 if free else window - size) + pen[b]
        assert cost == pytest.approx(_best_cost(places.tolist(), penalty.tolist(), window, last))


def test_packing_keeps_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["one", "two.", "three\n", "é", "<|endoftext|>"], k=rng.randint(0, 900)))) for i in range(40)]
    rows += [(None, None), (5, ""), (5, ""), (77, "word " * 30000), (78, "x" * 6000)]
    got = packing.pack(_docs(spark, rows).coalesce(2), stretch=8192).collect()
    slow = packing.tokenizer(packing.default_tokenizer()).slow
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, text in rows:
        ids = slow.encode(text or "", add_special_tokens=False).ids + [1]
        own = pieces[(i, len(ids))]
        crcs = {(r["start"], r["length"]): r["ids_crc32"] for r in own}
        for (start, length), crc in crcs.items():
            assert zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc
        assert sum(length for _, length in crcs) == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(_docs(spark, rows).limit(0)).count() == 0


# personal data

def _base(text):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19:
            d.reverse()
            if (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_match_the_plain_rules():
    rng = random.Random(4)
    parts = ["a.b@c-d.e", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "5", " ", "-", "+1 (234) 555-0000",
             "+", "é", "x@y", "@z.com", "1.2.3.4.5.6.7.8.9", "٣", "00001.2.3.004"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert pii.base_spans(text) == _base(text), text
    assert pii.base_spans("a" * 200000 + "1" * 200000 + "." * 1000 + "+" * 1000) == []


def test_label_model_and_spans(spark):
    p, right = pii.label_model(["+++0", "---0", "+0-0", "0000"], np.array([80.0, 80, 5, 50]))
    assert p[0] > 0.9 and p[1] < 0.1 and p[3] == 0 and right[1] > 0.8
    iban = "iban DE89 3704 0044 0532 0130 00 ok"
    rows = [(i, f"{iban} call 555.123.4567 now, mail a@b.co") for i in range(20)]
    rows += [(None, None), (21, ""), (22, "nothing here"), (22, "nothing here"), (23, "a@b.co " * 20000)]
    found = pii.digest(pii.find(_docs(spark, rows))).collect()
    assert len(found) == len(rows)
    some = next(r for r in found if r["doc_id"] == 0)
    assert "iban:5:32" in some["spans"] and some["n_email"] == 1
    assert next(r for r in found if r["doc_id"] == 22)["spans"] == ""
    assert next(r for r in found if r["doc_id"] == 23)["n_email"] == 20000
    masked = {r["doc_id"]: r for r in pii.mask(_docs(spark, rows)).collect()}
    assert masked[0]["text"].startswith("iban <IBAN> ok") and masked[0]["text"].endswith("mail <EMAIL>")
    assert masked[22]["text"] == "nothing here" and masked[None]["text"] is None and masked[22]["spans"] == "s"
    assert pii.find(_docs(spark, rows).limit(0)).count() == 0


# nearest neighbours

def test_forest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base[rng.integers(0, 60, 900)] + 0.1 * rng.normal(size=(900, 16)), rng.normal(size=(600, 16)),
                        np.repeat(base[:1], 40, 0)]).astype(np.float32)
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] + [1.0] * 15, 1), (5060, [], 1), (5080, [1.0, None], 1),
           (None, [1.0] * 16, 1), (5100, [1.0] * 3, 1), (0, rows[0][1], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=700, query_rows=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(v), 20))
    hits = 0
    w = v.astype(np.float64)
    for q, found in got.items():
        found.sort()
        scores = (w * w[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(v)), -scores))[:20]
        hits += len(set(best.tolist()) & {x[1] for x in found})
        assert [x[0] for x in found] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in found)
    assert hits / (20 * len(got)) >= 0.9
    assert all([(-s, i) for _, i, s in x] == sorted((-s, i) for _, i, s in x) for x in got.values())
    tied = [x[1] for x in got[1500] if x[1] >= 1500]  # of forty equal vectors, the smallest ids
    assert tied == [i for i in range(1501, 1540)][:len(tied)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# decontamination

def _smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_matches_the_textbook():
    rng = np.random.default_rng(6)
    for _ in range(30):
        a = rng.integers(0, 6, rng.integers(1, 12))
        b = [rng.integers(-1, 6, rng.integers(1, 20)) for _ in range(4)]
        grid = np.full((4, max(map(len, b))), -2)
        for k, x in enumerate(b):
            grid[k, :len(x)] = x
        assert decontam.align(a, grid)[0].tolist() == [_smith_waterman(a, x) for x in b]


def test_copies_and_edits_are_found(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    item = rng.choices(vocabulary, k=40)
    edited = [w if k % 7 else "other" for k, w in enumerate(item)]
    gap = item[:15] + ["so", "to", "say"] + item[15:]
    noise = lambda n: rng.choices(vocabulary, k=n)
    docs = [(1, noise(300) + item + noise(300)), (2, noise(50) + edited + noise(20)), (3, noise(4000)), (4, gap), (5, item[:12]),
            (6, item * 200), (7, item), (7, item)]
    rows = [(i, " ".join(w).capitalize() + ".") for i, w in docs] + [(None, " ".join(item)), (9, None), (10, "")]
    items = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x")],
                                  "item_id long, text string, mark string")
    got = decontam.contaminated(_docs(spark, rows), items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (4, 1), (6, 1), (7, 1)]
    assert {r["doc_id"]: r["score"] for r in got}[1] == 1.0
    assert decontam.contaminated(_docs(spark, rows).limit(0), items).count() == 0
    assert decontam.contaminated(_docs(spark, rows), items.limit(0)).count() == 0


@pytest.mark.parametrize("every", [4, 5])
@pytest.mark.parametrize("copies", [1, 5, 1000])
def test_dense_edits_are_found_in_any_number_of_copies(spark, every, copies):
    rng = random.Random(every)
    lengths = (20, 30, 40, 41, 42, 45, 56)
    items = [[f"i{n}x{k}" for k in range(n)] for n in lengths]
    edited = [[w if k % every != every - 1 else "other" for k, w in enumerate(i)] for i in items]
    noise = lambda n: [f"n{rng.randrange(400)}" for _ in range(n)]
    around = noise(30), noise(30)
    rows = [(c * len(items) + k, " ".join(around[0] + e + around[1])) for c in range(copies) for k, e in enumerate(edited)]
    # the whole item beside them makes the n-grams that the edits replace the rarer ones
    rows += [(-1 - k, " ".join(i)) for k, i in enumerate(items)]
    table = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(_docs(spark, rows), table).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(
        (i, i % len(items) if i >= 0 else -1 - i) for i, _ in rows)
    low = min(_smith_waterman(np.arange(n), np.where(np.arange(n) % every == every - 1, -1, np.arange(n))) / (2 * n)
              for n in lengths)
    assert min(r["score"] for r in got) == pytest.approx(low)


def test_parts_of_long_items_count_and_phrases_of_short_ones_do_not(spark):
    long, short = [f"l{k}" for k in range(300)], [f"s{k}" for k in range(6)]
    table = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    noise = [f"n{k}" for k in range(40)]
    part = [w if k % 7 else "other" for k, w in enumerate(long[100:240])]
    thin = [w for k, v in enumerate(long[:180]) for w in ([v, "x", "y"] if k % 6 > 2 else [v])]
    docs = [(1, long[60:200]), (2, part), (3, long[80:93]), (4, long[80:92]), (5, short[:4]), (6, short), (7, short[:3] + short[4:]),
            (8, thin), (9, long[:3] * 60)]
    rows = [(i, " ".join(noise + w + noise)) for i, w in docs]
    got = {r["doc_id"]: r for r in decontam.contaminated(_docs(spark, rows), table).collect()}
    # of the thin one, three words in a row and three single ones alternate: 12 - 6 of every 6 less 6
    assert sorted(got) == [1, 2, 3, 6]
    assert got[1]["score"] == pytest.approx(140 / 300) and got[1]["end_word"] == 179 and got[6]["score"] == 1.0


# n-gram Jaccard join

def _shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def test_shingle_sets_match_plain_ones():
    texts = ["a b c d e f", "A b\tc\x0bd e  f", "a b", "a  B ", "", "é x a b c d e", "a b c d e f a b c d e f", None]
    got = [s for _, part in shingles.chunks(pa.array([t or "" for t in texts])) for s in part]
    assert [len(s) for s in got] == [len(_shingles(t)) for t in texts]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() == got[3].tolist()
    sliced = [s for _, part in shingles.chunks(pa.array([t or "" for t in texts]).slice(2)) for s in part]
    assert [s.tolist() for s in sliced] == [s.tolist() for s in got[2:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([4, 8, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    line = " ".join(f"common{i}" for i in range(30))
    rows += [(1000 + i, line + " " + " ".join(f"u{i}x{k}" for k in range(8 + 4 * i))) for i in range(12)]
    rows += [(None, None), (2000, ""), (2000, ""), (2001, "one two"), (2002, "ONE  two"), (None, rows[0][1]), (2003, " \n"),
             (3, rows[3][1]), (4000, "long " + " ".join(str(k) for k in range(20000)))]
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(_docs(spark, rows).repartition(3), group=4).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(_components(rows), key=key)


@pytest.mark.parametrize("group", [4, 64])
def test_large_groups_of_near_copies_become_one_component(spark, group):
    """Two families of near copies with one opening, a chain that links only from neighbour to neighbour, and strangers
    that share the opening."""
    rng = random.Random(11)
    opening = " ".join(rng.choices("abcdefgh", k=8))
    rows = []
    for _ in range(2):
        base = [f"{rng.choice('pqrst')}{rng.randint(0, 99)}" for _ in range(60)]
        for _ in range(220):
            words = list(base)
            words[rng.randint(0, 59)] = f"v{rng.randint(0, 999)}"
            rows.append(opening + " " + " ".join(words))
    chain = [f"c{i}" for i in range(160)]
    rows += [" ".join(chain[i:i + 80]) for i in range(0, 80, 4)]
    rows += [opening + " " + " ".join(f"{rng.choice('klmno')}{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(rows)]
    got = ngram_join.near_duplicates(_docs(spark, docs).repartition(4), group=group).collect()
    want = {i: (n, c) for i, n, c in _components(docs)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert max(Counter(c for _, c in want.values()).values()) >= 200


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(_docs(spark, [(1, "a")]).limit(0)).count() == 0
    alone = ngram_join.near_duplicates(_docs(spark, [(1, "a b c d e f"), (2, None)])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in alone) == [(1, 2, 1), (2, 0, 2)]


# web archives

def test_archives_round_trip(spark, tmp_path):
    page = "<html>" + "text " * 50
    rows = [(i, f"http://x/{i}\r\n", page + str(i % 7) * (i % 5), "d") for i in range(300)]
    rows += [(900, None, None, "d"), (901, "u", "", "d"), (902, "u", "short", "d"), (903, "u", "short", "d"),
             (None, "u", page, "d"), (904, "é", "ü" * 200000, "d"), (0, "again", rows[0][2], "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    folder = str(tmp_path / "archives")
    manifest = warc.write(pages, folder, roll=20000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read(spark, folder).collect()
    first = {}
    for i, _, html, _ in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        want.append((-1 if i is None else i, len(body), hashlib.sha256(body).hexdigest(),
                     "response" if refers is None else "revisit", -1 if refers is None else refers))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                   -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == sorted(want)
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_starts_with_its_dictionary():
    rng = random.Random(1)
    many = [f"<html><body>{rng.random()}<p>the same words in each record</p>{k}</body></html>".encode() * 3 for k in range(400)]
    content = b"".join(warc.archive_frames(many))
    assert int.from_bytes(content[:4], "little") == 0x184D2A5D and int.from_bytes(content[4:8], "little") > 500
    assert content[8:12] == bytes.fromhex("37a430ec")
    assert list(warc.records(content)) == many
    assert list(warc.records(b"".join(warc.archive_frames([b"one"])))) == [b"one"]


# languages

def _language(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def test_language_network_learns_and_reads_whole_texts(spark):
    rng = random.Random(9)
    letters = {"aa": "abcdeé", "bb": "bcdfgñ", "cc": "vwxyzü"}
    rows = [(i, _language(rng, letters[k], rng.randint(3, 400)), k) for i in range(400) for k in [rng.choice(list(letters))]]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "123 !?", "bb"), (503, "dcb ñ gfd cbf", None), (None, rows[0][1], rows[0][2]),
             (504, _language(rng, letters["cc"], 20000), "cc"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: k for i, _, k in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 50
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] in (500, 501, 502)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_known_share_counts_byte_pairs(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcé", k=rng.choice([0, 1, 2, 30, 200]))).encode() for _ in range(60)]
    pairs = np.zeros(1 << 16, bool)
    seen = {p for t in texts[::3] for p in zip(t, t[1:], strict=False)}
    for a, b in seen:
        pairs[a << 8 | b] = True
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes + 3
    data = np.frombuffer(b"xyz" + b"".join(texts) + b"!", np.uint8)
    want = [sum(p in seen for p in zip(t, t[1:], strict=False)) / max(1, len(t) - 1) for t in texts]
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(langid, "PAIRS_AT_ONCE", size)
        assert np.allclose(langid.known_share(pairs, data, starts, sizes), want)


def test_gradients_and_segments():
    rng = np.random.default_rng(2)
    table, recurrent = rng.normal(size=(256, 24)), rng.normal(size=(8, 24)) * 0.3
    x = rng.integers(0, 5, (6, 3)).astype(np.uint8)
    weight = rng.normal(size=(6, 3, 8))

    def loss(t, r):
        return float((langid._run(x, t.astype(np.float64), r.astype(np.float64))[0] * weight).sum())

    _, kept = langid._run(x, table, recurrent)
    d_table, d_recurrent = langid._back(kept, weight, recurrent)
    for array, gradient, name in ((table, d_table, 0), (recurrent, d_recurrent, 1)):
        for at in [(1, 3), (2, 12), (3, 20)]:
            up, down = array.copy(), array.copy()
            up[at] += 1e-3
            down[at] -= 1e-3
            pair = (loss(up, recurrent), loss(down, recurrent)) if name == 0 else (loss(table, up), loss(table, down))
            assert gradient[at] == pytest.approx((pair[0] - pair[1]) / 2e-3, rel=2e-2, abs=2e-3)
    net = langid.new_network(["x", "y"])
    text = rng.integers(97, 123, 700).astype(np.uint8)
    twice = np.concatenate([text, text[:10]])
    p = langid.probabilities(net, twice, np.array([0, 700]), np.array([700, 10]))
    assert p.sum(1) == pytest.approx([1, 1], abs=1e-4)
    assert langid.probabilities(net, text, np.array([0]), np.array([700]))[0] == pytest.approx(p[0])
