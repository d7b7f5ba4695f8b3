"""Periodic runs, ranked search and order MinHash against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundleflow.llm import best_position, order_minhash, runs


# periodic runs

def _plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                stretch = words[i:j + q]
                if all(any(stretch[x] != stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words, found):
    lost = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def _periodic_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        words = []
        while len(words) < rng.randint(0, 260):
            block = rng.choices("ab" if rng.random() < 0.4 else "abcdefgh", k=rng.randint(1, 30))
            words += (block * rng.randint(1, 9))[:rng.randint(1, 140)]
        texts.append(rng.choice([" ", "\n", " \t\x0b "]).join(words))
    x, y = [rng.choices("pqrstuvw", k=25) for _ in range(2)]
    block = x + x + x + y + x + y + y + y  # every 16-word gram of the block stands in it at least twice
    return texts + [" ".join(block * 4), " ".join(block * 4 + x), " ".join(["z"] * 3000), "é b c " * 30]


def test_runs_are_those_of_brute_force(spark):
    texts = _periodic_texts() + [None, "", " \n", "one", "a " * 23, "a " * 24, "a " * 24]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, 2), (None, "b " * 30, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int, start int")
    got = runs.find_runs(docs, keep=("doc_id", "text", "start")).collect()
    assert len(got) == len(rows) and sum(len(r["runs"]) > 1 for r in got) > 20
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want = _plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["n_words"] == len(words) and r["collapsed"] == _collapsed(words, want) and r["start"] == 2
    summary = runs.digest(runs.find_runs(docs)).collect()
    one = next(r for r in summary if r["doc_id"] is None)
    assert (one["n_runs"], one["start"], one["length"], one["period"], one["exponent_milli"]) == (1, 0, 30, 1, 30000)
    assert one["runs_sha256"] == hashlib.sha256(b"0,30,1\n").hexdigest()
    none = next(r for r in summary if r["doc_id"] == len(texts) - 5)
    assert none["n_runs"] == 0 and none["start"] is None and none["exponent_milli"] is None
    assert none["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_best_run_breaks_ties_by_start_then_period(spark):
    found = spark.createDataFrame(
        [(1, 90, [(0, 30, 10), (5, 24, 8), (40, 24, 8), (60, 30, 10)], "t")],
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    r = runs.digest(found).first()
    assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (0, 30, 10, 3000)


def test_repeated_text_follows_the_checksum(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefghijk", k=rng.randint(0, 80)))) for i in range(300)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", runs.repeated_text(F.col("text"), F.col("doc_id")).alias("new")).collect()
    changed = 0
    for r in got:
        words = (r["text"] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        assert (r["new"] or "").split() == words
    assert changed > 10


# ranked search

def _terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _plain_search(docs, items, k):
    tf = [(i, Counter(_terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, length = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c in tf:
            m = 100 - 90 + (90 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_postings, block_items", [(200, 3), (1 << 19, 512)])
def test_search_ranks_as_brute_force_does(spark, shard_postings, block_items):
    rng = random.Random(6)
    pool = ["w%d" % i for i in range(40)] + ["É", "é", "The", "the", "ß1", "a-b", "x_y"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(1, 60)))) for i in range(220)]
    docs += [(i + 500, docs[0][1]) for i in range(25)]  # ties
    docs += [(500, docs[0][1]), (500, docs[1][1]), (None, docs[2][1]), (900, None), (901, ""), (902, " .,!"), (903, "w1 " * 20000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(3, "w39 w1"), (20, None), (21, "?"), (22, "unheard of"), (23, docs[0][1]), (23, docs[0][1])]
    left = spark.createDataFrame([(i, t, "s", 1, "r") for i, t in docs], "doc_id long, text string, term string, tf int, row string")
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    found = best_position.search(left, right, shard_postings=shard_postings, block_items=block_items).collect()
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str)
    assert got == _plain_search(docs, items, 10)
    assert best_position.search(left.limit(0), right).count() == 0
    assert best_position.search(left, right.limit(0)).count() == 0


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(2)
    document = np.concatenate([rng.permutation(20000) for _ in range(3)])
    term = np.repeat(np.arange(3), 20000)
    impact = (1e6 / (1 + rng.permutation(60000))).astype(np.int64) + 1

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += max(0, at.stop - at.start)
            return np.asarray(self)[at]

    lists = best_position.Lists(document, term, impact, 3)
    lists.document = lists.document.view(Counted)
    documents, scores = lists.best([0, 1, 2], np.arange(20000), 10)
    total = np.bincount(document, impact)
    assert scores.tolist() == sorted(total.astype(int).tolist(), reverse=True)[:10]
    assert Counted.read < 6000


# order MinHash

def _plain_elements(text):
    size = min(8, len(text))
    count, out = Counter(), []
    for i in range(len(text) - size + 1 if size else 0):
        gram = text[i:i + size]
        out.append((gram, count[gram]))
        count[gram] += 1
    return out


def test_elements_number_the_occurrences():
    rng = random.Random(3)
    for _ in range(80):
        text = "".join(rng.choices("ab\U0001F600", k=rng.randint(0, 300)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        found, want = order_minhash.elements(points).tolist(), _plain_elements(text)
        assert len(found) == len(want) == len(set(found))
        other = text[::-1]
        mirrored = order_minhash.elements(np.frombuffer(other.encode("utf-32-le"), np.uint32).astype(np.uint64)).tolist()
        assert set(dict(zip(found, want, strict=True)).items()) >= {
            (h, e) for h, e in zip(mirrored, _plain_elements(other), strict=True) if h in set(found)}


def _plain_fingerprint(text):
    found = [int(x) for x in order_minhash.elements(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))]
    out = []
    for slot in range(order_minhash.SLOTS):
        a, b = int(order_minhash._FACTOR[slot]), int(order_minhash._SHIFT[slot])
        ranked = sorted(range(len(found)), key=lambda i: (((found[i] >> 32) * a + b) % 2**32, i))[:2]
        total = np.array([slot], np.uint64)
        for h in ([found[i] for i in sorted(ranked)] + [0, 0])[:2]:
            total = order_minhash.mix(total * order_minhash._P + np.array([h], np.uint64))
        out.append(int(total[0]) >> 32)
    return out


def test_fingerprint_takes_the_least_elements_in_text_order():
    rng = random.Random(4)
    for size in [0, 1, 7, 8, 9, 10, 40, 700, 9000]:
        text = "".join(rng.choices("abc de", k=size))
        assert order_minhash.fingerprint(text).tolist() == _plain_fingerprint(text)


def test_likeness_follows_edits_and_order():
    rng = random.Random(9)
    near, far, moved = [], [], []
    for _ in range(30):
        words = ["".join(rng.choices("abcdefghijklmno", k=6)) for _ in range(300)]
        text = " ".join(words)
        few = list(words)
        for i in rng.sample(range(300), 3):
            few[i] = "changed"
        many = list(words)
        for i in rng.sample(range(300), 40):
            many[i] = "changed"
        whole = order_minhash.fingerprint(text)
        near.append(order_minhash.likeness(whole, order_minhash.fingerprint(" ".join(few))))
        far.append(order_minhash.likeness(whole, order_minhash.fingerprint(" ".join(many))))
        moved.append(order_minhash.likeness(whole, order_minhash.fingerprint(" ".join(words[150:] + words[:150]))))
    assert np.mean(near) > 0.85 and 0.3 < np.mean(far) < 0.65
    # the same k-mers in another order: half of the pairs stand the other way round
    assert 0.35 < np.mean(moved) < 0.65


@pytest.mark.parametrize("block_rows", [1, 7, 1024])
def test_every_document_meets_its_next(spark, monkeypatch, block_rows):
    monkeypatch.setattr(order_minhash, "BLOCK_ROWS", block_rows)
    rng = random.Random(7)
    rows = [(i * 3, "".join(rng.choices("abc dé\U0001F600", k=rng.choice([0, 1, 5, 60, 300])))) for i in range(90)]
    rows += [(None, "no id"), (None, "none either"), (9, "again"), (9, "again"), (12, None), (-5, "x" * 50000)]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, block int")
    got = order_minhash.fingerprints(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    texts = sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == texts
    marks = {r["a"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "a string")
             .select("a", F.xxhash64("a").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), marks[r[1] or ""]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        a, b, c = (order_minhash.fingerprint(x) for x in (t, changed, after))
        want.append((str(i), t, changed, a.tobytes(), b.tobytes(), float((a == b).mean()), float((a == c).mean())))
    assert sorted((str(r[0]), *r[1:3], bytes(r[3]), bytes(r[4]), *r[5:]) for r in got) == sorted(want)
    one = order_minhash.digest(order_minhash.fingerprints(docs.where("doc_id = 27"))).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(rows[9][1])
    assert order_minhash.fingerprints(docs.limit(0)).count() == 0
