"""Personal data: rule spans, and further spans chosen by weak supervision.

Base spans (email, ip, card, phone) follow fixed rules and always stay.  Further candidates (``CANDIDATES``: looser
shapes that may or may not be personal data) are voted on by labelers of three kinds:

* regex labelers look at the candidate's own shape,
* gazetteer labelers look its parts up in short lists,
* context labelers look at the words around it.

Each votes +1, -1 or abstains.  Votes of all candidates are counted per kind and pattern, which is at most a few
thousand rows however large the corpus is.  Expectation-maximisation over these counts estimates each labeler's
reliability and each pattern's probability; those probabilities then train the final span classifier, a logistic
regression over the candidate's features, again on counts per feature pattern.  So both models see every candidate of
the whole table.  Candidates whose probability reaches ``THRESHOLD`` become spans.  Where no candidate exists, or no
labeler ever voted for a kind, nothing is added.

The texts are read once: the scan stores spans and candidates, and the models are applied to what it stored.

Defined results: a null text counts as empty and has no spans; rows are kept as they are, null and repeated ids too;
an empty table gives no rows; extra columns are ignored; where spans of the classifier overlap a base span or an
earlier one, they are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_words", "phone_bare", "ssn", "iban", "name")
THRESHOLD = 0.9

# Shapes of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Shapes of the further candidates.
CANDIDATES = {
    "email_words": re.compile(r"\b[a-z0-9._-]{2,40} (?:at|\(at\)|\[at\]) [a-z0-9-]{2,40} (?:dot|\(dot\)|\[dot\]) [a-z]{2,10}\b", re.I),
    "phone_bare": re.compile(r"(?<![0-9+.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? [A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)?"),
}
# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io info de fr es uk eu".split())
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25}
FIRST_NAMES = frozenset("anna ben carlos claire david emma eva hans jean john jose karl laura lucas luis maria marie "
                        "martin mary michael paul peter pierre sarah sofia thomas".split())
CONTEXT = {
    "email_words": ("mail", "contact", "write", "reach"),
    "phone_bare": ("call", "phone", "tel", "mobile", "fax", "dial"),
    "ssn": ("ssn", "social security", "tax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "name": ("regards", "dear", "contact", "signed", "attn", "from"),
}
AGAINST = ("version", "isbn", "order no", "part no", "serial", "figure", "page")
LABELERS = ("shape", "gazetteer", "context", "against")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, dotted domain, in linear time: a match holds exactly one @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots, from the left of each dotted chain; kept if none is above 255."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    doubled = (d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _DIGITS.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
            yield match.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    return [(kind, s, e) for kind, find in zip(KINDS, (emails, addresses, cards, phones), strict=True)
            for s, e in find(text)]


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    digits = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return int(digits) % 97 == 1


def votes(kind: str, text: str, s: int, e: int) -> tuple[int, int, int, int]:
    """Votes of the labelers in the order of ``LABELERS``: 1, -1, or 0 for none."""
    value, around = text[s:e], text[max(0, s - 40):s].lower()
    shape = gazetteer = 0
    if kind == "email_words":
        tld = value.split()[-1].lower()
        shape = 1 if "(" in value or "[" in value else 0
        gazetteer = 1 if tld in TOP_DOMAINS else -1
    elif kind == "phone_bare":
        separators = {c for c in value if c in " .-"}
        shape = 1 if len(separators) == 1 or "(" in value else -1
        gazetteer = -1 if re.sub("[^0-9]", "", value)[0] in "01" else 0
    elif kind == "ssn":
        shape = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 0
    elif kind == "iban":
        shape = 1 if _iban_ok(value) else -1
        gazetteer = 1 if IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else -1
    elif kind == "name":
        words = value.lower().split()[1:]
        shape = 1 if len(words) == 2 else 0
        gazetteer = 1 if words[0] in FIRST_NAMES else -1
    context = 1 if any(w in around for w in CONTEXT[kind]) else 0
    against = -1 if any(w in around for w in AGAINST) else 0
    return shape, gazetteer, context, against


def features(kind: str, text: str, s: int, e: int) -> int:
    """Bits of the span classifier: shape, length and neighbours, but no vote and no list."""
    value = text[s:e]
    before, after = text[s - 1:s], text[e:e + 1]
    bits = (any(c.isdigit() for c in value), any(c in "()[]" for c in value), "-" in value, "." in value,
            len(value) > 16, before in ("", " ", "\n"), after in ("", " ", "\n"), after in (".", ",", ";"),
            ":" in text[max(0, s - 3):s], any(c in text[max(0, s - 12):s].lower() for c in ("tel", "mail", "call", "nr", "no")))
    return sum(1 << i for i, b in enumerate(bits) if b)


N_FEATURES = 10


def more_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, pattern in CANDIDATES.items():
        for match in pattern.finditer(text):
            yield kind, *match.span()


SCAN_SCHEMA = ("base array<struct<kind:string,s:long,e:long>>, base_sha256 string, "
               "more array<struct<kind:string,s:long,e:long,votes:string,bits:long>>")


def _scan(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Base spans and voted candidates per row, in Arrow batches."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
    more_type = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()),
                                    ("votes", pa.string()), ("bits", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = {0: "0", 1: "+", -1: "-"}
        for batch in batches:
            bases, digests, mores = [], [], []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py() or ""
                base = base_spans(t)
                bases.append([{"kind": k, "s": s, "e": e} for k, s, e in base])
                digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                more, taken = [], [(s, e) for _, s, e in base]
                for k, s, e in more_candidates(t):
                    if all(e <= a or b <= s for a, b in taken):
                        taken.append((s, e))
                        more.append({"kind": k, "s": s, "e": e, "bits": features(k, t, s, e),
                                     "votes": "".join(sign[v] for v in votes(k, t, s, e))})
                mores.append(more)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bases, base_type), pa.array(digests, pa.string()),
                 pa.array(mores, more_type)],
                names=[*batch.schema.names[:-1], "base", "base_sha256", "more"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(SCAN_SCHEMA).fields]))


def label_model(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with counts: (probability per pattern, reliability per labeler).

    A labeler of reliability r votes right with probability r.  Reliabilities start at 0.7 and are smoothed by ten
    imagined votes at that rate, so a labeler that seldom votes keeps it.
    """
    v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in patterns], float)
    right, prior = np.full(v.shape[1], 0.7), 0.5
    p = np.full(len(v), 0.5)
    for _ in range(rounds):
        weight = np.log(right) - np.log1p(-right)
        p = 1 / (1 + np.exp(-(v @ weight + np.log(prior) - np.log1p(-prior))))
        voted = np.abs(v) * counts[:, None]
        agreed = (voted * np.where(v > 0, p[:, None], 1 - p[:, None])).sum(0)
        right = np.clip((agreed + 7) / (voted.sum(0) + 10), 0.55, 0.99)
        prior = np.clip((p @ counts + 1) / (counts.sum() + 2), 0.05, 0.95)
    p = np.where(np.abs(v).sum(1) == 0, 0.0, p)  # nobody voted: no evidence
    return p, right


def span_classifier(bits: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression (last: constant) on probabilities as targets, weighted by counts."""
    x = np.column_stack([(bits[:, None] >> np.arange(N_FEATURES)) & 1, np.ones(len(bits))]).astype(float)
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (p - target)) + 1e-3 * w)
    return w


def fitted(candidates: DataFrame) -> dict[tuple[str, str, int], float]:
    """(kind, votes, bits) -> probability; the counts that come to the driver have at most
    5 kinds x 81 vote patterns x 1,024 feature patterns."""
    rows = (candidates.select(F.explode("more").alias("c"))
            .groupBy("c.kind", "c.votes", "c.bits").count().collect())
    out: dict[tuple[str, str, int], float] = {}
    for kind in MORE_KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        counts = np.array([r["count"] for r in own], float)
        patterns = sorted({r["votes"] for r in own})
        place = np.array([patterns.index(r["votes"]) for r in own])
        p, _ = label_model(patterns, np.bincount(place, counts, len(patterns)))
        bits = np.array([r["bits"] for r in own])
        w = span_classifier(bits, p[place], counts)
        x = np.column_stack([(bits[:, None] >> np.arange(N_FEATURES)) & 1, np.ones(len(bits))])
        final = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        # the classifier refines the label model: both must hold a span for likely
        for r, a, b in zip(own, p[place], final, strict=True):
            out[(kind, r["votes"], r["bits"])] = float(a * b) ** 0.5
    return out


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``keep``, ``base`` and ``spans`` (arrays of kind, s, e) and base_sha256."""
    scanned = stored(_scan(docs, text, keep), "pii")
    chosen = sorted(k for k, p in fitted(scanned).items() if p >= threshold)
    spans = F.transform("base", lambda m: F.struct(m.s.alias("s"), m.e.alias("e"), m.kind.alias("kind")))
    if chosen:
        keys = F.array(*[F.lit(f"{k}|{v}|{b}") for k, v, b in chosen])
        added = F.transform(
            F.filter("more", lambda m: F.array_contains(keys, F.concat_ws("|", m.kind, m.votes, m.bits))),
            lambda m: F.struct(m.s.alias("s"), m.e.alias("e"), m.kind.alias("kind")))
        spans = F.concat(spans, added)
    return scanned.select(*keep, "base", "base_sha256", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans as text: base kinds as listed, then the others by name."""
    order = {k: i for i, k in enumerate(KINDS + tuple(sorted(MORE_KINDS)))}

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m.kind == kind)).cast("long").alias(f"n_{kind}")

    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    listed = F.array_sort(F.transform("spans", lambda m: F.struct(
        ranks[m.kind].alias("rank"), m.s.alias("s"), m.e.alias("e"), m.kind.alias("kind"))))
    return found.select("doc_id", *[count(k) for k in KINDS], "base_sha256", F.array_join(
        F.transform(listed, lambda m: F.concat_ws(":", m.kind, m.s, m.e)), ",").alias("spans"))


def mask(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one."""
    # a row travels as one column, so no column of the input can clash with those added here
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = find(row, "text", ("row",), threshold)
    whole = F.col(f"row.`{text}`")
    merged = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, m: F.when(m.s < a["at"], F.struct(F.greatest(a["at"], m.e).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(m.e.alias("at"), F.concat(
            a["out"], F.substr(whole, a["at"] + 1, m.s - a["at"]), F.lit("<"), F.upper(m.kind), F.lit(">"))
            .alias("out"))),
        lambda a: F.concat(a["out"], F.substr(whole, a["at"] + 1)))
    masked = F.when(whole.isNull() | (F.size("spans") == 0), whole).otherwise(merged)
    return found.select(*[masked.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
