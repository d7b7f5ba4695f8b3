"""Secret scan through a trigram inverted index, in DataFrame operations only.

1. Every rule's regex is turned into a Boolean trigram query: a list of alternatives, each a set of trigrams that
   any match must contain (``trigram_query``).
2. The index has one posting (trigram, text key) per text and trigram of some query.  A text key is a 64-bit hash of
   the text: equal texts share postings, and a clash only adds a candidate that verification rejects.
3. Postings are intersected per alternative; alternatives and rules give the candidates of each text.
4. Candidates join the texts by key and the regex runs on them.  Rules with an alternative without trigrams
   (such as hex runs) scan every text.

Defined results: a null text counts as empty and has no spans; null or repeated ids are kept row by row, since rows
are joined by text; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import match_spans

try:  # the regex parser of the standard library
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` must have ``least`` characters, else a match is dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in the order in which ties of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # maximal runs of 24 or more are exactly the runs that survive the length test
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)


def _literal_runs(items) -> list[list[str]] | None:
    """Alternatives of a parsed regex, each the literal runs that a match contains in this order ("" ends a run)."""
    done: list[list[str]] = [[""]]

    def product(options: list[list[str]]) -> None:
        nonlocal done
        if len(done) * len(options) > MAX_ALTERNATIVES:
            options = [["", ""]]
        # the first run of an option continues the last run so far
        done = [left[:-1] + [left[-1] + right[0]] + right[1:] for left in done for right in options]

    for op, arg in items:
        if op is _c.LITERAL:
            product([[chr(arg).lower()]])
        elif op is _c.BRANCH:
            product([alternative for part in arg[1] for alternative in _literal_runs(part)])
        elif op is _c.SUBPATTERN:
            product(_literal_runs(arg[-1]))
        elif op is _c.IN and len(arg) <= 4 and all(kind is _c.LITERAL for kind, _ in arg):
            product([[chr(value).lower()] for _, value in arg])
        elif op is _c.MAX_REPEAT and arg[0] == 0:
            inner = _literal_runs(arg[2])
            product([[""]] + inner if arg[1] == 1 else [["", ""]])
        elif op is _c.MAX_REPEAT:
            product([option + [""] for option in _literal_runs(arg[2])] if arg[1] > 1 else _literal_runs(arg[2]))
        elif op is not _c.AT:
            product([["", ""]])
    return done


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Lower-case trigrams any match contains, one set per alternative; None if some alternative has none."""
    alternatives = {frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2))
                    for runs in _literal_runs(_p.parse(pattern))}
    if not all(alternatives):
        return None
    # an alternative that asks for more than another one adds nothing
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def trigram_postings(texts: DataFrame, trigrams: list[str], text: str, key: str) -> DataFrame:
    """(trigram, key): one row per distinct text and trigram, for the trigrams of the queries."""
    # lower() maps every ASCII letter to its lower case, so no match of either case is lost
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return texts.select(key, F.explode(found).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...], text: str, key: str) -> DataFrame:
    """(key, kinds): the rules whose Boolean query a text satisfies."""
    spark = texts.sparkSession
    terms = [(r.kind, n, t, len(alternative)) for r in rules
             for n, alternative in enumerate(trigram_query(r.pattern) or []) for t in sorted(alternative)]
    if not terms:
        return texts.select(key, F.array().cast("array<string>").alias("kinds")).limit(0)
    queries = spark.createDataFrame(terms, "kind string, alternative int, trigram string, terms int")
    postings = trigram_postings(texts, sorted({t[2] for t in terms}), text, key)
    # the query terms come from the rules alone, so their size is known
    return (postings.join(F.broadcast(queries), "trigram")
            .groupBy(key, "kind", "alternative", "terms").agg(F.count("*").alias("found"))
            .where("found = terms")
            .groupBy(key).agg(F.collect_set("kind").alias("kinds")))


def _verified(rule: Rule, text: Column) -> Column:
    return F.transform(
        F.filter(match_spans(text, rule.pattern, rule.group), lambda m: m["size"] >= rule.least),
        lambda m: F.struct(m.s.alias("s"), m.e.alias("e")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per input row: ``keep`` columns and ``found``, an array of (s, rank, e, kind) sorted by start, then rule."""
    work = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    work = work.withColumn("_key", F.xxhash64("_text"))
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    hits = candidates(work, tuple(r for r in rules if r.kind in indexed), "_text", "_key")
    work = work.join(hits, "_key", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    for r in rules:
        wanted = F.col("_text").rlike(r.pattern)
        if r.kind in indexed:
            wanted = F.array_contains("kinds", r.kind) & wanted
        work = work.withColumn(f"_{r.kind}", F.when(wanted, _verified(r, F.col("_text"))).otherwise(none))

    def listed(rank: int, rule: Rule) -> Column:
        return F.transform(f"_{rule.kind}", lambda m: F.struct(
            m.s.alias("s"), F.lit(rank).alias("rank"), m.e.alias("e"), F.lit(rule.kind).alias("kind")))

    return work.select(*keep, F.array_sort(F.concat(*[listed(i, r) for i, r in enumerate(rules)])).alias("found"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m.kind, m.s, m.e)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base rules, the SHA-256 of their spans, and all spans as text."""
    base = F.filter("found", lambda m: m["rank"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda m: m.kind == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(span_text(base), 256).alias("base_sha256"),
                          span_text(F.col("found")).alias("spans"))


def redact(text: str, spans: str) -> str:
    """Cut the spans (``kind:start:end`` joined by commas) out of a text; for spot checks on single rows."""
    for part in reversed([p for p in re.split(",", spans) if p]):
        kind, s, e = part.rsplit(":", 2)
        text = text[:int(s)] + f"[{kind}]" + text[int(e):]
    return text
