"""Keyword tags from names and mail text.

A document's text is its supplier, its bill-to and its message's subject and body.
The long part, the message, is searched once per message and not once per document.
A document contributes its own short text plus the first characters of the message:
only a phrase that starts in the names and ends in the message can be missed by
searching the two parts separately, and such a phrase reaches at most its own length
into the message.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import lexicon as lx
from ..functions import text
from ..functions.automaton import Patterns
from .scale import cut_lineage


def shortest_terms(terms) -> list[str]:
    """Lower-cased terms without those that contain another one of them."""
    low = sorted({t.lower() for t in terms}, key=lambda t: (len(t), t))
    kept: list[str] = []
    for t in low:
        if not any(k in t for k in kept):
            kept.append(t)
    return kept


TELECOM = shortest_terms(lx.TELECOM_TERMS)
UTILITY = shortest_terms(t for group in lx.UTILITY_TERMS.values() for t in group)
DIRECT_DEBIT = ["direct debit"]  # the other fixed term is upper case and never found
_REACH = max(map(len, (t.lower() for g in lx.UTILITY_TERMS.values() for t in g)))


@F.pandas_udf(IntegerType())
def _term_flags(texts: pd.Series) -> pd.Series:
    """1 telecom, 2 utility, 4 direct debit; texts are in normal form.

    Searching some 160 terms in a text costs the JVM one byte loop per term; Python's
    substring search is several times faster, batch transfer included.
    """
    def flags(t):
        if not t:
            return 0
        return (any(w in t for w in TELECOM) + 2 * any(w in t for w in UTILITY)
                + 4 * any(w in t for w in DIRECT_DEBIT))
    return pd.Series([flags(t) for t in texts], dtype="int32")


def _flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def joined_text(*parts) -> Column:
    """Non-empty parts joined by a blank, in normal form."""
    return text.tag_text(F.concat_ws(" ", *[text.blank_to_null(p) for p in parts]))


def is_telecom(x) -> Column:
    return _flag(_term_flags(text.tag_text(x)), 1)


def is_utility(x) -> Column:
    return _flag(_term_flags(text.tag_text(x)), 2)


def is_direct_debit(subject, body) -> Column:
    return _flag(_term_flags(joined_text(subject, body)), 4)


def tag_array(telecom, utility, debit) -> Column:
    """Tags in their fixed order."""
    return F.filter(F.array(F.when(telecom, "TELECOM"), F.when(utility, "UTILITY"), F.when(debit, "DD")),
                    lambda t: t.isNotNull())


def message_flags(messages: DataFrame, key: str) -> DataFrame:
    """One row per message: what its text says, and its opening characters."""
    m = messages.select(F.col(key), joined_text("subject", "body").alias("_text"))
    return m.select(key, _term_flags("_text").alias("m_flags"), F.substring("_text", 1, _REACH).alias("m_head"))


def derive_tags(documents: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Add ``tags``; documents without a message rely on their names alone."""
    joined = documents.join(message_flags(messages, key), key, "left")
    own = _term_flags(joined_text("supplier_name", "bill_to", "m_head"))
    found = joined.withColumn("_own", own).withColumn("m_flags", F.coalesce("m_flags", F.lit(0)))
    either = F.col("_own").bitwiseOR(F.col("m_flags"))
    return found.withColumn("tags", tag_array(_flag(either, 1), _flag(either, 2), _flag(F.col("m_flags"), 4))).drop(
        "_own", "m_flags", "m_head")


# --- evidence -----------------------------------------------------------------
TERMS = 100_000  # terms of one automaton


def lexicon_terms(spark: SparkSession) -> DataFrame:
    """The fixed terms as a table ``tag, language, term``, one place to extend them from."""
    rows = [("TELECOM", "any", t) for t in lx.TELECOM_TERMS] + [("DD", "any", t) for t in lx.DIRECT_DEBIT_TERMS]
    rows += [("UTILITY", language, t) for language, terms in lx.UTILITY_TERMS.items() for t in terms]
    return spark.createDataFrame(rows, "tag string, language string, term string")


def _evidence(terms: list[tuple]):
    """Hits of one block of terms in Arrow batches of (key, text)."""
    numbers: dict[str, list[int]] = {}
    for i, (_, _, term) in enumerate(terms):
        numbers.setdefault(term, []).append(i)
    words = list(numbers)

    def work(batches):
        known = Patterns((w, i) for i, w in enumerate(words))
        for batch in batches:
            at, tags, languages, found, firsts, counts = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                first: dict[int, int] = {}
                count: dict[int, int] = {}
                free: dict[int, int] = {}  # where the next occurrence may begin
                for start, end, n in sorted(known.places(t or "")):
                    first.setdefault(n, start)
                    if start >= free.get(n, 0):
                        count[n], free[n] = count.get(n, 0) + 1, end
                for n, start in first.items():
                    for i in numbers[words[n]]:
                        at.append(row)
                        tags.append(terms[i][0])
                        languages.append(terms[i][1])
                        found.append(terms[i][2])
                        firsts.append(start)
                        counts.append(count[n])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(tags, pa.string()), pa.array(languages, pa.string()),
                 pa.array(found, pa.string()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())],
                names=["key", "tag", "language", "term", "first_place", "n_places"])
    return work


def evidence(texts: DataFrame, key: str, body: str, terms: DataFrame, block: int = TERMS) -> DataFrame:
    """Which terms stand in which texts: ``key, tag, language, term, first_place, n_places``.

    ``terms(tag, language, term)`` are in lower case; others never stand in a text in normal form.  Places count characters of the text in normal form;
    occurrences of one term that overlap count once.  A text is walked once, whatever the number of terms; more than
    ``block`` terms make one more walk for each further block, so no task holds an unbounded automaton.
    """
    # texts are in lower case: a term with a capital cannot occur, blanks at a term's ends count
    kept = cut_lineage(terms.select("tag", "language", "term").where((F.col("term") != "") & (F.col("term") == F.lower("term")))
                       .distinct())
    blocks = max(1, -(-kept.count() // block))
    rows = texts.select(F.col(key).alias("key"), text.tag_text(body).alias("_text"))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        mine = [tuple(r) for r in kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()]  # about ``block``
        found = rows.mapInArrow(_evidence(mine), f"key {kind}, tag string, language string, term string, first_place int, n_places int")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def evident_tags(found: DataFrame, key: str) -> DataFrame:
    """``key, tags`` from evidence: the distinct tags of each text, in order of their names."""
    return found.groupBy(key).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
