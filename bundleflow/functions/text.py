"""Scalar text functions: ``Column -> Column``, built-in expressions throughout.

Only accent folding (NFKD) needs Python; it is an Arrow UDF that receives a value
only for rows with non-ASCII text, so plain-ASCII data never pays for it.

Regular expressions that mention ``\\s``, ``\\w``, ``\\b`` or ``\\d`` carry ``(?U)``:
the JVM's classes are ASCII-only without it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as lx

_WS = r"[\s\x1c-\x1f]"  # what str.split() and str.strip() treat as blank


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` worked out once."""
    return F.element_at(F.transform(F.array(x), body), 1)


# --- whitespace, nulls ------------------------------------------------------
def strip(x) -> Column:
    return F.regexp_replace(_c(x), f"(?U)^{_WS}+|{_WS}+$", "")


def collapse(x) -> Column:
    """Trim and turn every whitespace run into one space."""
    return strip(F.regexp_replace(_c(x), f"(?U){_WS}+", " "))


def raw_key(x) -> Column:
    """Lower-cased, whitespace-collapsed text; the key of last resort."""
    return collapse(F.lower(_c(x)))


tag_text = raw_key  # the same normal form serves keyword tagging


def null_if_sentinel(x) -> Column:
    x = _c(x)
    return F.when(~F.lower(strip(x)).isin(lx.NULL_SENTINELS), x)


def is_empty_name(x) -> Column:
    x = _c(x)
    return x.isNull() | F.lower(strip(x)).isin(lx.EMPTY_NAMES)


def non_ascii(x) -> Column:
    return F.coalesce(_c(x).rlike(r"[^\x00-\x7F]"), F.lit(False))


def blank_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(""))


# --- name normalization -----------------------------------------------------
def norm_alnum(x) -> Column:
    """Lower-case and keep letters and digits of every script."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    """Compatibility-decompose and drop combining marks."""
    def fold(v):
        if v is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return s.map(fold)


def fold_accents(x) -> Column:
    plain = F.translate(_c(x), "Đđ", "Dd")  # the stroke is not a combining mark
    return F.coalesce(nfkd_fold(F.when(non_ascii(plain), plain)), plain)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def _expand(tokens: Column, pairs: dict[str, str]) -> Column:
    table = _literal_map(pairs)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def _latin_words(folded: Column) -> Column:
    spaced = F.replace(folded, F.lit("&"), F.lit(" & "))
    return _tokens(collapse(F.regexp_replace(spaced, r"(?U)[^a-z0-9&\s]", " ")))


def _or_raw(key: Column, original: Column) -> Column:
    return F.when(is_empty_name(original), "").otherwise(F.coalesce(blank_to_null(key), raw_key(original)))


def normalize_name(x) -> Column:
    """Key for sensitive-supplier matching: abbreviations expanded, legal forms dropped."""
    x = _c(x)
    words = _expand(_latin_words(F.lower(fold_accents(x))), lx.ABBREVIATIONS)
    words = F.filter(words, lambda t: ~t.isin(lx.LEGAL_SUFFIXES))
    return _or_raw(F.array_join(words, " "), x)


def normalize_entity(x, canonical: dict[str, str] | None = None) -> Column:
    """Key for legal-entity matching: legal forms kept and spelled out.

    ``canonical`` maps a whitespace-free CJK name to its registered English form;
    it is part of the deployment's entity list.  CJK names outside it (three or
    more CJK characters) keep their script with all whitespace removed.
    """
    x = _c(x)
    stroke = F.translate(x, "Đđ", "Dd")
    is_cjk = F.size(F.regexp_extract_all(stroke, F.lit(lx.CJK_CLASS), F.lit(0))) >= 3
    packed = F.regexp_replace(stroke, f"(?U){_WS}+", "")
    english = F.try_element_at(_literal_map(canonical), packed) if canonical else F.lit(None).cast("string")
    latin = F.lower(fold_accents(F.when(is_cjk, english).otherwise(x)))
    for pattern, form in lx.DOTTED_FORMS:
        latin = F.regexp_replace(latin, f"(?U){pattern}", form)
    words = _expand(_expand(_latin_words(latin), lx.ABBREVIATIONS), lx.ENTITY_EXPANSIONS)
    key = F.when(is_cjk & english.isNull(), packed).otherwise(F.array_join(words, " "))
    return _or_raw(key, x)


def normalize_vn(x) -> Column:
    """Key for Vietnamese supplier names; a name without Latin content has no key."""
    x = _c(x)
    latin = F.regexp_replace(F.lower(fold_accents(x)), r"(?U)[^a-z0-9\s]", " ")
    words = _expand(_tokens(collapse(latin)), lx.VN_EXPANSIONS)
    return F.when(is_empty_name(x), "").otherwise(F.array_join(words, " "))


def clean_artifact(x) -> Column:
    """Drop spreadsheet cell references that leaked into text."""
    return collapse(F.regexp_replace(_c(x), f"(?U){lx.ARTIFACT_PATTERN}", ""))


def is_junk_alt(x) -> Column:
    s = strip(_c(x))
    return s.isNull() | F.lower(s).isin(lx.JUNK_ALT_NAMES) | (F.length(s) <= 2)


def is_junk_entity(x) -> Column:
    low = F.lower(strip(_c(x)))
    return F.exists(F.array(*map(F.lit, lx.JUNK_ENTITY_MARKS)), lambda m: F.contains(low, m))


# --- numbers in text --------------------------------------------------------
def po_numbers(x) -> Column:
    """Purchase-order numbers of a text, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(f"(?U){lx.PO_PATTERN}"), F.lit(1)))


def valid_pos(candidates) -> Column:
    """The same over an array of candidate strings."""
    found = F.transform(
        _c(candidates), lambda v: F.regexp_extract_all(v, F.lit(f"(?U){lx.PO_PATTERN}"), F.lit(1)))
    return F.array_distinct(F.flatten(F.filter(found, lambda v: v.isNotNull())))


def _drop_leading_zeros(x) -> Column:
    return F.regexp_replace(x, r"^0+(?!$)", "")


def digit_runs(x) -> Column:
    """Distinct digit runs of a text without their leading zeros."""
    runs = F.regexp_extract_all(_c(x), F.lit(r"(?U)(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(runs, _drop_leading_zeros))


def ascii_alnum(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def pure_digit_key(x) -> Column:
    """The number without separators and leading zeros, or null if it has a letter."""
    key = ascii_alnum(x)
    return F.when(key.rlike("^[0-9]+$"), _drop_leading_zeros(key))


# --- file and folder names --------------------------------------------------
def _strip_chars(x: Column, cls: str) -> Column:
    return F.regexp_replace(x, f"^[{cls}]+|[{cls}]+$", "")


def _or_fallback(safe: Column, fallback) -> Column:
    """A blank or missing text cleans to nothing and takes the fallback."""
    return F.coalesce(blank_to_null(safe), F.lit(fallback) if isinstance(fallback, str) else fallback)


def sanitize_result(x, fallback) -> Column:
    """Part of an output file name."""
    safe = _strip_chars(F.regexp_replace(strip(x), "[^A-Za-z0-9._-]+", "_"), "_.")
    return _or_fallback(F.substring(safe, 1, lx.NAME_LIMIT), fallback)


def _squeeze(x: Column) -> Column:
    safe = F.regexp_replace(x, r"[^A-Za-z0-9._\- ]+", "_")
    return _strip_chars(F.regexp_replace(safe, r"[\s_]+", "_"), r"._\-")


def sanitize_folder(x, fallback) -> Column:
    return _or_fallback(F.substring(_squeeze(strip(x)), 1, lx.NAME_LIMIT), fallback)


def file_suffix(x) -> Column:
    """Last extension of a path, with its dot; empty when there is none."""
    return F.regexp_extract(_c(x), r"[^/](\.[^./]+)/*$", 1)


def file_stem(x) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_extract(_c(x), r"(?:^|/)([^/]+?)(?:\.[^./]+)?/*$", 1)


def base_name(x) -> Column:
    return F.regexp_extract(_c(x), r"([^/]*)/*$", 1)


def sanitize_file(x, fallback) -> Column:
    """File name with its extension kept and only the stem shortened."""
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    raw = strip(x)
    suffix = F.regexp_extract(raw, r"[^/](\.[A-Za-z0-9]{1,10})$", 1)
    stem = _squeeze(F.regexp_replace(raw, r"(?<=[^/])\.[A-Za-z0-9]{1,10}$", ""))
    stem = F.coalesce(blank_to_null(stem), blank_to_null(file_stem(fb)), F.lit("file"))
    keep = F.greatest(F.lit(1), F.lit(lx.NAME_LIMIT) - F.length(suffix))
    return F.when(raw != "", F.concat(F.substring(stem, F.lit(1), keep), suffix)).otherwise(fb)


def sanitize_path_part(x) -> Column:
    return F.regexp_replace(
        strip(F.coalesce(blank_to_null(x), F.lit("unknown"))), r'[<>:"/\\|?*]', "_")


def sanitize_attachment(x, subject) -> Column:
    name = F.regexp_replace(_c(x), "[^a-zA-Z0-9.]", "_")
    head = F.coalesce(blank_to_null(F.substring(_c(subject), 1, 6)), F.lit("attached"))
    return F.when(F.substring_index(name, ".", 1) == "", F.concat(head, F.lit(".pdf"))).otherwise(name)


def output_stem(supplier, number, index) -> Column:
    """``<supplier>_<number>`` for a split document."""
    return F.concat_ws(
        "_", sanitize_result(supplier, "unknown_supplier"),
        sanitize_result(number, F.format_string("noinv_%02d", _c(index).cast("int"))))


def missing_fields(supplier_id, po_number, invoice_number) -> Column:
    """Why a supplier rename is impossible; null when nothing is missing."""
    fields = [("supplier_id", supplier_id), ("po_number", po_number), ("invoice_number", invoice_number)]
    gone = F.filter(
        F.array(*[F.when(F.coalesce(_c(c), F.lit("")) == "", n) for n, c in fields]), lambda v: v.isNotNull())
    return F.when(F.size(gone) > 0, F.concat(F.lit("missing required field(s): "), F.array_join(gone, ", ")))


def renamed_stem(supplier_id, po_number, invoice_number) -> Column:
    stem = F.concat(F.lit("ESD"), _c(supplier_id), F.lit(" PO"), _c(po_number), F.lit(" INV"), _c(invoice_number))
    return F.when(missing_fields(supplier_id, po_number, invoice_number).isNull(), stem)


def unsafe_path(x) -> Column:
    """True for a member path with a parent step or an absolute root."""
    slashed = F.replace(_c(x), F.lit("\\"), F.lit("/"))
    return F.startswith(slashed, F.lit("/")) | F.array_contains(F.split(slashed, "/"), "..")


# --- mail headers -----------------------------------------------------------
def parse_sender(x) -> Column:
    """``struct(sender_name, sender_email)`` from a From header."""
    x = _c(x)
    raw = strip(x)
    angled = F.regexp_extract(raw, r"<([^>]+)>", 1)
    before = F.regexp_extract(raw, r"(?s)^(.*?)<[^>]+>", 1)
    bare = F.regexp_extract(raw, r"(?U)([\w.+-]+@[\w-]+\.[\w.-]+)", 1)
    rest = strip(F.replace(raw, bare, F.lit("")))

    def unquoted(c):
        return _strip_chars(c, '"')

    name = (F.when(x.isNull() | (x == ""), "")
            .when(angled != "", strip(unquoted(strip(before))))
            .when(bare != "", strip(_strip_chars(strip(unquoted(rest)), "<>")))
            .otherwise(unquoted(raw)))
    mail = F.when(angled != "", strip(angled)).when(bare != "", bare).otherwise("")
    return F.struct(name.alias("sender_name"), F.coalesce(mail, F.lit("")).alias("sender_email"))


_MAIL_DATE = (r"^\s*(?:[A-Za-z]+,)?\s*(\d{1,2})[\s-]+([A-Za-z]{3})[a-z]*[\s-]+(\d{4}|\d{2})\s+"
              r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[A-Za-z]{1,5}))?\s*(?:\(.*\))?\s*$")


def date_to_iso(x) -> Column:
    """RFC-2822 date as ISO text with its own offset; unreadable dates stay as they are."""
    x = _c(x)
    # one pass of the pattern; a text it does not match stays in one piece
    parts = F.split(F.regexp_replace(x, _MAIL_DATE, "$1|$2|$3|$4|$5|$6|$7"), r"\|", -1)
    return F.when(x.isNull(), "").otherwise(let(parts, lambda p: F.coalesce(_iso_from_parts(p), x)))


def _iso_from_parts(parts: Column) -> Column:
    def part(i):
        return F.try_element_at(parts, F.lit(i))

    month = F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(2))) + 2) / 3)
                   .cast("int").cast("string"), 2, "0")
    second = F.coalesce(blank_to_null(part(6)), F.lit("00"))
    zone = part(7)
    zones = F.create_map(*[F.lit(x) for pair in lx.MAIL_ZONES.items() for x in pair])
    # a zone that has no number is local time
    offset = (F.when(zone.isin("", "-0000"), "")
              .when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
              .otherwise(F.coalesce(F.try_element_at(zones, F.upper(zone)), F.lit(""))))
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(
        F.concat(F.when(part(3) > "68", "19").otherwise("20"), part(3)))
    local = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"),
                     F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), second)
    readable = (F.size(parts) == 7) & F.try_to_timestamp(local, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return F.when(readable, F.concat(local, offset))


def iso_to_timestamp(x) -> Column:
    return F.try_to_timestamp(_c(x))


# --- batch and run names ----------------------------------------------------
def day_letter(d) -> Column:
    return F.element_at(F.array(*map(F.lit, lx.DAY_LETTERS)), F.weekday(_c(d)) + 1)


def batch_id(entity, letter, counter, suffix, code: str = lx.CONFIG_CODE) -> Column:
    """``<entity>.<code><day><nn><suffix>``; the counter may grow past two digits."""
    return F.concat(_c(entity), F.lit(f".{code}"), letter, F.format_string("%02d", _c(counter)), suffix)


def report_name(prefix: str, date_dir, run_root) -> Column:
    return F.concat(F.lit(f"{prefix}_"), _c(date_dir), F.lit("_"),
                    F.regexp_replace(_c(run_root), "^run_", ""), F.lit(".xlsx"))


# --- model text -------------------------------------------------------------
def clean_translation(raw, source) -> Column:
    """Strip labels, quotes and an added full stop from a translation."""
    source = _c(source)
    label = r"(?iU)^(translation|translated( text| name)?|english( translation)?)\s*[:\-]\s*"
    bare = strip(F.regexp_replace(strip(F.regexp_replace(_c(raw), r"(?s)<think>.*?</think>", "")), label, ""))

    def unquote(t):
        return F.when(t.rlike(r"""(?s)^(['"]).*\1$""") & (F.length(t) >= 2),
                      strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    def unstop(t):
        return F.when(F.endswith(t, F.lit(".")) & ~F.endswith(source, F.lit(".")),
                      strip(F.regexp_replace(t, r"\.+$", ""))).otherwise(t)

    return F.coalesce(blank_to_null(let(let(bare, unquote), unstop)), source)


# --- page lists -------------------------------------------------------------
def format_runs(runs) -> Column:
    """``1–3, 5`` from an array of runs, a dash when it is empty."""
    runs = _c(runs)
    text = F.array_join(F.transform(runs, lambda r: F.when(
        r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(
        F.concat(r["lo"].cast("string"), F.lit("–"), r["hi"].cast("string")))), ", ")
    return F.when(F.coalesce(F.size(runs), F.lit(0)) > 0, text).otherwise("—")
