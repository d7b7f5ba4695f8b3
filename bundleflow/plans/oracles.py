"""Building blocks of the check SQL: the same rules written for a plain SQL engine."""

from __future__ import annotations

from ..functions import lexicon as lx
from . import projections as P


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in pairs.items()) + "}"


def ctes(**named: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in named.items())


# --- names ------------------------------------------------------------------
def _fold(x: str) -> str:
    return f"lower(strip_accents(translate({x}, 'Đđ', 'Dd')))"


def _words(folded: str, keep: str) -> str:
    spaced = f"replace({folded}, '&', ' & ')" if "&" in keep else folded
    return (f"list_filter(regexp_split_to_array(regexp_replace({spaced}, '[^{keep}\\s]', ' ', 'g'), '\\s+'), "
            f"lambda t: t <> '')")


def _expand(words: str, pairs: dict[str, str]) -> str:
    return f"list_transform({words}, lambda t: coalesce({sql_map(pairs)}[t], t))"


def _guard(x: str, key: str, fallback: bool) -> str:
    raw = f"trim(regexp_replace(lower(trim({x})), '\\s+', ' ', 'g'))"
    mid = f" WHEN ({key}) = '' THEN {raw}" if fallback else ""
    return f"(CASE WHEN {x} IS NULL OR lower(trim({x})) IN ('', 'nan', 'none') THEN ''{mid} ELSE {key} END)"


def name_key(x: str) -> str:
    words = _expand(_words(_fold(x), "a-z0-9&"), lx.ABBREVIATIONS)
    kept = f"list_filter({words}, lambda t: NOT list_contains({strings(lx.LEGAL_SUFFIXES)}, t))"
    return _guard(x, f"array_to_string({kept}, ' ')", True)


def entity_key(x: str) -> str:
    s = _fold(x)
    for pattern, form in lx.DOTTED_FORMS:
        s = f"regexp_replace({s}, {quote(pattern)}, {quote(form)}, 'g')"
    words = _expand(_expand(_words(s, "a-z0-9&"), lx.ABBREVIATIONS), lx.ENTITY_EXPANSIONS)
    return _guard(x, f"array_to_string({words}, ' ')", True)


def vn_key(x: str) -> str:
    return _guard(x, f"array_to_string({_expand(_words(_fold(x), 'a-z0-9'), lx.VN_EXPANSIONS)}, ' ')", False)


# --- similarity -------------------------------------------------------------
def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by rows of the usual table."""
    return f"""list_reduce(
  list_prepend({{'ch': '', 'r': list_transform(range(0, length({b}) + 1), lambda x: 0)}},
    list_transform(string_split({a}, ''), lambda x: {{'ch': x, 'r': [0]}})),
  lambda p, q: {{'ch': q.ch, 'r': list_reduce(
    list_prepend({{'j': 0, 'r': [0]}},
      list_transform(range(1, length({b}) + 1), lambda j: {{'j': j::INTEGER, 'r': [0]}})),
    lambda u, v: {{'j': v.j, 'r': list_append(u.r,
      CASE WHEN {b}[v.j] = q.ch THEN p.r[v.j] + 1 ELSE greatest(p.r[v.j + 1], u.r[v.j]) END)}}).r}}).r[-1]"""


def ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return f"((1.0::DOUBLE - ({total} - 2 * {lcs(a, b)})::DOUBLE / {total}) * 100)"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def ratio_scores(pairs: str) -> dict[str, str]:
    """CTE ``rs(a, b, score)`` over ``pairs(a, b)``."""
    return {"rs": f"SELECT a, b, {ratio('a', 'b')} AS score FROM {pairs}"}


def token_sort_scores(pairs: str) -> dict[str, str]:
    """CTE ``ts(a, b, score)`` over distinct non-empty ``pairs(a, b)``."""
    return {
        "ts0": f"SELECT a, b, {sorted_tokens('a')} AS sa, {sorted_tokens('b')} AS sb FROM {pairs}",
        "ts": f"SELECT a, b, {ratio('sa', 'sb')} AS score FROM ts0"}


def partial_scores(pairs: str) -> dict[str, str]:
    """CTE ``ps(a, b, score)``: every window of the longer side is a row."""
    return {
        "ps0": f"""SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s,
                   CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM {pairs}
                   UNION SELECT a, b, b, a FROM {pairs} WHERE length(a) = length(b)""",
        "ps1": """SELECT DISTINCT s, substring(l, greatest(k, 0)::INT + 1,
                  (least(k + length(s), length(l)) - greatest(k, 0))::INT) AS t, a, b
                  FROM ps0, unnest(range(1 - length(s), length(l))) AS u(k)""",
        "ps2": f"SELECT s, t, {ratio('s', 't')} AS score FROM (SELECT DISTINCT s, t FROM ps1)",
        "ps": "SELECT a, b, max(score) AS score FROM ps1 JOIN ps2 USING (s, t) GROUP BY a, b"}


def token_set_scores(pairs: str) -> dict[str, str]:
    """CTE ``tt(a, b, score)`` over distinct non-empty ``pairs(a, b)``."""
    return {
        "tt0": f"""SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y
                   FROM {pairs}""",
        "tt1": """SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS xy,
                  array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS xo,
                  array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS yo FROM tt0""",
        "tt2": f"""SELECT a, b, xy, xo, yo, CASE WHEN xo = '' OR yo = '' THEN 0 ELSE {lcs('xo', 'yo')} END AS l,
                   length(xy) + CASE WHEN xy <> '' THEN 1 ELSE 0 END AS g FROM tt1""",
        "tt": """SELECT a, b, CASE WHEN xy <> '' AND (xo = '' OR yo = '') THEN 100.0::DOUBLE
                 WHEN xy = '' THEN 100 - 100 * (length(xo) + length(yo) - 2 * l)::DOUBLE / (length(xo) + length(yo))
                 ELSE greatest(
                   100 - 100 * (length(xo) + length(yo) - 2 * l)::DOUBLE / (2 * g + length(xo) + length(yo)),
                   100 - 100 * (1 + length(xo))::DOUBLE / (2 * length(xy) + 1 + length(xo)),
                   100 - 100 * (1 + length(yo))::DOUBLE / (2 * length(xy) + 1 + length(yo))) END AS score FROM tt2"""}


# --- segmentation -----------------------------------------------------------
def roles(ok: str = "coalesce(supplier_name_on_page = key_supplier, false)") -> dict[str, str]:
    """CTEs up to ``roles(pdf_id, page_idx, rule, invoice_index, ...)``."""
    return {
        "sig": P.ansi(P.SIGNALS),
        "k": """SELECT *, first_value(supplier_name_on_page IGNORE NULLS) OVER (PARTITION BY pdf_id ORDER BY page_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS key_supplier,
                regexp_replace(lower(invoice_number), '[^a-z0-9]', '', 'g') AS norm_num FROM sig""",
        "e": f"SELECT *, {ok} AS supplier_ok FROM k",
        "e2": "SELECT *, CASE WHEN supplier_ok AND norm_num IS NOT NULL THEN norm_num END AS elig FROM e",
        "s": """SELECT *, CASE WHEN elig IS NOT NULL AND elig IS DISTINCT FROM
                  last_value(elig IGNORE NULLS) OVER (PARTITION BY pdf_id ORDER BY page_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS is_start FROM e2""",
        "i": """SELECT *, sum(is_start) OVER (PARTITION BY pdf_id ORDER BY page_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inv_ord,
                sum(is_start) OVER (PARTITION BY pdf_id) AS n_inv,
                last_value(elig IGNORE NULLS) OVER (PARTITION BY pdf_id ORDER BY page_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_num FROM s""",
        "roles": """SELECT *, split_part(rule, '_', 1) AS role FROM (SELECT *,
                  CASE WHEN n_inv = 0 THEN 'main_fallback'
                       WHEN NOT read_ok AND inv_ord = 0 THEN 'dropped'
                       WHEN NOT read_ok THEN 'support_unknown'
                       WHEN supplier_ok AND norm_num IS NULL AND inv_ord = 0 THEN 'support_pending'
                       WHEN supplier_ok AND norm_num IS NULL THEN 'support'
                       WHEN is_start = 1 THEN 'main_start'
                       WHEN inv_ord = 0 THEN 'dropped'
                       WHEN norm_num = cur_num THEN 'main' ELSE 'support' END AS rule,
                  CAST(CASE WHEN n_inv = 0 THEN 1
                       WHEN inv_ord = 0 AND supplier_ok AND norm_num IS NULL THEN 1
                       ELSE inv_ord END AS INT) AS invoice_index FROM i)"""}
