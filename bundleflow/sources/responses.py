"""Typed page rows from the raw text of model responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from ..operators.scale import cut_lineage


def _objects(s: str):
    """Parsed top-level ``{...}`` spans of a text, in order."""
    depth = start = 0
    for at, ch in ((m.start(), m.group()) for m in re.finditer(r"[{}]", s)):
        if ch == "{":
            start = at if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                try:
                    yield json.loads(s[start: at + 1])
                except ValueError:
                    pass


def _picked(raw: str | None, required: str) -> dict | None:
    """The last object with the required key, else the last object."""
    if not raw:
        return None
    t = re.sub(r"<think>.*?</think>", "", raw, flags=re.DOTALL) if "<think>" in raw else raw
    if "`" in t:
        t = re.sub(r"```(?:json)?", "", t).replace("`", "")
    last = keyed = None
    for o in _objects(t):
        last = o
        if required in o:
            keyed = o
    return last if keyed is None else keyed


def pick_json(required: str):
    """Arrow UDF: the text of the object that :func:`_picked` finds."""
    def pick(raw: pd.Series) -> pd.Series:
        found = (_picked(t, required) for t in raw)
        return pd.Series([None if o is None else json.dumps(o, ensure_ascii=False) for o in found], dtype=object)

    pick.__annotations__ = {"raw": pd.Series, "return": pd.Series}
    return F.pandas_udf(pick, StringType())


def _text_or_none(x) -> bool:
    return x is None or isinstance(x, str)


def _sound(x: str | None) -> str | None:
    """JSON can name half characters, which no column holds."""
    return x if x is None else x.encode("utf-8", "replace").decode()


def _read_signals(o: dict | None) -> tuple:
    if o is None:
        return False, None, None
    supplier, number = o.get("supplier_name_on_page"), o.get("invoice_number")
    if not _text_or_none(supplier) or not (_text_or_none(number) or type(number) is int):
        return False, None, None
    return True, _sound(supplier), _sound(number if number is None else str(number))


def _read_fields(o: dict | None) -> tuple:
    if o is None:
        return False, None, None
    bill, pos = o.get("bill_to_client_name"), o.get("po_numbers", [])
    if not _text_or_none(bill) or not isinstance(pos, list) or not all(map(_text_or_none, pos)):
        return False, None, None
    return True, _sound(bill), [_sound(p) for p in pos]


def _typed(required: str, read, kind: str):
    """Arrow UDF: each response parsed once, into a struct ``ok, a, b``."""
    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(_picked(t, required)) for t in raw], columns=["ok", "a", "b"])

    parse.__annotations__ = {"raw": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(parse, f"ok boolean, a string, b {kind}")


def parse_signals(responses: DataFrame) -> DataFrame:
    """``page_signals`` from ``pdf_id, page_idx, raw_text``; wrong types fail the page."""
    rows = responses.withColumn("_o", _typed("supplier_name_on_page", _read_signals, "string")(F.col("raw_text")))
    return rows.select("pdf_id", "page_idx", F.col("_o.ok").alias("read_ok"), F.col("_o.a").alias("supplier_name_on_page"),
                       text.null_if_sentinel("_o.b").alias("invoice_number"))


def parse_fields(responses: DataFrame) -> DataFrame:
    """``page_fields`` from the same input; purchase orders must be a list of strings, none if the key is missing."""
    rows = responses.withColumn("_o", _typed("po_numbers", _read_fields, "array<string>")(F.col("raw_text")))
    none = F.array().cast("array<string>")
    return rows.select("pdf_id", "page_idx", F.col("_o.ok").alias("read_ok"), text.null_if_sentinel("_o.a").alias("bill_to"),
                       F.when(F.col("_o.ok"), F.coalesce(text.valid_pos("_o.b"), none)).alias("po_numbers"))


def page_readings(pages: DataFrame, signal_responses: DataFrame, field_responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``page_signals`` and ``page_fields``, the input of a run, for all ``pages(pdf_id, page_idx)``.

    A page has one response of each kind at most; without one it is a failed page.
    """
    wanted = cut_lineage(pages.select("pdf_id", "page_idx").distinct())  # met by both kinds

    def of_all(parsed: DataFrame) -> DataFrame:
        return (wanted.join(parsed, ["pdf_id", "page_idx"], "left")
                .withColumn("read_ok", F.coalesce("read_ok", F.lit(False))))

    return of_all(parse_signals(signal_responses)), of_all(parse_fields(field_responses))


def translations(responses: DataFrame) -> DataFrame:
    """``translations(src, dst)`` from ``src, raw_text``."""
    return responses.select("src", text.clean_translation("raw_text", "src").alias("dst"))
