"""Reference sheets whose columns are found by their titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _has(*words: str) -> Callable[[str], bool]:
    return lambda c: all(w in c.lower() for w in words)


ENTITY_COLUMNS = {
    "le": lambda c: c.strip().upper() == "LEGAL ENTITY (LE)", "bill_to_name": _has("bill", "name"),
    "source_site": _has("source", "site"), "country": lambda c: c.strip().lower() == "country"}
VN_COLUMNS = {"supplier_id": _has("supplier", "id"), "supplier_name": _has("supplier", "name")}
ROUTING_COLUMNS = {"source_site": _has("source", "site"), "appo": _has("appo"), "tidecr": _has("tide")}
ROUTING_OPTIONAL = {"nonpo": lambda c: "non po" in c.lower() or "nonpo" in c.lower(),
                    "archive": _has("archive"), "rits": _has("rits")}


def resolve_columns(df: DataFrame, required: dict, optional: dict | None = None, keep: tuple = ()) -> DataFrame:
    """Select and rename the first column that satisfies each test.

    Fails naming the columns found when a required one is missing; a missing optional
    column becomes null.
    """
    def first(test):
        return next((c for c in df.columns if test(c)), None)

    out = [F.col(f"`{k}`") for k in keep]
    for name, test in required.items():
        at = first(test)
        if at is None:
            raise ValueError(f"no column for {name!r} among {df.columns}")
        out.append(F.col(f"`{at}`").cast("string").alias(name))
    for name, test in (optional or {}).items():
        at = first(test)
        out.append((F.col(f"`{at}`") if at else F.lit(None)).cast("string").alias(name))
    return df.select(*out)


def vn_sheet(df: DataFrame, ord_col: str) -> DataFrame:
    """Supplier list; the first column that is neither id nor name is the other name."""
    taken = [next(c for c in df.columns if VN_COLUMNS[k](c)) for k in VN_COLUMNS]
    rest = [c for c in df.columns if c not in taken and c != ord_col]
    alt = (lambda c: c == rest[0]) if rest else (lambda c: False)
    return resolve_columns(df, VN_COLUMNS, {"alt_name": alt}, keep=(ord_col,))

