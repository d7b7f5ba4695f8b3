"""Find the worksheet that belongs to the last document of a bundle.

Cells arrive as rows: ``folder, workbook, sheet_idx, sheet_name, value``.  A number of
digits only is compared with the digit runs of a cell, any other number with the
letters and digits of the whole cell, in both directions.  Cells look their numbers up
in an index of the folder's numbers (:mod:`containment`) and leave only as hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import containment
from .scale import cut_lineage


def sheet_match(targets: DataFrame, cells: DataFrame, workbooks: DataFrame) -> DataFrame:
    """``pdf_id, folder, workbook, sheet_name, n_candidates, reason`` per bundle.

    ``targets(pdf_id, folder, invoice_number)`` names the last document of a bundle,
    ``workbooks(folder, workbook)`` the spreadsheets beside it; only a folder with
    exactly one is searched.  The last matching sheet wins.
    """
    # read by several steps, as the numbers are
    single = cut_lineage(workbooks.where(~F.startswith(text.base_name("workbook"), F.lit("~$")))
                         .groupBy("folder").agg(F.count(F.lit(1)).alias("n_books"), F.min("workbook").alias("workbook")))
    digits, norm = F.col("digits"), F.col("norm")
    wanted = cut_lineage(targets.select("pdf_id", "folder", text.pure_digit_key("invoice_number").alias("digits"),
                                        text.ascii_alnum("invoice_number").alias("norm"))
                         .withColumn("norm", F.when(digits.isNull() & (norm != ""), norm)))

    numbers = wanted.select("folder", digits, norm).where(digits.isNotNull() | norm.isNotNull()).distinct()
    open_ = single.where(F.col("n_books") == 1).select("folder", F.col("workbook").alias("_book"))
    asked = open_.join(numbers.select("folder").distinct(), "folder", "left_semi")
    texts = (cells.join(asked, "folder").where(F.col("workbook") == F.col("_book"))
             .select("folder", F.col("sheet_idx").cast("int").alias("sheet_idx"), "sheet_name", text.strip("value").alias("_v"))
             .where(F.col("_v") != "")
             .select("folder", "sheet_idx", "sheet_name", text.ascii_alnum("_v").alias("norm"), text.digit_runs("_v").alias("runs")))
    # hits are grouped by a value of their own, so a folder with very many cells stays free to be split
    target = F.struct("folder", "digits", "norm").alias("target")
    hits = containment.hits(texts, numbers.join(asked, "folder", "left_semi")).select(target, "sheet_idx", "sheet_name")
    found = (hits.groupBy("target").agg(F.max_by("sheet_name", "sheet_idx").alias("sheet_name"),
                                        F.count(F.lit(1)).alias("n_candidates")).select("target.*", "sheet_name", "n_candidates"))
    alike = [wanted[c].eqNullSafe(found[c]) for c in ("digits", "norm")]
    best = (wanted.join(found, [wanted["folder"] == found["folder"], *alike])
            .select("pdf_id", "sheet_name", "n_candidates"))
    out = wanted.select("pdf_id", "folder").join(single, "folder", "left").join(best, "pdf_id", "left")
    n = F.coalesce("n_books", F.lit(0))
    return out.select(
        "pdf_id", "folder", F.when(n == 1, F.col("workbook")).alias("workbook"), "sheet_name",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(n == 0, "no Excel file in folder").when(n > 1, "multiple Excel files found")
        .when(F.col("sheet_name").isNull(), "no sheet matched the invoice number").alias("reason"))
