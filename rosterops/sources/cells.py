"""Cell grids to bound tables.

A workbook arrives as a long table ``cells(workbook, sheet, row_no, col_no, raw, kind)``.
Headers are found, bound and checked with joins and aggregates per sheet; the pivot runs
with a known header list, so it is one aggregate with partial combine per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import clean, strip_spaces

CELL_COLUMNS = ["workbook", "sheet", "row_no", "col_no", "raw", "kind"]
SHEET = ["workbook", "sheet"]


def to_cells(wide: DataFrame, workbook: Column, sheet: Column, row_no: Column, columns: list[str]) -> DataFrame:
    """Long cells of a wide table; the header row must already be a row of it."""
    cells = F.array(*(F.struct(F.lit(i).alias("col_no"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)))
    return wide.select(workbook.alias("workbook"), sheet.alias("sheet"), row_no.alias("row_no"), F.explode(cells).alias("c")).select(
        "workbook", "sheet", "row_no", "c.col_no", "c.raw", F.lit("s").alias("kind"))


def drop_blank_rows(cells: DataFrame) -> DataFrame:
    """Keep rows that hold at least one non-blank cell; row numbers stay true."""
    filled = cells.filter(clean("raw") != "").select(*SHEET, "row_no").distinct()
    return cells.join(filled, [*SHEET, "row_no"], "left_semi")


def header_text(raw, inner_spaces: bool = True) -> Column:
    return clean(raw) if inner_spaces else strip_spaces(raw)


def header_row_all(cells: DataFrame, required: list[str], at_least: int | None = None, inner_spaces: bool = True) -> DataFrame:
    """First row per sheet that holds all (or ``at_least``) required headers."""
    need = len(set(required)) if at_least is None else at_least
    text = header_text("raw", inner_spaces)
    found = cells.filter(text.isin(required)).groupBy(*SHEET, "row_no").agg(F.countDistinct(text).alias("n"))
    return found.filter(F.col("n") >= need).groupBy(*SHEET).agg(F.min("row_no").alias("header_row"))


def header_row_fixed(cells: DataFrame, row_no: int) -> DataFrame:
    """The same header row for every sheet: the first, the second or a chosen one."""
    return cells.select(*SHEET).distinct().withColumn("header_row", F.lit(row_no))


def header_map(cells: DataFrame, header_rows: DataFrame, inner_spaces: bool = True) -> DataFrame:
    """Header text to column per sheet; the first occurrence wins."""
    at = cells.join(header_rows, SHEET).filter(F.col("row_no") == F.col("header_row"))
    named = at.withColumn("header", header_text("raw", inner_spaces)).filter(F.col("header") != "")
    return named.groupBy(*SHEET, "header", "header_row").agg(F.min("col_no").alias("col_no"))


def bind(cells: DataFrame, headers: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows below the header as named text columns, lineage kept."""
    body = cells.join(headers.filter(F.col("header").isin(wanted)), [*SHEET, "col_no"]).filter(
        F.col("row_no") > F.col("header_row"))
    return body.groupBy(*SHEET, "row_no").pivot("header", wanted).agg(F.first("raw"))


def missing_headers(headers: DataFrame, required: list[str], sheets: DataFrame) -> DataFrame:
    """Required headers a sheet does not have, one row each."""
    wanted = F.explode(F.array(*(F.lit(h) for h in required)))
    asked = sheets.select(*SHEET).distinct().withColumn("header", wanted)
    return asked.join(headers.select(*SHEET, "header"), [*SHEET, "header"], "left_anti")


def require_headers(headers: DataFrame, required: list[str], sheets: DataFrame, label: str) -> None:
    """Raise with the missing headers; there are at most ``len(required)``."""
    lost = missing_headers(headers, required, sheets).select("header").distinct().collect()
    if lost:
        names = "、".join(sorted(r["header"] for r in lost))
        raise ValueError(f"{label}缺少必要表头：{names}。")


def fuzzy_column(headers: DataFrame, keyword: str, fallback: int) -> DataFrame:
    """Leftmost column whose header equals or contains a keyword, else ``fallback``."""
    hit = headers.filter(F.contains(strip_spaces("header"), F.lit(keyword)))
    best = hit.groupBy(*SHEET).agg(F.min("col_no").alias("hit"))
    return headers.select(*SHEET).distinct().join(best, SHEET, "left").select(
        *SHEET, F.coalesce("hit", F.lit(fallback)).alias("col_no"))


def sheets_by_alias(sheets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Role of a sheet by its name, whitespace ignored; the first sheet wins a role.

    ``sheets``: workbook, sheet, sheet_no. ``aliases``: alias, role (a small dimension).
    """
    spelled = aliases.withColumn("_k", strip_spaces("alias"))
    hit = sheets.withColumn("_k", strip_spaces("sheet")).join(spelled, "_k")
    return hit.groupBy("workbook", "role").agg(F.min(F.struct("sheet_no", "sheet")).getField("sheet").alias("sheet"))


def people_sheet(sheets: DataFrame, headers: DataFrame, required: list[str], preferred: str, ignored: list[str]) -> DataFrame:
    """The named people sheet, else the first one that has the required headers."""
    full = headers.filter(F.col("header").isin(required)).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") == len(required))
    open_sheets = sheets.filter(~F.col("sheet").isin(ignored)).join(full, SHEET, "left_semi")
    ranked = sheets.filter(F.col("sheet") == preferred).withColumn("rank", F.lit(0)).unionByName(
        open_sheets.withColumn("rank", F.lit(1)))
    return ranked.groupBy("workbook").agg(F.min(F.struct("rank", "sheet_no", "sheet")).getField("sheet").alias("sheet"))


def unused_sheets(sheets: DataFrame, used: DataFrame) -> DataFrame:
    """Sheets no operator reads."""
    return sheets.join(used.select(*SHEET), SHEET, "left_anti")


def linked_cells(cells: DataFrame) -> DataFrame:
    """Hyperlink target and label of formula cells."""
    from rosterops.functions.text import link_target

    return cells.withColumn("link", link_target("raw")).filter(F.col("link.url").isNotNull()).select(
        *SHEET, "row_no", "col_no", "link.url", "link.label")
