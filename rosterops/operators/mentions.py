"""Who is mentioned where: roster names in free text, crosstabs, list annotation.

Names are found by the substring join; ``automaton_needles=0`` takes its way for rosters of
any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import clean
from rosterops.functions.tables import literal_table
from rosterops.operators.skew import attach
from rosterops.operators.substring import AUTOMATON_NEEDLES, containing


def roster_names(roster: DataFrame) -> DataFrame:
    """Distinct names with their first roster position and how often they occur."""
    named = roster.withColumn("name", clean("name")).filter(F.col("name") != "")
    return named.groupBy("name").agg(F.min("row_no").alias("roster_no"), F.count(F.lit(1)).alias("copies"))


def mentions(cells: DataFrame, roster: DataFrame, text: str, keep: list[str], automaton_needles: int = AUTOMATON_NEEDLES) -> DataFrame:
    """One row per cell and distinct roster name in it, with the first position.

    ``keep`` identifies a cell. Adds ``name, roster_no, copies, position`` (1-based). A
    name listed twice in the roster counts twice in the reports, which ``copies`` carries.
    """
    held = cells.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    hits = containing(roster_names(roster), held, "name", "_body", ["roster_no", "copies"], keep, automaton_needles=automaton_needles)
    return hits.withColumn("position", F.instr("_body", F.col("name"))).drop("_body")


def names_in_text_order(hits: DataFrame, key: list[str]) -> DataFrame:
    """Names of each cell ordered by first position, then by roster order."""
    entry = F.struct("position", "roster_no", "name")
    return hits.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("h")).select(
        *key, F.transform("h", lambda x: x["name"]).alias("names"))


def crosstab(hits: DataFrame, route: str) -> DataFrame:
    """Mention counts in long form: name, route, count; absent pairs have no row."""
    return hits.groupBy("name", route).agg(
        F.sum("copies").alias("mentions"), F.min("roster_no").alias("roster_no"))


def crosstab_wide(counts: DataFrame, route: str, routes: list[str]) -> DataFrame:
    """Wide report with the caller's route columns; a blank stands for zero."""
    wide = counts.groupBy("name", "roster_no").pivot(route, routes).agg(F.sum("mentions"))
    return wide.orderBy("roster_no", "name")


def route_order(cells: DataFrame, route: str) -> DataFrame:
    """Routes in first-seen order."""
    return cells.filter(clean(route) != "").groupBy(route).agg(F.min("row_no").alias("first_row"))


def unmatched_cells(cells: DataFrame, hits: DataFrame, key: list[str], text: str, note_chars: int | None = None) -> DataFrame:
    """Non-blank cells that name nobody, with their text as a note, cut to ``note_chars`` if given."""
    left = cells.filter(clean(text) != "").join(hits.select(*key).distinct(), key, "left_anti")
    whole = clean(text)
    return left.withColumn("note", whole if note_chars is None else F.substring(whole, 1, note_chars))


# Attention categories with priority and short label.
FOCUS_CATEGORIES = [
    ("重点关注", 1, "重点"), ("一般关注", 2, "一般"), ("预防性关注", 3, "预防"),
    ("三新人员（不上会）", 4, "三新"), ("长期关注", 5, "长期"),
]


def category_table(spark) -> DataFrame:
    return literal_table(spark, FOCUS_CATEGORIES, "category string, priority int, label string")


def sheet_category(sheets: DataFrame, categories: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Category of a sheet by containment in either direction; the first priority wins.

    ``categories`` is a dimension with a handful of rows.
    """
    names = sheets.select(sheet).distinct()
    hit = names.join(F.broadcast(categories), F.contains(names[sheet], categories["category"])
                     | F.contains(categories["category"], names[sheet]))
    best = hit.groupBy(sheet).agg(F.min(F.struct("priority", "category", "label")).alias("b"))
    return best.select(sheet, "b.category", "b.priority", "b.label")


def annotate(schedule: DataFrame, focus: DataFrame, name: str, row: str) -> DataFrame:
    """Append category labels to names on the schedule; unlisted rows keep their text.

    ``focus``: name, category, priority, label. A name has at most one entry per category
    after the distinct, so the collected list is bounded by the dimension.
    """
    listed = focus.withColumn("_k", clean("name")).select("_k", "priority", "category", "label").filter("_k <> ''").distinct()
    per_name = listed.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("priority", "category", "label"))).alias("c"))
    keyed = schedule.withColumn("_k", clean(name))
    sizes = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    joined = attach(keyed, sizes.join(per_name, "_k"), ["_k"], "_n", F.col(row))
    labels = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))), "")
    return joined.select(
        *schedule.columns, F.concat("_k", F.coalesce(labels, F.lit(""))).alias("annotated"),
        F.get("c", F.lit(0)).getField("category").alias("top_category"),
        F.transform("c", lambda x: x["category"]).alias("categories"))


def annotation_totals(annotated: DataFrame, sheet: str) -> DataFrame:
    """Matches per category and per sheet in long form."""
    hit = annotated.filter(F.col("top_category").isNotNull())
    by_category = hit.select(F.explode("categories").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by_sheet = hit.groupBy(F.col(sheet).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return by_category.select(F.lit("category").alias("scope"), "label", "n").unionByName(
        by_sheet.select(F.lit("sheet").alias("scope"), "label", "n"))
