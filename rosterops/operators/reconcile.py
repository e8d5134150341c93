"""Two-table reconciliation by match name, and the key-set operations around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import clean, split_names
from rosterops.operators.skew import attach, running_sum

# Reconciliation statuses.
EQUAL, LEFT_MORE, RIGHT_MORE, LEFT_ONLY, RIGHT_ONLY = "一致", "场次多", "账单多", "仅场次有", "仅账单有"
RECONCILE_STATUSES = [EQUAL, LEFT_MORE, RIGHT_MORE, LEFT_ONLY, RIGHT_ONLY]


def name_entries(rows: DataFrame, roles: list[str], keep: list[str]) -> DataFrame:
    """One row per name occurrence in the role columns' comma lists."""
    per_role = F.array(*(
        F.struct(F.lit(i).alias("ord"), F.lit(r).alias("role"), split_names(r).alias("names"))
        for i, r in enumerate(roles)))
    exploded = rows.select(*keep, F.explode(per_role).alias("r"))
    named = exploded.select(*keep, F.col("r.ord").alias("role_ord"), F.col("r.role").alias("role"),
                            F.posexplode("r.names").alias("pos", "name"))
    return named.withColumn("match_name", F.lower("name"))


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """Entries of several sheets under one header; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def reconcile_status(left: Column, right: Column) -> Column:
    return (
        F.when((left > 0) & (right == 0), LEFT_ONLY)
        .when((left == 0) & (right > 0), RIGHT_ONLY)
        .when(left > right, LEFT_MORE)
        .when(right > left, RIGHT_MORE)
        .otherwise(EQUAL)
    )


def reconcile_note(status: Column, diff: Column) -> Column:
    size = F.abs(diff).cast("string")
    return (
        F.when(status == EQUAL, "两边姓名人次一致。")
        .when(status == LEFT_ONLY, "账单表没有该姓名。")
        .when(status == RIGHT_ONLY, "场次表没有该姓名。")
        .when(status == LEFT_MORE, F.concat(F.lit("场次表多 "), size, F.lit(" 次。")))
        .otherwise(F.concat(F.lit("账单表多 "), size, F.lit(" 次。")))
    )


def _side(entries: DataFrame, side: str) -> DataFrame:
    """Counts per match name; the first spelling by row order names the group."""
    keyed = entries.filter(clean("match_name") != "")
    return keyed.groupBy("match_name").agg(
        F.count(F.lit(1)).alias(f"{side}_count"),
        F.min(F.struct("row_no", "name")).getField("name").alias(f"{side}_name"),
    )


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer comparison of how often each name occurs on either side.

    Both sides shrink to one row per name before they meet, so a name with a third of
    all entries costs one row in the join.
    """
    joined = _side(left, "left").join(_side(right, "right"), "match_name", "full_outer")
    counted = joined.withColumns({
        "left_count": F.coalesce("left_count", F.lit(0)), "right_count": F.coalesce("right_count", F.lit(0)),
    })
    status = reconcile_status(F.col("left_count"), F.col("right_count"))
    return counted.select(
        "match_name", status.alias("status"), F.coalesce("left_name", "right_name").alias("name"),
        "left_count", "right_count", (F.col("left_count") - F.col("right_count")).alias("diff"),
        reconcile_note(status, F.col("left_count") - F.col("right_count")).alias("note"),
    )


def reference_rows(left: DataFrame, right: DataFrame, result: DataFrame) -> DataFrame:
    """Where each compared name came from, in long form: one row per source row.

    The names on one side can be any number, so they stay rows instead of one text cell.
    """
    def refs(entries, side):
        role = F.when(clean("role") != "", F.concat(F.lit("/"), F.col("role"))).otherwise("")
        ref = F.concat("sheet", F.lit("!第"), F.col("row_no").cast("string"), F.lit("行"), role)
        return entries.select("match_name", F.lit(side).alias("side"), "name", "row_no", ref.alias("ref"))

    both = refs(left, "left").unionByName(refs(right, "right"))
    per_name = result.select("match_name", "status", (F.col("left_count") + F.col("right_count")).alias("_n"))
    return attach(both, per_name, ["match_name"], "_n", F.col("row_no"), how="inner").drop("_n")


def reference_text(refs: DataFrame, lines: int = 1000) -> DataFrame:
    """References and spellings per name and side as display text, in row order.

    A cell holds at most ``lines`` references; a longer list goes on in the next part, so
    the name with the most entries is never gathered whole.
    """
    numbered = running_sum(refs, ["match_name", "side"], "row_no", F.lit(1), "_k")
    part = F.floor((F.col("_k") - 1) / lines).alias("part")
    listed = F.array_sort(F.collect_list(F.struct("row_no", "ref", "name")))
    return numbered.groupBy("match_name", "side", part).agg(listed.alias("l")).select(
        "match_name", "side", "part",
        F.array_join(F.transform("l", lambda x: x["ref"]), "；").alias("refs"),
        F.array_join(F.array_distinct(F.transform("l", lambda x: x["name"])), " / ").alias("names"))


def reconcile_summary(result: DataFrame) -> DataFrame:
    """Totals, distinct names and one count per status, as a single row."""
    per_status = [F.count_if(F.col("status") == s).alias(f"status_{i}") for i, s in enumerate(RECONCILE_STATUSES)]
    return result.agg(
        F.coalesce(F.sum("left_count"), F.lit(0)).alias("left_total"), F.count_if(F.col("left_count") > 0).alias("left_names"),
        F.coalesce(F.sum("right_count"), F.lit(0)).alias("right_total"), F.count_if(F.col("right_count") > 0).alias("right_names"),
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("status") == EQUAL).alias("matched"),
        F.count_if(F.col("status") != EQUAL).alias("mismatched"), *per_status,
    )


def filter_status(result: DataFrame, choice: str) -> DataFrame:
    """``all``, ``diff`` for every mismatch, or one status word."""
    if choice == "all":
        return result
    return result.filter(F.col("status") != EQUAL) if choice == "diff" else result.filter(F.col("status") == choice)


def chinese_order(column: str) -> Column:
    """Sort key in pinyin order."""
    return F.collate(F.col(column), "zh_Hans_CHN")


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides."""
    return left.select(key).union(right.select(key)).distinct()
