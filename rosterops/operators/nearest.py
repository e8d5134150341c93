"""Nearest-date matching of bills and check-ins, and proof-link columns.

Only the day of a row matters for the choice, so both sides are reduced to distinct
``(name, day)``: bills keep their first index, check-ins the index that wins a tie. Nearest
days come from two scans along a name's days, in spans, so a hot name is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import clean
from rosterops.operators.skew import attach, running_last


def nearest_days(bill_days: DataFrame, checkin_days: DataFrame, tolerance: int) -> DataFrame:
    """``bill_days`` (``name, day, ...``) with ``checkin_idx, day_diff`` of the nearest check-in day (``name, day,
    checkin_idx``) within tolerance.

    Both sides are laid on the day axis of a name, one row per day. The last check-in before each day
    and the first one after it come from scans in spans, so a name of any length of history is
    never sorted in one task, and the work does not grow with the tolerance.
    """
    kept = [c for c in bill_days.columns if c not in ("name", "day")]
    axis = bill_days.withColumn("checkin_idx", F.lit(None).cast("long")).unionByName(checkin_days, allowMissingColumns=True)
    per_day = axis.groupBy("name", "day").agg(F.min("checkin_idx").alias("checkin_idx"), *[F.max(c).alias(c) for c in kept])
    numbered = per_day.withColumn("_d", F.unix_date("day").cast("long"))
    hit = F.when(F.col("checkin_idx").isNotNull(), F.struct("_d", "checkin_idx"))
    before = running_last(numbered, ["name"], "_d", hit, "_b")
    after = running_last(before, ["name"], "_d", hit, "_a", reverse=True)
    options = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_d") - F.col(f"{c}._d")).cast("int").alias("diff"), F.col(f"{c}.checkin_idx").alias("checkin_idx"))) for c in ("_b", "_a")]
    best = after.withColumn("_best", F.least(*options)).filter(F.col(kept[0]).isNotNull() & (F.col("_best.diff") <= tolerance))
    return best.select("name", "day", *kept, F.col("_best.checkin_idx").alias("checkin_idx"), F.col("_best.diff").alias("day_diff"))


def match_nearest(bills: DataFrame, checkins: DataFrame, tolerance: int) -> DataFrame:
    """``bills``: bill_idx, name, day. ``checkins``: checkin_idx, name, day.

    Adds ``status`` (matched, duplicate, unmatched), ``checkin_idx`` and ``day_diff``.
    Equal names, smallest day distance, first check-in on a tie. The second bill that
    lands on a check-in is a duplicate.
    """
    b = bills.withColumn("name", clean("name")).filter((F.col("name") != "") & F.col("day").isNotNull())
    c = checkins.withColumn("name", clean("name")).filter((F.col("name") != "") & F.col("day").isNotNull())
    bill_days = b.groupBy("name", "day").agg(F.min("bill_idx").alias("first_bill"), F.count(F.lit(1)).alias("_n"))
    checkin_days = c.groupBy("name", "day").agg(F.min("checkin_idx").cast("long").alias("checkin_idx"))
    chosen = nearest_days(bill_days, checkin_days, tolerance)
    claims = chosen.groupBy("checkin_idx").agg(F.min("first_bill").alias("claimed_by"))
    per_day = bill_days.join(chosen.select("name", "day", "checkin_idx", "day_diff").join(claims, "checkin_idx"),
                             ["name", "day"], "left").drop("first_bill")
    joined = attach(b, per_day, ["name", "day"], "_n", F.col("bill_idx"))
    status = (
        F.when(F.col("checkin_idx").isNull(), "unmatched")
        .when(F.col("bill_idx") == F.col("claimed_by"), "matched").otherwise("duplicate")
    )
    return joined.withColumn("status", status).drop("claimed_by", "_n")


def skipped_bills(bills: DataFrame) -> DataFrame:
    """Bills without a name or without a readable day."""
    return bills.filter((clean("name") == "") | F.col("day").isNull())


def proof_links(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Links of proof columns per matched bill, in column order.

    ``links``: checkin_idx, col_no, header, url, label. A sheet bounds its columns.
    """
    wanted = links.filter(F.contains("header", F.lit("证明")) | F.contains("header", F.lit("文件")))
    entry = F.struct("col_no", "url", "label")
    per_checkin = wanted.groupBy("checkin_idx").agg(F.array_sort(F.collect_list(entry)).alias("proofs"))
    return matches.join(per_checkin, "checkin_idx", "left").withColumn(
        "proofs", F.coalesce("proofs", F.array().cast("array<struct<col_no:int,url:string,label:string>>")))


def proof_width(with_proofs: DataFrame) -> DataFrame:
    """Number of link columns a report needs, one at least."""
    return with_proofs.agg(F.greatest(F.coalesce(F.max(F.size("proofs")), F.lit(1)), F.lit(1)).alias("columns"))


def link_columns(with_proofs: DataFrame, width: int) -> DataFrame:
    """``width`` link columns; missing ones are NULL."""
    names = ["入住证明"] if width == 1 else [f"入住证明{i + 1}" for i in range(width)]
    return with_proofs.select("*", *(F.get("proofs", F.lit(i)).getField("url").alias(n) for i, n in enumerate(names)))


def pick_columns(matches: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """User-picked output columns, right side prefixed."""
    return matches.select(*left, *(F.col(c).alias(f"checkin_{c}") for c in right))
