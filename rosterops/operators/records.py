"""Record policies: which training rows count, for coverage and for renewal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.dates import month_key
from rosterops.functions.text import clean

TRAINING_COLUMNS = [
    "project", "employee_id", "name", "start_date", "end_date", "recorded", "machine_flag",
    "remark", "sheet", "row_no",
]

ABNORMAL_RECORDED = "培训信息是否录入为“是”，但备注包含“取消”，数据矛盾，需人工确认。"
ABNORMAL_FLAGGED = "机器看为“Y”，但备注包含“取消”，数据矛盾，需人工确认。"


def is_recorded() -> Column:
    return clean("recorded") == "是"


def is_cancelled() -> Column:
    return F.contains(clean("remark"), F.lit("取消"))


def is_flagged() -> Column:
    return F.upper(clean("machine_flag")) == "Y"


def record_date() -> Column:
    """Start date, else end date."""
    return F.coalesce("start_date", "end_date")


def coverage_policy(training: DataFrame) -> DataFrame:
    """Adds ``active, abnormal, record_status, record_reason, train_date``."""
    recorded, cancelled = is_recorded(), is_cancelled()
    return training.withColumns({
        "train_date": record_date(),
        "active": ~cancelled,
        "abnormal": recorded & cancelled,
        "record_status": F.when(recorded & cancelled, "已录入但备注取消").when(cancelled, "已取消")
        .when(recorded, "已录入").otherwise("未录入"),
        "record_reason": F.when(recorded & cancelled, ABNORMAL_RECORDED)
        .when(cancelled, "备注包含“取消”，这条计划记录不参与覆盖判断。").otherwise(""),
    })


def renewal_policy(training: DataFrame) -> DataFrame:
    """The same split with the machine flag; only flagged rows are active."""
    flagged, cancelled = is_flagged(), is_cancelled()
    return training.withColumns({
        "active": flagged & ~cancelled,
        "abnormal": flagged & cancelled,
        "record_status": F.when(flagged & cancelled, "机器看Y但备注取消").when(cancelled, "已取消")
        .when(flagged, "机器看Y").otherwise("机器看非Y"),
        "record_reason": F.when(flagged & cancelled, ABNORMAL_FLAGGED)
        .when(cancelled, "备注包含“取消”，这条记录不参与有效期更新。")
        .when(flagged, "").otherwise("机器看不是“Y”，本次不参与有效期更新。"),
    })


def split_flags(training: DataFrame) -> DataFrame:
    """Three overlapping memberships: recorded, pending and flagged for renewal."""
    recorded = is_recorded()
    return training.withColumns({
        "in_recorded": recorded,
        "in_pending": ~recorded & ~is_cancelled(),
        "in_update": is_flagged(),
    })


def scheduled_rows(training: DataFrame) -> DataFrame:
    """Active rows with a usable date: base of the schedule distribution."""
    rows = coverage_policy(training).filter(F.col("active") & F.col("train_date").isNotNull())
    return rows.withColumn("month", month_key("train_date"))


def recorded_rows(training: DataFrame) -> DataFrame:
    """Active recorded rows with a usable date: base of the yearly statistics."""
    rows = scheduled_rows(training).filter(is_recorded())
    return rows.withColumn("year", F.year("train_date"))


def pending_defaults(training: DataFrame, columns: list[str]) -> DataFrame:
    """First non-blank value per column in row order, per project and month, and overall.

    The overall row has a NULL month. One pass with grouping sets, map-side combined.
    """
    pending = split_flags(training).filter("in_pending").withColumn("month", month_key(record_date()))
    firsts = [
        F.min(F.when(clean(c) != "", F.struct("row_no", F.col(c).alias("v")))).getField("v").alias(c)
        for c in columns
    ]
    sets = pending.groupingSets([["project", "month"], ["project"]], "project", "month")
    out = sets.agg(*firsts, F.grouping_id().alias("_g"))
    return out.filter((F.col("_g") != 0) | F.col("month").isNotNull()).withColumn(
        "scope", F.when(F.col("_g") == 0, "month").otherwise("all")).drop("_g")


def pending_sessions(training: DataFrame) -> DataFrame:
    """Distinct ``(start, end)`` of pending rows per project and month, first row kept."""
    pending = split_flags(training).filter("in_pending").withColumn("month", month_key(record_date()))
    return (
        pending.filter(F.col("month").isNotNull())
        .groupBy("project", "month", "start_date", "end_date")
        .agg(F.min("row_no").alias("first_row"))
    )


def common_months(training: DataFrame, projects: list[str]) -> DataFrame:
    """Months in which every chosen project has a flagged row."""
    chosen = sorted(set(projects))
    months = (
        split_flags(training).filter(F.col("in_update") & F.col("project").isin(chosen))
        .select("project", month_key(record_date()).alias("month"))
        .filter(F.col("month").isNotNull())
    )
    counted = months.distinct().groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") == len(chosen)).select("month")


def what_if_rows(planned: DataFrame) -> DataFrame:
    """Caller-planned rows in the shape of training rows: unrecorded, end falls back to start."""
    return planned.select(
        "project", clean("employee_id").alias("employee_id"), clean("name").alias("name"),
        F.col("start_date"), F.coalesce("end_date", "start_date").alias("end_date"),
        F.lit("否").alias("recorded"), F.lit("").alias("machine_flag"), clean("remark").alias("remark"),
        F.coalesce(F.col("source"), F.lit("模拟排班")).alias("sheet"), "row_no",
    )
