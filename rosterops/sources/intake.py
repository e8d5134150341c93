"""Good and reject streams of request lists, pasted records and aligned table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions import dates as D
from rosterops.functions import text as X
from rosterops.operators.skew import attach, mark_first


def split_rejects(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Two frames over one tagged pass: rows without a reason, rows with one."""
    tagged = rows.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def read_requests(rows: DataFrame) -> DataFrame:
    """Query list ``(raw_id, raw_name, row_no)`` with a verdict per row.

    Blank rows leave. The reason is NULL for a good row; the first row of an ID is good,
    later ones are duplicates.
    """
    shaped = rows.withColumns({
        "employee_id": X.numeric_employee_id("raw_id"), "name": X.squeeze("raw_name"), "shown_id": X.squeeze("raw_id"),
    }).filter((F.col("shown_id") != "") | (F.col("name") != ""))
    valid = F.col("employee_id").rlike("^[0-9]{6}$")
    bad = shaped.filter(~valid).withColumn("reason", F.lit("员工号不是 6 位数字"))
    marked = mark_first(shaped.filter(valid), ["employee_id"], "row_no", "is_first")
    good = marked.withColumn("reason", F.when(~F.col("is_first"), "重复员工号，已跳过")).drop("is_first")
    return good.unionByName(bad)


def parse_pasted(rows: DataFrame, text: str, leave_types: DataFrame | None = None) -> DataFrame:
    """Pasted record lines to ID, name and dates; an absent part stays NULL."""
    found = X.dates_in_text(text)
    first = D.query_date_text(F.get(found, F.lit(0)))
    second = D.query_date_text(F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0))))
    out = rows.withColumns({
        "employee_id": X.bounded_id(text), "name": X.name_after_id(text),
        "start_date": F.when(F.size(found) > 0, first), "end_date": F.when(F.size(found) > 0, second),
    })
    return out if leave_types is None else resolve_leave_type(out, text, leave_types, "leave_type")


def pasted_lines(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lines of a pasted text; one single long line is cut before each ID and name."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), X.clean), lambda x: x != "")
    only = F.get(lines, F.lit(0))
    cut = F.when((F.size(lines) == 1) & (F.length(only) > 100), X.split_pasted_line(only)).otherwise(lines)
    return rows.select(*keys, F.posexplode(cut).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def pasted_reason() -> Column:
    return (
        F.when(F.col("employee_id").isNull(), "未识别员工号")
        .when(F.col("leave_type").isNull(), "未识别请假类型")
        .when(F.col("start_date").isNull(), "未识别日期")
    )


def resolve_leave_type(rows: DataFrame, text: str, leave_types: DataFrame, out: str) -> DataFrame:
    """Leave code of a text by five tiers, longest spelling first within a tier.

    ``leave_types``: code, label (``CODE-name``), a dimension of a few dozen rows. Only
    distinct texts are resolved.
    """
    dim = F.broadcast(leave_types.select("code", "label", F.regexp_replace("label", "^[^-]*-", "").alias("part")))
    texts = rows.select(X.clean(text).alias("_t")).filter(F.col("_t") != "").distinct()
    t, code, label, part = F.col("_t"), F.col("code"), F.col("label"), F.col("part")
    quoted = F.concat(F.lit(r"\Q"), code, F.lit(r"\E"))
    inside = F.contains(t, code) & F.regexp_like(t, F.concat(F.lit("(?<![A-Z0-9_/])"), quoted, F.lit("(?![A-Z0-9_/])")))
    at = F.regexp_instr(t, F.concat(F.lit("(?<![A-Z0-9_/])"), quoted, F.lit("(?![A-Z0-9_/])")))
    tier = (
        F.when(t == code, 0).when(t == label, 1).when(inside, 2)
        .when(F.contains(t, label), 3).when(F.contains(t, part) | F.contains(part, t), 4)
    )
    hit = texts.join(dim, F.contains(t, code) | F.contains(t, part) | F.contains(part, t)).withColumns(
        {"tier": tier, "at": F.when(inside, at).otherwise(0)}).filter(F.col("tier").isNotNull())
    width = F.when(F.col("tier") == 2, -F.length(code)).otherwise(-F.length(label))
    best = hit.groupBy("_t").agg(F.min(F.struct("tier", "at", width.alias("w"), "label", "code")).getField("code").alias(out))
    keyed = rows.withColumn("_t", X.clean(text))
    sizes = keyed.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    return attach(keyed, best, ["_t"], "_n", F.xxhash64(*rows.columns), counts=sizes).drop("_t")


def align_cells(cells: Column, header: Column) -> Column:
    """Drop a leading sequence number when a row is one cell wider than its header."""
    wider = F.size(cells) == F.size(header) + 1
    numbered = X.squeeze(F.get(cells, F.lit(0))).rlike("^[0-9]{1,4}$")
    headed = F.coalesce(F.get(header, F.lit(0)) != "序号", F.lit(False))
    return F.when(wider & numbered & headed, F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)


def limit_rows(rows: DataFrame, size: int | None, order: str = "row_no") -> DataFrame:
    """The first rows of an input list, as the caller asks for a trial run."""
    return rows if size is None else rows.orderBy(order).limit(size)


def write_failed(rows: DataFrame, keys: list[str], path: str) -> None:
    """Tab-separated keys and reason of failed rows, ready for a second run."""
    rows.filter(F.col("reason").isNotNull()).select(*keys, "reason").write.mode("overwrite").option("sep", "\t").csv(path)


def read_failed(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """The log of ``write_failed`` as rows, all columns as text."""
    layout = ", ".join(f"`{k}` string" for k in [*keys, "reason"])
    return spark.read.schema(layout).option("sep", "\t").csv(path)
