"""Workbook health: one issue table out of many independent checks.

Every check is a DataFrame ``(level, area, message, detail)``; the board is their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.dates import date_text, training_date
from rosterops.functions.text import clean
from rosterops.functions.tables import literal_table
from rosterops.operators import attendance as A
from rosterops.operators import rules as R
from rosterops.operators.records import coverage_policy, split_flags

LEVELS = ["error", "warning", "info"]
REQUIRED_PEOPLE, SUGGESTED_PEOPLE = ["员工号", "姓名"], ["分部", "技术信息", "是否运行", "备注"]
EXEMPT_HEADERS = ["员工号", "姓名", "培训开始日期", "培训结束日期", "备注"]


def _issue(rows: DataFrame, level: str, area, message: Column, detail=None) -> DataFrame:
    place = F.lit(area) if isinstance(area, str) else area
    return rows.select(F.lit(level).alias("level"), place.alias("area"), message.alias("message"),
                       (F.lit("") if detail is None else detail).alias("detail"))


def text(*parts) -> Column:
    """Concatenate words and columns."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def row_place() -> Column:
    return text(F.col("sheet"), " 第", F.col("row_no"), "行")


def person_label() -> Column:
    both = F.concat_ws(" / ", F.nullif(clean("employee_id"), F.lit("")), F.nullif(clean("name"), F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), text("第", F.col("row_no"), "行"))


def header_issues(headers: DataFrame, area: str, required: list[str], suggested: list[str]) -> DataFrame:
    """Missing required headers are errors, missing suggested ones warnings.

    ``headers``: one ``header`` per row of one sheet.
    """
    spark = headers.sparkSession
    wanted = literal_table(
        spark, [("error", h) for h in required] + [("warning", h) for h in suggested], "level string, header string")
    lost = F.broadcast(wanted).join(headers.select("header").distinct(), "header", "left_anti")
    hint = F.when(F.col("level") == "warning", "相关展示或 CRM 分类可能不完整。").otherwise("")
    word = F.when(F.col("level") == "warning", "缺少建议表头“").otherwise("缺少必要表头“")
    return lost.select("level", F.lit(area).alias("area"), F.concat(word, "header", F.lit("”。")).alias("message"), hint.alias("detail"))


def people_issues(people: DataFrame) -> DataFrame:
    """Rows without ID and name, and every row of an ID that occurs more than once."""
    area = "人员信息表"
    blank = people.filter((clean("employee_id") == "") & (clean("name") == ""))
    twice = A.duplicate_rows_of(people, "employee_id")
    rows = text("行号：", F.col("row_no"))
    return _issue(blank, "warning", area, text("第", F.col("row_no"), "行缺少员工号和姓名。")).unionByName(
        _issue(twice, "warning", area, text("员工号 ", F.col("employee_id"), " 重复出现。"), rows))


def training_issues(raw: DataFrame) -> DataFrame:
    """Contradictions and date problems of project rows.

    ``raw``: training columns, the two dates as the texts ``raw_start`` and ``raw_end``.
    One scan; a row carries an array of its problems.
    """
    parsed = raw.withColumns({"start_date": training_date("raw_start"), "end_date": training_date("raw_end")})
    rows = coverage_policy(parsed)
    start, end = F.col("start_date").isNull(), F.col("end_date").isNull()
    unreadable = (start & (clean("raw_start") != "")) | (end & (clean("raw_end") != ""))
    place = row_place()

    def problem(test, words, detail):
        return F.when(test, F.struct(F.concat(person_label(), F.lit(words)).alias("message"), detail.alias("detail")))

    found = F.array_compact(F.array(
        problem(F.col("abnormal"), " 数据矛盾。", F.concat(place, F.lit("："), F.col("record_reason"))),
        problem(unreadable, " 培训日期无法解析。", place),
        problem(F.col("active") & start & end, " 缺少可用培训日期。", place),
    ))
    issues = rows.select("project", F.explode(found).alias("p"))
    return _issue(issues, "warning", F.col("project"), F.col("p.message"), F.col("p.detail"))


def project_issues(training: DataFrame, expiry_projects: DataFrame) -> DataFrame:
    """Expected projects without a sheet, row counts of the others, missing expiry columns."""
    rules = R.rule_table(training.sparkSession).select("project")
    counts = split_flags(training).groupBy("project").agg(
        F.count_if("in_recorded").alias("recorded"), F.count_if("in_pending").alias("pending"))
    absent = rules.join(counts, "project", "left_anti")
    no_column = counts.join(expiry_projects.select("project").distinct(), "project", "left_anti")
    return (
        _issue(absent, "warning", "培训项目", text("未识别到“", F.col("project"), "”项目 sheet。"))
        .unionByName(_issue(counts, "info", F.col("project"), text("识别到项目 sheet“", F.col("project"), "”。"),
                            text("已录入 ", F.col("recorded"), " 行，未录入 ", F.col("pending"), " 行。")))
        .unionByName(_issue(no_column, "warning", F.col("project"), F.lit("人员信息表中没有对应有效期列。"),
                            F.lit("排班总览无法按人员当前有效期判断该项目。")))
    )


def mismatch_issues(training: DataFrame, left: str = "航空安保", right: str = "TSA") -> DataFrame:
    """Sessions whose lists differ, an issue for every person on one side only."""
    lone = A.roster_mismatch(training, left, right)
    span = F.when(F.col("start_date") == F.col("end_date"), date_text("start_date")).otherwise(
        text(date_text("start_date"), " 至 ", date_text("end_date")))
    detail = text("仅", F.col("only_in"), "：", F.col("label"))
    return _issue(lone, "warning", "安保 / TSA 名单", F.concat(span, F.lit(" 名单不一致。")), detail)


def attendance_issues(marked: DataFrame, records: DataFrame, year: int) -> DataFrame:
    """Summary of the yearly check, unrecognised roles, every double booking."""
    stats = marked.agg(F.count(F.lit(1)).alias("q"), F.count_if("attended").alias("a"))
    base = _issue(stats, "info", "CRM", F.lit(f"{year} 年 CRM 核对可生成。"), text(
        "应参加 ", F.col("q"), " 人，已参加 ", F.col("a"), " 人，未参加 ", F.col("q") - F.col("a"), " 人。"))
    strange = marked.filter(A.role_of(F.col("tech")) == "未识别").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    odd = _issue(strange, "warning", "CRM", text("有 ", F.col("n"), " 名 CRM 应参加人员技术等级未识别。"))
    twice = A.duplicate_bookings(records)
    total = twice.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    booked = _issue(total, "warning", "CRM", text(f"{year} 年 CRM 有 ", F.col("n"), " 人重复安排。"))
    people = _issue(twice, "warning", "CRM", F.lit(f"{year} 年 CRM 重复安排。"), text(F.col("name"), "：", F.col("bookings"), " 次"))
    return base.unionByName(odd).unionByName(booked).unionByName(people)


def sheet_issues(sheets: DataFrame, used: DataFrame) -> DataFrame:
    """Sheets that nothing reads, and the exact attendance sheet when it is missing."""
    spare = sheets.join(used.select("sheet"), "sheet", "left_anti")
    ignored = _issue(spare, "info", "未纳入监控", text("工作表“", F.col("sheet"), "”当前不参与监控。"))
    exact = sheets.agg(F.count_if(F.col("sheet") == "CRM").alias("n")).filter("n = 0")
    near = sheets.filter(F.contains("sheet", F.lit("CRM")) & (F.col("sheet") != "CRM"))
    return ignored.unionByName(_issue(exact, "warning", "CRM", F.lit("未找到精确名为“CRM”的工作表。"))).unionByName(
        _issue(near, "info", "CRM", text("发现工作表“", F.col("sheet"), "”，系统不会作为当年 CRM 核对来源。")))


def health_board(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level)


def sort_issues(issues: DataFrame) -> DataFrame:
    """Errors, then warnings, then information."""
    return issues.orderBy(level_rank(F.col("level")), "area", "message")
