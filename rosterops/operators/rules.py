"""Training-validity rules: one dimension row per project and Column expressions over it.

A rule is reduced to a ``kind`` (base month, three-month window, latest date), a validity
in months, a base-month flex, an offset of the window end and a month-end flag. Every
function takes the rule as a ``Rule`` of Columns, so the same expressions serve a join
with the dimension, a literal rule in a test and a lambda inside ``aggregate``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterops.functions.dates import date_text, ranges_overlap
from rosterops.functions.tables import literal_table

# Project, aliases, rule type, validity, unit, base-month flex, rounding.
PROJECT_RULES = [
    ("应急训练", ["EP-飞行人员应急复训"], "基准月", 24, "日历月", 1, "月底"),
    ("危险品", ["DGET-危险品培训"], "3个月窗口（截止到前一日）", 2, "年", 0, "当日"),
    ("航空安保", [], "最新日期", 24, "日历月", 0, "月底"),
    ("TSA", [], "最新日期", 12, "日历月", 0, "月底"),
    ("疲劳管理", [], "最新日期", 24, "日历月", 0, "月底"),
    ("飞行作风", [], "最新日期", 24, "日历月", 0, "月底"),
    ("英语能力", ["LG_STUDY-英语语言学习/考试"], "3个月窗口", 3, "年", 0, "当日"),
    ("汉语能力", ["LG_STUDY-汉语语言学习/考试"], "3个月窗口", 6, "年", 0, "当日"),
]

RULE_COLUMNS = ["rule_kind", "months", "flex", "end_offset", "month_end"]
WINDOW = ["window_from", "window_to"]
RULE_SCHEMA = "project string, rule_kind string, months int, flex int, end_offset int, month_end boolean"

# The status words of the board, in rank order, and their column names.
EXPIRED, EXPIRED_PLANNED, MUST, UNCOVERED, RECOMMENDED, ABNORMAL, NORMAL = (
    "已过期", "已过期已排补训", "必须排", "已排未覆盖", "推荐排", "异常", "正常",
)
STATUS_RANK = {s: i for i, s in enumerate(
    [EXPIRED, EXPIRED_PLANNED, MUST, UNCOVERED, RECOMMENDED, ABNORMAL, NORMAL])}
VISIBLE = {
    EXPIRED: "expired", EXPIRED_PLANNED: "expired_planned", MUST: "must",
    UNCOVERED: "uncovered", RECOMMENDED: "recommended", ABNORMAL: "abnormal",
}


def _rule_row(name, rule_type, amount, unit, flex, rounding):
    months = amount * 12 if "年" in unit else amount
    kind = {"基准月": "base", "最新日期": "latest"}.get(rule_type, "window")
    return (name, kind, months, flex, -1 if "前一日" in rule_type else 0, rounding == "月底")


def rule_table(spark: SparkSession) -> DataFrame:
    """Rule dimension, one row per project."""
    rows = [_rule_row(name, *rest) for name, _aliases, *rest in PROJECT_RULES]
    return literal_table(spark, rows, RULE_SCHEMA)


def alias_table(spark: SparkSession) -> DataFrame:
    """Every accepted spelling of a project name."""
    rows = [(a, name) for name, aliases, *_ in PROJECT_RULES for a in [name, *aliases]]
    return literal_table(spark, rows, "alias string, canonical string")


def canonical_project(rows: DataFrame, raw: Column, out: str = "project") -> DataFrame:
    """Canonical project name; an unknown name stays as it is."""
    aliases = F.broadcast(alias_table(rows.sparkSession))
    keyed = rows.withColumn("_alias", raw)
    joined = keyed.join(aliases, keyed["_alias"] == aliases["alias"], "left")
    return joined.withColumn(out, F.coalesce("canonical", "_alias")).drop("_alias", "alias", "canonical")


def with_rules(rows: DataFrame, project: str = "project", old: str | None = None) -> DataFrame:
    """Inner join with the eight-row dimension.

    With ``old``, the window of that expiry is computed once, as the columns ``WINDOW``, and a
    rule taken with ``Rule.of_columns(window=True)`` reads it instead of building it anew in
    every expression. Such a rule serves that expiry only.
    """
    ruled = rows.join(F.broadcast(rule_table(rows.sparkSession).withColumnRenamed("project", project)), project)
    if old is None:
        return ruled
    rule = Rule.of_columns()
    return ruled.withColumns(dict(zip(WINDOW, (window_start(rule, F.col(old)), window_end(rule, F.col(old))))))


@dataclass(frozen=True)
class Rule:
    """A rule as Columns."""

    kind: Column
    months: Column
    flex: Column
    end_offset: Column
    month_end: Column
    window: tuple[Column, Column] | None = None

    @classmethod
    def of_columns(cls, window: bool = False) -> "Rule":
        return cls(*(F.col(c) for c in RULE_COLUMNS), tuple(F.col(c) for c in WINDOW) if window else None)

    @classmethod
    def named(cls, project: str) -> "Rule":
        name, _aliases, *rest = next(r for r in PROJECT_RULES if r[0] == project)
        return cls(*(F.lit(v) for v in _rule_row(name, *rest)[1:]))


def first_of_month(date) -> Column:
    return F.trunc(date, "MM")


def add_validity(rule: Rule, date: Column) -> Column:
    """Day-clamped month addition, then the month end where the rule rounds."""
    moved = F.add_months(date, rule.months)
    return F.when(rule.month_end, F.last_day(moved)).otherwise(moved)


def base_month_expiry(date: Column, months: Column) -> Column:
    return F.last_day(F.add_months(first_of_month(date), months + 1))


def window_start(rule: Rule, old: Column) -> Column:
    if rule.window is not None:
        return rule.window[0]
    base = first_of_month(F.add_months(old, -1))
    return (
        F.when(rule.kind == "base", F.add_months(base, -rule.flex))
        .when(rule.kind == "window", F.add_months(old, -3))
    )


def window_end(rule: Rule, old: Column) -> Column:
    if rule.window is not None:
        return rule.window[1]
    base = first_of_month(F.add_months(old, -1))
    return (
        F.when(rule.kind == "base", F.last_day(F.add_months(base, rule.flex)))
        .when(rule.kind == "window", F.date_add(old, rule.end_offset))
    )


def due_date(rule: Rule, old: Column) -> Column:
    """Last day to act: the window end, or the expiry itself without a window."""
    return F.coalesce(window_end(rule, old), old)


def in_window(rule: Rule, date: Column, old: Column) -> Column:
    inside = (date >= window_start(rule, old)) & (date <= window_end(rule, old))
    return F.coalesce(inside, F.lit(False))


def new_expiry(rule: Rule, date: Column, old: Column) -> Column:
    """Inside the window the old expiry moves on, outside the training date counts."""
    outside = F.when(rule.kind == "base", base_month_expiry(date, rule.months)).otherwise(add_validity(rule, date))
    return F.when(in_window(rule, date, old), add_validity(rule, old)).otherwise(outside)


def judgement(rule: Rule, date: Column, old: Column) -> Column:
    return (
        F.when(old.isNull(), "首次无旧值")
        .when(rule.kind == "latest", F.when(date > old, "超期").otherwise("最新日期重算"))
        .when(in_window(rule, date, old), "命中窗口")
        .when(date > window_end(rule, old), "超期")
        .otherwise("提前窗口外")
    )


def write_decision(old: Column, new: Column, today: Column) -> Column:
    """Outcome of a renewal; only ``已更新`` is written back."""
    return (
        F.when(new < today, "更新无效")
        .when(new < old, "有效期回退")
        .when(new == old, "不变")
        .otherwise("已更新")
    )


def write_reason(old: Column, new: Column, today: Column) -> Column:
    return (
        F.when((new < today) & (new < old), "新有效期早于当前日期，且比当前有效期更早，本次不回写。")
        .when(new < today, "新有效期早于当前日期，本次不回写。")
        .when(new < old, "新有效期早于当前有效期，本次不回写。")
        .when(new == old, "新旧有效期一致，无需回写。")
        .when(old.isNotNull(), "新有效期晚于当前有效期，允许回写。")
        .otherwise("首次生成有效期，允许回写。")
    )


def plan_covers(rule: Rule, date: Column, old: Column) -> Column:
    """A planned date covers the round: on or before the due date and it extends."""
    ok = (date <= due_date(rule, old)) & (new_expiry(rule, date, old) > old)
    return F.coalesce(ok, F.lit(False))


def coverage_reason(rule: Rule, date: Column, old: Column) -> Column:
    due, new = due_date(rule, old), new_expiry(rule, date, old)
    return (
        F.when(old.isNull(), "无旧有效期，无法判断本轮到期是否已被覆盖。")
        .when(date.isNull(), "培训日期无法解析，不能判断是否已覆盖本轮到期。")
        .when(date > due, F.concat(F.lit("培训日期 "), date_text(date), F.lit(" 晚于本轮最晚完成日期 "),
                                   date_text(due), F.lit("，不能覆盖本轮到期。")))
        .when(new <= old, F.concat(F.lit("按规则计算的新有效期 "), date_text(new), F.lit(" 未晚于当前有效期 "),
                                   date_text(old), F.lit("，不能覆盖本轮到期。")))
        .otherwise(F.concat(F.lit("培训日期 "), date_text(date), F.lit(" 可覆盖本轮到期。")))
    )


def expiry_reason(rule: Rule, date: Column, old: Column) -> Column:
    """How the new expiry came about, in words."""
    new = date_text(new_expiry(rule, date, old))
    return (
        F.when(rule.kind == "latest", F.concat(F.lit("无窗口期，按本次培训开始日期重算到 "), new, F.lit("。")))
        .when((rule.kind == "base") & in_window(rule, date, old),
              F.concat(F.lit("命中基准月窗口，保留原基准月并顺延到 "), new, F.lit("。")))
        .when(rule.kind == "base",
              F.concat(F.lit("未命中基准月窗口，基准月改为 "), F.month(date).cast("string"),
                       F.lit(" 月，新有效期为 "), new, F.lit("。")))
        .when(in_window(rule, date, old),
              F.concat(F.when(rule.end_offset < 0, "命中3个月窗口（截止到前一日）").otherwise("命中3个月窗口"),
                       F.lit("，沿用旧到期锚点顺延到 "), new, F.lit("。")))
        .otherwise(F.concat(F.lit("未命中3个月窗口，按本次培训开始日期重算到 "), new, F.lit("。")))
    )


def point_status(rule: Rule, cutoff: Column, old: Column) -> Column:
    """Status of an expiry on one day."""
    return (
        F.when(old.isNull(), "缺少旧有效期")
        .when(cutoff > due_date(rule, old), EXPIRED)
        .when(in_window(rule, cutoff, old), "命中窗口")
        .otherwise("有效未到窗口")
    )


def stage_status(rule: Rule, start: Column, end: Column, old: Column) -> Column:
    """Status of an expiry against a planning stage."""
    no_window = rule.kind == "latest"
    return (
        F.when(old.isNull(), "缺少旧有效期")
        .when(due_date(rule, old) < start, EXPIRED)
        .when(ranges_overlap(start, end, window_start(rule, old), window_end(rule, old)), "命中窗口")
        .when(no_window & old.between(start, end), "本阶段到期")
        .when(no_window, "阶段外未到期")
        .otherwise("有效未到窗口")
    )


def urgency_rank(rule: Rule, start: Column, end: Column, old: Column, status: Column) -> Column:
    """50 expired, 40/30/20 within 30/60/90 days of the stage end, 15 due, 10 in window."""
    due = due_date(rule, old)
    days = F.when(rule.kind == "window", F.datediff(due, end))
    return (
        F.when(old.isNull(), 0)
        .when((due < start) | (status == EXPIRED), 50)
        .when(days <= 30, 40)
        .when(days <= 60, 30)
        .when(days <= 90, 20)
        .when(status == "本阶段到期", 15)
        .when(status == "命中窗口", 10)
        .otherwise(0)
    )


URGENCY_LABELS = {50: "已过期", 40: "30天内到期", 30: "60天内到期", 20: "90天内到期", 15: "本阶段到期", 10: "命中窗口"}


def urgency_label(rank: Column) -> Column:
    label = F.lit("")
    for value, text in URGENCY_LABELS.items():
        label = F.when(rank == value, text).otherwise(label)
    return label


def scheduling_need(rule: Rule, start: Column, end: Column, old: Column) -> Column:
    """Need before any plan is looked at: expired, must, recommended or normal."""
    due = due_date(rule, old)
    lead_start = first_of_month(F.add_months(due, -2))
    early = (
        F.when(rule.kind == "latest", ranges_overlap(start, end, lead_start, due))
        .otherwise(ranges_overlap(start, end, window_start(rule, old), window_end(rule, old)))
    )
    return (
        F.when(due < start, EXPIRED)
        .when(due.between(start, end), MUST)
        .when(early, RECOMMENDED)
        .otherwise(NORMAL)
    )


def status_rank(status: Column) -> Column:
    pairs = [F.lit(x) for item in STATUS_RANK.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(99))


def is_visible(status: Column) -> Column:
    return status.isin(list(VISIBLE))


# Display tone per status, worst first.
TONES = {"red": [EXPIRED, MUST, UNCOVERED, ABNORMAL], "orange": [RECOMMENDED], "green": [EXPIRED_PLANNED, NORMAL]}


def tone_rank(status: Column) -> Column:
    """0 red, 1 orange, 2 green, 3 gray; the worst tone of a set is its minimum."""
    rank = F.lit(3)
    for i, words in enumerate(TONES.values()):
        rank = F.when(status.isin(words), i).otherwise(rank)
    return rank


def tone_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in ("red", "orange", "green", "gray"))), rank + 1)


def default_stage_end(today: Column) -> Column:
    return F.last_day(F.add_months(today, 1))


