"""Status board: person by project, with plan coverage, and the summaries over it.

The board needs, per person and project, three facts about that person's training rows.
They depend on a row only through its day and flags, so training is first reduced to one
row per person, project, day and flag pair. That bounds a person's group by the calendar
however many rows one person holds, and the reduction combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.functions.dates import date_text, month_key, training_date
from rosterops.functions.text import clean, is_null_word, person_key
from rosterops.functions.tables import literal_table
from rosterops.operators import rules as R
from rosterops.operators.records import ABNORMAL_RECORDED, coverage_policy


def _days(training: DataFrame) -> DataFrame:
    """Training reduced to person, project, sheet, day and flags, with its first row."""
    policy = coverage_policy(training).filter(F.col("active") | F.col("abnormal"))
    keys = ["project", clean("employee_id").alias("t_id"), clean("name").alias("t_name"), "train_date", "active", "abnormal", "sheet"]
    return policy.groupBy(*keys).agg(F.min("row_no").alias("first_row"))


def same_person(people: DataFrame, days: DataFrame) -> DataFrame:
    """ID-first identity as one equi-join; names only decide where an ID is blank.

    A day row offers its ID, its name to people without ID, and, having no ID itself, its
    name to everybody. A person asks by ID and by name among unnumbered rows, or, without
    ID, by name alone. No pair can meet twice.
    """
    def key(kind, value):
        return F.when(F.col(value) != "", F.concat(F.lit(kind), F.col(value)))

    has_p, has_t = F.col("employee_id") != "", F.col("t_id") != ""
    asks = F.when(has_p, F.array(key("id:", "employee_id"), key("unnumbered:", "name"))).otherwise(F.array(key("name:", "name")))
    offers = F.array(key("id:", "t_id"), key("name:", "t_name"), F.when(~has_t, key("unnumbered:", "t_name")))
    asked = people.withColumn("_key", F.explode(F.array_compact(asks)))
    offered = days.withColumn("_key", F.explode(F.array_compact(offers)))
    return asked.join(offered, ["project", "_key"]).drop("_key")


def _earliest(condition: Column) -> Column:
    """First row under a condition: dated rows first, by day, then by row number."""
    key = F.struct(F.col("train_date").isNull().alias("undated"), F.col("train_date").alias("day"),
                   F.col("first_row").alias("row_no"), F.col("sheet").alias("sheet"))
    return F.min(F.when(condition, key))


def _stage(today: str, stage_end: str | None) -> tuple[Column, Column]:
    start = F.lit(today).cast("date")
    return start, F.lit(stage_end).cast("date") if stage_end else R.default_stage_end(start)


def _people(expiry: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """People of the board, with the day of their expiry as ``old``."""
    people = expiry.withColumns({
        "employee_id": clean("employee_id"), "name": clean("name"), "old": training_date("raw_expiry"),
    }).filter((F.col("employee_id") != "") | (F.col("name") != ""))
    if excluded is not None:
        people = people.join(excluded.select("name", "project"), ["name", "project"], "left_anti")
    return people.filter(F.col("old").isNotNull() | ~is_null_word("raw_expiry"))


def _status(need: Column, bad: Column, cover: Column, planned: Column) -> Column:
    uncovered = planned & need.isin(R.MUST, R.RECOMMENDED)
    return (F.when(bad, R.ABNORMAL).when(cover, R.NORMAL)
            .when(planned & (need == R.EXPIRED), R.EXPIRED_PLANNED).when(uncovered, R.UNCOVERED).otherwise(need))


def board_statuses(
    expiry: DataFrame, training: DataFrame, today: str, stage_end: str | None = None, excluded: DataFrame | None = None,
) -> DataFrame:
    """``status, project, due_month`` of the rows of ``status_board``, for counts.

    A status asks only whether there is a training row of a kind, not which one: the days of a person and
    project are gathered once, bounded by the calendar, and meet people as one row, not as one each.
    """
    start, end = _stage(today, stage_end)
    people = _people(expiry, excluded)
    policy = coverage_policy(training).filter(F.col("active") | F.col("abnormal"))
    days = policy.groupBy("project", clean("employee_id").alias("t_id"), clean("name").alias("t_name")).agg(
        F.max("abnormal").alias("bad"), F.max("active").alias("planned"),
        F.collect_set(F.when(F.col("active"), F.col("train_date"))).alias("days"))
    rule, old = R.Rule.of_columns(window=True), F.col("old")
    dated = R.with_rules(people.filter(F.col("old").isNotNull()), old="old").withColumnRenamed("row_no", "person_row")
    more = [c for c in dated.columns if c not in ("project", "person_row", "employee_id", "name", "raw_expiry")]
    met = same_person(dated, days).select("project", "person_row", "bad", "planned", *more, F.explode_outer("days").alias("day"))
    facts = met.groupBy("project", "person_row").agg(
        F.max("bad").alias("bad"), F.max("planned").alias("planned"), F.max(R.plan_covers(rule, F.col("day"), old)).alias("cover"))
    board = dated.join(facts, ["project", "person_row"], "left")
    known = [F.coalesce(fact, F.lit(False)) for fact in ("bad", "cover", "planned")]
    readable = board.select(_status(R.scheduling_need(rule, start, end, old), *known).alias("status"), "project", month_key(R.due_date(rule, old)).alias("due_month"))
    unreadable = people.filter(F.col("old").isNull()).select(F.lit(R.ABNORMAL).alias("status"), "project", F.lit("").alias("due_month"))
    return readable.unionByName(unreadable)


def status_board(
    expiry: DataFrame, training: DataFrame, today: str, stage_end: str | None = None,
    excluded: DataFrame | None = None, people_sheet: str = "人员信息表",
) -> DataFrame:
    """Person-by-project board.

    ``expiry``: project, employee_id, name, raw_expiry, row_no. ``training``: the training
    columns. ``excluded``: optional ``(name, project)`` pairs to leave out.
    """
    start, end = _stage(today, stage_end)
    people = _people(expiry, excluded)
    dated = R.with_rules(people.filter(F.col("old").isNotNull()).select(
        "project", "employee_id", "name", "old", F.col("row_no").alias("person_row")), old="old")
    rule, old, day = R.Rule.of_columns(window=True), F.col("old"), F.col("train_date")
    matched = same_person(dated, _days(training))
    covers = F.col("active") & R.plan_covers(rule, day, old)
    facts = matched.groupBy("project", "person_row").agg(
        _earliest(F.col("abnormal")).alias("bad"),
        _earliest(F.col("active")).alias("plan"),
        _earliest(covers).alias("cover"),
    )
    readable = R.with_rules(people.filter(F.col("old").isNotNull()), old="old").withColumnRenamed("row_no", "person_row")
    board = readable.join(facts, ["project", "person_row"], "left").withColumns({
        "need": R.scheduling_need(rule, start, end, old), "due": R.due_date(rule, old),
    })
    need, planned = F.col("need"), F.col("plan").isNotNull()
    uncovered = planned & need.isin(R.MUST, R.RECOMMENDED)
    status = _status(need, F.col("bad").isNotNull(), F.col("cover").isNotNull(), planned)
    person_source = F.concat(F.lit(f"{people_sheet} 第"), F.col("person_row").cast("string"), F.lit("行"))

    def row_source(fact):
        return F.concat(F.col(f"{fact}.sheet"), F.lit(" 第"), F.col(f"{fact}.row_no").cast("string"), F.lit("行"))

    plan_day = F.coalesce(F.date_format("plan.day", "yyyy-MM-dd"), F.lit("日期无法解析"))
    no_cover = F.concat(plan_day, F.lit("，但不能覆盖本轮到期。"), R.coverage_reason(rule, F.col("plan.day"), old))
    known = board.select(
        status.alias("status"),
        "project", "employee_id", "name", date_text("old").alias("expiry"),
        month_key("due").alias("due_month"), date_text("due").alias("due_date"),
        date_text(F.coalesce(F.col("cover.day"), F.when(F.col("cover").isNull(), F.col("plan.day")))).alias("scheduled_date"),
        F.when(F.col("bad").isNotNull(), row_source("bad"))
        .when(F.col("cover").isNotNull(), row_source("cover"))
        .when((planned & (need == R.EXPIRED)) | uncovered, row_source("plan"))
        .otherwise(person_source).alias("source"),
        F.when(F.col("bad").isNotNull(), F.concat(
            F.lit(ABNORMAL_RECORDED), F.lit("（项目 sheet 第"), F.col("bad.row_no").cast("string"), F.lit("行）")))
        .when(F.col("cover").isNotNull(), "已找到可覆盖本轮到期的有效安排，排班层面不用重复排。")
        .when(planned & (need == R.EXPIRED), F.concat(F.lit("当前有效期已过期，已有安排 "), no_cover))
        .when(uncovered, F.concat(F.lit("已有安排 "), no_cover))
        .when(need == R.EXPIRED, "当前有效期已过期，且未找到可覆盖本轮到期的安排。")
        .when(need.isin(R.MUST, R.RECOMMENDED), "未找到可覆盖本轮到期的安排。")
        .otherwise(F.concat(F.lit("当前有效期为 "), date_text("old"), F.lit("，本阶段不用处理。"))).alias("reason"),
    )
    unreadable = people.filter(F.col("old").isNull()).select(
        F.lit(R.ABNORMAL).alias("status"), "project", "employee_id", "name", clean("raw_expiry").alias("expiry"),
        F.lit("").alias("due_month"), F.lit("").alias("due_date"), F.lit("").alias("scheduled_date"),
        F.concat(F.lit(f"{people_sheet} 第"), F.col("row_no").cast("string"), F.lit("行")).alias("source"),
        F.concat(F.lit("当前有效期“"), clean("raw_expiry"), F.lit("”无法解析为日期。")).alias("reason"),
    )
    return known.unionByName(unreadable)


def with_status_rank(board: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of the status in the order of urgency."""
    return board.withColumn("rank", R.status_rank(F.col("status")))


def sort_board(board: DataFrame) -> DataFrame:
    return with_status_rank(board).orderBy("rank", "due_date", "project", "name").drop("rank")


def filter_board(
    board: DataFrame, projects: list[str] | None = None, statuses: list[str] | None = None,
    months: list[str] | None = None, keyword: str = "",
) -> DataFrame:
    """Facet filter; without statuses only the ones that need attention stay."""
    out = board.filter(F.col("status").isin(statuses) if statuses else R.is_visible(F.col("status")))
    if projects:
        out = out.filter(F.col("project").isin(projects))
    if months:
        out = out.filter(F.col("due_month").isin(months))
    if keyword.strip():
        texts = ["project", "employee_id", "name", "expiry", "due_month", "scheduled_date", "source", "reason"]
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(keyword.strip()))
        out = out.filter(hit)
    return out


def status_cards(board: DataFrame) -> DataFrame:
    """Count per status that needs attention, zero included."""
    counts = board.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    words = literal_table(board.sparkSession, [(s, i) for i, s in enumerate(R.VISIBLE)], "status string, ord int")
    return F.broadcast(words).join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"), "ord")


def _bucket_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(name) for s, name in R.VISIBLE.items()]


def project_matrix(board: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Project by status counts; known projects without rows appear with zeros."""
    seen = board.filter(R.is_visible(F.col("status")))
    counts = seen.groupBy("project").agg(*_bucket_counts(), F.count(F.lit(1)).alias("total"))
    if known is not None:
        counts = known.select("project").distinct().join(counts, "project", "left").unionByName(
            counts.join(known.select("project"), "project", "left_anti"))
    return counts.na.fill(0)


def ranked_matrix(matrix: DataFrame) -> DataFrame:
    """Adds ``place``, from 1: the projects with most to do first. A row per project is ordered."""
    order = ["total", "expired", "expired_planned", "must", "uncovered", "recommended"]
    return matrix.withColumn("place", F.row_number().over(Window.orderBy(*(F.col(c).desc() for c in order), "project")))


def sort_matrix(matrix: DataFrame) -> DataFrame:
    return ranked_matrix(matrix).orderBy("place").drop("place")


def month_grid(board: DataFrame, year: int) -> DataFrame:
    """Twelve rows of status counts by due month."""
    months = board.sparkSession.range(1, 13).select(F.format_string(f"{year}-%02d", "id").alias("due_month"))
    counts = (
        board.filter(R.is_visible(F.col("status")) & F.col("due_month").startswith(f"{year}-"))
        .groupBy("due_month").agg(*_bucket_counts())
    )
    return months.join(counts, "due_month", "left").na.fill(0)


def person_risk(board: DataFrame, with_items: bool = True) -> DataFrame:
    """Counts per person and the nearest due date; a person holds one row per project."""
    keyed = board.filter(R.is_visible(F.col("status"))).withColumn(
        "person", F.coalesce(F.nullif("employee_id", F.lit("")), F.nullif("name", F.lit(""))))
    near = training_date(F.coalesce(F.nullif("due_date", F.lit("")), F.col("expiry")))
    items = [F.sort_array(F.collect_list(F.struct(
        R.status_rank(F.col("status")).alias("rank"), "status", "project", "due_date", "expiry", "reason",
    ))).alias("items")] if with_items else []
    return keyed.filter(F.col("person").isNotNull()).groupBy("person").agg(
        F.min("employee_id").alias("employee_id"), F.min("name").alias("name"), *_bucket_counts(),
        F.count(F.lit(1)).alias("total"), date_text(F.min(near)).alias("nearest_due"), *items)


def sort_risk(risk: DataFrame) -> DataFrame:
    return risk.orderBy(*(F.col(c).desc() for c in R.VISIBLE.values()), "nearest_due", "name")


def top_rows(board: DataFrame, size: int | None = None) -> DataFrame:
    """Rows ranked per project and status, with the true total of each group.

    ``size`` keeps the first rows of each group only; without it all stay.

    The rank is a top-k, which Spark cuts down before the shuffle; the total comes from a
    separate count, so no group is gathered whole.
    """
    seen = board.filter(R.is_visible(F.col("status")))
    totals = seen.groupBy("project", "status").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("project", "status").orderBy("due_date", "name", "employee_id")
    ranked = seen.withColumn("rank", F.row_number().over(order))
    top = ranked if size is None else ranked.filter(F.col("rank") <= size)
    return top.join(totals, ["project", "status"])


def facets(board: DataFrame) -> DataFrame:
    """Distinct filter values in long form."""
    pairs = F.array(*(F.struct(F.lit(k).alias("facet"), F.col(c).alias("value"))
                      for k, c in (("project", "project"), ("status", "status"), ("month", "due_month"))))
    return (board.select(F.explode(pairs).alias("p")).select("p.*")
            .filter(F.col("value") != "").distinct())


def worst_tone(board: DataFrame, by: list[str]) -> DataFrame:
    ranked = board.groupBy(*by).agg(F.min(R.tone_rank(F.col("status"))).alias("r"))
    return ranked.select(*by, R.tone_name(F.col("r")).alias("tone"))


def schedule_distribution(scheduled: DataFrame) -> DataFrame:
    """Totals by month, by day and by project, each with its project breakdown text."""
    dims = F.array(
        F.struct(F.lit("month").alias("dim"), F.col("month").alias("label")),
        F.struct(F.lit("date").alias("dim"), date_text("train_date").alias("label")),
        F.struct(F.lit("project").alias("dim"), F.col("project").alias("label")),
    )
    daily = scheduled.groupBy("month", "train_date", "project").agg(F.count(F.lit(1)).alias("c"))
    parts = (daily.select("project", "c", F.explode(dims).alias("d"))
             .groupBy("d.dim", "d.label", "project").agg(F.sum("c").alias("c")))
    entry = F.struct((-F.col("c")).alias("neg"), F.col("project").alias("p"))
    text = F.transform(F.sort_array(F.collect_list(entry)),
                       lambda e: F.concat_ws(" ", e["p"], (-e["neg"]).cast("string")))
    return parts.groupBy("dim", "label").agg(
        F.sum("c").alias("total"), F.array_join(text, "；").alias("project_summary"))


def filter_schedule(rows: DataFrame, project: str = "", month: str = "", year: int | None = None) -> DataFrame:
    """Scheduled or recorded rows of one project, month or year; blank choices keep all."""
    out = rows.filter(F.col("project") == project) if project else rows
    out = out.filter(F.col("month") == month) if month else out
    return out if year is None else out.filter(F.year("train_date") == year)


def selected_rows(board: DataFrame, chosen: DataFrame) -> DataFrame:
    """Board rows of chosen people ``(name, employee_id)``."""
    keys = chosen.select(person_key("name", "employee_id").alias("_key")).distinct()
    keyed = board.withColumn("_key", person_key("name", "employee_id"))
    return keyed.join(keys, "_key", "left_semi").drop("_key")


def yearly_training(recorded: DataFrame, year: int) -> DataFrame:
    """Recorded head count by project and by month of one year; twelve month rows."""
    base = recorded.filter(F.col("year") == year).groupBy("project", "month").agg(F.count(F.lit(1)).alias("c"))
    by_project = base.groupBy(F.lit("project").alias("dim"), F.col("project").alias("label")).agg(F.sum("c").alias("total"))
    months = recorded.sparkSession.range(1, 13).select(F.format_string(f"{year}-%02d", "id").alias("label"))
    by_month = base.groupBy(F.col("month").alias("label")).agg(F.sum("c").alias("total"))
    grid = months.join(by_month, "label", "left").select(
        F.lit("month").alias("dim"), "label", F.coalesce("total", F.lit(0)).alias("total"))
    return by_project.unionByName(grid)
