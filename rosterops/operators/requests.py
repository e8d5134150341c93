"""Requests against result rows: matching, pairing, status decision, audit flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions import text as X
from rosterops.functions.dates import query_date_text, same_day_text
from rosterops.operators.mentions import mentions
from rosterops.operators.skew import attach, running_sum
from rosterops.session import cut_lineage
from rosterops.sources.intake import resolve_leave_type

EMPTY_MARK = "没有相关信息"
FIELDS = ["employee_id", "name", "leave_type", "start_date", "end_date"]


def real_rows(results: DataFrame) -> DataFrame:
    """Result rows that are not the portal's "nothing found" line."""
    return results.filter(~F.contains(F.coalesce("row_text", F.lit("")), F.lit(EMPTY_MARK)))


def whitelisted(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose ID is on the list."""
    sizes = rows.groupBy("employee_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = allowed.select("employee_id").distinct()
    return attach(rows, listed, ["employee_id"], "_n", F.xxhash64(*rows.columns), how="left_semi", counts=sizes)


def fits(asked, shown) -> Column:
    """Does a result row stand for a request? Both arguments give a column by its name.

    A result field that is there must agree; one that is blank must occur in the row text.
    Names agree by their keys, days by value, leave types by the code that the shown text
    stands for, or by the name where it stands for none.
    """
    def field(name, same, wanted):
        return F.when(X.clean(shown(name)) != "", same).otherwise(F.contains(F.coalesce(shown("row_text"), F.lit("")), wanted))

    same_type = F.when(X.clean(shown("k_type")) != "", asked("leave_type") == shown("k_type")).otherwise(
        (asked("leave_name") != "") & F.contains(shown("leave_type"), asked("leave_name")))
    return F.coalesce(
        field("employee_id", asked("employee_id") == shown("employee_id"), asked("employee_id"))
        & ((asked("k_name") == "") | field("name", asked("k_name") == shown("k_name"), asked("name")))
        & field("leave_type", same_type, asked("leave_name"))
        & field("start_date", asked("k_start") == shown("k_start"), asked("start_date"))
        & field("end_date", asked("k_end") == shown("k_end"), asked("end_date")), F.lit(False))


def row_matches() -> Column:
    """``fits`` between request columns and ``r_`` prefixed result columns."""
    return fits(F.col, lambda name: F.col(f"r_{name}"))


def with_type_codes(results: DataFrame, leave_types: DataFrame | None) -> DataFrame:
    """Adds ``k_type``, the leave code that a shown type stands for; a code stands for itself
    where no dimension (``code, label``) is given."""
    if leave_types is None:
        return results.withColumn("k_type", X.clean("leave_type"))
    return resolve_leave_type(results, "leave_type", leave_types, "k_type")


def _with_keys(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Comparison keys of name and days, computed once per row before the join."""
    def day(c):
        return query_date_text(F.substring(F.coalesce(F.col(prefix + c), F.lit("")), 1, 10))

    return rows.withColumns({f"{prefix}k_name": X.display_name_key(prefix + "name"), f"{prefix}k_start": day("start_date"), f"{prefix}k_end": day("end_date")})


def _prefixed(results: DataFrame) -> DataFrame:
    return results.select(*(F.col(c).alias(f"r_{c}") for c in results.columns))


def first_matches(requests: DataFrame, results: DataFrame, leave_types: DataFrame | None = None) -> DataFrame:
    """First result row per request: equal ID, or the ID inside the text of a row without one.

    Both sides shrink to distinct field values first. Complete result rows meet requests
    on ID, type and both days, so an employee with any number of rows only pairs rows of
    the same span; incomplete ones meet on the ID. Rows without an ID offer every
    six-digit run of their text as a key, so they take a hash join too.
    """
    r = _with_keys(_prefixed(with_type_codes(real_rows(results), leave_types)), "r_")
    signature = ["r_employee_id", "r_name", "r_leave_type", "r_k_type", "r_start_date", "r_end_date", "r_k_name", "r_k_start", "r_k_end"]
    numbered = r.filter(X.clean("r_employee_id") != "")
    first = F.min("r_row_no").alias("r_row_no")
    whole = numbered.filter(_all_present()).groupBy("r_employee_id", "r_k_type", "r_k_name", "r_k_start", "r_k_end").agg(first)
    partial = numbered.filter(~_all_present()).groupBy(*signature, "r_row_text").agg(first)
    inside = r.filter(X.clean("r_employee_id") == "").groupBy(*signature, "r_row_text").agg(first).withColumn(
        "r_key", F.explode(_id_windows("r_row_text")))
    fields = [*FIELDS, "leave_name"]
    asked = _with_keys(requests.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n")))
    c = F.col
    exact = asked.join(whole, (c("employee_id") == c("r_employee_id")) & (c("leave_type") == c("r_k_type"))
                       & (c("k_start") == c("r_k_start")) & (c("k_end") == c("r_k_end")))
    exact = exact.filter((c("k_name") == "") | (c("k_name") == c("r_k_name")))
    offered = partial.withColumn("r_key", c("r_employee_id")).unionByName(inside)
    loose = asked.join(offered, c("employee_id") == c("r_key")).filter(row_matches())
    hit = exact.select(*fields, "r_row_no").unionByName(loose.select(*fields, "r_row_no"))
    best = hit.groupBy(*fields).agg(F.min("r_row_no").alias("result_row"))
    sizes = requests.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n"))
    return attach(requests, best, fields, "_n", F.col("sequence"), counts=sizes)


def _all_present() -> Column:
    ok = F.lit(True)
    for c in ("r_name", "r_k_type", "r_start_date", "r_end_date"):
        ok = ok & (X.clean(c) != "")
    return ok


def _id_windows(text: str) -> Column:
    """Distinct six-digit windows of a text, overlapping ones too."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([0-9]{6,})"), 1)
    windows = F.transform(runs, lambda run: F.transform(
        F.sequence(F.lit(1), F.length(run) - 5), lambda i: F.substring(run, i, 6)))
    return F.array_distinct(F.flatten(windows))


def pair_full_rows(requests: DataFrame, results: DataFrame, leave_types: DataFrame | None = None) -> DataFrame:
    """Each result row serves one request, in order, for rows with all five fields.

    Equal requests are interchangeable, so the k-th result of a field combination takes
    its k-th request: two running counts and an equi-join. Fields are equal by their keys:
    name without notes, days by value, leave type by code. The counts scan in spans, so a
    combination with a third of all rows does not end up in one task.
    """
    keys = ["employee_id", "k_name", "k_type", "k_start", "k_end"]

    def ranked(rows, order):
        return running_sum(_with_keys(rows), keys, order, F.lit(1), "_k")

    left = ranked(requests.withColumn("k_type", F.col("leave_type")), "sequence")
    right = ranked(with_type_codes(real_rows(results), leave_types), "row_no").select(*keys, "_k", F.col("row_no").alias("result_row"))
    return left.join(right, [*keys, "_k"], "left").drop("_k", "k_name", "k_type", "k_start", "k_end")


def _circles(requests: DataFrame, results: DataFrame) -> DataFrame:
    """``batch, employee_id, circle``: employees of a batch whose results may meet.

    A row without an ID may stand for every employee named in its text, and a failed attempt
    belongs to its own request. Mostly every employee is a circle of one.
    """
    people = requests.select("batch", "employee_id").distinct()
    several = results.filter((X.clean("employee_id") == "") & (F.size(_id_windows("row_text")) > 1))
    named = requests.select("batch", "employee_id", F.col("name").alias("q_name"), X.display_name_key("name").alias("q_key")).distinct()
    found = several.select("batch", "row_no", "row_text", X.display_name_key("name").alias("key"), F.explode(_id_windows("row_text")).alias("employee_id"))
    same = (F.col("q_key") == "") | F.when(F.col("key") != "", F.col("key") == F.col("q_key")).otherwise(F.contains("row_text", F.col("q_name")))
    links = found.join(named, ["batch", "employee_id"]).filter(same).select("batch", "row_no", "employee_id").distinct()
    return joined_labels(people, links)


def joined_labels(people: DataFrame, links: DataFrame) -> DataFrame:
    """``batch, employee_id, circle``: the smallest employee reachable over shared rows.

    ``links``: batch, row_no, employee_id. In each round an employee takes the smallest label among
    those on its rows, all who bear its old label follow (hook), and a label is replaced by its
    own label (jump). Labels only sink and stay inside a circle, so when none moves, each is
    the smallest of its circle. A chain halves about every round.
    """
    labels = people.withColumn("circle", F.col("employee_id"))
    moved = not links.isEmpty()
    while moved:
        low = links.join(labels, ["batch", "employee_id"]).groupBy("batch", "row_no").agg(F.min("circle").alias("low"))
        own = links.join(low, ["batch", "row_no"]).groupBy("batch", "employee_id").agg(F.min("low").alias("low"))
        near = labels.join(own, ["batch", "employee_id"], "left").withColumn("low", F.coalesce("low", "circle"))
        hooks = near.filter("low < circle").groupBy("batch", "circle").agg(F.min("low").alias("hook"))
        hooked = near.join(hooks, ["batch", "circle"], "left").withColumn("low", F.least("low", "hook"))
        hooked = cut_lineage(hooked.select("batch", "employee_id", "circle", "low"))
        moved = not hooked.filter("low < circle").isEmpty()
        if moved:
            over = hooked.filter("low < employee_id").select("batch", F.col("employee_id").alias("low"), F.col("low").alias("next"))
            labels = hooked.join(over, ["batch", "low"], "left").select(
                "batch", "employee_id", F.coalesce("next", "low").alias("circle"))
    return labels.select("batch", "employee_id", "circle")


def pair_partial_rows(requests: DataFrame, results: DataFrame, leave_types: DataFrame | None = None) -> DataFrame:
    """Results in their order each take the first waiting request they fit.

    Returns ``sequence, result_row, state``: ``matched``, or ``failed`` for an attempt that ended
    in an error or without a row and may not be tried again. Such an attempt takes its own
    request (``attempted``) out of the pool at its turn; one that may be tried again leaves it
    there. Optional result columns: ``attempted, failed, retryable``. The fold runs per circle of
    employees that can meet in one ``batch``, the submission the rows belong to.
    """
    for name, kind in (("attempted", "long"), ("failed", "boolean"), ("retryable", "boolean")):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    results = results.withColumns({"failed": F.coalesce("failed", F.lit(False)), "retryable": F.coalesce("retryable", F.lit(False))})
    usable = results.filter(F.col("failed")).unionByName(real_rows(results.filter(~F.col("failed"))))
    circles = _circles(requests, usable)
    keys = ["batch", "circle"]
    fields = ["sequence", *FIELDS, "leave_name", "k_name", "k_start", "k_end"]
    waiting = _with_keys(requests.join(circles, ["batch", "employee_id"])).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("waiting"))
    owner = requests.select("batch", F.col("sequence").alias("attempted"), F.col("employee_id").alias("_own"))
    coded = _with_keys(with_type_codes(usable, leave_types)).join(owner, ["batch", "attempted"], "left")
    home = F.when(F.col("failed"), F.array("_own")).when(X.clean("employee_id") != "", F.array("employee_id")).otherwise(_id_windows("row_text"))
    shown = ["row_no", "failed", "retryable", "attempted", *FIELDS, "k_type", "k_name", "k_start", "k_end", "row_text"]
    placed = coded.withColumn("_home", F.explode(home)).join(circles.withColumnRenamed("employee_id", "_home"), ["batch", "_home"])
    rows = placed.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list(F.struct(*shown)))).alias("rows"))

    def step(state, row):
        fit = F.filter(state["waiting"], lambda w: fits(lambda n: w[n], lambda n: row[n]))
        gone = F.when(row["failed"], F.when(~row["retryable"], row["attempted"])).otherwise(F.get(fit, F.lit(0))["sequence"])

        def take(no):
            pair = F.struct(no.alias("sequence"), row["row_no"].alias("result_row"), F.when(row["failed"], "failed").otherwise("matched").alias("state"))
            return F.struct(F.filter(state["waiting"], lambda w: no.isNull() | (w["sequence"] != no)).alias("waiting"),
                            F.when(no.isNull(), state["pairs"]).otherwise(F.concat(state["pairs"], F.array(pair))).alias("pairs"))

        return X.bind(gone, take)

    none = F.array().cast("array<struct<sequence:bigint,result_row:bigint,state:string>>")
    start = F.struct(F.col("waiting"), none.alias("pairs"))
    both = waiting.join(rows, keys)
    return both.select(F.explode(F.aggregate("rows", start, step, lambda s: s["pairs"])).alias("p")).select("p.*")


def attempt_notes(results: DataFrame) -> DataFrame:
    """``sequence, note``: what the last attempt for a request said. The first of remark, error,
    row text and status that is not blank."""
    said = F.coalesce(*(F.when(X.clean(c) != "", F.col(c)) for c in ("remark", "error", "row_text", "status")), F.lit(""))
    return results.groupBy(F.col("attempted").alias("sequence")).agg(F.max_by(said, "row_no").alias("note"))


def decide_status(requests: DataFrame, results: DataFrame, conflicts: DataFrame, leave_types: DataFrame | None = None) -> DataFrame:
    """Outcome per request out of its submission's result and conflict tables.

    Conflicts beat results; a conflict table that names somebody else is abnormal; an
    empty result is a failure.
    """
    def counts(rows, prefix):
        empty = F.contains(F.coalesce("row_text", F.lit("")), F.lit(EMPTY_MARK))
        return rows.groupBy("batch").agg(F.count_if(~empty).alias(f"{prefix}_real"), F.count_if(empty).alias(f"{prefix}_none"))

    matched = first_matches(requests, results, leave_types)
    clash = first_matches(requests, conflicts, leave_types).select("sequence", F.col("result_row").alias("conflict_row"))
    per_batch = counts(results, "res").join(counts(conflicts, "con"), "batch", "full_outer").na.fill(0)
    sizes = requests.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).join(per_batch, "batch", "left").na.fill(0)
    joined = attach(matched.join(clash, "sequence", "left"), sizes, ["batch"], "_n", F.col("sequence"))
    found, conflict = F.col("result_row").isNotNull(), F.col("conflict_row").isNotNull()
    status = (
        F.when(F.col("con_real") > 0, F.when(conflict, "冲突").otherwise("异常"))
        .when(F.col("res_real") == 0, "失败")
        .when(~found, "异常")
        .when(F.col("con_none") > 0, "成功")
        .otherwise("失败")
    )
    return joined.withColumn("status", status).drop("_n", "res_real", "res_none", "con_real", "con_none")


def audit_flags(pairs: DataFrame) -> DataFrame:
    """Four yes/no columns of a request next to its result row (``r_`` columns).

    A blank result field does not contradict the request. ``r_k_type`` is the code that the
    shown leave type stands for (see ``with_type_codes``).
    """
    def yes(test):
        return F.when(F.coalesce(test, F.lit(False)), "是").otherwise("否")

    def blank(c):
        return X.clean(c) == ""

    return pairs.withColumns({
        "id_matched": yes(blank("r_employee_id") | (F.col("employee_id") == F.col("r_employee_id"))),
        "name_matched": yes(X.names_agree("name", "r_name")),
        "date_matched": yes((blank("r_start_date") | same_day_text("start_date", "r_start_date"))
                            & (blank("r_end_date") | same_day_text("end_date", "r_end_date"))),
        "type_matched": yes(blank("r_leave_type") | _types_agree()),
    })


def _types_agree() -> Column:
    by_name = (F.col("leave_name") != "") & F.contains("r_leave_type", F.col("leave_name"))
    return F.when(X.clean("r_k_type") != "", F.col("leave_type") == F.col("r_k_type")).otherwise(by_name)


def page_name_flag(given, shown) -> Column:
    """Name verdict of a report row, which tells a missing input name apart."""
    same = X.compact_name_key(given) == X.compact_name_key(shown)
    return F.when(X.clean(given) == "", "未提供").when(same, "是").otherwise("否")


def identity_problem() -> Column:
    """First disagreement between a request and its result row, empty when there is none."""
    c = F.col

    def clash(r, test):
        return (X.clean(r) != "") & ~test

    def words(what, asked, shown):
        return F.concat(F.lit(f"结果{what}不匹配: 输入"), c(asked), F.lit(", 页面"), c(shown))

    return (
        F.when(clash("r_employee_id", c("employee_id") == c("r_employee_id")), words("员工号", "employee_id", "r_employee_id"))
        .when(clash("r_name", X.names_agree("name", "r_name")), words("姓名", "name", "r_name"))
        .when(clash("r_start_date", same_day_text("start_date", "r_start_date")), words("开始日期", "start_date", "r_start_date"))
        .when(clash("r_end_date", same_day_text("end_date", "r_end_date")), words("结束日期", "end_date", "r_end_date"))
        .when(clash("r_leave_type", _types_agree()), words("锁班类型", "leave_name", "r_leave_type"))
        .otherwise("")
    )


def run_summary(requests: DataFrame, outcomes: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of a batch: valid, succeeded, failed, input errors."""
    valid = requests.agg(F.count(F.lit(1)).alias("n")).scalar()
    wrong = errors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return outcomes.agg(
        F.count_if(F.col("status") == "成功").alias("succeeded"), F.count_if(F.col("status") != "成功").alias("failed"),
    ).select(valid.alias("valid"), "succeeded", "failed", wrong.alias("input_errors"))


def merge_details(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two detail kinds in one table; columns only one side has are NULL on the other."""
    return first.unionByName(second, allowMissingColumns=True)


def row_of_employee(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """First table row that shows a request's ID or, failing that, its name.

    ``rows``: row_no, row_text. IDs are looked up among the digit windows of a row, names by
    the substring join.
    """
    ids = rows.select("row_no", F.explode(_id_windows("row_text")).alias("employee_id"))
    by_id = requests.select("employee_id").distinct().join(ids, "employee_id").groupBy("employee_id").agg(F.min("row_no").alias("id_row"))
    named = mentions(rows.withColumnRenamed("row_no", "text_row"), requests.withColumn("row_no", F.col("sequence")), "row_text", ["text_row"], automaton_needles=0)
    by_name = named.groupBy("name").agg(F.min("text_row").alias("name_row"))
    out, spread = requests.withColumn("name", X.clean("name")), F.col("sequence")
    for key, found in (("employee_id", by_id), ("name", by_name)):
        sizes = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        out = attach(out, found, [key], "_n", spread, counts=sizes)
    return out.withColumn("matched_row", F.least("id_row", "name_row")).drop("id_row", "name_row")
