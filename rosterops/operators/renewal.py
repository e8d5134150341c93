"""Renewal run: flagged training rows move expiry dates, one row after another.

Rows of one person and project chain: a written result is the old expiry of the next row.
The chain is a fold, but not over raw rows. For a fixed training day the state can only
be written a bounded number of times before it stands still (a written expiry either
depends on the day alone or lies a whole validity past it), so within a day rows beyond
``STEPS`` all repeat the last outcome. The fold therefore runs over at most ``STEPS``
rows per calendar day, which a top-k cuts before the shuffle, and the remaining rows
take their day's last outcome through a skew-safe join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.functions.dates import date_text, month_key, training_date
from rosterops.functions.text import clean
from rosterops.operators import rules as R
from rosterops.operators.records import record_date, renewal_policy
from rosterops.operators.skew import attach

STEPS = 3

NAME_HIT, NAME_ID_HIT, ID_HIT = "姓名", "姓名 + 员工号", "员工号二次验证"


def resolve_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Name-first entity resolution: adds ``person_row, matched_by, match_error``.

    ``people``: employee_id, name, row_no. The distinct ``(name, id)`` pairs of the rows
    are resolved, not the rows, so the joins see each pair once.
    """
    roster = people.select(clean("employee_id").alias("p_id"), clean("name").alias("p_name"), F.col("row_no").alias("p_row"))
    pick = [F.count(F.lit(1)).alias("n"), F.min("p_row").alias("row")]
    by_name = roster.filter("p_name <> ''").groupBy("p_name").agg(*pick, F.min_by("p_id", "p_row").alias("id"))
    by_both = roster.filter("p_name <> '' and p_id <> ''").groupBy("p_name", "p_id").agg(*pick)
    by_id = roster.filter("p_id <> ''").groupBy("p_id").agg(*pick)
    keyed = rows.withColumns({"employee_id": clean("employee_id"), "name": clean("name")})
    pairs = keyed.groupBy("name", "employee_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = (
        pairs.join(by_name.select(F.col("p_name").alias("name"), F.col("n").alias("nn"), F.col("row").alias("nr"), "id"), "name", "left")
        .join(by_both.select(F.col("p_name").alias("name"), F.col("p_id").alias("employee_id"),
                             F.col("n").alias("bn"), F.col("row").alias("br")), ["name", "employee_id"], "left")
        .join(by_id.select(F.col("p_id").alias("employee_id"), F.col("n").alias("dn"), F.col("row").alias("dr")), "employee_id", "left")
    )
    one, many = F.col("nn") == 1, F.col("nn") > 1
    conflict = (F.col("employee_id") != "") & (F.col("id") != "") & (F.col("id") != F.col("employee_id"))
    error = (
        F.when(one & conflict, F.concat(F.lit("姓名命中，但员工号不一致（人员信息表："), F.col("id"), F.lit("）。")))
        .when(many & (F.col("employee_id") == ""), "人员信息表中存在重名，且项目 sheet 的更新记录缺少员工号，无法唯一定位。")
        .when(many & (F.coalesce("bn", F.lit(0)) != 1), "人员信息表中存在重名，员工号也无法唯一确认。")
        .when(F.col("nn").isNull() & (F.col("dn") > 1), "员工号命中多行，无法唯一定位。")
        .when(F.col("nn").isNull() & F.col("dn").isNull(), "未在人员信息表中找到对应人员。")
    )
    resolved = joined.select(
        "name", "employee_id", "_n", error.alias("match_error"),
        F.when(error.isNotNull(), None).when(one, F.col("nr")).when(many, F.col("br")).otherwise(F.col("dr")).alias("person_row"),
        F.when(error.isNotNull(), None).when(one, NAME_HIT).when(many, NAME_ID_HIT).otherwise(ID_HIT).alias("matched_by"),
    )
    return attach(keyed, resolved, ["name", "employee_id"], "_n", F.col("row_no")).drop("_n")


def _outcome(rule: R.Rule, day: Column, old: Column, today: Column) -> Column:
    new = R.new_expiry(rule, day, old)
    return F.struct(
        old.alias("old"), new.alias("new"), R.judgement(rule, day, old).alias("judgement"),
        R.write_decision(old, new, today).alias("result"),
    )


def fold_chain(steps: Column, old: Column, rule: R.Rule, today: Column) -> Column:
    """Outcomes of date-sorted steps ``(day, rank, row_no)``, the written expiry carried along."""
    none = F.array().cast(
        "array<struct<day:date,rank:int,row_no:bigint,old:date,new:date,judgement:string,result:string>>")

    def move(state, step):
        done = _outcome(rule, step["day"], state["expiry"], today)
        kept = F.struct(step["day"].alias("day"), step["rank"].alias("rank"), step["row_no"].alias("row_no"),
                        done["old"].alias("old"), done["new"].alias("new"), done["judgement"].alias("judgement"), done["result"].alias("result"))
        expiry = F.when(done["result"] == "已更新", done["new"]).otherwise(state["expiry"])
        return F.struct(expiry.alias("expiry"), F.concat(state["log"], F.array(kept)).alias("log"))

    return F.aggregate(steps, F.struct(old.alias("expiry"), none.alias("log")), move)


def renewal_run(
    training: DataFrame, expiry: DataFrame, people: DataFrame, today: str,
    projects: list[str] | None = None, month: str | None = None,
) -> DataFrame:
    """One row per flagged training row, processed or skipped.

    ``expiry``: person_row, project, raw_expiry. Columns out: project, sheet, row_no,
    employee_id, name, person_row, old_expiry, new_expiry, judgement, result, skip_status,
    reason, old_text.
    """
    now = F.lit(today).cast("date")
    rows = renewal_policy(training).filter(F.col("active") | F.col("abnormal"))
    if projects:
        rows = rows.filter(F.col("project").isin(projects))
    if month:
        rows = rows.filter(month_key(record_date()) == month)
    matched = resolve_people(rows, people)
    skip = (
        F.when(F.col("abnormal"), "记录异常")
        .when(F.col("start_date").isNull(), "日期异常")
        .when(F.col("match_error").isNotNull(), "匹配失败")
    )
    why = F.when(F.col("abnormal"), F.col("record_reason")).when(
        F.col("start_date").isNull(), "培训开始日期无法解析。").otherwise(F.col("match_error"))
    staged = matched.withColumns({"skip_status": skip, "skip_reason": why})
    ready = staged.filter(F.col("skip_status").isNull())

    day_keys = ["person_row", "project", "start_date"]
    order = Window.partitionBy(*day_keys).orderBy("row_no")
    ranked = ready.select(*day_keys, "row_no").withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= STEPS)
    chains = ranked.groupBy("person_row", "project").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start_date").alias("day"), "rank", "row_no"))).alias("steps"))
    current = expiry.select("person_row", "project", "raw_expiry", training_date("raw_expiry").alias("expiry_now"))
    folded = R.with_rules(chains.join(current, ["person_row", "project"], "left")).select(
        "person_row", "project", "raw_expiry", *R.RULE_COLUMNS,
        fold_chain(F.col("steps"), F.col("expiry_now"), R.Rule.of_columns(), now).getField("log").alias("log"))
    per_day = folded.select("person_row", "project", "raw_expiry", *R.RULE_COLUMNS, F.explode("log").alias("o")).groupBy(
        "person_row", "project", F.col("o.day").alias("start_date")).agg(
        F.sort_array(F.collect_list(F.struct("o.rank", "o.row_no", "o.old", "o.new", "o.judgement", "o.result"))).alias("outcomes"),
        F.first("raw_expiry").alias("raw_expiry"), *(F.first(c).alias(c) for c in R.RULE_COLUMNS))
    sizes = ready.groupBy(*day_keys).agg(F.count(F.lit(1)).alias("_n"))
    done = attach(ready, per_day, day_keys, "_n", F.col("row_no"), counts=sizes)
    own = F.get(F.filter("outcomes", lambda o: o["row_no"] == F.col("row_no")), F.lit(0))
    outcome = F.coalesce(own, F.element_at("outcomes", -1))
    rule = R.Rule.of_columns()
    shown = ["project", "sheet", "row_no", "employee_id", "name", "person_row"]
    processed = done.withColumn("o", outcome).select(
        *shown, F.col("o.old").alias("old_expiry"), F.col("o.new").alias("new_expiry"),
        F.col("o.judgement").alias("judgement"), F.col("o.result").alias("result"),
        F.lit(None).cast("string").alias("skip_status"),
        F.concat_ws("；", F.concat(F.lit("匹配方式："), F.col("matched_by")),
                    R.expiry_reason(rule, F.col("start_date"), F.col("o.old")),
                    R.write_reason(F.col("o.old"), F.col("o.new"), now)).alias("reason"),
        F.coalesce(F.nullif(date_text("o.old"), F.lit("")), F.nullif(clean("raw_expiry"), F.lit("")), F.lit("无")).alias("old_text"),
    )
    missing = F.lit(None)
    skipped = staged.filter(F.col("skip_status").isNotNull()).select(
        *shown, missing.cast("date").alias("old_expiry"), missing.cast("date").alias("new_expiry"),
        missing.cast("string").alias("judgement"), missing.cast("string").alias("result"),
        "skip_status", F.col("skip_reason").alias("reason"), F.lit("").alias("old_text"))
    return processed.unionByName(skipped)


def renewal_counts(run: DataFrame) -> DataFrame:
    """Counters of one run, as a single row."""
    results = {"updated": "已更新", "unchanged": "不变", "rollback": "有效期回退", "invalid": "更新无效"}
    return run.agg(
        F.count(F.lit(1)).alias("matched"),
        *(F.count_if(F.col("result") == word).alias(name) for name, word in results.items()),
        F.count_if(F.col("skip_status").isNotNull()).alias("skipped"),
    )


def updated_people(run: DataFrame) -> DataFrame:
    """People that changed: changed projects and their last written expiry."""
    written = run.filter(F.col("result") == "已更新")
    last = written.groupBy("person_row", "project").agg(F.max("new_expiry").alias("expiry"))
    entry = F.struct("project", "expiry")
    return last.groupBy("person_row").agg(
        F.count(F.lit(1)).alias("changed_cells"), F.sort_array(F.collect_list(entry)).alias("changes"))


def updated_expiry(expiry: DataFrame, run: DataFrame) -> DataFrame:
    """The people table after the run: written dates replace the old cells."""
    last = run.filter(F.col("result") == "已更新").groupBy("person_row", "project").agg(F.max("new_expiry").alias("written"))
    return expiry.join(last, ["person_row", "project"], "left").select(
        *[c for c in expiry.columns if c != "raw_expiry"],
        F.coalesce(date_text("written"), F.lit("")).alias("_w"), "raw_expiry",
    ).withColumn("raw_expiry", F.when(F.col("_w") != "", F.col("_w")).otherwise(F.col("raw_expiry"))).drop("_w")
