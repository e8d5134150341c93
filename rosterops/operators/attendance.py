"""Attendance: who took part, who is missing, who is booked twice, where lists differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.dates import date_text
from rosterops.functions.text import clean
from rosterops.functions.tables import literal_table
from rosterops.operators.records import coverage_policy
from rosterops.operators.skew import attach

ROLES = ["教员", "机长", "副驾驶", "未识别"]


def role_of(tech: Column) -> Column:
    text = clean(tech)
    return (
        F.when(F.contains(text, F.lit("教员")), "教员").when(F.contains(text, F.lit("机长")), "机长")
        .when(F.contains(text, F.lit("副驾驶")), "副驾驶").otherwise("未识别")
    )


def required_people(people: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """People with an ID or a name who are not on the exempt name list."""
    named = people.withColumns({"employee_id": clean("employee_id"), "name": clean("name")})
    named = named.filter((F.col("employee_id") != "") | (F.col("name") != ""))
    return named if exempt is None else named.join(exempt.select("name"), "name", "left_anti")


def year_records(training: DataFrame, year: int) -> DataFrame:
    """Active records of one year that name somebody."""
    rows = coverage_policy(training).filter(F.col("active") & (F.year("train_date") == year))
    rows = rows.withColumns({"employee_id": clean("employee_id"), "name": clean("name")})
    keyed = rows.withColumn("person", F.coalesce(F.nullif("employee_id", F.lit("")), F.nullif("name", F.lit(""))))
    return keyed.filter(F.col("person").isNotNull())


def _keys() -> Column:
    return F.array_distinct(F.filter(F.array("employee_id", "name"), lambda k: k != ""))


def attendance(required: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``attended`` and the earliest day; an ID or a name among the record keys counts.

    Records shrink to one row per key before the join; a person has at most two keys.
    """
    per_key = records.select(F.explode(_keys()).alias("key"), "train_date").groupBy("key").agg(F.min("train_date").alias("first_day"))
    asked = required.select("row_no", F.explode(_keys()).alias("key"))
    found = asked.join(per_key, "key").groupBy("row_no").agg(F.min("first_day").alias("first_day"))
    return required.join(found, "row_no", "left").withColumn("attended", F.col("first_day").isNotNull())


def participation(marked: DataFrame) -> DataFrame:
    return marked.groupBy(F.when(F.col("attended"), "attended").otherwise("missing").alias("kind")).agg(
        F.count(F.lit(1)).alias("people"))


def attendance_by_month(marked: DataFrame) -> DataFrame:
    """Twelve months of first attendances, then the missing bucket as month 0."""
    months = marked.sparkSession.range(0, 13).select(F.col("id").cast("int").alias("month"))
    counts = marked.groupBy(F.coalesce(F.month("first_day"), F.lit(0)).alias("month")).agg(F.count(F.lit(1)).alias("people"))
    return months.join(counts, "month", "left").na.fill(0)


def attendance_by_role(marked: DataFrame) -> DataFrame:
    """Required, attended, missing and rate per role.

    A required person counts as attended when any of their keys belongs to an attended
    *person*, so a namesake of one counts here although the plain total does not.
    """
    good = marked.filter("attended").select(F.explode(_keys()).alias("key")).distinct()
    hit = marked.select("row_no", F.explode(_keys()).alias("key")).join(good, "key", "left_semi").select("row_no").distinct()
    flagged = marked.join(hit.withColumn("hit", F.lit(True)), "row_no", "left")
    counts = flagged.groupBy(role_of(F.col("tech")).alias("role")).agg(
        F.count(F.lit(1)).alias("required"), F.count_if(F.coalesce("hit", F.lit(False))).alias("attended"))
    roles = literal_table(marked.sparkSession, [(r,) for r in ROLES], "role string")
    full = F.broadcast(roles).join(counts, "role", "left").na.fill(0)
    return full.select(
        "role", "required", "attended", (F.col("required") - F.col("attended")).alias("missing"),
        F.when(F.col("required") > 0, F.col("attended") / F.col("required")).otherwise(0.0).alias("rate"))


def duplicate_bookings(records: DataFrame) -> DataFrame:
    """People with more than one record: count, distinct days, distinct instructors.

    Days are bounded by the calendar and instructors by the staff list, so both lists are
    short. Row numbers are not; they come from ``duplicate_rows``.
    """
    grouped = records.groupBy("person").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.array_sort(F.collect_set(date_text("train_date"))).alias("days"),
        F.array_sort(F.collect_set(F.when(clean("instructor") != "", clean("instructor")))).alias("instructors"),
        F.min_by("name", "row_no").alias("name"),
    )
    return grouped.filter(F.col("bookings") > 1)


def duplicate_rows(records: DataFrame) -> DataFrame:
    """Every row of a person booked more than once."""
    sizes = records.groupBy("person").agg(F.count(F.lit(1)).alias("bookings"))
    return attach(records, sizes, ["person"], "bookings", F.col("row_no")).filter(F.col("bookings") > 1)


def session_people(training: DataFrame, project: str) -> DataFrame:
    """Distinct people per session ``(start, end)`` of one project, first row kept."""
    rows = coverage_policy(training).filter(
        (F.col("project") == project) & F.col("active") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    rows = rows.withColumns({"employee_id": clean("employee_id"), "name": clean("name")})
    person = F.when(F.col("employee_id") != "", F.concat(F.lit("id:"), "employee_id")).when(
        F.col("name") != "", F.concat(F.lit("name:"), "name"))
    label = F.concat_ws(" / ", F.nullif("employee_id", F.lit("")), F.nullif("name", F.lit("")))
    keyed = rows.withColumns({"person": person, "label": label}).filter(F.col("person").isNotNull())
    return keyed.groupBy("start_date", "end_date", "person").agg(
        F.min(F.struct("row_no", "label")).alias("f")).select(
        "start_date", "end_date", "person", F.col("f.row_no").alias("row_no"), F.col("f.label").alias("label"))


def roster_mismatch(training: DataFrame, left: str, right: str) -> DataFrame:
    """People in a session of one project but not in the same session of the other."""
    a, b = session_people(training, left), session_people(training, right)
    keys = ["start_date", "end_date"]
    shared = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)

    def missing(have, other, side):
        return (have.join(other.select(*keys, "person"), [*keys, "person"], "left_anti")
                .join(shared, keys, "left_semi").withColumn("only_in", F.lit(side)))

    return missing(a, b, left).unionByName(missing(b, a, right))


def duplicate_keys(rows: DataFrame, key: str, order: str = "row_no") -> DataFrame:
    """Keys that occur more than once, with count and first and last row."""
    keyed = rows.withColumn(key, clean(key)).filter(F.col(key) != "")
    return keyed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row"), F.max(order).alias("last_row"),
    ).filter(F.col("n") > 1)


def duplicate_rows_of(rows: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once, with the number ``n`` of them. A list of any
    length stays rows; heavy keys are spread."""
    keyed = rows.withColumn(key, clean(key)).filter(F.col(key) != "")
    sizes = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return attach(keyed, sizes, [key], "n", F.xxhash64(*rows.columns), how="inner")


def id_integrity(sets: DataFrame, group: str, key: str) -> DataFrame:
    """Per set: size, blank IDs, surplus of repeated IDs and the verdict.

    Counts per ID come first, so no set is gathered to find its distinct IDs.
    """
    per_id = sets.groupBy(group, clean(key).alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy(group).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("_id") == "", F.col("n"))), F.lit(0)).alias("blank"),
        F.sum(F.when(F.col("_id") == "", 0).otherwise(F.col("n") - 1)).alias("repeated"),
    ).withColumn("valid", (F.col("blank") == 0) & (F.col("repeated") == 0))
