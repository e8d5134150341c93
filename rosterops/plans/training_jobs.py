"""Training queries: records, rules, status board and its summaries, renewal, attendance, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterops.functions.dates import date_text
from rosterops.operators import attendance as A
from rosterops.operators import coverage as C
from rosterops.operators import health as H
from rosterops.operators import records as P
from rosterops.operators import renewal as N
from rosterops.operators import rules as R
from rosterops.plans import inputs as I

TODAY, STAGE_END, YEAR, RENEWAL_DAY = "2002-06-10", "2002-07-31", 1998, "1999-06-01"
CHOSEN = ["危险品", "TSA", "英语能力"]


def _board(spark, sf):
    excluded = I.table(spark, sf, "customer").filter(F.col("c_nationkey") == 7).select(
        F.col("c_name").alias("name"), F.lit("TSA").alias("project"))
    return C.status_board(I.expiry(spark, sf), I.shipments_as_training(spark, sf), TODAY, STAGE_END, excluded)


def _statuses(spark, sf):
    """Status, project and month of the board's rows, for queries that count them."""
    excluded = I.table(spark, sf, "customer").filter(F.col("c_nationkey") == 7).select(
        F.col("c_name").alias("name"), F.lit("TSA").alias("project"))
    return C.board_statuses(I.expiry(spark, sf), I.shipments_as_training(spark, sf), TODAY, STAGE_END, excluded)


def record_policies(spark, sf):
    """States for coverage and renewal, and the three memberships."""
    t = I.training(spark, sf)
    cover = P.coverage_policy(t).select("row_no", "active", "abnormal", "record_status", "record_reason", "train_date")
    renew = P.renewal_policy(t).select("row_no", F.col("active").alias("renew_active"), F.col("abnormal").alias("renew_abnormal"), F.col("record_status").alias("renew_status"))
    return cover.join(renew, "row_no").join(P.split_flags(t).select("row_no", "in_recorded", "in_pending", "in_update"), "row_no")


def rule_outcomes(spark, sf):
    """Window, due date, new expiry, judgement and write decision per order."""
    o = I.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    old = F.when(F.col("o_totalprice") > 30000, F.date_add("day", (F.col("o_totalprice") % 400).cast("int") - 200))
    aliased = F.when(F.col("o_orderpriority") == "2-HIGH", "DGET-危险品培训").otherwise(I.project_of(F.col("o_orderpriority")))
    rows = R.with_rules(R.canonical_project(o.withColumn("old", old), aliased), old="old")
    rule, day, was, today = R.Rule.of_columns(window=True), F.col("day"), F.col("old"), F.lit(RENEWAL_DAY).cast("date")
    new = R.new_expiry(rule, day, was)
    return rows.select(
        "o_orderkey", "project", R.window_start(rule, was).alias("win_start"), R.window_end(rule, was).alias("win_end"),
        R.due_date(rule, was).alias("due"), new.alias("new_expiry"), R.judgement(rule, day, was).alias("judgement"),
        R.write_decision(was, new, today).alias("decision"), R.plan_covers(rule, day, was).alias("covers"))


def stage_states(spark, sf):
    """Point status, stage status, urgency and need of each expiry."""
    o = I.table(spark, sf, "orders")
    rows = R.with_rules(o.select("o_orderkey", I.project_of(F.col("o_orderpriority")).alias("project"), F.col("o_orderdate").cast("date").alias("old")), old="old")
    rule, was = R.Rule.of_columns(window=True), F.col("old")
    start, end = F.lit("1998-03-01").cast("date"), F.lit("1998-04-30").cast("date")
    stage = R.stage_status(rule, start, end, was)
    rank = R.urgency_rank(rule, start, end, was, stage)
    return rows.select("o_orderkey", R.point_status(rule, start, was).alias("point"), stage.alias("stage"), rank.alias("urgency"),
                       R.urgency_label(rank).alias("urgency_label"), R.scheduling_need(rule, start, end, was).alias("need"))


def status_board(spark, sf):
    """The person-by-project board."""
    return _board(spark, sf).drop("reason")


def board_filter(spark, sf):
    """P5: facet filter with default statuses, projects and a keyword."""
    return C.filter_board(_board(spark, sf), projects=CHOSEN, keyword="1").drop("reason")


def status_cards(spark, sf):
    """A3: rows per status that needs attention."""
    return C.status_cards(_statuses(spark, sf)).drop("ord")


def project_matrix(spark, sf):
    """A4, A5: project by status counts, known projects zero-filled."""
    return C.project_matrix(_statuses(spark, sf), R.rule_table(spark))


def matrix_order(spark, sf):
    """A4: place of each project in the report."""
    return C.ranked_matrix(project_matrix(spark, sf)).select("project", "place")


def board_order(spark, sf):
    """Rank of each board row's status."""
    return C.with_status_rank(_board(spark, sf)).select("project", "employee_id", "status", "rank")


def month_grid(spark, sf):
    """Twelve months of due rows."""
    return C.month_grid(_statuses(spark, sf), 2002)


def person_risk(spark, sf):
    """Risk per person with the nearest due date."""
    return C.person_risk(_board(spark, sf), with_items=False)


def risk_items(spark, sf):
    """Every item behind a person's risk, in its place of the list."""
    risk = C.person_risk(_board(spark, sf)).select("person", F.posexplode("items").alias("place", "item"))
    return risk.select("person", "place", "item.rank", "item.status", "item.project", "item.due_date", "item.expiry")


def top_rows(spark, sf):
    """First 80 rows per project and status, with the true total."""
    return C.top_rows(_board(spark, sf), 80).select("project", "status", "rank", "total", "due_date", "name", "employee_id")


def board_facets(spark, sf):
    """Distinct projects, statuses and months of the board."""
    return C.facets(_board(spark, sf))


def worst_tones(spark, sf):
    """Worst display tone per person."""
    return C.worst_tone(_board(spark, sf), ["employee_id"])


def scheduled_distribution(spark, sf):
    """Scheduled rows by month, by day and by project."""
    return C.schedule_distribution(P.scheduled_rows(I.training(spark, sf)))


def schedule_filter(spark, sf):
    """Scheduled rows of one project in one month."""
    rows = P.scheduled_rows(I.training(spark, sf))
    return C.filter_schedule(rows, "TSA", year=YEAR).select("row_no", "project", "month", "train_date")


def selected_rows(spark, sf):
    """Board rows of chosen people."""
    chosen = I.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("employee_id"))
    return C.selected_rows(_board(spark, sf), chosen).select("project", "employee_id", "status")


def yearly_training(spark, sf):
    """Recorded head count of one year."""
    return C.yearly_training(P.recorded_rows(I.training(spark, sf)), YEAR)


def pending_defaults(spark, sf):
    """First meaningful value of each column of pending rows, per month and overall."""
    return P.pending_defaults(I.training(spark, sf), ["instructor", "machine_flag"])


def pending_sessions(spark, sf):
    """Distinct sessions of pending rows."""
    return P.pending_sessions(I.training(spark, sf))


def common_months(spark, sf):
    """Months in which every chosen project has flagged rows."""
    return P.common_months(I.training(spark, sf), CHOSEN)


def what_if_board(spark, sf):
    """Planned rows join the real ones for coverage only."""
    e = I.expiry(spark, sf)
    planned = e.filter(F.col("project") == "TSA").select(
        "project", "employee_id", "name", F.lit("2002-06-20").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        F.lit("").alias("remark"), F.lit(None).cast("string").alias("source"), "row_no")
    both = I.shipments_as_training(spark, sf).unionByName(P.what_if_rows(planned))
    return C.status_cards(C.status_board(e, both, TODAY, STAGE_END)).drop("ord")


def _older_cells(spark, sf):
    cells = I.expiry(spark, sf).withColumnRenamed("row_no", "person_row")
    older = F.when(F.col("raw_expiry").isin("待定", "/"), F.col("raw_expiry")).otherwise(
        F.date_format(F.date_add(F.lit("1997-01-01"), (F.col("person_row") % 700).cast("int")), "yyyy-MM-dd"))
    return cells.withColumn("raw_expiry", older)


def _renewal(spark, sf, **choice):
    return N.renewal_run(I.training(spark, sf), _older_cells(spark, sf), I.people(spark, sf), RENEWAL_DAY, **choice)


def renewal_run(spark, sf):
    """Every flagged row in order, written expiry carried to the next one."""
    return _renewal(spark, sf).select("row_no", "project", "person_row", "old_expiry", "new_expiry", "judgement", "result", "skip_status")


def renewal_choice(spark, sf):
    """The run of chosen projects in one month."""
    run = _renewal(spark, sf, projects=["TSA", "危险品"], month="1998-05")
    return run.select("row_no", "project", "person_row", "old_expiry", "new_expiry", "judgement", "result", "skip_status")


def written_expiry(spark, sf):
    """The people table after the run, written dates in place of the old cells."""
    return N.updated_expiry(_older_cells(spark, sf), _renewal(spark, sf)).select("person_row", "project", "raw_expiry")


def renewal_counts(spark, sf):
    """Counters of the run."""
    return N.renewal_counts(_renewal(spark, sf))


def updated_people(spark, sf):
    """People whose cells changed, with the last written dates."""
    entry = F.transform("changes", lambda x: F.concat_ws("=", x["project"], date_text(x["expiry"])))
    return N.updated_people(_renewal(spark, sf)).select("person_row", "changed_cells", F.array_join(entry, ";").alias("changes"))


def resolved_people(spark, sf):
    """Name-first resolution with its failure reasons, on names that occur twice."""
    people = I.people(spark, sf).withColumn("name", F.substring("name", 1, 16))
    rows = I.training(spark, sf).withColumn("name", F.when(F.col("row_no") % 5 == 0, "").otherwise(F.substring("name", 1, 16)))
    return N.resolve_people(rows, people).select("row_no", "person_row", "matched_by", "match_error")


def _attendance(spark, sf):
    rows = I.training(spark, sf).filter(F.col("project") == "TSA")
    exempt = I.table(spark, sf, "customer").filter(F.col("c_nationkey") == 3).select(F.col("c_name").alias("name"))
    records = A.year_records(rows, YEAR)
    return A.attendance(A.required_people(I.people(spark, sf), exempt), records), records


def attendance(spark, sf):
    """Who attended in the year, with the first day."""
    return _attendance(spark, sf)[0].select("row_no", "employee_id", "name", "attended", "first_day")


def participation(spark, sf):
    """A10: people who attended in the year and people who did not."""
    return A.participation(_attendance(spark, sf)[0])


def attendance_by_month(spark, sf):
    """First attendances per month and the missing bucket."""
    return A.attendance_by_month(_attendance(spark, sf)[0])


def attendance_by_role(spark, sf):
    """Required, attended, missing and rate per role."""
    return A.attendance_by_role(_attendance(spark, sf)[0])


def duplicate_bookings(spark, sf):
    """People booked more than once, with days and instructors."""
    d = A.duplicate_bookings(_attendance(spark, sf)[1])
    return d.select("person", "bookings", "name", F.array_join("days", ",").alias("days"), F.array_join("instructors", ",").alias("instructors"))


def duplicate_rows(spark, sf):
    """Every row of a person booked more than once."""
    return A.duplicate_rows(_attendance(spark, sf)[1]).select("person", "row_no", "bookings")


def roster_mismatch(spark, sf):
    """People in one of two sessions that share their days."""
    return A.roster_mismatch(I.training(spark, sf), "航空安保", "TSA").select("start_date", "end_date", "person", "row_no", "only_in")


def duplicate_ids(spark, sf):
    """Employee IDs on more than one record."""
    return A.duplicate_keys(I.training(spark, sf), "employee_id")


def duplicate_id_rows(spark, sf):
    """Every record of an ID that is on more than one."""
    return A.duplicate_rows_of(I.training(spark, sf), "employee_id").select("employee_id", "row_no", "n")


def id_integrity(spark, sf):
    """Per project, whether every ID is present and unique."""
    return A.id_integrity(I.training(spark, sf), "project", "employee_id")


def workbook_health(spark, sf):
    """One issue table out of all checks."""
    t, cells = I.training(spark, sf), I.expiry(spark, sf)
    raw = t.withColumn("raw_start", F.when(F.col("row_no") % 11 == 0, "待定").otherwise(date_text("start_date"))).withColumn(
        "raw_end", F.when(F.col("row_no") % 11 == 0, "").otherwise(date_text("end_date")))
    people = I.people(spark, sf).withColumn("employee_id", F.when(F.col("row_no") % 10 == 0, "").otherwise((F.col("row_no") - F.col("row_no") % 2).cast("string")))
    nameless = people.withColumn("name", F.when(F.col("row_no") % 20 == 0, "").otherwise(F.col("name")))
    marked, records = _attendance(spark, sf)
    sheets = t.select("sheet").distinct()
    used = sheets.filter(F.col("sheet") != "TSA")
    headers = spark.createDataFrame([("员工号",), ("姓名",), ("分部",)], "header string")
    return H.health_board([
        H.header_issues(headers, "人员信息表", H.REQUIRED_PEOPLE, H.SUGGESTED_PEOPLE), H.people_issues(nameless), H.training_issues(raw),
        H.project_issues(t, cells.filter(F.col("project") != "TSA")), H.mismatch_issues(t), H.attendance_issues(marked, records, YEAR),
        H.sheet_issues(sheets, used)])


QUERIES = {f.__name__: f for f in (
    record_policies, rule_outcomes, stage_states, status_board, board_filter, status_cards, project_matrix, matrix_order, board_order, month_grid, person_risk, risk_items, top_rows,
    board_facets, worst_tones, scheduled_distribution, schedule_filter, selected_rows, yearly_training, pending_defaults, pending_sessions, common_months, what_if_board,
    renewal_run, renewal_choice, written_expiry, renewal_counts, updated_people, resolved_people, attendance, participation, attendance_by_month, attendance_by_role, duplicate_bookings,
    duplicate_rows, roster_mismatch, duplicate_ids, duplicate_id_rows, id_integrity, workbook_health)}
