"""Rule cases, status board, renewal chain and identity rules."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from rosterops.operators import attendance as A
from rosterops.operators import coverage as C
from rosterops.operators import renewal as N
from rosterops.operators import rules as R

D = lambda x: date.fromisoformat(x) if x else None

# Project, old expiry, training day, judgement, new expiry, window start and end.
RENEWALS = [
    ("应急训练", None, "2000-01-01", "首次无旧值", "2002-02-28", None, None), ("应急训练", "2002-02-28", "2001-12-01", "命中窗口", "2004-02-29", "2001-12-01", "2002-02-28"),
    ("应急训练", "2002-02-28", "2002-02-28", "命中窗口", "2004-02-29", "2001-12-01", "2002-02-28"), ("应急训练", "2002-02-28", "2001-11-30", "提前窗口外", "2003-12-31", "2001-12-01", "2002-02-28"),
    ("应急训练", "2002-02-28", "2002-03-01", "超期", "2004-04-30", "2001-12-01", "2002-02-28"), ("危险品", None, "2000-01-01", "首次无旧值", "2002-01-01", None, None),
    ("危险品", "2027-06-15", "2027-03-15", "命中窗口", "2029-06-15", "2027-03-15", "2027-06-14"), ("危险品", "2027-06-15", "2027-06-15", "超期", "2029-06-15", "2027-03-15", "2027-06-14"),
    ("危险品", "2027-06-15", "2027-03-14", "提前窗口外", "2029-03-14", "2027-03-15", "2027-06-14"), ("英语能力", "2027-06-15", "2027-06-15", "命中窗口", "2030-06-15", "2027-03-15", "2027-06-15"),
    ("汉语能力", "2027-06-15", "2027-06-16", "超期", "2033-06-16", "2027-03-15", "2027-06-15"), ("航空安保", "2002-01-31", "2001-12-20", "最新日期重算", "2003-12-31", None, None),
    ("TSA", "2026-05-31", "2026-05-06", "最新日期重算", "2027-05-31", None, None), ("疲劳管理", "2002-01-31", "2000-06-15", "最新日期重算", "2002-06-30", None, None),
    ("飞行作风", "2002-01-31", "2002-03-01", "超期", "2004-03-31", None, None),
]
STAGES = [
    ("危险品", "2027-06-15", "2027-03-15", "2027-03-31", "命中窗口"), ("危险品", "2027-06-15", "2027-06-15", "2027-06-30", "已过期"),
    ("危险品", "2027-06-15", "2027-03-01", "2027-03-14", "有效未到窗口"), ("英语能力", "2027-06-15", "2027-06-15", "2027-06-30", "命中窗口"),
    ("航空安保", "2026-04-30", "2026-04-01", "2026-04-30", "本阶段到期"), ("航空安保", "2026-05-31", "2026-04-01", "2026-04-30", "阶段外未到期"),
]
DECISIONS = [(None, "2026-05-01", "已更新"), ("2026-04-30", "2026-04-30", "不变"), ("2026-04-30", "2026-01-31", "更新无效"), ("2026-12-31", "2026-06-30", "有效期回退"), ("2026-02-01", "2026-03-15", "更新无效")]


def test_renewal_rules(spark):
    rows = [(i, p, D(o), D(t)) for i, (p, o, t, *_rest) in enumerate(RENEWALS)]
    df = R.with_rules(spark.createDataFrame(rows, "i int, project string, old date, day date"))
    rule, old, day = R.Rule.of_columns(), F.col("old"), F.col("day")
    got = df.select("i", R.judgement(rule, day, old), R.new_expiry(rule, day, old), R.window_start(rule, old), R.window_end(rule, old)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: (j, D(n), D(a), D(b)) for i, (_p, _o, _t, j, n, a, b) in enumerate(RENEWALS)}


def test_stage_and_decision(spark):
    df = R.with_rules(spark.createDataFrame([(i, p, D(o), D(s), D(e)) for i, (p, o, s, e, _) in enumerate(STAGES)], "i int, project string, old date, s date, e date"))
    got = df.select("i", R.stage_status(R.Rule.of_columns(), F.col("s"), F.col("e"), F.col("old"))).collect()
    assert dict(map(tuple, got)) == {i: r[4] for i, r in enumerate(STAGES)}
    df = spark.createDataFrame([(i, D(o), D(n)) for i, (o, n, _) in enumerate(DECISIONS)], "i int, o date, n date")
    got = df.select("i", R.write_decision(F.col("o"), F.col("n"), F.lit("2026-04-01").cast("date"))).collect()
    assert dict(map(tuple, got)) == {i: r[2] for i, r in enumerate(DECISIONS)}


TRAINING = "project string, employee_id string, name string, start_date date, end_date date, recorded string, machine_flag string, remark string, sheet string, row_no long"


def test_board_precedence(spark):
    expiry = spark.createDataFrame([
        ("TSA", "1", "a", "2026-05-31", 2), ("TSA", "2", "b", "2026-05-31", 3), ("TSA", "3", "c", "2026-05-31", 4), ("TSA", "4", "d", "坏", 5), ("TSA", "5", "e", "N/A", 6),
        ("TSA", "", "f", "2026-06-30", 7), ("TSA", "7", "g", "2027-06-30", 8), ("TSA", "8", "h", "2026-08-31", 9), ("TSA", "9", "x", "2026-05-31", 10),
    ], "project string, employee_id string, name string, raw_expiry string, row_no long")
    rows = [
        ("TSA", "1", "zzz", "2026-05-06", "否", ""), ("TSA", "2", "b", "2026-06-09", "否", ""), ("TSA", "3", "c", "2026-05-06", "是", "取消"),
        ("TSA", "99", "f", "2026-07-05", "否", ""), ("TSA", "", "h", "2026-08-20", "否", "取消"),
    ]
    training = spark.createDataFrame([(p, i, n, D(s), None, r, "", m, p, k) for k, (p, i, n, s, r, m) in enumerate(rows)], TRAINING)
    excluded = spark.createDataFrame([("x", "TSA")], "name string, project string")
    board = C.status_board(expiry, training, "2026-06-10", excluded=excluded)
    assert {r["name"]: r["status"] for r in board.collect()} == {
        "a": "正常", "b": "已过期已排补训", "c": "异常", "d": "异常", "f": "已排未覆盖", "g": "正常", "h": "推荐排"}
    counted = C.board_statuses(expiry, training.unionByName(training), "2026-06-10", excluded=excluded)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, board.select("status", "project", "due_month").collect()))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "first_row" not in plan and "min(CASE" not in plan  # no row is looked for where only its kind counts


def test_blank_ids_only_meet_by_name(spark):
    people = spark.createDataFrame([("P", "1", "n", 1), ("P", "", "n", 2), ("P", "2", "m", 3)], "project string, employee_id string, name string, person_row long")
    days = spark.createDataFrame([("P", "1", "other", 10), ("P", "", "n", 11), ("P", "9", "n", 12), ("P", "2", "", 13)], "project string, t_id string, t_name string, k long")
    got = {(r["person_row"], r["k"]) for r in C.same_person(people, days).collect()}
    assert got == {(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)}


def _add(d, n):
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(1)).day
    return date(y, m + 1, min(d.day, last))


def test_renewal_chain_matches_a_plain_loop(spark):
    """A hot person with many rows on few days, latest-date and window rules."""
    rnd = random.Random(3)
    rows, k = [], 0
    for project in ("TSA", "英语能力"):
        for person in range(4):
            for _ in range(40 if person == 0 else 6):
                k += 1
                rows.append((project, str(person), f"p{person}", date(2026, 1, 1) + timedelta(rnd.randrange(0, 400)), k))
    training = spark.createDataFrame([(p, i, n, d, None, "是", "Y", "", p, k) for p, i, n, d, k in rows], TRAINING)
    cells = [(p, i, f"p{i}", "2026-06-15" if i % 2 else "", i) for p in ("TSA", "英语能力") for i in range(4)]
    expiry = spark.createDataFrame([(p, r, c) for p, _i, _n, c, r in cells], "project string, person_row long, raw_expiry string")
    people = spark.createDataFrame([(str(i), f"p{i}", i) for i in range(4)], "employee_id string, name string, row_no long")
    run = N.renewal_run(training, expiry, people, "2026-04-01")
    got = {r["row_no"]: (r["old_expiry"], r["new_expiry"], r["result"]) for r in run.collect()}
    want = {}
    for project in ("TSA", "英语能力"):
        for person in range(4):
            old = D("2026-06-15") if person % 2 else None
            for _p, _i, _n, day, k in sorted((r for r in rows if r[0] == project and r[1] == str(person)), key=lambda r: (r[3], r[4])):
                if project == "TSA":
                    moved = _add(day, 12)
                    new = _add(moved.replace(day=1), 1) - timedelta(1)
                else:
                    inside = old is not None and _add(old, -3) <= day <= old
                    new = _add(old, 36) if inside else _add(day, 36)
                word = "更新无效" if new < date(2026, 4, 1) else "有效期回退" if old and new < old else "不变" if new == old else "已更新"
                want[k] = (old, new, word)
                old = new if word == "已更新" else old
    assert got == want


def test_name_first_resolution(spark):
    people = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "b", 3), ("", "c", 4), ("5", "d", 5), ("5", "e", 6)], "employee_id string, name string, row_no long")
    rows = spark.createDataFrame([(1, "1", "a"), (2, "9", "a"), (3, "", "b"), (4, "3", "b"), (5, "8", "b"), (6, "7", "c"), (7, "1", ""), (8, "5", ""), (9, "77", "zz")], "row_no long, employee_id string, name string")
    got = {r["row_no"]: (r["person_row"], r["matched_by"], bool(r["match_error"])) for r in N.resolve_people(rows, people).collect()}
    assert got == {1: (1, "姓名", False), 2: (None, None, True), 3: (None, None, True), 4: (3, "姓名 + 员工号", False), 5: (None, None, True), 6: (4, "姓名", False),
                   7: (1, "员工号二次验证", False), 8: (None, None, True), 9: (None, None, True)}


def test_namesake_counts_by_role(spark):
    people = spark.createDataFrame([("1", "王", "机长", 1), ("2", "王", "机长", 2)], "employee_id string, name string, tech string, row_no long")
    records = spark.createDataFrame([("1", "", D("2026-02-01"))], "employee_id string, name string, train_date date")
    marked = A.attendance(people, records)
    assert {r["kind"]: r["people"] for r in A.participation(marked).collect()} == {"attended": 1, "missing": 1}
    role = [r for r in A.attendance_by_role(marked).collect() if r["role"] == "机长"][0]
    assert (role["required"], role["attended"]) == (2, 2)
