"""Joins and scans against plain loops, with hot keys."""

import random
import tracemalloc
from datetime import date, timedelta

import ahocorasick
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterops.operators import mentions as M
from rosterops.operators import nearest as P
from rosterops.operators import reconcile as R
from rosterops.operators import requests as Q
from rosterops.operators import skew as K
from rosterops.operators import structure as S
from rosterops.operators import validate as V
from rosterops.operators.substring import containing, hit_words
from rosterops.sources import cells as C
from rosterops.sources import intake, packages, reports


def test_reconcile_golden(spark):
    rows = spark.createDataFrame([("s", 4, "张三，李四", "王五", ""), ("s", 5, "Tom", "王五", "李四")], "sheet string, row_no long, `学员` string, `教员` string, `检查员` string")
    left = R.name_entries(rows, ["学员", "教员", "检查员"], ["sheet", "row_no"])
    right = spark.createDataFrame([("全动", i, "", n, n.lower()) for i, n in enumerate(["张三", "李四", "李四", "王五", "TOM", "赵六"])], "sheet string, row_no long, role string, name string, match_name string")
    got = {r["match_name"]: (r["status"], r["diff"]) for r in R.reconcile(left, right).collect()}
    assert got == {"张三": ("一致", 0), "李四": ("一致", 0), "王五": ("场次多", 1), "tom": ("一致", 0), "赵六": ("仅账单有", -1)}
    summary = R.reconcile_summary(R.reconcile(left, right)).first()
    assert (summary["left_total"], summary["compared"], summary["mismatched"]) == (6, 5, 2)


def test_chinese_order(spark):
    df = spark.createDataFrame([(n,) for n in ("张", "王", "李", "陈")], "n string")
    assert [r[0] for r in df.orderBy(R.chinese_order("n")).collect()] == ["陈", "李", "王", "张"]


@pytest.mark.parametrize("tolerance", [2, 500])
def test_nearest_date_against_a_loop(spark, tolerance):
    rnd = random.Random(tolerance)
    day = lambda: date(2024, 1, 1) + timedelta(rnd.randrange(40))
    bills = [(i, "hot" if rnd.random() < 0.5 else rnd.choice("abc"), day()) for i in range(150)]
    checkins = [(i, "hot" if rnd.random() < 0.5 else rnd.choice("abd"), day()) for i in range(60)]
    got = P.match_nearest(spark.createDataFrame(bills, "bill_idx long, name string, day date"), spark.createDataFrame(checkins, "checkin_idx long, name string, day date"), tolerance)
    want, used = {}, set()
    for i, name, d in bills:
        best = min(((abs((d - c).days), k) for k, n, c in checkins if n == name and abs((d - c).days) <= tolerance), default=None)
        want[i] = ("unmatched", None) if best is None else ("duplicate" if best[1] in used else "matched", best[1])
        if best:
            used.add(best[1])
    assert {r["bill_idx"]: (r["status"], r["checkin_idx"]) for r in got.collect()} == want


def test_scans_and_attach_with_small_spans(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else "b", i, rnd.choice([None, None, f"t{i}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    last = K.running_last(df, ["k"], "i", F.col("v"), "o", span=7)
    first = K.running_last(df, ["k"], "i", F.col("v"), "o", reverse=True, span=7)
    total = K.running_sum(df, ["k"], "i", F.lit(1), "o", span=7)
    for out, pick in ((last, lambda own, i: next((v for _k, j, v in reversed(own) if j <= i and v), None)),
                      (first, lambda own, i: next((v for _k, j, v in own if j >= i and v), None)),
                      (total, lambda own, i: sum(1 for _k, j, _v in own if j <= i))):
        assert {r["i"]: r["o"] for r in out.collect()} == {i: pick([x for x in rows if x[0] == k], i) for k, i, _v in rows}
    monkeypatch.setattr(K, "HOT_ROWS", 20)
    marked = K.mark_first(df, ["k"], "i", "f")
    assert {r["i"] for r in marked.filter("f").collect()} == {min(i for k, i, _v in rows if k == key) for key in ("hot", "b")}
    assert marked.count() == len(rows)


def test_substring_join(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choice("abcd飞行") for _ in range(rnd.randrange(0, 60)))) for i in range(40)]
    needles = [(i, "".join(rnd.choice("abcd飞行") for _ in range(rnd.randrange(1, 7)))) for i in range(50)] + [(99, "")]
    want = {(n, t) for n, w in needles for t, body in texts if w and w in body}
    n, t = spark.createDataFrame(needles, "n long, w string"), spark.createDataFrame(texts, "t long, body string")
    tagged = t.withColumn("tag", F.lit(7)).withColumn("u", F.when(F.col("t") > 30, None).otherwise(F.col("t") % 3))
    n = n.withColumn("m", F.col("n") % 3)
    monkeypatch.setattr(K, "HOT_ROWS", 3)
    for way in ({}, {"automaton_needles": 0}, {"automaton_chars": 10}):
        got = containing(n, tagged, "w", "body", ["n"], ["t", "u"], carry=("tag",), **way).collect()
        assert sorted((r["n"], r["t"]) for r in got) == sorted(want) and {r["tag"] for r in got} == {7}
        got = containing(n, tagged, "w", "body", ["n", "m"], ["t", "u"], within=("m", "u"), **way).collect()
        assert sorted((r["n"], r["t"]) for r in got) == sorted((a, b) for a, b in want if b <= 30 and a % 3 == b % 3)
        assert containing(n.limit(0), t, "w", "body", ["n"], ["t"], **way).isEmpty()


def test_substring_join_repeats_and_wide_letters(spark):
    texts = [(1, "a" * 500), (2, "x😀y飞行手册😀"), (3, None), (4, ""), (5, "abcdXabcd"), (5, "abcdXabcd")]
    needles = [(1, "a" * 300), (2, "😀y飞"), (3, "a" * 501), (4, None), (5, "dXab"), (6, "abcdYabcd"), (7, "册😀"), (2, "😀y飞")]
    n, t = spark.createDataFrame(needles, "n long, w string"), spark.createDataFrame(texts, "t long, body string")
    for limit in (0, 100):
        got = containing(n, t, "w", "body", ["n"], ["t"], automaton_needles=limit).collect()
        assert sorted((r["n"], r["t"]) for r in got) == sorted((a, b) for a, w in needles for b, body in texts if w and body and w in body)


def test_automaton_holds_few_texts_as_objects():
    words = [f"n{k}" for k in range(50)]
    automaton = ahocorasick.Automaton()
    for number, word in enumerate(words):
        automaton.add_word(word, number)
    automaton.make_automaton()
    body = " ".join(words) + "x" * 20_000
    texts = pa.array([body, None, "", "n7 n7"] * 1_000)
    tracemalloc.start()
    found = hit_words(texts, automaton, pa.array(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # a text is 20 kB: all of them 20 MB
    got = [set(x) for x in found.slice(0, 4).to_pylist()]
    assert got == [set(words), set(), set(), {"n7"}] and len(found) == 4_000


def test_mentions_and_crosstab(spark):
    roster = spark.createDataFrame([("李四", 1), ("张三", 2), ("张三丰", 3), ("张三", 4)], "name string, row_no long")
    cells = spark.createDataFrame([(1, "A", "张三丰 李四"), (2, "A", "李四"), (3, "B", "无人"), (4, "B", "")], "c long, route string, text string")
    for hits in (M.mentions(cells, roster, "text", ["c", "route"]), M.mentions(cells, roster, "text", ["c", "route"], automaton_needles=0)):
        counts = {(r["name"], r["route"]): r["mentions"] for r in M.crosstab(hits, "route").collect()}
        assert counts == {("张三", "A"): 2, ("张三丰", "A"): 1, ("李四", "A"): 2}
        assert {r["c"]: r["names"] for r in M.names_in_text_order(hits, ["c"]).collect()}[1] == ["张三", "张三丰", "李四"]
        assert [r["c"] for r in M.unmatched_cells(cells, hits, ["c"], "text").collect()] == [3]
    wide = M.crosstab_wide(M.crosstab(M.mentions(cells, roster, "text", ["c", "route"]), "route"), "route", ["A", "B"]).collect()
    assert [(r["name"], r["A"], r["B"]) for r in wide] == [("李四", 2, None), ("张三", 2, None), ("张三丰", 1, None)]


def test_circles_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds, cut, rnd = [], Q.cut_lineage, random.Random(3)
    monkeypatch.setattr(Q, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    order = list(range(10_000))
    rnd.shuffle(order)
    pairs = [(1, i, f"{e:06d}") for i in range(9_999) for e in (order[i], order[i + 1])]
    pairs += [(2, 0, "000005"), (2, 0, "000007"), (2, 1, "000007"), (2, 1, "000003"), (2, 2, "000009")]
    links = spark.createDataFrame(pairs, "batch long, row_no long, employee_id string")
    people = links.select("batch", "employee_id").distinct().union(spark.createDataFrame([(2, "000001")], "batch long, employee_id string"))
    got = {(r["batch"], r["employee_id"]): r["circle"] for r in Q.joined_labels(people, links).collect()}
    assert len(got) == 10_005 and {v for (b, _), v in got.items() if b == 1} == {"000000"}
    assert {e: v for (b, e), v in got.items() if b == 2} == {
        "000001": "000001", "000003": "000003", "000005": "000003", "000007": "000003", "000009": "000009"}
    assert len(rounds) < 20


def test_structure_small(spark):
    p = [("1", "a", "技术：飞行教员C", "总队777", "公司检查员", "经理", True, False, False), ("2", "b", "技术：Z类机长", "湖南分公司", "", "", False, False, False),
         ("3", "c", "技术：A类机长", "外", "", "", False, False, False), ("4", "d", "技术：A1类副驾驶", "777返聘", "", "", False, False, False), ("5", "e", "地勤", "", "", "", False, False, False)]
    df = spark.createDataFrame(p, "employee_id string, name string, tech string, origin string, inspector_qualification string, management_role string, RAMA boolean, REUO boolean, RWAS boolean")
    df = df.withColumns({c: F.lit(False) for c in ("EAMA", "EEUO", "EWAS")})
    got = {(r["section"], r["item"]): (r["people"], r["base"], r["percent"]) for r in S.structure_report(df, 29).collect()}
    assert got[("总人数及空地人员占比", "总人数")] == (33, 33, "100%")
    assert got[("总人数及空地人员占比", "地面人员")] == (29, 33, "88%")
    assert got[("机长含以上各级别占比", "其他")] == (1, 3, "33%")
    assert got[("机长航线资格占比", "左座带飞")] == (1, 3, "33%")
    assert ("副驾驶级别占比", "其他") not in got
    origins = {r["item"]: r["people"] for r in S.origin_summary(df).collect()}
    assert (origins["飞行/总队 777"], origins["湖南"], origins["其他"], origins["上海"]) == (2, 1, 1, 0)
    assert {(r["kind"], r["value"]) for r in S.unrecognized(df).collect()} == {("tech", "地勤"), ("origin", "外")}


def test_hot_keys_join_like_others(spark, monkeypatch):
    from rosterops.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 4 if k < 30 else None, k) for k in range(33)] + [(9, 99)], "key int, no int")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "key int, word string")
    for how in ("left", "inner", "left_semi"):
        want = sorted(map(str, rows.join(known, "key", how).select("no").collect()))
        assert sorted(map(str, skew.attach(rows, known, ["key"], "n", F.col("no"), how=how, counts=counts).select("no").collect())) == want
    sized = counts.filter("key is not null").withColumn("word", F.col("key").cast("string"))
    assert skew.attach(rows, sized, ["key"], "n", F.col("no")).filter("word = key").count() == 31


def test_pairs_are_used_once(spark):
    fields = "sequence long, employee_id string, name string, leave_type string, leave_name string, start_date string, end_date string, batch string"
    day = "2024-01-02"
    req = [(1, "000001", "A", "X", "rest", day, day, "b"), (2, "000001", "A", "Y", "sick", day, day, "b"), (3, "000001", "A", "Y", "sick", day, day, "b"),
           (4, "000002", "B", "X", "rest", day, day, "b"), (5, "000003", "", "X", "rest", day, day, "b")]
    asked = spark.createDataFrame(req, fields)
    types = spark.createDataFrame([("X", "X-rest"), ("Y", "Y-sick")], "code string, label string")
    res = [
        (10, "000001", "", "", "", "", "b", "", None, False, False),  # nothing but an ID, and no text: fits nobody
        (11, "000001", "a（注）", "Y-sick", "2024/1/2", "2024/01/02", "b", "", None, False, False),  # a label, other forms of the day
        (12, "", "", "rest", "", "", "b", f"000001 000002 A B rest {day}", None, False, False),  # fits 1 and 4: the first one takes it
        (13, "000003", "", "", "", "", "b", "", 5, True, True),  # may be tried again: stays in the pool
        (14, "", "", "X", day, day, "b", "no. 000003", None, False, False),
        (15, "000001", "A", "Y", day, day, "b", "没有相关信息", None, False, False),
        (16, "000002", "", "", "", "", "b", "", 4, True, False),  # failed for good
        (17, "000002", "B", "X", day, day, "b", "", None, False, False),  # too late
    ]
    rows = spark.createDataFrame(res, "row_no long, employee_id string, name string, leave_type string, start_date string, end_date string, batch string, row_text string, attempted long, failed boolean, retryable boolean")
    got = {(r["sequence"], r["result_row"], r["state"]) for r in Q.pair_partial_rows(asked, rows, types).collect()}
    assert got == {(2, 11, "matched"), (1, 12, "matched"), (5, 14, "matched"), (4, 16, "failed")}
    whole = Q.pair_full_rows(asked, rows.filter("row_no = 11"), types)
    assert {(r["sequence"], r["result_row"]) for r in whole.collect()} == {(1, None), (2, 11), (3, None), (4, None), (5, None)}


def test_form_names_and_gate(spark):
    rows = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(["x", "x_2", "x", "x", "y", "x_2"], 1)], "position long, row_no long, `文件名` string")
    v = V.validate_rows(rows, [V.Field("q", "radio", "选", required=True, options=["a"])], "文件名", "表")
    assert [r["file_name"] for r in V.manifest(v).orderBy("row_no").collect()] == ["x.docx", "x_2.docx", "x_3.docx", "x_4.docx", "y.docx", "x_2_2.docx"]
    gate = V.gate(v).first()
    assert (gate["total"], gate["failed"], gate["open"]) == (6, 6, False)


def test_cells_sheets_and_headers(spark):
    grid = [("w", "s", 1, 0, "标题"), ("w", "s", 2, 0, " "), ("w", "s", 3, 0, "员工号"), ("w", "s", 3, 1, " 姓 名"), ("w", "s", 3, 2, "员工号"), ("w", "s", 4, 0, "7"), ("w", "s", 4, 1, "甲"), ("w", "s", 4, 2, "8")]
    cells = spark.createDataFrame([(*g, "s") for g in grid], "workbook string, sheet string, row_no long, col_no int, raw string, kind string")
    rows = C.header_row_all(cells, ["员工号", "姓名"], inner_spaces=False)
    headers = C.header_map(cells, rows, inner_spaces=False)
    got = C.bind(cells, headers, ["员工号", "姓名"]).first()
    assert (got["row_no"], got["员工号"], got["姓名"]) == (4, "7", "甲")
    assert {r["row_no"] for r in C.drop_blank_rows(cells).collect()} == {1, 3, 4}
    with pytest.raises(ValueError, match="备注"):
        C.require_headers(headers, ["员工号", "备注"], cells, "表")
    sheets = spark.createDataFrame([("w", "汇总", 1), ("w", "s", 2)], "workbook string, sheet string, sheet_no int")
    assert C.people_sheet(sheets, headers, ["员工号", "姓名"], "人员信息表", ["CRM"]).first()["sheet"] == "s"


def test_manifest_failed_log_and_report(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    files = packages.read_files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    sha = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    manifest = spark.createDataFrame([("a.txt", 5, sha), ("b.txt", 1, "x")], "path string, size long, sha256 string")
    assert {r["path"]: r["reason"] for r in packages.check_manifest(manifest, files).collect()} == {"a.txt": None, "b.txt": "项目包缺少文件"}
    good, bad = intake.split_rejects(manifest, F.when(F.col("size") < 2, "短"))
    assert (good.count(), bad.count()) == (1, 1)
    intake.write_failed(bad, ["path"], str(tmp_path / "failed"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "failed")).first()[1] == "短"
    report = reports.long_report({"一": manifest}, "path", "size")
    reports.write_long_report(report, str(tmp_path / "long"))
    reports.write_sections({"x": manifest}, str(tmp_path / "sections"), "csv")
    assert spark.read.parquet(str(tmp_path / "long")).count() == 2
    assert spark.read.option("header", "true").csv(str(tmp_path / "sections")).count() == 2


def test_near_pairs_against_a_loop(spark):
    rnd = random.Random(4)
    ranges = [(i, rnd.choice([1, 2]), a := rnd.randrange(0, 90), a + rnd.randrange(0, 25)) for i in range(30)]
    pieces = [(i, rnd.choice([1, 2]), a := rnd.randrange(0, 90), a + rnd.randrange(0, 12)) for i in range(40)]
    r, p = spark.createDataFrame(ranges, "i long, k long, lo int, hi int"), spark.createDataFrame(pieces, "j long, k long, a int, b int")
    got = [(x["i"], x["j"]) for x in K.near_pairs(r, p, "k", F.col("lo"), F.col("hi"), F.col("a"), F.col("b"), cell=7).collect()]
    want = {(i, j) for i, k, lo, hi in ranges for j, m, a, b in pieces if k == m and a <= hi and b >= lo}
    assert len(got) == len(set(got)) and set(got) == want


def test_first_result_rows_against_a_loop(spark):
    rnd = random.Random(8)
    pick = lambda: (f"00000{rnd.randrange(3)}", rnd.choice(["A", "B", ""]), rnd.choice(["X", "Y"]), f"2024-01-0{rnd.randrange(1, 4)}")
    req = [(i, e, n, t, t.lower() + "型", d, d) for i in range(30) for e, n, t, d in [pick()]]
    res = []
    for i in range(60):
        e, n, t, d = pick()
        bare = rnd.random() < 0.4
        res.append((i, "" if bare else e, n.lower(), t if rnd.random() < 0.7 else "", d.replace("-0", "/"), d if rnd.random() < 0.7 else "", f"{e} {n} {t.lower()}型 {d}" if rnd.random() < 0.8 else "没有相关信息"))
    asked = spark.createDataFrame(req, "sequence long, employee_id string, name string, leave_type string, leave_name string, start_date string, end_date string")
    rows = spark.createDataFrame(res, "row_no long, employee_id string, name string, leave_type string, start_date string, end_date string, row_text string")
    got = {r["sequence"]: r["result_row"] for r in Q.first_matches(asked, rows).collect()}

    def agrees(q, r):
        _s, e, n, t, tn, d1, d2 = q
        _i, re_, rn, rt, r1, r2, text = r
        day = lambda x: "-".join(p.zfill(2) if k else p for k, p in enumerate(x.replace("/", "-").split("-")))
        tests = [re_ == e if re_ else e in text, not n or (rn.upper() == n if rn else n in text), rt == t if rt else tn in text,
                 day(r1) == d1 if r1 else d1 in text, day(r2) == d2 if r2 else d2 in text]
        return "没有相关信息" not in text and all(tests)

    assert got == {q[0]: next((r[0] for r in res if agrees(q, r)), None) for q in req}


def test_written_files_against_their_manifest(spark, tmp_path):
    from rosterops.sources import intake, packages, reports

    lines = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "x\ty")], "part string, no int, line string")
    reports.write_text_files(lines, "part", "no", "line", str(tmp_path / "package"))
    files = packages.read_files(spark, str(tmp_path / "package")).filter("path like '%.txt'").selectExpr("regexp_extract(path, 'part=([^/]+)/', 1) as path", "size", "sha256")
    manifest = files.union(spark.createDataFrame([("c", 1, "0")], "path string, size long, sha256 string"))
    assert sorted((r["path"], r["size"]) for r in files.collect()) == [("a", 8), ("b", 4)]
    assert {r["path"]: r["reason"] for r in packages.check_manifest(manifest, files).collect()} == {"a": None, "b": None, "c": "项目包缺少文件"}
    failed = spark.createDataFrame([(1, "x y", None), (2, "a\tb", "bad"), (3, "", "none")], "row_no int, raw string, reason string")
    intake.write_failed(failed, ["row_no", "raw"], str(tmp_path / "failed"))
    assert sorted(tuple(r) for r in intake.read_failed(spark, ["row_no", "raw"], str(tmp_path / "failed")).collect()) == [("2", "a\tb", "bad"), ("3", None, "none")]
    report = reports.long_report({"s": lines.groupBy("part").count()}, "part", "count")
    reports.write_long_report(report, str(tmp_path / "report"))
    assert sorted(tuple(r) for r in reports.read_long_report(spark, str(tmp_path / "report"), "s").collect()) == [("s", "a", 2), ("s", "b", 1)]
