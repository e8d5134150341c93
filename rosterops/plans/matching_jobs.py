"""Matching queries: reconciliation, nearest dates, mentions, structure, requests, cells, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterops.functions.text import clean, link_target
from rosterops.operators import mentions as M
from rosterops.operators import nearest as D
from rosterops.operators import reconcile as R
from rosterops.operators import requests as Q
from rosterops.operators import structure as S
from rosterops.operators import validate as V
from rosterops.operators.skew import mark_first
from rosterops.plans import inputs as I
from rosterops.session import new_folder
from rosterops.sources import cells as C
from rosterops.sources import intake, packages, reports


def _entries(spark, sf, kind):
    e = I.table(spark, sf, "events").filter(F.col("event_type") == kind)
    name = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    return e.select(F.lit(kind).alias("sheet"), F.col("event_id").alias("row_no"), F.lit("学员").alias("role"), name.alias("name"), F.lower(name).alias("match_name"))


def reconcile_counts(spark, sf):
    """How often each user occurs among purchases and signups."""
    return R.reconcile(_entries(spark, sf, "purchase"), _entries(spark, sf, "signup"))


def reconcile_summary(spark, sf):
    """Totals, distinct names and status counts of the reconciliation."""
    return R.reconcile_summary(reconcile_counts(spark, sf))


def reconcile_differences(spark, sf):
    """Only the names that differ."""
    return R.filter_status(reconcile_counts(spark, sf), "diff").select("match_name", "status", "diff")


def reconcile_references(spark, sf):
    """Source rows of each compared name as display text."""
    a, b = _entries(spark, sf, "purchase"), _entries(spark, sf, "signup")
    return R.reference_text(R.reference_rows(a, b, R.reconcile(a, b)))


def split_names_reconcile(spark, sf):
    """Comma lists of part name words per role against upper-case bill sheets."""
    p = I.table(spark, sf, "part")
    sessions = p.select(F.lit("场次").alias("sheet"), F.col("p_partkey").alias("row_no"),
                        F.concat(F.regexp_replace("p_name", " ", "， "), F.lit(",")).alias("学员"), F.lower("p_type").alias("教员"))
    left = R.name_entries(sessions, ["学员", "教员"], ["sheet", "row_no"])

    def bill(word, sheet):
        return p.select(F.lit(sheet).alias("sheet"), F.col("p_partkey").alias("row_no"), F.lit("").alias("role"), F.upper(word).alias("name"), F.lower(word).alias("match_name"))

    word = F.split("p_name", " ")
    right = R.union_sheets([bill(word[1], "全动"), bill(F.col("p_type"), "理论").filter(F.col("row_no") % 2 == 0)])
    return R.reconcile(left, right).select("match_name", "status", "left_count", "right_count", "diff", "note")


def key_union(spark, sf):
    """U4: distinct match names of both sides."""
    return R.key_union(_entries(spark, sf, "purchase"), _entries(spark, sf, "signup"), "match_name")


def _stays(spark, sf):
    e = I.table(spark, sf, "events")
    name, day = F.col("user_id").cast("string").alias("name"), F.col("ts").cast("date").alias("day")
    bills = e.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("bill_idx"), name, F.when(F.col("value") > 1, day).alias("day"))
    checkins = e.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("checkin_idx"), name, day)
    return bills, checkins


def nearest_date_match(spark, sf):
    """Nearest signup day per purchase within two days; reused hits are duplicates."""
    return D.match_nearest(*_stays(spark, sf), 2).select("bill_idx", "name", "day", "checkin_idx", "day_diff", "status")


def nearest_date_wide(spark, sf):
    """J2 with a tolerance of two years."""
    return D.match_nearest(*_stays(spark, sf), 730).select("bill_idx", "name", "day", "checkin_idx", "day_diff", "status")


def skipped_bills(spark, sf):
    """Purchases without a name or a day."""
    return D.skipped_bills(_stays(spark, sf)[0]).select("bill_idx", "name")


def proof_columns(spark, sf):
    """Proof links of matched bills as columns, wide enough for the longest list."""
    bills, checkins = _stays(spark, sf)
    matched = D.match_nearest(bills, checkins, 2)
    per = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(h).alias("header")) for i, h in ((3, "入住证明"), (5, "备注"), (7, "其他文件"))))
    links = checkins.select("checkin_idx", F.explode(per).alias("h")).select(
        "checkin_idx", "h.col_no", "h.header", F.concat(F.lit('=HYPERLINK("u'), F.col("checkin_idx").cast("string"), F.lit("-"), F.col("h.col_no").cast("string"), F.lit('","x")')).alias("f"))
    parsed = links.withColumn("l", link_target("f")).select("checkin_idx", "col_no", "header", "l.url", "l.label")
    shown = D.link_columns(D.proof_links(matched, parsed), 2)
    return D.pick_columns(shown, ["bill_idx", "status"], ["入住证明1", "入住证明2"]).withColumnsRenamed({"checkin_入住证明1": "link1", "checkin_入住证明2": "link2"})


def proof_width(spark, sf):
    """Number of link columns the report needs."""
    bills, checkins = _stays(spark, sf)
    links = checkins.select("checkin_idx", (F.col("checkin_idx") % 4).cast("int").alias("col_no"), F.lit("证明").alias("header"), F.lit("u").alias("url"), F.lit("x").alias("label"))
    return D.proof_width(D.proof_links(D.match_nearest(bills, checkins, 2), links))


def _roster(spark, sf):
    """Distinct words of part names."""
    words = I.table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("name"))
    return words.groupBy("name").agg(F.min("p_partkey").alias("row_no"))


def mentions_crosstab(spark, sf):
    """Documents per language that mention each roster word."""
    hits = M.mentions(I.documents(spark, sf), _roster(spark, sf), "text", ["doc_id", "lang"])
    return M.crosstab(hits, "lang").select("name", "lang", "mentions")


def mentions_wide(spark, sf):
    """A1: the crosstab with a column per language; a blank stands for zero."""
    hits = M.mentions(I.documents(spark, sf), _roster(spark, sf), "text", ["doc_id", "lang"])
    return M.crosstab_wide(M.crosstab(hits, "lang"), "lang", ["de", "en", "es", "fr"])


def mentions_lookup(spark, sf):
    """J3 by postings, the way for rosters of any size."""
    hits = M.mentions(I.documents(spark, sf), _roster(spark, sf), "text", ["doc_id", "lang"], automaton_needles=0)
    return hits.select("doc_id", "name", "position")


def first_positions(spark, sf):
    """Roster words of each document in text order."""
    hits = M.mentions(I.documents(spark, sf), _roster(spark, sf), "text", ["doc_id"])
    return M.names_in_text_order(hits, ["doc_id"]).select("doc_id", F.array_join("names", " ").alias("names"))


def unmatched_cells(spark, sf):
    """A2: documents that mention nobody, with a short note."""
    d = I.documents(spark, sf)
    hits = M.mentions(d, _roster(spark, sf), "text", ["doc_id"])
    return M.unmatched_cells(d, hits, ["doc_id"], "text", note_chars=50).select("doc_id", "note")


def route_order(spark, sf):
    """A1: report columns in first-seen order."""
    o = I.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("route"), F.col("o_orderkey").alias("row_no"))
    return M.route_order(o, "route")


def _annotated(spark, sf):
    labels = {c: i for i, (c, _p, _l) in enumerate(M.FOCUS_CATEGORIES)}
    c = I.table(spark, sf, "customer")
    sheet = F.concat(F.lit("2024"), I.nth(list(labels), F.col("c_nationkey") % 5), F.lit("名单"))
    lists = c.filter(F.col("c_acctbal") > 3000).select(F.col("c_name").alias("name"), sheet.alias("sheet")).unionByName(
        c.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_name").alias("name"), F.lit("长期关注").alias("sheet")))
    dim = M.sheet_category(lists, M.category_table(spark))
    focus = lists.join(dim, "sheet").select("name", "category", "priority", "label")
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), I.customer_name(F.col("o_custkey")).alias("name"), F.col("o_orderpriority").alias("sheet"))
    return M.annotate(o, focus, "name", "row_no")


def annotate_list(spark, sf):
    """Orders annotated with their customer's attention categories."""
    return _annotated(spark, sf).select("row_no", "annotated", "top_category")


def annotation_totals(spark, sf):
    """Matches per category and per sheet."""
    return M.annotation_totals(_annotated(spark, sf), "sheet")


def structure_report(spark, sf):
    """All conditional counts of the crew report."""
    return S.structure_report(I.personnel(spark, sf), 29).select("section", "item", "people", "base", "percent")


def origin_summary(spark, sf):
    """Crew per original unit."""
    return S.origin_summary(I.personnel(spark, sf)).select("item", "people", "base", "percent")


def unrecognized_values(spark, sf):
    """Technical texts and origins nobody knows."""
    return S.unrecognized(I.personnel(spark, sf))


def residual_people(spark, sf):
    """Persons behind the residual rows."""
    return S.residual_people(I.personnel(spark, sf))


def dedupe_first(spark, sf):
    """First document of each text; later copies are marked."""
    return mark_first(I.table(spark, sf, "documents").withColumn("key", F.md5("text")), ["key"], "doc_id", "is_first").select("doc_id", "is_first")


def request_intake(spark, sf):
    """Query list with a verdict per row."""
    o = I.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.lpad(F.col("o_custkey").cast("string"), 6, "1")).when(
        F.col("o_totalprice") > 250000, F.concat((F.col("o_custkey") + 200000).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    rows = o.select(F.col("o_orderkey").alias("row_no"), raw.alias("raw_id"), F.lit("  张  三 ").alias("raw_name"))
    return intake.read_requests(rows).select("row_no", "employee_id", "name", "shown_id", "reason")


def row_alignment(spark, sf):
    """Rows one cell wider than their header lose a leading number."""
    o = I.table(spark, sf, "orders")
    wide = F.array((F.col("o_orderkey") % 20000).cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"))
    cells = F.when(F.col("o_orderstatus") == "F", wide).otherwise(F.slice(wide, 2, 2))
    header = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("序号"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return o.select("o_orderkey", F.array_join(intake.align_cells(cells, header), "|").alias("cells"))


def _requests(spark, sf):
    """Orders as requests: one employee, type and span each."""
    o = I.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("sequence"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("employee_id"), I.customer_name(F.col("o_custkey")).alias("name"),
        F.upper(F.substring("o_orderpriority", 3, 3)).alias("leave_type"), F.lower("o_orderpriority").alias("leave_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end_date"), F.col("o_orderstatus").alias("batch"))


def _leave_types(spark, sf):
    """Leave codes with their labels."""
    kinds = I.table(spark, sf, "orders").select(F.upper(F.substring("o_orderpriority", 3, 3)).alias("code"), F.lower("o_orderpriority").alias("name")).distinct()
    return kinds.select("code", F.concat_ws("-", "code", F.regexp_replace("name", "^[0-9]-", "")).alias("label"))


def _results(spark, sf, extra=0):
    """Results of two thirds of the requests. Those of class F leave fields to the row text; of
    the others every third shows the label instead of the code, another third a name only."""
    r = _requests(spark, sf).filter(F.col("batch") != "O")
    bare = F.col("batch") == "F"
    text = F.concat_ws(" ", "employee_id", "name", "leave_name", "start_date")
    word = F.regexp_replace("leave_name", "^[0-9]-", "")
    kind = F.when(F.col("sequence") % 3 == 0, F.concat_ws("-", "leave_type", word)).when(F.col("sequence") % 3 == 1, word).otherwise(F.col("leave_type"))
    return r.select(
        (F.col("sequence") + extra).alias("row_no"), F.when(bare, "").otherwise(F.col("employee_id")).alias("employee_id"),
        F.when(bare, "").otherwise(F.concat(F.lower("name"), F.lit("（副）"))).alias("name"), F.when(bare, "").otherwise(kind).alias("leave_type"),
        F.when(bare, "").otherwise(F.regexp_replace("start_date", "-", "/")).alias("start_date"),
        F.when(bare, "").otherwise(F.regexp_replace("end_date", "-", "/")).alias("end_date"), text.alias("row_text"), "batch")


def first_result_matches(spark, sf):
    """First result row of each request, by ID or by the row text."""
    return Q.first_matches(_requests(spark, sf), _results(spark, sf), _leave_types(spark, sf)).select("sequence", "result_row")


def paired_results(spark, sf):
    """The k-th equal result takes the k-th equal request."""
    results = _results(spark, sf, 1).filter(F.col("batch") == "P")
    return Q.pair_full_rows(_requests(spark, sf), results, _leave_types(spark, sf)).select("sequence", "result_row")


def partial_pairs(spark, sf):
    """Results take the first waiting request they fit; fields are blank here and there.

    Of class P every seventh attempt failed for good and every eleventh may be tried again.
    A blank day stands in the text of even requests only, an ID in that of half of the F rows.
    """
    r = _requests(spark, sf)
    seq, failed = F.col("sequence"), (F.col("batch") == "P") & ((F.col("sequence") % 7 == 0) | (F.col("sequence") % 11 == 0))
    shown_id = (F.col("batch") == "P") | (seq % 4 < 2)
    answers = r.filter(F.col("batch") != "O").select(
        seq.alias("row_no"), seq.alias("attempted"), failed.alias("failed"), (seq % 7 != 0).alias("retryable"), "batch",
        F.when(shown_id, F.col("employee_id")).otherwise("").alias("employee_id"), F.when(shown_id, "").otherwise(F.col("name")).alias("name"), F.lit("").alias("leave_type"),
        F.regexp_replace("start_date", "-", "/").alias("start_date"), F.lit("").alias("end_date"),
        F.concat_ws(" ", F.when(shown_id, F.col("name")), "leave_name", F.when(seq % 2 == 0, F.col("end_date")), F.when(~shown_id, F.col("employee_id"))).alias("row_text"))
    return Q.pair_partial_rows(r, answers, _leave_types(spark, sf))


def attempt_notes(spark, sf):
    """What the last attempt for each request said."""
    r = _requests(spark, sf)
    tried = r.select(
        F.col("sequence").alias("row_no"), (F.col("sequence") % 1000).alias("attempted"), F.when(F.col("batch") == "F", "remark").otherwise(" ").alias("remark"),
        F.when(F.col("batch") == "P", F.concat(F.lit("error "), "leave_name")).alias("error"), F.lit("").alias("row_text"), F.col("batch").alias("status"))
    return Q.attempt_notes(tried)


def request_outcomes(spark, sf):
    """Status per request out of result and conflict rows of its batch."""
    results = _results(spark, sf)
    conflicts = _results(spark, sf).filter(F.col("batch") == "P").filter(F.col("row_no") % 2 == 0).unionByName(
        results.filter(F.col("batch") == "F").withColumn("row_text", F.lit("没有相关信息")))
    return Q.decide_status(_requests(spark, sf), results, conflicts, _leave_types(spark, sf)).select("sequence", "status")


def request_summary(spark, sf):
    """Valid, succeeded, failed and wrong inputs of a batch."""
    bad = request_intake(spark, sf).filter(F.col("reason").isNotNull())
    return Q.run_summary(_requests(spark, sf), request_outcomes(spark, sf), bad)


def audit_flags(spark, sf):
    """Match flags and the first disagreement of each pair."""
    r = _requests(spark, sf)
    shown = r.select("sequence", F.col("employee_id").alias("r_employee_id"), F.when(F.col("batch") == "F", "别人").otherwise(F.col("name")).alias("r_name"),
                     F.regexp_replace("start_date", "-", "/").alias("r_start_date"), F.when(F.col("batch") == "P", "2030-01-01").otherwise("").alias("r_end_date"),
                     F.when(F.col("batch") == "O", F.when(F.col("sequence") % 2 == 0, "ZZZ").otherwise(F.concat_ws("-", "leave_type", F.regexp_replace("leave_name", "^[0-9]-", "")))).otherwise("").alias("r_leave_type"))
    shown = Q.with_type_codes(shown.withColumnRenamed("r_leave_type", "leave_type"), _leave_types(spark, sf)).withColumnsRenamed({"leave_type": "r_leave_type", "k_type": "r_k_type"})
    pairs = Q.audit_flags(r.join(shown, "sequence")).withColumn("problem", Q.identity_problem())
    return pairs.select("sequence", "id_matched", "name_matched", "date_matched", "type_matched", "problem", Q.page_name_flag("name", "r_name").alias("page_name"))


def employee_rows(spark, sf):
    """First table row that shows an employee's ID or name."""
    rows = _requests(spark, sf).filter(F.col("batch") != "O").select(
        F.col("sequence").alias("row_no"), F.when(F.col("batch") == "F", F.concat_ws("/", "employee_id", "start_date")).otherwise(F.concat_ws("/", "name", "start_date")).alias("row_text"))
    return Q.row_of_employee(_requests(spark, sf), rows).select("sequence", "matched_row")


def whitelist_join(spark, sf):
    """Requests of listed employees."""
    allowed = I.table(spark, sf, "customer").filter(F.col("c_acctbal") > 5000).select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("employee_id"))
    return Q.whitelisted(_requests(spark, sf), allowed).select("sequence", "employee_id")


def merged_details(spark, sf):
    """Two detail kinds in one table."""
    a = I.table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    b = I.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return Q.merge_details(a, b)


HEADERS = ["员工号", "姓名", "项目名称", "备注"]


def _cells(spark, sf):
    """Customers as workbooks, one per segment, one sheet per nation, header on row 3 and data from row 4."""
    c = I.table(spark, sf, "customer")
    rows = c.select(F.col("c_mktsegment").alias("workbook"), F.concat(F.lit("表"), F.col("c_nationkey").cast("string")).alias("sheet"),
                    (F.col("c_custkey") + 4).alias("row_no"), F.col("c_custkey").cast("string").alias("a"), F.concat(F.lit("　"), F.col("c_name"), F.lit(" ")).alias("b"),
                    F.when(F.col("c_acctbal") < 0, "").otherwise(F.lit("项目")).alias("c"), F.lit("").alias("d"))
    sheets = rows.select("workbook", "sheet").distinct()

    def line(no, *texts):
        return sheets.select("workbook", "sheet", F.lit(no).cast("long").alias("row_no"), *(F.lit(t).alias(n) for t, n in zip(texts, "abcd")))

    titled = rows.unionByName(line(1, "标题", "", "", "")).unionByName(line(2, "", " ", "", "")).unionByName(line(3, " 员工号", "姓名", "项目 名称", "姓名"))
    return C.to_cells(titled, F.col("workbook"), F.col("sheet"), F.col("row_no"), ["a", "b", "c", "d"])


def header_rows(spark, sf):
    """Header row per sheet after blank rows left."""
    cells = C.drop_blank_rows(_cells(spark, sf))
    strict = C.header_row_all(cells, ["员工号", "姓名"])
    loose = C.header_row_all(cells, HEADERS, at_least=3, inner_spaces=False).withColumnRenamed("header_row", "loose_row")
    return strict.join(loose, C.SHEET)


def bound_rows(spark, sf):
    """S3: rows below the header as named columns; the first of two equal headers wins."""
    cells = _cells(spark, sf)
    headers = C.header_map(cells, C.header_row_all(cells, ["员工号", "姓名"]), inner_spaces=False)
    return C.bind(cells, headers, ["员工号", "姓名", "项目名称"]).select(
        "workbook", "sheet", "row_no", F.col("员工号").alias("employee_id"), clean("姓名").alias("name"), F.col("项目名称").alias("project"))


def missing_headers(spark, sf):
    """Headers a sheet lacks, and the column a keyword falls on."""
    cells = _cells(spark, sf)
    headers = C.header_map(cells, C.header_row_fixed(cells, 3), inner_spaces=False)
    lost = C.missing_headers(headers, HEADERS, cells)
    return lost.join(C.fuzzy_column(headers, "名称", 9), C.SHEET).join(
        C.fuzzy_column(headers, "备注", 9).withColumnRenamed("col_no", "fallback_col"), C.SHEET)


def sheet_roles(spark, sf):
    """Sheet per role by alias, the people sheet, and sheets nobody reads."""
    c = I.table(spark, sf, "customer")
    sheets = c.groupBy(F.col("c_mktsegment").alias("workbook"), F.concat(F.lit("表 "), (F.col("c_nationkey") % 6).cast("string")).alias("sheet")).agg(F.min("c_custkey").alias("sheet_no"))
    aliases = spark.createDataFrame([("表1", "甲"), ("表 2", "乙"), ("表3", "乙")], "alias string, role string")
    roles = C.sheets_by_alias(sheets, aliases)
    return roles.select("workbook", "role", "sheet").unionByName(C.unused_sheets(sheets, roles).select("workbook", F.lit("").alias("role"), "sheet"))


FORM = [V.Field("d", "date", "日期", required=True), V.Field("b", "boolean", "是否"), V.Field("r", "radio", "单选", options=["click", "view", "error"]),
        V.Field("m", "checkbox", "多选", options=["8", "7"]), V.Field("t", "text", "文本", default="无")]


def _form(spark, sf):
    e = I.table(spark, sf, "events")
    return V.validate_rows(e.select(
        (F.col("event_id") + 1).alias("position"), (F.col("event_id") + 2).alias("row_no"), F.when(F.col("value") > 20, F.concat(F.lit("表/"), F.col("user_id").cast("string"))).alias("文件名"),
        F.when(F.col("value") < 1, "").when(F.col("value") < 2, "2024-13-01").otherwise(F.date_format("ts", "yyyy/M/d")).alias("日期"),
        F.when(F.col("event_type") == "error", "或许").when(F.col("event_type") == "view", "是").otherwise("N").alias("是否"), F.col("event_type").alias("单选"),
        F.concat((F.col("user_id") % 10).cast("string"), F.lit("；7")).alias("多选"), F.lit(None).cast("string").alias("文本")), FORM, "文件名", "表单")


def batch_validation(spark, sf):
    """Validated rows with values, marks and errors."""
    f = _form(spark, sf)
    return f.select("row_no", "title", F.col("d").alias("day"), "b", "bPass", "bFail", "r", "r_click", "m", "m_8", "m_7", "t", F.array_join("errors", "|").alias("errors"))


def batch_gate(spark, sf):
    """Whether the batch may go out."""
    return V.gate(_form(spark, sf))


def unique_file_names(spark, sf):
    """Output names without repeats, in row order."""
    return V.manifest(_form(spark, sf)).select("row_no", "file_name", "state")


def evidence_import(spark, sf):
    """Check items with their two evidence lists."""
    b = I.table(spark, sf, "benchmark")
    items = b.select((F.col("item_id") + 2).alias("row_no"), F.when(F.col("item_id") % 7 != 0, F.col("item_id") + 1).alias("item_seq"), F.concat(F.lit("C"), F.col("item_id").cast("string")).alias("code"),
                     F.lit("").alias("name"), F.substring("text", 1, 10).alias("keyword"), F.when(F.col("item_id") % 3 == 0, "停用").otherwise("是").alias("enabled"))
    n = I.table(spark, sf, "nation")
    manual = n.select((F.col("n_nationkey") % 10 + 1).cast("long").alias("item_seq"), F.col("n_nationkey").cast("long").alias("row_no"), F.col("n_name").alias("document_name"), F.lit("证据").alias("text"))
    audit = n.select((F.col("n_regionkey") + 1).cast("long").alias("item_seq"), F.col("n_nationkey").cast("long").alias("row_no"), F.lit("").alias("content"), F.when(F.col("n_nationkey") > 5, F.col("n_name")).otherwise("").alias("note"))
    out = packages.import_evidence(items, manual, audit)
    return out.select("position", "code", "enabled", F.array_join(F.transform("manual", lambda x: x["document_name"]), ",").alias("manual"),
                      F.array_join(F.transform("audit", lambda x: x["note"]), ",").alias("audit"))


def field_configs(spark, sf):
    """Field table with either language's headers and type words."""
    n = I.table(spark, sf, "nation")
    words = list(packages.TYPE_SYNONYMS)
    config = n.select(F.col("n_name").alias("字段名"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("label"), I.nth(words, F.col("n_nationkey") % 12).alias("类型"),
                      F.when(F.col("n_regionkey") == 1, "是").otherwise("").alias("必填"), F.col("n_regionkey").cast("string").alias("rows"))
    return packages.parse_fields(config).select("name", "label", "type", "required", "rows")


def loop_fields(spark, sf):
    """Sub-fields of loop fields, from the named sheet or that of the field's own name."""
    n = I.table(spark, sf, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "loop").otherwise("text")
    fields = n.select(F.col("n_name").alias("name"), kind.alias("type"), F.when(F.col("n_regionkey") == 2, "shared").otherwise("").alias("sub_sheet"))
    c = I.table(spark, sf, "customer").join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    sheet = F.when(F.col("c_custkey") % 5 == 0, "shared").otherwise(F.col("n_name"))
    return packages.loop_fields(fields, c.select(sheet.alias("sheet"), F.col("c_name").alias("sub_name")))


def non_blank_rows(spark, sf):
    """Rows with at least one filled cell."""
    o = I.table(spark, sf, "orders")
    cells = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_custkey").cast("string")).alias("甲"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("乙 栏"))
    return V.non_blank_rows(cells, ["甲", "乙 栏"]).select("o_orderkey")


def reject_reasons(spark, sf):
    """Pasted lines that cannot be read, with the first reason."""
    o = I.table(spark, sf, "orders")
    six = F.when(F.col("o_orderkey") % 5 != 0, F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")).otherwise("x")
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    word = F.when(F.col("o_orderkey") % 3 != 0, F.upper(F.substring("o_orderpriority", 3, 3))).otherwise("?")
    lines = o.select(F.col("o_orderkey").alias("line_no"), F.concat_ws(" ", six, word, day).alias("line"))
    good, bad = intake.split_rejects(intake.parse_pasted(lines, "line", _leave_types(spark, sf)), intake.pasted_reason())
    return good.select("line_no", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("line_no", "reason"))



def written_report(spark, sf):
    """A report of several tables, written by section and read back."""
    o, n = I.table(spark, sf, "orders"), F.count(F.lit(1)).alias("n")
    sections = {"优先级": o.groupBy("o_orderpriority").agg(n), "状态": o.groupBy("o_orderstatus").agg(n), "客户": o.groupBy("o_custkey").agg(n)}
    keys = ["o_orderpriority", "o_orderstatus", "o_custkey"]
    report = reports.long_report({name: t.withColumnRenamed(k, "key") for k, (name, t) in zip(keys, sections.items(), strict=True)}, "key", "n")
    path = new_folder(spark, "report")
    reports.write_long_report(report, path)
    return reports.read_long_report(spark, path)


def failed_log(spark, sf):
    """Rows of the query list that failed, logged tab by tab for a second run and read back."""
    path = new_folder(spark, "failed")
    intake.write_failed(request_intake(spark, sf), ["row_no", "shown_id"], path)
    return intake.read_failed(spark, ["row_no", "shown_id"], path).select(F.col("row_no").cast("long").alias("row_no"), "shown_id", "reason")


def package_check(spark, sf):
    """A package of written files against its manifest, by size and SHA-256.

    A file holds one source's documents of ten thousand ids, a line each; the manifest names a file
    more, and has a wrong sum for one and a wrong size for another.
    """
    part = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 10_000).cast("string"))
    docs = I.table(spark, sf, "documents").select(part.alias("part"), "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text")).alias("line"))
    path = new_folder(spark, "package")
    reports.write_text_files(docs, "part", "doc_id", "line", path)
    whole = docs.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("l"))
    content = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    declared = whole.select("part", F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))
    declared = declared.select("part", F.when(F.col("part") == "src3-0", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                               F.when(F.col("part") == "src5-0", F.sha2("part", 256)).otherwise(F.col("sha256")).alias("sha256"))
    more = declared.filter(F.col("part") == "src1-0").withColumn("part", F.lit("none"))
    files = packages.read_files(spark, path).filter(F.col("path").endswith(".txt")).withColumn("path", F.regexp_extract("path", "part=([^/]+)/", 1))
    return packages.check_manifest(declared.union(more).withColumnRenamed("part", "path"), files)


QUERIES = {f.__name__: f for f in (
    loop_fields, non_blank_rows, reject_reasons, written_report, failed_log, package_check, reconcile_counts, reconcile_summary, reconcile_differences, reconcile_references, split_names_reconcile, key_union, nearest_date_match,
    nearest_date_wide, skipped_bills, proof_columns, proof_width, mentions_crosstab, mentions_wide, mentions_lookup, first_positions, unmatched_cells, route_order,
    annotate_list, annotation_totals, structure_report, origin_summary, unrecognized_values, residual_people, dedupe_first, request_intake,
    row_alignment, first_result_matches, paired_results, partial_pairs, attempt_notes, request_outcomes, request_summary, audit_flags, employee_rows,
    whitelist_join, merged_details, header_rows, bound_rows, missing_headers, sheet_roles, batch_validation, batch_gate, unique_file_names,
    evidence_import, field_configs)}
