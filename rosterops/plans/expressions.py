"""Queries that exercise the Column expressions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterops.functions import dates as D
from rosterops.functions import normal as N
from rosterops.functions import ranges as G
from rosterops.functions import text as X
from rosterops.operators.locate import evidence_segments
from rosterops.operators.review import chapter_label, section_number, stable_title
from rosterops.operators.validate import NO_WORDS, YES_WORDS
from rosterops.plans import inputs as I
from rosterops.sources import intake
from rosterops.sources import text_blocks as T


def text_cleaning(spark, sf):
    """cleaning, squeezing, word tests and safe names."""
    d = I.documents(spark, sf)
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    return d.select(
        "doc_id", F.md5(X.clean(padded)).alias("cleaned"), F.md5(X.squeeze("text")).alias("squeezed"),
        F.length(X.strip_spaces("text")).alias("solid_chars"), X.is_null_word(F.lit(" N/A ")).alias("null_word"),
        X.is_true_word(F.col("lang")).alias("true_word"), X.has_value("text").alias("has_value"),
        X.safe_name(F.concat("doc_name", F.lit("/:  "), F.col("text"))).alias("safe"),
        X.sheet_name(F.concat("doc_name", F.lit("[a]"))).alias("sheet"))


def number_parsing(spark, sf):
    """numbers in text, yes/no words, clock text without minutes."""
    e = I.table(spark, sf, "events")
    flag = X.yes_no(F.substring("event_type", 1, 1), [*YES_WORDS, "s"], [*NO_WORDS, "v"])
    clock = F.date_format("ts", "HH:mm")
    return e.select("event_id", X.number_like("props").alias("k"), X.number_like(F.col("value").cast("string")).alias("v"),
                    flag["value"].alias("flag"), flag["valid"].alias("flag_valid"), X.cut_minutes(clock).alias("hours"))


def date_formats(spark, sf):
    """The same day written in many ways comes back as the same day."""
    o = I.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    serial = F.datediff("d", F.lit("1899-12-30").cast("date"))
    texts = [F.date_format("d", f) for f in ("yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd")]
    mixed = F.when(F.col("o_orderstatus") == "F", texts[0]).when(F.col("o_orderstatus") == "O", texts[1]).otherwise(texts[2])
    late = F.add_months("d", 240)
    lodging = F.when(F.col("o_orderstatus") == "F", (serial + F.datediff(late, "d")).cast("string")).when(
        F.col("o_orderstatus") == "O", F.date_format(late, "yy/MM/dd")).otherwise(F.date_format(late, "yyyy-M-d HH:mm"))
    overflow = F.concat(F.year("d").cast("string"), F.lit("-02-31"))
    return o.select(
        "o_orderkey", D.training_date(mixed).alias("training"), D.training_date(serial.cast("string"), F.lit("n")).alias("serial"),
        D.training_date(overflow).alias("rolled"), D.lodging_date(lodging).alias("lodging"), D.form_date(mixed).alias("form"),
        D.form_date(overflow).alias("form_strict"), D.format_form_date(F.col("d")).alias("shown"), D.query_date(texts[1]).alias("query"),
        D.query_date_text(texts[1], "/").alias("query_text"), D.same_day_text(texts[0], F.concat(texts[0], F.lit(" 08:00"))).alias("same_day"))


def month_arithmetic(spark, sf):
    """month keys, bounds, clamped additions and overlaps."""
    o = I.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    bounds = D.month_bounds(D.month_key("d"))
    return o.select(
        "o_orderkey", D.month_key("d").alias("month"), bounds["start"].alias("first_day"), bounds["end"].alias("last_day"),
        F.add_months("d", -3).alias("back3"), F.add_months("d", 24).alias("ahead24"),
        D.ranges_overlap("d", F.date_add("d", 10), F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date")).alias("overlaps"),
        F.datediff(F.lit("1998-01-01").cast("date"), "d").alias("days"))


def month_facets(spark, sf):
    """sorted distinct months per project."""
    t = I.training(spark, sf)
    months = t.select("project", D.month_key("start_date").alias("month")).distinct()
    return months.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"))


def extract_ids(spark, sf):
    """Six-digit runs, their counts and their sorted distinct list."""
    d = I.documents(spark, sf).withColumn("runs", X.six_digit_runs("text"))
    return d.select("doc_id", F.size("runs").alias("found"), F.size(F.array_distinct("runs")).alias("distinct_found"),
                    F.array_join(X.sorted_ids(F.col("runs")), ",").alias("ids"))


def identity_keys(spark, sf):
    """person keys, ID forms, whitelists and name agreement."""
    c = I.table(spark, sf, "customer")
    six = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    noted = F.concat(F.lower("c_name"), F.lit(" （借调） "))
    return c.select(
        "c_custkey", X.person_key("c_name", F.col("c_custkey")).alias("person_key"),
        X.numeric_employee_id(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0"))).alias("numeric_id"),
        X.six_digit_employee_id(F.concat(F.lit("ID-"), six, F.lit("/x"))).alias("six_id"),
        F.array_join(X.whitelist_ids(F.concat(six, F.lit("，"), six, F.lit(";999999"))), ",").alias("whitelist"),
        X.names_agree("c_name", noted).alias("agree"), X.compact_name_key(noted).alias("compact"))


def leave_types(spark, sf):
    """the code of a leave text, whatever form it is written in."""
    e = I.table(spark, sf, "events")
    kinds = e.select("event_type").distinct().select(F.upper("event_type").alias("code"), F.concat_ws("-", F.upper("event_type"), "event_type").alias("label"))
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.upper("event_type")).when(form == 1, F.concat_ws("-", F.upper("event_type"), "event_type"))
        .when(form == 2, F.concat(F.lit("申请 "), F.upper("event_type"), F.lit(" 一天"))).otherwise(F.concat(F.lit("申请"), F.col("event_type"))))
    return intake.resolve_leave_type(e.select("event_id", text.alias("leave_text")), "leave_text", kinds, "leave_type")


def pasted_records(spark, sf):
    """ID, name and dates of pasted lines, long lines cut first."""
    o = I.table(spark, sf, "orders")
    six = F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")
    one = F.concat(six, F.lit("张三丰 "), F.date_format("o_orderdate", "yyyy-M-d"), F.lit(" 至 "), F.date_format(F.date_add("o_orderdate", 3), "yyyy/MM/dd"), F.lit(" "))
    text = F.repeat(one, 4)
    lines = intake.pasted_lines(o.select("o_orderkey", text.alias("pasted")), "pasted", ["o_orderkey"])
    return intake.parse_pasted(lines, "line").drop("line")


def word_joining(spark, sf):
    """words between whitespace, punctuation and symbols, joined again."""
    d = I.documents(spark, sf)
    return d.select("doc_id", F.size(X.split_words("text")).alias("words"), F.md5(X.join_words("text", "|")).alias("joined"))


def tech_levels(spark, sf):
    """level code and label of technical texts."""
    p = I.people(spark, sf)
    return p.select("row_no", X.tech_level("tech").alias("level"), X.after_colon("tech").alias("label"))


def loose_texts(spark, sf):
    """F32: loose text of every document, whole texts."""
    return I.documents(spark, sf).select("doc_id", F.md5(N.loose_text("text")).alias("loose"))


def match_texts(spark, sf):
    """match text and identifiers of every document line."""
    lines = I.lines_of(I.documents(spark, sf)).withColumn("lowered", N.nfkc_lower("text"))
    return lines.select("doc_id", "line_no", F.md5(N.match_text(F.col("lowered"))).alias("norm"),
                        F.array_join(N.id_tokens(F.col("lowered")), " ").alias("tokens"))


def turn_similarity(spark, sf):
    """grams and similarity of each turn and the next one."""
    t = I.turns(spark, sf).withColumn("norm", N.match_text(N.nfkc_lower("text"))).withColumn("grams", N.grams(F.col("norm")))
    nxt = t.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("norm").alias("n2"), F.col("grams").alias("g2"))
    score = N.similarity(F.col("norm"), F.col("n2"), F.col("grams"), F.col("g2"))
    return t.join(nxt, ["doc_id", "page_no"]).select("doc_id", "page_no", F.size("grams").alias("n_grams"), F.round(score, 6).alias("similarity"))


def headings(spark, sf):
    """heading tests, clause parts, section and chapter of lines."""
    lines = I.lines_of(I.documents(spark, sf))
    numbered = F.when(F.col("line_no") % 3 == 0, F.concat(F.col("line_no").cast("string"), F.lit("."), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    n = lines.withColumn("text", numbered)
    clause = T.clause_parts("text")
    return n.select("doc_id", "line_no", T.is_heading("text").alias("heading"), T.looks_like_title("text").alias("title"),
                    clause["number"].alias("clause"), F.md5(clause["text"]).alias("rest"), section_number(F.col("text")).alias("section"),
                    chapter_label(F.col("text")).alias("chapter"), F.md5(stable_title(F.col("text"))).alias("stable"))


def page_match_texts(spark, sf):
    """match text of every page, its lines cleaned first."""
    return I.turns(spark, sf).select("doc_id", "page_no", F.md5(N.page_match_text(N.nfkc_lower("text"))).alias("norm"))


def evidence_parts(spark, sf):
    """evidence segments of every benchmark passage and conversation turn."""
    b = I.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.lit("item").alias("kind"), "text")
    t = I.turns(spark, sf).select(F.concat_ws("-", "doc_id", "page_no").alias("key"), F.lit("turn").alias("kind"), "text")
    return b.unionByName(t).select("kind", "key", F.posexplode(evidence_segments(N.nfkc_lower("text"))).alias("seg_idx", "segment"))


def page_ranges(spark, sf):
    """page lists with both treatments of reversed spans, and their run text."""
    o = I.table(spark, sf, "orders")
    a, b, c = (F.col("o_orderkey") % 9 + 1), (F.col("o_custkey") % 9 + 1), (F.col("o_orderkey") % 5 + 10)
    text = F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" , "), c.cast("string"), F.lit(",x,99"))
    keep, swap = G.parse_pages(text, F.lit(12)), G.parse_pages(text, F.lit(12), swap_reversed=True)
    return o.select("o_orderkey", F.array_join(keep, ",").alias("kept"), F.array_join(swap, ",").alias("swapped"), G.format_pages(swap).alias("runs"))


def month_runs(spark, sf):
    """months with orders per customer as run text."""
    o = I.table(spark, sf, "orders")
    months = o.groupBy("o_custkey").agg(F.collect_set(F.month("o_orderdate")).alias("m"))
    return months.select("o_custkey", G.format_pages("m").alias("runs"))


def dotted_sequences(spark, sf):
    """dotted ranges expanded, with and without zero padding."""
    p = I.table(spark, sf, "part")
    low, high = F.lpad((F.col("p_size") % 9 + 1).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 20 + 1).cast("string"), 2, "0")
    text = F.concat(F.lit("3."), low, F.lit("-3."), high)
    return p.select("p_partkey", F.array_join(G.dotted_sequence(text, True), " ").alias("padded"), F.array_join(G.dotted_sequence(text), " ").alias("plain"))


def markdown_text(spark, sf):
    """readable text of every page source."""
    return I.table(spark, sf, "pages").select("page_id", F.md5(X.plain_markdown("html")).alias("plain"))


def link_cells(spark, sf):
    """target and label of link formulas."""
    p = I.table(spark, sf, "pages")
    formula = F.concat(F.lit('=HYPERLINK("'), F.col("url"), F.lit('" , "页 '), F.col("page_id").cast("string"), F.lit('")'))
    link = X.link_target(formula)
    return p.select("page_id", link["url"].alias("target"), link["label"].alias("label"))


def context_snippets(spark, sf):
    """snippet and excerpt around the first hit of a word in every document."""
    d = I.documents(spark, sf)
    return d.select("doc_id", X.snippet(X.squeeze("text"), F.lit("that")).alias("snippet"), X.excerpt("text", F.lit("that")).alias("excerpt"))


QUERIES = {f.__name__: f for f in (
    text_cleaning, number_parsing, date_formats, month_arithmetic, month_facets, extract_ids, identity_keys, leave_types, pasted_records,
    word_joining, tech_levels, loose_texts, match_texts, turn_similarity, headings, page_match_texts, evidence_parts, page_ranges,
    month_runs, dotted_sequences, markdown_text, link_cells, context_snippets)}
