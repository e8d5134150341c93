"""Evidence to page location: which one to three contiguous pages hold an evidence text.

A window of one or two pages is a prefix of the window of three that starts on the same
page. So pages are searched once, in the longest window per start page; a hit counts for
a shorter window when it ends inside that window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.functions.normal import KEEP_CJK, nfkc_lower, page_match_text, without_prefix
from rosterops.functions.ranges import dotted_sequence, parse_pages
from rosterops.functions.text import clean, safe_token
from rosterops.operators.skew import with_halo
from rosterops.operators.substring import containing

MAX_PAGES, SEGMENT, STEP, SHORTEST, WEAK = 3, 26, 20, 12, 6
MISS_REASON, TRUST_REASON, REVIEW_REASON = (
    "没有足够片段集中命中连续页面。", "片段集中命中连续页面，顺序一致。", "存在候选页面范围，需要人工确认。")


def evidence_segments(content) -> Column:
    """Segments of an evidence text: cleaned lines, long ones in overlapping parts."""
    trimmed = F.transform(F.split(content, "\r?\n"), lambda x: F.regexp_replace(
        without_prefix(F.regexp_replace(x, r"^(?U)[\s\x{FEFF}]+|(?U)[\s\x{FEFF}]+$", "")), KEEP_CJK, ""))
    strong = F.filter(trimmed, lambda x: F.length(x) >= WEAK)

    def parts(line):
        starts = F.filter(
            F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.length(line) - SEGMENT) / STEP), F.lit(0))), lambda i: i * STEP),
            lambda at: at < F.length(line))
        cut = F.transform(starts, lambda at: F.substring(line, at.cast("int") + 1, F.lit(SEGMENT)))
        return F.when(F.length(line) <= 34, F.array(line)).otherwise(F.filter(cut, lambda p: F.length(p) >= SHORTEST))

    return F.flatten(F.transform(strong, parts))


def segment_table(targets: DataFrame) -> DataFrame:
    """``(target_id, seg_idx, segment, weight)`` of targets with content."""
    cut = targets.select("target_id", F.posexplode(evidence_segments(nfkc_lower("content"))).alias("seg_idx", "segment"))
    return cut.withColumn("weight", F.greatest(F.lit(8), F.length("segment")))


def page_windows(pages: DataFrame) -> DataFrame:
    """Longest contiguous window per start page: text and cumulative lengths.

    ``pages``: doc_id, page_no, text. Columns out: doc_id, start_page, body, lengths
    (one entry per available window size).
    """
    normal = pages.select("doc_id", "page_no", page_match_text(nfkc_lower("text")).alias("norm"))
    shared = with_halo(normal, "page_no", MAX_PAGES - 1)
    ahead = Window.partitionBy("doc_id", "_s").orderBy("page_no")
    wide = shared
    for k in range(1, MAX_PAGES):
        near = F.lead("page_no", k).over(ahead) == F.col("page_no") + k
        wide = wide.withColumn(f"n{k}", F.when(near, F.lead("norm", k).over(ahead)))
    kept = wide.filter(~F.col("_halo"))
    second, third = F.col("n1"), F.when(F.col("n1").isNotNull(), F.col("n2"))
    one = F.length("norm")
    lengths = F.array_compact(F.array(one, one + F.length(second), one + F.length(second) + F.length(third)))
    return kept.select("doc_id", F.col("page_no").alias("start_page"),
                       F.concat("norm", F.coalesce(second, F.lit("")), F.coalesce(third, F.lit(""))).alias("body"), lengths.alias("lengths"))


def window_sizes(windows: DataFrame) -> DataFrame:
    """One row per window: doc_id, start_page, end_page, text length."""
    return windows.select("doc_id", "start_page", F.posexplode("lengths").alias("k", "chars")).select(
        "doc_id", "start_page", (F.col("start_page") + F.col("k")).alias("end_page"), "chars")


def ordered_hits(positions: Column) -> Column:
    """How many positions do not fall back behind the last accepted one."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))

    def step(state, at):
        ok = at >= state["last"]
        return F.struct(F.when(ok, at).otherwise(state["last"]).alias("last"),
                        F.when(ok, state["n"] + 1).otherwise(state["n"]).alias("n"))

    return F.aggregate(positions, start, step, lambda s: s["n"])


def score_windows(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Every window that holds at least one segment of a target, scored."""
    segments = segment_table(targets)
    totals = segments.groupBy("target_id").agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("total_segments"))
    words = segments.select("segment").distinct()
    windows = page_windows(pages)
    hits = containing(words, windows, "segment", "body", [], ["doc_id", "start_page"], carry=("lengths",)).select(
        "segment", "doc_id", "start_page", "lengths", (F.instr("body", F.col("segment")) - 1).alias("at"))
    sized = hits.select("segment", "doc_id", "start_page", "at", F.posexplode("lengths").alias("k", "chars")).filter(
        F.col("at") + F.length("segment") <= F.col("chars"))
    per = segments.join(sized, "segment").groupBy("target_id", "doc_id", "start_page", "k").agg(
        F.sum("weight").alias("covered"), F.count(F.lit(1)).alias("matched_segments"),
        F.array_sort(F.collect_list(F.struct("seg_idx", "at", "segment"))).alias("found"))
    joined = per.join(totals, "target_id")
    coverage = F.col("covered") / F.col("total_weight")
    ratio = ordered_hits(F.transform("found", lambda x: x["at"])) / F.col("matched_segments")
    penalty = F.when(F.col("k") > 1, 0.03).otherwise(0.0)
    return joined.withColumns({"coverage": coverage, "order_ratio": ratio}).select(
        "target_id", "doc_id", "start_page", (F.col("start_page") + F.col("k")).alias("end_page"), "coverage", "order_ratio",
        F.greatest(F.lit(0.0), F.col("coverage") * 0.78 + F.col("order_ratio") * 0.22 - penalty).alias("score"),
        "matched_segments", "total_segments", F.transform("found", lambda x: x["segment"]).alias("snippets"))


def locate(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Best window and verdict per target: trusted, review, miss or skip.

    ``targets``: target_id, content. The two best windows are a top-k, cut down before the
    shuffle; the score lead is the difference of their scores.
    """
    scored = score_windows(targets, pages)
    order = Window.partitionBy("target_id").orderBy(
        F.desc("score"), F.desc("coverage"), F.col("end_page") - F.col("start_page"), "start_page", "doc_id")
    top = scored.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    best = top.groupBy("target_id").agg(
        F.min_by(F.struct("doc_id", "start_page", "end_page", "coverage", "order_ratio", "score", "matched_segments",
                          "total_segments", "snippets"), "place").alias("b"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    totals = segment_table(targets).groupBy("target_id").agg(F.count(F.lit(1)).alias("segments"))
    joined = targets.join(best, "target_id", "left").join(totals, "target_id", "left")
    lead = F.col("b.score") - F.coalesce("second", F.lit(0.0))
    sure = (F.col("b.coverage") >= 0.78) & (F.col("b.order_ratio") >= 0.85) & ((lead >= 0.08) | (F.col("b.coverage") >= 0.94))
    status = (
        F.when(clean("content") == "", "skip")
        .when(F.col("b").isNull() | (F.col("b.coverage") < 0.45) | (F.col("b.matched_segments") < 2), "miss")
        .when(sure, "trusted").otherwise("review")
    )
    reason = (
        F.when(clean("content") == "", "依据为空或标记为不适用。").when(F.col("segments").isNull(), "依据内容无法形成有效片段。")
        .when(status == "miss", MISS_REASON).when(status == "trusted", TRUST_REASON).otherwise(REVIEW_REASON)
    )

    def metric(name):
        return F.round(F.coalesce(F.col(f"b.{name}"), F.lit(0.0)), 3).alias(name)

    return joined.select(
        "target_id", status.alias("status"), "b.doc_id", "b.start_page", "b.end_page", metric("coverage"), metric("order_ratio"),
        metric("score"), F.coalesce("b.matched_segments", F.lit(0)).alias("matched_segments"),
        F.coalesce("segments", F.lit(0)).alias("total_segments"), reason.alias("reason"), F.col("b.snippets").alias("snippets"))


def status_summary(located: DataFrame) -> DataFrame:
    return located.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("trusted", "review", "miss", "skip")))


def page_bounds(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def expand_range(located: DataFrame, bounds: DataFrame) -> DataFrame:
    """One page more on each side, inside the document."""
    return located.join(bounds, "doc_id", "left").withColumns({
        "from_page": F.greatest(F.col("start_page") - 1, F.col("first_page")),
        "to_page": F.least(F.col("end_page") + 1, F.col("last_page")),
    }).drop("first_page", "last_page")


def segment_flags(slots: DataFrame, pages: DataFrame) -> DataFrame:
    """Matched flag per segment of a slot's content within its chosen pages.

    ``slots``: target_id, content, doc_id, from_page, to_page. A slot reads its own pages
    only; the range is swapped when reversed.
    """
    low, high = F.least("from_page", "to_page"), F.greatest("from_page", "to_page")
    wanted = slots.filter(F.col("from_page").isNotNull() & F.col("to_page").isNotNull()).select(
        "target_id", "doc_id", F.explode(F.sequence(low, high)).alias("page_no"))
    chosen = wanted.join(pages.select("doc_id", "page_no", page_match_text(nfkc_lower("text")).alias("norm")), ["doc_id", "page_no"])
    body = chosen.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "norm"))).alias("p")).select(
        "target_id", F.array_join(F.transform("p", lambda x: x["norm"]), "").alias("body"))
    return segment_table(slots).join(body, "target_id", "left").select(
        "target_id", "seg_idx", "segment", F.coalesce(F.contains("body", F.col("segment")), F.lit(False)).alias("matched"))


def sequence_of(title, fallback: Column) -> Column:
    """Leading dotted number of a title."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col(title), F.lit("")), r"^\s*([0-9]+(?:\.[0-9]+)+)", 1), F.lit("")), fallback)


def evidence_groups(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flat basket: one row per adopted evidence; an item without any keeps one, index 0.

    ``items``: item_seq, code, name. ``evidence``: item_seq, ev_no, content, note.
    """
    title = F.concat_ws("  ", F.nullif(clean("code"), F.lit("")), F.nullif(clean("name"), F.lit("")))
    joined = items.select("item_seq", title.alias("title")).join(evidence, "item_seq", "left")
    return joined.select("item_seq", "title", F.coalesce("ev_no", F.lit(0)).alias("ev_no"),
                         F.coalesce("content", F.lit("")).alias("content"), F.coalesce("note", F.lit("")).alias("note"))


def slots_from_groups(groups: DataFrame) -> DataFrame:
    """Locator slots of a basket: sequence from the title, one slot per evidence."""
    fallback = F.concat(F.lit("未编号"), F.col("item_seq").cast("string"))
    filled = groups.filter("ev_no > 0").withColumn("sequence", sequence_of("title", fallback))
    return filled.select(
        F.concat_ws("-", "sequence", F.col("ev_no").cast("string")).alias("target_id"), "sequence",
        F.coalesce(F.nullif("title", F.lit("")), F.col("sequence")).alias("title"), "content", "note")


def slots_from_ranges(ranges: DataFrame, key: str, text: str) -> DataFrame:
    """Empty slots of dotted ranges such as ``1.1-1.61``; an unreadable range gives none."""
    cut = ranges.select(key, F.posexplode(dotted_sequence(text)).alias("pos", "sequence"))
    return cut.select(key, (F.col("pos") + 1).alias("slot_no"), "sequence", F.col("sequence").alias("title"), F.lit("").alias("content"))


def export_tasks(slots: DataFrame, documents: DataFrame) -> DataFrame:
    """Page ranges to cut, each with the reason why it cannot be cut.

    ``slots``: slot_id, sequence, title, doc_id, from_page, to_page. ``documents``: doc_id,
    page_count.
    """
    joined = slots.join(documents.select("doc_id", "page_count"), "doc_id", "left")
    low, high = F.least("from_page", "to_page"), F.greatest("from_page", "to_page")
    complete = F.col("from_page").isNotNull() & F.col("to_page").isNotNull()
    reason = (
        F.when(F.col("page_count").isNull(), "未选择 PDF。").when(~complete, "页码不完整。")
        .when((low < 1) | (high > F.col("page_count")), "页码超出 PDF 范围。")
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("sequence"))
    name = F.concat(safe_token("sequence", "未编号"), F.lit("_"), F.substring(safe_token(title), 1, 40), F.lit(".pdf"))
    known = F.col("page_count").isNotNull() & complete
    return joined.select("slot_id", "sequence", "doc_id", F.when(known, low).otherwise(F.coalesce("from_page", F.lit(0))).alias("start_page"),
                         F.when(known, high).otherwise(F.coalesce("to_page", F.lit(0))).alias("end_page"),
                         name.alias("file_name"), reason.alias("skipped_reason"))


def rebind_slots(slots: DataFrame, documents: DataFrame) -> DataFrame:
    """Saved slots against current documents: by ID, else by name; values put in range.

    ``slots``: slot_id, doc_id, doc_name, status, coverage, order_ratio, score, start_page,
    end_page. ``documents``: doc_id, doc_name.
    """
    known = documents.select("doc_id", F.col("doc_name").alias("_idname"))
    names = documents.groupBy("doc_name").agg(F.min("doc_id").alias("_byname"))
    joined = slots.join(known, "doc_id", "left")
    shown = F.coalesce(F.nullif(clean("doc_name"), F.lit("")), F.col("_idname"), F.lit(""))
    named = joined.withColumn("doc_name", shown).join(names, "doc_name", "left")
    page = {c: F.when(F.col(c) >= 1, F.col(c).cast("int")).alias(c) for c in ("start_page", "end_page")}
    metric = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))).alias(c) for c in ("coverage", "order_ratio", "score")}
    status = F.when(F.col("status").isin("trusted", "review", "miss", "skip"), F.col("status")).otherwise("review")
    return named.select("slot_id", F.when(F.col("_idname").isNotNull(), F.col("doc_id")).otherwise(F.col("_byname")).alias("doc_id"),
                        "doc_name", status.alias("status"), *metric.values(), *page.values())


def page_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules per page: all, odd, even or a page range, in rule order.

    ``pages``: doc_id, page_no, page_count. ``rules``: rule_id, mode, range_text; what one
    person drew on a page, so a small dimension.
    """
    page, top = F.col("page_no"), F.col("page_count")
    fits = (
        F.when(F.col("mode") == "all", True).when(F.col("mode") == "odd", page % 2 == 1).when(F.col("mode") == "even", page % 2 == 0)
        .when(F.col("mode") == "range", F.array_contains(parse_pages("range_text", top, swap_reversed=True), page)).otherwise(False)
    )
    hit = pages.filter(page.between(1, top)).join(F.broadcast(rules), fits)
    return hit.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))
