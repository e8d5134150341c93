"""Page layout to manual units: items to lines, margin lines, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.functions.normal import line_key, nfkc_lower
from rosterops.functions.text import clean, squeeze
from rosterops.operators.skew import dense_order, running_last, running_sum
from rosterops.session import cut_lineage
from rosterops.sources.text_blocks import SENTENCE_END, clause_parts, looks_like_title

WORD_GAP, PARAGRAPH, HEADING = 3, 420, 40
TOP, BOTTOM, EDGE_TOP, EDGE_BOTTOM = 0.14, 0.88, 0.08, 0.9
ALNUM_END, ALNUM_START = r"[0-9a-zA-Z]$", r"^[0-9a-zA-Z]"


def item_lines(items: DataFrame, page_height: float, ignored: list[str] | None = None) -> DataFrame:
    """Text items ``(doc_id, page_no, str, x, y, width)`` to lines, top of the page first.

    Items share a line when their y rounds to the same even number; a space goes between
    latin words that are more than three units apart.
    """
    kept = items.withColumn("str", clean("str")).filter(
        (F.col("str") != "") & F.col("x").isNotNull() & F.col("y").isNotNull())
    if ignored:
        kept = kept.filter(~line_key(nfkc_lower("str")).isin(ignored))
    keyed = kept.withColumn("_y", F.floor(F.col("y") / 2 + 0.5) * 2)
    line = ["doc_id", "page_no", "_y"]
    along = Window.partitionBy(*line).orderBy("x", "str", "width", "y")
    # A line's text so far ends as its last item does, and reaches as far as any of them.
    reach = F.greatest(F.lit(0.0), F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    placed = keyed.withColumns({"_k": F.row_number().over(along), "_before": F.lag("str").over(along), "_end": reach})
    apart = (F.col("x") - F.col("_end") > WORD_GAP) & F.col("_before").rlike(ALNUM_END) & F.col("str").rlike(ALNUM_START)
    pieces = F.struct("_k", F.concat(F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), "str").alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["piece"]), "")
    first = F.min_by(F.struct("x", "y"), "_k")
    lines = placed.groupBy(*line).agg(squeeze(text).alias("text"), first.alias("_f"))
    return lines.select(
        "doc_id", "page_no", (-F.col("_y")).cast("long").alias("line_no"), "text", F.col("_f.x").alias("x"), F.col("_f.y").alias("y"),
        (1 - F.col("_f.y") / F.greatest(F.lit(1.0), F.lit(float(page_height)))).alias("top_ratio")).filter(F.col("text") != "")


def margin_keys(norm: Column) -> Column:
    """Identities of a line: itself, digits masked, and the start of the masked form."""
    masked = F.regexp_replace(norm, "[0-9]+", "#")
    start = F.when(F.length(masked) >= 8, F.substring(masked, 1, 10))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(norm, masked, start))))


def repeated_margin_keys(lines: DataFrame) -> DataFrame:
    """Line identities on a quarter of the pages of a document, three at least.

    Only lines near the top or bottom count. Pages per key are counted in two steps, so a
    key on every page is never gathered.
    """
    pages = lines.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    edge = lines.filter((F.col("top_ratio") < TOP) | (F.col("top_ratio") > BOTTOM))
    keys = edge.select("doc_id", "page_no", F.explode(margin_keys(line_key(nfkc_lower("text")))).alias("key")).distinct()
    counts = keys.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("on_pages"))
    return counts.join(pages, "doc_id").filter(
        F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.25))).select("doc_id", "key", "on_pages")


def body_lines(lines: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Lines without margins, noise and page numbers; adds ``norm``."""
    shaped = lines.withColumn("norm", line_key(nfkc_lower("text")))
    near_edge = (F.col("top_ratio") < TOP) | (F.col("top_ratio") > BOTTOM)
    kept = shaped.filter(
        (F.col("norm") != "") & F.col("top_ratio").between(EDGE_TOP, EDGE_BOTTOM)
        & ~(near_edge & clean("text").rlike("^[0-9]{1,4}$")))
    if ignored:
        kept = kept.filter(~F.col("norm").isin(ignored))
    repeated = repeated_margin_keys(lines)
    marked = kept.select("doc_id", "page_no", "line_no", F.explode(margin_keys(F.col("norm"))).alias("key")).join(
        repeated, ["doc_id", "key"], "left_semi").select("doc_id", "page_no", "line_no").distinct()
    return kept.join(marked, ["doc_id", "page_no", "line_no"], "left_anti")


_ENTRY = "array<struct<text:string,title:string,weak:boolean>>"


def page_paragraphs(body: DataFrame) -> DataFrame:
    """Paragraphs and title events of each page, in order.

    A paragraph ends at a clause start, a sentence end, 420 characters or the page end, so
    the fold never leaves a page and a page bounds its group.
    """
    clause = clause_parts("text")
    entry = F.struct("line_no", clean("text").alias("value"), F.length("norm").alias("n"), clause["number"].alias("number"), clause["text"].alias("rest"))
    pages = body.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    none = F.array().cast(_ENTRY)
    nothing = F.lit(None).cast("string")

    def closed(text):
        whole = squeeze(text)
        return F.when(whole == "", none).otherwise(F.array(F.struct(
            whole.alias("text"), F.when(looks_like_title(whole), whole).alias("title"), F.lit(False).alias("weak"))))

    def step(state, line):
        has_clause, open_text = line["number"].isNotNull(), state["open"]
        heading = (line["rest"] != "") & (F.length(line["rest"]) <= HEADING) & ~line["rest"].rlike(SENTENCE_END)
        event = F.struct(nothing.alias("text"), F.when(heading, F.concat_ws(" ", line["number"], line["rest"])).otherwise(line["number"]).alias("title"),
                         (~heading).alias("weak"))
        clause_ends = line["rest"].rlike(SENTENCE_END)
        spaced = open_text.rlike(ALNUM_END) & line["value"].rlike(ALNUM_START)
        grown = F.concat(open_text, F.when(spaced, " ").otherwise(""), line["value"])
        size = state["size"] + line["n"]
        line_ends = line["value"].rlike(SENTENCE_END) | (size >= PARAGRAPH)
        clause_out = F.concat(state["out"], closed(open_text), F.array(event), F.when(clause_ends, closed(line["rest"])).otherwise(none))
        line_out = F.concat(state["out"], F.when(line_ends, closed(grown)).otherwise(none))
        next_open = F.when(has_clause, F.when(clause_ends, "").otherwise(line["rest"])).otherwise(F.when(line_ends, "").otherwise(grown))
        carried = F.when(has_clause, F.length(F.regexp_replace(F.lower(line["rest"]), r"[^0-9a-z\x{4E00}-\x{9FFF}]+", ""))).otherwise(size)
        return F.struct(next_open.alias("open"), F.when(next_open == "", 0).otherwise(carried).alias("size"),
                        F.when(has_clause, clause_out).otherwise(line_out).alias("out"))

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("size"), none.alias("out"))
    folded = F.aggregate("lines", start, step, lambda s: F.concat(s["out"], closed(s["open"])))
    return pages.select("doc_id", "page_no", F.posexplode(folded).alias("pos", "e")).select("doc_id", "page_no", "pos", "e.*")


def layout_units(lines: DataFrame, ignored: list[str] | None = None, keep=cut_lineage) -> DataFrame:
    """Manual units of a laid-out document: paragraphs with running title and page.

    A bare clause number only becomes the title when there is none yet. ``keep`` stores the
    paragraphs, and their places, as several later steps read each: pages are folded once.
    """
    paragraphs = keep(page_paragraphs(body_lines(lines, ignored)))
    entries = keep(dense_order(paragraphs, ["doc_id"], "page_no", "pos", "_o"))
    strong = F.when(F.col("title").isNotNull() & ~F.col("weak"), F.col("title"))
    titled = running_last(entries, ["doc_id"], "_o", strong, "_strong")
    first_weak = entries.filter("weak").groupBy("doc_id").agg(F.min(F.struct("_o", "title")).alias("_w"))
    joined = titled.join(first_weak, "doc_id", "left")
    weak = F.when(F.col("_w._o") <= F.col("_o"), F.col("_w.title"))
    named = joined.withColumn("title", F.coalesce("_strong", weak, F.lit(""))).filter(F.col("text").isNotNull())
    numbered = running_sum(named, ["doc_id"], "_o", F.lit(1), "unit_idx")
    return numbered.select("doc_id", F.col("unit_idx").cast("int").alias("unit_idx"), "page_no", "text", "title")
