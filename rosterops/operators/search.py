"""Keyword search over document blocks, evidence making and re-resolution."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.functions import text as X
from rosterops.functions.normal import loose_offsets, loose_text
from rosterops.operators.skew import attach, near_pairs, running_last, running_sum
from rosterops.operators.substring import all_positions, containing
from rosterops.session import cut_lineage

CONTEXT = 20


def candidate_blocks(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Item and block pairs where the loose keyword occurs in the loose block text.

    ``blocks``: doc_id, block_idx, text. ``items``: item_id, keyword. A block that holds
    the keyword holds all its grams, so this is the gram test and its verification in
    one. A one-character keyword counts only when some block is exactly that character.
    Items with ``enabled`` false are not searched; a missing mark counts as true.
    """
    if "enabled" in items.columns:
        items = items.filter(F.coalesce("enabled", F.lit(True)))
    asked = items.filter(X.clean("keyword") != "").withColumn("loose_key", loose_text("keyword")).filter(F.col("loose_key") != "")
    indexed = blocks.withColumn("loose", loose_text("text"))
    single = F.length("loose_key") == 1
    usable = asked
    if not asked.filter(single).isEmpty():
        alone = indexed.filter(F.length("loose") == 1).select(F.col("loose").alias("loose_key")).distinct()
        usable = asked.filter(~single).unionByName(asked.filter(single).join(alone, "loose_key", "left_semi").select(*asked.columns))
    text = indexed.select("doc_id", "block_idx", "text", "loose")
    return containing(usable, text, "loose_key", "loose", ["item_id", "keyword"], ["doc_id", "block_idx"], carry=("text",)).select(
        "item_id", "keyword", "loose_key", "doc_id", "block_idx", "text")


HIT_SCHEMA = "item_id long, doc_id long, block_idx int, start int, end int, mode string, matched_text string"
HIT_ARROW = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("block_idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                       ("mode", pa.string()), ("matched_text", pa.string())])
ROWS = 64


def keyword_hits(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """All exact hits, and loose hits at ranges no exact hit has, with source offsets."""
    def emit(batches):
        names = ["item_id", "doc_id", "block_idx", "text", "keyword", "loose_key"]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):  # a few at a time: rows and hits as Python objects take many times the space
                out = []
                part = batch.slice(first, ROWS)
                for item, doc, block, text, word, loose_word in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    seen = set()
                    at = text.find(word)
                    while at >= 0:
                        seen.add((at, at + len(word)))
                        out.append((item, doc, block, at, at + len(word), "exact", word))
                        at = text.find(word, at + len(word))
                    loose, source = loose_offsets(text)
                    at = loose.find(loose_word)
                    while at >= 0:
                        span = (source[at], source[at + len(loose_word) - 1] + 1)
                        if span not in seen:
                            seen.add(span)
                            out.append((item, doc, block, *span, "loose", text[span[0]:span[1]]))
                        at = loose.find(loose_word, at + len(loose_word))
                columns = zip(*out, strict=True) if out else [[] for _ in HIT_ARROW]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HIT_ARROW, strict=True)], schema=HIT_ARROW)

    return candidate_blocks(blocks, items).mapInArrow(emit, HIT_SCHEMA)


def ranked_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their ``rank`` per item: document name in Chinese order, then document, block and start."""
    named = hits.join(documents.select("doc_id", "doc_name"), "doc_id")
    by = Window.partitionBy("item_id").orderBy(F.collate("doc_name", "zh_Hans_CHN"), "doc_name", "doc_id", "block_idx", "start", "end")
    return named.withColumn("rank", F.row_number().over(by))


def sort_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits by document name in Chinese order, then block and start."""
    named = hits.join(documents.select("doc_id", "doc_name"), "doc_id")
    return named.orderBy(F.collate("doc_name", "zh_Hans_CHN"), "block_idx", "start")


def hit_counts(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per item, zero included."""
    counts = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))
    return items.select("item_id").join(counts, "item_id", "left").na.fill(0)


def filter_hits(hits: DataFrame, item_id=None, doc_id=None) -> DataFrame:
    out = hits if item_id is None else hits.filter(F.col("item_id") == item_id)
    return out if doc_id is None else out.filter(F.col("doc_id") == doc_id)


def search_documents(documents: DataFrame, query: str) -> DataFrame:
    """Documents ``(doc_id, name, markdown)`` that hold a query, with a snippet."""
    key = " ".join(query.split()).lower()
    body = documents.withColumn("plain", X.plain_markdown("markdown"))
    found = body.filter(F.contains(F.lower(F.concat_ws(" ", "name", "plain")), F.lit(key)) & F.lit(key != ""))
    return found.withColumn("snippet", X.snippet("plain", F.lit(key))).drop("plain", "markdown")


def source_columns(text: Column, start: Column, end: Column) -> dict[str, Column]:
    """Clamped offsets, text and 20 characters on either side; offsets are 0-based."""
    low = F.least(F.greatest(start, F.lit(0)), F.length(text))
    high = F.least(F.greatest(end, low), F.length(text))
    before = F.greatest(low - CONTEXT, F.lit(0))
    return {
        "start": low, "end": high, "text": F.substring(text, low + 1, high - low),
        "before_text": F.substring(text, before + 1, low - before),
        "after_text": F.substring(text, high + 1, F.lit(CONTEXT)),
    }


def evidence_from_hits(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence rows of hits, with their context."""
    b = blocks.select("doc_id", "block_idx", F.col("text").alias("block_text"))
    joined = hits.join(b, ["doc_id", "block_idx"])
    shown = source_columns(F.col("block_text"), F.col("start"), F.col("end"))
    return joined.select("item_id", "doc_id", "block_idx", "mode", *(c.alias(n) for n, c in shown.items()))


def global_offsets(blocks: DataFrame) -> DataFrame:
    """Start and end of each block in the document text, blocks joined by two newlines."""
    summed = running_sum(blocks, ["doc_id"], "block_idx", F.length("text") + 2, "_end")
    return summed.withColumn("g_end", F.col("_end") - 2).withColumn("g_start", F.col("g_end") - F.length("text")).drop("_end")


def evidence_from_range(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence of global ranges ``(range_id, doc_id, g_from, g_to)``.

    Only the blocks a range and its context touch are read, through a cell-wise overlap
    join inside the document. The block position is set when both ends fall in one.
    """
    placed = global_offsets(blocks).select("doc_id", "block_idx", "text", "g_start", "g_end")
    size = placed.groupBy("doc_id").agg(F.max("g_end").alias("g_size"))
    bounded = ranges.join(size, "doc_id").withColumns({
        "g_from": F.least(F.greatest("g_from", F.lit(0)), "g_size")}).withColumn(
        "g_to", F.least(F.greatest("g_to", "g_from"), "g_size"))
    touched = near_pairs(bounded, placed, "doc_id", F.col("g_from") - CONTEXT - 2, F.col("g_to") + CONTEXT + 2, F.col("g_start"), F.col("g_end"))
    piece = F.struct("block_idx", "text", "g_start", "g_end")
    whole = touched.groupBy("range_id", "doc_id", "g_from", "g_to").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = whole.withColumn("body", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).withColumn(
        "base", F.col("p")[0]["g_start"])
    shown = source_columns(F.col("body"), F.col("g_from") - F.col("base"), F.col("g_to") - F.col("base"))
    holds_from = F.get(F.filter("p", lambda x: F.col("g_from").between(x["g_start"], x["g_end"])), F.lit(0))
    holds_to = F.get(F.filter("p", lambda x: F.col("g_to").between(x["g_start"], x["g_end"])), F.lit(0))
    same = holds_from["block_idx"] == holds_to["block_idx"]
    return joined.select(
        "range_id", "doc_id", "g_from", "g_to", *(shown[n].alias(n) for n in ("text", "before_text", "after_text")),
        F.when(same, holds_from["block_idx"]).alias("block_idx"),
        F.when(same, F.col("g_from") - holds_from["g_start"]).alias("start"),
        F.when(same, F.col("g_to") - holds_from["g_start"]).alias("end"))


def _at_offsets(sources: DataFrame, blocks: DataFrame, on: list[str], expected: str, tier: int) -> DataFrame:
    """Sources whose text stands at their offsets in the joined block."""
    joined = sources.join(blocks, on)
    start, end = F.col("s_start"), F.col("s_end")
    legal = (start >= 0) & (end > start) & (end <= F.length("b_text"))
    same = F.substring(F.col("b_text"), start + 1, end - start) == F.col(expected)
    hit = joined.filter(legal & same & (F.col(expected) != ""))
    return hit.select("source_id", F.lit(tier).alias("tier"), "b_doc", "b_idx", start.alias("start"), end.alias("end"))


def _occurrences(pairs: DataFrame, needle: str, with_context: bool) -> DataFrame:
    """Every hit of a needle in its candidate block, filtered by the stored context."""
    spots = pairs.withColumn("start", F.explode(all_positions(F.col("b_text"), F.col(needle))))
    end = F.col("start") + F.length(needle)
    if not with_context:
        return spots.withColumn("end", end)
    before, after = F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit(""))
    head_at = F.greatest(F.col("start") - F.length(before), F.lit(0))
    head = F.substring(F.col("b_text"), head_at + 1, F.col("start") - head_at)
    tail = F.substring(F.col("b_text"), end + 1, F.length(after))
    return spots.withColumn("end", end).filter(((before == "") | (head == before)) & ((after == "") | (tail == after)))


def _only_one(hits: DataFrame, tier: int) -> DataFrame:
    """Sources with exactly one hit at a tier."""
    one = hits.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("b_doc", "b_idx", "start", "end")).alias("h"))
    return one.filter("n = 1").select("source_id", F.lit(tier).alias("tier"), "h.b_doc", "h.b_idx", "h.start", "h.end")


def _only_ones(hits: DataFrame, tiers: dict[int, Column]) -> DataFrame:
    """Sources with exactly one hit at a tier, for the hits of several tiers in one pass."""
    spot = F.struct("b_doc", "b_idx", "start", "end")
    counted = hits.groupBy("source_id").agg(*(F.struct(
        F.count_if(fits).alias("n"), F.min(F.when(fits, spot)).alias("h")).alias(f"t{tier}") for tier, fits in tiers.items()))
    every = F.array(*(F.struct(F.lit(tier).alias("tier"), F.col(f"t{tier}.n").alias("n"), F.col(f"t{tier}.h").alias("h")) for tier in tiers))
    return counted.select("source_id", F.explode(every).alias("x")).filter("x.n = 1").select(
        "source_id", "x.tier", "x.h.b_doc", "x.h.b_idx", "x.h.start", "x.h.end")


def _blocks_for_join(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("doc_id").alias("b_doc"), F.col("block_idx").alias("b_idx"), F.col("text").alias("b_text"))


def _best_tier(sources: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    found = tiers[0]
    for tier in tiers[1:]:
        found = found.unionByName(tier)
    best = found.groupBy("source_id").agg(F.min(F.struct("tier", "b_doc", "b_idx", "start", "end")).alias("h"))
    out = sources.join(best, "source_id", "left")
    return out.select(
        *sources.columns, F.col("h.tier").alias("tier"), F.col("h.b_doc").alias("new_doc"),
        F.col("h.b_idx").alias("new_idx"), F.col("h.start").alias("new_start"), F.col("h.end").alias("new_end"))


def resolve_sources(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Find where check-item sources moved to in a re-read checklist.

    ``sources``: source_id, doc_id, old_block_id, block_idx, s_start, s_end, text,
    before_text, after_text, keyword. ``blocks``: doc_id, block_id, block_idx, text. Tiers:
    1 same block ID and offsets, 2 block index and offsets, 3 unique with context in that
    block, 4 unique with context anywhere, 5 unique keyword in that block. No tier: kept.
    """
    s = sources.withColumn("wanted", F.coalesce(F.nullif("text", F.lit("")), F.col("keyword")))
    b = _blocks_for_join(blocks).join(
        blocks.select(F.col("doc_id").alias("b_doc"), F.col("block_idx").alias("b_idx"), "block_id"), ["b_doc", "b_idx"])
    by_id = _at_offsets(s, b.withColumnRenamed("block_id", "old_block_id"), ["old_block_id"], "wanted", 1)
    indexed = b.withColumnsRenamed({"b_idx": "block_idx"}).withColumn("b_idx", F.col("block_idx"))
    here = s.join(indexed.withColumnRenamed("b_doc", "doc_id").withColumn("b_doc", F.col("doc_id")), ["doc_id", "block_idx"])
    by_index = _at_offsets(
        s, indexed.withColumn("doc_id", F.col("b_doc")).drop("block_id"), ["doc_id", "block_idx"], "wanted", 2)
    in_block = _only_one(_occurrences(here.filter("wanted <> ''"), "wanted", True), 3)
    everywhere = containing(
        s, _blocks_for_join(blocks), "wanted", "b_text", ["source_id", "doc_id", "before_text", "after_text"], ["b_doc", "b_idx"],
        within=("doc_id", "b_doc"))
    by_context = _only_one(_occurrences(everywhere, "wanted", True), 4)
    by_keyword = _only_one(_occurrences(here.filter("keyword <> ''"), "keyword", False), 5)
    return _best_tier(sources, [by_id, by_index, in_block, by_context, by_keyword])


def evidence_documents(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents an evidence row may sit in: its ID, else all of its name, else all.

    Adds ``scope`` (id, name, all) and ``scope_doc``; ``all`` rows carry no document.
    """
    ids = documents.select(F.col("doc_id").alias("scope_doc"))
    by_id = evidence.join(ids, evidence["doc_id"] == ids["scope_doc"]).withColumn("scope", F.lit("id"))
    rest = evidence.join(by_id.select("source_id"), "source_id", "left_anti")
    names = documents.select(F.col("doc_id").alias("scope_doc"), F.col("doc_name").alias("_n"))
    by_name = rest.join(names, rest["doc_name"] == names["_n"]).drop("_n").withColumn("scope", F.lit("name"))
    loose = rest.join(by_name.select("source_id"), "source_id", "left_anti").withColumns(
        {"scope_doc": F.lit(None).cast("long"), "scope": F.lit("all")})
    cut = [*evidence.columns, "scope_doc", "scope"]
    return by_id.select(*cut).unionByName(by_name.select(*cut)).unionByName(loose.select(*cut))


def _in_scope(scoped: DataFrame, blocks: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """Blocks that hold a row's text: those of its documents, or any block for scope ``all``.

    A row with documents meets the postings of these alone.
    """
    pinned = containing(scoped.filter("scope <> 'all'"), blocks, needle, "b_text", keys, ["b_doc", "b_idx"], within=("scope_doc", "b_doc"))
    return pinned.unionByName(containing(scoped.filter("scope = 'all'"), blocks, needle, "b_text", keys, ["b_doc", "b_idx"]))


def resolve_evidence(evidence: DataFrame, documents: DataFrame, blocks: DataFrame, keep=cut_lineage) -> DataFrame:
    """Find where saved evidence stands in the current documents.

    ``evidence``: source_id, doc_id, doc_name, block_id, block_idx, s_start, s_end, g_from,
    g_to, text, before_text, after_text, selection. ``blocks`` carry ``block_id``. Tiers: 1
    global offsets, 2 block ID, 3 block index, 4 document context for selections, 5
    context in the block, 6 context in any block in scope, 7 document context.

    The least tier wins, so only evidence that no place of tier 1 to 3 holds is looked for in texts.
    ``keep`` stores the places of these three, and the evidence that is left.
    """
    scoped = evidence_documents(evidence, documents)
    placed = global_offsets(blocks)
    pinned = scoped.filter("scope <> 'all'")
    first_doc = pinned.groupBy("source_id").agg(F.min("scope_doc").alias("scope_doc"))
    asked = (evidence.select("source_id", "g_from", "g_to", "text").filter(F.col("g_from").isNotNull() & (F.col("g_to") > F.col("g_from")))
             .join(first_doc, "source_id").select(
                 F.col("source_id").alias("range_id"), F.col("scope_doc").alias("doc_id"), "g_from", "g_to", F.col("text").alias("_want")))
    read = evidence_from_range(asked.drop("_want"), blocks).withColumnRenamed("text", "_got")
    by_global = read.join(asked.select("range_id", "_want"), "range_id").filter(F.col("_got") == F.col("_want")).select(
        F.col("range_id").alias("source_id"), F.lit(1).alias("tier"), F.col("doc_id").alias("b_doc"),
        F.col("block_idx").alias("b_idx"), F.col("start"), F.col("end"))

    b = _blocks_for_join(blocks).join(
        blocks.select(F.col("doc_id").alias("b_doc"), F.col("block_idx").alias("b_idx"), "block_id"), ["b_doc", "b_idx"])
    in_scope = (F.col("scope") == "all") | (F.col("scope_doc") == F.col("b_doc"))
    by_id = scoped.drop("doc_id").join(b, "block_id").filter(in_scope)
    legal = (F.col("s_start") >= 0) & (F.col("s_end") > F.col("s_start")) & (F.col("s_end") <= F.length("b_text"))
    same = F.substring(F.col("b_text"), F.col("s_start") + 1, F.col("s_end") - F.col("s_start")) == F.col("text")

    def taken(rows, tier):
        hit = rows.filter(legal & same).groupBy("source_id").agg(F.min(F.struct("b_doc", "b_idx", "s_start", "s_end")).alias("h"))
        return hit.select("source_id", F.lit(tier).alias("tier"), "h.b_doc", "h.b_idx",
                          F.col("h.s_start").alias("start"), F.col("h.s_end").alias("end"))

    at_index = pinned.drop("doc_id", "block_id").withColumnsRenamed({"block_idx": "b_idx"}).withColumn(
        "b_doc", F.col("scope_doc")).join(b, ["b_doc", "b_idx"])
    early = keep(by_global.unionByName(taken(by_id, 2)).unionByName(taken(at_index, 3)))
    rest = keep(scoped.join(early.select("source_id").distinct(), "source_id", "left_anti").select(*scoped.columns))
    everywhere = _in_scope(
        rest.drop("doc_id"), _blocks_for_join(blocks), "text",
        ["source_id", "scope", "scope_doc", "block_idx", "before_text", "after_text", "selection"])
    by_context = _only_ones(_occurrences(everywhere, "text", True), {5: F.col("b_idx") == F.col("block_idx"), 6: F.lit(True)})
    columns = ["source_id", "selection", "b_doc", "b_idx", "start", "end"]
    across = _document_context(everywhere, placed).select(*columns).unionByName(_across_blocks(rest, placed).select(*columns))
    return _best_tier(evidence, [early, by_context, _only_ones(across, {4: F.col("selection"), 7: F.lit(True)})])


def _edges(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text before and after each block: 20 characters of its neighbours and the joint."""
    near = placed.select(
        F.col("doc_id").alias("b_doc"), F.col("block_idx").alias("b_idx"),
        F.substring(F.col("text"), F.greatest(F.length("text") - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("tail"),
        F.substring(F.col("text"), 1, CONTEXT).alias("head"))
    prior = near.select("b_doc", (F.col("b_idx") + 1).alias("b_idx"), F.concat("tail", F.lit("\n\n")).alias("lead"))
    later = near.select("b_doc", (F.col("b_idx") - 1).alias("b_idx"), F.concat(F.lit("\n\n"), "head").alias("follow"))
    return prior, later


def _across_blocks(scoped: DataFrame, placed: DataFrame) -> DataFrame:
    """Hits of texts that run over block joints, with their context.

    The longest piece of such a text finds its blocks; every piece must then end, fill or
    begin the block at its distance. ``end`` counts on from the first block's start.
    """
    multi = scoped.filter(F.contains("text", F.lit("\n\n"))).withColumn("pieces", F.split("text", "\n\n", -1))
    sized = F.transform("pieces", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    keyed = multi.withColumn("_top", F.array_max(sized)).select(
        "source_id", "scope", "scope_doc", "before_text", "after_text", "selection", "text", "pieces",
        F.col("_top.x").alias("anchor"), (-F.col("_top.i")).alias("at"))
    blocks = placed.select(F.col("doc_id").alias("b_doc"), F.col("block_idx").alias("b_idx"), F.col("text").alias("b_text"))
    found = _in_scope(keyed.drop("pieces"), blocks, "anchor", ["source_id", "scope", "scope_doc", "at"])
    bases = found.select("source_id", "b_doc", (F.col("b_idx") - F.col("at")).alias("base")).distinct()
    laid = keyed.select("source_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "piece"))
    checked = bases.join(laid, "source_id").withColumn("b_idx", (F.col("base") + F.col("k")).cast("int")).join(blocks, ["b_doc", "b_idx"])
    body, piece = F.col("b_text"), F.col("piece")
    fits = F.when(F.col("k") == 0, body.endswith(piece)).when(F.col("k") == F.col("n") - 1, body.startswith(piece)).otherwise(body == piece)
    whole = checked.filter(fits).groupBy("source_id", "b_doc", "base").agg(
        F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.max(F.when(F.col("k") == 0, body)).alias("first"),
        F.max(F.when(F.col("k") == 0, F.length(body) - F.length(piece))).alias("start"),
        F.max(F.when(F.col("k") == F.col("n") - 1, F.substring(body, F.length(piece) + 1, F.length(body)))).alias("rest")).filter("c = n")
    prior, later = _edges(placed)
    last = later.withColumnRenamed("b_idx", "last_idx")
    placed_hits = whole.withColumns({"b_idx": F.col("base").cast("int"), "last_idx": (F.col("base") + F.col("n") - 1).cast("int")}).join(
        prior, ["b_doc", "b_idx"], "left").join(last, ["b_doc", "last_idx"], "left").join(
        keyed.select("source_id", "before_text", "after_text", "selection", "text"), "source_id")
    before, after = F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit(""))
    head = F.concat(F.coalesce("lead", F.lit("")), F.substring(F.col("first"), F.lit(1), F.col("start")))
    tail = F.concat("rest", F.coalesce("follow", F.lit("")))
    return placed_hits.filter(head.endswith(before) & tail.startswith(after)).withColumn("end", F.col("start") + F.length("text"))


def _document_context(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Hits whose context may run over block edges: neighbours lend 20 characters."""
    prior, later = _edges(placed)
    wide = pairs.join(prior, ["b_doc", "b_idx"], "left").join(later, ["b_doc", "b_idx"], "left").withColumns({
        "lead": F.coalesce("lead", F.lit("")), "follow": F.coalesce("follow", F.lit(""))})
    spots = wide.withColumn("start", F.explode(all_positions(F.col("b_text"), F.col("text"))))
    end = F.col("start") + F.length("text")
    body, shift = F.concat("lead", "b_text", "follow"), F.length("lead")
    before, after = F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit(""))
    head_at = F.greatest(F.col("start") + shift - F.length(before), F.lit(0))
    head = F.substring(body, head_at + 1, F.col("start") + shift - head_at)
    tail = F.substring(body, end + shift + 1, F.length(after))
    ok = ((before == "") | (head == before)) & ((after == "") | (tail == after))
    return spots.withColumn("end", end).filter(ok)


def saved_hits(hits: DataFrame, saved: DataFrame, with_text: bool = False) -> DataFrame:
    """Hits already saved as evidence: same document, block and offsets (and text)."""
    keys = ["doc_id", "block_idx", "start", "end", *(["matched_text"] if with_text else [])]
    return hits.join(saved.select(*keys).distinct(), keys, "left_semi")


def located_sources(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sources whose text still stands at their block and offsets."""
    b = blocks.select("block_id", F.col("text").alias("b_text"))
    at = F.substring(F.col("b_text"), F.col("s_start") + 1, F.col("s_end") - F.col("s_start"))
    wanted = F.coalesce(F.nullif("text", F.lit("")), F.col("keyword"))
    joined = sources.join(b, sources["old_block_id"] == b["block_id"])
    return joined.filter((F.col("s_end") > F.col("s_start")) & (at == wanted)).select("source_id")


def adopt_evidence(manual: DataFrame, adopted: DataFrame) -> DataFrame:
    """Basis rows of candidates that were not adopted yet; running it again adds nothing.

    ``manual``: item_id, evidence_id, doc_name, page_no, block_idx, text. ``adopted``:
    item_id, source_evidence_id.
    """
    done = adopted.select("item_id", F.col("source_evidence_id").alias("evidence_id"))
    fresh = manual.join(done, ["item_id", "evidence_id"], "left_anti")
    place = (
        F.when(F.col("page_no") > 0, F.concat(F.col("doc_name"), F.lit(" / 第 "), F.col("page_no").cast("string"), F.lit(" 页")))
        .when(F.col("block_idx") > 0, F.concat(F.col("doc_name"), F.lit(" / 第 "), F.col("block_idx").cast("string"), F.lit(" 段")))
        .otherwise(F.col("doc_name"))
    )
    return fresh.select("item_id", F.col("evidence_id").alias("source_evidence_id"), F.col("text").alias("content"),
                        F.concat(F.lit("采纳自 "), place).alias("note"))


def highlight_segments(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Disjoint segments of each text with the ranges that cover them, by start, end and number.

    ``texts``: text_id, text. ``ranges``: text_id, range_id, start, end. All borders become events on the
    text's axis; a sweep gives each border the next one, in spans, and how many ranges are open
    from there on. Segments with open ranges meet these in cells of the axis, so a text with very
    many ranges never tests them all for a segment.
    """
    size = texts.select("text_id", F.length("text").alias("n"))
    clipped = ranges.join(size, "text_id").select(
        "text_id", "range_id", F.least(F.greatest("start", F.lit(0)), "n").alias("start"),
        F.least(F.greatest("end", F.lit(0)), "n").alias("end")).filter("end > start")
    events = size.select("text_id", F.explode(F.array(F.lit(0), F.col("n"))).alias("at"), F.lit(0).alias("step")).union(
        clipped.select("text_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"))
        .select("text_id", "e.at", "e.step"))
    borders = events.groupBy("text_id", "at").agg(F.sum("step").alias("step"))
    swept = running_sum(borders, ["text_id"], "at", F.col("step"), "open")
    swept = running_last(swept, ["text_id"], "at", F.col("at"), "end", reverse=True, exclusive=True)
    segments = swept.filter(F.col("end").isNotNull()).select("text_id", F.col("at").alias("start"), "end", "open")
    spans = clipped.select("text_id", "range_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = near_pairs(spans, segments.filter("open > 0"), "text_id", F.col("r_start"), F.col("r_end") - 1, F.col("start"), F.col("end") - 1)
    entry = F.struct("r_start", "r_end", "range_id")
    active = met.groupBy("text_id", "start", "end").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["range_id"]).alias("active"))
    whole = segments.join(active, ["text_id", "start", "end"], "left").withColumn("active", F.coalesce("active", F.array().cast("array<bigint>")))
    counts = segments.groupBy("text_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(whole, texts.select("text_id", "text"), ["text_id"], "_n", F.col("start"), "inner", counts)
    return placed.select("text_id", "start", "end", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("segment"), "active")


def block_windows(hits: DataFrame, blocks: DataFrame, target: int) -> DataFrame:
    """Text of about ``target`` characters around a hit, across block edges.

    ``hits``: hit_id, doc_id, block_idx, start, end.
    """
    placed = global_offsets(blocks)
    at = hits.join(placed.select("doc_id", "block_idx", "g_start"), ["doc_id", "block_idx"])
    size = placed.groupBy("doc_id").agg(F.max("g_end").alias("g_size"))
    width = F.col("end") - F.col("start")
    goal = F.greatest(width, F.lit(target))
    before = F.floor((goal - width) / 2)
    g_from, g_to = F.col("g_start") + F.col("start"), F.col("g_start") + F.col("end")
    asked = at.join(size, "doc_id").select(
        "hit_id", "doc_id", g_from.alias("m_from"), g_to.alias("m_to"), "g_size",
        F.greatest(g_from - before, F.lit(0)).alias("g_from"),
        F.least(g_to + F.greatest(goal - width - before, F.lit(0)), F.col("g_size")).alias("g_to"))
    window = evidence_from_range(asked.select(F.col("hit_id").alias("range_id"), "doc_id", "g_from", "g_to"), blocks)
    return asked.join(window.select(F.col("range_id").alias("hit_id"), "text"), "hit_id").select(
        "hit_id", "doc_id", "text", (F.col("m_from") - F.col("g_from")).alias("match_start"),
        (F.col("m_to") - F.col("g_from")).alias("match_end"), (F.col("g_from") > 0).alias("cut_start"),
        (F.col("g_to") < F.col("g_size")).alias("cut_end"))
