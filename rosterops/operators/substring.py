"""Substring join: which needles occur in which texts.

Needles whose number and size are checked travel to the tasks as one automaton. Where pairs are
made within a key only (a document), the needles and texts of a key meet in one task, which builds
their own automaton; a key of more than ``GROUP_CHARS`` characters is left to the postings. Any others
go by postings: texts are cut into ``(gram, key, place)``, and a needle is probed by its two
rarest grams, which must both stand in a text at their distance in the needle, so a common gram
alone makes no candidate. A needle's grams are as long as the largest of ``SIZES`` that it holds. Only grams of
needles are kept, before any shuffle where their list is of checked size; they are counted with partial
sums, and a gram with many postings is split by ``attach``. Candidates are keys, never text; each is
verified on its text at the end. Both ways give the same pairs.
"""

from __future__ import annotations

from array import array
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rosterops.operators.skew import attach

AUTOMATON_NEEDLES, AUTOMATON_CHARS = 50_000, 5_000_000
SIZES, PROBES, PIECE = (1, 2, 3, 4, 8, 16), 2, 64
GROUP_CHARS, LISTED_CHARS = 4_000_000, 500_000
ROWS = 64  # texts that are Python objects at a time


def fits_broadcast(rows: DataFrame, max_rows: int, max_chars: int) -> bool:
    """Size check in front of a broadcast, by rows and by characters of all columns.

    Reads at most ``max_rows + 1`` rows.
    """
    wide = F.concat_ws("", *(F.col(c).cast("string") for c in rows.columns))
    seen = rows.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(wide)), F.lit(0)).alias("chars")).first()
    return seen["n"] <= max_rows and seen["chars"] <= max_chars


def _postings(rows: DataFrame, keys: list[str], text: str, sizes: Column) -> DataFrame:
    """``keys, _g, _at``: the grams of a text with their places, for the lengths in ``sizes``.

    A text is cut into pieces first, each with the few letters that follow it, so that a gram is
    a substring of a short piece, in generated code.
    """
    whole = F.lit(f"(?s)(?=(.{{1,{PIECE + SIZES[-1] - 1}}})).{{1,{PIECE}}}")
    pieces = rows.select(*keys, sizes.alias("_sizes"), F.posexplode(F.regexp_extract_all(F.col(text), whole, F.lit(1))).alias("_no", "_piece"))
    sized = pieces.select(*keys, "_no", "_piece", F.explode("_sizes").alias("_size")).filter(F.length("_piece") >= F.col("_size"))
    last = F.least(F.lit(PIECE), F.length("_piece") - F.col("_size") + 1) - 1
    starts = sized.select(*keys, "_no", "_piece", "_size", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return starts.select(*keys, F.substring(F.col("_piece"), F.col("_i") + 1, F.col("_size")).alias("_g"), (F.col("_no") * PIECE + F.col("_i")).alias("_at"))


def gram_sizes(needle: str) -> Column:
    """The largest of ``SIZES`` that a needle holds, as an array."""
    size = F.lit(SIZES[0])
    for wide in SIZES[1:]:
        size = F.when(F.length(needle) >= wide, wide).otherwise(size)
    return F.array(size)


def _probes(own: DataFrame, spread: DataFrame) -> DataFrame:
    """The ``PROBES`` rarest grams of each needle; a needle with a gram no text has gets none."""
    df = F.coalesce("_df", F.lit(0)).alias("df")
    ranked = own.join(spread, ["_in", "_g"], "left").groupBy("_in", "_w").agg(
        F.array_sort(F.collect_list(F.struct(df, F.col("_g").alias("g"), F.col("_at").alias("off")))).alias("p"))
    best = ranked.filter(F.get("p", F.lit(0))["df"] > 0).withColumn("p", F.slice("p", 1, PROBES))
    return best.select("_in", "_w", F.size("p").alias("_need"), F.explode("p").alias("x")).select(
        "_in", "_w", "_need", F.col("x.g").alias("_g"), F.col("x.off").alias("_off"))


def containing(
    needles: DataFrame, texts: DataFrame, needle: str, text: str, needle_keys: list[str], text_keys: list[str],
    within: tuple[str, str] | None = None, carry: tuple[str, ...] = (),
    automaton_needles: int = AUTOMATON_NEEDLES, automaton_chars: int = AUTOMATON_CHARS, group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Pairs ``(needle_keys, needle, text_keys, carry, text)`` with ``text`` containing ``needle``.

    Column names of the two sides must differ. Blank needles match nothing. ``text_keys``
    tell the texts apart; ``carry`` names further columns of theirs to return. ``within``
    names a key of each side: only pairs that agree in it are made, and NULL agrees with nothing.
    ``automaton_needles=0`` always goes by postings. ``group_chars`` is the most that one key of
    ``within`` may hold in one task.
    """
    asked, held = (F.col(c) for c in within) if within else (F.lit(0), F.lit(0))
    n = needles.select(*needle_keys, needle).filter(F.col(needle) != "").withColumn("_own", asked)
    t = texts.select(*text_keys, *carry, text).withColumn("_in", held)
    if automaton_needles and fits_broadcast(n, automaton_needles, automaton_chars):
        hits, n = _by_automaton(n, t, needle, text), F.broadcast(n)
    elif automaton_needles and within:
        hits = _by_groups(n, t, needle, text, text_keys, group_chars)
    else:
        hits = _by_postings(n, t, needle, text, text_keys)
    return hits.join(n, (hits["_w"] == n[needle]) & (hits["_in"] == n["_own"])).select(
        *needle_keys, needle, *text_keys, *carry, text)


def _by_automaton(n: DataFrame, t: DataFrame, needle: str, text: str) -> DataFrame:
    """Texts with each needle ``_w`` they hold; the needles are of checked size."""
    words = [r[0] for r in n.select(needle).distinct().collect()]
    if not words:  # no text need be read
        return t.filter(F.lit(False)).withColumn("_w", F.lit(None).cast("string"))
    built: dict = {}

    @F.arrow_udf(ArrayType(StringType()))
    def found(texts: pa.Array) -> pa.Array:
        if "a" not in built:
            automaton = ahocorasick.Automaton()
            for number, word in enumerate(words):
                automaton.add_word(word, number)
            automaton.make_automaton()
            built["a"] = automaton, pa.array(words, pa.string())
        return hit_words(texts, *built["a"])

    return t.withColumn("_w", F.explode(found(F.col(text))))


def hit_words(texts: pa.Array, automaton: ahocorasick.Automaton, words: pa.Array) -> pa.Array:
    """The distinct ``words`` in each text, as Arrow: only ``ROWS`` texts at a time are Python objects."""
    ends, numbers = array("i", [0]), array("i")
    for first in range(0, len(texts), ROWS):
        for body in texts.slice(first, ROWS).to_pylist():
            numbers.extend({k for _, k in automaton.iter(body)} if body and len(words) else ())
            ends.append(len(numbers))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(numbers, pa.int32())))


def _by_groups(n: DataFrame, t: DataFrame, needle: str, text: str, text_keys: list[str], most: int) -> DataFrame:
    """Texts with each needle ``_w`` of their key that they hold; keys of more than ``most`` characters by postings."""
    words = n.select(F.col("_own").alias("_in"), F.col(needle).alias("_w")).filter("_in is not null").distinct()
    live = t.join(words.select("_in").distinct(), "_in", "left_semi").select(*t.columns)
    chars = words.select("_in", F.length("_w").alias("c")).unionByName(live.select("_in", F.length(text).alias("c")))
    heavy = chars.groupBy("_in").agg(F.sum("c").alias("c")).filter(F.col("c") > most).select("_in")
    layout = StructType([*live.schema, StructField("_w", StringType())])

    def found(needles: pa.Table, texts: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for word in needles.column("_w").to_pylist():
            automaton.add_word(word, word)
        automaton.make_automaton()
        held = [{w for _, w in automaton.iter(body)} if body and len(needles) else () for body in texts.column(text).to_pylist()]
        rows = pa.array([i for i, hits in enumerate(held) for _ in hits], pa.int64())
        return texts.take(rows).append_column("_w", pa.array([w for hits in held for w in hits], pa.string()))

    def together(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.groupBy("_in").cogroup(b.groupBy("_in")).applyInArrow(found, layout)

    if heavy.isEmpty():
        return together(words, live)
    light = together(words.join(heavy, "_in", "left_anti"), live.join(heavy, "_in", "left_anti").select(*live.columns))
    large = n.join(heavy, n["_own"] == heavy["_in"], "left_semi")
    return light.unionByName(_by_postings(large, live.join(heavy, "_in", "left_semi").select(*live.columns), needle, text, text_keys))


def _by_postings(n: DataFrame, t: DataFrame, needle: str, text: str, text_keys: list[str]) -> DataFrame:
    """Texts with each needle ``_w`` of their group that they hold, for any number of needles."""
    words = n.select(F.col(needle).alias("_w"), F.col("_own").alias("_in")).distinct()
    own = _postings(words, ["_in", "_w"], "_w", gram_sizes("_w"))
    sizes = words.agg(F.collect_set(gram_sizes("_w")[0])).scalar()  # as many as SIZES at most
    postings = _postings(t, [*text_keys, "_in"], text, sizes)
    grams = own.select("_in", "_g").distinct()
    if fits_broadcast(words.select("_w"), AUTOMATON_NEEDLES, LISTED_CHARS):
        grams = F.broadcast(grams)
    wanted = postings.join(grams, ["_in", "_g"], "left_semi")
    spread = wanted.groupBy("_in", "_g").agg(F.count(F.lit(1)).alias("_df"))
    met = attach(wanted, _probes(own, spread), ["_in", "_g"], "_df", F.struct(*text_keys), "inner", counts=spread)
    whole = met.groupBy("_in", "_w", "_need", *text_keys, (F.col("_at") - F.col("_off")).alias("_start")).agg(
        F.count(F.lit(1)).alias("_n")).filter("_n >= _need")
    keys = [f"_k{i}" for i in range(len(text_keys))]
    pairs = whole.select(F.col("_in").alias("_scope"), "_w", *(F.col(c).alias(k) for c, k in zip(text_keys, keys))).distinct()
    same = reduce(lambda a, b: a & b, (t[c].eqNullSafe(pairs[k]) for c, k in zip(text_keys, keys)), t["_in"] == pairs["_scope"])
    return t.join(pairs, same).filter(F.contains(F.col(text), F.col("_w"))).drop("_scope", *keys)


def all_positions(text: Column, needle: Column) -> Column:
    """0-based starts of all non-overlapping hits, left to right, as an array."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.regexp_replace(needle, F.lit(r"\\E"), F.lit(r"\\E\\\\E\\Q")), F.lit(r"\E")), -1)
    hits = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(state, piece):
        here = state["next"] + F.length(piece)
        return F.struct((here + F.length(needle)).alias("next"), F.concat(state["at"], F.array(here)).alias("at"))

    return F.aggregate(hits, start, step, lambda s: s["at"])
