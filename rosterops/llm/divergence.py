"""How far the sources of a language differ in their words, by one-hot level products.

Every source of a language gives each kept term a price that depends on the term's count there
only. Equal counts are one *level* of the source, so two sources differ by a sum over pairs of
levels: how many terms stand at level ``a`` of the one and ``b`` of the other, times the difference
of the two prices. With an indicator column for each (source, level), the matrix product of
these columns with their transpose yields all these joint tables at once.

Terms are dealt to units by their hash; sources beyond ``GROUPS`` of a language are dealt to
pairs of groups of sources. A unit cuts its terms, sorted by count, into blocks of at most
``COLUMNS`` indicator columns, so that many rare terms or few frequent ones share a block. Each
block's product is priced where it is made, and only sums per pair of sources are passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import pick, stored, table_rows, whole_groups

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
UNIT_TERMS, GROUPS, COLUMNS = 2_048, 64, 1_024
HELD = 300_000  # distinct terms a task counts before it passes them on
PART_CHARS = 1 << 20
# ASCII letters and everything beyond ASCII; in UTF-8 every byte of the latter is 0x80 or more.
_TERM, _REST = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[a-z\x80-\xff]*")


def terms_of(text: str) -> Iterator[list[bytes]]:
    """All terms of a text, A-Z lowered, a part of the text at a time."""
    data, start = text.encode().lower(), 0
    while start < len(data):
        end = _REST.match(data, min(start + PART_CHARS, len(data))).end()
        yield _TERM.findall(data, start, end)
        start = end


def labelled_texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def term_counts(texts: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, from ``lang, source, text``."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for lang, source, text in table_rows(batches):
            n, docs = total.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            own: set[bytes] = set()
            for found in terms_of(text):
                n.update(found)
                own.update(found)
            docs.update(own)
            held += len(n)
            if held >= HELD:
                yield from _counted(total, schema)
                total, held = {}, 0
        yield from _counted(total, schema)

    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(total: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in total.items():
        terms = list(n)
        names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
        counts = [pa.array([some[t] for t in terms], pa.int64()) for some in (n, docs)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), *counts], schema=schema)


def price(count: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """``1 + floor(scale * (count + smooth) / (total + smooth * terms))``, in whole numbers."""
    above = ((count + smooth).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)")).cast("decimal(38,0)")
    below = (total + smooth * terms).cast("decimal(38,0)")
    return F.call_function("div", above, below) + 1


def blocks_of(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of ``counts`` (terms by sources) whose levels are at most ``most`` columns
    together; one row always fits."""
    open_ = [(0, len(counts))]
    while open_:
        first, after = open_.pop()
        part = np.sort(counts[first:after], axis=0)
        columns = part.shape[1] + int((part[1:] != part[:-1]).sum())
        if columns <= most or after - first == 1:
            yield slice(first, after)
        else:
            middle = (first + after) // 2
            open_ += [(middle, after), (first, middle)]


def one_hot(counts: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of every source's levels, their prices, and each source's first column."""
    rows, hot, worth, starts = np.arange(len(counts)), [], [], []
    for group in range(counts.shape[1]):
        levels, first, place = np.unique(counts[:, group], return_index=True, return_inverse=True)
        column = np.zeros((len(counts), len(levels)), np.float32)
        column[rows, place] = 1
        starts.append(sum(map(len, worth)))
        hot.append(column)
        worth.append(prices[first, group])
    return np.hstack(hot), np.concatenate(worth), np.array(starts)


def unit_sums(counts: np.ndarray, prices: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = COLUMNS) -> np.ndarray:
    """Sums of price differences over all terms (rows), for each source of ``left`` by one of ``right``
    (columns), by exact products: a joint table's entry is a number of terms of one unit."""
    total = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(counts.sum(axis=1), kind="stable")
    counts, prices = counts[order], prices[order]
    for block in blocks_of(counts, most) if len(counts) and total.size else ():
        a, worth_a, starts_a = one_hot(counts[block][:, left], prices[block][:, left])
        b, worth_b, starts_b = (a, worth_a, starts_a) if left is right else one_hot(counts[block][:, right], prices[block][:, right])
        joint = (a.T @ b).astype(np.int64)
        joint *= np.abs(worth_a[:, None] - worth_b[None, :])
        total += np.add.reduceat(np.add.reduceat(joint, starts_a, axis=0), starts_b, axis=1)
    return total


def pair_sums(kept: DataFrame, groups: DataFrame, unit_terms: int = UNIT_TERMS, in_block: int = GROUPS, columns: int = COLUMNS) -> DataFrame:
    """``lang, source, item, value``: for every two sources of a language, in both orders, the sum of
    their price differences over all kept terms.

    ``kept``: ``lang, source, term, n, p`` with a row per count above zero. ``groups``: ``lang, source, p0, terms``, the
    price of a count of zero and the number of the language's kept terms.
    """
    width = Window.partitionBy("lang")
    named = groups.select("lang", "source", "p0", F.greatest(F.lit(1), F.ceil(F.col("terms") / unit_terms)).alias("units"), F.ceil(F.count(F.lit(1)).over(width) / in_block).alias("blocks"))
    named = named.withColumn("own", F.pmod(F.xxhash64("source"), "blocks"))
    rows = kept.join(named, ["lang", "source"]).withColumn("unit", F.pmod(F.xxhash64("term"), "units"))
    heads = named.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))).alias("met")
    both = heads.select("lang", "unit", met, "own", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p")).union(
        rows.select("lang", "unit", met, "own", "source", "term", "n", "p"))
    dealt = both.select("lang", "unit", "met.x", "met.y", "own", "source", "term", "n", "p")
    ordered = dealt.repartition("lang", "unit", "x", "y").sortWithinPartitions("lang", "unit", "x", "y")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 4):
            for first, after in zip(starts, np.append(starts[1:], len(table))):
                yield _unit(table.slice(first, after - first), columns, schema)

    found = ordered.mapInArrow(sums, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _unit(unit: pa.Table, columns: int, schema: pa.Schema) -> pa.RecordBatch:
    """A unit's sums: its terms become a dense table of counts and prices, absent ones at level zero."""
    lang, x, y = unit.column(0)[0].as_py(), unit.column(2)[0].as_py(), unit.column(3)[0].as_py()
    own, n, p = (unit.column(k).to_numpy() for k in (4, 7, 8))
    source, term = unit.column(5).combine_chunks().dictionary_encode(), unit.column(6).combine_chunks().dictionary_encode()
    names, at = source.dictionary.to_pylist(), source.indices.to_numpy()
    head = np.asarray(term.indices.is_null())
    zero, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    zero[at[head]], block[at[head]] = p[head], own[head]
    counts = np.zeros((len(term.dictionary), len(names)), np.int64)
    prices = np.tile(zero, (len(counts), 1))
    row = np.asarray(term.indices.fill_null(0))[~head]
    counts[row, at[~head]], prices[row, at[~head]] = n[~head], p[~head]
    left = np.flatnonzero(block == x)
    right = left if x == y else np.flatnonzero(block == y)
    value = unit_sums(counts, prices, left, right, columns)
    i, j = np.nonzero(left[:, None] != right[None, :])
    sides = [(left[i], right[j], value[i, j])] + ([] if x == y else [(right[j], left[i], value[i, j])])
    a, b, v = (np.concatenate(c) for c in zip(*sides))
    labels = pa.array(names, pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(v)), labels.take(pa.array(a)), labels.take(pa.array(b)), pa.array(v)], schema=schema)


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top: int | None = TOP, unit_terms: int = UNIT_TERMS,
    in_block: int = GROUPS, columns: int = COLUMNS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every occurring (lang, source).

    Part ``pair`` lists each other source of the language with the sum of price differences over the terms
    kept, those in at least ``least_docs`` documents of the language. Part ``term`` lists the terms that
    occur in the source and are dearer there than in the whole language, up to rank ``top`` (None: all).
    Null texts, languages and sources count as empty ones; a language without kept terms has sums of 0 and
    no terms; repeated rows are documents each; an empty table gives no row.
    """
    texts = labelled_texts(docs, text_col, lang_col, source_col)
    counts = stored(term_counts(texts), "term-counts")
    common = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= least_docs)
    kept = stored(counts.join(common.select("lang", "term", "all_n"), ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept-terms")
    wide = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(wide, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])
    none = F.lit(0).cast("long")
    at_zero = F.when(F.col("terms") > 0, price(none, F.col("total"), F.col("terms"), smooth, scale)).otherwise(none)
    groups = stored(groups.withColumn("p0", at_zero), "term-groups")
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", price(F.col("n"), F.col("total"), F.col("terms"), smooth, scale).alias("p"),
        price(F.col("all_n"), F.col("lang_total"), F.col("terms"), smooth, scale).alias("q"))
    pairs = pair_sums(priced.select("lang", "source", "term", "n", "p"), groups.select("lang", "source", "p0", "terms"), unit_terms, in_block, columns)
    dear = priced.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [some.withColumn("rank", F.row_number().over(by)) for some in (pairs, dear)]
    ranked[1] = ranked[1] if top is None else ranked[1].filter(F.col("rank") <= top)
    parts = [some.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, some in zip(("pair", "term"), ranked, strict=True)]
    return parts[0].union(parts[1])
