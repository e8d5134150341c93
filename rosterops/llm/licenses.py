"""License scan by diagonal voting, with DataFrame functions only.

Every pair of neighbouring words of a text is joined to the places where a template has that
pair. A place in the text less the place in the template is a diagonal: pairs of one copied
passage share it. Votes are summed by diagonal; diagonals at most ``GAP`` apart, as left by a
word put in or taken out, are merged. A phrase is verified where one diagonal holds all its
pairs; a longer template where one diagonal or a run of them holds the share ``SHARE`` of them
within a span of about its own length. Each diagonal starts a run, and of runs that overlap
the best stays, so stray pairs nearby take nothing away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import texts_of

GAP, SHARE = 3, 0.75
LONGER = 1.5  # span of a run, in lengths of its template
# Fixed: a word is a run of ASCII letters and digits and of all other signs beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed: the phrases that are found word for word, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Wording of further public licenses, found also with a few words changed.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution sharealike international license", "cc-by-sa"),
    ("unlicensed free and unencumbered software released into the public domain", "unlicense"),
]
_END = ""  # stands after the last word, at the number of words


def template_pairs(session, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """``pair, hash, template, place, pairs, exact, label`` of all word pairs; fixed and small."""
    rows = [(_END, -1, 0, 1, True, "")]
    for number, (text, label) in enumerate([*phrases, *templates]):
        words = text.split()
        rows += [(f"{a} {b}", number, k, len(words) - 1, number < len(phrases), label) for k, (a, b) in enumerate(zip(words, words[1:]))]
    known = session.createDataFrame(rows, "pair string, template int, place int, pairs int, exact boolean, label string")
    return known.withColumn("hash", F.xxhash64("pair"))


def words_of(text: Column) -> Column:
    """Words with small letters. The Kelvin sign, whose small letter is an ASCII one, is put aside."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("Å"))), _BETWEEN), "")


def _best_run(near: Column, pairs: Column, gap: int, share: float) -> Column:
    """The run that starts at the first of some diagonals and holds most pairs, and among these the
    shortest: ``(missed, long, start, end)``, ``missed`` being less the pairs found. Null: none
    reaches ``share``. A diagonal that would make the span too long is passed over."""
    first = F.element_at(near, 1)
    none = F.lit(None).cast("struct<missed:int,long:int,start:int,end:int>")

    def add(state: Column, d: Column) -> Column:
        low, high = F.least(state["low"], d["low"]), F.greatest(state["high"], d["high"])
        fits = (d["diagonal"] - state["last"] <= gap) & (high + 2 - low <= LONGER * (pairs + 1))
        places = F.array_union(state["places"], d["places"])
        run = F.struct((-F.size(places)).alias("missed"), (high + 2 - low).alias("long"), low.alias("start"), (high + 2).alias("end"))
        more = F.struct(
            d["diagonal"].alias("last"), places.alias("places"), low.alias("low"), high.alias("high"),
            F.least(state["best"], F.when(F.size(places) >= share * pairs, run)).alias("best"),
        )
        return F.when(fits, more).otherwise(state)

    start = F.struct(first["diagonal"].alias("last"), F.array().cast("array<int>").alias("places"), first["low"].alias("low"), first["high"].alias("high"), none.alias("best"))
    return F.when(F.size(near) > 0, F.aggregate(near, start, add)["best"])


def _apart(runs: Column) -> Column:
    """Runs that do not overlap, the best first."""
    free = lambda some, r: ~F.exists(some, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    empty = F.array().cast("array<struct<missed:int,long:int,start:int,end:int>>")
    return F.aggregate(F.array_sort(runs), empty, lambda some, r: F.when(free(some, r), F.array_append(some, r)).otherwise(some))


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
    gap: int = GAP, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, spans`` for every row of ``docs``.

    ``spans``: ``(label, exact, start, end, score)`` in words, exact ones for each place of a
    phrase, the others for runs of a template; ``score`` is the share of its pairs found. A
    phrase needs two words or more. A null or empty text has no words and no spans. Rows that
    repeat an id and text are scanned once and returned as often as they occur; null ids are
    kept. Votes of one document meet in one place, texts do not.
    """
    texts = texts_of(docs, id_col, text_col)
    cut = texts.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    each = F.transform("w", lambda word, k: F.concat(word, F.lit(" "), F.coalesce(F.get("w", k + 1), F.lit(""))))
    pairs = cut.select("doc_id", "h", F.posexplode(F.concat(each, F.array(F.lit(_END)))).alias("at", "pair"))
    known = F.broadcast(template_pairs(texts.sparkSession, phrases, templates).withColumnRenamed("pair", "t_pair"))
    votes = pairs.withColumn("hash", F.xxhash64("pair")).join(known, "hash").filter(F.col("pair") == F.col("t_pair"))
    key = ["doc_id", "h"]
    diagonals = votes.groupBy(*key, "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.first("pairs").alias("pairs"), F.first("exact").alias("exact"), F.first("label").alias("label"),
    )
    reach = max([0, *[int(LONGER * len(text.split())) + len(text.split()) for text, _ in templates]])
    along = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(0, reach)
    near = F.collect_list(F.when(~F.col("exact"), F.struct("diagonal", "places", "low", "high"))).over(along)
    own = F.struct((-F.size("places")).alias("missed"), (F.col("high") + 2 - F.col("low")).alias("long"), F.col("low").alias("start"), (F.col("high") + 2).alias("end"))
    real = F.when(F.col("exact"), F.when(F.size("places") == F.col("pairs"), own)).otherwise(_best_run(near, F.col("pairs"), gap, share))
    runs = diagonals.withColumn("run", F.when(F.col("template") >= 0, real))
    each = runs.groupBy(*key, "template").agg(
        F.max("n").alias("n"), F.max("low").alias("low"), F.collect_list("run").alias("runs"),
        F.first("pairs").alias("pairs"), F.first("exact").alias("exact"), F.first("label").alias("label"),
    ).withColumn("runs", F.when(F.col("exact"), F.col("runs")).otherwise(_apart(F.col("runs"))))
    spans = F.transform("runs", lambda r: F.struct("label", "exact", r["start"].alias("start"), r["end"].alias("end"), (-r["missed"] / F.col("pairs")).alias("score")))
    found = each.withColumn("spans", spans).groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("n"))).alias("copies"), F.max(F.when(F.col("template") < 0, F.col("low"))).alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    again = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return again.select("doc_id", F.col("n_words").cast("long"), "spans")


def report(spans: DataFrame) -> DataFrame:
    """One row per document: places of the exact phrases, and labels."""
    base = F.filter("spans", lambda s: s["exact"])
    label = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda s: s["label"]))), ",")
    start = F.transform(base, lambda s: s["start"])
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"),
        F.array_max(start).cast("long").alias("last_word"), label(base).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
