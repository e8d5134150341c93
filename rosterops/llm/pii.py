"""Personal data: spans by pattern, and terms that give protected entities away.

Base spans are those of e-mail addresses, ip addresses, card and phone numbers. Each distinct
value is a protected entity. Words that stand near an entity, of whatever length, are scored
against the whole corpus: with ``p`` the shares of documents, ``PMI(term, entity) = log2(p(t, e) / (p(t) p(e)))`` is
what a term reveals of an entity, and ``IC(entity) = -log2 p(e)`` all there is to reveal. A term
with ``PMI / IC`` at or above ``DISCLOSURE``, seen near the entity in at least ``SUPPORT``
different contexts, stands for it nearly as well as the value itself. All its occurrences in a
document that holds the entity, near or far, are spans of kind ``term``. Copies of one passage are
one context.

All of it is DataFrame functions. Matches become rows; places come from running sums over the
gaps between them, so a text with very many matches costs no more per match than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import by_place, pick, stored, text_hash, texts_of

KINDS = ["email", "ip", "card", "phone", "term"]
# Fixed patterns. Possessive repeats and the look-behinds keep long runs linear: a match that
# fails at the start of a run fails inside it too; \G is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this sign have no match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = 48  # characters on either side of a value in which terms are looked for
SUPPORT, DISCLOSURE = 3, 0.8
PIECES, WORD = r"\p{L}+|[^\p{L}]+", r"^\p{L}"  # words and what lies between them
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, n.between(16, 19) & F.call_function("luhn_check", F.when(n.between(16, 19), digits)))
        .when(kind == 3, n.between(8, 15))
        .otherwise(False)
    )


def _matches(text: Column, kind: int, context: int) -> Column:
    """Matches of a kind with the gap before each and the text around it."""
    name = KINDS[kind]
    gaps = F.split(text, PATTERNS[name], -1)
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0)).alias("value"), F.slice(gaps, 2, 1 << 30).alias("next"))
    found = F.transform(
        F.filter(zipped, lambda z: z["value"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["value"].alias("value"),
            F.right(z["gap"], F.lit(context)).alias("before"), F.left(z["next"], F.lit(context)).alias("after"),
        ),
    )
    sign = SIGNS[name]
    maybe = text.rlike("[0-9]") if sign is None else F.contains(text, F.lit(sign))
    return F.when(maybe, found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,before:string,after:string>>"))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """``doc_id, h, kind, copies, value, before, after, start, end``: the valid base spans of whole
    texts, and a row of kind -1 for every document. ``h`` is the text's hash; rows that repeat an
    id and text are one document of several ``copies``. Stored, as it is read more than once."""
    texts = texts_of(docs, id_col, text_col)
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after")))
    every = F.concat(mark, *[_matches(F.col("text"), kind, context) for kind in range(4)])
    rows = texts.select("doc_id", text_hash(F.col("text")).alias("h"), F.explode(every).alias("m")).select("doc_id", "h", "m.*")
    once = rows.groupBy("doc_id", "h", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "value", "before", "after")], F.count(F.lit(1)).alias("copies"))
    along = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.length("value")).over(along)
    placed = once.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    kept = placed.filter((F.col("kind") == -1) | _valid(F.col("kind"), F.col("value")))
    return stored(kept.select("doc_id", "h", "kind", "copies", "value", "before", "after", "start", "end"), "pii-mentions")


def _near_terms(side: str, context: int) -> Column:
    """Words of a context, in small letters. One cut by the context's border is left out."""
    parts = F.regexp_extract_all(side, F.lit(PIECES), F.lit(0))
    whole = F.when(F.length(side) < context, parts)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))) if side == "before" else F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(F.filter(F.coalesce(whole, inner), lambda p: p.rlike(WORD)), F.lower)


def _entity() -> Column:
    return F.struct("kind", F.lower("value").alias("value")).alias("entity")


def terms_near(found: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``doc_id, h, entity, context, term``: the words around every base span."""
    around = F.concat(_near_terms("before", context), _near_terms("after", context))
    return found.filter("kind >= 0").select("doc_id", "h", _entity(), F.xxhash64("before", "after").alias("context"), F.explode(around).alias("term"))


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, text_col: str = "text") -> DataFrame:
    """``entity, term, ratio``: pairs past the disclosure threshold, from the whole corpus."""
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc_id", "h").alias("both"))
    pairs = stored(pairs.filter(F.col("contexts") >= support).drop("contexts"), "pii-pairs")
    words = F.array_distinct(F.filter(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+"), lambda w: w != ""))
    # Counted before it is joined: a task passes on one row per word, however often it occurs.
    of_term = pick(docs, text=text_col).select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    of_entity = found.filter("kind >= 0").groupBy(_entity()).agg(F.countDistinct("doc_id", "h").alias("with_entity"))
    total = found.filter("kind = -1").agg(F.sum("copies")).scalar()
    scored = pairs.join(of_term, "term").join(of_entity, "entity").withColumn("n", total)
    content = F.log2(F.col("n") / F.col("with_entity"))
    reveals = F.log2(F.col("both") * F.col("n") / (F.col("with_term") * F.col("with_entity")))
    return scored.select("entity", "term", (reveals / content).alias("ratio")).filter(F.col("ratio") >= disclosure)


def occurrences(docs: DataFrame, found: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, start, end``: every place of a disclosing term in the documents that hold its
    entity. ``known``: ``entity, term``. Only texts of such documents are taken apart; a place is the
    running sum of the lengths before it."""
    held = found.filter("kind >= 0").select("doc_id", "h", _entity()).distinct()
    wanted = stored(held.join(known, "entity").select("doc_id", "h", "term").distinct(), "pii-wanted")
    holders = wanted.select(F.col("doc_id").alias("held_id"), F.col("h").alias("held_h")).distinct()
    # Every base span holds a digit or an @.
    texts = texts_of(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]")).withColumn("h", text_hash(F.col("text")))
    texts = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("h") == F.col("held_h")), "left_semi").dropDuplicates(["doc_id", "h"])
    pieces = texts.select("doc_id", "h", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("i", "piece"))
    along = Window.partitionBy("doc_id", "h").orderBy("i")
    placed = pieces.withColumn("end", F.sum(F.length("piece").cast("long")).over(along)).filter(F.col("piece").rlike(WORD))
    words = placed.select("doc_id", "h", (F.col("end") - F.length("piece")).alias("start"), "end", F.lower("piece").alias("word"))
    terms = wanted.select(F.col("doc_id").alias("held_id"), F.col("h").alias("held_h"), "term")
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("h") == F.col("held_h")) & (F.col("word") == F.col("term"))
    return words.join(terms, same, "left_semi").select("doc_id", "h", "start", "end")


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """``doc_id, h, copies, kind, start, end``: a row per span (code points, end exclusive),
    ``kind`` a place in ``KINDS``, and one of kind -1 per document.

    Matches of a kind are leftmost and apart; one that fails its test is dropped without
    another try. A null or empty text has no spans. Null ids are kept. ``context`` bounds where
    terms are looked for, not where known ones are marked.
    """
    found = mentions(docs, id_col, text_col, context)
    known = disclosing(docs, found, terms_near(found, context), support, disclosure, text_col)
    marked = occurrences(docs, found, known.select("entity", "term"), id_col, text_col)
    columns = ["doc_id", "h", "copies", "kind", "start", "end"]
    return found.select(*columns).union(marked.select("doc_id", "h", F.lit(1).cast("long"), F.lit(4), "start", "end"))


def report(spans: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, all spans."""
    one = F.when(F.col("kind") >= 0, F.struct("kind", "start", "end"))
    found = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(one)).alias("s"), F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    again = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return again.select(
        "doc_id", *[count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:4])],
        F.sha2(text(F.filter("s", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"),
    )


def sanitise(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` put in general terms, as ``[EMAIL]`` or ``[TERM]``.

    Spans that overlap are joined under the kind of the first. Texts without a span, and null
    ones, stay as they are and are not shuffled unless they have a sign of personal data.
    """
    plain, [doc_id, text_name] = by_place(docs, id_col, text_col)
    real = spans.filter("kind >= 0")
    before = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    apart = real.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0))).filter(F.col("end") > F.col("from"))
    cuts = apart.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("s"))
    cuts = cuts.select(F.col("doc_id").alias("pii_id"), F.col("h").alias("pii_h"), F.col("s").alias("pii_s"))
    text = F.col(text_name)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda s: F.when(s["start"] >= s["from"], F.concat(F.substring(text, (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), F.get(names, s["kind"]))).otherwise("")
    tail = F.substring(text, (F.element_at("pii_s", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform("pii_s", piece), ""), tail)
    maybe = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    joined = plain.filter(maybe).join(cuts, F.col(doc_id).eqNullSafe(F.col("pii_id")) & (text_hash(text) == F.col("pii_h")), "left")
    changed = joined.withColumn(text_name, F.when(F.col("pii_s").isNull(), text).otherwise(clean)).select(*plain.columns)
    return plain.filter(~maybe).union(changed).toDF(*docs.columns)
