"""Document text to ordered blocks and pages.

A document is one row, so its lines are cut, cleaned and numbered inside that row with
array expressions; only the running title needs to look across blocks, and it does so
with the two-level scan, whatever the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import clean, squeeze
from rosterops.operators.skew import running_last

NUMBERED = r"^[0-9]+(?:\.[0-9]+){1,6}(?:\s+\S.*)?$"
CHAPTERED = r"^第[一二三四五六七八九十百0-9]+[章节条](?:\s+\S.*)?$"
CLAUSE = r"^((?:第[一二三四五六七八九十百0-9]+[章节条]|[0-9]+(?:\.[0-9]+){1,6}))\s*(.*)$"
SENTENCE_END = r"[。；！？!?]$"


def is_heading(line) -> Column:
    """A numbered or chapter heading."""
    text = clean(line)
    return text.rlike(NUMBERED) | text.rlike(CHAPTERED)


def looks_like_title(line) -> Column:
    """A heading, or a short line without closing punctuation."""
    text = clean(line)
    short = F.length(text).between(2, 28) & ~text.rlike(r"[。；，！？!?：:]$")
    return is_heading(line) | short


def clause_parts(line) -> Column:
    """Struct ``(number, text)`` of a clause line; the number is NULL otherwise."""
    text = clean(line)
    return F.struct(
        F.nullif(F.regexp_extract(text, CLAUSE, 1), F.lit("")).alias("number"),
        clean(F.regexp_extract(text, CLAUSE, 2)).alias("text"))


def text_lines(text) -> Column:
    """Trimmed non-empty lines as an array."""
    unified = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\r\n?", "\n")
    return F.filter(F.transform(F.split(unified, "\n+"), clean), lambda x: x != "")


def split_blocks(documents: DataFrame, doc_id: str, doc_name: str, text: str) -> DataFrame:
    """Blocks ``(doc_id, doc_name, block_idx, text)``, numbered from 1, tabs shown as bars."""
    cut = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_name).alias("doc_name"),
                           F.posexplode(text_lines(text)).alias("pos", "line"))
    return cut.select("doc_id", "doc_name", (F.col("pos") + 1).alias("block_idx"), "line",
                      F.regexp_replace("line", "\t+", " | ").alias("text"))


def with_running_title(blocks: DataFrame, title: Column) -> DataFrame:
    """Last title seen so far in the document, empty before the first."""
    out = running_last(blocks, ["doc_id"], "block_idx", F.when(title, clean("line")), "title")
    return out.withColumn("title", F.coalesce("title", F.lit(""))).drop("line")


def manual_units(documents: DataFrame, doc_id: str, doc_name: str, text: str) -> DataFrame:
    """Comparison units: squeezed lines with the running title by the looser title test.

    The squeeze turns tabs into spaces before a unit is typed, so a tab that survives is
    impossible and every unit is a paragraph.
    """
    blocks = split_blocks(documents, doc_id, doc_name, text).withColumn("line", squeeze("line"))
    titled = with_running_title(blocks.withColumn("text", F.col("line")), looks_like_title("line"))
    return titled.withColumn("kind", F.lit("paragraph"))


def page_texts(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Page-text table ``(doc_id, page_no, text)``."""
    return pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_no"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def textless_documents(pages: DataFrame) -> DataFrame:
    """Documents whose pages hold no text at all: scans, to be rejected."""
    longest = pages.groupBy("doc_id").agg(F.max(F.length(clean("text"))).alias("n"))
    return longest.filter(F.col("n") == 0).select("doc_id", F.lit("没有可读取文字层").alias("reason"))


def readable_pages(pages: DataFrame) -> DataFrame:
    return pages.join(textless_documents(pages), "doc_id", "left_anti")


def enabled_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.coalesce(F.col("enabled"), F.lit(True)))
