"""Compatibility-normalised text.

Spark has no NFKC, so this one step runs as an Arrow batch UDF that only translates
characters; everything after it (filters, prefixes, grams) stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rosterops.functions.text import _c, char_grams

KEEP_CJK = r"[^0-9a-z\x{4E00}-\x{9FFF}]+"
CLAUSE_PREFIX = r"^(?U)\s*(?:[0-9]+(?:\.[0-9]+){1,6}|[（(]\s*[0-9]+\s*[）)]|[a-z][.、])\s*"


@F.pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    """NFKC, then lower case; NULL becomes empty."""
    return texts.fillna("").map(lambda t: t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC only; NULL becomes empty."""
    return texts.fillna("").map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def loose(lowered: Column) -> Column:
    """Loose text out of a lowered one: whitespace, punctuation and symbols fall away."""
    return F.regexp_replace(lowered, r"(?U)[\s\x{FEFF}\p{P}\p{S}]+", "")


def match_text(lowered: Column) -> Column:
    """Match text out of a lowered one: no clause number, only digits, latin and CJK."""
    return F.regexp_replace(F.regexp_replace(lowered, CLAUSE_PREFIX, ""), KEEP_CJK, "")


def line_key(lowered: Column) -> Column:
    """Line identity: digits, latin and CJK only."""
    return F.regexp_replace(lowered, KEEP_CJK, "")


def space_free(lowered: Column) -> Column:
    """Search identity: lowered text without whitespace."""
    return F.regexp_replace(lowered, r"(?U)[\s\x{FEFF}]+", "")


def page_line(lowered: Column) -> Column:
    """One lowered page line: page furniture becomes empty, then the structural prefix goes."""
    line = F.regexp_replace(lowered, r"^(?U)[\s\x{FEFF}]+|(?U)[\s\x{FEFF}]+$", "")
    furniture = (
        line.rlike(r"^20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}$") | line.rlike(r"^[0-9]{1,4}$") | line.rlike(r"^《[^》]{1,20}》$")
    )
    return F.when(furniture, "").otherwise(without_prefix(line))


def without_prefix(line: Column) -> Column:
    """Drop a leading number and a leading parenthesised number."""
    numberless = F.regexp_replace(line, r"^\s*[0-9]+(?:\.[0-9]+)*\s*", "")
    return F.regexp_replace(numberless, r"^[（(]\s*[0-9]+\s*[）)]\s*", "")


def page_match_text(lowered: Column) -> Column:
    """Match text of a page: its lines cleaned one by one, then joined without separator."""
    lines = F.transform(F.split(lowered, "\r?\n"), page_line)
    return F.regexp_replace(F.array_join(lines, ""), KEEP_CJK, "")


def grams(text: Column, size: int = 2) -> Column:
    """Distinct character grams; a text no longer than ``size`` is its own gram."""
    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) <= size, whole).otherwise(char_grams(text, size))


def id_tokens(lowered: Column) -> Column:
    """Sorted distinct identifiers: latin words of two characters or more, and numbers."""
    raw = F.regexp_extract_all(lowered, F.lit(r"([a-z][a-z0-9._/-]*|[0-9]+(?:\.[0-9]+)*)"), 1)
    return F.array_sort(F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))))


def token_difference(left, right) -> Column:
    """Tokens only one side has."""
    return F.struct(F.array_except(_c(left), _c(right)).alias("left_only"), F.array_except(_c(right), _c(left)).alias("right_only"))


def similarity(left: Column, right: Column, left_grams: Column, right_grams: Column) -> Column:
    """Similarity of two match texts, 0 to 1, from grams, containment and length ratio."""
    shared = F.size(F.array_intersect(left_grams, right_grams))
    dice = 2 * shared / F.greatest(F.lit(1), F.size(left_grams) + F.size(right_grams))
    ratio = F.least(F.length(left), F.length(right)) / F.greatest(F.length(left), F.length(right))
    inside = F.when(F.contains(left, right) | F.contains(right, left), ratio).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside, dice * 0.82 + ratio * 0.18))
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).otherwise(score)


class LooseTable(dict):
    """Character to its loose form, filled on demand for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        shown = "".join(c for c in unicodedata.normalize("NFKC", chr(code)).lower()
                        if not (c.isspace() or c == "﻿" or unicodedata.category(c)[0] in "PS"))
        self[code] = shown
        return shown


LOOSE = LooseTable()


def loose_offsets(text: str) -> tuple[str, list[int]]:
    """Loose text and, per loose character, the source character it came from."""
    parts, offsets = [], []
    for i, ch in enumerate(text):
        shown = LOOSE[ord(ch)]
        parts.append(shown)
        offsets += [i] * len(shown)
    return "".join(parts), offsets


@F.pandas_udf(StringType())
def loose_text(texts: pd.Series) -> pd.Series:
    """Loose text character by character, as the offset map sees it."""
    return texts.fillna("").map(lambda t: t.translate(LOOSE))
