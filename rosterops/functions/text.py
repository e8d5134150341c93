"""Text expressions: cleaning, extraction, splitting, display windows.

Whitespace means the Unicode set plus the byte-order mark, because cells pasted from
office tools carry no-break and ideographic spaces that ``trim`` alone would keep.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cell format: words that mean "no value" and words that mean "yes".
NULL_WORDS = ["", "/", "N/A", "NA", "None", "不适用", "无", "null", "NULL"]
TRUE_WORDS = ["是", "Y", "y", "YES", "Yes", "TRUE", "true", "1", "4"]

_SPACE = r"[\s\x{FEFF}]"
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def clean(col) -> Column:
    """Null becomes the empty text; Unicode whitespace is trimmed at both ends."""
    return F.btrim(F.coalesce(_c(col).cast("string"), F.lit("")), F.lit(_BLANKS))


def squeeze(col) -> Column:
    """Every whitespace run, no-break spaces included, becomes one space."""
    return F.regexp_replace(clean(col), rf"(?U){_SPACE}+", " ")


def strip_spaces(col) -> Column:
    """Drop all whitespace."""
    return F.regexp_replace(clean(col), rf"(?U){_SPACE}+", "")


def is_null_word(col) -> Column:
    return clean(col).isin(NULL_WORDS)


def is_true_word(col) -> Column:
    return clean(col).isin(TRUE_WORDS)


def has_value(col) -> Column:
    return clean(col) != ""


def number_like(col) -> Column:
    """The whole text as a number, else the first signed decimal in it, else 0."""
    text = clean(col)
    inner = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    return F.coalesce(text.try_cast("double"), inner.try_cast("double"), F.lit(0.0))


def yes_no(col, yes_words: list[str], no_words: list[str]) -> Column:
    """Struct ``(value, valid)``: blank gives NULL and valid, an unknown word is invalid."""
    text = F.lower(clean(col))
    value = F.when(text.isin(yes_words), F.lit(True)).when(text.isin(no_words), F.lit(False))
    valid = (text == "") | text.isin(yes_words) | text.isin(no_words)
    return F.struct(value.alias("value"), valid.alias("valid"))


def person_key(name, employee_id) -> Column:
    return F.concat_ws("@@", clean(name), clean(employee_id))


def six_digit_runs(col) -> Column:
    """Non-overlapping runs of six digits, without word boundaries."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"([0-9]{6})"), 1)


def sorted_ids(runs: Column) -> Column:
    """Distinct runs in numeric order."""
    as_numbers = F.transform(F.array_distinct(runs), lambda x: x.cast("int"))
    return F.transform(F.array_sort(as_numbers), lambda n: F.lpad(n.cast("string"), 6, "0"))


def numeric_employee_id(col) -> Column:
    """``193391.0`` gives ``193391``; anything that is not all digits gives empty text."""
    text = squeeze(col)
    whole = F.regexp_extract(text, r"^([0-9]+)\.0+$", 1)
    return F.when(whole != "", whole).when(text.rlike(r"^[0-9]+$"), text).otherwise("")


def six_digit_employee_id(col) -> Column:
    """The first six-digit run, else the squeezed text."""
    text = squeeze(col)
    hit = F.regexp_extract(text, r"([0-9]{6})", 1)
    return F.when(hit != "", hit).otherwise(text)


def whitelist_ids(col) -> Column:
    """IDs in pasted text; a text without any six-digit run is cut into sixes."""
    text = F.coalesce(_c(col), F.lit(""))
    direct = F.array_distinct(six_digit_runs(text))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    cut = F.regexp_extract_all(digits, F.lit(r"([0-9]{6})"), 1)
    return F.when(F.size(direct) > 0, direct).otherwise(F.array_distinct(cut))


def display_name_key(col) -> Column:
    """Upper-case name without parenthesised notes."""
    bare = F.regexp_replace(F.upper(squeeze(col)), r"[（(][^）)]*[）)]", "")
    return squeeze(bare)


def compact_name_key(col) -> Column:
    """Name without parenthesised notes and without inner spaces."""
    return strip_spaces(F.regexp_replace(squeeze(col), r"[（(][^）)]*[）)]", ""))


def names_agree(left, right) -> Column:
    """Two names agree when either is blank or their keys are equal."""
    a, b = F.coalesce(_c(left), F.lit("")), F.coalesce(_c(right), F.lit(""))
    return (a == "") | (b == "") | (display_name_key(a) == display_name_key(b))


def split_pasted_line(col) -> Column:
    """Cut one long pasted line before every six digits followed by a CJK character."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), r"(?=[0-9]{6}[\x{4E00}-\x{9FA5}])")
    trimmed = F.transform(parts, clean)
    return F.filter(trimmed, lambda x: x.rlike(r"[0-9]{6}"))


def name_after_id(col) -> Column:
    """The two to four CJK characters that follow a six-digit ID."""
    return F.nullif(
        F.regexp_extract(F.coalesce(_c(col), F.lit("")), r"[0-9]{6}\s*([\x{4E00}-\x{9FA5}]{2,4})", 1),
        F.lit(""),
    )


def bounded_id(col) -> Column:
    """A six-digit number that stands alone as a word."""
    return F.nullif(
        F.regexp_extract(F.coalesce(_c(col), F.lit("")), r"(?U)\b([0-9]{6})\b", 1), F.lit("")
    )


def dates_in_text(col) -> Column:
    return F.regexp_extract_all(
        F.coalesce(_c(col), F.lit("")), F.lit(r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})"), 1
    )


def split_names(col) -> Column:
    """Names in a comma list, either comma form, blanks dropped."""
    return F.filter(F.transform(F.split(clean(col), "[，,]"), clean), lambda x: x != "")


def split_options(col) -> Column:
    """Options in a cell, split on commas, list commas, semicolons and newlines."""
    return F.filter(
        F.transform(F.split(clean(col), r"[，,、;；\n\r]+"), clean), lambda x: x != ""
    )


def split_words(col) -> Column:
    """Items between whitespace, punctuation and symbol runs."""
    return F.filter(
        F.split(F.coalesce(_c(col), F.lit("")), r"(?U)[\s\x{FEFF}\p{P}\p{S}]+"), lambda x: x != ""
    )


def join_words(col, separator: str = "") -> Column:
    return F.array_join(split_words(col), separator)


def after_colon(col) -> Column:
    """Text after the first colon of either width, whole text when there is none."""
    return clean(F.regexp_replace(clean(col), r"^[^:：]*[:：]", ""))


def tech_level(col) -> Column:
    """Level code out of a technical description, by three patterns in order."""
    compact = strip_spaces(F.upper(clean(col)))
    tail = F.regexp_replace(compact, r"^[^:：]*[:：]?", "")
    has_colon = compact.rlike("[:：]")
    content = F.when(has_colon & (tail != ""), F.regexp_replace(tail, "：", ":")).otherwise(compact)
    patterns = [r"([A-Z][0-9]{0,2})类", r"飞行教员([A-Z][0-9]{0,2})", r"([A-Z][0-9]{0,2})$"]
    hits = [F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits, F.lit(""))


def cut_minutes(col) -> Column:
    """``123:45`` gives ``123``; the wide colon counts too."""
    return clean(F.split(clean(col), "[：:]")[0])


def safe_name(col) -> Column:
    """Output file name: reserved characters become ``_``, space runs become one space."""
    return squeeze(F.regexp_replace(clean(col), r'[\\/:*?"<>|]', "_"))


def safe_token(col, fallback: str = "证据") -> Column:
    """File name part without spaces: reserved runs and space runs become one ``_``."""
    text = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r'[\\/:*?"<>|]+', "_")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def sheet_name(col) -> Column:
    """Sheet-safe name: reserved characters become spaces."""
    return clean(F.regexp_replace(clean(col), r"[\\/?*\[\]:]", " "))


def link_target(formula) -> Column:
    """Struct ``(url, label)`` out of a ``HYPERLINK("url","label")`` cell formula."""
    text = F.coalesce(_c(formula), F.lit(""))
    both = r'(?i)HYPERLINK\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)'
    return F.struct(
        F.nullif(F.regexp_extract(text, both, 1), F.lit("")).alias("url"),
        F.nullif(F.regexp_extract(text, both, 2), F.lit("")).alias("label"),
    )


def plain_markdown(col) -> Column:
    """Readable text of a Markdown source."""
    text = F.coalesce(_c(col), F.lit(""))
    steps = [
        (r"\A---\r?\n(?s:.*?)\r?\n---\r?\n?", ""),  # front matter
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),  # images keep their caption
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),  # links keep their label
        (r"(?m)^```.*$", " "),
        (r"<[^>]+>", " "),
        (r"(?m)^\s*(?:#{1,6}|[-+*>]|[0-9]+\.)\s+", ""),  # headings, lists, quotes
        (r"(?m)^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$", " "),  # table rules
        (r"[|`*_~]", " "),
    ]
    for pattern, target in steps:
        text = F.regexp_replace(text, pattern, target)
    return squeeze(text)


def snippet(text, needle, before: int = 35, after: int = 65) -> Column:
    """Text around the first hit, dots on every cut side; no hit gives the first 100."""
    body, key = F.coalesce(_c(text), F.lit("")), F.coalesce(_c(needle), F.lit(""))
    position = F.instr(F.lower(body), F.lower(key))
    start = F.greatest(position - before, F.lit(1))
    stop = F.least(position + F.length(key) + after, F.length(body) + 1)
    cut = F.substring(body, start, stop - start)
    head = F.when(start > 1, "...").otherwise("")
    tail = F.when(stop <= F.length(body), "...").otherwise("")
    whole = F.substring(body, 1, before + after)
    return F.when(position > 0, F.concat(head, cut, tail)).otherwise(whole)


def excerpt(text, needle, radius: int = 90) -> Column:
    """Squeezed text around the first hit, or its first ``2 * radius`` characters."""
    body = squeeze(text)
    key = F.coalesce(_c(needle), F.lit(""))
    position = F.instr(F.lower(body), F.lower(key))
    start = F.greatest(position - radius, F.lit(1))
    hit = F.substring(body, start, position + F.length(key) + radius - start)
    whole = F.substring(body, 1, 2 * radius)
    return F.when((key == "") | (position == 0), whole).otherwise(hit)


def char_grams(text, size: int, distinct: bool = True) -> Column:
    """Distinct character runs of one length, none when the text is shorter. Without ``distinct``
    every run stays, at the place where it starts.

    The text becomes a character array once; cutting runs out of the string itself would
    walk it from the start for every run.
    """
    def cut(chars):
        def run(i):
            if size <= 8:
                return F.concat(*(F.get(chars, i + k) for k in range(size)))
            return F.array_join(F.slice(chars, i + 1, F.lit(size)), "")

        last = F.size(chars) - size
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)
        return F.when(last >= 0, F.array_distinct(runs) if distinct else runs)

    whole = bind(F.split(_c(text), ""), cut)
    return F.coalesce(F.when(_c(text) != "", whole), F.array().cast("array<string>"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, for expressions that lambdas read often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
