"""Date expressions at day precision.

Four cell formats meet here. They differ on purpose: training sheets roll an overflowing
day forward, forms reject it, lodging bills read two-digit years, query lists only know
year-month-day. Nothing raises under ANSI mode; an unreadable cell is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterops.functions.text import _c, clean, is_null_word

SERIAL_EPOCH = "1899-12-30"


def rolled_date(year, month, day) -> Column:
    """Date from parts; a month or day past its end moves on into the next one."""
    january = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(january, month - 1), day - 1)


def strict_date(year, month, day) -> Column:
    """Date from parts, NULL when the calendar has no such day."""
    legal = month.between(1, 12) & day.between(1, 31) & (year >= 1)
    rolled = F.when(legal, rolled_date(year, month, day))
    return F.when(F.month(rolled) == month, rolled)


def serial_date(serial) -> Column:
    """Spreadsheet day number; fractions are times of day and fall away."""
    days = F.floor(F.round(_c(serial).cast("double") * 86400000) / 86400000).cast("int")
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days)


def _parts(text, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))


def training_date(raw, kind=None) -> Column:
    """Cell of a training sheet. ``kind`` is the cell kind; ``n`` marks a day serial."""
    text = clean(raw)
    flat = F.regexp_replace(F.regexp_replace(text, "[/.]", "-"), "T", " ")
    dashed, packed = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    parsed = (
        F.when(is_null_word(raw), F.lit(None).cast("date"))
        .when(flat.rlike(dashed), rolled_date(*_parts(flat, dashed)))
        .when(text.rlike(packed), rolled_date(*_parts(text, packed)))
    )
    if kind is None:
        return parsed
    return F.when(_c(kind) == "n", serial_date(text.try_cast("double"))).otherwise(parsed)


def lodging_date(raw) -> Column:
    """Cell of a lodging bill; the first format that fits wins, others are NULL."""
    text = clean(raw)
    packed = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    year_first = r"^([0-9]{2})/([0-9]{2})/([0-9]{2})$"
    month_first_time = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})\s+[0-9]{1,2}:[0-9]{2}"
    month_first = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$"
    long_form = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"

    def month_day_year(pattern):
        month, day, year = _parts(text, pattern)
        return rolled_date(year + 2000, month, day)

    y2, m2, d2 = _parts(text, year_first)
    number = text.try_cast("int")
    return (
        F.when(text.rlike(packed), strict_date(*_parts(text, packed)))
        .when(text.rlike("^[0-9]+$") & (number > 40000), F.date_add(F.lit("1970-01-01").cast("date"), number - 25569))
        .when(text.rlike(year_first), rolled_date(y2 + 2000, m2, d2))
        .when(text.rlike(month_first_time), month_day_year(month_first_time))
        .when(text.rlike(month_first), month_day_year(month_first))
        .when(text.rlike(long_form), rolled_date(*_parts(text, long_form)))
    )


def form_date(raw) -> Column:
    """Cell of a form: packed, separated or serial text, calendar checked."""
    text = clean(raw)
    flat = F.regexp_replace(text, "[./]", "-")
    packed, dashed = r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    number = text.try_cast("double")
    return (
        F.when(text.rlike(packed), strict_date(*_parts(text, packed)))
        .when(flat.rlike(dashed), strict_date(*_parts(flat, dashed)))
        .when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & (number > 0), serial_date(number))
    )


def format_form_date(date, pattern: str = "YYYY年MM月DD日") -> Column:
    """Fill ``YYYY``, ``MM`` and ``DD`` of a display pattern; NULL gives empty text."""
    col = _c(date)
    text = F.lit(pattern)
    for mark, fmt in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd")):
        text = F.regexp_replace(text, F.lit(mark), F.date_format(col, fmt))
    return F.coalesce(text, F.lit(""))


def query_date_text(raw, separator: str = "-") -> Column:
    """Year, month, day joined with zero padding; any other text is kept."""
    text = clean(raw)
    parts = F.split(text, "[-/]")
    padded = F.transform(parts, lambda x, i: F.when(i > 0, _pad2(x)).otherwise(x))
    return F.when(F.size(parts) == 3, F.array_join(padded, separator)).otherwise(text)


def _pad2(x) -> Column:
    return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)


def query_date(raw) -> Column:
    """The same text as a date, NULL when it is not one."""
    return F.try_to_date(query_date_text(raw, "-"), "yyyy-MM-dd")


def same_day_text(left, right) -> Column:
    """Equal after normalising the first ten characters of both."""
    def head(c):
        return query_date_text(F.substring(F.coalesce(_c(c).cast("string"), F.lit("")), 1, 10))

    return head(left) == head(right)


def month_key(date) -> Column:
    return F.date_format(_c(date), "yyyy-MM")


def month_bounds(key) -> Column:
    """Struct of the first and last day of a ``yyyy-MM`` key, NULL for other text."""
    first = F.try_to_date(F.concat(clean(key), F.lit("-01")), "yyyy-MM-dd")
    return F.struct(first.alias("start"), F.last_day(first).alias("end"))


def ranges_overlap(start_a, end_a, start_b, end_b) -> Column:
    """Closed ranges share a day; a missing bound means no."""
    return F.coalesce((_c(start_a) <= _c(end_b)) & (_c(start_b) <= _c(end_a)), F.lit(False))


def date_text(date) -> Column:
    return F.coalesce(F.date_format(_c(date), "yyyy-MM-dd"), F.lit(""))
