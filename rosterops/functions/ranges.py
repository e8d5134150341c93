"""Page ranges and dotted sequences as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterops.functions.text import _c, bind, clean


def parse_pages(text, max_page, swap_reversed: bool = False) -> Column:
    """``1-3,7`` as sorted distinct pages inside ``1..max_page``.

    A reversed span such as ``5-3`` is dropped, or read as ``3-5`` with ``swap_reversed``.
    """
    top = _c(max_page).cast("int")

    def expand(part):
        ends = F.split(part, "-")
        number = lambda i: F.regexp_extract(F.get(ends, F.lit(i)), r"^\s*([0-9]+)", 1).try_cast("int")
        read = F.struct(F.contains(part, F.lit("-")).alias("span"), number(0).alias("first"), number(1).alias("last"))
        return bind(read, pages)

    def pages(read):
        is_span, first, last = read["span"], read["first"], read["last"]
        low = F.least(first, last) if swap_reversed else first
        high = F.greatest(first, last) if swap_reversed else last
        low, high = F.greatest(low, F.lit(1)), F.least(high, top)
        span_ok = first.isNotNull() & last.isNotNull() & (low <= high)
        single_ok = (first >= 1) & (first <= top)
        nothing = F.array().cast("array<int>")
        return F.when(is_span, F.when(span_ok, F.sequence(low, high)).otherwise(nothing)).otherwise(
            F.when(single_ok, F.array(first)).otherwise(nothing)
        )

    parts = F.transform(F.split(clean(text), ","), clean)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def format_pages(pages) -> Column:
    """Sorted distinct pages as run text: ``[1,2,3,7]`` gives ``1-3,7``."""
    def runs(p):
        starts = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
        ends = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
        return F.array_join(F.zip_with(
            starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ",")

    return bind(F.array_sort(F.array_distinct(_c(pages))), runs)


def dotted_sequence(text, keep_padding: bool = False) -> Column:
    """``1.1-1.4`` as its members; NULL when the majors differ or the span is reversed."""
    pattern = r"^\s*([0-9]+)\.([0-9]+)\s*-\s*([0-9]+)\.([0-9]+)\s*$"
    part = lambda i: F.regexp_extract(_c(text), pattern, i)
    parts = F.struct(part(1).alias("major"), part(3).alias("other"), part(2).alias("low"), part(4).alias("high"))

    def members(p):
        low, high = p["low"].try_cast("int"), p["high"].try_cast("int")
        padded = p["low"].rlike("^0[0-9]+") | p["high"].rlike("^0[0-9]+")
        shape = F.struct(F.greatest(F.length(p["low"]), F.length(p["high"])).alias("width"), padded.alias("padded"))

        def expand(s):
            def member(n):
                plain = n.cast("string")
                shown = F.when(s["padded"], F.lpad(plain, s["width"], F.lit("0"))).otherwise(plain) if keep_padding else plain
                return F.concat_ws(".", p["major"], shown)

            return F.transform(F.sequence(low, high), member)

        return F.when((p["major"] == p["other"]) & (low <= high), bind(shape, expand))

    return bind(parts, members)
