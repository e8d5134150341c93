"""Config-driven row validation: the field table becomes Columns, the data stays put.

A field configuration is what one person typed for one form, so it is read once on the
driver as a list of ``Field`` and every rule turns into an expression. Validation is then
one projection over the data, without a join and without Python in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.dates import form_date, format_form_date
from rosterops.functions.text import clean, safe_name, split_options, yes_no
from rosterops.operators.skew import running_sum

# Words of a yes/no field and the two mark characters.
YES_WORDS, NO_WORDS = ["是", "true", "1", "yes", "y"], ["否", "false", "0", "no", "n"]
MARK, BLANK = "☑", "□"


@dataclass(frozen=True)
class Field:
    """One configured field."""

    name: str
    kind: str
    label: str = ""
    required: bool = False
    default: str = ""
    options: list[str] = field(default_factory=list)
    date_format: str = "YYYY年MM月DD日"

    @property
    def shown(self) -> str:
        return self.label or self.name


def raw_value(f: Field, columns: list[str]) -> Column:
    """Cell of a field under its label, its name or its placeholder, in that order."""
    for candidate in (f.label, f.name, "{" + f.name + "}"):
        if candidate and candidate in columns:
            return F.col(f"`{candidate}`").cast("string")
    return F.lit("")


def _value(f: Field, columns: list[str]) -> Column:
    return F.coalesce(F.nullif(clean(raw_value(f, columns)), F.lit("")), F.lit(f.default.strip()))


def _parsed(f: Field) -> dict[str, Column]:
    """Columns computed once per field and used by its errors and its outputs."""
    value = F.col(f"_v_{f.name}")
    if f.kind == "date":
        return {f"_p_{f.name}": form_date(value)}
    if f.kind == "boolean":
        return {f"_p_{f.name}": yes_no(value, YES_WORDS, NO_WORDS)}
    if f.kind == "checkbox":
        return {f"_p_{f.name}": split_options(value)}
    return {}


def _errors(f: Field) -> list[Column]:
    value, parsed = F.col(f"_v_{f.name}"), F.col(f"_p_{f.name}")
    found = []
    if f.required:
        found.append(F.when(value == "", f"{f.shown}不能为空"))
    if f.kind == "date":
        found.append(F.when((value != "") & parsed.isNull(), f"{f.shown}不是有效日期"))
    if f.kind == "boolean":
        found.append(F.when(~parsed["valid"], f"{f.shown}只能填写 是/否"))
    if f.kind == "radio" and f.options:
        found.append(F.when((value != "") & ~value.isin(f.options), F.concat(F.lit(f"{f.shown}选项无效："), value)))
    if f.kind == "checkbox" and f.options:
        odd = F.filter(parsed, lambda x: ~x.isin(f.options))
        found.append(F.when(F.size(odd) > 0, F.concat(F.lit(f"{f.shown}包含无效选项："), F.array_join(odd, "、"))))
    return found


def _outputs(f: Field) -> list[Column]:
    """Display value and one-hot marks of a field."""
    value, parsed = F.col(f"_v_{f.name}"), F.col(f"_p_{f.name}")

    def mark(test, name):
        return F.when(test, MARK).otherwise(BLANK).alias(name)

    if f.kind == "date":
        return [format_form_date(parsed, f.date_format).alias(f.name)]
    if f.kind == "boolean":
        yes = F.coalesce(parsed["value"], F.lit(False))
        return [F.when(yes, "是").otherwise("否").alias(f.name), mark(yes, f"{f.name}Pass"), mark(~yes, f"{f.name}Fail")]
    if f.kind == "radio":
        return [value.alias(f.name), *(mark(value == o, f"{f.name}_{o}") for o in f.options)]
    if f.kind == "checkbox":
        return [F.array_join(parsed, "、").alias(f.name), *(mark(F.array_contains(parsed, o), f"{f.name}_{o}") for o in f.options)]
    return [value.alias(f.name)]


def non_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one filled cell."""
    filled = F.lit(False)
    for c in columns:
        filled = filled | (clean(F.col(f"`{c}`")) != "")
    return rows.filter(filled)


def validate_rows(rows: DataFrame, fields: list[Field], title_column: str, base_title: str, position: str = "position") -> DataFrame:
    """Validated rows: position, row_no, title, one column set per field, errors.

    ``position`` is the 1-based rank among the non-blank rows of a form sheet; it names
    untitled rows.
    """
    valued = rows.withColumns({f"_v_{f.name}": _value(f, rows.columns) for f in fields})
    parsed = valued.withColumns({n: c for f in fields for n, c in _parsed(f).items()})
    errors = F.array_compact(F.array(*(e for f in fields for e in _errors(f)), F.lit(None).cast("string")))
    outputs = [c for f in fields for c in _outputs(f)]
    given = safe_name(F.col(f"`{title_column}`")) if title_column in rows.columns else F.lit("")
    number = F.col(position).cast("string")
    fallback = F.concat(F.lit(f"{base_title}_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    return parsed.select(position, "row_no", F.coalesce(F.nullif(given, F.lit("")), fallback).alias("title"), *outputs, errors.alias("errors"))


def gate(validated: DataFrame) -> DataFrame:
    """All or nothing: one row that says whether the batch may go out."""
    return validated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") > 0).alias("failed")).withColumn(
        "open", (F.col("total") > 0) & (F.col("failed") == 0))


def manifest(validated: DataFrame, extension: str = ".docx") -> DataFrame:
    """Unique output name and state per row of the batch."""
    bad = F.size("errors") > 0
    return unique_names(validated, "title", "row_no").select(
        "row_no", F.concat("unique_name", F.lit(extension)).alias("file_name"),
        F.when(bad, "失败").otherwise("成功").alias("state"), F.array_join("errors", "；").alias("note"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``x``, ``x_2``, ``x_3`` in row order; a literal ``x_2`` that is taken moves on.

    Names can only collide inside one family: a stem and its ``_<number>`` variants.
    Families without a collision are numbered by rank. Only families where a numbered
    name meets a literal one are replayed in order.
    """
    ranked = running_sum(rows, [name], order, F.lit(1), "_k")
    taken = rows.select(F.col(name).alias("_lit")).distinct()
    plain = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_k").cast("string")))
    tried = ranked.withColumn("_try", plain)
    clash = tried.filter(F.col("_k") > 1).join(taken, F.col("_try") == F.col("_lit"), "left_semi")
    stem = F.regexp_replace(F.col(name), r"(?:_[0-9]+)+$", "")
    families = clash.select(stem.alias("_stem")).distinct()
    marked = tried.withColumn("_stem", stem)
    calm = marked.join(families, "_stem", "left_anti").withColumn("unique_name", F.col("_try"))
    busy = marked.join(families, "_stem", "left_semi")
    replayed = _replay_families(busy.select("_stem", F.col(order).alias("_o"), F.col(name).alias("_lit")))
    settled = busy.join(replayed, [busy["_stem"] == replayed["f_stem"], busy[order] == replayed["f_o"]]).drop("f_stem", "f_o")
    cut = [*rows.columns, "unique_name"]
    return calm.select(*cut).unionByName(settled.select(*cut))


def _replay_families(busy: DataFrame) -> DataFrame:
    """Greedy naming inside families that hold literal variants.

    Names in a family wait for each other, so the replay is ordered. It streams through
    the sorted partition and keeps the used names of the current family only.
    """
    ordered = busy.repartition("_stem").sortWithinPartitions("_stem", "_o")

    def replay(batches):
        import pandas as pd

        stem, used, following = None, set(), {}
        for batch in batches:
            out = []
            for s, o, literal in zip(batch["_stem"], batch["_o"], batch["_lit"]):
                if s != stem:
                    stem, used, following = s, set(), {}
                name, n = literal, following.get(literal, 2)
                while name in used:
                    name, n = f"{literal}_{n}", n + 1
                following[literal] = n
                used.add(name)
                out.append((s, o, name))
            yield pd.DataFrame(out, columns=["f_stem", "f_o", "unique_name"])

    return ordered.mapInPandas(replay, "f_stem string, f_o long, unique_name string")
