"""Workforce structure: conditional counts of several sections in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.functions.text import after_colon, clean
from rosterops.functions.tables import literal_table

# Header names and codes of the personnel sheet.
REQUIRED_HEADERS = [
    "姓名", "技术信息", "RAMA", "REUO", "RWAS", "EAMA", "EEUO", "EWAS", "原单位", "检查员资格", "行政职务",
]
QUALIFICATION_CODES = [
    "RAMA", "REUO", "RWAS", "RSEA", "EAMA", "EEUO", "EWAS", "ESEA", "RANC", "RORD", "RJFK", "RLAX", "RNLU",
]

# Original unit to report label; labels are listed in report order.
ORIGIN_LABELS = {
    "总队777": "飞行/总队 777", "777返聘": "飞行/总队 777", "总队737": "飞行/总队 737",
    "总队320": "飞行/总队 320", "总队909": "飞行/总队 909", "湖南分公司": "湖南", "湖北分公司": "湖北",
    "新疆分公司": "新疆", "新疆分公司（借）": "新疆", "河南分公司": "河南", "西安分公司": "西安",
    "重庆航空": "重庆", "汕头分公司": "汕头", "珠海分公司": "珠海", "广西分公司": "广西",
    "海南分公司": "海南", "上海分公司（借）": "上海",
}
UNKNOWN_ORIGIN, OTHER = "未识别", "其他"
ABROAD = ("美", "欧", "西亚")


@dataclass(frozen=True)
class Item:
    """One counted row of the report: section, label, who is counted, out of whom."""

    section: str
    label: str
    counted: Column
    base: Column


def label_of() -> Column:
    return after_colon("tech")


def has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def crew_flags(people: DataFrame) -> DataFrame:
    """Role predicates as boolean columns next to the technical label."""
    label = F.col("label")
    origin = clean("origin")
    teacher, transfer = has(label, "飞行教员"), has(label, "划转")
    flagged = people.withColumn("label", label_of()).withColumns({
        "teacher": teacher,
        "captain": has(label, "机长") & ~teacher & ~transfer,
        "first_officer": has(label, "副驾驶") & ~transfer,
        "transfer_captain": label == "划转机长",
        "transfer_first_officer": label == "划转副驾驶",
        "local": origin.startswith("总队") | (origin == "777返聘"),
        "inspector": clean("inspector_qualification").isin("公司检查员", "委任代表"),
        "manager": clean("management_role") != "",
    })
    return flagged.withColumns({
        "registered": F.col("teacher") | F.col("captain") | F.col("first_officer"),
        "captain_base": F.col("teacher") | F.col("captain"),
        "captain_all": F.col("teacher") | F.col("captain") | F.col("transfer_captain"),
        "first_officer_all": F.col("first_officer") | F.col("transfer_first_officer"),
        "crew": F.col("teacher") | F.col("captain") | F.col("transfer_captain")
        | F.col("first_officer") | F.col("transfer_first_officer"),
    }).withColumn(
        "line_captain",
        (F.col("teacher") | has(label, "A类机长") | has(label, "B类机长") | has(label, "C类机长"))
        & ~has(label, "Z类机长") & ~F.col("RAMA") & ~F.col("REUO") & ~F.col("RWAS"),
    )


def flag_combinations(section: str, base: Column, flags: list[Column], singles: list[str], none: str | None) -> list[Item]:
    """All combinations of three flags; ``none`` labels the empty one or leaves it out."""
    items = []
    for bits in ((1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)):
        on = [i for i, b in enumerate(bits) if b]
        label = none if not on else singles[on[0]] if len(on) == 1 else "+".join(ABROAD[i] for i in on)
        if label is None:
            continue
        test = base
        for flag, bit in zip(flags, bits):
            test = test & (flag if bit else ~flag)
        items.append(Item(section, label, test, base))
    return items


def closed_classes(section: str, base: Column, classes: list[tuple[str, Column]], residual: str = OTHER) -> list[Item]:
    """One item per class and a residual item for rows in none of them."""
    covered = F.lit(False)
    items = []
    for label, test in classes:
        items.append(Item(section, label, base & test, base))
        covered = covered | test
    return [*items, Item(section, residual, base & ~covered, base)]


def report_items() -> list[Item]:
    """Every counted row over persons, in report order; head counts of ground staff aside."""
    c, label = F.col, F.col("label")
    captains, line = c("captain_base"), "机长航线资格占比"
    abroad = [c("RAMA"), c("REUO"), c("RWAS")]
    radio = [c("EAMA"), c("EEUO"), c("EWAS")]
    anyone_abroad = abroad[0] | abroad[1] | abroad[2]
    # Report rows of the levels in report order, with their labels.
    levels = [("C类教员", "飞行教员C"), ("B类教员", "飞行教员B"), ("A类教员", "飞行教员A"),
              ("D类机长", "D类机长"), ("C类机长", "C类机长"), ("B类机长", "B类机长"), ("Z类机长", "Z类机长")]
    junior = [("D类副驾驶", label == "D类副驾驶"), ("C类副驾驶", label == "C类副驾驶"), ("B类副驾驶", label == "B类副驾驶"),
              ("A类副驾驶", label.isin("A1类副驾驶", "A2类副驾驶")), ("转机型副驾驶", c("transfer_first_officer"))]
    level_section, homes = "机长含以上各级别占比", "人员居住情况"
    radio_names = ["单美洲报务", "单欧洲报务", "单西亚报务"]
    items = [
        Item("飞行管理人员占比", "管理人员", c("crew") & c("manager"), c("crew")),
        Item("飞行管理人员占比", "非管理人员", c("crew") & ~c("manager"), c("crew")),
        Item("教员、机长、副驾驶占比", "教员", c("crew") & c("teacher"), c("crew")),
        Item("教员、机长、副驾驶占比", "机长", c("crew") & (c("captain") | c("transfer_captain")), c("crew")),
        Item("教员、机长、副驾驶占比", "副驾驶", c("crew") & c("first_officer_all"), c("crew")),
        Item(level_section, "检查员", c("captain_all") & c("inspector"), c("captain_all")),
        *closed_classes(level_section, c("captain_all"),
                        [*((name, label == word) for name, word in levels), ("在训机长", c("transfer_captain"))]),
        *flag_combinations(line, captains, abroad, ["仅北美带队", "仅欧洲带队", "仅西亚带队"], None),
        Item(line, "航线机长", captains & c("line_captain"), captains),
        Item(line, "左座带飞", captains & (label == "Z类机长"), captains),
        Item(line, OTHER, captains & ~(anyone_abroad | c("line_captain") | (label == "Z类机长")), captains),
        *flag_combinations("机长报务占比", captains, radio, radio_names, "无报务"),
        *closed_classes("副驾驶级别占比", c("first_officer_all"), junior),
        *flag_combinations("副驾驶报务占比", c("first_officer"), radio, radio_names, "无报务"),
        Item(homes, "机长本地居住", c("captain_all") & c("local"), c("captain_all")),
        Item(homes, "机长异地居住", c("captain_all") & ~c("local"), c("captain_all")),
        Item(homes, "副驾驶本地居住", c("first_officer_all") & c("local"), c("first_officer_all")),
        Item(homes, "副驾驶异地居住", c("first_officer_all") & ~c("local"), c("first_officer_all")),
    ]
    return items


def percent_text(count: Column, base: Column) -> Column:
    """Whole percent, half up; no base gives ``0%``."""
    value = F.round(100 * count / F.nullif(base, F.lit(0))).cast("int")
    return F.concat(F.coalesce(value, F.lit(0)).cast("string"), F.lit("%"))


TRAITS = ["label", *QUALIFICATION_CODES[:3], *QUALIFICATION_CODES[4:7], "teacher", "captain", "first_officer", "transfer_captain",
          "transfer_first_officer", "local", "inspector", "manager", "registered", "captain_base", "captain_all",
          "first_officer_all", "crew", "line_captain"]


def count_items(flagged: DataFrame, items: list[Item]) -> DataFrame:
    """All items in one pass: people are counted per combination of traits, which
    combines in the tasks, and the items are then sums over those few combinations.
    """
    combos = flagged.groupBy(*TRAITS).agg(F.count(F.lit(1)).alias("_n"))
    measures = []
    for i, item in enumerate(items):
        for name, test in ((f"n{i}", item.counted), (f"d{i}", item.base)):
            measures.append(F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0)).alias(name))
    one = combos.agg(*measures)
    rows = F.array(*(
        F.struct(F.lit(i).alias("ord"), F.lit(x.section).alias("section"), F.lit(x.label).alias("item"),
                 F.col(f"n{i}").alias("people"), F.col(f"d{i}").alias("base"))
        for i, x in enumerate(items)))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "percent", percent_text(F.col("people"), F.col("base")))


def structure_report(people: DataFrame, ground_staff: int) -> DataFrame:
    """The whole report; residual rows appear only when somebody is in them."""
    flagged = crew_flags(people)
    head = "总人数及空地人员占比"
    crew = Item(head, "空勤人员（已注册人员）", F.col("registered"), F.col("registered"))
    total = Item(head, "总人数", F.col("registered"), F.col("registered"))
    counted = count_items(flagged, [total, crew, *report_items()])
    staff = F.lit(ground_staff)
    in_head = F.col("section") == head
    shifted = counted.withColumns({
        "people": F.when(in_head & (F.col("item") == "总人数"), F.col("people") + staff).otherwise(F.col("people")),
        "base": F.when(in_head, F.col("base") + staff).otherwise(F.col("base")),
    })
    ground = shifted.filter(in_head & (F.col("item") == "总人数")).select(
        F.lit(-1).alias("ord"), F.lit(head).alias("section"), F.lit("地面人员").alias("item"), staff.cast("long").alias("people"), "base")
    rows = shifted.drop("percent").unionByName(ground)
    always = F.col("section").isin("机长航线资格占比")
    kept = rows.filter((F.col("item") != OTHER) | (F.col("people") > 0) | always)
    return kept.withColumn("percent", percent_text(F.col("people"), F.col("base")))


def residual_people(people: DataFrame) -> DataFrame:
    """Persons behind the residual rows, in long form."""
    flagged = crew_flags(people)
    residual = [i for i in report_items() if i.label == OTHER]
    sections = F.filter(F.array(*(F.when(i.counted, i.section) for i in residual)), lambda x: x.isNotNull())
    who = F.concat_ws(" ", F.nullif(clean("employee_id"), F.lit("")), F.nullif(clean("name"), F.lit("")))
    return flagged.select(F.explode(sections).alias("section"),
                          F.coalesce(F.nullif(who, F.lit("")), F.col("label")).alias("person"))


def origin_label(origin) -> Column:
    text = clean(origin)
    pairs = [F.lit(x) for item in ORIGIN_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.nullif(text, F.lit("")), F.lit(UNKNOWN_ORIGIN))


def origin_summary(people: DataFrame) -> DataFrame:
    """Crew per original unit: fixed labels with zeros, then one bucket for the rest."""
    labels = list(dict.fromkeys(ORIGIN_LABELS.values()))
    crew = crew_flags(people).filter("crew").withColumn("item", origin_label("origin"))
    counts = crew.groupBy("item").agg(F.count(F.lit(1)).alias("people"))
    total = counts.agg(F.coalesce(F.sum("people"), F.lit(0)).alias("t")).scalar()
    dim = literal_table(people.sparkSession, list(enumerate(labels)), "ord int, item string")
    known = F.broadcast(dim).join(counts, "item", "left").select("ord", "item", F.coalesce("people", F.lit(0)).alias("people"))
    rest = counts.filter(~F.col("item").isin(labels)).agg(F.sum("people").alias("people")).filter("people > 0").select(
        F.lit(len(labels)).alias("ord"), F.lit(OTHER).alias("item"), "people")
    return known.unionByName(rest).withColumn("base", total).withColumn("percent", percent_text(F.col("people"), F.col("base")))


def unrecognized(people: DataFrame) -> DataFrame:
    """Distinct technical texts and crew origins outside the known ones."""
    flagged = crew_flags(people)
    labels = list(dict.fromkeys(ORIGIN_LABELS.values()))
    tech = flagged.filter(~F.col("crew") & (clean("tech") != "")).select(F.lit("tech").alias("kind"), clean("tech").alias("value"))
    origin = flagged.filter(F.col("crew") & (clean("origin") != "") & ~origin_label("origin").isin(labels)).select(
        F.lit("origin").alias("kind"), clean("origin").alias("value"))
    return tech.unionByName(origin).distinct()


def parse_personnel(bound: DataFrame) -> DataFrame:
    """Personnel rows out of a bound sheet: texts, one boolean per code, blank rows dropped."""
    names = {"员工号": "employee_id", "姓名": "name", "技术信息": "tech", "原单位": "origin",
             "检查员资格": "inspector_qualification", "行政职务": "management_role"}
    have = set(bound.columns)
    texts = [(clean(h) if h in have else F.lit("")).alias(n) for h, n in names.items()]
    flags = [((clean(code) != "") if code in have else F.lit(False)).alias(code) for code in QUALIFICATION_CODES]
    rows = bound.select("row_no", *texts, *flags)
    return rows.filter((F.col("name") != "") | (F.col("tech") != "") | (F.col("employee_id") != ""))
