"""Package manifests, evidence tables and field configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterops.functions.text import clean


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder as ``(path, size, sha256)``; content never leaves the task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per declared path; files nobody declared do not appear.

    ``manifest`` and ``files``: path, size, sha256.
    """
    have = files.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = manifest.join(have, "path", "left")
    reason = (
        F.when(F.col("_size").isNull(), "项目包缺少文件")
        .when((F.col("_size") != F.col("size")) | (F.col("_sha") != F.col("sha256")), "项目文件校验失败")
    )
    return joined.select("path", "size", "sha256", reason.alias("reason"))


def import_evidence(items: DataFrame, manual: DataFrame, audit: DataFrame) -> DataFrame:
    """Check items with their two evidence lists.

    ``items``: row_no, item_seq, code, name, keyword, enabled. ``manual``: item_seq,
    row_no, document_name, text. ``audit``: item_seq, row_no, content, note. Items are
    ordered by sequence, then row; an item without sequence takes its place in that order
    through ``position_items``. Evidence of one item is what an auditor collected by hand.
    """
    kept = items.filter((clean("code") != "") | (clean("name") != "") | (clean("keyword") != ""))
    placed = position_items(kept)
    found = manual.filter((clean("document_name") != "") & (clean("text") != ""))
    basis = audit.filter((clean("content") != "") | (clean("note") != ""))
    m = found.groupBy("item_seq").agg(F.array_sort(F.collect_list(F.struct("row_no", "document_name", "text"))).alias("manual"))
    a = basis.groupBy("item_seq").agg(F.array_sort(F.collect_list(F.struct("row_no", "content", "note"))).alias("audit"))
    position = F.col("position").cast("long")
    return placed.join(m.withColumnRenamed("item_seq", "_m"), position == F.col("_m"), "left").join(
        a.withColumnRenamed("item_seq", "_a"), position == F.col("_a"), "left").select(
        "position", "code", "name", "keyword", is_enabled("enabled").alias("enabled"), "row_no",
        F.coalesce("manual", F.array().cast("array<struct<row_no:bigint,document_name:string,text:string>>")).alias("manual"),
        F.coalesce("audit", F.array().cast("array<struct<row_no:bigint,content:string,note:string>>")).alias("audit"))


def position_items(items: DataFrame) -> DataFrame:
    """Sequence of an item; one without takes its rank: numbered items, then by row."""
    numbered = items.filter(F.col("item_seq").isNotNull())
    count = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    bare = items.filter(F.col("item_seq").isNull()).select("row_no")
    ranks = dense_position(bare, "row_no").select("row_no", (F.col("position") + count).alias("_p"))
    return items.join(ranks, "row_no", "left").withColumn("position", F.coalesce("item_seq", "_p")).drop("_p")


def dense_position(rows: DataFrame, order: str, span: int = 4096) -> DataFrame:
    """1-based rank over distinct ``order`` values by two-level counting."""
    from rosterops.operators.skew import running_sum

    return running_sum(rows.withColumn("_g", F.lit(0)), ["_g"], order, F.lit(1), "position", span).drop("_g")


def is_enabled(flag) -> Column:
    return ~F.lower(clean(flag)).isin("否", "停用", "false", "0")


# Column synonyms and type synonyms of a field configuration.
FIELD_SYNONYMS = {
    "name": ["字段名", "name", "字段"], "label": ["显示名称", "label", "名称", "标签"], "type": ["类型", "type"],
    "options": ["选项", "options"], "default_value": ["默认值", "default"], "required": ["必填", "required"],
    "placeholder": ["提示", "placeholder"], "format": ["格式", "format"], "sub_sheet": ["子表", "subSheet"],
    "rows": ["行数", "rows"],
}
TYPE_SYNONYMS = {
    "文本": "text", "单行文本": "text", "多行文本": "textarea", "文本域": "textarea", "日期": "date", "是否": "boolean",
    "布尔": "boolean", "单选": "radio", "多选": "checkbox", "列表": "loop", "循环": "loop", "表格": "loop",
}


def field_type(raw) -> Column:
    text = clean(raw)
    pairs = [F.lit(x) for item in TYPE_SYNONYMS.items() for x in item]
    plain = F.coalesce(F.nullif(F.lower(text), F.lit("")), F.lit("text"))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), plain)


def parse_fields(config: DataFrame) -> DataFrame:
    """Field table out of a configuration sheet with either language's headers."""
    def pick(key, default=""):
        present = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in FIELD_SYNONYMS[key] if c in config.columns]
        return clean(F.coalesce(*present, F.lit(default)))

    carried = [c for c in ("sheet", "row_no") if c in config.columns]
    shaped = config.select(
        *carried, pick("name").alias("name"), F.coalesce(F.nullif(pick("label"), F.lit("")), pick("name")).alias("label"),
        field_type(pick("type", "text")).alias("type"), pick("options").alias("options"),
        pick("default_value").alias("default_value"), pick("required").isin("是", "true").alias("required"),
        pick("placeholder").alias("placeholder"), pick("format").alias("format"), pick("sub_sheet").alias("sub_sheet"),
        F.coalesce(F.nullif(pick("rows").try_cast("int"), F.lit(0)), F.lit(3)).alias("rows"))
    return shaped.filter(F.col("name") != "")


def loop_fields(fields: DataFrame, sub_fields: DataFrame) -> DataFrame:
    """Sub-fields of loop fields; a loop without a named sheet uses its own name."""
    loops = fields.filter(F.col("type") == "loop").select(
        F.col("name").alias("loop"), F.coalesce(F.nullif("sub_sheet", F.lit("")), F.col("name")).alias("_sheet"))
    return loops.join(sub_fields.withColumnRenamed("sheet", "_sheet"), "_sheet").drop("_sheet")
