"""Benchmark tables seen as roster, training, bill, document and form inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Training project per order priority.
PROJECT_OF = {"1-URGENT": "应急训练", "2-HIGH": "危险品", "3-MEDIUM": "航空安保", "4-NOT SPECIFIED": "TSA", "5-LOW": "英语能力"}
TECH = ["飞行教员A", "飞行教员B", "飞行教员C", "A类机长", "B类机长", "C类机长", "D类机长", "Z类机长", "划转机长", "A1类副驾驶",
        "A2类副驾驶", "B类副驾驶", "C类副驾驶", "D类副驾驶", "划转副驾驶", "签派员"]
ORIGINS = ["总队777", "777返聘", "总队737", "总队320", "总队909", "湖南分公司", "湖北分公司", "新疆分公司", "新疆分公司（借）", "河南分公司",
           "西安分公司", "重庆航空", "汕头分公司", "珠海分公司", "广西分公司", "海南分公司", "上海分公司（借）", "外部单位", "", "总队999"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_of(priority: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, project in PROJECT_OF.items():
        out = F.when(priority == word, project).otherwise(out)
    return out


def customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def nth(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as training records; a dear order lost its employee ID, a cheap one was cancelled."""
    o = table(spark, sf_dir, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    start = F.col("o_orderdate").cast("date")
    return o.select(
        project_of(F.col("o_orderpriority")).alias("project"),
        F.when(price > 480000, "").otherwise(F.col("o_custkey").cast("string")).alias("employee_id"),
        customer_name(F.col("o_custkey")).alias("name"), start.alias("start_date"),
        F.date_add(start, (F.col("o_orderkey") % 3).cast("int")).alias("end_date"),
        F.when(status == "F", "是").otherwise("否").alias("recorded"), F.when(status.isin("F", "P"), "Y").otherwise("").alias("machine_flag"),
        F.when(price < 20000, "临时取消").otherwise("").alias("remark"), project_of(F.col("o_orderpriority")).alias("sheet"),
        F.col("o_orderkey").alias("row_no"), F.concat(F.lit("教员"), (F.col("o_custkey") % 7).cast("string")).alias("instructor"))


def shipments_as_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as planned training days of the ordering customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_discount")
    day = F.col("l_shipdate").cast("date")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        project_of(F.col("o_orderpriority")).alias("project"), F.col("o_custkey").cast("string").alias("employee_id"),
        customer_name(F.col("o_custkey")).alias("name"), day.alias("start_date"), day.alias("end_date"),
        F.when(F.col("l_linestatus") == "F", "是").otherwise("否").alias("recorded"), F.lit("").alias("machine_flag"),
        F.when(F.col("l_discount") > 0.095, "取消").otherwise("").alias("remark"), project_of(F.col("o_orderpriority")).alias("sheet"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("employee_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("row_no"),
                    F.concat(F.lit("技术："), nth(TECH, F.col("c_nationkey") % 16)).alias("tech"))


def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order per customer and project plus two years, as the cell text of the people sheet.

    A customer in debt has an unreadable cell, a very rich one an empty mark.
    """
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey", project_of(F.col("o_orderpriority")).alias("project")).agg(F.max("o_orderdate").cast("date").alias("d"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    cell = F.when(F.col("c_acctbal") < 0, "待定").when(F.col("c_acctbal") > 9500, "/").otherwise(F.date_format(F.add_months("d", 24), "yyyy.M.d"))
    return last.join(c, last["o_custkey"] == c["c_custkey"]).select(
        "project", F.col("c_custkey").cast("string").alias("employee_id"), F.col("c_name").alias("name"), cell.alias("raw_expiry"),
        F.col("c_custkey").alias("row_no"))


def personnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as crew members with technical label, origin and qualification flags."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    return li.select(
        c("l_orderkey").cast("string").alias("employee_id"), F.concat(F.lit("P"), c("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("技术信息："), nth(TECH, c("l_suppkey") % 16)).alias("tech"), nth(ORIGINS, c("l_partkey") % 20).alias("origin"),
        F.when(c("l_quantity") > 45, "公司检查员").otherwise("").alias("inspector_qualification"),
        F.when(c("l_quantity") < 5, "经理").otherwise("").alias("management_role"),
        (c("l_returnflag") == "R").alias("RAMA"), (c("l_linestatus") == "O").alias("REUO"), (c("l_discount") > 0.045).alias("RWAS"),
        (c("l_tax") > 0.035).alias("EAMA"), (c("l_quantity") > 25).alias("EEUO"), (c("l_extendedprice") > 50000).alias("EWAS"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_name"), "text", "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as pages: one conversation is one document."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role", "text")


def lines_of(documents: DataFrame) -> DataFrame:
    """Document lines, numbered from 1."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), "text")
