"""Report sinks: one partition per report section, written by the tasks that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sections(sections: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each named section under ``path/section=<name>``."""
    for name, frame in sections.items():
        writer = frame.write.mode("overwrite")
        target = f"{path}/section={name}"
        if fmt == "csv":
            writer.option("header", "true").csv(target)
        else:
            writer.parquet(target)


def long_report(sections: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Sections of one shape as a single long table, ready to partition by section."""
    out = None
    for name, frame in sections.items():
        part = frame.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("item"),
                            F.col(value).cast("long").alias("amount"))
        out = part if out is None else out.unionByName(part)
    return out


def write_long_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("section").parquet(path)


def read_long_report(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """A written long report; of one section only its folder is read."""
    report = spark.read.schema("item string, amount long, section string").parquet(path)
    return (report if section is None else report.filter(F.col("section") == section)).select("section", "item", "amount")


def write_text_files(lines: DataFrame, key: str, order: str, line: str, path: str) -> None:
    """One text file per ``key`` under ``path/key=<value>``, its lines in the order of ``order``."""
    placed = lines.select(key, order, line).repartition(key).sortWithinPartitions(key, order)
    placed.select(key, line).write.mode("overwrite").partitionBy(key).text(path)
