"""Small fixed tables as JVM-side rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows of ``name type, ...`` columns, without a Python worker behind them."""
    fields = [part.split() for part in schema.split(",")]
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields))) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
