"""From raw documents to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterops.llm import decontam, langid, packing, pii, simhash
from rosterops.llm.frames import new_folder, pick
from rosterops.llm.queries import language_model, table, vocabulary

COLUMNS = {name: name for name in ("doc_id", "text", "lang", "source", "n_chars")}

#: Rows that Spark hands to Python at a time: both sides hold a batch, and keep its room for later stages.
BATCH_ROWS, BATCH_CONF = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` in a session whose Arrow batches are small; smaller ones that the user has set stay."""
    @wraps(stage)
    def run_small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
            spark.conf.set(BATCH_CONF, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_small


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing label is filled in, others stay."""
    docs = pick(docs, **COLUMNS)
    judged = langid.identify(docs, language_model(docs)).filter(F.col("lang_pred") != langid.UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by the SimHash index, then exactly."""
    return simhash.keep_one(pick(docs, **COLUMNS))


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.remove_leaks(pick(docs, **COLUMNS), table(spark, sf_dir, "benchmark"))


@in_small_batches
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data put in general terms; ``n_chars`` counts the new text."""
    docs = pick(docs, **COLUMNS)
    clean = pii.sanitise(docs, pii.find(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts cut into sequences of at most 2048 ids; small batches, as earlier stages hold memory too."""
    return packing.pack(docs, vocabulary(), end_id=1, width=2048, batch_chars=1 << 20)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: Suffix automata, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
