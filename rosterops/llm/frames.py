"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(rows: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(docs, doc_id="doc_id", text="body")``.

    Columns are taken by place, so extra columns whose names differ in case only, hold dots
    or clash with an operator's own columns do no harm. An exact name goes before one that
    differs in case; the first of equal names is taken.
    """
    plain, places = by_place(rows, *columns.values())
    return plain.select(*[F.col(place).alias(out) for out, place in zip(columns, places, strict=True)])


def by_place(rows: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with columns named by their place, and the new names of the ``wanted`` ones.

    ``toDF(*rows.columns)`` gives the old names back.
    """
    names = rows.columns

    def place(name: str) -> str:
        exact = [i for i, n in enumerate(names) if n == name]
        loose = [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not exact + loose:
            raise ValueError(f"no column {name!r} among {names}")
        return f"c{(exact + loose)[0]}"

    return rows.toDF(*[f"c{i}" for i in range(len(names))]), [place(name) for name in wanted]


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty)."""
    return pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    A scratch folder stands in only in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as a table in the shared folder and read back: computed once, whatever
    executors are lost later, and read by column."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def size_blocks(rows: Iterable, weight, most: int) -> Iterator[list]:
    """Lists of consecutive rows, closed once their weights reach ``most``."""
    block, total = [], 0
    for row in rows:
        block.append(row)
        total += weight(row)
        if total >= most:
            yield block
            block, total = [], 0
    if block:
        yield block


def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time as texts take space twice."""
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            yield from zip(*(column.to_pylist() for column in batch.slice(first, 64).columns), strict=True)


def text_slices(batches: Iterator[pa.RecordBatch], place: int, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about ``chars`` bytes of text each, and their texts (null: empty)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy())
        starts = np.flatnonzero(np.diff(ends // chars, prepend=-1))
        for first, after in zip(starts, np.append(starts[1:], batch.num_rows)):
            part = batch.slice(first, after - first)
            yield part, pc.fill_null(part.column(place), "").to_pylist()


def annotate(docs: DataFrame, judge: Callable[[list[str]], list[tuple]], fields: str, text_col: str, chars: int) -> DataFrame:
    """``docs`` with columns that ``judge`` derives from batches of whole texts; the other
    columns pass through untouched. Null texts are judged as empty ones."""
    names = docs.columns
    plain, [text] = by_place(docs, text_col)
    place = plain.columns.index(text)
    plain = plain.withColumn(text, F.col(text).cast("string"))
    more = arrow_of(docs.sparkSession.createDataFrame([], fields))
    schema = pa.schema([*arrow_of(plain), *more])
    layout = T.StructType([*plain.schema, *docs.sparkSession.createDataFrame([], fields).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, place, chars):
            found = batch_of(judge(texts), more)
            yield pa.RecordBatch.from_arrays([*part.columns, *found.columns], schema=schema)
        give_back()

    return plain.mapInArrow(run, layout).toDF(*names, *more.names)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` but for the rows whose id and text hash are in ``gone`` (``doc_id, h``)."""
    plain, [doc_id, text] = by_place(docs, id_col, text_col)
    listed = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("gone_id")) & (text_hash(F.col(text)) == F.col("gone_h"))
    return plain.join(listed, same, "left_anti").toDF(*docs.columns)


def text_hash(text: Column) -> Column:
    """Tells apart texts of one id; null is as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def give_back() -> None:
    """Hands memory that a task has freed back to the system: a Python worker lives on after its
    task, and what it keeps is the next stage's loss."""
    pa.default_memory_pool().release_unused()
    trim = kept(("trim",), lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))  # glibc's only
    if trim is not None:
        trim(0)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_of(rows: DataFrame) -> pa.Schema:
    """Arrow schema of a DataFrame's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.schema)


def offsets_of(totals: DataFrame, key: str, n: str, out: str) -> DataFrame:
    """Second pass of the prefix sums: the sum of ``n`` over all smaller keys.

    ``totals`` has one row per partition, whatever the rows within.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(out))


def crc_of_id(id_col: Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(id_col.cast("string").cast("binary"))


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """One value per Python worker. Functions travel by value, so a variable of their module
    would be new in every task; the worker's ``sys`` stays."""
    store = vars(sys).setdefault("_rosterops_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def restored(kind: type, state: dict) -> Any:
    """An object from its broadcast variables. Classes travel with the task, not in broadcasts."""
    out = object.__new__(kind)
    vars(out).update(state)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the row each group starts at. The rows come sorted by their
    first ``keys`` columns, none of them null; a group may span batches, and is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seen = pa.Table.from_batches([*held[-1:], batch])
        seen = seen.slice(len(seen) - batch.num_rows - 1) if held else seen
        fresh = _changes(seen, keys)[1:] if held else _changes(seen, keys)
        last = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
        if fresh.any() and (held or last):
            done = pa.Table.from_batches([*held, batch.slice(0, last)])
            yield done, np.flatnonzero(_changes(done, keys))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        done = pa.Table.from_batches(held)
        yield done, np.flatnonzero(_changes(done, keys))


def _changes(table: pa.Table, keys: int) -> np.ndarray:
    """Rows whose key differs from that of the row before; the first one does."""
    fresh = np.zeros(len(table), bool)
    fresh[:1] = True
    for column in (table.column(k).combine_chunks() for k in range(keys)):
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy(zero_copy_only=False)
    return fresh
