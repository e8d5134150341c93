"""Token ids in files of wavelet matrices.

A shard is one compressed file with the documents of one range of ``doc_id``. Its rows are
blocks of about ``BLOCK`` ids, a document never split, each a wavelet matrix: bit-planes from
the highest bit down, every plane ordered by a stable split on the planes before, with the
number of ones before every ``STEP`` bits beside it. One block answers ``access`` (the id at a
place), ``rank`` (how often an id occurs before a place) and ``select`` (where it occurs the
k-th time) without its text or a plain copy of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, offsets_of, size_blocks, table_rows, texts_of
from rosterops.llm.tokens import encoder, with_end

BLOCK = 1 << 20
STEP = 512
BATCH_CHARS = 10 << 20  # characters encoded at a time
FORMAT = "shard int, block int, before long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Planes of one block, with access, rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.packed, self.ranks = n, zeros, planes, [np.frombuffer(r, "<u4") for r in ranks]
        self.bytes = [np.frombuffer(plane, np.uint8) for plane in planes]

    @staticmethod
    def build(ids: np.ndarray, depth: int) -> "WaveletMatrix":
        zeros, planes, ranks = [], [], []
        for level in reversed(range(depth)):
            bits = (ids & ids.dtype.type(1 << level)).astype(bool)
            plane = np.packbits(bits, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), STEP // 8), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
            planes.append(plane.tobytes())
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            zeros.append(int(len(bits) - ones.sum()))
            split = np.empty_like(ids)
            np.compress(~bits, ids, out=split[: zeros[-1]])
            np.compress(bits, ids, out=split[zeros[-1] :])
            ids = split
        return WaveletMatrix(len(ids), zeros, planes, ranks)

    def all(self) -> np.ndarray:
        """Every id in order: the splits undone from the lowest plane up."""
        kind = np.uint16 if len(self.packed) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(reversed(self.bytes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[~bits] = ids[:zeros]
            above[bits] = ids[zeros:] | kind(1 << level)
            ids = above
        return ids

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        step = place // STEP
        if step >= len(self.ranks[level]):
            return self.n - self.zeros[level]
        part = self.bytes[level][step * STEP // 8 : (place + 7) // 8]
        return int(self.ranks[level][step]) + int(np.unpackbits(part, bitorder="little")[: place - step * STEP].sum())

    def access(self, place: int) -> int:
        value = 0
        for level in range(len(self.packed)):
            bit = int(self.bytes[level][place // 8]) >> (place % 8) & 1
            ones = self._ones(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            value = 2 * value + bit
        return value

    def _range(self, value: int, place: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``place`` lie below the lowest plane."""
        low, high, depth = 0, place, len(self.packed)
        for level in range(depth):
            a, b = self._ones(level, low), self._ones(level, high)
            if value >> (depth - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, place: int | None = None) -> int:
        """Occurrences of ``value`` before ``place`` (default: all)."""
        if value >> len(self.packed):
            return 0
        low, high = self._range(value, self.n if place is None else place)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of ``value``, from 0."""
        place, depth = self._range(value, self.n)[0] + k, len(self.packed)
        for level in reversed(range(depth)):
            bit = value >> (depth - 1 - level) & 1
            place = self._find(level, bit, place - self.zeros[level] if bit else place)
        return place

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of that kind in a plane."""
        before = self.ranks[level].astype(np.int64)
        counts = before if bit else np.arange(len(before)) * STEP - before
        step = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.bytes[level][step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")[: self.n - step * STEP]
        return step * STEP + int(np.flatnonzero(bits == bit)[k - int(counts[step])])


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them under ``folder``, ascending by ``doc_id``.

    Null ids come first; rows of one id stand in the order of their texts' hash. A null or
    empty text is the end id alone. The range shuffle splits even one id's rows, and a worker
    holds one block at a time, or one document if that is longer.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    layout = FORMAT.format(kind=kind)
    schema = arrow_of(texts.sparkSession.createDataFrame([], layout))
    ordered = texts.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before, tool = TaskContext.get().partitionId(), 0, encoder(path)
        depth = max(1, max(tool.size - 1, end_id).bit_length())
        kind = np.uint16 if depth <= 16 else np.uint32

        def encoded() -> Iterator[tuple]:
            for some in size_blocks(table_rows(batches), lambda row: len(row[1]), BATCH_CHARS):
                yield from zip([doc_id for doc_id, _ in some], with_end(*tool.encode([text for _, text in some]), end_id), strict=True)

        for number, block in enumerate(size_blocks(encoded(), lambda row: len(row[1]), BLOCK)):
            ids = np.concatenate([ids for _, ids in block]).astype(kind)
            built = WaveletMatrix.build(ids, depth)
            lengths = [len(ids) for _, ids in block]
            yield batch_of(
                [(shard, number, before, len(ids), [d for d, _ in block], lengths, built.zeros, built.packed, [r.tobytes() for r in built.ranks])], schema
            )
            before += len(ids)

    # Rows are large: look at the size of a row group after each.
    ordered.drop("_h").mapInArrow(blocks, layout).write.option("compression", "zstd").option("parquet.block.size.row.check.min", 1).parquet(folder)


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(FORMAT.format(kind=kind)).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` per document, from the files alone. ``ids`` are
    little-endian unsigned 32-bit integers; ``start`` counts the ids of all documents before."""
    files = _files(spark, folder, kind)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    layout = f"shard int, doc_id {kind}, at long, n_tokens long, ids binary"
    schema = arrow_of(spark.createDataFrame([], layout))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, _, before, n, doc_ids, lengths, zeros, planes, ranks in table_rows(batch.slice(i, 1) for i in range(batch.num_rows)):
                ids, out, at = WaveletMatrix(n, zeros, planes, ranks).all().astype("<u4"), [], 0
                for doc_id, length in zip(doc_ids, lengths, strict=True):
                    out.append((shard, doc_id, before + at, length, ids[at : at + length].tobytes()))
                    at += length
                yield batch_of(out, schema)

    # One row of 16 bytes per file.
    base = F.broadcast(offsets_of(totals, "shard", "n", "base"))
    return files.mapInArrow(documents, layout).join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def count_token(spark: SparkSession, folder: str, token: int, kind: str = "bigint") -> DataFrame:
    """Occurrences of one id per shard, by rank alone: ``shard, n``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, n, zeros, planes, ranks in table_rows(batches):
            yield batch_of([(shard, WaveletMatrix(n, zeros, planes, ranks).rank(token))], pa.schema([("shard", pa.int32()), ("n", pa.int64())]))

    found = _files(spark, folder, kind).select("shard", "n_tokens", "zeros", "planes", "ranks").mapInArrow(counts, "shard int, n long")
    return found.groupBy("shard").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int, kind: str = "bigint") -> DataFrame:
    """Every place of one id, by select: ``doc_id, place`` (from 0 in its document)."""
    layout = f"doc_id {kind}, place long"
    schema = arrow_of(spark.createDataFrame([], layout))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, doc_ids, lengths, zeros, planes, ranks in table_rows(batches):
            matrix, starts = WaveletMatrix(n, zeros, planes, ranks), np.cumsum([0, *lengths])
            found = [matrix.select(token, k) for k in range(matrix.rank(token))]
            rows = np.searchsorted(starts, found, "right") - 1
            yield batch_of([(doc_ids[r], int(p - starts[r])) for r, p in zip(rows, found, strict=True)], schema)

    return _files(spark, folder, kind).select("n_tokens", "doc_ids", "lengths", "zeros", "planes", "ranks").mapInArrow(places, layout)
