"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become whole numbers. Candidates are packed into chunks and turned into postings: per
component, the rows with a weight other than zero. A block of query rows is scored against one
chunk component by component, each weighted posting scattered into a dense array of scores; a
partition selection keeps each query's k best of the chunk, and the chunks' lists are merged.

A row's hash names its chunk or block, so a task that runs again after a lost executor makes the
same ones. Blocks are the small side and travel: each goes to every chunk by a join on the chunk's
number, while a chunk is sent once and meets its blocks one after another. Whole numbers are stored
in as few bytes as they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import pick, table_rows

K = 20
SCALE = 64
CHUNK, BLOCK = 16_384, 256  # candidates of a chunk, queries of a block, on average at most
STRIP = 64  # queries scored at a time


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: each component as ``floor(scale * x)``.

    Rows with a null id, a null vector or a null or non-finite component are left out.
    """
    rows = pick(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long"), F.transform("v", lambda x: F.floor(scale * x)).cast("array<bigint>").alias("v"))


def packed(rows: DataFrame, most: int, number: str) -> tuple[DataFrame, int]:
    """Distinct rows dealt out by hash and packed: ``number, ids, width, kind, matrix``, and how many
    numbers there are, so that a number has ``most`` rows on average at most.

    A shorter vector is filled with zeros, which leaves its products as they are."""
    parts = max(1, -(-rows.count() // most))
    schema = pa.schema([(number, pa.int64()), ("ids", pa.binary()), ("width", pa.int64()), ("kind", pa.string()), ("matrix", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, block in groupby(table_rows(batches), key=lambda row: row[0]):
            _, ids, vectors = zip(*block, strict=True)
            matrix = np.zeros((len(ids), max(1, *map(len, vectors))), "<i8")
            for row, v in zip(matrix, vectors, strict=True):
                row[: len(v)] = v
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.array_equal(matrix.astype(k), matrix))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (at, np.array(ids, "<i8").tobytes(), matrix.shape[1], kind, matrix.astype(kind).tobytes())], schema=schema)

    dealt = rows.distinct().select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("long").alias(number), "vec_id", "v")
    sorted_rows = dealt.repartition(number).sortWithinPartitions(number)
    return sorted_rows.mapInArrow(pack, f"{number} long, ids binary, width long, kind string, matrix binary"), parts


def largest_of(matrix: np.ndarray) -> int:
    """Largest absolute value; the least number of a type has none in the type itself."""
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def scores_of(queries: np.ndarray, chunk: np.ndarray) -> Iterator[np.ndarray]:
    """Dense score arrays of strips of queries against all rows of a chunk."""
    width = min(queries.shape[1], chunk.shape[1])
    largest = largest_of(queries) * largest_of(chunk) * width
    if largest >= 1 << 62:
        raise OverflowError("inner products exceed 64 bits")
    kind = np.int32 if largest < 1 << 31 else np.int64
    postings = []
    for term in range(width):
        rows = np.flatnonzero(chunk[:, term])
        weights = chunk[rows, term].astype(kind)
        postings.append((slice(None) if len(rows) == len(chunk) else rows, weights))
    for first in range(0, len(queries), STRIP):
        strip = queries[first : first + STRIP, :width].astype(kind)
        scores = np.zeros((len(strip), len(chunk)), kind)
        for term in range(width):
            rows, weights = postings[term]
            for query in np.flatnonzero(strip[:, term]):
                scores[query, rows] += strip[query, term] * weights
        yield scores


def best_rows(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores but for ``own``, ties to smaller ids."""
    able = np.flatnonzero(ids != own)
    if len(able) > k:
        worst = np.partition(scores[able], len(able) - k)[len(able) - k]
        able = able[scores[able] >= worst]
    return able[np.lexsort((ids[able], -scores[able].astype(np.int64)))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors`` (from ``quantised``) that
    ``is_query`` holds for, against all rows with another id.

    Ties go to the smaller id. Rows that repeat an id and vector count once; an id with several
    vectors is several candidates and its queries' lists are merged. Fewer than k candidates
    give fewer rows; an empty table gives none.
    """
    candidates, chunks = packed(vectors, chunk, "chunk")
    queries, _ = packed(vectors.filter(is_query), block, "block")
    blocks = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "kind", "matrix")])
    sent = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    # The chunk is the buffered side of the merge: a task holds one chunk and one block at a time.
    pairs = sent.hint("merge").join(candidates, "chunk")
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, width, kind, matrix, q_ids, q_width, q_kind, q in table_rows(b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            ids, asked = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
            strips = scores_of(np.frombuffer(q, q_kind).reshape(-1, q_width), np.frombuffer(matrix, kind).reshape(-1, width))
            rows = (row for strip in strips for row in strip)
            found = [(own, best, row[best]) for own, row in zip(asked, rows, strict=True) for best in [best_rows(row, ids, own, k)]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([own for own, _, _ in found], [len(best) for _, best, _ in found])),
                pa.array(np.concatenate([ids[best] for _, best, _ in found])),
                pa.array(np.concatenate([some for _, _, some in found]).astype(np.int64)),
            ], schema=schema)

    lists = pairs.select("ids", "width", "kind", "matrix", "q_ids", "q_width", "q_kind", "q_matrix").mapInArrow(score, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
