"""Packing: concatenate and cut.

All documents form one long row of ids, cut every ``width`` ids. Pass one encodes each
partition once, into a table that holds every document's ids and the number of ids before it
in its partition. Pass two turns the partitions' totals into global offsets by a prefix sum,
and each document is cut where its span of the long row meets a window border. No document
moves to another machine: a piece is a boundary record of its window, and a window that
spans two partitions simply gets pieces from both.

Only the last sequence can be short, so padding stays under one sequence for all input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, give_back, offsets_of, size_blocks, stored, table_rows, texts_of
from rosterops.llm.tokens import encoder, with_end

WIDTH = 2048
BATCH_CHARS = 6 << 20  # characters encoded at a time


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Pass one: ``part, before, doc_id, n, ids`` per document, ``ids`` as 32-bit integers.

    The row order inside a partition is that of the scan. The table is written, so that
    later passes see one order even if an executor is lost.
    """
    texts = texts_of(docs, id_col, text_col)
    empty = texts.sparkSession.createDataFrame([], "part int, before long, doc_id string, n long, ids binary")
    schema = arrow_of(empty.withColumn("doc_id", F.lit(None).cast(texts.schema["doc_id"].dataType)))
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, tool = TaskContext.get().partitionId(), 0, encoder(path)
        for block in size_blocks(table_rows(batches), lambda row: len(row[1]), batch_chars):
            out = []
            for (doc_id, _), ids in zip(block, with_end(*tool.encode([text for _, text in block]), end_id), strict=True):
                out.append((part, before, doc_id, len(ids), ids.tobytes()))
                before += len(ids)
            yield batch_of(out, schema)
        give_back()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return stored(texts.mapInArrow(encode, f"part int, before long, doc_id {kind}, n long, ids binary"), "tokens")


def pack(
    docs: DataFrame, path: str, end_id: int = 1, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is the end id
    alone; repeated rows and null ids are packed like any other document; an empty table gives
    no piece. The order of the documents is that of the scan. A smaller ``batch_chars`` takes less
    memory, and more time as words are encoded once a batch.
    """
    table = token_table(docs, path, end_id, id_col, text_col, batch_chars)
    totals = table.groupBy("part").agg(F.sum("n").alias("n"))
    # One row of 16 bytes per partition of the scan.
    based = table.join(F.broadcast(offsets_of(totals, "part", "n", "base")), "part")
    placed = based.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    schema = pa.schema([(n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
    schema = schema.insert(0, arrow_of(placed).field("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in size_blocks(table_rows(batches), lambda row: row[2], batch_chars // 4):
            out = []
            for doc_id, at, n, ids in block:
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, width)
                    length = min(n - start, width - offset)
                    out.append((doc_id, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]))
                    start += length
            yield batch_of(out, schema)
        give_back()

    return placed.mapInArrow(cut, layout)


def sequences(pieces: DataFrame, width: int = WIDTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, length, ids``: pieces joined in order, padded to ``width`` unless their
    length is a power of two. A sequence has at most ``width`` pieces."""
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    one = F.lit(pad_id.to_bytes(4, "little"))
    padded = F.when(
        F.expr("bit_count(length) = 1"), joined
    ).otherwise(F.concat(joined, F.aggregate(F.array_repeat(one, (width - F.col("length")).cast("int")), F.lit(b""), lambda a, b: F.concat(a, b))))
    return gathered.select("sequence_id", "length", padded.alias("ids"))
