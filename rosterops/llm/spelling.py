"""Spelling variants by blocked Gram matrices.

Two words are near if one inserted, deleted or replaced letter makes one of the other. Their
letter counts then differ by a squared distance of one or two, and that distance follows from
a matrix product of count vectors: ``|a|^2 + |b|^2 - 2 a.b``. Words meet in blocks of one length and
the next longer one; pairs at most two apart are kept, and the edit itself is verified.

The blocks are cut finer than by length, so that a large vocabulary never meets itself whole.
Letters fall into ``CLASSES`` classes, and a word's class counts give its cells: the *full* cell of
its counts, and a *deleted* cell for each class, with one letter of it taken away. Near words
share one cell:

* a word and one with a letter more: the full cell of the one is a deleted cell of the other;
* one letter replaced by another class's: their deleted cells of the two classes are equal;
* one replaced inside a class: their full cells are equal.

Each pair meets in exactly one cell, as one of these kinds. A cell holds words of two adjacent
lengths. Cells of more than ``BLOCK`` rows are dealt to pairs of blocks, each its own group, so
every group's matrices are bounded and no pair is lost. A group passes on one row per word,
with its number of near words and the best of them, never the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import pick, stored, table_rows, whole_groups

LEAST_CHARS, LEAST_COUNT, FACTOR = 7, 2, 10
EVERY = 31  # one in so many runs loses a letter; None: none does
CLASSES = 8
BLOCK = 16_384  # rows of a cell that meet at once
TILE = 1_024
HELD = 200_000  # distinct words a task counts before it passes them on
PART_CHARS = 1 << 20


def runs_of(text: str, least: int) -> Iterator[bytes]:
    """Maximal runs of at least ``least`` letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lowered, one
    byte a letter. A very long text is read a part at a time, each part ending with its last run."""
    runs, rest = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least), re.compile(rb"[a-z\xc0-\xff]*")
    data, start = text.encode("latin-1", "replace").lower(), 0
    while start < len(data):
        end = rest.match(data, min(start + PART_CHARS, len(data))).end()
        yield from runs.findall(data, start, end)
        start = end


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int | None = EVERY
) -> DataFrame:
    """``word, n``: words of at least ``least_chars`` letters with their occurrences over all texts.

    With ``every``, a run loses the letter at ``h % length`` where ``every`` divides ``h``, the CRC-32 of
    ``<doc_id>:<run>``. Null texts have no word; a null id counts as an empty one.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string")).filter("text is not null")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for doc_id, text in table_rows(batches):
            seed = crc32(f"{doc_id}:".encode())
            for word, n in Counter(runs_of(text, least_chars)).items():
                if every:
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if not h % every:
                        gone = h % len(word)
                        word = word[:gone] + word[gone + 1 :]
                        if len(word) < least_chars:
                            continue
                total[word] = total.get(word, 0) + n
            if len(total) >= HELD:
                yield _counted(total, schema)
                total = {}
        yield _counted(total, schema)

    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _counted(total: dict[bytes, int], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and each word's length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def cells(words: DataFrame, classes: int = CLASSES) -> DataFrame:
    """``cell, role, word, n``: the full cell (role 0) and the deleted cells (role 1 + class) of each word."""
    schema = pa.schema([("cell", pa.binary()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, lengths = letters_of(batch.column(0).to_pylist())
            rows = np.arange(batch.num_rows)
            full = np.bincount(np.repeat(rows, lengths) * classes + letters % classes, minlength=len(rows) * classes).reshape(-1, classes).astype("<u4")
            held, role = np.nonzero(full)
            fewer = full[held]
            fewer[np.arange(len(held)), role] -= 1
            keys = np.ascontiguousarray(np.concatenate([full, fewer]))
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * classes), len(keys), [None, pa.py_buffer(keys)])
            which = pa.array(np.concatenate([rows, held]))
            roles = pa.array(np.concatenate([np.zeros(len(rows), np.int32), role.astype(np.int32) + 1]))
            yield pa.RecordBatch.from_arrays([binary.cast(pa.binary()), roles, batch.column(0).take(which), batch.column(1).take(which)], schema=schema)

    return words.select("word", "n").mapInArrow(spread, "cell binary, role int, word string, n long")


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of code points of one length that differ in one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows where ``long`` is ``short`` and one letter more: what is equal from the front and what is
    equal from the end cover the short word."""
    front = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return front + back >= short.shape[1]


def near_pairs(role: np.ndarray, block: np.ndarray | None, full: np.ndarray, fewer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of a cell: ``full`` holds the code points of the words of role 0, ``fewer``
    those of the others, one letter longer; the rows are sorted by role. With ``block``, only pairs of two
    blocks are wanted."""
    n, short = len(role), len(full)
    letters, column = np.unique(np.concatenate([full.ravel(), fewer.ravel()]), return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(short), full.shape[1]), np.repeat(np.arange(short, n), fewer.shape[1])])
    counts = np.bincount(rows * len(letters) + column, minlength=n * len(letters)).reshape(n, -1).astype(np.float32)
    square, one = (counts * counts).sum(axis=1, keepdims=True), np.ones((n, 1), np.float32)
    left, right = np.hstack([2 * counts, -square, -one]), np.hstack([counts, one, square])  # their product: minus the squared distance
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    heads = np.flatnonzero(np.append(True, role[1:] != role[:-1]))
    for head, end in zip(heads, np.append(heads[1:], n)):
        begin = head if role[head] == 0 else end  # words of one deleted class have met in their full cell
        for i in range(head, end, TILE):
            for j in range(begin, n, TILE):
                apart = left[i : min(i + TILE, end)] @ right[j : j + TILE].T
                a, b = np.nonzero((apart > -2.5) & (apart < -0.5))
                a, b = a + i, b + j
                fine = a < b
                if block is not None:
                    fine &= block[a] != block[b]
                found.append((a[fine], b[fine]))
    a, b = (np.concatenate(x) for x in zip(*found))
    kind = (a >= short).astype(np.int8) + (b >= short)
    near = np.zeros(len(a), bool)
    for first in range(0, len(a), 1 << 18):
        part = slice(first, first + (1 << 18))
        x, y, k = a[part], b[part], kind[part]
        fine = np.zeros(len(x), bool)
        fine[k == 0] = replaced(full[x[k == 0]], full[y[k == 0]])
        fine[k == 1] = inserted(full[x[k == 1]], fewer[y[k == 1] - short])
        fine[k == 2] = replaced(fewer[x[k == 2] - short], fewer[y[k == 2] - short])
        near[part] = fine
    return a[near], b[near]


def near_words(words: DataFrame, block: int = BLOCK, classes: int = CLASSES) -> DataFrame:
    """``word, n_near, near_n, near``: for each word (``word, n``, distinct) with near words their number
    and the one of largest ``n``, ties to the smallest in code-point order."""
    rows = cells(words, classes)
    # At most one hot cell per ``block`` rows.
    hot = F.broadcast(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > block).select("cell", F.ceil(F.col("k") / block).alias("blocks")))
    dealt = rows.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), "blocks"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    dealt = dealt.select("cell", F.explode(every).alias("pair"), "role", "own", "word", "n").select("cell", "pair.x", "pair.y", "role", "own", "word", "n")
    ordered = dealt.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "role")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 3):
            x, y, role, own, n = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 6))
            names = table.column(5).to_pylist()
            letters, lengths = letters_of(names)
            places = np.append(0, np.cumsum(lengths))
            out: list[tuple] = []
            for first, after in zip(starts, np.append(starts[1:], len(names))):
                if after - first < 2:
                    continue
                short = first + int(np.searchsorted(role[first:after], 1))
                size = int(lengths[first]) - (short == first)  # of the words of role 0
                full = letters[places[first] : places[short]].reshape(-1, size)
                fewer = letters[places[short] : places[after]].reshape(-1, size + 1)
                a, b = near_pairs(role[first:after], None if x[first] == y[first] else own[first:after], full, fewer)
                if len(a):
                    out += _best(a, b, n[first:after], names[first:after])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema)], schema=schema)

    found = ordered.mapInArrow(compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.w").alias("near"))


def _best(a: np.ndarray, b: np.ndarray, n: np.ndarray, names: list[str]) -> list[tuple]:
    """A row for each word of some pairs: its near words' number and the best of them."""
    some = np.unique(np.concatenate([a, b]))
    order = np.zeros(len(names), np.int64)
    order[sorted(some.tolist(), key=names.__getitem__)] = np.arange(len(some))
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((order[near], -n[near], word))
    word, near = word[by], near[by]
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    sizes = np.diff(np.append(heads, len(word)))
    return [(names[w], int(k), int(n[v]), names[v]) for w, k, v in zip(word[heads], sizes, near[heads])]


def variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK, classes: int = CLASSES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``, distinct words).

    A word's form is its near word of largest ``n``, if that is at least ``factor`` times the word's own;
    else null. ``root`` follows forms to the last one. Counts grow by ``factor`` a step, so chains are short
    and have no circles. An empty table gives no row.
    """
    words = stored(words.select("word", "n"), "words")
    found = words.join(near_words(words, block, classes), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    fits = F.col("near_n") >= factor * F.col("n")
    formed = stored(found.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    top = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        moved = stored(top.join(top.select(F.col("word").alias("root"), F.col("root").alias("up")), "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        top = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
