"""Benchmark decontamination by suffix arrays over the training text.

Training documents are read in shards of about ``SHARD`` words, each inside one task. A shard's
words become numbers (0 for a word no item has), and its suffixes are sorted by their first
``window`` words. A suffix that meets a 0 before the shortest item window cannot begin a match,
so only the others enter the array. Every test suffix, cut to its window, is then found by a
binary search for both ends of its range, which gives all its places at once. Windows that
follow one another on both sides join to longest verbatim matches with their locations.

Items reach the tasks in blocks of a stated size; with more items there are more blocks, each
a pass over the documents that carries the matches found so far. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, give_back, pick, restored, size_blocks, stored, table_rows, text_hash, texts_of, without

WINDOW = 10
SHARD = 1 << 19  # words of a shard
ITEM_BYTES = 32 << 20  # text of the items of one block
# Fixed: digits and letters stay, capitals are lowered, other ASCII ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


class Items:
    """The windows of one block of items, as numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.names = window, [name for name, _ in items]
        split = [words_of(text) for _, text in items]
        self.codes = {word: k + 1 for k, word in enumerate(dict.fromkeys(w for words in split for w in words))}
        bits = max(1, len(self.codes).bit_length())
        self.bits, self.per = bits, max(1, 63 // bits)
        owners: dict[tuple[int, ...], list[int]] = {}
        for k, words in enumerate(split):
            coded = [self.codes[w] for w in words]
            for cut in {tuple(coded[i : i + window]) for i in range(max(1, len(coded) - window + 1))}:
                owners.setdefault(cut, []).append(k)
        owners.pop((), None)
        cuts = list(owners)
        self.lengths = np.array([len(cut) for cut in cuts], np.int64)
        self.owners = list(owners.values())
        top = (1 << bits) - 1
        self.low = self.keys(np.array([[*cut, *[0] * (window - len(cut))] for cut in cuts], np.int64).reshape(len(cuts), window))
        self.high = self.keys(np.array([[*cut, *[top] * (window - len(cut))] for cut in cuts], np.int64).reshape(len(cuts), window))

    def keys(self, words: np.ndarray) -> list[np.ndarray]:
        """``window`` columns of word numbers, several to a 63-bit key."""
        keys = []
        for first in range(0, self.window, self.per):
            key = np.zeros(len(words), np.int64)
            for column in range(first, min(first + self.per, self.window)):
                key = (key << self.bits) | words[:, column]
            keys.append(key)
        return keys

    def matches(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and the places in the shard where they begin."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(shard):
            return none
        stops = np.flatnonzero(shard == 0)
        starts = np.flatnonzero(shard)
        ends = np.append(stops, len(shard))[np.searchsorted(stops, starts)]
        starts = starts[ends - starts >= self.lengths.min()]
        if not len(starts):
            return none
        padded = np.append(shard, np.zeros(self.window, np.int64))
        keys = self.keys(np.stack([padded[starts + k] for k in range(self.window)], axis=1))
        order = np.lexsort(keys[::-1])
        suffixes, keys = starts[order], [key[order] for key in keys]
        first, last = _bound(keys, self.low, False), _bound(keys, self.high, True)
        counts = last - first
        window = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
        return window, suffixes[np.repeat(first, counts) + within]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted suffixes: the first place not before (``after``: behind) each."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high) // 2, 0)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, want in zip(keys, wanted, strict=True):
            here = key[middle]
            less |= equal & (here < want)
            equal &= here == want
        right = open_ & (less | equal if after else less)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ``(start, end)`` joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """Distinct items, read to the driver a block at a time."""
    rows = pick(items, item_id=id_col, text=text_col).select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("text <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield Items([(r["item_id"], r["text"]) for r in part.toLocalIterator()], window)


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD, block_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``doc_id, h, n_words, matches, items`` for every row of ``docs``; ``h`` is the text's hash.

    ``matches`` are the longest verbatim matches as ``(start, end)`` in words, in order and
    apart; ``items`` the ids of items with an occurring window, sorted, each once. An item of
    fewer than ``window`` words is one window; one without words, or null, never occurs. An
    item without an id counts for ``matches`` only. A null text has no words; repeated
    documents are judged each; no items: nothing matches.
    """
    state = texts_of(docs, id_col, text_col).select(
        "doc_id", "text", text_hash(F.col("text")).alias("h"), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("matches"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema, layout = arrow_of(state), state.schema
    context = state.sparkSession.sparkContext
    for block in item_blocks(items, window, item_col, item_text_col, block_bytes):
        state = state.mapInArrow(_scan(context.broadcast(vars(block)), schema, shard_words), layout)
    return state.drop("text")


def _scan(shared, schema: pa.Schema, shard_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = restored(Items, shared.value)
        code = items.codes.get

        def coded() -> Iterator[tuple]:
            for row in table_rows(batches):
                yield row, np.array([code(word, 0) for word in words_of(row[1])], np.int64)

        for block in size_blocks(coded(), lambda pair: len(pair[1]) + 1, shard_words):
            starts = np.cumsum([0] + [len(codes) + 1 for _, codes in block])  # a 0 between documents
            shard = np.zeros(starts[-1], np.int64)
            for (_, codes), start in zip(block, starts[:-1], strict=True):
                shard[start : start + len(codes)] = codes
            found, places = items.matches(shard)
            owner = np.searchsorted(starts, places, "right") - 1
            spans: dict[int, set] = {}
            windows: dict[int, set] = {}
            for doc, window, place in zip(owner.tolist(), found.tolist(), (places - starts[owner]).tolist(), strict=True):
                spans.setdefault(doc, set()).add((place, place + int(items.lengths[window])))
                windows.setdefault(doc, set()).add(window)
            out = []
            for k, ((doc_id, text, h, _, old, names), codes) in enumerate(block):
                kept = [(m["start"], m["end"]) for m in old]
                if k in spans:
                    kept = _merged([*kept, *spans[k]])
                    hit = {items.names[item] for window in windows[k] for item in items.owners[window]}
                    names = sorted({*names, *hit} - {None})
                out.append((doc_id, text, h, len(codes), [{"start": a, "end": b} for a, b in kept], names))
            yield batch_of(out, schema)
        give_back()

    return scan


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    leaks = find_leaks(docs, items, window, id_col, text_col).filter(F.size("matches") > 0).select("doc_id", "h")
    return without(docs, stored(leaks, "leaks"), id_col, text_col)


def leak_report(leaks: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items and their digest."""
    hit = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return leaks.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
    )
