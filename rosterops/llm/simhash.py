"""Near-duplicates by SimHash and a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the hashes of a text's word shingles do.
Only distinct fingerprints are compared. The index has these levels:

* **Upper nodes** are masked bit patterns. The 64 bits fall into ``SEGMENTS`` segments; two
  fingerprints at most ``BITS`` apart agree on all bits of some ``SEGMENTS - BITS`` of them. Each
  choice of segments is a mask, and fingerprints that share a masked pattern share a node with
  no difference so far. These nodes are the shuffle key, so no link crosses tasks unseen.
* Below, a node's fingerprints are sorted by **Gray rank**, where neighbours differ in few
  bits, by one range sort of the cluster over (mask, pattern, rank). A huge node thereby spans
  several sorted blocks.
* Inside a block a node is a **tree** of runs: each inner node holds the bits that all below it
  share. Two runs are joined top-down; their differences on bits that both share add up from
  level to level, and a pair of runs past ``BITS`` is dropped whole.
* Blocks of one node that lie apart meet as pairs, dropped by the same test before any member
  is compared.

A run of links is kept as a spanning forest, at most one edge per fingerprint and node, never
all pairs. The forest is contracted to components in rounds of joins over written tables.

``keep_one`` links texts by the exact Jaccard similarity of their word shingles. The index over the
fingerprints of these sets gives the first candidates; every link is verified on the sets. As a fingerprint's
bits tell too little of pairs at 0.8, sets still apart meet again if they share one of the rarest
grams that either must have in common with the other, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, by_place, give_back, size_blocks, stored, table_rows, text_hash, texts_of, without

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS = 6
BLOCK_ROWS = 1 << 18  # fingerprints compared in one go
SMALL, LEAF, FAN = 32, 64, 8
BATCH_CHARS = 1 << 22
_ALL = (1 << 64) - 1
WORDS, SIMILARITY = 5, 0.8  # of ``keep_one``: words of a shingle, Jaccard similarity of near copies
BUCKETS = 1 << 19  # counts that order the grams of a set
CENTRES, ORDERS = (1, 16, 64), 32  # sets that meet all others of a gram, by round, and orders of sets to take them by
SEEN = 1 << 18  # sets a task remembers so as to pass them on once
SKETCH = 4  # longs of a set's parity sketch
WIDE = 32  # longs of the sketch by which a pair is judged before its sets are shipped
SLACK = 1e-9  # rounding of a bound: more candidates, never fewer


def fingerprint_of(text: str, hash_of, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one whole text; 0 without a word."""
    words = text.encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])), np.uint64, n)
    return print_of(hashes)


def print_of(hashes: np.ndarray) -> int:
    """Fingerprint of hashes (64 bits each): a bit is set if it is in more than half of them."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def sketch_of(grams: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Parities of a set's grams by some of their bits, in ``longs`` longs. Each gram that one of two sets
    holds alone changes one parity, so they differ in at least as many grams as their sketches do in bits."""
    odd = np.bincount((grams.view(np.uint64) >> np.uint64(40)) % np.uint64(64 * longs), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, h, fp`` (64 bits as a signed long) for every row; null and empty texts have 0.
    ``h`` is the text's hash."""
    texts = texts_of(docs, id_col, text_col).withColumn("h", text_hash(F.col("text")))
    layout = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long, fp long"
    schema = arrow_of(texts.sparkSession.createDataFrame([], layout))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for block in size_blocks(table_rows(batches), lambda row: len(row[1]), BATCH_CHARS):
            found = [fingerprint_of(text, xxh64_intdigest, shingle, seed) for _, text, _ in block]
            yield batch_of([(doc_id, h, fp - (1 << 64) if fp >> 63 else fp) for (doc_id, _, h), fp in zip(block, found, strict=True)], schema)
        give_back()

    return texts.mapInArrow(prints, layout)


def masks(bits: int = BITS, segments: int = SEGMENTS) -> list[int]:
    """All choices of ``segments - bits`` segments, as signed 64-bit masks."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    chosen = [sum(some) for some in combinations(parts, segments - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint among Gray codes, as a signed long of the same order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Links:
    """Components among the rows of some arrays, by the smallest row."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up


def tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up: shared bits of each run, and which bits those are."""
    starts = np.arange(0, len(codes), LEAF)
    both, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    levels = [(both, ~(both ^ some))]
    while len(both) > 1:
        starts = np.arange(0, len(both), FAN)
        both, some = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(some, starts)
        levels.append((both, ~(both ^ some)))
    return levels


def join_trees(a: np.ndarray, b: np.ndarray, bits: int, links: Links, base_a: int, base_b: int, same: bool) -> None:
    """Link codes of ``a`` and ``b`` at most ``bits`` apart; both sorted by Gray rank.

    ``same``: both are one array, and each pair of runs is met once.
    """
    tops = [tree(a), tree(b)]
    for levels in tops:  # trees of equal height: the lower one's root is its own parent
        while len(levels) < max(len(t) for t in tops):
            levels.append(levels[-1])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in reversed(range(len(tops[0]))):
        (pa_, ma), (pb, mb) = tops[0][level], tops[1][level]
        if level < len(tops[0]) - 1:
            i, j = _children(i, len(pa_), len(tops[0][level + 1][0])), _children(j, len(pb), len(tops[1][level + 1][0]))
            i, j = (np.repeat(i, j.shape[1], axis=1).ravel(), np.tile(j, (1, i.shape[1])).ravel())
            fine = (i < len(pa_)) & (j < len(pb)) & ((i <= j) | (not same))
            i, j = i[fine], j[fine]
        near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= bits
        i, j = i[near], j[near]
    steps = np.arange(LEAF)
    for first in range(0, len(i), 256):
        x, y = i[first : first + 256, None] * LEAF + steps, j[first : first + 256, None] * LEAF + steps
        left, right = a[np.minimum(x, len(a) - 1)], b[np.minimum(y, len(b) - 1)]
        close = (_far(left[:, :, None], right[:, None, :]) <= bits) & (x < len(a))[:, :, None] & (y < len(b))[:, None, :]
        pair, u, v = np.nonzero(close)
        links.add(base_a + x[pair, u], base_b + y[pair, v])


def _children(nodes: np.ndarray, n: int, above: int) -> np.ndarray:
    """Columns of child numbers; a repeated root is its own only child."""
    return nodes[:, None] if n == above else nodes[:, None] * FAN + np.arange(FAN)


def link_block(group: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Component of each row of a block; rows of a group are neighbours, in Gray order."""
    links, n = Links(len(codes)), len(codes)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, n))
    small = np.repeat(sizes <= SMALL, sizes)
    rows = np.flatnonzero(small)
    for step in range(1, SMALL):
        rows = rows[rows + step < n]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        near = rows[_far(codes[rows], codes[rows + step]) <= bits]
        links.add(near, near + step)
    for head, size in zip(heads[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        part = codes[head : head + size]
        join_trees(part, part, bits, links, head, head, True)
    return links.label


def forest(distinct: DataFrame, bits: int = BITS, segments: int = SEGMENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``a, b`` whose components are those of all fingerprints (``fp``) within ``bits``."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(bits, segments))]))
    keyed = distinct.select("fp", gray_rank(F.col("fp")).alias("rank"), every.alias("m")).select("m.mask", "m.key", "rank", "fp")
    ordered = keyed.repartitionByRange("mask", "key", "rank").sortWithinPartitions("mask", "key", "rank").select("mask", "key", "fp")
    layout = "mask int, key long, block long, shared long, fixed long, members binary, a long, b long"
    schema = arrow_of(distinct.sparkSession.createDataFrame([], layout))
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges_of(codes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linked = label != np.arange(len(label))
        return codes[label[linked]].view(np.int64), codes[linked].view(np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for block in size_blocks(batches, lambda batch: batch.num_rows, block_rows):
            table = pa.Table.from_batches(block)
            mask, key, codes = (table.column(k).to_numpy() for k in range(3))
            codes = np.ascontiguousarray(codes).view(np.uint64)
            if not len(codes):
                continue
            fresh = np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            group = np.cumsum(fresh)
            a, b = edges_of(codes, link_block(group, codes, bits))
            nothing = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(a), pa.array(b)], schema=schema)
            ends = {1: slice(0, int((group == 1).sum())), int(group[-1]): slice(int((group < group[-1]).sum()), len(group))}
            for part in ends.values():  # a node at the block's border may go on in another block
                own = codes[part]
                shared, fixed = np.bitwise_and.reduce(own), ~(np.bitwise_and.reduce(own) ^ np.bitwise_or.reduce(own))
                signed = [int(x.view(np.int64)) for x in (shared, fixed)]
                yield batch_of([(int(mask[part][0]), int(key[part][0]), number, *signed, own.tobytes(), None, None)], schema)
            number += 1

    found = stored(ordered.mapInArrow(blocks, layout), "simhash-blocks")
    nodes = found.filter("mask is not null").select("mask", "key", "block", "shared", "fixed", "members")
    other = nodes.select("mask", "key", *[F.col(c).alias(f"{c}_b") for c in ("block", "shared", "fixed", "members")])
    apart = F.bit_count(F.expr("(shared ^ shared_b) & fixed & fixed_b"))
    pairs = nodes.join(other, ["mask", "key"]).filter((F.col("block") < F.col("block_b")) & (apart <= bits)).select("members", "members_b")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in table_rows(batches):
            codes = [np.frombuffer(x, np.uint64) for x in (left, right)]
            links = Links(len(codes[0]) + len(codes[1]))
            join_trees(*codes, bits, links, 0, len(codes[0]), False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges_of(np.concatenate(codes), links.label)], schema=edge_schema)

    return found.filter("a is not null").select("a", "b").union(pairs.mapInArrow(across, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (``a, b``): equal roots in each component.

    A round hooks every node to its smallest neighbour, follows these hooks twice and renames
    the edges, until none is left. Every aggregate is a minimum and combines before its shuffle.
    """
    edges, labels = stored(edges, "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up"))
        for _ in range(2):
            hooks = hooks.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
            hooks = stored(hooks, "hooks")
        renamed = edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = stored(renamed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("root"))
        else:
            moved = labels.join(hooks.select(F.col("node").alias("root"), "up"), "root", "left")
            labels = stored(moved.select("node", F.coalesce("up", "root").alias("root")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, h, fp, root, component_id`` for every row of ``docs``; ``h`` is the text's hash and
    ``root`` one fingerprint of the component, equal for all its rows.

    ``component_id`` is the smallest id reachable over links of at most ``bits`` differing
    bits, the row's own included. Null and empty texts have the fingerprint 0 and are linked
    like any other; null ids never become a ``component_id`` unless a component has no other.
    Repeated rows stay; an empty table gives none.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(forest(least.select("fp"), bits, segments)).select(F.col("node").alias("fp"), "root")
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def _shingled(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    """Of blocks of rows ``doc_id, text, h``: ids, text hashes, set hashes and each row's distinct grams, sorted."""
    from xxhash import xxh64_intdigest

    for block in size_blocks(table_rows(batches), lambda row: len(row[1]), BATCH_CHARS):
        sids, found = [], []
        for _, text, _ in block:
            words = text.encode().lower().split()
            pieces = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}
            grams = np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces)).view(np.int64))
            found.append(grams)
            sids.append(xxh64_intdigest(grams.tobytes(), SEED))
        yield [r[0] for r in block], [r[2] for r in block], np.array(sids, np.uint64).view(np.int64), found


def shingle_prints(texts: DataFrame, shingle: int = WORDS) -> DataFrame:
    """``doc_id, h, sid, fp, sketch`` for every row of ``doc_id, text, h``: ``sid`` is the hash of the text's distinct word
    shingles, equal for equal sets, ``fp`` their fingerprint. A text of fewer words is one shingle; an empty one has the empty
    shingle. Beside them, rows ``bucket, often``: how often grams occur, by their lowest bits."""
    layout = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long, sid long, fp long, sketch array<long>, bucket int, often long"
    schema = arrow_of(texts.sparkSession.createDataFrame([], layout))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for ids, hashes, sids, found in _shingled(batches, shingle):
            counts += np.bincount(np.concatenate(found) & (BUCKETS - 1), minlength=BUCKETS)
            prints = np.array([print_of(g.view(np.uint64)) for g in found], np.uint64).view(np.int64)
            sketches = pa.array([sketch_of(g) for g in found], schema[4].type)
            columns = [pa.array(ids, schema[0].type), pa.array(hashes, pa.int64()), pa.array(sids), pa.array(prints), sketches]
            columns += [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        seen = np.flatnonzero(counts)
        for part in np.array_split(seen, max(1, len(seen) >> 16)):
            nothing = [pa.nulls(len(part), schema[k].type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(part.astype(np.int32)), pa.array(counts[part])], schema=schema)
        give_back()

    return texts.mapInArrow(prints, layout)


def shingle_sets(texts: DataFrame, shingle: int = WORDS) -> DataFrame:
    """``sid, n, wide, grams`` for every row of ``doc_id, text, h``; ``wide`` is a sketch of ``WIDE`` longs."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int32()), ("wide", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sids, found in _shingled(batches, shingle):
            sizes = np.array([len(g) for g in found], np.int32)
            borders, places = np.append(0, np.cumsum(sizes)).astype(np.int32), np.arange(len(found) + 1, dtype=np.int32) * WIDE
            lists = [(places, np.concatenate([sketch_of(g, WIDE) for g in found])), (borders, np.concatenate(found))]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for ends, values in lists]
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(sizes), *lists], schema=schema)
        give_back()

    return texts.mapInArrow(sets, "sid long, n int, wide array<long>, grams array<long>")


def rare_grams(texts: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """``gram, sid, n, place``: the first grams of each set, rare ones first, from rows ``doc_id, text, h``.

    Two sets as similar as that share at least ``similarity * n`` grams of either, so the first
    ``n - ceil(similarity * n) + 1`` of both hold a common one. ``counts`` (by a gram's lowest bits) only order the
    grams; they never decide a result. A task passes a set on once; grams of one set only are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("gram", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_of, seen = shared.value, set()
        for _, _, sids, found in _shingled(batches, shingle):
            out = []
            for sid, grams in zip(sids.tolist(), found, strict=True):
                if sid in seen:
                    continue
                seen.add(sid)
                n = len(grams)
                order = np.lexsort((grams, often_of[grams & (BUCKETS - 1)]))[: n - math.ceil(similarity * n - SLACK) + 1]
                out.append((grams[order], np.full(len(order), sid), np.full(len(order), n, np.int32), np.arange(len(order), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
            if len(seen) > SEEN:
                seen = set()
        del seen
        give_back()

    rows = texts.mapInArrow(first, "gram long, sid long, n int, place int").repartition("gram")
    along = Window.partitionBy("gram")  # a gram has a row per set, and one more per task that met the set
    several = rows.distinct().withColumn("lo", F.min("sid").over(along)).withColumn("hi", F.max("sid").over(along)).filter("lo <> hi")
    return several.select("gram", "sid", "n", "place")


def indexed_pairs(marks: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``a, b``: sets (``sid, fp`` of ``marks``) that the index of fingerprints links, as a forest: the edges between
    fingerprints, each stood for by its least set, and that set with all others of the fingerprint."""
    least = stored(marks.groupBy("fp").agg(F.min("sid").alias("least")), "set-prints")
    edges = forest(least.select("fp"), bits, segments)
    for end in "ab":
        edges = edges.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"least_{end}")), end)
    equal = marks.join(least, "fp").filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    return edges.select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b")).union(equal)


def similar_sets(rare: DataFrame, sets_of: Callable[[DataFrame], DataFrame], marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of the sets (``sid``) linked to another by a Jaccard similarity of at least
    ``similarity``: exactly the components of all such pairs.

    Every link is verified on the whole sets, which ``sets_of`` gives for a list of ``sid``. First come the pairs
    of the fingerprint index over ``marks`` (``sid, fp, sketch``). Then sets that share a rare gram are candidates: in rounds each
    set meets the ``CENTRES`` of its grams, the first by one of ``ORDERS`` orders of sets, other ones each round; that
    links most of a large group with few pairs. At last all candidates not yet in one component meet, if their sizes, the places of
    the gram in both and their sketches allow the similarity.
    """
    least = similarity / (1 + similarity)

    def able(a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Length and place leave room for the common grams that the similarity asks for."""
        sizes = F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - SLACK
        return sizes & (F.least(a["n"] - a["place"], b["n"] - b["place"]) >= least * (a["n"] + b["n"]) - SLACK)

    def verified(pairs: DataFrame) -> DataFrame:
        whole = stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), "paired-sets")
        near = stored(near_sketches(pairs, whole, similarity), "near-pairs")
        ends = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        whole = whole.join(ends, "sid", "left_semi")
        left, right = (whole.select(F.col("sid").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        met = near.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
        return met.filter(F.col("both") / (F.size("grams_a") + F.size("grams_b") - F.col("both")) >= similarity).select("a", "b")

    names = ["sid", "n", "place", "root"]
    mine, theirs = {c: F.col(c) for c in names}, {c: F.col(f"{c}_b") for c in names}
    along = Window.partitionBy("gram")
    tested, edges, labels = None, None, None
    for turn in range(-1, len(CENTRES) + 1):
        if turn >= 0:
            members = rare.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        if turn < 0:
            pairs = indexed_pairs(marks)
        elif turn < len(CENTRES):
            order = F.xxhash64("sid", F.pmod("gram", F.lit(ORDERS)) + ORDERS * turn)
            centres = members.withColumn("k", F.row_number().over(along.orderBy(order, "sid"))).filter(F.col("k") <= CENTRES[turn])
            met = members.join(centres.select("gram", *[F.col(c).alias(f"{c}_b") for c in names]), "gram").filter(F.col("sid") != F.col("sid_b"))
            pairs = met.filter((F.col("root") != F.col("root_b")) & able(mine, theirs))
        else:
            members = members.withColumn("lo", F.min("root").over(along)).withColumn("hi", F.max("root").over(along)).filter("lo <> hi").select("gram", *names)
            pairs = _still_apart(stored(members.join(marks.select("sid", "sketch"), "sid"), "set-members"), similarity, able(mine, theirs))
        if turn >= 0:
            pairs = pairs.select(F.least("sid", "sid_b").alias("a"), F.greatest("sid", "sid_b").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "set-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = verified(pairs)
        edges = stored(found if edges is None else edges.union(found), "set-links")
        labels = components(edges)
    return labels


def _may_be_near(a: str, b: str, sizes: Column, similarity: float, longs: int) -> Column:
    """Similar sets differ in few grams, so in few bits of their sketches; ``sizes`` is the sum of both sizes."""
    apart = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(longs)), F.lit(0))
    return apart <= (1 - similarity) / (1 + similarity) * sizes + SLACK


def near_sketches(pairs: DataFrame, whole: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sizes and sketches in ``whole`` (``sid, n, wide``) allow the similarity: only
    their sets are shipped, so chance pairs, of which there are ever more in larger tables, cost a sketch each."""
    for end in "ab":
        pairs = pairs.join(whole.select(F.col("sid").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}")), end)
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - SLACK
    return pairs.filter(sizes & _may_be_near("wide_a", "wide_b", F.col("n_a") + F.col("n_b"), similarity, WIDE)).select("a", "b")


def _still_apart(members: DataFrame, similarity: float, able: Column) -> DataFrame:
    """Pairs of ``members`` (``sid, n, place, root, gram, sketch``) of one gram and two roots that may be similar.

    Sizes that allow the similarity stand in one band or in two that follow each other. A set meets those of
    its band or the next one; it cannot share enough with a set as large as these by grams that
    stand too far back in it, so it is not laid out for them.
    """
    step, least = -math.log(similarity), similarity / (1 + similarity)
    banded = members.withColumn("band", F.floor(F.log("n") / step))
    both = banded.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    smallest = F.greatest(F.col("n"), F.exp((F.col("band") + F.col("up")) * step) * F.lit(1 - 1e-6))
    low = both.filter((F.col("up") == 0) | (F.col("n") - F.col("place") >= least * (F.col("n") + smallest) - SLACK))
    low = low.withColumn("band", F.col("band") + F.col("up"))
    high = banded.select("gram", "band", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "place", "root", "sketch")])
    near = _may_be_near("sketch", "sketch_b", F.col("n") + F.col("n_b"), similarity, SKETCH)
    once = (F.col("up") == 1) | (F.col("sid") < F.col("sid_b"))
    return low.join(high, ["gram", "band"]).filter(once & (F.col("root") != F.col("root_b")) & able & near)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard similarity of at least
    ``similarity`` of their word shingles: that of the smallest id (null ids last), of
    the smallest text hash among its rows, once if the whole row is repeated."""
    texts = texts_of(docs, id_col, text_col).withColumn("h", text_hash(F.col("text")))
    prints = stored(shingle_prints(texts, shingle), "shingle-prints")
    buckets = prints.filter("bucket is not null").groupBy("bucket").agg(F.sum("often").alias("often")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[buckets.column("bucket").to_numpy()] = buckets.column("often").to_numpy()
    marks = stored(prints.filter("bucket is null").select("sid", "fp", "sketch").distinct(), "set-marks")
    found = stored(prints.filter("bucket is null").groupBy("sid", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "set-rows")
    least = found.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of some ``sid``, made anew from one text of each."""
        keys = least.join(wanted, "sid").select(F.col("k.doc_id").alias("own_id"), F.col("k.h").alias("own_h"))
        keys = stored(keys, "set-keys")  # a table of known size: Spark broadcasts it if small, or else joins by shuffle
        own = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))
        sets = shingle_sets(texts.join(keys, own, "left_semi"), shingle)
        return sets.dropDuplicates(["sid"]) if again else sets

    again = not found.filter("n > 1").isEmpty()  # rows of one id and text: else each key gives one set
    rare = stored(rare_grams(texts, counts, similarity, shingle), "rare-grams")
    roots = similar_sets(rare, sets_of, marks, similarity).select(F.col("node").alias("sid"), "root")
    rooted = stored(least.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "set-roots")
    first = rooted.groupBy("root").agg(F.min("k").alias("k"))
    first = rooted.select("sid", "root").join(first, "root").select("sid", F.col("k.doc_id").alias("k_id"), F.col("k.h").alias("k_h"))
    judged = found.join(first, "sid").withColumn("keep", F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))
    judged = stored(judged.select("doc_id", "h", "n", "keep"), "set-judged")
    repeated = judged.filter("keep and n > 1").select("doc_id", "h")
    others = judged.filter("not keep").select("doc_id", "h")
    if repeated.isEmpty():
        return without(docs, others, id_col, text_col)
    plain, [doc_id, text] = by_place(docs, id_col, text_col)
    listed = repeated.select(F.col("doc_id").alias("again_id"), F.col("h").alias("again_h"))
    same = F.col(doc_id).eqNullSafe(F.col("again_id")) & (text_hash(F.col(text)) == F.col("again_h"))
    once = plain.join(listed, same, "left_semi").dropDuplicates([doc_id, text])
    return without(plain, others.union(repeated), doc_id, text).union(once).toDF(*docs.columns)
