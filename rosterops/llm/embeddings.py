"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label and length are compared by cosine. Scaled to length one and turned so that
the leading dimensions hold most of what tells vectors of a label apart (a PCA, fitted on a
bounded sample; any rotation keeps all cosines), they are sorted along these dimensions and
packed into tiles. Two tiles meet only if their boxes of leading coordinates come near enough.
Within a pair of tiles, blocks of products are accumulated a few dimensions at a time. What the
rest can still add is at most the product of the two suffix norms; pairs that cannot reach the
threshold any more are dropped, and a block without pairs stops. The pairs left are decided by
the cosine of the vectors as given, in double precision.

Equal vectors are one class with a number of copies and are never paired. A pair of tiles passes
on each vector's number of links and a spanning forest of them, at most one edge a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, pick, stored
from rosterops.llm.simhash import Links, components
from rosterops.operators.skew import attach

THRESHOLD = 0.98
SAMPLE = 4_096  # distinct vectors, by the order of their hash, that the rotation is fitted on
SAMPLE_VALUES = 1 << 20  # and numbers in them
TILE_BYTES, TILE_ROWS = 4 << 20, 8_192  # of a tile
BLOCK = 512  # rows of a block of products
BOX = 8  # leading dimensions in a tile's box, and dimensions of the first step
SLACK = 1e-6  # of a bound on rounded products: more pairs to decide, never fewer
_PLACES = 1 << 13  # places of a tile


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v, fine``: ``v`` as floats or doubles, ``label`` as text; ``fine`` rows take part."""
    rows = pick(vectors, vec_id=id_col, v=vector_col, label=label_col)
    kind = rows.schema["v"].dataType.simpleString()
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("v").cast(kind if kind in ("array<float>", "array<double>") else "array<double>"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & good, F.lit(False)))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled twice, so that no square overflows."""
    rows = matrix.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_rotations(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length in the sample, the axes of its vectors' spread inside their labels."""
    longest = classes.agg(F.max(F.size("v"))).first()[0] or 1
    rows = classes.select("label", "v").orderBy(F.xxhash64("v"), "label").limit(max(16, min(sample, SAMPLE_VALUES // longest))).collect()
    out = {}
    for width in {len(r["v"]) for r in rows}:
        some = [r for r in rows if len(r["v"]) == width]
        matrix, labels = unit_rows(np.array([r["v"] for r in some])), np.unique([r["label"] for r in some], return_inverse=True)[1]
        means = np.zeros((labels.max() + 1, width))
        np.add.at(means, labels, matrix)
        matrix = matrix - (means / np.bincount(labels)[:, None])[labels]
        out[width] = np.linalg.eigh(matrix.T @ matrix)[1][:, ::-1].copy()
    return out


def turned(matrix: np.ndarray, rotations: dict[int, np.ndarray]) -> np.ndarray:
    """Unit rows along the rotation's axes; a length the sample lacks keeps its own."""
    rows = unit_rows(matrix)
    return rows @ rotations[rows.shape[1]] if rows.shape[1] in rotations else rows


def _matrices(batch: pa.RecordBatch, place: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal vector length and their vectors, for each length in a batch."""
    lists = batch.column(place)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat, sizes = lists.flatten().to_numpy(), np.diff(ends)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, flat[ends[rows][:, None] + np.arange(width)]


def tiles_of(classes: DataFrame, rotations: dict[int, np.ndarray], reach: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``label, width, tile, lo, hi, least, copies, matrix``: vectors (``label, v, least, copies``) sorted by strips
    along the first two axes, then along the third, with the box of each tile."""
    shared = classes.sparkSession.sparkContext.broadcast(rotations)  # SAMPLE_VALUES bounds the sample, its lengths the rotations
    double = classes.schema["v"].dataType.simpleString() == "array<double>"
    number = np.dtype("<f8" if double else "<f4")
    placed_type = f"label string, width int, s0 int, s1 int, along double, v {classes.schema['v'].dataType.simpleString()}, least {classes.schema['least'].dataType.simpleString()}, copies long"
    place_schema = arrow_of(classes.sparkSession.createDataFrame([], placed_type))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _matrices(batch, 1):
                axes = turned(matrix, shared.value)[:, :3]
                axes = np.hstack([axes, np.zeros((len(axes), 3 - axes.shape[1]))])
                strips = np.floor(axes[:, :2] / reach).astype(np.int32)
                part = batch.take(pa.array(rows))
                columns = [part.column(0), pa.array(np.full(len(rows), matrix.shape[1], np.int32)), pa.array(strips[:, 0]), pa.array(strips[:, 1]), pa.array(axes[:, 2]), *part.columns[1:]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, place_schema, strict=True)], schema=place_schema)

    order = ["label", "width", "s0", "s1", "along"]
    ordered = classes.select("label", "v", "least", "copies").mapInArrow(place, placed_type).repartitionByRange(*order).sortWithinPartitions(*order)
    tile_type = f"label string, width int, tile long, lo array<double>, hi array<double>, least array<{classes.schema['least'].dataType.simpleString()}>, copies array<long>, matrix binary"
    tile_schema = arrow_of(classes.sparkSession.createDataFrame([], tile_type))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number_of, held, key = TaskContext.get().partitionId() << 24, [], None

        def closed() -> pa.RecordBatch:
            matrix = np.concatenate([m for m, _, _ in held]).astype(number)
            axes = turned(matrix, shared.value)[:, :BOX]
            values = [[key[0]], [key[1]], [number_of], [axes.min(axis=0).tolist()], [axes.max(axis=0).tolist()]]
            lists = [pa.array([pa.concat_arrays([part[k] for part in held]).to_pylist()], f.type) for k, f in ((1, tile_schema[5]), (2, tile_schema[6]))]
            return pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(values, tile_schema)), *lists, pa.array([matrix.tobytes()], pa.binary())], schema=tile_schema)

        for batch in batches:
            labels, widths = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            first = 0
            while first < batch.num_rows:
                this = (labels[first], int(widths[first]))
                if held and (this != key or sum(len(m) for m, _, _ in held) >= most):
                    yield closed()
                    held, number_of = [], number_of + 1
                key, most = this, max(1, min(tile_rows, TILE_BYTES // (number.itemsize * this[1])))
                after = first + 1
                room = most - sum(len(m) for m, _, _ in held)
                while after < batch.num_rows and after - first < room and labels[after] == this[0] and widths[after] == this[1]:
                    after += 1
                part = batch.slice(first, after - first)
                [(_, matrix)] = _matrices(part, 5)
                held.append((matrix, part.column(6), part.column(7)))
                first = after
        if held:
            yield closed()

    return ordered.mapInArrow(pack, tile_type)


def meeting_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """``a, b``: tiles of one label and length, ``a`` not above ``b``, whose boxes are at most ``reach`` apart.

    Tiles meet in cells of ``reach`` along the first two axes, so a label of very many tiles is
    spread over its cells.
    """
    boxes = tiles.select("label", "width", "tile", "lo", "hi")

    def strip(side, k, more):
        return F.floor(F.coalesce(F.get(side, F.lit(k)), F.lit(0.0)) / reach) + more

    def celled(wider: int) -> DataFrame:
        ranges = [F.sequence(strip("lo", k, -wider), strip("hi", k, wider)) for k in (0, 1)]
        return boxes.withColumn("c0", F.explode(ranges[0])).withColumn("c1", F.explode(ranges[1]))

    left, right = celled(0).alias("l"), celled(1).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("label", "width", "c0", "c1")]
    gaps = F.zip_with(F.zip_with("l.lo", "r.hi", lambda x, y: x - y), F.zip_with("r.lo", "l.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)
    met = left.join(right, same).filter((F.col("l.tile") <= F.col("r.tile")) & (far <= reach * reach + SLACK))
    return met.select(F.col("l.tile").alias("a"), F.col("r.tile").alias("b")).distinct()


class Side:
    """One tile in a comparison: vectors as given, turned, and their suffix norms at every step."""

    def __init__(self, matrix: np.ndarray, rotations: dict[int, np.ndarray]) -> None:
        self.given = matrix.astype(np.float64)
        self.given /= np.abs(self.given).max(axis=1, keepdims=True)
        self.norm = np.sqrt((self.given * self.given).sum(axis=1))
        self.axes = turned(matrix, rotations)
        width = matrix.shape[1]
        self.steps = [0, *(BOX << k for k in range(64) if BOX << k < width), width]
        squares = np.cumsum((self.axes * self.axes)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.hstack([squares, np.zeros((len(matrix), 1))])[:, self.steps[1:]])


def block_links(a: Side, i: slice, b: Side, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places, inside the slices, of the pairs whose cosine reaches the threshold."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    dense = np.zeros((i.stop - i.start, j.stop - j.start))
    steps = list(pairwise(a.steps))
    for turn, (first, after) in enumerate(steps):
        dense += a.axes[i, first:after] @ b.axes[j, first:after].T
        able = dense + a.rest[i, turn, None] * b.rest[None, j, turn] >= threshold - SLACK
        n = np.count_nonzero(able)
        if not n:
            return none
        if n < dense.size // 16:
            break
    x, y = np.nonzero(able)
    sums = dense[x, y]
    for turn in range(turn + 1, len(steps)):  # few pairs are left: they go on alone
        first, after = steps[turn]
        sums = sums + np.einsum("ij,ij->i", a.axes[i.start + x, first:after], b.axes[j.start + y, first:after])
        able = sums + a.rest[i.start + x, turn] * b.rest[j.start + y, turn] >= threshold - SLACK
        x, y, sums = x[able], y[able], sums[able]
    if len(x) >= dense.size // 16:
        cosine = (a.given[i] @ b.given[j].T)[x, y]
    else:
        cosine = np.einsum("ij,ij->i", a.given[i.start + x], b.given[j.start + y])
    fine = cosine / (a.norm[i.start + x] * b.norm[j.start + y]) >= threshold
    return x[fine], y[fine]


def compare_tiles(a: Side, b: Side | None, copies_a: np.ndarray, copies_b: np.ndarray, threshold: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (those of ``a``, then those of ``b``) to others' copies, and its forest's root."""
    alone = b is None
    right = a if alone else b
    base = 0 if alone else len(a.given)
    links, degree = Links(base + len(right.given)), np.zeros(base + len(right.given), np.int64)
    for i in range(0, len(a.given), block):
        rows = slice(i, min(i + block, len(a.given)))
        for j in range(i if alone else 0, len(right.given), block):
            x, y = block_links(a, rows, right, slice(j, min(j + block, len(right.given))), threshold)
            x, y = x + i, y + j
            if alone:
                x, y = x[x < y], y[x < y]
            np.add.at(degree, x, copies_b[y])
            np.add.at(degree, y + base, copies_a[x])
            links.add(x, y + base)
    return degree, links.label


def linked(tiles: DataFrame, rotations: dict[int, np.ndarray], threshold: float, block: int = BLOCK) -> DataFrame:
    """``node, links, up``: from each pair of tiles, the vectors with links in it, how many copies these
    reach, and a vector of the same component (perhaps itself). A node is a place in a tile."""
    reach = float(np.sqrt(2 - 2 * threshold))
    shared = tiles.sparkSession.sparkContext.broadcast(rotations)  # bounded as above
    body = [F.col(c) for c in ("width", "copies", "matrix")]
    left, right = (tiles.select(F.col("tile").alias(x), F.struct(*body).alias(f"of_{x}")) for x in "ab")
    pairs = meeting_tiles(tiles, reach).join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("up", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            a, b = pair.column(0)[0].as_py(), pair.column(1)[0].as_py()
            sides, copies = [], []
            for place in (2, 3) if a != b else (2,):
                width, n, matrix = (pair.column(place).field(k) for k in range(3))
                copies.append(n.flatten().to_numpy())
                raw = matrix[0].as_buffer()
                kind = "<f8" if raw.size == 8 * len(copies[-1]) * width[0].as_py() else "<f4"
                sides.append(Side(np.frombuffer(raw, kind).reshape(-1, width[0].as_py()), shared.value))
            degree, label = compare_tiles(sides[0], sides[1] if a != b else None, copies[0], copies[-1], threshold, block)
            nodes = np.concatenate([tile * _PLACES + np.arange(len(n)) for tile, n in zip((a, b), copies)])
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(degree[some]), pa.array(nodes[label[some]])], schema=schema)

    return pairs.mapInArrow(compare, "node long, links long, up long")


def nodes_of(tiles: DataFrame, kind: str) -> DataFrame:
    """``node, label, v, least, copies``: the tiles' vectors as rows, ``v`` of type ``kind``."""
    layout = f"node long, label string, v {kind}, least {tiles.schema['least'].dataType.elementType.simpleString()}, copies long"
    schema = arrow_of(tiles.sparkSession.createDataFrame([], layout))
    number = "<f8" if kind == "array<double>" else "<f4"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            label, tile, least, copies = one.column(0)[0], one.column(1)[0].as_py(), one.column(2).flatten(), one.column(3).flatten()
            flat, n = np.frombuffer(one.column(4)[0].as_buffer(), number), len(copies)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // n)), pa.array(flat))
            columns = [pa.array(tile * _PLACES + np.arange(n)), pa.repeat(label, n), lists, least, copies]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return tiles.select("label", "tile", "least", "copies", "matrix").mapInArrow(unpack, layout)


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tile_rows: int = TILE_ROWS, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link if their labels are equal and the cosine is at least ``threshold`` (above -1), which goes
    for repeated rows and equal vectors too. ``component_id`` is the smallest id reachable, the row's
    own included, and ``kept`` says whether it is the row's own. Rows with a null label, or a vector that
    is null, empty, zero or has null or non-finite components link with nothing, nor do vectors of
    different lengths. A null id is never a ``component_id`` unless a component has no other; its row is
    not kept. An empty table gives no row.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = valid_vectors(vectors, id_col, vector_col, label_col)
    kind = rows.schema["v"].dataType.simpleString()
    classes = rows.filter("fine").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "vector-classes")
    rotations = fit_rotations(classes, sample)
    tiles = stored(tiles_of(classes, rotations, reach, min(tile_rows, _PLACES)), "vector-tiles")
    found = stored(linked(tiles, rotations, threshold, block), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b")).distinct())
    nodes = nodes_of(tiles, kind).join(links, "node", "left").join(roots, "node", "left")
    nodes = stored(nodes.withColumn("root", F.coalesce("root", "node")), "vector-nodes")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    known = attach(nodes, ids, ["root"], "size", F.col("node"))
    known = known.select("label", "v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    some = attach(rows.filter("fine").drop("fine"), known, ["label", "v"], "copies", F.col("vec_id"), "inner").select("vec_id", "n_links", "component_id")
    others = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = some.union(others)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
