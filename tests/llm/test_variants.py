"""Spelling variants, source divergence and near vectors against brute force."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from rosterops.llm import divergence, embeddings, spelling
from rosterops.llm.frames import whole_groups


def test_whole_groups_over_batches():
    rng = random.Random(5)
    keys = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(60))
    table = pa.table({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "i": list(range(60))})
    for size in (1, 2, 7, 60):
        batches = [b for first in range(0, 60, size) for b in table.slice(first, size).to_batches()] + [pa.RecordBatch.from_pylist([], table.schema)]
        found = []
        for part, starts in whole_groups(iter(batches), 2):
            for first, after in zip(starts, np.append(starts[1:], len(part))):
                found.append([(r["a"], r["b"]) for r in part.slice(first, after - first).to_pylist()])
        assert [g[0] for g in found] == sorted(set(keys)) and sum(found, []) == keys
    assert list(whole_groups(iter([]), 1)) == []


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variant_rows(words, factor=10):
    out, forms = [], {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        fits = best is not None and words[best] >= factor * n
        forms[w] = best if fits else None
        out.append([w, forms[w], None, n, len(others), words[best] if fits else None])
    for row in out:
        row[2] = row[0]
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block, classes", [(1 << 14, 8), (6, 2), (3, 1)])
def test_variants_against_all_pairs(spark, block, classes):
    rng = random.Random(block)
    words = {}
    while len(words) < 220:
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(7, 10)))
        words[word] = rng.choice([2, 3, 30, 30, 400, 5000])
    words["z" * 300] = 7
    words["z" * 301] = 80
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert sorted(tuple(r) for r in spelling.variants(rows, block=block, classes=classes).collect()) == variant_rows(words)
    none = spelling.variants(rows.filter("n < 0"), block=block, classes=classes)
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_tiles_of_a_cell(monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 5)
    rng = np.random.default_rng(2)
    full = np.unique(rng.integers(97, 99, (40, 7)).astype(np.uint32), axis=0)
    role = np.zeros(len(full), np.int32)
    a, b = spelling.near_pairs(role, None, full, np.zeros((0, 8), np.uint32))
    want = {(i, j) for i in range(len(full)) for j in range(i) if (full[i] != full[j]).sum() == 1}
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


def test_word_counts_against_patterns(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_CHARS", 5)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdEÉé× -Ā中.") for _ in range(rng.randrange(400))) for _ in range(40)] + [None, "", "x" * 50, "Abcdefgh abcdefgH ABCDEFGH"]
    rows = [(k if k % 7 else None, t, "more") for k, t in enumerate(texts)] + [(5, texts[5], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N string").repartition(3)
    for every in (3, None):
        total = Counter()
        for doc_id, text, _ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                total[run] += 1
        want = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
        found = spelling.word_counts(docs, every=every)
        assert {r["word"]: r["n"] for r in found.collect()} == want and want
    assert spelling.word_counts(docs.filter("doc_id < 0")).count() == 0


def audit_rows(rows, least_docs, top):
    text_of = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts, docs = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text_of(text))
        counts[lang or "", source or ""].update(found)
        docs.update((lang or "", w) for w in set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [w for (l, w), n in docs.items() if l == lang and n >= least_docs]
        groups = {s: c for (l, s), c in counts.items() if l == lang}

        def prices(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + (10**9 * (count[w] + 5)) // (total + 5 * len(kept)) for w in kept}

        p = {s: prices(c) for s, c in groups.items()}
        q = prices(sum(groups.values(), Counter()))
        for s in groups:
            pair = [(-sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in groups if t != s]
            term = [(q[w] - p[s][w], w) for w in kept if groups[s][w] > 0 and p[s][w] > q[w]]
            for part, some in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("unit_terms, in_block, columns", [(2048, 64, 1024), (3, 2, 7)])
def test_audit_against_all_terms(spark, unit_terms, in_block, columns):
    rng = random.Random(unit_terms)
    names = ["aa", "Bb", "éé", "中", "cc", "dd", "Ee", "ff", "gg", "hh", "\U0001f600"]
    rows = [(rng.choice(["x", "y", None]), rng.choice(["s", "t", "u", "", None, "v"]), " ".join(rng.choice(names[: rng.randrange(1, 12)]) for _ in range(rng.randrange(30)))) for _ in range(90)]
    rows += [("x", "s", rows[0][2]), ("x", "s", None), ("lone", "one", "zz"), ("lone", "two", None), ("x", "hot", "aa " * 3000)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "Lang string, source string, text string, TEXT2 string").repartition(4)
    found = divergence.audit(docs, least_docs=4, top=3, unit_terms=unit_terms, in_block=in_block, columns=columns, lang_col="Lang")
    assert sorted(tuple(r) for r in found.collect()) == audit_rows(rows, 4, 3)
    assert divergence.audit(docs.filter("source = 'none'"), lang_col="Lang").count() == 0


def test_prices_hold_whole_numbers_of_any_size(spark):
    big = 10**13
    rows = spark.createDataFrame([(big - 7, 3 * big, 10)], "a long, b long, c long")
    assert rows.select(divergence.price(rows["a"], rows["b"], rows["c"], 5, 10**9)).first()[0] == 1 + 10**9 * (big - 2) // (3 * big + 50)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART_CHARS", 3)
    assert sum(divergence.terms_of("ab écd-Efgh中 i"), []) == ["ab".encode(), "écd".encode(), "efgh中".encode(), b"i"]
    assert list(divergence.terms_of("")) == []


def vector_rows(rows, threshold):
    """Links of all pairs, by double-precision cosines."""
    good = []
    for _, v, label in rows:
        fine = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        good.append(np.array(v, np.float64) if fine else None)
    up, degree = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(good):
        for j, b in enumerate(good[:i]):
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                degree[i] += 1
                degree[j] += 1
                up[top(i)] = top(j)
    least = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[top(k)] = min(least.get(top(k), vec_id), vec_id)
    return sorted(((r[0], d, least.get(top(k)), r[0] is not None and least.get(top(k)) == r[0]) for k, (r, d) in enumerate(zip(rows, degree))), key=str)


@pytest.mark.parametrize("tile_rows, block, threshold", [(8192, 512, 0.98), (7, 3, 0.98), (16, 4, 0.7)])
def test_near_vectors_against_all_pairs(spark, tile_rows, block, threshold):
    rng = np.random.default_rng(tile_rows)
    centres = rng.normal(size=(12, 20)) + 1
    rows = []
    for k in range(200):
        v = (centres[rng.integers(12)] + rng.normal(size=20) * rng.choice([0.02, 0.1, 0.4])) * rng.choice([1e-3, 1, 1e3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    hot = rows[3][1]
    rows += [(300 + k, hot, rows[3][2]) for k in range(30)] + [(3, hot, rows[3][2]), (400, [2 * x for x in hot], rows[3][2]), (None, hot, rows[3][2])]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 20, 1), (503, [float("nan")] * 20, 1), (504, [None] + [1.0] * 19, 1), (505, [float("inf")] * 20, 1), (506, hot, None)]
    rows += [(507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0), (509, [-1.0, -2.0], 0), (510, [1.0], 0), (511, [7.0], 0), (None, None, None)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, Node int").repartition(5)
    found = embeddings.near_vectors(vectors, threshold, tile_rows=tile_rows, block=block, sample=100)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == vector_rows(rows, threshold)


def test_near_vectors_of_text_ids_and_large_numbers(spark):
    rows = [("b", [1e300, 1e300], "x"), ("a", [1e-300, 1e-300], "x"), ("c", [1e300, -1e300], "x"), ("a", [1e300, 1e300], "y")]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embeddings.near_vectors(vectors).collect()) == [("a", 0, "a", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    assert embeddings.near_vectors(vectors.filter("label = 'z'")).count() == 0


def test_pairs_that_cannot_reach_are_dropped_early():
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(64, 40))
    side = embeddings.Side(matrix, {})
    x, y = embeddings.block_links(side, slice(0, 32), side, slice(32, 64), 0.98)
    assert not len(x)
    near_ones = np.vstack([matrix[:32], matrix[:32] + 0.01])
    side = embeddings.Side(near_ones, {})
    x, y = embeddings.block_links(side, slice(0, 32), side, slice(32, 64), 0.98)
    assert x.tolist() == y.tolist() == list(range(32))
