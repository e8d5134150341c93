"""Tokens, packing and wavelet files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterops.llm import packing, wavelet
from rosterops.llm.frames import new_folder
from rosterops.llm.queries import vocabulary
from rosterops.llm.tokens import Encoder, with_end

TOOL = Encoder(vocabulary())
PIECES = ["word", "Word,", "stop.", "İz", "Σ", "don't", "'s", "क़", "é", "x̸", ".̸", " ", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "...", ".,", "12", "é.", "\n", "", "漢字"]


def plain(text):
    return TOOL.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([" ", "", "\n"])), max_size=8), max_size=4))
def test_ids_are_the_librarys(parts):
    texts = ["".join(a + b for a, b in part) for part in parts]
    if texts:
        found = with_end(*TOOL.encode(texts), 7)
        assert [ids.tolist() for ids in found] == [[*plain(text), 7] for text in texts]


ROWS = [(3, "Some words, and more."), (1, None), (2, ""), (None, "no id"), (3, "Some words, and more."), (5, "long " * 5000), (3, "other text of three")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return rows.select("*", F.lit(1), F.lit("x"), F.lit("y")).toDF("doc_id", "text", "IDS", "start", "TEXT")


def test_packing_cuts_without_gap_or_loss(spark, docs):
    pieces = packing.pack(docs, vocabulary(), end_id=1, width=64)
    found = pieces.collect()
    rows = {}
    for p in found:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        rows.setdefault(p["sequence_id"], []).append(p)
    flat = []
    for number in range(len(rows)):
        at = 0
        for p in sorted(rows[number], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            flat.append(p)
        assert at == 64 or number == len(rows) - 1
    want = sorted(np.array([*plain(text or ""), 1], "<u4").tobytes() for _, text in ROWS)
    got, part = [], b""
    for p in flat:  # in the order of the long row a document's pieces follow one another
        part += p["ids"]
        if len(part) == 4 * p["doc_tokens"]:
            got.append(part)
            part = b""
    assert sorted(got) == want and not part
    lengths = {r["sequence_id"]: (r["length"], len(r["ids"]) // 4) for r in packing.sequences(pieces, 64).collect()}
    assert all(size == (n if n & (n - 1) == 0 else 64) for n, size in lengths.values())


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0


def test_wavelet_matrix_against_lists():
    random.seed(5)
    for n in (1, 7, 511, 512, 513, 3000):
        ids = np.array([random.choice([0, 1, 5, 700, 49407, random.randrange(49408)]) for _ in range(n)], np.uint16)
        matrix = wavelet.WaveletMatrix.build(ids, 16)
        matrix = wavelet.WaveletMatrix(n, matrix.zeros, matrix.packed, [r.tobytes() for r in matrix.ranks])
        assert matrix.all().tolist() == ids.tolist()
        for k in random.sample(range(n), min(n, 40)):
            assert matrix.access(k) == ids[k]
        for value in (0, 5, 49407, 3, 1 << 20):
            places = [k for k, v in enumerate(ids) if v == value]
            assert matrix.rank(value) == len(places)
            assert matrix.rank(value, n // 2) == sum(k < n // 2 for k in places)
            assert [matrix.select(value, k) for k in range(len(places))] == places


def test_files_give_the_ids_back(spark, docs, monkeypatch):
    folder = new_folder(spark, "wavelet")
    wavelet.write_tokens(docs, vocabulary(), folder, end_id=2)
    found = sorted(wavelet.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    at, texts = 0, {}
    for doc_id, text in ROWS:
        texts.setdefault(doc_id, []).append(np.array([*plain(text or ""), 2], "<u4").tobytes())
    for r in found:
        assert r["start"] == at and r["ids"] in texts[r["doc_id"]]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 3, 3, 5]
    token = plain("long")[0]
    assert sum(r["n"] for r in wavelet.count_token(spark, folder, token).collect()) == 5000
    assert sorted(r["place"] for r in wavelet.find_token(spark, folder, token).collect()) == list(range(5000))
    assert zlib.crc32(found[0]["ids"]) == zlib.crc32(np.array([*plain("no id"), 2], "<u4").tobytes())


def test_files_of_nothing(spark):
    folder = new_folder(spark, "wavelet")
    wavelet.write_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary(), folder)
    assert wavelet.read_tokens(spark, folder).count() == 0
