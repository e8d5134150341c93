"""Substring joins inside a key, and grams as long as a needle allows."""

import random

from rosterops.operators import search, substring
from rosterops.operators.substring import containing


def test_needles_of_a_key_meet_its_texts_only(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("ab\n") for _ in range(n))
    needles = [(k, k % 4 if k % 9 else None, word(random.choice((1, 2, 3, 5, 9, 17)))) for k in range(80)]
    texts = [(k, k % 5 if k % 7 else None, word(random.randrange(40))) for k in range(60)]
    n = spark.createDataFrame(needles, "n long, m long, w string")
    t = spark.createDataFrame(texts, "t long, u long, body string")
    want = sorted((a, b) for a, m, w in needles for b, u, body in texts if m is not None and m == u and w in body)
    for most in (10**6, 300, 0):  # all keys in one task each, some, none
        got = substring.containing(n, t, "w", "body", ["n", "m"], ["t", "u"], within=("m", "u"), automaton_needles=1, group_chars=most)
        assert sorted((r["n"], r["t"]) for r in got.collect()) == want


def test_long_needles_are_probed_by_long_grams(spark):
    names = spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(300)], "n long, w string").withColumnRenamed("w", "_w").selectExpr("_w", "0 as _in")
    own = substring._postings(names, ["_in", "_w"], "_w", substring.gram_sizes("_w"))
    assert {len(r["_g"]) for r in own.select("_g").distinct().collect()} == {16}
    n = spark.createDataFrame([(1, "Customer#000000007"), (2, "ab"), (3, "abcd efg")], "n long, w string")
    t = spark.createDataFrame([(k, f"Customer#{k:09d}/1994 abcd efg"[: 20 + k]) for k in range(20)], "t long, body string")
    got = substring.containing(n, t, "w", "body", ["n"], ["t"], automaton_needles=0)
    want = sorted((k, r["t"]) for r in t.collect() for k, w in ((1, "Customer#000000007"), (2, "ab"), (3, "abcd efg")) if w in r["body"])
    assert sorted((r["n"], r["t"]) for r in got.collect()) == want


def test_no_needles_read_no_text(spark):
    needles, texts = spark.createDataFrame([(1, "")], "n long, word string"), spark.createDataFrame([(7, "abc")], "k long, body string")
    pairs = containing(needles, texts, "word", "body", ["n"], ["k"])
    assert "found(" not in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.columns == ["n", "word", "k", "body"] and pairs.count() == 0


def test_evidence_at_its_place_is_not_looked_for_in_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, doc_name string")
    blocks = spark.createDataFrame([(1, 1, "p", "xx needle"), (1, 2, "q", "needle needle"), (2, 1, "r", "the needle")], "doc_id long, block_idx int, block_id string, text string")
    rows = [("kept", 1, "a", "p", 1, 3, 9, None, None, "needle", "", "", False), ("moved", 2, "b", "gone", 3, 0, 6, None, None, "needle", "the ", "", False)]
    evidence = spark.createDataFrame(rows, "source_id string, doc_id long, doc_name string, block_id string, block_idx int, s_start int, s_end int, g_from int, g_to int, "
                                     "text string, before_text string, after_text string, selection boolean")
    asked = []
    monkeypatch.setattr(search, "containing", lambda needles, *a, **k: asked.append({r["source_id"] for r in needles.collect()}) or containing(needles, *a, **k))
    found = {r["source_id"]: (r["tier"], r["new_doc"], r["new_idx"], r["new_start"]) for r in search.resolve_evidence(evidence, docs, blocks).collect()}
    assert found == {"kept": (2, 1, 1, 3), "moved": (6, 2, 1, 4)} and set().union(*asked) == {"moved"}
