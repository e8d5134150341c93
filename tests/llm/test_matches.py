"""SimHash groups, personal data, licenses, top-k and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rosterops.llm import licenses, pii, simhash, topk


def groups(codes, bits):
    up = list(range(len(codes)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (int(codes[i]) ^ int(codes[j])).bit_count() <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(codes))]


def near_codes(n, seeds, flips, seed=1):
    random.seed(seed)
    bases = [random.getrandbits(64) for _ in range(seeds)]
    out = {0, (1 << 64) - 1, 7}
    while len(out) < n:
        code = random.choice(bases)
        for _ in range(random.randrange(flips)):
            code ^= 1 << random.randrange(64)
        out.add(code)
    return sorted(out)


def test_links_of_a_block_against_all_pairs():
    codes = np.array(near_codes(700, 3, 9), np.uint64)
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    assert simhash.link_block(np.zeros(len(codes), np.int64), codes, 4).tolist() == groups(codes, 4)
    links = simhash.Links(len(codes))
    for part, base in ((codes[:300], 0), (codes[300:], 300)):
        simhash.join_trees(part, part, 4, links, base, base, True)
    simhash.join_trees(codes[:300], codes[300:], 4, links, 0, 300, False)
    assert links.label.tolist() == groups(codes, 4)


@pytest.mark.parametrize("block_rows", [1 << 18, 40])
def test_components_against_all_pairs(spark, block_rows):
    codes = near_codes(400, 40, 7, seed=block_rows)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.forest(spark.createDataFrame([(c,) for c in signed], "fp long").repartition(6), block_rows=block_rows)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = groups(codes, 4)
    roots = [found.get(c, c) for c in signed]
    assert len(set(zip(roots, want, strict=True))) == len(set(roots)) == len(set(want))


def test_fingerprint_of_odd_texts():
    assert simhash.fingerprint_of("", xxh64_intdigest) == simhash.fingerprint_of(" \n\t\x0b", xxh64_intdigest) == 0
    assert simhash.fingerprint_of("One  TWO", xxh64_intdigest) == xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint_of("a b c d", xxh64_intdigest) == xxh64_intdigest(b"a b c d", 42)
    assert simhash.fingerprint_of("É x", xxh64_intdigest) == xxh64_intdigest("É x".encode(), 42)


def test_groups_of_documents(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(9, base), (4, base), (7, base + " tail"), (2, "quite another text with words of its own"), (None, ""), (5, None), (6, ""), (4, base), (2, "one more text under the same id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", F.lit(1), F.lit("r"), F.lit("y"), F.lit(0)).toDF("doc_id", "text", "FP", "root", "TEXT", "DOC_ID")
    found = simhash.near_duplicates(docs)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found.collect()) == [(0, 5), (2, 2), (2, 2), (4, 4), (4, 4), (5, 5), (6, 5), (7, 4), (9, 4)]
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r[0], r[1]) for r in left.collect()) == sorted([(2, rows[3][1]), (2, rows[8][1]), (4, base), (5, None)], key=lambda x: (x[0], x[1] or ""))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_near_copies_against_all_similarities(spark):
    random.seed(11)
    make = lambda n: [f"w{random.randrange(5_000)}" for _ in range(n)]
    line, texts = make(40), []
    for _ in range(12):
        base = make(random.randrange(30, 200))
        for share in (0, 0.005, 0.02, 0.025, 0.03, 0.05):
            texts.append([w if random.random() >= share else "new" for w in base] + (line if random.random() < 0.3 else []))
    texts += [base[:-k] for k in (1, 9, 12, 20)] + [line, line[:-1], line[:3], line[:4], []]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    up = list(range(len(texts)))
    pairs = [(len(a & b) / len(a | b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j]
    for _ in up:
        for near, i, j in pairs:
            if near >= 0.8:
                up[i] = up[j] = min(up[i], up[j])
    assert sum(0.8 <= near < 0.9 for near, _, _ in pairs) > 10 and sum(0.7 <= near < 0.8 for near, _, _ in pairs) > 5
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {k for k, root in enumerate(up) if k == root}


def test_near_copies_come_through_the_index(spark, monkeypatch):
    calls, forest = [], simhash.forest
    monkeypatch.setattr(simhash, "forest", lambda *args, **more: calls.append(1) or forest(*args, **more))
    base = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, "quite another text with words of its own")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {1, 3} and calls == [1]


def test_sketches_keep_texts_apart_that_share_a_passage(spark):
    random.seed(5)
    def grams(n): return [random.getrandbits(63) for _ in range(n)]  # noqa: E704
    shared = grams(20)
    sets = [np.unique(np.array(shared + grams(80), np.int64)) for _ in range(40)]
    sets.append(np.unique(np.concatenate([sets[0][:-2], np.array(grams(2), np.int64)])))
    for a, b in ((sets[0], sets[1]), (sets[0], sets[-1])):
        bits = int(np.bitwise_count(simhash.sketch_of(a).view(np.uint64) ^ simhash.sketch_of(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2
    rows = [(k, 100, j, k, g, simhash.sketch_of(s).tolist()) for k, s in enumerate(sets) for j, g in enumerate(shared[:11]) if g in s]
    members = spark.createDataFrame(rows, "sid long, n int, place int, root long, gram long, sketch array<long>")
    found = simhash._still_apart(members, 0.8, F.lit(True)).select("sid", "sid_b").distinct().collect()
    assert [tuple(r) for r in found] == [(0, 40)]


def test_pairs_that_only_share_grams_leave_before_their_sets_are_shipped(spark):
    random.seed(6)
    def grams(n): return [random.getrandbits(63) for _ in range(n)]  # noqa: E704
    base = grams(1500)
    sets = [base, base[:-90] + grams(90), base[:700] + grams(800), grams(1500), base[:1000]]
    rows = [(k, len(s), simhash.sketch_of(np.unique(np.array(s, np.int64)), simhash.WIDE).tolist()) for k, s in enumerate(sets)]
    whole = spark.createDataFrame(rows, "sid long, n int, wide array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 5)], "a long, b long")
    assert [tuple(r) for r in simhash.near_sketches(pairs, whole).collect()] == [(0, 1)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fine[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_against_patterns(spark):
    random.seed(6)
    parts = ["a.b", "@", "x-1.org", ".", "1", "255", "256", "0007", "+", " ", "-", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "𝒳", "10.0.0.1", "+1 (415) 555-2671", "a@b.c", "_", "5500005555555559"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(25))) for _ in range(400)]
    texts += [None, "", "1" * 60_000, "a" * 60_000, "a@b" + ".c" * 30_000, "+1" + " " * 40_000, "1.2.3.4 " * 3_000, "1-" * 30_000]
    docs = spark.createDataFrame([(k % 399 or None, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, END string")
    docs = docs.union(docs.filter("doc_id = 5")).repartition(4)
    found = pii.report(pii.find(docs)).collect()
    texts += [t for k, t in enumerate(texts) if (k % 399 or None) == 5]
    got = sorted(",".join(s for s in r["spans"].split(",") if not s.startswith("term")) for r in found)
    assert got == sorted(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)) for t in texts)


def test_terms_that_disclose_a_value(spark):
    secret, plain = "write to zorblatt under jz@mail.org today", "nothing of note happens here at all"
    rows = [(k, f"{'abcdefgh'[k]}words {secret} again{k}") for k in range(5)] + [(k, plain + " today write to" + " x" * k) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.find(docs)
    found = {r["doc_id"]: r["spans"] for r in pii.report(spans).collect()}
    at = rows[0][1].index("zorblatt")
    assert f"term:{at}:{at + 8}" in found[0] and "term" not in found[20]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, spans).collect()}
    assert "write to [TERM]" in clean[0] and "[EMAIL] today" in clean[0] and "jz@" not in clean[0]
    assert all(clean[k] == t for k, t in rows if k >= 10)
    copies = spark.createDataFrame([(k, rows[0][1]) for k in range(9)] + rows[5:], "doc_id long, text string")
    assert not pii.find(copies).filter("kind = 4").count()  # copies of one passage are one context


def test_terms_are_marked_in_the_whole_document(spark):
    far = "lorem é𝒳 " * 60
    told = [f"{'abcdefgh'[k]}words ask Zorblatt or Qy about jz@mail.org {'stuvwxyz'[k]}end {far}later zorblatt signed for qy" for k in range(5)]
    other = [f"zorblatt writes {k} x@y{k}.org" if k == 59 else f"nothing of note {'y' * k} to ask or sign about, lorem é𝒳 later signed for" for k in range(10, 90)]
    docs = spark.createDataFrame(list(enumerate(told + other)) + [(0, told[0]), (None, told[4])], "doc_id long, text string")
    spans = pii.find(docs)
    got = sorted((r["start"], r["end"]) for r in spans.filter("doc_id = 0 and kind = 4").collect())
    want = [m.span() for m in re.finditer("zorblatt|qy", told[0].lower())]
    assert len(want) == 4 and got == want and want[-2][0] - told[0].index("@") > 500
    assert spans.filter("kind = 4 and doc_id is null").count() == 4
    assert not spans.filter("kind = 4 and doc_id >= 5").count()  # there stands no value that the term tells of
    assert sorted(r["n_email"] for r in pii.report(spans).filter("doc_id = 0").collect()) == [1, 1]


def test_personal_data_is_cut_out_whole(spark):
    texts = [(1, "call +1 (415) 555-2671 or 10.0.0.1, a@b.c"), (2, None), (3, "no data 5"), (None, "x a@b.c"), (1, "call +1 (415) 555-2671 or 10.0.0.1, a@b.c"), (4, "+10.0.0.1 00 9 tail")]
    docs = spark.createDataFrame([(*t, 1, "o", 0) for t in texts], "doc_id long, text string, h int, other string, n int").toDF("doc_id", "text", "h", "Text", "doc_ID")
    clean = pii.sanitise(docs, pii.find(docs))
    assert clean.columns == docs.columns
    assert sorted(str(r[1]) for r in clean.collect()) == sorted(["call [PHONE] or [IP], [EMAIL]"] * 2 + ["None", "no data 5", "x [EMAIL]", "[PHONE] tail"])
    assert pii.report(pii.find(docs.limit(0))).count() == 0


def test_license_places_against_search(spark):
    random.seed(8)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "License,", "x", "é", "K", "!"]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(60))) for _ in range(150)] + [None, "", "!!", "CC-BY 4.0", "cc by " * 5_000]
    rows = [(k % 149 or None, t, "v") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, PLACES string")
    found = licenses.report(licenses.scan(docs)).collect()
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def want(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(small))
        hits = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in hits]
        return len(found), len(hits), min(starts, default=-1), max(starts, default=-1), ",".join(sorted({x for _, x in hits}))

    none = lambda x: -1 if x is None else x
    got = sorted((r["n_words"], r["n_base"], none(r["first_word"]), none(r["last_word"]), r["base_labels"]) for r in found)
    assert got == sorted(want(t) for _, t, _ in [*rows, rows[5], rows[5]])


def test_changed_license_wording_is_found(spark):
    text = "Permission is hereby freely granted, free of charge, to any person obtaining one copy of this software"
    docs = spark.createDataFrame([(1, text), (2, "free of charge to any person")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.report(licenses.scan(docs)).collect()}
    assert found[1]["labels"] == "mit" and found[1]["base_labels"] == "" and 0.7 < found[1]["score"] < 1
    assert found[2]["labels"] == "" and found[2]["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_of_a_list_are_all_found(spark):
    lesser, affero = "GNU Lesser General Public License", "GNU Affero General Public License"
    texts = [
        f"{lesser}, Mozilla Public License", f"Mozilla Public License, Eclipse Public License, {affero}, X Public License, Y Public License",
        f"{lesser} {lesser}, Public License", f"{lesser} or {affero}", "Public License, Mozilla Public License", "gnu lesser and general public license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["label"], s["start"], s["end"], s["score"]) for s in r["spans"]] for r in licenses.scan(docs).collect()}
    assert found[0] == [("lgpl", 0, 5, 1.0)] and found[1] == [("agpl", 6, 11, 1.0)]
    assert found[2] == [("lgpl", 0, 5, 1.0), ("lgpl", 5, 10, 1.0)]
    assert found[3] == [("agpl", 6, 11, 1.0), ("lgpl", 0, 5, 1.0)]
    assert found[4] == [] and found[5] == [("lgpl", 0, 6, 0.75)]


@pytest.mark.parametrize(("chunk", "block"), [(16_384, 256), (7, 3)])
def test_top_k_against_all_products(spark, chunk, block):
    random.seed(9)
    rows = [(k, [random.choice([0.0, 0.1, -0.3, 0.5]) for _ in range(5)]) for k in range(60)]
    odd = [(100, None), (120, [1.0, None]), (140, [float("nan"), 1.0]), (160, [float("inf")]), (None, [1.0] * 5), (180, []), (7, rows[7][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, SCORE int")
    got = topk.top_k(topk.quantised(vectors), F.col("vec_id") % 20 == 0, 4, chunk, block).collect()
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in [*rows, (180, [])]}
    for q in (0, 20, 40, 180):
        dots = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == [(k + 1, *d) for k, d in enumerate(dots)]
    assert {r["query_id"] for r in got} == {0, 20, 40, 180}
    assert topk.top_k(topk.quantised(vectors.limit(0)), F.lit(True)).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(k, [2.0**k, -(2.0**15), 1.0 - 2.0 ** (25 - k)]) for k in range(25)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantised(vectors, scale=1), F.col("vec_id") >= 24, 3, 4, 2).collect()
    dots = sorted((-sum(int(np.floor(a)) * int(np.floor(b)) for a, b in zip(rows[24][1], v)), i) for i, v in rows[:24])[:3]
    assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got) == [(k + 1, *d) for k, d in enumerate(dots)]


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    random.seed(10)
    vocab = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    make = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    item, base = make(30), make(200)
    rows = [(1, base), (2, base), (3, base + " one"), (4, make(50) + " " + item), (5, "?? 12"), (6, None), (7, make(80) + " a@b.org"), (8, make(90)), (None, make(70))]
    docs = spark.createDataFrame([(i, t, "en" if i != 8 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == {1, 2, 3, 4, 7, 8, None} and seen[1] == {1, 4, 7, 8, None} and seen[2] == seen[3] == {1, 7, 8, None}
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert kept[7]["text"].endswith("[EMAIL]") and kept[7]["n_chars"] == len(kept[7]["text"]) and kept[8]["lang"] == "en"
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {1, 7, 8, None}


def test_pipeline_hands_few_rows_to_python_at_a_time(spark):
    import corpus_pipeline

    name, before = corpus_pipeline.BATCH_CONF, spark.conf.get(corpus_pipeline.BATCH_CONF)
    docs = spark.range(4000).coalesce(1).selectExpr("id as doc_id", "'some text' as text", "'en' as lang", "'s' as source", "9 as n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32())], ["n"])

    try:
        for given, most in (("10000", 500), ("100", 100), ("0", 500)):
            spark.conf.set(name, given)
            corpus_pipeline.in_small_batches(lambda s, d, _: d)(spark, docs, "")
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n int").collect()) == most
        spark.conf.set(name, "10000")
        corpus_pipeline.identify_language(spark, docs, "")
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, before)
