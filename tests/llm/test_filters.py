"""URL rules, decontamination, language ID and quality."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterops.llm import decontam, langid, quality, urlrules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr/x", "block"), ("b.org", "", "block"), ("b.org", "", "allow")]


def judged(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"), default=None)
    return (best[0] + best[1], best[2]) if best else (None, "allow")


@pytest.mark.parametrize("most", [500_000, 2])
def test_url_rules_against_all_rules(spark, most):
    random.seed(2)
    hosts = ["net", "x.net", "EXAMPLE.net", "w.example.net", "example.com", "badexample.com", "org", "A.org", "q.a.org", "b.org", "", "a..org"]
    paths = ["", "/", "/en", "/en/", "/en/5", "/english/", "/de/1", "/fr/", "/fr/xy", "/fr/x/y", "//fr/"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?u=http://net/", "#t/?")] + [None, "", "no-scheme.net/", "http:/x.net/", "://"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, HOST string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", None, "block"), ("net", "/en/", "maybe")], "host string, path string, verdict string")
    found = {r["page_id"]: r for r in urlrules.judge(pages, rules, most=most).collect()}
    assert len(found) == len(urls)
    for k, url in enumerate(urls):
        cut = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (cut[1].lower(), cut[2]) if cut else ("", "")
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, *judged(host, path)), url


def test_url_rules_of_nothing(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert urlrules.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in urlrules.judge(one, rules, default="block").collect()] == ["block", "block"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(text, items, window):
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        cut = words(item)
        n = min(len(cut), window)
        cuts = {tuple(cut[k : k + n]) for k in range(len(cut) - n + 1)} if n else set()
        for k in range(len(doc) - n + 1):
            if tuple(doc[k : k + n]) in cuts:
                hit |= set(range(k, k + n))
                names |= {name} if name is not None else set()
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize(("shard", "block"), [(1 << 19, 32 << 20), (3, 40)])
def test_decontamination_against_all_windows(spark, shard, block):
    random.seed(3)
    some = ["a", "B", "c", "é", "7"]
    make = lambda n: " ".join(random.choice(some) + random.choice(["", ",", "."]) for _ in range(n))
    items = [(f"i{k}", make(random.choice([1, 2, 3, 5, 8, 12]))) for k in range(12)] + [("i0", "x y z q r"), ("none", None), ("empty", ""), ("marks", "?!"), (None, "x y z q")]
    items.append(items[3])
    texts = [make(random.randrange(40)) for _ in range(25)] + [None, "", "...", "x Y z q r x y Z q", "ÉCOLE é"]
    docs = spark.createDataFrame([(k if k % 7 else None, t, k, "m") for k, t in enumerate(texts)], "doc_id long, text string, k int, m string").toDF("doc_id", "text", "k", "TEXT")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.leak_report(decontam.find_leaks(docs, bench, window=4, shard_words=shard, block_bytes=block)).collect()
    got = sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    want = sorted((*w, w[1] > 0) for w in (leaks(t, items, 4) for t in texts))
    assert got == want
    left = decontam.remove_leaks(docs, bench, window=4)
    assert left.columns == docs.columns
    assert sorted(r["k"] for r in left.collect()) == [k for k, t in enumerate(texts) if not leaks(t, items, 4)[1]]


def test_decontamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r)[1:4] for r in decontam.leak_report(decontam.find_leaks(docs, none)).collect()] == [(2, 0, 0)]
    assert decontam.find_leaks(docs.limit(0), none).count() == 0


def greedy(text, sample):
    """Phrases of a text: each the longest that occurs in the sample."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        count += 1
    return count


def test_phrases_against_greedy_search():
    random.seed(4)
    samples = {"x": ["abab cab. Abba", "caab"], "y": ["cccb", "bcbc cb"]}
    model = langid.Model(samples)
    flat = {name: " " + " ".join("".join(chr(c) if c else " " for c in langid.letters_of(t)) for t in some) + " " for name, some in samples.items()}
    texts = ["".join(random.choice("abc zé!?") for _ in range(random.randrange(1, 300))) + "a" for _ in range(40)]
    found = model.phrases([model.code(langid.letters_of(t)) for t in texts])
    for text, row in zip(texts, found, strict=True):
        clean = "".join(chr(c) if c else " " for c in langid.letters_of(text))
        assert row.tolist() == [greedy(clean, flat[name]) for name in model.languages]


@pytest.mark.parametrize("dense", [0, 2, 7])
def test_sparse_edges_are_as_good_as_a_table(dense):
    random.seed(4)
    samples = {name: ["".join(random.choice("abcdefghij kl"[k:]) for _ in range(300)) for _ in range(3)] for k, name in enumerate("xyz")}
    few, all_ = langid.Model(samples, dense), langid.Model(samples)
    assert few.width == dense + 3 and all_.width == 15 and len(few.keys) > 0 == len(all_.keys)
    texts = ["".join(random.choice("abcdefghijklqé !") for _ in range(random.randrange(1, 700))) + "a" for _ in range(40)]
    assert few.costs(texts).tolist() == all_.costs(texts).tolist()


def test_languages_of_thousands_of_letters():
    random.seed(6)
    pools = {"p": [chr(0x4E00 + k) for k in range(3_000)], "q": [chr(0x4E00 + k) for k in range(3_000)], "latin": list("abcdefgh")}
    words = {name: ["".join(random.choices(pool, k=3)) for _ in range(4_000)] for name, pool in pools.items()}
    text = lambda name, n: " ".join(random.choices(words[name], k=n))
    model = langid.Model({name: [text(name, 90) for _ in range(64)] for name in pools})
    wanted = [name for name in pools for _ in range(40)]
    best = [model.languages[k] for k in model.costs([text(name, 60) for name in wanted]).argmin(axis=1)]
    assert best == wanted and model.span > 2_900 and model.table.nbytes < 200 << 20


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 !?", "s"), (4, "THE DOG", "s"), (None, "die Katze " * 3000, "s"), (4, "THE DOG", "s")], "doc_id long, text string, bits string")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(train)).collect()
    assert sorted((r["lang_pred"], r["doc_id"]) for r in found if r["doc_id"]) == [("en", 4), ("en", 4), ("und", 1), ("und", 2), ("und", 3)]
    assert [r["lang_pred"] for r in found if r["doc_id"] is None] == ["de"]
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.identify(docs.select("doc_id", "text").limit(0), nothing).count() == 0


def test_copies_take_no_language_from_the_sample(spark):
    texts = [(f"{'ab' * k} {'ba' * (k % 7)} cd", "x") for k in range(1, 101)] + [("the cat and the dog", "en")]
    train = spark.createDataFrame(texts, "text string, lang string")
    copies = train.filter("lang = 'x'").crossJoin(spark.range(2_000).select()).union(train)
    want, got = langid.fit(train), langid.fit(copies)
    assert got.languages == want.languages == ["en", "x"] and got.weights.tolist() == want.weights.tolist()
    assert got.table.tolist() == want.table.tolist()


def test_languages_held_out(spark):
    from rosterops.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.01"
    found = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("lang")).first()
    assert n > 200 and right > 0.98


def test_quality_held_out(spark):
    from rosterops.llm.queries import op8_quality

    sf = "/root/testdata/sf0.01"
    scored = op8_quality(spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    found = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("quality")).first()
    assert n > 50 and right > 0.95


def test_rules_are_paths_and_columns(spark):
    text = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    rules = quality.tree_rules(text, ["a", "b"])
    assert rules == [(("a", "<=", 1.5),), (("a", "<=", 1.5), ("b", "<=", 2.0)), (("a", "<=", 1.5), ("b", ">", 2.0)), (("a", ">", 1.5),)]
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (2.0, 1.0)], "a double, b double")
    scores = [r[0] for r in rows.select(quality.Ensemble(((rules[2], 2.0),), 0.0).score()).collect()]
    assert scores[0] == scores[2] == 0.5 and scores[1] > 0.85


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, ""), (4, "w " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    assert sorted((r["doc_id"], r["label"]) for r in quality.labelled(stats, labels).collect()) == [(2, 1), (2, 1)]
    for known in (quality.labelled(stats, labels), quality.labelled(stats, labels.limit(0))):
        assert [r[0] for r in stats.select(quality.fit(known).score().between(0, 1)).collect()] == [True] * 5
    assert quality.statistics(docs.limit(0)).count() == 0
