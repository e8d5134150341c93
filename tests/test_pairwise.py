import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterops.functions.normal import loose_offsets
from rosterops.operators import diff, pairwise, review
from rosterops.operators.align import Span, heaviest
from rosterops.operators.pairwise import Judge, Manual, deal, gap_chain
from rosterops.plans.comparison import compare_manuals, compare_pairs, comparison_summary

UNITS = "doc_id long, unit_id string, unit_idx int, text string, title string, page_no int"
PAIRS = [("1-2", 1, 2), ("1-3", 1, 3), ("2-3", 2, 3), ("4-5", 4, 5), ("3-6", 3, 6)]


def manuals(spark, texts):
    rows = [(doc, f"{doc}-{i // 2}", i + 1, t, title, None) for doc, lines in texts.items() for i, (t, title) in enumerate(lines)]
    return spark.createDataFrame(rows, UNITS), spark.createDataFrame(PAIRS, "pair_id string, my_doc long, ref_doc long")


def revisions(rnd):
    """Manuals that are edits of one another: lines changed, dropped, doubled and moved."""
    words = ["飞行", "训练", "检查", "机组", "应当", "每季度", "2次", "B737", "记录", "cabin crew", "check list", "v1.2", "注意", "部门"]
    base = [("".join(rnd.choices(words, k=rnd.randrange(3, 9))) + rnd.choice("。；，"), f"{k // 6 + 1}.{k % 3} 标题" if rnd.random() < 0.7 else "") for k in range(40)]
    out = {}
    for doc in range(1, 7):
        lines = []
        for text, title in base:
            roll = rnd.random()
            if roll < 0.15:
                continue
            if roll < 0.4:
                at = rnd.randrange(len(text) - 1)
                text = text[:at] + rnd.choice(words) + text[at + rnd.randrange(3):]
            lines += [(text, title)] * (2 if roll > 0.9 else 1)
        if doc % 2:
            at = rnd.randrange(len(lines) - 6)
            lines[at:at + 4] = lines[at:at + 4][::-1]
        out[doc] = lines
    return out


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_pairs_in_cells_are_compared_as_pair_by_pair(spark):
    units, pairs = manuals(spark, revisions(random.Random(5)))
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("my").alias("side"), F.col("my_doc").alias("doc_id")), F.struct(F.lit("ref").alias("side"), F.col("ref_doc").alias("doc_id")))).alias("s"))
    apart = compare_manuals(sides.select("pair_id", "s.side", "s.doc_id").join(units, "doc_id").drop("doc_id"))
    cells = compare_pairs(units, pairs)
    assert rows(cells.matches(), apart["matches"].columns) == rows(apart["matches"], apart["matches"].columns)
    events = cells.events()
    assert rows(events, apart["events"].columns) == rows(apart["events"], apart["events"].columns)
    slim = ["pair_id", "event_id", "kind", "title"]
    assert rows(cells.events(texts=False), slim) == rows(events, slim) and {r["kind"] for r in events.collect()} >= {"modified", "reference-added", "reference-removed"}
    whole = comparison_summary(apart)
    assert rows(cells.summary(), whole.columns) == rows(whole, whole.columns)


def test_no_partner_of_a_repeated_line_is_left_out(spark):
    """A line that stands 40 times on both sides finds all 40, not the first 24."""
    same = [("重复的一行文字内容。", "")] * 40
    units, pairs = manuals(spark, {1: same, 2: same})
    found = compare_pairs(units, pairs.limit(1)).matches().agg(F.sum(F.col("my_end") - F.col("my_start")), F.sum(F.col("ref_end") - F.col("ref_start"))).first()
    assert tuple(found) == (40, 40)


def test_each_pair_meets_both_manuals_in_one_cell(spark):
    units, pairs = manuals(spark, revisions(random.Random(1)))
    own = compare_pairs(units, pairs).own
    for size in (30, 100_000):
        dealt, slices = deal(own, pairs, size)
        keys = ["leader", "_x", "_y"]
        copies = {(tuple(r[k] for k in keys), r["doc_id"]): r["n"] for r in slices.groupBy(*keys, "doc_id").agg(F.count("*").alias("n")).collect()}
        sizes = {r["doc_id"]: r["n"] for r in own.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        got = dealt.collect()
        assert sorted((r["pair_id"], r["my_doc"], r["ref_doc"]) for r in got) == sorted(PAIRS)
        assert all(copies[tuple(r[k] for k in keys), r[side]] == sizes[r[side]] for r in got for side in ("my_doc", "ref_doc"))


def _manual(lines, texts):
    held = {"norm": lines, "key": lines, "text": lines, "short": [len(x) < 30 for x in lines], "unit_id": lines, "unit_idx": lines, "page_no": lines, "title": lines, "tokens": lines}
    return Manual(held, texts)


def test_gap_chain_against_all_candidates(monkeypatch):
    """Lists of grams, one by one, and all candidates at once give one chain."""
    rnd = random.Random(3)
    for _ in range(30):
        texts = {}
        mine, theirs = (_manual(["".join(rnd.choices("ab1检查", k=rnd.randrange(6, 12))) for _ in range(rnd.randrange(1, 14))], texts) for _ in range(2))
        n, m = len(mine.norm), len(theirs.norm)
        monkeypatch.setattr(pairwise, "FEW_TEXTS", 10_000)
        one = gap_chain(mine, theirs, 0, n, 0, m, Judge(0.64))
        monkeypatch.setattr(pairwise, "FEW_TEXTS", 0)
        assert gap_chain(mine, theirs, 0, n, 0, m, Judge(0.64)) == one
        judge, spans, right = Judge(0.64), [], [(a, b, t) for a in range(m) for b, t in theirs.windows[a]]
        for start in range(n):
            for end, text in mine.windows[start]:
                equal = [(a, b, t, 1.0) for a, b, t in right if t.norm == text.norm]
                for a, b, t, s in equal or [(a, b, t, judge(text, t)) for a, b, t in right]:
                    if s:
                        cover = min(text.size, t.size)
                        bonus = max(0.0, 1 - abs(start / max(1, n - 1) - a / max(1, m - 1))) * cover * 0.03
                        spans.append((start, a, end, b, cover * (1.25 if equal else s - 0.64 + 0.18) + bonus))
        spans.sort()
        chosen = [spans[k] for k in heaviest([Span(start, end, a, b, w) for start, a, end, b, w in spans])]
        assert [x[:4] for x in one] == [(start, end, a, b) for start, a, end, b, _ in chosen]


def test_category_counts_read_the_events_once(spark):
    kind = F.when(F.col("id") < 9, "added?").when(F.col("id") < 11, "modified").otherwise("review")
    events = spark.range(5, 12).select(kind.alias("kind"), F.lit("T").alias("title"), F.col("id").cast("string").alias("my_text"), F.lit("x Y").alias("ref_text"))
    counts = review.category_counts(events, "1 0")
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Range (5, 12") == 1
    assert {tuple(r) for r in counts.filter("total > 0").collect()} == {("modified", 2, 1), ("review", 1, 0), ("all", 7, 1)}
    assert {tuple(r) for r in review.category_counts(events.limit(0)).collect()} == {(k, 0, 0) for k in [*review.KIND_LABELS, "all"]}
    assert {r["matched"] for r in review.category_counts(events).filter("kind = 'all'").collect()} == {7}


def test_a_source_is_read_only_for_a_focus_and_places_follow_its_characters():
    found = review.normalized_range.func(pd.Series([object(), "a 甲乙", "x"]), pd.Series([None, "甲 乙", "乙"]))  # an object has no translate()
    assert found["start"].isna().tolist() == [True, False, True] and found.iloc[1].tolist() == [2, 4]
    rnd = random.Random(8)
    for _ in range(300):
        source = "".join(rnd.choices("aB½①ﬁ甲乙,。 \n😀ß９", k=rnd.randrange(1, 30)))
        loose, at = loose_offsets(source)
        kept = [(c, i) for c, i in zip(loose, at) if c.isascii() and c.isalnum() or "一" <= c <= "鿿"]
        body = "".join(c for c, _ in kept)
        for start, size in ((k, n) for k in range(len(body)) for n in (1, 2, 5) if k + n <= len(body)):
            assert review.source_range(source, start, size) == (kept[start][1], kept[start + size - 1][1] + 1)
        assert source.translate(review.KEPT) == body


def test_one_sided_texts_need_no_common_places(monkeypatch):
    monkeypatch.setattr(diff, "TailRows", lambda *a: pytest.fail("no rows are needed"))
    assert diff.diff("甲  乙", "") == {"left": [{"kind": "removed", "text": "甲 乙"}], "right": []}
    assert diff.diff("", "b") == {"left": [], "right": [{"kind": "added", "text": "b"}]} and diff.diff(" ", None) == {"left": [], "right": []}
