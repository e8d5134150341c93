"""Search, location, layout and comparison of documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rosterops.operators import locate as L
from rosterops.operators import manual as M
from rosterops.operators import review as V
from rosterops.operators import search as S
from rosterops.operators import align
from rosterops.operators.align import Span, best_chain, gap_candidates, heaviest, increasing_chain
from rosterops.operators.events import sort_events, text_similarity
from rosterops.operators.slices import plain
from rosterops.plans.comparison import compare_manuals, comparison_summary
from rosterops.sources import text_blocks as T


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "手册A", "1.1 总则\n第一条 飞行员 应当检查\tA１２。\n飞行员飞行员"), (2, "手册B", "abc def\nABC-def飞行 员\n员")], "doc_id long, doc_name string, text string")


@pytest.fixture(scope="module")
def blocks(docs):
    cut = T.split_blocks(docs, "doc_id", "doc_name", "text")
    return T.with_running_title(cut, T.is_heading("line")).withColumn("block_id", F.concat_ws("-b", F.col("doc_id").cast("string"), F.col("block_idx").cast("string")))


def test_blocks(blocks):
    rows = {(r["doc_id"], r["block_idx"]): (r["text"], r["title"]) for r in blocks.collect()}
    assert rows[(1, 2)][0] == "第一条 飞行员 应当检查 | A１２。" and rows[(1, 3)][1].startswith("第一条") and rows[(2, 1)][1] == ""


def test_keyword_hits(spark, blocks):
    items = spark.createDataFrame([(1, "飞行员"), (2, "a12"), (3, "abcdef"), (4, "员"), (5, "，"), (6, "检")], "item_id long, keyword string")
    hits = {(r["item_id"], r["doc_id"], r["block_idx"], r["start"], r["end"], r["mode"]) for r in S.keyword_hits(blocks, items).collect()}
    assert {h for h in hits if h[0] != 4} == {
        (1, 1, 2, 4, 7, "exact"), (1, 1, 3, 0, 3, "exact"), (1, 1, 3, 3, 6, "exact"), (1, 2, 2, 7, 11, "loose"), (2, 1, 2, 15, 18, "loose"), (3, 2, 1, 0, 7, "loose"), (3, 2, 2, 0, 7, "loose")}
    assert {h[1:3] for h in hits if h[0] == 4} == {(1, 2), (1, 3), (2, 2), (2, 3)}
    counts = {r["item_id"]: r["hits"] for r in S.hit_counts(items, S.keyword_hits(blocks, items)).collect()}
    assert counts[5] == 0 and counts[6] == 0 and counts[1] == 4


def test_keyword_hits_come_a_few_rows_at_a_time(spark, monkeypatch):
    emits = []
    frame = spark.createDataFrame([(1, 1, k, "ab abab", "ab", "ab") for k in range(200)], "item_id long, doc_id long, block_idx int, text string, keyword string, loose_key string")
    monkeypatch.setattr(S, "candidate_blocks", lambda *_: type("Rows", (), {"mapInArrow": lambda self, emit, schema: emits.append(emit) or frame.mapInArrow(emit, schema)})())
    assert S.keyword_hits(None, None).count() == 600
    sizes = [b.num_rows for b in emits[0](iter(frame.toArrow().combine_chunks().to_batches()))]
    assert sizes == [192, 192, 192, 24]


def test_source_tiers(spark, blocks):
    src = [(1, 1, "1-b2", 2, 4, 7, "飞行员", "第一条 ", "", "飞行员"), (2, 1, "zz", 2, 4, 7, "飞行员", "", "", "飞行员"), (3, 1, "zz", 2, 0, 2, "检查", "应当", "", "x"),
           (4, 1, "zz", 9, 0, 2, "检查", "应当", "", "x"), (5, 1, "zz", 1, 0, 2, "不在", "", "", "总则"), (6, 1, "zz", 9, 0, 1, "飞行员", "", "", "q")]
    sources = spark.createDataFrame(src, "source_id long, doc_id long, old_block_id string, block_idx int, s_start int, s_end int, text string, before_text string, after_text string, keyword string")
    got = {r["source_id"]: (r["tier"], r["new_idx"], r["new_start"]) for r in S.resolve_sources(sources, blocks).collect()}
    assert got == {1: (1, 2, 4), 2: (2, 2, 4), 3: (3, 2, 10), 4: (4, 2, 10), 5: (5, 1, 4), 6: (None, None, None)}
    assert {r["source_id"] for r in S.located_sources(sources, blocks).collect()} == {1}


def test_evidence_tiers(spark, docs, blocks):
    ev = [(1, 1, "手册A", "", None, None, None, 8, 12, "第一条 ", "", "", False), (2, 9, "手册A", "1-b2", None, 4, 7, None, None, "飞行员", "", "", False),
          (3, 1, "手册A", "", 2, 4, 7, None, None, "飞行员", "", "", False), (4, 9, "手册C", "", None, None, None, None, None, "检查", "应当", "", True),
          (5, 1, "手册A", "", 2, 0, 2, None, None, "检查", "应当", "", False), (6, 9, "无", "", None, None, None, None, None, "def飞", "", "", False),
          (7, 1, "手册A", "", None, None, None, None, None, "飞行员飞", "。\n\n", "", True), (8, 1, "手册A", "", None, None, None, None, None, "２。\n\n飞行员", "１", "飞", True),
          (9, 9, "无", "", None, None, None, None, None, "def\n\nABC-def飞行 员\n\n员", "abc ", "", False), (10, 1, "手册A", "", None, None, None, None, None, "２。\n\n飞行员", "９", "", True)]
    evidence = spark.createDataFrame(ev, "source_id long, doc_id long, doc_name string, block_id string, block_idx int, s_start int, s_end int, g_from int, g_to int, text string, before_text string, after_text string, selection boolean")
    got = {r["source_id"]: (r["tier"], r["new_doc"], r["new_idx"], r["new_start"]) for r in S.resolve_evidence(evidence, docs.select("doc_id", "doc_name"), blocks).collect()}
    assert got == {1: (1, 1, 2, 0), 2: (2, 1, 2, 4), 3: (3, 1, 2, 4), 4: (4, 1, 2, 10), 5: (5, 1, 2, 10), 6: (6, 2, 2, 4), 7: (4, 1, 3, 0), 8: (4, 1, 2, 17), 9: (7, 2, 1, 4), 10: (None, None, None, None)}


def test_locate_two_pages(spark):
    first = "4 仓库夜间巡查办法\n4.2 出发之前\n4.2.1 值班员应当先核对钥匙编号，缺一把也不得离开岗亭。\n4.2.2 手电筒电量低于一半时须更换电池并在登记簿写明时间。\n2031/07/19 《仓库值班手册》 12"
    second = "4.2.3 巡查路线\n从北门起沿 B 区货架顺时针行走，全程不少于 40 分钟，遇到漏水处用粉笔画圈并拍照留存。"
    pages = spark.createDataFrame([(1, 11, "前言与目录。"), (1, 12, first), (1, 13, second), (2, 3, "食堂菜单另行公布")], "doc_id long, page_no int, text string")
    evidence = "4.2 出发之前\n值班员应当先核对钥匙编号，缺一把也不得离开岗亭。\n手电筒电量低于一半时须更换电池并在登记簿写明时间。\n从北门起沿B区货架顺时针行走，全程不少于40分钟，遇到漏水处用粉笔画圈并拍照留存。"
    targets = spark.createDataFrame([(1, evidence), (2, "  "), (3, "海边的灯塔每晚十点熄灭\n渔船回港以后才开始修网"), (4, "短")], "target_id long, content string")
    got = {r["target_id"]: (r["status"], r["start_page"], r["end_page"]) for r in L.locate(targets, pages).collect()}
    assert got == {1: ("trusted", 12, 13), 2: ("skip", None, None), 3: ("miss", None, None), 4: ("miss", None, None)}
    sizes = {(r["doc_id"], r["start_page"], r["end_page"]) for r in L.window_sizes(L.page_windows(pages)).collect()}
    assert sizes == {(1, 11, 11), (1, 11, 12), (1, 11, 13), (1, 12, 12), (1, 12, 13), (1, 13, 13), (2, 3, 3)}


def test_layout_units(spark):
    lines = [(p, i, t, r) for p in range(1, 5) for i, (t, r) in enumerate([("公司手册 第1版", 0.1), ("1.1 适用范围" if p == 1 else "续前段落的第一行", 0.3), ("本章规定训练要求", 0.4), ("并适用于全体人员。", 0.5), (str(p), 0.89)])]
    df = spark.createDataFrame([(1, p, i, t, r) for p, i, t, r in lines], "doc_id long, page_no int, line_no long, text string, top_ratio double")
    keys = {r["key"] for r in M.repeated_margin_keys(df).collect()}
    assert "公司手册第1版" in keys and "#" in keys
    units = [(r["page_no"], r["text"], r["title"]) for r in M.layout_units(df).orderBy("unit_idx").collect()]
    assert units[0] == (1, "适用范围本章规定训练要求并适用于全体人员。", "1.1 适用范围")
    assert units[1] == (2, "续前段落的第一行本章规定训练要求并适用于全体人员。", "1.1 适用范围") and len(units) == 4
    long_page = spark.createDataFrame([(1, 1, i, "字" * 100, 0.2 + i / 100) for i in range(9)], "doc_id long, page_no int, line_no long, text string, top_ratio double")
    stored = []
    plan = M.layout_units(df, keep=lambda rows: stored.append(M.cut_lineage(rows)) or stored[-1])._jdf.queryExecution().optimizedPlan().toString()
    assert len(stored) == 2 and "aggregate(" not in plan  # no page is folded again after it is stored
    assert [len(r["text"]) for r in M.layout_units(long_page).orderBy("unit_idx").collect()] == [500, 400]


def test_item_lines(spark):
    items = spark.createDataFrame([(1, 1, "hello", 0.0, 100.2, 5.0), (1, 1, "world", 20.0, 99.8, 5.0), (1, 1, "飞行", 26.0, 100.0, 5.0), (1, 1, "下", 0.0, 50.0, 5.0)], "doc_id long, page_no int, str string, x double, y double, width double")
    assert [r["text"] for r in M.item_lines(items, 200.0).orderBy("line_no").collect()] == ["hello world飞行", "下"]


def test_item_lines_of_a_very_long_line(spark):
    n = 30_000
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.lit("word12").alias("str"), (F.col("id") * 10.0).alias("x"), F.lit(50.0).alias("y"),
                                  F.when(F.col("id") == 7, 35.0).when(F.col("id") % 100 != 0, 4.0).alias("width"))
    began = time.monotonic()
    text = M.item_lines(items, 200.0).first()["text"]
    # The item at 7 reaches over the next three, so no space goes before these.
    assert text.split(" ") == ["word12"] * 7 + ["word12" * 4] + ["word12"] * (n - 11) and time.monotonic() - began < 20


OPEN, SHUT = "早班司机到站后先填写里程登记卡。", "末班车入库时由保管员锁好侧门。"
SCENES = [
    # One own rule gone, two others come in between two shared lines.
    ([OPEN, "雨天一律改走河堤旧路。", SHUT], [OPEN, "遇雾时打开双闪并减速行驶。", "隧道内不得超车或者掉头。", SHUT]),
    # One line with another subject and another number.
    ([OPEN, "维修组每月清洗滤网，至少更换15个垫圈。", SHUT], [OPEN, "各车队每月清洗滤网，至少更换18个垫圈。", SHUT]),
    # A line before everything shared.
    ([SHUT], ["发车铃响三遍以后关闭站台栏杆。", SHUT]),
    # One line, broken in two on one side only.
    ([OPEN, "乘务员清点灭火器并且签字以后才可以打开后门。", SHUT], [OPEN, "乘务员清点灭火器并且", "签字以后才可以打开后门。", SHUT]),
    # A line said twice on one side.
    ([OPEN, "轮胎气压每天中午测量一遍。", "轮胎气压每天中午测量一遍。", SHUT], [OPEN, "轮胎气压每天中午测量一遍。", SHUT]),
]


def test_comparison_scenes(spark):
    rows = [(p, s, f"{s}-{i}", i, t, "", None) for p, (a, b) in enumerate(SCENES) for s, texts in (("my", a), ("ref", b)) for i, t in enumerate(texts, 1)]
    units = spark.createDataFrame(rows, "pair_id long, side string, unit_id string, unit_idx int, text string, title string, page_no int")
    result = compare_manuals(units)
    result["events"] = result["events"].cache()
    events = [(r["pair_id"], r["kind"]) for r in sort_events(result["events"]).collect()]
    assert events == [(0, "reference-added"), (0, "reference-removed"), (1, "modified"), (2, "reference-added"), (4, "reference-removed")]
    changed = result["events"].filter("kind = 'modified'").first()
    assert (changed["my_tokens_only"], changed["ref_tokens_only"]) == (["15"], ["18"])
    assert "".join(s["text"] for s in changed["my_diff"]) == changed["my_text"].replace("，", ",")
    added = result["events"].filter("pair_id = 0 and kind = 'reference-added'").first()
    assert (added["anchor_before"]["my_idx"], added["anchor_after"]["ref_idx"]) == (0, 3)
    assert {r["pair_id"]: r["same_slices"] for r in comparison_summary(result).collect()}[4] == 3
    numbered = result["events"].withColumn("n", F.regexp_extract("event_id", "([0-9]+)$", 1).cast("long"))
    assert V.report_rows(numbered, ["pair_id"], "n").count() == 5
    assert {r["kind"]: r["matched"] for r in V.category_counts(numbered, "双闪").collect()}["all"] == 1


def brute_chain(cands):
    """Heaviest chain by trying every subset order, for tiny inputs."""
    best = 0.0

    def grow(my, ref, weight, rest):
        nonlocal best
        best = max(best, weight)
        for i, (a, b, c, d, w) in enumerate(rest):
            if a >= my and c >= ref:
                grow(b, d, weight + w, rest[i + 1:])

    grow(0, 0, 0.0, sorted(cands))
    return best


def test_chains_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for gap in range(12):
        for _ in range(9):
            a, c = rnd.randrange(8), rnd.randrange(8)
            rows.append((1, gap, a, a + rnd.randrange(1, 3), c, c + rnd.randrange(1, 3), False, 0.8, float(rnd.randrange(1, 20))))
    df = spark.createDataFrame(rows, "pair_id long, gap long, my_start int, my_end int, ref_start int, ref_end int, exact boolean, similarity double, weight double")
    chosen = best_chain(df).collect()
    for gap in range(12):
        own = [r for r in rows if r[1] == gap]
        kept = sorted(((r["my_start"], r["my_end"], r["ref_start"], r["ref_end"]) for r in chosen if r["gap"] == gap))
        assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(kept, kept[1:]))
        weight = sum(max(r[8] for r in own if r[2:6] == k) for k in kept)
        assert weight == pytest.approx(brute_chain([(r[2], r[3], r[4], r[5], r[8]) for r in own]))
    anchors = spark.createDataFrame([(1, i, r) for i, r in enumerate([5, 1, 2, 9, 3, 4, 8])], "pair_id long, my_idx int, ref_idx int")
    assert [r["ref_idx"] for r in increasing_chain(anchors).orderBy("my_idx").collect()] == [1, 2, 3, 4, 8]


def test_gap_candidates_against_all_pairs(spark):
    """The rare-gram probe loses no pair a full comparison keeps."""
    rnd = random.Random(2)
    base = ["飞行部负责组织年度训练检查工作", "机组应当在起飞前完成全部检查单", "客舱服务人员按照规定执行巡视", "地面保障单位提供除冰设备支持"]
    rows = []
    for side in ("my", "ref"):
        for i in range(14):
            text = list(rnd.choice(base) + rnd.choice(base)[:6])
            for _ in range(3):
                text[rnd.randrange(len(text))] = rnd.choice("飞行检查训练部")
            t = "".join(text) + "。"
            rows.append((1, side, 0, i, t, t, plain(t)))
    gapped = spark.createDataFrame(rows, "pair_id long, side string, gap long, idx int, text string, lowered string, norm string")
    got = {(r["my_start"], r["my_end"], r["ref_start"], r["ref_end"]) for r in gap_candidates(gapped).collect()}
    side = {s: [r[4] for r in rows if r[1] == s] for s in ("my", "ref")}
    windows = {s: [(i, i + k, "".join(v[i:i + k])) for i in range(len(v)) for k in (1, 2) if i + k <= len(v)] for s, v in side.items()}
    grams = lambda t: {plain(t)[i:i + 2] for i in range(len(plain(t)) - 1)}
    want = set()
    for a, b, x in windows["my"]:
        equal = [w for w in windows["ref"] if plain(w[2]) == plain(x)]
        pool = equal or [w for w in windows["ref"] if grams(w[2]) & grams(x)]
        ranked = sorted(pool, key=lambda w: (0 if equal else -len(grams(w[2]) & grams(x)), w[0], w[1]))[:24]
        for c, d, y in ranked:
            ratio = min(len(plain(x)), len(plain(y))) / max(len(plain(x)), len(plain(y)))
            if equal or (text_similarity(x, y) >= 0.64 and ratio >= 0.42):
                want.add((a, b, c, d))
    assert got == want and len(want) > 10


def test_equal_weights_take_the_first_end():
    spans = [Span(0, 1, 5, 6, 2.0), Span(0, 1, 2, 3, 2.0), Span(1, 2, 3, 4, 1.0), Span(1, 2, 0, 1, 3.0)]
    assert heaviest(spans) == [3] and heaviest(spans[:3]) == [1, 2] and heaviest([]) == []


def test_decisions_and_context(spark):
    events = spark.createDataFrame([(1, "revision-1"), (1, "revision-2")], "pair_id long, event_id string")
    keys = ["pair_id", "event_id"]
    stored = spark.createDataFrame([(1, "revision-1", "included"), (1, "revision-9", "included"), (1, "revision-2", "??")], "pair_id long, event_id string, decision string")
    assert V.decision_summary(V.overlay_decisions(events, stored, keys)).first().asDict() == {"pending": 1, "included": 1, "excluded": 0}
    with pytest.raises(ValueError):
        V.set_decisions(stored, events, "maybe", keys)
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(["甲" * 5, "乙 丙，丁", "戊" * 5], 1)], "doc_id long, unit_idx int, text string")
    focus = spark.createDataFrame([(1, 1, 2, 2, "乙丙丁"), (2, 1, 1, 1, "没有")], "event_key long, doc_id long, first_unit int, last_unit int, focus_text string")
    got = {r["event_key"]: (r["before"], r["focus"], r["after"]) for r in V.event_context(focus, units, radius=3).collect()}
    assert got == {1: ("甲甲甲", "乙 丙，丁", "戊戊戊"), 2: ("", "没有", "乙 丙")}


@pytest.mark.parametrize("threshold, hot", [(0.5, 100_000), (0.3, 3), (0.8, 3), (1.0, 3)])
def test_similar_sets_against_all_pairs(spark, monkeypatch, threshold, hot):
    from rosterops.operators import similar, skew

    monkeypatch.setattr(similar, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rng = random.Random(7)
    common = [f"boilerplate {k}" for k in range(6)]
    sets = {}
    for k in range(90):
        base = sets[rng.choice(list(sets))] if sets and rng.random() < 0.6 else {f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 30))}
        sets[k] = {x for x in base if rng.random() > 0.12} | set(rng.sample(common, rng.randrange(4))) or {"only"}
    rows = [(k, line) for k, some in sets.items() for line in some] + [(3, line) for line in sets[3]] + [(None, "line 1"), (5, None)]
    found = similar.similar_sets(spark.createDataFrame(rows, "k long, line string").repartition(4), "k", "line", threshold)
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= threshold}
    got = [(r["a"], r["b"], r["shared"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and (want or threshold == 1.0)


def test_copies_are_one_class(spark):
    from rosterops.operators import similar

    docs = spark.createDataFrame([(4, "a\nb"), (2, "a\nb"), (3, "b\na"), (7, None), (6, ""), (1, "x\n \n")], "doc_id long, text string")
    classes = similar.copy_classes(docs, "doc_id", "text")
    assert sorted(tuple(r) for r in classes.collect()) == [(1, 1), (2, 2), (3, 3), (4, 2), (6, 6), (7, 6)]
    lines = docs.selectExpr("doc_id", "explode(split(text, '\\n')) as text")
    assert [tuple(r) for r in similar.similar_documents(lines, classes, "doc_id", "text").collect()] == [(2, 3, 2, 1.0)]
    assert similar.similar_documents(lines.limit(0), classes.limit(0), "doc_id", "text").count() == 0


def test_highlights_of_very_many_ranges(spark):
    rng = random.Random(9)
    texts = {"a": "x" * 300, "b": "yz", "c": "", "d": "Überläufer"}
    ranges = [(t, k, rng.randrange(-5, 310), rng.randrange(-5, 310)) for k, t in enumerate(rng.choices("abd", k=120))] + [("a", 500, 10, 20), ("a", 500, 10, 20)]
    out = S.highlight_segments(spark.createDataFrame(list(texts.items()), "text_id string, text string"), spark.createDataFrame(ranges, "text_id string, range_id long, start int, end int"))
    want = []
    for name, text in texts.items():
        held = [(max(a, 0), min(b, len(text)), k) for t, k, a, b in ranges if t == name and min(b, len(text)) > max(a, 0)]
        cuts = sorted({0, len(text), *(x for a, b, _ in held for x in (a, b))})
        want += [(name, a, b, text[a:b], [k for s, e, k in sorted(held) if s < b and e > a]) for a, b in zip(cuts, cuts[1:])]
    assert sorted((r["text_id"], r["start"], r["end"], r["segment"], r["active"]) for r in out.collect()) == sorted(want)


def test_windows_of_a_gap_meet_in_slots_without_their_texts(spark, monkeypatch):
    rnd = random.Random(4)
    texts = {s: ["".join(rnd.choice("ab1检查") for _ in range(14)) for _ in range(10)] for s in "mr"}
    grams = lambda t: sorted({t[i:i + 2] for i in range(len(t) - 1)})
    mine, theirs = (spark.createDataFrame([(1, 0, i, i + 1, t, t, grams(t)) for i, t in enumerate(texts[s])],
                                          f"pair_id long, gap long, {s}_start int, {s}_end int, {s}_norm string, {s}_match string, {s}_grams array<string>") for s in "mr")
    monkeypatch.setattr(align, "SLOT", 3)
    found = align._overlaps(mine, theirs, ["pair_id", "gap"], 4)
    assert "explode(m_grams" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for i, a in enumerate(texts["m"]):
        shared = [(-len(set(grams(a)) & set(grams(b))), k) for k, b in enumerate(texts["r"])]
        n = len(grams(a))
        want |= {(i, k) for s, k in sorted(shared)[:4] if -s >= (n * align.SHARE if n >= len(a) * align.VARIED else 1)}
    assert want and {(r["m_start"], r["r_start"]) for r in found.collect()} == want
