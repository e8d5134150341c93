"""Column expressions on small literal tables."""

import random
from datetime import date

from pyspark.sql import functions as F

from rosterops.functions import dates as D
from rosterops.functions import normal as N
from rosterops.functions import ranges as G
from rosterops.functions import text as X
from rosterops.operators.diff import common_places, diff
from rosterops.operators.locate import evidence_segments, ordered_hits
from rosterops.operators.slices import sentences
from rosterops.operators.substring import all_positions


def one(spark, *columns, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_cleaning(spark):
    raw = "﻿　 张三  李 "
    assert one(spark, X.clean("a"), X.squeeze("a"), X.strip_spaces("a"), a=raw) == ("张三  李", "张三 李", "张三李")
    assert one(spark, X.is_null_word("a"), X.is_true_word("a"), X.has_value("a"), a=" 不适用 ") == (True, False, True)
    assert one(spark, X.number_like("a"), a="约 -12.5 小时") == (-12.5,)
    assert one(spark, X.number_like("a"), a="无") == (0.0,)


def test_ids_and_names(spark):
    assert one(spark, F.array_join(X.six_digit_runs("a"), ","), a="1234567 x 000012") == ("123456,000012",)
    assert one(spark, F.array_join(X.sorted_ids(X.six_digit_runs("a")), ","), a="900000 000012 900000") == ("000012,900000",)
    assert one(spark, X.numeric_employee_id("a"), a="193391.0") == ("193391",)
    assert one(spark, F.array_join(X.whitelist_ids("a"), ","), a="12-34-56-78-90-12") == ("123456,789012",)
    assert one(spark, X.names_agree("a", F.lit("")), X.names_agree("a", F.lit("li si（飞）")), a="LI  SI") == (True, True)
    assert one(spark, F.size(X.split_pasted_line("a")), a="123456张三 x 654321李四 y") == (2,)
    assert one(spark, X.name_after_id("a"), F.array_join(X.dates_in_text("a"), "|"), a="123456 张三丰 2026-1-2 2026/01/03") == ("张三丰", "2026-1-2|2026/01/03")
    assert one(spark, X.tech_level("a"), a="技术：a1类机长") == ("A1",)
    assert one(spark, X.tech_level("a"), a="飞行教员C") == ("C",)


def test_dates(spark):
    assert one(spark, D.training_date("a"), D.form_date("a"), a="2026-02-31") == (date(2026, 3, 3), None)
    assert one(spark, D.training_date("a"), a="2026/5.6T08") == (date(2026, 5, 6),)
    assert one(spark, D.training_date("a", F.lit("n")), D.training_date("a"), a="45000.7") == (date(2023, 3, 15), None)
    assert one(spark, D.lodging_date("a"), a="25/03/04") == (date(2025, 3, 4),)
    assert one(spark, D.lodging_date("a"), a="3/4/25 8:30") == (date(2025, 3, 4),)
    assert one(spark, D.lodging_date("a"), a="45000") == (date(2023, 3, 15),)
    assert one(spark, D.lodging_date("a"), D.form_date("a"), a="garbage") == (None, None)
    assert one(spark, D.query_date("a"), D.query_date_text("a", "/"), a="2026/1/2") == (date(2026, 1, 2), "2026/01/02")
    assert one(spark, D.format_form_date(F.lit("2026-01-02").cast("date")), D.format_form_date(F.lit(None).cast("date"))) == ("2026年01月02日", "")


def test_ranges(spark):
    assert one(spark, F.array_join(G.parse_pages("a", F.lit(10)), ","), a="1-3, 7,5-4,99") == ("1,2,3,7",)
    assert one(spark, F.array_join(G.parse_pages("a", F.lit(10), swap_reversed=True), ","), a="5-3,2") == ("2,3,4,5",)
    assert one(spark, G.format_pages(F.array(*(F.lit(i) for i in (7, 1, 2, 3, 9, 10))))) == ("1-3,7,9-10",)
    assert one(spark, F.array_join(G.dotted_sequence(F.lit("1.08-1.10"), True), " ")) == ("1.08 1.09 1.10",)
    assert one(spark, G.dotted_sequence(F.lit("1.8-2.1"))) == (None,)


def test_normal_forms(spark):
    assert one(spark, N.loose_text("a"), a="Ａ１２。 飞-行") == ("a12飞行",)
    assert one(spark, N.match_text(N.nfkc_lower("a")), a="1.2.3 飞行 ABC（试）") == ("飞行abc试",)
    assert one(spark, F.array_join(N.id_tokens(N.nfkc_lower("a")), " "), a="B737-800 x 20 次 v1.2") == ("20 b737-800 v1.2",)
    assert one(spark, F.array_join(N.grams(F.col("a")), " "), a="abab") == ("ab ba",)
    assert one(spark, N.page_match_text(N.nfkc_lower("a")), a="2026/01/10\n50\n《大纲》\n7.5.4 飞行经历：1000 小时") == ("飞行经历1000小时",)


def test_segments_and_hits(spark):
    text = "飞行" * 30
    parts = one(spark, evidence_segments(F.col("a")), a=text)[0]
    assert [len(p) for p in parts] == [26, 26, 20]
    assert one(spark, ordered_hits(F.array(*(F.lit(i) for i in (3, 1, 4, 2, 9))))) == (3,)
    assert one(spark, all_positions(F.col("a"), F.lit("aa")), a="aaaaXaa")[0] == [0, 2, 5]


def test_display_texts(spark):
    assert one(spark, X.plain_markdown("a"), a="---\nx: 1\n---\n# 标题\n- [链接](u) `码`\n| a | b |\n| --- | --- |") == ("标题 链接 码 a b",)
    assert one(spark, X.snippet("a", F.lit("zzz")), a="短文") == ("短文",)
    assert one(spark, X.link_target("a")["url"], a='=HYPERLINK("http://u", "名")') == ("http://u",)
    assert one(spark, X.safe_token("a"), a=' a/b:c  d ') == ("a_b_c_d",)


def test_sentences():
    assert sentences("甲乙丙丁戊己庚辛壬。短尾") == ["甲乙丙丁戊己庚辛壬。短尾"]
    assert sentences("第一句需要完成训练。第二句需要完成检查。") == ["第一句需要完成训练。", "第二句需要完成检查。"]
    packed = sentences("这是一个很长的句子片段内容，" * 30)
    assert len(packed) > 1 and "".join(packed) == "这是一个很长的句子片段内容，" * 30


def test_common_places_are_as_many_as_can_be():
    rnd = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rnd.choices("abc", k=rnd.randrange(12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = list(common_places(a, b))
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_diff_keeps_both_texts():
    for a, b in (("飞行部20次", "各单位24次"), ("", "x"), ("same", "same"), ("a" * 900, "a" * 450 + "b" * 450)):
        d = diff(a, b)
        assert "".join(r["text"] for r in d["left"]) == a
        assert "".join(r["text"] for r in d["right"]) == b
    assert list(common_places("abXcd", "abYYcd")) == [(0, 0), (1, 1), (3, 4), (4, 5)]
    long = "".join(random.Random(3).choices("abcd", k=3000))
    other = long[:1000] + "zz" + long[1100:]
    assert len(list(common_places(long, other))) == 2900


def test_diffs_of_many_rows_take_little_memory():
    import random
    import tracemalloc

    import pyarrow as pa

    from rosterops.operators.diff import diff, diff_arrays

    random.seed(3)
    texts = ["".join(random.choice("ab c") for _ in range(60)) for _ in range(2001)]
    tracemalloc.start()
    found = diff_arrays(pa.array(texts[:-1]), pa.array(texts[1:]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and len(found) == 2000 and found[7].as_py() == diff(texts[7], texts[8])
    assert len(diff_arrays(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
    assert diff_arrays(pa.array([None]).cast(pa.string()), pa.array(["x"])).to_pylist() == [diff(None, "x")]
