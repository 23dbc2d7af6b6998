import datetime as dt

import pytest
from pyspark.sql import functions as F

from menuflow.functions import dates, text
from menuflow.functions.plain import half_width, plain_form, strip_blanks


def one(spark, column, **values):
    """The value of a column expression over one row of the given values."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("ＡＢ－１", "ab-1"), (" x ", "x"), ("　X　", "x"), ("a b", "a b"), ("​q﻿", "q"), ("plain_1", "plain_1"), ("", ""), (None, None), ("On_Sale", "on_sale")],
)
def test_plain_form(spark, given, expected):
    assert one(spark, plain_form(F.lit(given).cast("string"))) == expected


def test_width_and_edges(spark):
    assert one(spark, half_width(F.lit("ＡＺ０９！～　"))) == "AZ09!~ "
    assert one(spark, strip_blanks(F.lit("  a b　"))) == "a b"


def test_text_of_html(spark):
    assert one(spark, text.strip_comments(F.lit("a<!-- x\ny -->b"))) == "ab"
    assert one(spark, text.clean_text(F.lit(" <b>a</b> <br/> b　  c&amp;&lt;d&gt; "))) == "a\nb c&<d>"
    assert one(spark, text.escape_html(F.lit("<a b=\"c\">'&"))) == "&lt;a b=&quot;c&quot;&gt;&#x27;&amp;"
    assert one(spark, text.first_sentence(F.lit("【NEW】一つめ。二つめ。"))) == "一つめ。"
    assert one(spark, text.first_sentence(F.lit("※注\n本文です"))) == "本文です"
    assert one(spark, text.first_sentence(F.lit("あ" * 200))) == "あ" * 99 + "…"


def test_quotes_and_keys(spark):
    assert one(spark, text.quotes(F.lit("「a」と『b』、「c"))) == ["a", "b"]
    assert one(spark, text.launch_quotes(F.lit("『夏の皿』を新発売！「特製ソース」が極限の旨さで、とても長い文のあとに新発売"), "新発売")) == ["夏の皿"]
    assert one(spark, text.match_key(F.lit("「Ａ・Ｂ」 ㌔（限定）！ー"))) == "abキロ限定!ー"
    assert one(spark, text.review_key(F.lit("Ａ・b！—スープ%"))) == "abスープ"
    assert one(spark, text.table_key(F.lit("Ａ 〜 B"))) == "A~B"
    assert one(spark, text.space_free(F.lit("a　b c"))) == "abc"
    assert one(spark, text.name_variants(F.lit("店名チーズ丼"), ["店名"])) == ["店名チーズ丼", "チーズ丼"]
    assert one(spark, text.name_variants(F.lit("店名丼"), ["店名"], 2)) == ["店名丼"]


@pytest.mark.parametrize(("given", "expected"), [("1,234.5kcal", 1234.5), ("１２", 12.0), ("-", None), ("ー", None), ("−3", -3.0), ("約3", None), ("", None), (None, None), ("+4g", 4.0)])
def test_numbers(spark, given, expected):
    assert one(spark, text.to_number(F.lit(given).cast("string"))) == expected


def test_units_and_display(spark):
    assert tuple(one(spark, text.split_unit(F.lit("1,200 kcal")))) == (1200.0, "kcal")
    assert [one(spark, text.format_number(F.lit(x))) for x in (550.0, 12.5, 0.25, 1_000_000.0)] == ["550", "12.5", "0.25", "1e+06"]


def test_rules_words_and_paths(spark):
    rules = [("丼", "bowl"), ("鍋", None), (".", "rest")]
    assert [one(spark, text.first_rule(F.lit(x), rules, "none")) for x in ("牛丼鍋", "鍋丼x鍋", "鍋", "x", "")] == ["bowl", "bowl", None, "rest", "none"]
    words = {"麻婆": "a", "四川麻婆": "b", "カレー": "c"}
    assert [one(spark, text.longest_word(F.lit(x), words, {"c": ["パン"]})) for x in ("四川麻婆", "麻婆カレー", "カレーパン", "x")] == ["b", "c", None, None]
    assert one(spark, text.common_prefix(F.lit("abcd"), F.lit("abx"))) == 2
    assert tuple(one(spark, text.url_parts(F.lit("HTTPS://www.A.example/p/q?x=1#f")))) == ("https", "a.example", "/p/q", "x=1")
    assert one(spark, text.slug(F.lit("A b--C!"))) == "a-b-c"
    assert one(spark, text.base_key(F.lit("m1_260401"))) == "m1"
    assert one(spark, text.label_map(F.array(F.lit("熱量"), F.lit("他")), F.array(F.lit("1"), F.lit("2")), {"熱量": "kcal"})) == {"kcal": "1", "他": "2"}


def test_dates(spark):
    ref = F.to_date(F.lit("2026-01-10"))
    get = lambda m, d, r=ref: one(spark, dates.yearless_date(F.lit(m), F.lit(d), r))
    assert get(1, 5) == dt.date(2026, 1, 5) and get(12, 25) == dt.date(2025, 12, 25) and get(2, 30) is None
    assert get(2, 29, F.to_date(F.lit("2024-12-31"))) is None  # moved into a common year
    assert one(spark, dates.headline_date(F.lit("12月25日より"), ref)) == dt.date(2025, 12, 25)
    assert one(spark, dates.headline_date(F.lit("本日発売"), ref)) == dt.date(2026, 1, 10)
    assert one(spark, dates.headline_date(F.lit("近日"), ref)) is None
    assert one(spark, dates.key_date(F.lit("x_260231"))) is None and one(spark, dates.key_date(F.lit("x_260228"))) == dt.date(2026, 2, 28)
    assert one(spark, dates.ja_date(ref)) == "2026年1月10日"
    assert one(spark, dates.period_text(ref, ref, F.lit(True))) == "2026年1月10日〜2026年1月10日(終了)"
    assert one(spark, dates.effective_date(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit("2026-01-10 05:00:00").cast("timestamp"))) == dt.date(2026, 1, 10)


def test_numbers_in_six_digits(spark):
    from menuflow.functions import text

    values = [1234567.0, 12345.678, 0.00001, 0.0001, 100.0, 0.0, -2.5, 999999.5, None, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.format_number(F.col("v"))).collect()] == ["1.23457e+06", "12345.7", "1e-05", "0.0001", "100", "0", "-2.5", "1e+06", None, "inf", "nan"]


def test_repeated_and_null_labels(spark):
    from menuflow.functions import text

    df = spark.createDataFrame([(["a", None, "b", "a"], [1, 2, 3, 4]), ([], []), (None, None)], "k array<string>, v array<int>")
    assert [r[0] for r in df.select(text.label_map(F.col("k"), F.col("v"), {"b": "a"})).collect()] == [{"a": 4}, {}, None]


def test_entities_paths_and_descriptions(spark):
    from menuflow.functions import text

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.unescape(F.lit("a&#12354;&#x3042;&#X41;&amp;#65;&#0;&#9999999;"))) == "aああA&#65;&#0;&#9999999;"
    for path, plain in (("/a/../b/./c//d/..", "/b/c/"), ("x/y", "x/y"), ("/", "/"), ("/../..", "/"), ("", "")):
        assert one(text.resolve_path(F.lit(path))) == plain
    told = one(text.short_description(F.lit("【新】 ※注\n【他】x\n" + "あ" * 120 + "。次"), limit=10))
    assert told["full_length"] == 121 and told["text"] == "あ" * 9 + "…"
    for a, b, n in (("abcd", "abxd", 2), ("abc", "abc", 3), ("", "a", 0), ("x", "y", 0), ("ab", "abc", 2)):
        assert one(text.common_prefix(F.lit(a), F.lit(b))) == n
