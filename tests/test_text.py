"""Scalar functions against literal cases."""

from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.functions import text as T


def column(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_query_terms(spark):
    got = column(spark, ["The River's a é x1 river", "茶壶灯笼 of 船", "", "ab船c", "İstanbul ΑΣ"], T.query_terms)
    assert sorted(got[0]) == ["river", "x1", "é"]
    assert sorted(got[1]) == ["壶灯", "灯笼", "茶壶"]
    assert got[2] == []
    assert sorted(got[3]) == ["ab", "b船", "船c"]
    assert "ας" in got[4] and any(t.startswith("i") and "stanbul" in t for t in got[4])


def test_plain_terms_counts_characters(spark):
    got = column(spark, ["The a é to To ok"], T.plain_terms)
    assert sorted(got[0]) == ["ok", "the", "to"]


def test_whitespace_and_markup(spark):
    assert column(spark, [" a \t　b\n"], T.normalise_whitespace) == ["a b"]
    assert column(spark, ["<p>a <b>b</b>\n c</p> <open"], T.strip_markup) == ["a b c"]
    assert column(spark, ["&amp;lt; &quot;"], T.decode_entities) == ['< "']
    assert column(spark, ["a href='x&amp;y' id=\"q\"", "a href=x"], lambda c: T.attribute(c, "href")) == ["x&y", None]


def test_ids_and_names(spark):
    assert column(spark, ["chapter_007", "chapter_", "part_1", "chapter_1x"], T.chapter_number) == [7, None, None, None]
    assert column(spark, [" - Für Élise! ", "茶壶"], T.safe_name) == ["Für-Élise", "茶壶"]
    assert column(spark, ["a-b_1", "a b", "", "é"], T.valid_id) == [True, False, False, False]
    assert column(spark, ["Contents", " 目录 ", "contents: more", "contentsx"], T.is_noise_title) == [True, True, True, False]
    assert column(spark, ["a#b#c", "a"], T.href_fragment) == ["b#c", None]


def test_usage_and_cost(spark):
    rows = [(10, 5, None, None), (10, 5, 11, None), (10, 5, 4, 1), (-1, 5, None, None), (None, 5, None, None), (10, 5, 4, 0)]
    df = spark.createDataFrame(rows, "i long, o long, c long, w long")
    usage = numbers.valid_usage(F.col("i"), F.col("o"), F.col("c"), F.col("w"))
    got = df.select(usage.isNotNull(), numbers.cached_cost(usage, 10, 1, 50)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, True]
    assert abs(got[5][1] - (6 * 10 + 4 * 1 + 5 * 50) / 1e6) < 1e-12
    big = spark.createDataFrame([(272_000, 0, 0, 1), (272_001, 1, 1, 1), (5, 3, 3, 1)], "i long, c long, w long, o long")
    usd = [r[0] for r in big.select(numbers.tiered_cost(F.col("i"), F.col("c"), F.col("w"), F.col("o"))).collect()]
    assert abs(usd[0] - (272_000 * 10 + 50) / 1e6) < 1e-9
    assert abs(usd[1] - (271_999 * 20 + 2 + 25 + 75) / 1e6) < 1e-9
    assert usd[2] is None


def test_basis_points(spark):
    df = spark.createDataFrame([(1, 3), (5, 4), (0, 0)], "n long, d long")
    got = df.select(numbers.basis_points(F.col("n"), F.col("d")), numbers.basis_points(F.col("n"), F.col("d"), empty=0)).collect()
    assert [tuple(r) for r in got] == [(3333, 3333), (10000, 10000), (None, 0)]
