from conftest import rows
from pyspark.sql import functions as F

from tallyfield.functions import numbers, outcomes, text


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_strip_takes_every_unicode_space(spark):
    assert one(spark, ["India ", " India", "\tNew Zealand ", None], "string", text.strip) == [
        "India", "India", "New Zealand", None,
    ]


def test_scrub_removes_residue_anywhere(spark):
    assert one(spark, ["V Kohli†", "Rizwanâ€", "A B", None], "string", text.scrub) == ["V Kohli", "Rizwan", "AB", None]


def test_missing_tokens(spark):
    assert one(spark, ["", "nan", "x", None], "string", text.null_if_token) == [None, None, "x", None]


def test_visible_text_resolves_entities_once(spark):
    assert one(spark, ["<b>a&nbsp;&amp;lt; <i>b</i></b>"], "string", text.visible_text) == ["a &lt; b"]


def test_numbers(spark):
    values = ["25", " 25 ", "-", "", None, "1.0d", "inf", "3.9", "-2.5e1", "nan"]
    assert one(spark, values, "string", numbers.to_number) == [25.0, 25.0, None, None, None, None, None, 3.9, -25.0, None]
    assert one(spark, values, "string", numbers.to_whole) == [25, 25, 0, 0, 0, 0, 0, 3, -25, 0]


def test_dates(spark):
    values = ["Oct 16, 2022", "Oct 6, 2022", "15-01-2024", "2024-01-15", "bad", None]
    expected = ["2022-10-16", "2022-10-06", "2024-01-15", "2024-01-15", None, None]
    assert one(spark, values, "string", numbers.iso_date) == expected


def test_ratios(spark):
    df = spark.createDataFrame([(1, 3), (1005, 1000), (5, 0), (5, None), (2, 3)], "a long, b long")
    out = df.select(
        numbers.safe_ratio(F.col("a"), F.col("b")).alias("q"),
        numbers.rounded_ratio(F.col("a"), F.col("b")).alias("r"),
        numbers.rounded_ratio(F.col("a"), F.col("b"), 100, 1).alias("p"),
    ).collect()
    assert [tuple(r) for r in out] == [
        (1 / 3, 0.33, 33.3), (1.005, 1.01, 100.5), (None, None, None), (None, None, None), (2 / 3, 0.67, 66.7),
    ]


def test_ratios_of_decimals_and_negative_numbers(spark):
    df = spark.createDataFrame([(40.0, 4.7, 6.0), (0.0, 4.7, 0.0), (-5.0, 1000.0, 1.0)], "runs double, overs double, w double")
    out = df.select(
        numbers.rounded_ratio(F.col("runs"), F.col("overs"), digits=1).alias("e"), numbers.rounded_ratio(F.col("w"), F.col("overs"), 1, digits=1).alias("w")
    )
    assert [tuple(r) for r in out.collect()] == [(8.51, 1.28), (0.0, 0.0), (-0.01, 0.0)]


def test_blanks_of_any_kind_and_long_numbers(spark):
    assert one(spark, ["\u00a07 ", "3000000000"], "string", numbers.to_whole) == [7, 3000000000]
    values = ["Oct 16, 2022 ", " 2022-10-16", "October 16, 2022", "16/10/2022", "6/1/2022"]
    assert one(spark, values, "string", numbers.iso_date) == ["2022-10-16"] * 4 + ["2022-01-06"]


def test_overs(spark):
    assert one(spark, [3.4, 4.0, 0.5, None], "double", numbers.overs_to_balls) == [22, 24, 5, None]


def test_outcomes(spark):
    df = spark.createDataFrame([("a", "a", "b"), ("b", "a", "b"), ("no result", "a", "b"), (None, "a", "b")], "w string, x string, y string")
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    out = df.select(
        outcomes.outcome_label(w, x, y).alias("label"), outcomes.winner_name(w, x, y, x, y).alias("name"),
        outcomes.same_pair(x, y, "b", "a").alias("pair"),
    )
    assert [tuple(r) for r in out.collect()] == [(1, "a", True), (0, "b", True), (None, "No Result", True), (None, "No Result", True)]


def test_neutral_flag_is_a_substring_test(spark):
    df = spark.createDataFrame([("NATION_1", "X", "Ground nation_10"), ("A", "B", "C"), ("A", "B", None)], "x string, y string, v string")
    flags = df.select(outcomes.neutral_flag(F.col("v"), F.col("x"), F.col("y")).alias("n"))
    assert [r["n"] for r in flags.collect()] == [0, 1, 1]


def test_present_flag(spark):
    flag = lambda c: text.present_flag(c, "out", "not_out")
    assert one(spark, ["c A b B", "", None], "string", flag) == ["out", "not_out", None]
    assert rows(spark.range(1)) == [(0,)]
