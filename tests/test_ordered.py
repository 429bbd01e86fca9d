"""Evaluation in ranges and by plain windows must agree, with one key holding most rows, ties and NULLs."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(5)
    data = []
    for i in range(3000):
        key = draw.choice(["hot", "hot", "hot", "b", "c", None, f"k{i % 40}"])
        day = 700 if draw.random() < 0.4 else draw.randrange(1000)
        data.append((i, key, day, draw.choice([0, 1, None]), draw.choice("xxxy")))
    return spark.createDataFrame(data, "id long, k string, day int, v int, run string").cache()


def ranges(series, keys, partitions):
    return ordered.in_ranges(series, keys, ["day", "id"], partitions)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_ranges_hold_their_share_however_long_a_group_is(series, keys, partitions):
    cut = ranges(series, keys, partitions)
    assert cut.count() == 3000
    sizes = [r["count"] for r in cut.groupBy(ordered.CHUNK).count().collect()]
    assert len(sizes) == partitions or len(sizes) > 0.8 * partitions
    assert max(sizes) < 2.5 * 3000 / partitions + 1


@pytest.mark.parametrize("partitions", [8, 40])
def test_one_key_and_one_day_are_split(spark, partitions):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(1).alias("day"), "id", (F.col("id") % 2).alias("v"))
    cut = ranges(df, ["k"], partitions)
    assert max(r["count"] for r in cut.groupBy(ordered.CHUNK).count().collect()) < 2.5 * 4000 / partitions
    numbered = ordered.whole(ordered.number_rows(cut, ["k"], ["day", "id"], "n"))
    assert numbered.where("n <> id + 1").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("partitions", [3, 50])
def test_numbering(series, keys, partitions):
    window = Window.partitionBy(*keys).orderBy("day", "id")
    plain = series.withColumn("n", F.row_number().over(window).cast("long"))
    cut = ordered.whole(ordered.number_rows(ranges(series, keys, partitions), keys, ["day", "id"], "n"))
    assert rows(plain, "id", "n") == rows(cut, "id", "n")
    assert set(plain.columns) == set(cut.columns)


@pytest.mark.parametrize("frame", [(-4, 0), (-5, -1)])
@pytest.mark.parametrize("partitions", [1, 7, 300])
def test_rolling(series, frame, partitions):
    outputs = {"m": ordered.mean_of("v"), "n": lambda w: F.count("v").over(w)}
    window = Window.partitionBy("k").orderBy("day", "id").rowsBetween(*frame)
    plain = series.withColumns({name: make(window) for name, make in outputs.items()})
    cut = ordered.whole(ordered.rolling(ranges(series, ["k"], partitions), ["k"], ["day", "id"], "v", frame, outputs))
    assert rows(plain, "id", "m", "n") == rows(cut, "id", "m", "n")
    assert set(plain.columns) == set(cut.columns)


def test_rolling_against_a_loop(series):
    data = sorted(((r["k"] or "", r["day"], r["id"], r["v"]) for r in series.collect()))
    expected, past = [], {}
    for key, _, ident, value in data:
        known = [v for v in past.setdefault(key, [])[-5:] if v is not None]
        expected.append((ident, sum(known) / len(known) if known else None))
        past[key].append(value)
    out = ordered.rolling(ranges(series, ["k"], 9), ["k"], ["day", "id"], "v", (-5, -1), {"m": ordered.mean_of("v")})
    assert dict(rows(out, "id", "m")) == dict(expected)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("partitions", [1, 8, 120, 900])
def test_run_positions(series, keys, partitions):
    data = sorted(((r["k"] or "") if keys else "", r["day"], r["id"], r["run"]) for r in series.collect())
    expected, last, count = {}, None, 0
    for key, _, ident, run in data:
        count = count + 1 if last == (key, run) else 1
        last = (key, run)
        expected[ident] = count
    df = ranges(series, keys, partitions)
    assert dict(rows(ordered.run_position(df, keys, ["day", "id"], ["run"], "p"), "id", "p")) == expected


def test_run_position_restarts(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, None), (6, None)], "seq int, innings string")
    df = ordered.in_ranges(df, [], ["seq"], 3)
    assert [p for _, p in rows(ordered.run_position(df, [], ["seq"], ["innings"], "p"), "seq", "p")] == [1, 2, 1, 1, 1, 2]


def test_totals_leave_out_the_whole_day(series):
    data = [(r["k"], r["day"], r["v"]) for r in series.collect()]
    measures = {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}
    out = ordered.totals_before(series.where("k IS NOT NULL"), ["k"], "day", measures)
    for key, day, n, s in rows(out, "k", "day", "n", "s")[::7]:
        before = [v for k, d, v in data if k == key and d < day]
        assert (n, s) == (len(before), sum(v or 0 for v in before))


def test_as_of_answers(series, spark):
    data = [(r["k"], r["day"], r["id"], r["v"]) for r in series.collect()]
    asked = spark.createDataFrame([(k, d) for k in ("hot", "b", "k3", "nobody") for d in (-1, 0, 500, 700, 701, 2000)] * 2, "k string, day int")
    totals = ordered.totals_as_of(series, asked, ["k"], "day", {"n": F.lit(1)})
    recent = ordered.recent_as_of(series, asked, ["k"], "day", ["day", "id"], "v", 5, "last")
    assert totals.count() == recent.count() == 24
    for key, day, n in rows(totals, "k", "day", "n"):
        assert n == sum(1 for k, d, *_ in data if k == key and d < day)
    for r in recent.withColumn("mean", ordered.mean_of_array(F.col("last"))).collect():
        past = sorted((d, i, v if v is not None else -1) for k, d, i, v in data if k == r["k"] and d < r["day"])
        before = [None if v == -1 else v for _, _, v in past]
        assert (r["last"] or []) == before[-5:]
        known = [v for v in before[-5:] if v is not None]
        assert r["mean"] == (sum(known) / len(known) if known else None)


def test_tasks_follow_the_rows(spark, series, monkeypatch):
    """Narrow rows compress so well that a shuffle's octets would put all of them into one task."""
    monkeypatch.setattr(ordered, "ROWS_OF_TASK", 100)
    tasks = ordered.tasks_for(spark, series.count())
    assert tasks == 30
    order = ["day", "id"]
    cut = ranges(series, ["k"], tasks)
    rolled = ordered.rolling(cut, ["k"], order, "v", (-5, -1), {"m": ordered.mean_of("v")}, tasks)
    numbered = ordered.number_rows(cut, ["k"], order, "n", tasks)
    assert rolled.rdd.getNumPartitions() == numbered.rdd.getNumPartitions() == tasks
    window = Window.partitionBy("k").orderBy(*order)
    plain = series.withColumns({"m": ordered.mean_of("v")(window.rowsBetween(-5, -1)), "n": F.row_number().over(window).cast("long")})
    assert rows(plain, "id", "m") == rows(rolled, "id", "m")
    assert rows(plain, "id", "n") == rows(numbered, "id", "n")
