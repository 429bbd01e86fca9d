import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfield.operators import aggregates, cleaning, keys
from tallyfield.plans import records, reports
from tallyfield.sources import catalogue


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 5, "n"), (None, 4, "m")], "key string, seq int, payload string")
    assert rows(cleaning.keep_first(df, ["key"], ["seq"])) == [(None, 4, "m"), ("k", 1, "a")]
    assert rows(cleaning.keep_last(df, ["key"], ["seq"])) == [(None, 5, "n"), ("k", 2, "b")]


def test_absent_columns_are_passed_over(spark):
    df = spark.createDataFrame([(" a ", "1")], "x string, y string")
    out = cleaning.fill_zero(cleaning.numeric_columns(cleaning.strip_columns(df, ["x", "zz"]), ["y", "zz"]), ["zz"])
    assert rows(cleaning.require(out, ["x", "zz"])) == [("a", 1.0)]


def test_number_names_is_dense_and_repeatable(spark):
    names = spark.range(5000).select(F.concat(F.lit("name "), "id").alias("name"))
    first = rows(keys.number_names(names, "name", "key"), "key", "name")
    again = rows(keys.number_names(names.repartition(7), "name", "key"), "key", "name")
    assert first == again
    assert [k for k, _ in first] == list(range(1, 5001))


def test_extend_dimension_keeps_known_keys(spark):
    known = spark.createDataFrame([(7, "a"), (9, "b")], "id long, name string")
    names = spark.createDataFrame([("b",), ("c",), ("c",), ("d",)], "name string")
    out = dict((n, i) for i, n in rows(keys.extend_dimension(known, names, "name", "id"), "id", "name"))
    assert out["a"] == 7 and out["b"] == 9 and {out["c"], out["d"]} == {10, 11}


def test_insert_rules_and_null_keys(spark):
    schema = "k string, t string, v string, seq int"
    old = spark.createDataFrame([("a", "x", "old", 0)], schema)
    new = spark.createDataFrame([("a", "x", "n1", 1), ("b", "x", "n3", 3), ("b", "x", "n2", 2), ("c", None, "n4", 4), ("c", None, "n5", 5)], schema)
    assert [r[2] for r in rows(keys.insert_or_ignore(old, new, ["k", "t"], ["seq"]))] == ["old", "n2", "n4", "n5"]
    assert [r[2] for r in rows(keys.insert_or_replace(old, new, ["k", "t"], ["seq"]))] == ["n1", "n3", "n4", "n5"]


def test_pair_bridge_last_contest_wins(spark):
    df = spark.createDataFrame([("m1", "A", "B", 1), ("m2", "B", "A", 2), ("m3", "C", "A", 1)], "id string, s1 string, s2 string, day int")
    out = dict(rows(keys.pair_key_bridge(df, "s1", "s2", "id", ["day"])))
    assert out == {"A Vs B": "m2", "B Vs A": "m2", "A Vs C": "m3", "C Vs A": "m3"}


def test_namesakes_resolve_by_team(spark):
    teams = spark.createDataFrame([(1, "A"), (2, "B")], "team_id long, team_name string")
    people = spark.createDataFrame([("Sam", "A"), ("Sam", "B")], "name string, team string")
    roster = records.build_players(people, teams, ["team"])
    scores = spark.createDataFrame([("m", "A", "Sam", 1), ("m", "B", "Sam", 2), ("m", "B", "Nobody", 3)], "match_id string, teamInnings string, batsmanName string, runs int")
    ids = {r["team_id"]: r["player_id"] for r in roster.collect()}
    assert rows(records.build_batting(scores, teams, roster), "runs", "batsman_id") == [(1, ids[1]), (2, ids[2]), (3, None)]
    assert rows(keys.ambiguous_names(roster, ["name"], "player_id")) == [("Sam", 2)]


def test_no_score_loses_a_player_the_roster_knows(spark):
    teams = spark.createDataFrame([(1, "A"), (2, "B")], "team_id long, team_name string")
    raw = [("Sam", "A", 1), ("Sam", "B", 2), ("Kim", None, 3), ("Kim", None, 4), ("Lee", "A", 5)]
    raw = spark.createDataFrame(raw, "name string, team string, seq int")
    roster = records.build_players(records.clean_players(raw, ["seq"]), teams, ["team"])
    assert rows(roster, "name", "team_id") == [("Kim", None), ("Lee", 1), ("Sam", 1), ("Sam", 2)]
    scores = [("m", "A", "Sam", 1), ("m", "B", "Sam", 2), ("m", "A", "Kim", 3), ("m", "B", "Lee", 4)]
    scores = spark.createDataFrame(scores, "match_id string, teamInnings string, batsmanName string, runs int")
    found = dict(rows(records.build_batting(scores, teams, roster), "runs", "batsman_id"))
    ids = {(r["name"], r["team_id"]): r["player_id"] for r in roster.collect()}
    assert found == {1: ids["Sam", 1], 2: ids["Sam", 2], 3: ids["Kim", None], 4: ids["Lee", 1]}


def test_strict_mode_takes_winner_texts_as_teams(spark):
    raw = spark.createDataFrame([("A", "B", "no result"), ("B", "C", "B")], "team1 string, team2 string, winner string")
    assert rows(records.build_teams(raw), "team_name") == [("A",), ("B",), ("C",)]
    assert rows(records.build_teams(raw, strict_reference=True), "team_name") == [("A",), ("B",), ("C",), ("no result",)]


def test_key_checks(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(2,), (3,), (3,)], "pk int")
    assert rows(keys.missing_parents(child, "fk", parent, "pk")) == [(1, 2)]
    assert rows(keys.repeated_keys(parent, ["pk"])) == [(3, 2)]
    assert rows(keys.missing_values(child, ["fk"])) == [("fk", 1)]


def test_win_rates_of_both_denominators(spark):
    df = spark.createDataFrame([("A", "B", "B"), ("C", "B", "B"), ("B", "A", "no result")], "side1 string, side2 string, winner string")
    assert rows(reports.win_rates(df, "side1"), "side", "contests", "win_percentage") == [("A", 1, 0.0), ("B", 1, 200.0), ("C", 1, 0.0)]
    assert rows(reports.win_rates(df), "side", "contests", "wins") == [("A", 2, 0), ("B", 3, 2), ("C", 1, 0)]


def test_head_to_head_orientation(spark):
    df = spark.createDataFrame([("A", "B", "B"), ("B", "A", "B"), ("A", "B", None)], "side1 string, side2 string, winner string")
    oriented = rows(reports.head_to_head(df, "A", "B"), "side1", "side1_wins", "side2_wins", "no_results", "contests")
    assert oriented == [("A", 0, 1, 1, 2), ("B", 1, 0, 0, 1)]
    merged = rows(reports.head_to_head(df, "B", "A", oriented=False), "side1", "side1_wins", "side2_wins", "no_results")
    assert merged == [("A", 0, 2, 1)]


def test_spread_of_whole_and_broken_numbers(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 4, 1.5), ("h", 7, 2.0)], "k string, w int, x double")
    out = rows(aggregates.mean_and_spread(df, ["k"], ["w", "x"]))
    assert out == [("g", 2.5, 1.5, 1.0, 0.5), ("h", 7.0, 0.0, 2.0, 0.0)]


def test_spread_of_very_large_numbers(spark):
    base = 3 * 10**15
    data = [("g", base + i % 7) for i in range(5000)] + [("h", s * (2**63 - 1)) for s in (1, -1)] + [("n", None)]
    df = spark.createDataFrame(data, "k string, w long")
    g, h, n = rows(aggregates.mean_and_spread(df, ["k"], ["w"]))
    assert g[1] == pytest.approx(base + statistics.fmean(i % 7 for i in range(5000)), rel=1e-15)
    assert g[2] == pytest.approx(statistics.pstdev(i % 7 for i in range(5000)), rel=1e-9)
    assert h[1:] == (0.0, pytest.approx(2.0**63, rel=1e-12)) and n[1:] == (None, None)
    many = spark.range(40).select(F.lit("g").alias("k"), (F.lit(2**62) + F.col("id") * 2**50).alias("w"))
    ((_, _, spread),) = rows(aggregates.mean_and_spread(many, ["k"], ["w"]))
    assert spread == pytest.approx(statistics.pstdev(i * 2**50 for i in range(40)), rel=1e-9)


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, tmp_path):
    games = spark.range(200).selectExpr("CAST(id AS STRING) AS match_id", "id % 3 AS ground")
    scores = spark.range(600).selectExpr("CAST(id % 200 AS STRING) AS match_id", "id AS runs")
    teams = spark.createDataFrame([(1, "A")], "team_id long, team_name string")
    stored = catalogue.store_star(spark, "bucket_test", str(tmp_path / "db"), {"matches": games, "batting": scores, "teams": teams}, 4)
    total = stored["matches"].join(stored["batting"].hint("merge"), "match_id").groupBy("match_id").agg(F.sum("runs").alias("runs"))
    assert "Exchange" not in total._jdf.queryExecution().executedPlan().toString()
    assert total.count() == 200 and total.agg(F.sum("runs")).first()[0] == sum(range(600))
    games.createOrReplaceTempView("passing_view")
    assert catalogue.describe(spark, "bucket_test") == [("batting", "match_id"), ("matches", "match_id"), ("teams", "")]
    again = catalogue.store_star(spark, "bucket_test", str(tmp_path / "db"), {"matches": games.limit(5)}, 4)
    assert again["matches"].count() == 5


def test_longer_tables_get_more_buckets(spark):
    star = {"matches": spark.range(40).selectExpr("id AS match_id"), "batting": spark.range(101).selectExpr("id AS match_id"), "teams": spark.range(9999)}
    assert [catalogue.bucket_count(star, 4, rows) for rows in (1000, 25, 10)] == [4, 5, 11]
    assert catalogue.bucket_count({"teams": star["teams"]}, 4) == 4


def test_group_limit_runs_before_the_shuffle(spark, folder):
    from tallyfield.registry import QUERIES, load_all

    load_all() if "topk_per_group" not in QUERIES else None
    plan = QUERIES["topk_per_group"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_duplicate_query_names_are_refused():
    from tallyfield import registry

    registry.load_all()
    with pytest.raises(ValueError):
        registry.query("f_training")(lambda spark, folder: None)


def test_last_rows_are_picked_from_dealt_out_rows(spark):
    """A scan's rows are dealt out before they are sorted by key, those of a long key to several tasks."""
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id", F.lit("x").alias("text"))
    last = cleaning.keep_last(df, ["k"], ["id"])
    assert "RepartitionByExpression" in last._jdf.queryExecution().optimizedPlan().toString()
    assert last.where("k = 'hot'").collect() == [("hot", 3998, "x")]
    assert last.count() == 1 + 1334


def test_scores_without_a_contest_stay(spark, monkeypatch):
    monkeypatch.setattr(records.ordered, "tasks_for", lambda spark, rows: 5)
    facts = spark.createDataFrame([("m1", 1, 7, 3), (None, 1, 7, 4), ("gone", 1, 7, 5)], "match_id string, batsman_id long, team_id long, runs int")
    matches = spark.createDataFrame([("m1", "G", None)], "match_id string, ground string, match_date date")
    players = spark.createDataFrame([(1, "P")], "player_id long, name string")
    teams = spark.createDataFrame([(7, "T")], "team_id long, team_name string")
    placed = records.performances_from_star(facts, matches, players, teams, "batsman_id", "team_id")
    assert sorted((r["runs"], r["venue"], r["player"], r["team"]) for r in placed.collect()) == [(3, "G", "P", "T"), (4, None, "P", "T"), (5, None, "P", "T")]
    assert "RepartitionByExpression" in placed._jdf.queryExecution().optimizedPlan().toString()
