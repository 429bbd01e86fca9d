"""Versioned loads and rejected rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfield.operators import keys, rejects
from tallyfield.plans import versions
from tallyfield.sources import tables

MATCH = "match_id string, team1 string, team2 string, winner string, margin string, ground string, matchDate string"
BAT = "match_id string, teamInnings string, batsmanName string, runs long"
BOWL = "match_id string, bowlingTeam string, bowlerName string, runs long"


def load(spark, target, matches, players=(), batting=(), bowling=()):
    return versions.load_version(
        spark, target, spark.createDataFrame(matches, MATCH), spark.createDataFrame(list(players), "name string, team string"),
        spark.createDataFrame(list(batting), BAT), spark.createDataFrame(list(bowling), BOWL), ["matchDate"], ["name"],
    )


def game(key, one, two, day, margin="m"):
    return (key, one, two, one, margin, "g", day)


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "star")


def keyed(df, name, key):
    return {r[name]: r[key] for r in df.collect()}


def test_second_load_goes_on(spark, target):
    first = [game("1", "A", "B", "2024-01-05"), game("2", "A", "B", "2024-02-05"), game("3", "B", "A", None)]
    assert load(spark, target, first, [("Ann", "A"), ("Bo", None)], [("1", "A", "Ann", 10)]) == 1
    second = [game("2", "A", "C", "2024-03-01", "new"), game("4", "C", "B", "2024-03-02")]
    assert load(spark, target, second, [("Ann", "A"), ("Ann", "C"), ("Bo", None)], [("4", "C", "Ann", 7)], [("4", "B", "Zed", 1)]) == 2
    old, new = versions.read_version(spark, target, 1), versions.read_version(spark, target)
    before, after = keyed(old["teams"], "team_name", "team_id"), keyed(new["teams"], "team_name", "team_id")
    assert {k: after[k] for k in before} == before and sorted(after.values()) == [1, 2, 3]
    assert rows(new["matches"], "match_id", "margin") == [("1", "m"), ("2", "new"), ("3", "m"), ("4", "m")]
    assert rows(old["matches"], "match_id") == [("1",), ("2",), ("3",)]
    assert set(rows(old["players"], "player_id", "name")) <= set(rows(new["players"], "player_id", "name"))
    assert new["players"].count() == 3 and new["players"].select("player_id").distinct().count() == 3
    people = {(r["name"], r["team_id"]): r["player_id"] for r in new["players"].collect()}
    assert rows(new["batting"], "match_id", "batsman_id") == [("1", people["Ann", after["A"]]), ("4", people["Ann", after["C"]])]
    months = {e.month: e.path for e in versions.entries(spark, target, 2) if e.table_name == "matches"}
    earlier = {e.month: e.path for e in versions.entries(spark, target, 1) if e.table_name == "matches"}
    # February is empty now, January and the undated contest are the files of the first load.
    assert set(months) == {"2024-01", "2024-03", versions.UNDATED}
    assert months["2024-01"] == earlier["2024-01"] and months[versions.UNDATED] == earlier[versions.UNDATED]


def test_rejected_load_leaves_the_old_version(spark, target):
    load(spark, target, [game("1", "A", "B", "2024-01-05")], [("Ann", "A")], [("1", "A", "Ann", 10)])
    with pytest.raises(versions.RejectedLoad) as refused:
        load(spark, target, [game("2", "A", None, "2024-01-06")], [("Eve", "A")], [("9", "A", "Ann", 1), (None, "A", "Ann", 1)])
    assert refused.value.broken == [("batting: match_id unknown in matches", 1), ("batting: no match_id", 1), ("matches: no team2_id", 1)]
    now = versions.read_version(spark, target)
    assert versions.newest(spark, target) == 1
    assert rows(now["matches"], "match_id") == [("1",)] and rows(now["players"], "name") == [("Ann",)] and now["batting"].count() == 1


def test_incoming_contests_are_worked_out_once(spark, target):
    load(spark, target, [game("1", "A", "B", "2024-01-05"), game("2", "A", "B", "2024-01-06"), game("3", "A", "B", "2024-02-06")])
    worked = spark.sparkContext.accumulator(0)

    def counted(margin):
        worked.add(1)
        return margin

    second = [game("1", "A", "B", "2024-01-05", "new"), game("3", "A", "B", "2024-03-06", "new"), game("4", "B", "A", None, "new")]
    matches = spark.createDataFrame(second, MATCH).withColumn("margin", F.udf(counted, "string")("margin"))
    none = [spark.createDataFrame([], s) for s in ("name string, team string", BAT, BOWL)]
    versions.load_version(spark, target, matches, *none, ["matchDate"], ["name"])
    assert worked.value == len(second)
    now = versions.read_version(spark, target)["matches"]
    assert rows(now, "match_id", "margin") == [("1", "new"), ("2", "m"), ("3", "new"), ("4", "new")]
    months = sorted(e.month for e in versions.entries(spark, target, 2) if e.table_name == "matches")
    assert months == ["2024-01", "2024-01", "2024-03", versions.UNDATED]


def test_rules_of_one_key_in_one_pass(spark):
    parent = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "id string")
    one = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "ref string")
    two = spark.createDataFrame([("y",), ("b",)], "of string")
    found = keys.broken_links(parent, "id", {"one": (one, "ref"), "two": (two, "of")}, "twice")
    assert rows(found) == [("one", 2), ("twice", 2), ("two", 1)]
    assert rows(keys.broken_links(parent.limit(0), "id", {"none": (one.limit(0), "ref")}, "twice")) == [("none", 0), ("twice", 0)]
    # Parent, uses: their keys move together, once.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0


def test_same_load_again_and_empty_load(spark, target):
    assert versions.read_version(spark, target)["teams"].count() == 0
    for number in (1, 2):
        assert load(spark, target, [game("1", "A", "B", "2024-01-05")], [("Ann", "A")]) == number
    assert load(spark, target, []) == 3
    now = versions.read_version(spark, target)
    assert [now[n].count() for n in ("teams", "players", "matches", "batting")] == [2, 1, 1, 0]


def test_a_version_is_written_once(spark, target):
    load(spark, target, [game("1", "A", "B", "2024-01-05")])
    with pytest.raises(Exception, match="already exists"):
        spark.range(1).write.mode("error").json(f"{target}/manifests/{1:08d}")


def test_split_counts_and_reasons(spark, tmp_path):
    data = [("a", "1", "2024-01-01"), ("nan", "x", "soon"), (None, None, None), ("a", "1", "2024-01-01"), ("b", " 2.5 ", "")]
    raw = spark.createDataFrame(data, "team string, runs string, day string")
    parts = rejects.split(raw, rejects.rules(["team"], ["runs"], ["day"]), str(tmp_path / "s"))
    assert (parts.read, parts.kept, parts.refused) == (5, 3, 2)
    assert parts.clean.columns == raw.columns
    assert rows(parts.clean) == sorted([data[0], data[3], data[4]])
    assert rows(parts.rejected, "team", "reject_reasons") == [
        (None, ["no team"]), ("nan", ["no team", "runs is no number", "day is no date"]),
    ]
    assert rows(rejects.by_reason(parts.rejected)) == [("day is no date", 1), ("no team", 2), ("runs is no number", 1)]


def test_split_of_nothing_and_clashing_names(spark, tmp_path):
    raw = spark.createDataFrame([("a",)], "team string")
    parts = rejects.split(raw.limit(0), rejects.rules(["team"]), str(tmp_path / "e"))
    assert (parts.read, parts.clean.count(), parts.rejected.count()) == (0, 0, 0)
    with pytest.raises(ValueError):
        rejects.split(raw.withColumnRenamed("team", rejects.REASONS), {}, str(tmp_path / "c"))
    other = rejects.split(raw.withColumnRenamed("team", rejects.REASONS), rejects.missing(rejects.REASONS), str(tmp_path / "d"), "why")
    assert rows(other.clean) == [("a",)]


def test_gate_warns_and_leaves_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    with pytest.warns(UserWarning, match="players"):
        there, absent = tables.present_inputs(spark, {"matches": str(tmp_path / "a.csv"), "players": str(tmp_path / "no.csv")})
    assert list(there) == ["matches"] and absent == ["players"]
