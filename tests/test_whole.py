"""From raw files to a saved model in one call."""

import csv
import random

import pytest
from conftest import rows

from tallyfield.plans import models, whole
from tallyfield.sources import tables


def write(path, columns, records):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file).writerows([columns, *records])
    return str(path)


@pytest.fixture
def raw(tmp_path):
    rng = random.Random(5)
    sides = ["India", "Nepal", "Oman", "Kenya", "Fiji"]
    games = []
    for n in range(120):
        one, two = rng.sample(sides, 2)
        winner = rng.choices([one, two, "no result"], [6 if one < two else 3, 3, 1])[0]
        games.append([one, f" {two}", winner, "5 runs", rng.choice("GH"), f"2023-{1 + n // 28:02d}-{1 + n % 28:02d}", f"T # {n}"])
    games += [games[0], ["India", "Nepal", "India", "1 run", "G", "someday", "T # 999"]]
    known = f"{games[119][0]} Vs {games[119][1].strip()}"
    bat = [[known, games[119][0], "1", "Ann†", "b X", "10", "5", "1", "0", "200"], ["Mars Vs Venus", "Mars", "1", "Eve", "b", "1", "1", "0", "0", "100"]]
    people = [["Ann", games[119][0], "Left", "nan", "Bat", "d"], ["Ann", games[119][0], "Right", "x", "y", "z"]]
    return {
        "matches": write(tmp_path / "m.csv", tables.RAW_MATCHES, games),
        "batting": write(tmp_path / "b.csv", tables.RAW_BATTING, bat),
        "players": write(tmp_path / "p.csv", tables.RAW_PLAYERS, people),
        "bowling": str(tmp_path / "nowhere.csv"),
    }


def test_whole_path(spark, raw, tmp_path):
    with pytest.warns(UserWarning, match="bowling"):
        done = whole.run(spark, raw, str(tmp_path / "star"), str(tmp_path / "model"))
    assert done.version == 1 and done.absent == ["bowling"]
    assert [done.star[n].count() for n in versions_in_order()] == [5, 1, 120, 1, 0]
    assert rows(done.star["players"], "name", "batting_style", "bowling_style") == [("Ann", "Left", None)]
    ((player, runs),) = rows(done.star["batting"], "batsman_id", "runs")
    assert (player, runs) == (1, 10)
    assert rows(done.unresolved["batting"], "batsmanName") == [("Eve",)]
    assert models.load(spark, str(tmp_path / "model")).name == done.trained.name


def versions_in_order():
    return ["teams", "players", "matches", "batting", "bowling"]


def test_contests_are_needed(spark, tmp_path):
    with pytest.warns(UserWarning), pytest.raises(tables.MissingInput):
        whole.load_files(spark, {"matches": str(tmp_path / "none.csv")}, str(tmp_path / "star"))
