"""History features against plain loops, and the promise that a row never sees its own outcome."""

import datetime
import os
import random
import re
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfield.plans import features, records
from tallyfield.sources import tables

SCHEMA = "contest_id long, side1 string, side2 string, side1_won int, venue string, contest_date date"


def make(spark, count=400, seed=3):
    draw = random.Random(seed)
    sides = ["Hot", "Hot", "Hot", "Ant", "Bee", "Cat", "Dog"]
    data = []
    for i in range(count):
        one, two = draw.sample(sorted(set(sides)), 2) if draw.random() < 0.5 else ("Hot", draw.choice(sides[3:]))
        day = datetime.date(2022, 1, 1) + datetime.timedelta(days=draw.randrange(60))
        data.append((i, one, two, draw.choice([0, 1, None]), draw.choice(["Hot park", "Ground", None]), day))
    return data, spark.createDataFrame(data, SCHEMA).cache()


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def loops(data):
    """Every feature the slow way: (form1, form2, h2h, venue, neutral) per contest."""
    ordered = sorted(data, key=lambda r: (r[5], r[0]))
    out = {}
    for at, (ident, one, two, _, venue, day) in enumerate(ordered):
        form1 = [r[3] for r in ordered[:at] if r[1] == one][-5:]
        form2 = [None if r[3] is None else 1 - r[3] for r in ordered[:at] if r[2] == two][-5:]
        met = [r for r in data if {r[1], r[2]} == {one, two} and r[5] < day]
        wins = sum(1 for r in met if r[3] is not None and (r[3] == 1) == (r[1] == one))
        here = [r for r in data if r[1] == one and venue is not None and r[4] == venue and r[5] < day]
        place = (venue or "").lower()
        out[ident] = (
            mean(form1), mean(form2), wins / len(met) if met else 0.5,
            sum(r[3] or 0 for r in here) / len(here) if here else 0.5,
            0 if one.lower() in place or two.lower() in place else 1,
        )
    return out


@pytest.mark.parametrize("partitions", [1, 12])
def test_all_features_against_loops(spark, partitions):
    data, df = make(spark)
    out = features.add_all_features(df, partitions=partitions)
    assert {r[0]: tuple(r[1:]) for r in rows(out, "contest_id", *features.FEATURES)} == loops(data)


def test_training_frame_drops_unknown_labels_last(spark):
    data, df = make(spark)
    slow = loops(data)
    expected = sorted(r[0] for r in data if r[3] is not None and None not in slow[r[0]])
    frame = features.training_frame(df)
    assert [i for (i,) in rows(frame, "contest_id")] == expected
    kinds = dict(frame.dtypes)
    assert all(kinds[name] == "double" for name in features.FEATURES) and kinds["side1_won"] == "int"


def test_own_outcome_never_leaks(spark):
    data, df = make(spark, 200, 8)
    flipped = df.withColumn("side1_won", F.when(F.col("contest_id") == 50, 1 - F.coalesce("side1_won", F.lit(0))).otherwise(F.col("side1_won")))
    a = rows(features.add_all_features(df).where("contest_id = 50"), *features.FEATURES)
    b = rows(features.add_all_features(flipped).where("contest_id = 50"), *features.FEATURES)
    assert a == b


def test_form_over_both_columns(spark):
    data, df = make(spark, 150, 4)
    ordered = sorted(data, key=lambda r: (r[5], r[0]))
    expected = {}
    for at, (ident, one, two, *_) in enumerate(ordered):
        for side in (one, two):
            past = [(r[3] if r[1] == side else None if r[3] is None else 1 - r[3]) for r in ordered[:at] if side in r[1:3]]
            expected[(ident, side)] = mean(past[-5:])
    for partitions in (1, 10):
        out = features.form_over_all(df, partitions=partitions)
        assert {(i, s): f for i, s, f in rows(out, "contest_id", "side", "form")} == expected


def test_candidates_see_the_past_only_and_not_each_other(spark):
    data, df = make(spark)
    draw = random.Random(1)
    asked = []
    for i in range(60):
        one, two = draw.sample(["Hot", "Ant", "Bee", "Cat", "New"], 2)
        asked.append((i, one, two, draw.choice(["Hot park", "Ground", None]), datetime.date(2021, 12, 30) + datetime.timedelta(days=draw.randrange(70))))
    candidates = spark.createDataFrame(asked, "candidate_id long, side1 string, side2 string, venue string, as_of date")
    out = features.candidate_features(df, candidates)
    found = {r[0]: tuple(r[1:]) for r in rows(out, "candidate_id", *features.FEATURES)}
    for ident, one, two, venue, day in asked:
        before = [r for r in data if r[5] < day]
        alone = loops([*before, (-1, one, two, None, venue, day)])[-1]
        assert found[ident] == alone
    imputed = features.impute(out)
    assert imputed.where("was_imputed").count() == sum(1 for v in found.values() if None in v)
    assert imputed.where("side1_form IS NULL OR side2_form IS NULL").count() == 0


GOLDEN = os.environ.get("TALLYFIELD_MATCHES_CSV")


@pytest.mark.skipif(not GOLDEN, reason="TALLYFIELD_MATCHES_CSV names no raw match table")
def test_known_tournament(spark):
    """The 23 training rows and the counts listed in FIXTURES.md, from the raw match table."""
    raw = tables.read_delimited(spark, GOLDEN, tables.RAW_MATCHES)
    clean = records.clean_matches(raw)
    assert raw.count() == clean.count() == 45
    teams = records.build_teams(clean)
    assert teams.count() == 16 and records.build_teams(clean, strict_reference=True).count() == 18
    matches = records.build_matches(clean, teams, ["matchDate"])
    frame = features.training_frame(records.contests_from_star(matches, teams))
    text = Path(__file__).resolve().parents[1].joinpath("FIXTURES.md").read_text()
    lines = re.findall(r"^\| (T20I # \d+) \| ([^|]+) \| ([^|]+) \| ([\d.]+) \| ([\d.]+) \| ([\d.]+) \| (\d) \|$", text, re.M)
    expected = sorted((i, a, b, float(f1), float(f2), float(v), int(w)) for i, a, b, f1, f2, v, w in lines)
    assert len(expected) == 23
    names = ["contest_id", "side1", "side2", "side1_form", "side2_form", "venue_record", "side1_won"]
    out = [(*r[:3], *[round(x, 4) for x in r[3:6]], r[6]) for r in rows(frame, *names)]
    assert sorted(out) == expected
    assert rows(frame.select("head_to_head", "neutral_venue").distinct()) == [(0.5, 1.0)]
