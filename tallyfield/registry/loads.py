"""Versioned loads, rejected loads, rejected rows, the skipping gate."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from tallyfield.operators import ordered, rejects
from tallyfield.plans import versions
from tallyfield.plans.adapters import CONTESTS_SQL, contest_table, table
from tallyfield.registry import query
from tallyfield.registry.cleaning import SPOILT_DATE
from tallyfield.session import fresh_path
from tallyfield.sources import tables

_targets: dict[tuple[str, str], str] = {}

# First load: what was known at the end of 1995, with a preliminary margin. Second load: everything from mid 1995 on.
FIRST_UNTIL, SECOND_FROM = "1995-12-31", "1995-07-01"


def _inputs(spark, folder):
    games = contest_table(spark, folder)
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    matches = games.select(
        F.col("contest_id").cast("string").alias("match_id"), F.col("side1").alias("team1"), F.col("side2").alias("team2"),
        "winner", F.col("margin").cast("string").alias("margin"), F.col("venue").alias("ground"),
        F.col("contest_date").cast("string").alias("matchDate"),
    )
    players = supplier.select(F.col("s_name").alias("name"), F.col("n_name").alias("team"))
    # Each contest gives one batting row for its first side.
    batting = matches.select("match_id", F.col("team1").alias("teamInnings"), F.lit("Nobody known").alias("batsmanName"), F.lit(1).alias("runs"), "matchDate")
    bowling = matches.select("match_id", F.col("team2").alias("bowlingTeam"), F.lit("Nobody known").alias("bowlerName"), F.lit(2).alias("runs"), "matchDate")
    return matches, players, batting, bowling


def loaded_twice(spark, folder) -> str:
    """Target of two loads: the second one goes on with new contests and replaces half a year of old ones."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _targets:
        target = fresh_path(spark, "versions")
        matches, players, batting, bowling = _inputs(spark, folder)
        early, late = F.col("matchDate") <= FIRST_UNTIL, F.col("matchDate") > FIRST_UNTIL
        first = matches.where(early).withColumn("margin", F.lit("preliminary"))
        some = players.where("team < 'J'")
        load = lambda *parts: versions.load_version(spark, target, *parts, ["matchDate"], ["name"])
        load(first, some, batting.where(early), bowling.where(early))
        load(matches.where(F.col("matchDate") >= SECOND_FROM), players, batting.where(late), bowling.where(late))
        _targets[key] = target
    return _targets[key]


@query(
    "star_second_load",
    f"""WITH {CONTESTS_SQL} SELECT CAST(contest_id AS VARCHAR) AS match_id, side1, side2, winner AS winner_text,
          CASE WHEN contest_date < DATE '{SECOND_FROM}' THEN 'preliminary' ELSE CAST(margin AS VARCHAR) END AS margin,
          1 AS batting_rows, 2 AS bowling_runs FROM contests""",
)
def star_second_load(spark, folder):
    """Contests after two loads, each once, with their score rows."""
    now = versions.read_version(spark, loaded_twice(spark, folder))
    one = now["teams"].select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("side1"))
    two = now["teams"].select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("side2"))
    # All three are dealt out by contest and sized by rows; names come last, so that only keys of teams move.
    tasks = ordered.tasks_for(spark, sum(now[name].count() for name in ("matches", "batting", "bowling")))
    games, batted, bowled = (ordered.dealt(now[name], ["match_id"], tasks) for name in ("matches", "batting", "bowling"))
    bats = batted.groupBy("match_id").agg(F.count(F.lit(1)).alias("batting_rows"))
    bowls = bowled.groupBy("match_id").agg(F.sum("runs").alias("bowling_runs"))
    named = games.join(bats, "match_id").join(bowls, "match_id").join(one, "team1_id").join(two, "team2_id")
    return named.select("match_id", "side1", "side2", "winner_text", "margin", "batting_rows", "bowling_runs")


@query(
    "star_stable_keys",
    f"""WITH {CONTESTS_SQL}, known AS (SELECT side1 AS side FROM contests UNION SELECT side2 FROM contests),
        early AS (SELECT s_name, n_name, n_name < 'J' AS before FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT s_name AS player, before AS in_first_load, before AS key_kept FROM early""",
)
def star_stable_keys(spark, folder):
    """Every player: whether the first load knew them, and whether the second load left them their key."""
    target = loaded_twice(spark, folder)
    before = versions.read_version(spark, target, 1)["players"].select(F.col("name").alias("player"), F.col("player_id").alias("old"))
    now = versions.read_version(spark, target, 2)["players"].select(F.col("name").alias("player"), "player_id")
    both = now.join(before, "player", "left")
    return both.select("player", F.col("old").isNotNull().alias("in_first_load"), F.col("old").eqNullSafe(F.col("player_id")).alias("key_kept"))


@query(
    "star_rejected_load",
    f"""WITH {CONTESTS_SQL} SELECT 'batting: match_id unknown in matches' AS rule, count(*) AS rows, 2 AS version_in_force,
          (SELECT count(*) FROM contests) AS matches_in_force FROM orders""",
)
def star_rejected_load(spark, folder):
    """A third load whose score rows name contests nobody has heard of: refused, the second one stays in force."""
    target = loaded_twice(spark, folder)
    matches, players, batting, bowling = _inputs(spark, folder)
    strange = table(spark, folder, "orders").select(
        F.concat(F.lit("?"), F.col("o_orderkey").cast("string")).alias("match_id"), F.lit("x").alias("teamInnings"), F.lit("y").alias("batsmanName")
    )
    broken = []
    try:
        versions.load_version(spark, target, matches, players, strange, bowling.limit(0), ["matchDate"], ["name"])
    except versions.RejectedLoad as refused:
        broken = refused.broken
    findings = spark.createDataFrame(broken, "rule string, rows long")
    kept = versions.read_version(spark, target)["matches"].count()
    in_force = F.lit(versions.newest(spark, target)).cast("long").alias("version_in_force")
    return findings.select("*", in_force, F.lit(kept).cast("long").alias("matches_in_force"))


_RAW = f"""SELECT CAST(o_orderkey AS STRING) AS match_id, CASE WHEN o_orderstatus = 'F' THEN ' nan' ELSE o_clerk END AS team1,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat(o_totalprice, ' dollars') ELSE CAST(o_totalprice AS STRING) END AS margin,
  {SPOILT_DATE} AS matchDate"""


@query(
    "clean_rejects",
    """SELECT CAST(o_orderkey AS VARCHAR) AS match_id, array_to_string(list_filter([
           CASE WHEN o_orderstatus = 'F' THEN 'no team1' END,
           CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'no matchDate' END,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'margin is no number' END,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'matchDate is no date' END], lambda r: r IS NOT NULL), '; ') AS reasons,
         (SELECT count(*) FROM orders) AS read FROM orders
       WHERE o_orderstatus = 'F' OR o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')""",
)
def clean_rejects(spark, folder):
    """Rejected rows with their reasons; the counts of clean and rejected rows add up to those read."""
    orders = table(spark, folder, "orders").withColumn("o_clerk", F.concat(F.lit("Side "), F.col("o_custkey").cast("string")))
    raw = spark.sql(f"{_RAW} FROM {{orders}}", orders=orders)
    checks = rejects.rules(required=["team1", "matchDate"], numeric=["margin"], dates=["matchDate"])
    parts = rejects.split(raw, checks, fresh_path(spark, "rejects"))
    reasons = F.array_join(rejects.REASONS, "; ").alias("reasons")
    return parts.rejected.select("match_id", reasons, F.lit(parts.kept + parts.refused).cast("long").alias("read"))


@query(
    "gate_skip",
    """SELECT 'customer' AS dataset, true AS present, count(*) AS rows FROM customer UNION ALL SELECT 'nowhere', false, 0
       UNION ALL SELECT 'orders', true, count(*) FROM orders""",
)
def gate_skip(spark, folder):
    """Data sets that are there are loaded; the one that is missing is left out and named."""
    paths = {name: f"{folder}/{name}.parquet" for name in ("customer", "nowhere", "orders")}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        there, absent = tables.present_inputs(spark, paths)
    result = spark.createDataFrame([(name, False, 0) for name in absent], "dataset string, present boolean, rows long")
    for name, path in there.items():
        counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        result = result.unionByName(counted.select(F.lit(name).alias("dataset"), F.lit(True).alias("present"), "rows"))
    return result
