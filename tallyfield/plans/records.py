"""Raw tables to clean tables to the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.numbers import iso_date
from tallyfield.functions.outcomes import outcome_label
from tallyfield.functions.text import fold_category
from tallyfield.operators import cleaning, keys, ordered
from tallyfield.sources import tables

BATTING_COUNTS = ("runs", "balls", "4s", "6s")
BOWLING_COUNTS = ("overs", "maiden", "runs", "wickets", "0s", "4s", "6s", "wides", "noBalls")


def clean_batting(raw: DataFrame) -> DataFrame:
    df = cleaning.drop_repeats(raw)
    df = cleaning.strip_columns(df, ["match", "teamInnings", "batsmanName", "dismissal"])
    df = cleaning.scrub_columns(df, ["batsmanName"])
    df = cleaning.numeric_columns(df, [*BATTING_COUNTS, "SR"])
    df = cleaning.fill_zero(df, BATTING_COUNTS)
    df = cleaning.map_columns(df, ["dismissal"], fold_category)
    df = cleaning.whole_columns(df, ["battingPos"])
    return cleaning.require(df, ["match", "teamInnings", "batsmanName"])


def clean_bowling(raw: DataFrame) -> DataFrame:
    df = cleaning.drop_repeats(raw)
    df = cleaning.strip_columns(df, ["match", "bowlingTeam", "bowlerName"])
    df = cleaning.scrub_columns(df, ["bowlerName"])
    df = cleaning.numeric_columns(df, [*BOWLING_COUNTS, "economy"])
    df = cleaning.fill_zero(df, BOWLING_COUNTS)
    return cleaning.require(df, ["match", "bowlingTeam", "bowlerName"])


def clean_players(raw: DataFrame, order: list[str]) -> DataFrame:
    """First record per player and team in arrival ``order``; names are cleaned before they are compared."""
    texts = ["name", "team", "battingStyle", "bowlingStyle", "playingRole", "description"]
    df = cleaning.strip_columns(raw, texts)
    df = cleaning.scrub_columns(df, ["name"])
    df = cleaning.null_tokens(df, texts)
    df = cleaning.require(df, ["name"])
    return cleaning.keep_first(df, ["name", "team"] if "team" in df.columns else ["name"], order)


def clean_matches(raw: DataFrame) -> DataFrame:
    df = cleaning.drop_repeats(raw)
    texts = ["team1", "team2", "winner", "margin", "ground", "scorecard"]
    df = cleaning.strip_columns(df, texts)
    df = cleaning.null_tokens(df, texts)
    df = cleaning.map_columns(df, ["matchDate"], iso_date)
    return cleaning.require(df, ["team1", "team2", "matchDate"])


def add_match_key(records: DataFrame, bridge: DataFrame) -> DataFrame:
    """Give score records the key of their contest through the text ``A Vs B``."""
    return keys.lookup_key(records, bridge, {"match": "pair_text"}, "match_id", "match_id")


def build_teams(matches: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Team dimension from the two sides; ``strict_reference`` also takes winner texts such as "no result" as teams."""
    columns = ["team1", "team2", *(["winner"] if strict_reference else [])]
    return tables.conform(keys.dimension(matches, columns, "team_name", "team_id"), tables.TEAMS)


def build_matches(matches: DataFrame, teams: DataFrame, order: list[str]) -> DataFrame:
    """Contest table with team keys; for a repeated match key the last row in ``order`` stays."""
    # Keys of contests repeat a few times at most, so one shuffle sized by rows brings their rows together.
    df = cleaning.keep_last(matches, ["match_id"], order, ordered.tasks_for(matches.sparkSession, matches.count()))
    for side in ("team1", "team2", "winner"):
        df = keys.lookup_key(df, teams, {side: "team_name"}, "team_id", f"{side}_id")
    df = df.withColumns({"winner_text": F.col("winner"), "match_date": F.col("matchDate").try_cast("date")})
    return tables.conform(df, tables.MATCHES)


def roster(players: DataFrame, teams: DataFrame, order: list[str]) -> DataFrame:
    """Players with their team's key, unique on (name, team), not numbered yet."""
    df = keys.lookup_key(players, teams, {"team": "team_name"}, "team_id", "team_id")
    return cleaning.keep_first(df, ["name", "team_id"], order)


def number_players(df: DataFrame, start: int = 0) -> DataFrame:
    """Player dimension from a roster; keys go on after ``start``."""
    df = df.withColumn("_identity", F.concat_ws("\u001f", "name", F.col("team_id").cast("string")))
    df = keys.number_names(df, "_identity", "player_id", start).drop("_identity")
    renamed = cleaning.rename_and_drop(
        df, {"battingStyle": "batting_style", "bowlingStyle": "bowling_style", "playingRole": "playing_role"}
    )
    return tables.conform(renamed, tables.PLAYERS)


def build_players(players: DataFrame, teams: DataFrame, order: list[str]) -> DataFrame:
    """Player dimension, unique on (name, team)."""
    return number_players(roster(players, teams, order))


def _player_keys(records: DataFrame, players: DataFrame, name: str, team_id: str, into: str) -> DataFrame:
    """Resolve a player by name and team, so that namesakes in two teams stay apart; else by a name that only one
    player has, whatever the team. ``keys.ambiguous_names`` lists the names that stay open."""
    df = keys.lookup_key(records, players, {name: "name", team_id: "team_id"}, "player_id", "_exact")
    alone = players.groupBy("name").agg(F.min("player_id").alias("player_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    df = keys.lookup_key(df, alone, {name: "name"}, "player_id", "_alone")
    return df.withColumn(into, F.coalesce("_exact", "_alone")).drop("_exact", "_alone")


def build_batting(batting: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    df = keys.lookup_key(batting, teams, {"teamInnings": "team_name"}, "team_id", "team_innings_id")
    df = _player_keys(df, players, "batsmanName", "team_innings_id", "batsman_id")
    names = {"battingPos": "batting_pos", "4s": "fours", "6s": "sixes", "SR": "strike_rate"}
    return tables.conform(cleaning.rename_and_drop(df, names), tables.BATTING)


def build_bowling(bowling: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    df = keys.lookup_key(bowling, teams, {"bowlingTeam": "team_name"}, "team_id", "bowling_team_id")
    df = _player_keys(df, players, "bowlerName", "bowling_team_id", "bowler_id")
    names = {"0s": "zeros", "4s": "fours", "6s": "sixes", "noBalls": "no_balls"}
    return tables.conform(cleaning.rename_and_drop(df, names), tables.BOWLING)


def load_star_schema(
    spark: SparkSession,
    target: str,
    matches: DataFrame,
    players: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    match_order: list[str],
    player_order: list[str],
    strict_reference: bool = False,
) -> dict[str, DataFrame]:
    """Write the five tables, dimensions first; facts look their keys up in the written dimensions."""
    loaded: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        tables.write_table(df, f"{target}/{name}")
        loaded[name] = tables.read_table(spark, f"{target}/{name}", df.schema)
        return loaded[name]

    teams = store("teams", build_teams(matches, strict_reference))
    store("matches", build_matches(matches, teams, match_order))
    roster = store("players", build_players(players, teams, player_order))
    store("batting", build_batting(batting, teams, roster))
    store("bowling", build_bowling(bowling, teams, roster))
    return loaded


def contests_from_star(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Contests with names, outcome and date: the base table of the features.

    Rows without any winner text or without a date are left out. A text that names neither side ("no result")
    keeps its row with an unknown outcome. ``winner`` is the name of the side that won, or that text.
    """
    one = teams.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("side1"))
    two = teams.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("side2"))
    df = matches.where(F.col("winner_text").isNotNull() & F.col("match_date").isNotNull())
    outcome = outcome_label(F.col("winner_id"), F.col("team1_id"), F.col("team2_id"))
    return df.join(one, "team1_id").join(two, "team2_id").select(
        F.col("match_id").alias("contest_id"), "side1", "side2", outcome.alias("side1_won"),
        F.col("ground").alias("venue"), F.col("match_date").alias("contest_date"),
        F.when(F.col("winner_id") == F.col("team1_id"), F.col("side1")).when(F.col("winner_id") == F.col("team2_id"), F.col("side2"))
        .otherwise(F.col("winner_text")).alias("winner"), "margin",
    )


def performances_from_star(facts: DataFrame, matches: DataFrame, players: DataFrame, teams: DataFrame, player_id: str, team_id: str):
    """Batting or bowling rows with the player's and the team's name, the ground and the date of the contest.

    Facts whose player or contest is not known stay, with NULL in those columns.
    """
    who = players.select(F.col("player_id").alias(player_id), F.col("name").alias("player"))
    side = teams.select(F.col("team_id").alias(team_id), F.col("team_name").alias("team"))
    where = matches.select("match_id", F.col("ground").alias("venue"), F.col("match_date").alias("contest_date"))
    # Sized by rows: the octets of a shuffle say little about short rows, and the sort of a task would spill.
    tasks = ordered.tasks_for(facts.sparkSession, facts.count())
    if tasks:
        named = facts.where("match_id IS NOT NULL").repartition(tasks, "match_id").join(where, "match_id", "left")
        placed = named.unionByName(facts.where("match_id IS NULL"), allowMissingColumns=True)
    else:
        placed = facts.join(where, "match_id", "left")
    return placed.join(who, player_id, "left").join(side, team_id, "left")
