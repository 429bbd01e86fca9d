"""Versioned loads of the star schema: staged, checked, then switched by one manifest.

A load writes only what it adds or changes below a folder of its own: new teams and players, whose keys go on after
those in use; the months of contests that it touches; its own score rows. Then the key rules are checked on the staged
version. Only if all hold is the manifest written, a single small file that lists the files' folders of every table; until that file is
there readers see the version before, so a load that fails or is rejected leaves nothing half done. Older versions
stay readable. Folders of rejected loads stay on disk and are listed by no manifest.

* **Teams and players**: known names keep their key and their row (insert or ignore).
* **Contests**: an incoming contest replaces the stored one with its key (insert or replace), also when its date moves
  to another month. Contests are stored by month of their date; untouched months are neither read nor written again.
* **Score rows** are added. Rows of a contest that was replaced stay.

Two loads at once: both stage, one manifest is written; the other load fails when it writes the same version's manifest.
What reaches the driver is the manifest: a line per load and table, and at most two per month of contests, those that
came in and those that stayed beside them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.operators import keys, ordered
from tallyfield.plans import records
from tallyfield.session import materialise
from tallyfield.sources import tables

SCHEMAS: dict[str, StructType] = {
    "teams": tables.TEAMS, "players": tables.PLAYERS, "matches": tables.MATCHES, "batting": tables.BATTING,
    "bowling": tables.BOWLING,
}
MANIFEST = "version long, table_name string, month string, path string"
UNDATED = "undated"

# What must be unique, what must be there, and which columns point at which dimension.
UNIQUE = {"teams": ["team_name"], "players": ["player_id"], "matches": ["match_id"]}
REQUIRED = {
    "teams": ["team_id", "team_name"], "players": ["name"], "matches": ["match_id", "team1_id", "team2_id"],
    "batting": ["match_id"], "bowling": ["match_id"],
}
FOREIGN = {
    "players": {"team_id": ("teams", "team_id")},
    "matches": {"team1_id": ("teams", "team_id"), "team2_id": ("teams", "team_id"), "winner_id": ("teams", "team_id")},
    "batting": {"match_id": ("matches", "match_id"), "batsman_id": ("players", "player_id")},
    "bowling": {"match_id": ("matches", "match_id"), "bowler_id": ("players", "player_id")},
}


class RejectedLoad(ValueError):
    """A staged version breaks key rules; ``broken`` lists (rule, rows)."""

    def __init__(self, broken: list[tuple[str, int]]) -> None:
        super().__init__("; ".join(f"{rule}: {rows} rows" for rule, rows in broken))
        self.broken = broken


@dataclass(frozen=True)
class Entry:
    """Folder with rows of a table; ``month`` is set for contests."""

    table_name: str
    month: str | None
    path: str


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """Every version's entries."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{target}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def newest(spark: SparkSession, target: str) -> int:
    """Number of the version in force; 0 before the first load."""
    return manifest(spark, target).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def entries(spark: SparkSession, target: str, version: int) -> list[Entry]:
    listed = manifest(spark, target).where(F.col("version") == version).collect()
    return [Entry(r["table_name"], r["month"], r["path"]) for r in listed]


def _read(spark: SparkSession, listed: Sequence[Entry], name: str, months: set[str] | None = None) -> DataFrame:
    paths = [e.path for e in listed if e.table_name == name and (months is None or e.month in months)]
    return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[name])


def read_version(spark: SparkSession, target: str, version: int | None = None) -> dict[str, DataFrame]:
    """The five tables of a version, of the one in force unless another is asked for."""
    listed = entries(spark, target, newest(spark, target) if version is None else version)
    return {name: _read(spark, listed, name) for name in SCHEMAS}


def _month(day: str = "match_date"):
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))


def _months(df: DataFrame) -> set[str]:
    return {r["month"] for r in df.select(_month().alias("month")).distinct().collect()}


def _sizes(df: DataFrame) -> dict[str, int]:
    """Rows of each month."""
    return {r["month"]: r["count"] for r in df.groupBy("month").count().collect()}


def _write_months(df: DataFrame, path: str) -> DataFrame:
    """Write contests by month of their date, and go on from the files."""
    df.withColumn("month", _month()).hint("rebalance", "month").write.partitionBy("month").parquet(path)
    return df.sparkSession.read.schema(SCHEMAS["matches"]).parquet(path)


def _replace_contests(spark: SparkSession, listed: list[Entry], incoming: DataFrame, stage: str) -> list[Entry]:
    """Stage every month that gains or loses a contest; the entries of the others go on as they are.

    Incoming contests are worked out once, as they are written; after that only their keys meet those of the stored ones, and
    whole rows of stored contests move in the touched months alone.
    """
    fresh = _write_months(incoming, f"{stage}/matches")
    parts, touched = {"matches": _months(fresh)}, _months(fresh)
    if any(e.table_name == "matches" for e in listed):
        stored = _read(spark, listed, "matches")
        tasks = ordered.tasks_for(spark, stored.count() + fresh.count())
        dealt = lambda df: ordered.dealt(df, ["match_id"], tasks)
        known = dealt(stored.where("match_id IS NOT NULL").select("match_id", _month().alias("month")))
        # Incoming keys are unique. Spark would move a semi or anti join in front of the shuffle that is sized by rows.
        replaced = materialise(known.join(dealt(fresh.select("match_id")), "match_id"), "replaced")
        gone = _sizes(replaced)
        touched = touched | set(gone)
        # Months that are replaced as a whole have no contest left to keep.
        had = _sizes(_read(spark, listed, "matches", touched).select(_month().alias("month")))
        before = _read(spark, listed, "matches", {month for month, rows in had.items() if rows > gone.get(month, 0)})
        unkeyed = before.where("match_id IS NULL")
        marked = dealt(replaced.select("match_id", F.lit(True).alias("_gone")))
        kept = dealt(before.where("match_id IS NOT NULL")).join(marked, "match_id", "left").where("_gone IS NULL")
        parts["kept"] = _months(_write_months(kept.select(*SCHEMAS["matches"].names).unionByName(unkeyed), f"{stage}/kept"))
    others = [e for e in listed if e.table_name == "matches" and e.month not in touched]
    staged = [Entry("matches", month, f"{stage}/{part}/month={month}") for part, months in parts.items() for month in sorted(months)]
    return others + staged


def violations(staged: dict[str, DataFrame], added: dict[str, DataFrame]) -> DataFrame:
    """Broken rules as (rule, rows). Uniqueness is checked on the whole staged dimension, the other rules on what is added."""
    found = []
    for name, columns in REQUIRED.items():
        nulls = keys.missing_values(added[name], columns)
        found.append(nulls.select(F.concat(F.lit(f"{name}: no "), "column_name").alias("rule"), F.col("nulls").alias("rows")))
    for name, columns in UNIQUE.items():
        if len(columns) > 1 or not any(to == (name, columns[0]) for links in FOREIGN.values() for to in links.values()):
            repeats = keys.repeated_keys(staged[name], columns).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
            found.append(repeats.select(F.lit(f"{name}: {', '.join(columns)} repeated").alias("rule"), "rows"))
    for parent, key in dict.fromkeys(to for links in FOREIGN.values() for to in links.values()):
        uses = {f"{name}: {column} unknown in {parent}": (added[name], column) for name, links in FOREIGN.items() for column, to in links.items() if to == (parent, key)}
        repeated = f"{parent}: {key} repeated" if UNIQUE[parent] == [key] else None
        found.append(keys.broken_links(staged[parent], key, uses, repeated))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.where("rows > 0")


def load_version(
    spark: SparkSession,
    target: str,
    matches: DataFrame,
    players: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    match_order: list[str],
    player_order: list[str],
) -> int:
    """Add cleaned tables as the next version and return its number; raise ``RejectedLoad`` if a key rule is broken."""
    base = newest(spark, target)
    listed = entries(spark, target, base)
    stage = f"{target}/data/{base + 1:08d}-{uuid.uuid4().hex}"

    def add(name: str, df: DataFrame) -> list[Entry]:
        tables.write_table(tables.conform(df, SCHEMAS[name]), f"{stage}/{name}")
        return [e for e in listed if e.table_name == name] + [Entry(name, None, f"{stage}/{name}")]

    staged: list[Entry] = []
    names = keys.entity_names(matches, ["team1", "team2"], "team_name")
    staged += add("teams", keys.new_members(_read(spark, listed, "teams"), names, "team_name", "team_id"))
    teams = _read(spark, staged, "teams")
    staged += add("players", _new_players(_read(spark, listed, "players"), records.roster(players, teams, player_order)))
    people = _read(spark, staged, "players")
    staged += _replace_contests(spark, listed, records.build_matches(matches, teams, match_order), stage)
    staged += add("batting", records.build_batting(batting, teams, people))
    staged += add("bowling", records.build_bowling(bowling, teams, people))

    own = [e for e in staged if e.path.startswith(stage)]
    broken = violations(
        {name: _read(spark, staged, name) for name in SCHEMAS}, {name: _read(spark, own, name) for name in SCHEMAS}
    ).collect()
    if broken:
        raise RejectedLoad(sorted((r["rule"], r["rows"]) for r in broken))
    lines = [(base + 1, e.table_name, e.month, e.path) for e in staged]
    # One file, put in place by a rename when its job commits; "error" refuses a version somebody else has written.
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("error").json(f"{target}/manifests/{base + 1:08d}")
    return base + 1


def _new_players(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Players whose name and team are not stored yet, numbered after those that are."""
    seen = known.select(F.col("name").alias("_name"), F.col("team_id").alias("_team"))
    same = (F.col("name") == F.col("_name")) & F.col("team_id").eqNullSafe(F.col("_team"))
    fresh = incoming.join(seen, same, "left_anti")
    return records.number_players(fresh, keys.highest_key(known, "player_id"))
