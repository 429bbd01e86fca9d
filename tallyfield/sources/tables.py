"""Delimited text in, typed tables out."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Texts a delimited file uses for a missing field.
MISSING_TOKENS = ("", "nan", "NaN", "NA", "N/A", "n/a", "NULL", "null", "None")

# Columns of the raw text tables.
RAW_MATCHES = ("team1", "team2", "winner", "margin", "ground", "matchDate", "match_id")
RAW_BATTING = ("match", "teamInnings", "battingPos", "batsmanName", "dismissal", "runs", "balls", "4s", "6s", "SR")
RAW_BOWLING = (
    "match", "bowlingTeam", "bowlerName", "overs", "maiden", "runs", "wickets", "economy",
    "0s", "4s", "6s", "wides", "noBalls",
)
RAW_PLAYERS = ("name", "team", "battingStyle", "bowlingStyle", "playingRole", "description")


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


# Columns of the star schema.
TEAMS = _schema(team_id=LongType, team_name=StringType, created_at=TimestampType)
PLAYERS = _schema(
    player_id=LongType, name=StringType, team_id=LongType, image=StringType, batting_style=StringType,
    bowling_style=StringType, playing_role=StringType, description=StringType, created_at=TimestampType,
)
MATCHES = _schema(
    match_id=StringType, team1_id=LongType, team2_id=LongType, winner_id=LongType, winner_text=StringType,
    margin=StringType, ground=StringType, match_date=DateType, created_at=TimestampType,
)
BATTING = _schema(
    match_id=StringType, team_innings_id=LongType, batsman_id=LongType, batting_pos=LongType, runs=LongType,
    balls=LongType, fours=LongType, sixes=LongType, strike_rate=DoubleType, dismissal=StringType,
    created_at=TimestampType,
)
BOWLING = _schema(
    match_id=StringType, bowling_team_id=LongType, bowler_id=LongType, overs=DoubleType, maiden=LongType,
    runs=LongType, wickets=LongType, economy=DoubleType, zeros=LongType, fours=LongType,
    sixes=LongType, wides=LongType, no_balls=LongType, created_at=TimestampType,
)


class MissingInput(FileNotFoundError):
    """An input table is not there; the caller decides whether to skip it or to stop."""


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in columns])


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    missing: Sequence[str] = MISSING_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV as text columns with true NULLs.

    Only the header line is looked at beforehand; no pass is spent on inferring types. Columns are matched to
    the header by name: those the file lacks are left out, others it has are not read. A folder whose files have
    different headers fails when it is read; read such files apart and join them with ``unionByName``. Set
    ``multi_line`` for files whose quoted fields contain line breaks; such files cannot be split among tasks.
    """
    require_inputs(spark, [path])
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path).columns
    rows = reader.schema(text_schema(header)).option("enforceSchema", False).csv(path)
    found = [name for name in columns if name in header]
    return rows.select(*[F.when(~F.col(f"`{n}`").isin(*missing), F.col(f"`{n}`")).alias(n) for n in found])


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> None:
    """Stop before anything is loaded if one of the paths is missing."""
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                raise MissingInput(path) from problem
            raise


def present_inputs(spark: SparkSession, paths: Mapping[str, str]) -> tuple[dict[str, str], list[str]]:
    """Skip form of the gate: the inputs that are there, and the names of those that are not, each with a warning."""
    there, absent = {}, []
    for name, path in paths.items():
        try:
            require_inputs(spark, [path])
        except MissingInput:
            warnings.warn(f"input {name} is missing and left out: {path}", stacklevel=2)
            absent.append(name)
        else:
            there[name] = path
    return there, absent


def write_delimited(df: DataFrame, path: str) -> None:
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**exact).csv(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto a declared schema: its columns, order and types; absent columns are NULL, a load time is added."""
    columns = []
    for field in schema:
        if field.name == "created_at" and "created_at" not in df.columns:
            columns.append(F.current_timestamp().alias("created_at"))
        elif field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet sink; ``mode="append"`` adds to what is there."""
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Tables and temporary views in use; with ``database`` that database's own tables only."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not (database and t.isTemporary))


def run_sql(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL text over named DataFrames (``{name}`` in the text) with bound parameters (``:name``)."""
    return spark.sql(text, args=args or {}, **tables)
