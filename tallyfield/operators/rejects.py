"""Clean and rejected rows from one pass, every rejected row with the reasons.

Rules are named Boolean columns that say what is wrong; a NULL result is no finding. They are evaluated once per row;
the flagged rows are stored in two folders by one write, and the counts come from that write's observation, so the
numbers of rows read, kept and rejected always add up. Repeated rows are judged alike; an empty table gives two empty ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions import numbers
from tallyfield.functions.text import strip
from tallyfield.sources.tables import MISSING_TOKENS

REASONS = "reject_reasons"
_SIDE = "_rejected"


def missing(column: str) -> dict[str, Column]:
    """No text, or one that stands for a missing value."""
    bare = strip(F.col(column).cast("string"))
    return {f"no {column}": bare.isNull() | bare.isin(*MISSING_TOKENS)}


def _there(column: str) -> Column:
    bare = strip(F.col(column).cast("string"))
    return bare.isNotNull() & ~bare.isin(*MISSING_TOKENS)


def no_number(column: str) -> dict[str, Column]:
    """Text is there but is no number."""
    return {f"{column} is no number": _there(column) & numbers.to_number(F.col(column).cast("string")).isNull()}


def no_date(column: str) -> dict[str, Column]:
    """Text is there but is no date of any known format."""
    return {f"{column} is no date": _there(column) & numbers.to_date_any(F.col(column).cast("string")).isNull()}


def rules(required: Sequence[str] = (), numeric: Sequence[str] = (), dates: Sequence[str] = ()) -> dict[str, Column]:
    """The usual rules; a column may be both required and typed."""
    every: dict[str, Column] = {}
    for make, columns in ((missing, required), (no_number, numeric), (no_date, dates)):
        for column in columns:
            every |= make(column)
    return every


def flagged(df: DataFrame, checks: Mapping[str, Column], into: str = REASONS) -> DataFrame:
    """``df`` with the array of reasons, empty for clean rows; reasons are in the order of the rules."""
    findings = F.array(*[F.when(F.coalesce(check, F.lit(False)), F.lit(reason)) for reason, check in checks.items()])
    return df.withColumn(into, F.array_compact(findings).cast("array<string>"))


@dataclass(frozen=True)
class Split:
    """``clean`` has the columns of the input; ``rejected`` has the reasons as well."""

    clean: DataFrame
    rejected: DataFrame
    read: int
    kept: int
    refused: int


def split(df: DataFrame, checks: Mapping[str, Column], path: str, into: str = REASONS) -> Split:
    """Write clean and rejected rows below ``path`` in one pass and count them on the way."""
    if into in df.columns or _SIDE in df.columns:
        raise ValueError(f"columns {into} and {_SIDE} are taken; name another one for the reasons")
    spark, watch = df.sparkSession, Observation()
    marked = flagged(df, checks, into).withColumn(_SIDE, F.size(into) > 0)
    counted = marked.observe(watch, F.count(F.lit(1)).alias("read"), F.count_if(_SIDE).alias("refused"))
    counted.write.partitionBy(_SIDE).parquet(path)
    counts = watch.get
    stored = StructType([f for f in marked.schema.fields if f.name != _SIDE])

    def side(name: str, rows: int) -> DataFrame:
        return spark.read.schema(stored).parquet(f"{path}/{_SIDE}={name}") if rows else spark.createDataFrame([], stored)

    kept = counts["read"] - counts["refused"]
    return Split(side("false", kept).drop(into), side("true", counts["refused"]), counts["read"], kept, counts["refused"])


def by_reason(rejected: DataFrame, into: str = REASONS) -> DataFrame:
    """Rows per reason; a row with two reasons counts for both."""
    return rejected.select(F.explode(into).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
