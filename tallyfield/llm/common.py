"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COMPARISONS: dict[str, str] = {}

#: A word: characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` must give the same rows and column names."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            COMPARISONS[name] = sql.strip()
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def pinned(df: DataFrame, **computed: Column) -> DataFrame:
    """``df`` with computed columns that are evaluated once a row.

    The optimizer copies the expression of a column into every place that uses it, also into lambdas, where it would run
    for each element. It does not look through a generator, so the values pass through one that yields a single row.
    """
    names = {c: free_name(df, c) for c in computed}
    pin = free_name(df, "pin")
    generated = df.select("*", F.explode(F.array(F.struct(*[v.alias(names[c]) for c, v in computed.items()]))).alias(pin))
    return generated.select(*[generated[c] for c in df.columns], *[F.col(f"{pin}.{n}").alias(n) for n in names.values()])


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; null counts 0."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone: 52 bits of an MD5 digest."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
