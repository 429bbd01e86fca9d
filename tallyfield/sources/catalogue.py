"""Star tables in Spark's catalogue, bucketed by the key they are joined on.

Facts and contests that are bucketed alike join, and facts are grouped by contest, without a shuffle. The shuffle is paid
once, when a table is written: rows are dealt out by the same hash first, so every bucket is one file. A contest has a few
dozen score rows, so its key cannot be hot; do not bucket by a key that can.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyfield.sources import tables

#: Rows that a bucket of the longest table holds on average, at most. One task sorts a bucket.
ROWS_A_BUCKET = 500_000


def open_database(spark: SparkSession, database: str, path: str) -> None:
    """Database whose tables live below ``path``, a folder that all executors reach."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{path}'")


def store_bucketed(df: DataFrame, database: str, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table in ``buckets`` files sorted by ``keys``; give tables that are joined the same number.

    NULL keys share a bucket. Parquet, replaced as a whole if it is there already.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"`{database}`.`{name}`")
    return df.sparkSession.table(f"`{database}`.`{name}`")


def bucket_count(star: Mapping[str, DataFrame], least: int, rows: int = ROWS_A_BUCKET) -> int:
    """Buckets for the tables of a star that are bucketed by contest, more for longer ones. Hand in stored tables: they are counted."""
    longest = max((df.count() for df in star.values() if "match_id" in df.columns), default=0)
    return max(least, -(-longest // rows))


def store_star(spark: SparkSession, database: str, path: str, star: Mapping[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """Contests and score rows bucketed by contest; teams and players as plain tables."""
    open_database(spark, database, path)
    stored = {}
    for name, df in star.items():
        if "match_id" in df.columns:
            stored[name] = store_bucketed(df, database, name, ["match_id"], buckets)
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")
            stored[name] = spark.table(f"`{database}`.`{name}`")
    return stored


def describe(spark: SparkSession, database: str) -> list[tuple[str, str]]:
    """Tables of a database in order of their names, each with the columns it is bucketed by."""
    found = []
    for name in tables.list_tables(spark, database):
        columns = spark.catalog.listColumns(f"`{database}`.`{name}`")
        found.append((name, ", ".join(c.name for c in columns if c.isBucket)))
    return found
