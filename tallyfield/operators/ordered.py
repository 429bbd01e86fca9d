"""Ordered work inside groups: numbering, rolling values, runs, and totals before a day.

A plain Spark window puts a whole group into one task, which is wrong once one group holds a large share of the data.
So rows are range-partitioned on key and order together and stored with the number of their range. A group, or a
single busy day, that is longer than a range simply spans several; a range is worked on alone, and the little that
crosses its border (a row count, the last few rows, the start of a run) travels as carried rows that are bounded per
range. There is one plan for every size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tallyfield.session import materialise

CHUNK = "_chunk"
#: Rows that one task sorts.
ROWS_OF_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Number of tasks that keeps ``ROWS_OF_TASK`` rows in each; None, for Spark's own choice, if each core has no more than that.

    Shuffles sized by their octets put millions of narrow, well-compressed rows into one task, which then spills.
    """
    tasks = -(-rows // ROWS_OF_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Store ``df`` range-partitioned by ``keys`` and ``order`` (a total order), with a column for the range.

    The functions below take such a table and keep that column, so that several can share the ranges; ``whole`` drops
    it. The number of ranges follows the session's shuffle settings unless it is given.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return materialise(ranged.withColumn(CHUNK, F.spark_partition_id()), "ranges")


def whole(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK)


def dealt(df: DataFrame, group: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows dealt out by group for the window, join or aggregate that follows; Spark's own choice unless a number is given."""
    return df.repartition(partitions, *group) if partitions else df


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, partitions: int | None = None) -> DataFrame:
    """1, 2, 3, … per key in the order of the ranges, in as many tasks as given."""
    group = [*keys, CHUNK]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.lit(0).alias("_is_row")
    )
    both = dealt(df.withColumn("_is_row", F.lit(1)).unionByName(starts, allowMissingColumns=True), group, partitions)
    inside = Window.partitionBy(*group).orderBy("_is_row", *order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = both.withColumn(into, F.row_number().over(inside) - 1 + F.first("_start").over(running))
    return numbered.where("_is_row = 1").withColumn(into, F.col(into).cast("long")).drop("_start", "_is_row")


def _tail(sequence: Column, count: int) -> Column:
    return F.when(F.size(sequence) <= count, sequence).otherwise(F.slice(sequence, -count, count))


def _last_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, count: int) -> DataFrame:
    """Last ``count`` rows of every group as one array in ascending order.

    Spark turns the ranked filter into a group limit that runs before the shuffle, and the array cannot be
    longer than ``count``.
    """
    newest_first = Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    ranked = df.select(*group, *order, value, F.row_number().over(newest_first).alias("_rank"))
    rows = F.collect_list(F.struct((-F.col("_rank")).alias("back"), *order, value))
    return ranked.where(F.col("_rank") <= count).groupBy(*group).agg(F.sort_array(rows).alias("_tail"))


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    frame: tuple[int, int],
    outputs: Mapping[str, Callable[[WindowSpec], Column]],
    partitions: int | None = None,
) -> DataFrame:
    """Aggregates of ``value`` over a row frame that looks back, per key in the order of the ranges.

    ``frame`` is ``(-k, 0)`` to include the current row or ``(-k, -1)`` to leave it out. It runs in as many tasks as given.
    """
    low, high = frame
    group, count = [*keys, CHUNK], -low
    tails = _last_rows(df, group, order, value, count)
    chunks_before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-count, -1)
    halo = (
        tails.withColumn("_halo", _tail(F.flatten(F.collect_list("_tail").over(chunks_before)), count))
        .select(*group, F.inline("_halo"))
        .drop("back")
        .withColumn("_is_row", F.lit(0))
    )
    both = dealt(df.withColumn("_is_row", F.lit(1)).unionByName(halo, allowMissingColumns=True), group, partitions)
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(low, high)
    rolled = both.withColumns({name: make(window) for name, make in outputs.items()})
    return rolled.where("_is_row = 1").drop("_is_row")


def mean_of(value: str) -> Callable[[WindowSpec], Column]:
    """Mean that skips NULL and is NULL over nothing; exact for whole numbers and decimals until the division."""

    def over(window: WindowSpec) -> Column:
        known = F.count(value).over(window)
        return F.sum(value).over(window).cast("double") / F.nullif(known, F.lit(0)).cast("double")

    return over


def run_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Sequence[str], into: str
) -> DataFrame:
    """Position inside the current run of equal ``run`` values, restarting whenever they change."""
    group = [*keys, CHUNK]
    inside = Window.partitionBy(*group).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = df.columns
    current = F.struct(*run)
    flagged = df.withColumns(
        {"_n": F.row_number().over(inside).cast("long"), "_new": ~F.lag(current).over(inside).eqNullSafe(current)}
    )
    started = flagged.withColumn("_from", F.max(F.when(F.col("_new"), F.col("_n"))).over(running))
    # What a range tells the ones after it: how long it is, which run it begins and ends with, where its last
    # run began.
    chunks = started.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(current, "_n").alias("_first_run"),
        F.max_by(current, "_n").alias("_last_run"),
        F.max("_from").alias("_last_from"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    fresh = ~F.lag("_last_run").over(by_chunk).eqNullSafe(F.col("_first_run"))
    located = chunks.withColumns({"_offset": offset, "_fresh": fresh})
    begun = F.when((F.col("_last_from") > 1) | F.col("_fresh"), F.col("_offset") + F.col("_last_from"))
    carried = located.withColumn("_begun", begun).select(
        *group,
        F.when(~F.col("_fresh"), F.col("_offset") - F.max("_begun").over(before) + 1).otherwise(0).alias("_extra"),
        F.lit(0).alias("_is_row"),
    )
    both = started.withColumn("_is_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    spread = (
        Window.partitionBy(*group).orderBy("_is_row", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_first_run = F.col("_from") == 1
    position = F.col("_n") - F.col("_from") + 1 + F.when(in_first_run, F.col("_carry")).otherwise(0)
    placed = both.withColumn("_carry", F.first("_extra").over(spread)).where("_is_row = 1")
    return placed.withColumn(into, position).select(*columns, into)


def _daily(df: DataFrame, keys: Sequence[str], day: str, measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys, day).agg(*[F.sum(m).cast("long").alias(name) for name, m in measures.items()])


def totals_before(df: DataFrame, keys: Sequence[str], day: str, measures: Mapping[str, Column]) -> DataFrame:
    """For every (keys, day) present: sums of the measures over all strictly earlier days of the same keys.

    Rows are first summed per key and day. The window then runs over at most one row per calendar day and key,
    so neither a busy pair nor a busy day reaches it as a long group, and whole days are left out by design.
    """
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in measures]
    return _daily(df, keys, day, measures).select(*keys, day, *sums)


def totals_as_of(
    df: DataFrame, asked: DataFrame, keys: Sequence[str], day: str, measures: Mapping[str, Column]
) -> DataFrame:
    """Same sums for the (keys, day) combinations in ``asked``, which themselves never count as history."""
    points = asked.select(*keys, day).distinct().withColumn("_kind", F.lit(0))
    daily = _daily(df, keys, day, measures).withColumn("_kind", F.lit(1))
    line = Window.partitionBy(*keys).orderBy(day, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = points.unionByName(daily, allowMissingColumns=True)
    sums = {name: F.coalesce(F.sum(name).over(line), F.lit(0)) for name in measures}
    return both.withColumns({f"_{name}": s for name, s in sums.items()}).where("_kind = 0").select(
        *keys, day, *[F.col(f"_{name}").alias(name) for name in measures]
    )


def recent_as_of(
    df: DataFrame,
    asked: DataFrame,
    keys: Sequence[str],
    day: str,
    order: Sequence[str],
    value: str,
    count: int,
    into: str,
) -> DataFrame:
    """Values of the last ``count`` rows before each asked-for (keys, day), oldest first; NULL without history.

    An array keeps "five unknown outcomes" apart from "no history at all".
    """
    tails = _last_rows(df, [*keys, day], order, value, count)
    back = Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - count, Window.currentRow)
    values = F.transform(_tail(F.flatten(F.collect_list("_tail").over(back)), count), lambda r: r[value])
    known = tails.select(*keys, day, values.alias(into), F.lit(1).alias("_kind"))
    points = asked.select(*keys, day).distinct().withColumn("_kind", F.lit(0))
    both = points.unionByName(known, allowMissingColumns=True)
    line = Window.partitionBy(*keys).orderBy(day, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    return (
        both.withColumn("_found", F.last(into, ignorenulls=True).over(line))
        .where("_kind = 0")
        .select(*keys, day, F.col("_found").alias(into))
    )


def mean_of_array(values: Column) -> Column:
    """Mean of the known values of an array; NULL when there is none."""
    known = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return total.cast("double") / F.nullif(F.size(known), F.lit(0))
