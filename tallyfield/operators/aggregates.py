"""Grouped reports: totals, conditional counts, top rows, value counts, confusion matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_and_count(df: DataFrame, keys: Sequence[str], measure: str, total: str, count: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(total), F.count(F.lit(1)).alias(count))


def count_where(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], total: str) -> DataFrame:
    """Rows per key, and rows per key that meet each condition."""
    counts = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), *counts)


def at_least(grouped: DataFrame, measure: str, minimum: int) -> DataFrame:
    return grouped.where(F.col(measure) >= minimum)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, rank: str | None = None):
    """First ``count`` rows per key. Spark limits each group before the shuffle, so long groups stay short."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= count)
    return kept if rank else kept.drop(name)


def best_per_group(df: DataFrame, keys: Sequence[str], measure: str, tiebreak: Sequence[str]) -> DataFrame:
    """The row with the highest measure per key; the lowest tiebreak decides between equals."""
    rest = [name for name in df.columns if name not in keys]
    order = F.struct((-F.col(measure)).alias("_down"), *tiebreak)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[name].alias(name) for name in rest])


def top_rows(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """First rows of the whole table: every task keeps its own ``count`` before they are merged."""
    return df.orderBy(*order).limit(count)


def value_counts(df: DataFrame, column: str, into: str = "rows") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(into))


def _exact_square_excess(name: str, n: Column) -> Column:
    """n * sum(x * x) - sum(x) ** 2 of whole numbers as double; NULL where a sum would not fit.

    Each number is split into its upper and lower 32 bits, so every sum of products has room for some 10 ** 18 rows, and
    what cancels out is taken off in whole numbers.
    """
    x = F.col(name).cast("long")
    upper = F.shiftright(x, 32)
    high, low = upper.cast("decimal(14,0)"), (x - F.shiftleft(upper, 32)).cast("decimal(14,0)")
    sums = F.sum(high.cast("decimal(28,0)")), F.sum(low.cast("decimal(28,0)"))
    parts = []
    for (one, sum1), (two, sum2), factor in (
        ((high, sums[0]), (high, sums[0]), 2**64), ((high, sums[0]), (low, sums[1]), 2**33), ((low, sums[1]), (low, sums[1]), 1),
    ):
        products = F.sum((one * two).cast("decimal(28,0)"))
        excess = F.try_subtract(F.try_multiply(n, products), F.try_multiply(sum1, sum2))
        parts.append(F.try_multiply(excess, F.lit(Decimal(factor))))
    return F.try_add(F.try_add(parts[0], parts[1]), parts[2]).cast("double")


def mean_and_spread(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], count: str | None = None
) -> DataFrame:
    """Mean and population standard deviation per key, and the number of rows if ``count`` names a column for it.

    Whole numbers are added up exactly, so the result does not depend on the order of the partial sums. Where that would
    need more than 38 digits, for billions of rows a key that use all 64 bits, the spread is merged from centred moments.
    """
    whole = {name for name, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    outputs = []
    for name in values:
        if name in whole:
            n, total = F.count(name).cast("decimal(18,0)"), F.sum(F.col(name).cast("decimal(28,0)"))
            variance = F.coalesce(_exact_square_excess(name, n) / F.nullif(n * n, F.lit(0)).cast("double"), F.var_pop(name))
            mean = total.cast("double") / F.nullif(F.count(name), F.lit(0)).cast("double")
            outputs += [mean.alias(f"{name}_mean"), F.sqrt(variance).alias(f"{name}_std")]
        else:
            outputs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    if count:
        outputs.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*keys).agg(*outputs)


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per true class, one column per predicted class."""
    counts = df.groupBy(label).pivot(prediction, list(classes)).agg(F.count(F.lit(1)))
    columns = [F.coalesce(F.col(str(c)), F.lit(0)).alias(f"predicted_{c}") for c in classes]
    return counts.select(label, *columns)


def rank_by_size(contributions: Column) -> Column:
    """Sort an array of (feature, contribution) structs by absolute contribution, largest first."""

    def larger_first(a: Column, b: Column) -> Column:
        left, right = F.abs(a["contribution"]), F.abs(b["contribution"])
        names = F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        return F.when(left > right, -1).when(left < right, 1).otherwise(names)

    return F.array_sort(contributions, larger_first)


def both_roles(df: DataFrame, side1: str, side2: str, into: str, role: str, keep: Sequence[str | Column]) -> DataFrame:
    """Every contest twice, once from the point of view of each side.

    This replaces "cross join entities, keep those in either role": the work stays linear in the contests.
    """
    views = F.array(
        F.struct(F.col(side1).alias(into), F.lit(1).alias(role)), F.struct(F.col(side2).alias(into), F.lit(2).alias(role))
    )
    return df.select(*keep, F.inline(views))
