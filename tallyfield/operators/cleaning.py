"""Row and column cleaning. Columns a table lacks are passed over, so one recipe fits narrower inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import numbers, text


#: Tasks that the rows of one key are dealt to before the first or last is picked.
SHARES_OF_KEY = 16


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` the table has."""
    return [name for name in columns if name in df.columns]


def drop_repeats(df: DataFrame) -> DataFrame:
    """One copy of every row. The partial aggregation collapses copies before they are shuffled."""
    return df.dropDuplicates()


def _pick(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], choose: Callable[[Column], Column], partitions: int | None
) -> DataFrame:
    rest = [name for name in df.columns if name not in keys and name not in order]
    row = F.struct(*order, *rest)
    # Rows are sorted by key before they meet. Dealt out, a task sorts a shuffle's share and not all that its scan reads;
    # copies of one key go to several tasks, so no key is too long.
    share = F.pmod(F.xxhash64(row), F.lit(SHARES_OF_KEY))
    by_key = [F.col(f"`{k}`") for k in keys]
    dealt = df.repartition(partitions, *by_key) if partitions else df.repartition(*by_key, share)
    picked = dealt.groupBy(*keys).agg(choose(row).alias("_row"))
    return picked.select(*[F.col(n) if n in keys else F.col("_row")[n].alias(n) for n in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """First row per key in the given order.

    An aggregate instead of a ranked window: the rows of a key meet in several tasks that keep one candidate each, so no
    task is given a key with a third of all rows. For keys that seldom repeat, a number of tasks saves the second
    shuffle: all rows of a key then meet in one of so many.
    """
    return _pick(df, keys, order, F.min, partitions)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Last row per key in the given order; ``partitions`` as in ``keep_first``."""
    return _pick(df, keys, order, F.max, partitions)


def map_columns(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """Apply ``change(column)`` to those of ``columns`` that exist."""
    return df.withColumns({name: change(F.col(f"`{name}`")) for name in present(df, columns)})


def strip_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, text.strip)


def scrub_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, text.scrub)


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, numbers.to_number)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing counts become 0; rates are left out of ``columns`` and stay NULL."""
    return map_columns(df, columns, lambda c: F.coalesce(c, F.lit(0.0)))


def whole_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, numbers.to_whole)


def null_tokens(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = ("", "nan")) -> DataFrame:
    return map_columns(df, columns, lambda c: text.null_if_token(c, tokens))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that miss one of the essential columns."""
    return df.dropna(subset=present(df, columns))


def rename_and_drop(df: DataFrame, renames: Mapping[str, str] | None = None, drops: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(dict(renames or {})).drop(*drops)


def add_present_flag(df: DataFrame, source: str, into: str, present_word: str, absent_word: str) -> DataFrame:
    return df.withColumn(into, text.present_flag(F.col(source), present_word, absent_word))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted list of the values in use, without NULL."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))
