"""Conformed keys: dimensions, surrogate keys, lookups, inserts with a conflict rule, and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyfield.functions.text import strip
from tallyfield.operators.cleaning import keep_first, keep_last
from tallyfield.operators.ordered import dealt, in_ranges, number_rows, tasks_for, whole


def entity_names(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """Distinct stripped names found in any of the columns, blanks left out. Each spelling is stripped once, not each row."""
    names = df.select(F.explode(F.array(*columns)).alias(into)).distinct().withColumn(into, strip(F.col(into)))
    return names.where(F.length(into) > 0).distinct()


def number_names(names: DataFrame, name: str, into: str, start: int | Column = 0) -> DataFrame:
    """Dense, repeatable surrogate keys for distinct names.

    Names are ranked by their MD5 text in ranges of it, so no task sees them all, however long the list is, and the
    same names always get the same keys.
    """
    hashed = names.withColumn("_hash", F.md5(F.col(name)))
    ranges = in_ranges(hashed, [], ["_hash", name])
    numbered = whole(number_rows(ranges, [], ["_hash", name], into))
    first = start if isinstance(start, Column) else F.lit(start)
    return numbered.withColumn(into, F.col(into) + first).drop("_hash")


def dimension(df: DataFrame, columns: Sequence[str], name: str, key: str) -> DataFrame:
    """Key and name of every entity that the columns mention."""
    return number_names(entity_names(df, columns, name), name, key).select(key, name)


def highest_key(df: DataFrame, key: str) -> int:
    """Largest surrogate key in use; 0 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]


def new_members(existing: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Names that are not known yet, with keys that go on after those in use."""
    new = names.select(name).distinct().join(existing, name, "left_anti")
    return number_names(new, name, key, highest_key(existing, key))


def extend_dimension(existing: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Add names that are not known yet; known ones keep their key."""
    return existing.unionByName(new_members(existing, names, name, key), allowMissingColumns=True)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows win; among incoming rows with one key the first in ``order`` wins.

    A NULL inside the key never conflicts, as in a SQL UNIQUE constraint: such rows are all added.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    firsts = keep_first(incoming.where(complete), keys, order)
    fresh = firsts.join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)
    return existing.unionByName(fresh).unionByName(incoming.where(~complete))


def insert_or_replace(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key wins, incoming over existing; rows with a NULL in the key are all kept."""
    both = existing.withColumn("_wave", F.lit(0)).unionByName(incoming.withColumn("_wave", F.lit(1)))
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    lasts = keep_last(both.where(complete), keys, ["_wave", *order])
    return lasts.unionByName(both.where(~complete)).drop("_wave")


def lookup_key(
    df: DataFrame, dim: DataFrame, on: dict[str, str], key: str, into: str
) -> DataFrame:
    """Left join that brings ``dim[key]`` in as ``into``; names without a match get NULL.

    ``on`` maps columns of ``df`` to columns of ``dim``. The dimension must be unique on those. Whether it is
    broadcast is left to Spark, which knows its size.
    """
    slim = dim.select(*[F.col(d).alias(f"_on_{d}") for d in on.values()], F.col(key).alias(into))
    condition = [df[s] == slim[f"_on_{d}"] for s, d in on.items()]
    return df.join(slim, condition, "left").drop(*[f"_on_{d}" for d in on.values()])


def ambiguous_names(dim: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Names that stand for several keys, with how many."""
    counts = dim.groupBy(*columns).agg(F.count(key).alias("keys"))
    return counts.where("keys > 1")


def pair_key_bridge(
    contests: DataFrame, side1: str, side2: str, key: str, order: Sequence[str], separator: str = " Vs "
) -> DataFrame:
    """Text ``A Vs B`` and ``B Vs A`` to contest key; for a pair that met repeatedly the last contest wins."""
    low, high = F.least(side1, side2), F.greatest(side1, side2)
    rank = F.struct(*order, key)
    last = contests.groupBy(low.alias("_low"), high.alias("_high")).agg(F.max_by(key, rank).alias(key))
    both = F.array(F.concat("_low", F.lit(separator), "_high"), F.concat("_high", F.lit(separator), "_low"))
    return last.select(F.explode(F.array_distinct(both)).alias("pair_text"), key)


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key without a parent row, with the number of rows that use them."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return used.join(parent.select(key), key, "left_anti")


def broken_links(
    parent: DataFrame, key: str, uses: Mapping[str, tuple[DataFrame, str]], repeated: str | None = None
) -> DataFrame:
    """Broken rules of one key as (rule, rows): per use (a table and its column) the rows whose value no parent row has,
    and under ``repeated``, if given, the rows of the parent that share their key with others. NULLs break no rule here.

    Every table's keys are shuffled once for all rules. Parent keys are dealt out by rows before they are counted, because
    keys that seldom repeat would fill the table of a task that counts all its scan reads.
    """
    counts = {"_p": "_p", **{name: f"_c{i}" for i, name in enumerate(uses)}}
    every = parent.select(F.col(key).alias("_key"), F.lit("_p").alias("_from"))
    for name, (child, column) in uses.items():
        every = every.unionAll(child.select(F.col(column).alias("_key"), F.lit(counts[name]).alias("_from")))
    tasks = tasks_for(parent.sparkSession, parent.count())
    if tasks:
        tasks = tasks_for(parent.sparkSession, every.count())
    used = dealt(every.where("_key IS NOT NULL"), ["_key"], tasks)
    seen = used.groupBy("_key").agg(*[F.count_if(F.col("_from") == c).alias(c) for c in counts.values()])
    broken = {name: F.sum(F.when(F.col("_p") == 0, F.col(counts[name]))) for name in uses}
    if repeated:
        broken[repeated] = F.sum(F.when(F.col("_p") > 1, F.col("_p")))
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(total, F.lit(0)).alias("rows")) for rule, total in broken.items()])
    return seen.agg(rules.alias("_rules")).select(F.inline("_rules"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL part cannot violate uniqueness."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per required column with the number of NULLs in it."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    pairs = F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("nulls")) for name in columns])
    return counts.select(F.inline(pairs))


def count_rows(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass; read the count from the observation after the next action. No extra job."""
    watch = Observation(step)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
