"""Boosted trees with second-order steps and a branch for missing values.

A tree's split is chosen from sums of first and second derivatives of the log loss per node, feature and bin. Since a prediction
depends on the bins alone, rows are first collapsed to cells: one row for each combination of bins that occurs, with its
number of rows and of positive labels. That is one aggregate over the data; all rounds work on the cells, whose number the
bins bound and not the data. Each level of each tree is one aggregate over the cells: at most ``PARTS`` tasks sum up their cells, and
what reaches the driver from each is one sum for each bin of each node. Several models, such as the folds of a cross-validation, are grown side by side: the
model is one more key of the same aggregate.

Defined results: a null or NaN feature takes the branch that its node's split found better for missing values, the right one if
there is no difference. Gains that agree to nine digits are ties; the first feature, then the smallest threshold wins. A node without
a split that gains anything keeps all its rows on the left. Rows without a label are not learnt from. Without any rows to learn
from all leaves are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import materialise

# Number, depth and rate of the trees, ridge on leaf weights, least second derivative in a child, least gain.
TREE_COUNT, TREE_DEPTH, TREE_RATE = 100, 3, 0.1
RIDGE, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Bins of a feature, gains that count as equal, trees between two stored margins, cells worth a task, most tasks.
BINS, SAME_GAIN, STORED_EVERY, CELLS_OF_PART, PARTS = 32, 1e-9, 5, 16_384, 64


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees in arrays: inner nodes [tree, heap place], leaves [tree, place from the left].

    ``feature`` is -1 where a node keeps all rows on the left; ``rows`` counts the training rows of each leaf.
    """

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @property
    def depth(self) -> int:
        return self.value.shape[1].bit_length() - 1


def empty_model(features: Sequence[str], trees: int, depth: int) -> Boosted:
    inner, leaves = (trees, 2**depth - 1), (trees, 2**depth)
    return Boosted(tuple(features), np.full(inner, -1), np.zeros(inner), np.zeros(inner, bool), np.zeros(leaves), np.zeros(leaves))


# --- bins and cells -------------------------------------------------------------------------------------


def even_cuts(features: Sequence[str], bins: int = BINS, low: float = 0.0, high: float = 1.0) -> dict[str, list[float]]:
    """Bins of equal width; values outside fall into the first and the last."""
    return {name: [low + (high - low) * k / bins for k in range(1, bins)] for name in features}


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Bins of about equally many rows, from one approximate pass; equal cuts are one."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, 10_000).alias(n) for n in features]).first()
    return {n: sorted(set(row[n] or [])) for n in features}


def bins_of(cuts: Mapping[str, Sequence[float]]) -> Column:
    """For each feature the number of its cuts that the value reaches; -1 if it is missing.

    A search in the sorted cuts over Arrow batches: comparisons with every cut, written as columns, grow past what the JVM compiles.
    """
    lists, names = [np.sort(np.asarray(c, float)) for c in cuts.values()], [f"b{j}" for j in range(len(cuts))]

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def placed(*columns: pd.Series) -> pd.DataFrame:
        values = [c.to_numpy("float64", na_value=np.nan) for c in columns]
        places = [np.where(np.isnan(v), -1, np.searchsorted(c, v, "right")).astype("int32") for v, c in zip(values, lists, strict=True)]
        return pd.DataFrame(dict(zip(names, places, strict=True)))

    found = placed(*[F.col(name).cast("double") for name in cuts])
    return F.array(*[found[n] for n in names])


def cells_of(rows: DataFrame, cuts: Mapping[str, Sequence[float]], label: str, models: Mapping[int, Column]) -> DataFrame:
    """(model, bins, n, positives) of the bin combinations that occur among each model's training rows."""
    binned = rows.filter(F.col(label).isNotNull()).select(
        bins_of(cuts).alias("bins"),
        F.col(label).cast("long").alias("positive"),
        *[F.coalesce(condition, F.lit(False)).alias(f"in_{k}") for k, condition in models.items()],
    )
    sums = [
        F.struct(F.lit(k).alias("model"), F.count_if(F.col(f"in_{k}")).alias("n"), F.coalesce(F.sum(F.when(F.col(f"in_{k}"), F.col("positive"))), F.lit(0)).alias("positives"))
        for k in models
    ]
    cells = binned.groupBy("bins").agg(F.array(*sums).alias("uses"))
    return cells.select("bins", F.inline("uses")).filter("n > 0").withColumn("margin", F.lit(0.0))


# --- growing --------------------------------------------------------------------------------------------


def leaf_places(model: Boosted, tree: int, values: np.ndarray, levels: int | None = None) -> np.ndarray:
    """Place from the left that each row of ``values`` (NaN where missing) reaches after the given levels."""
    place = np.zeros(len(values), np.int64)
    for level in range(model.depth if levels is None else levels):
        node = 2**level - 1 + place
        feature = model.feature[tree][node]
        value = values[np.arange(len(values)), np.maximum(feature, 0)]
        left = np.where(np.isnan(value), model.missing_left[tree][node], value < model.threshold[tree][node])
        place = 2 * place + ~(left | (feature < 0))
    return place


def margins(model: Boosted, values: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Log-odds that the trees from ``first`` up to ``last`` add."""
    total = np.zeros(len(values))
    for tree in range(first, len(model.value) if last is None else last):
        total += model.value[tree][leaf_places(model, tree, values)]
    return total


def _with_margins(batch: pa.RecordBatch, grown: list[Boosted], first: int, last: int) -> tuple[np.ndarray, ...]:
    """model, bins (as numbers, NaN where missing), n, positives and margin after the trees up to ``last``."""
    names = ["model", "n", "positives", "margin"]
    model, n, positives, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
    bins = batch.column("bins").flatten().to_numpy().reshape(len(model), -1)
    values, margin = np.where(bins < 0, np.nan, bins), margin.copy()
    for k, trees in enumerate(grown):
        own = model == k
        margin[own] += margins(trees, values[own], first, last)
    return model, values, n, positives, margin


def _histogram(cells: DataFrame, grown: list[Boosted], first: int, tree: int, level: int, slots: int) -> np.ndarray:
    """[model, place, feature, bin, (gradient, hessian, rows)], bin 0 being the missing values."""
    nodes, width = 2**level, len(grown[0].features)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(grown) * nodes * width * slots))
        for batch in batches:
            if not batch.num_rows:
                continue
            model, values, n, positives, margin = _with_margins(batch, grown, first, tree)
            place = np.zeros(len(model), np.int64)
            for k, trees in enumerate(grown):
                own = model == k
                place[own] = leaf_places(trees, tree, values[own], level)
            chance = 1 / (1 + np.exp(-margin))
            weights = (n * chance - positives, n * chance * (1 - chance), n)
            for f in range(width):
                bin_ = np.where(np.isnan(values[:, f]), 0, values[:, f] + 1).astype(np.int64)
                slot = ((model * nodes + place) * width + f) * slots + bin_
                for row, weight in zip(sums, weights, strict=True):
                    row += np.bincount(slot, weight, minlength=len(row))
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(row[used]) for row in sums)], ["slot", "g", "h", "n"])

    parts = cells.mapInArrow(partial, "slot long, g double, h double, n double").toArrow()
    slot, size = parts.column("slot").to_numpy(), len(grown) * nodes * width * slots
    found = np.column_stack([np.bincount(slot, parts.column(c).to_numpy(), minlength=size) for c in ("g", "h", "n")])
    return found.reshape(len(grown), nodes, width, slots, 3)


def _score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_split(sums: np.ndarray) -> tuple[int, int, bool, np.ndarray, np.ndarray]:
    """(feature or -1, cut, missing left, left sums, right sums) of one node's [feature, bin, 3].

    A cut is a number of bins: those below it go left. Only cuts right above a bin with rows are looked at.
    """
    total = sums[0].sum(axis=0)
    below = np.cumsum(sums[:, 1:], axis=1)  # [feature, cut - 1, 3]
    both = np.stack([below, below + sums[:, :1]], axis=2)  # missing values right, then left
    rest = total - both
    gain = _score(both[..., 0], both[..., 1]) + _score(rest[..., 0], rest[..., 1]) - _score(total[0], total[1])
    possible = (sums[:, 1:, None, 2] > 0) & (both[..., 1] >= LEAST_WEIGHT) & (rest[..., 1] >= LEAST_WEIGHT)
    gain = np.where(possible, gain, -np.inf)
    most = gain.max(initial=-np.inf)
    if not most > LEAST_GAIN:
        return -1, 0, True, total, np.zeros(3)
    feature, cut, side = np.unravel_index(np.flatnonzero(gain.ravel() >= most * (1 - SAME_GAIN))[0], gain.shape)
    return int(feature), int(cut) + 1, bool(side), both[feature, cut, side], rest[feature, cut, side]


def fit(
    rows: DataFrame, label: str, cuts: Mapping[str, Sequence[float]], models: Mapping[int, Column],
    trees: int = TREE_COUNT, depth: int = TREE_DEPTH, rate: float = TREE_RATE,
) -> dict[int, Boosted]:
    """A model for each key of ``models``, fitted on the rows that meet its condition, all of them side by side."""
    keys = list(models)
    stored = materialise(cells_of(rows, cuts, label, dict(enumerate(models.values()))), "tree-cells")
    parts = min(PARTS, -(-stored.count() // CELLS_OF_PART) or 1)
    cells = materialise(stored.repartition(parts, "model", "bins"), "tree-cells")
    slots = max((len(c) for c in cuts.values()), default=0) + 2
    grown = [empty_model(list(cuts), trees, depth) for _ in keys]  # thresholds are numbers of bins while growing
    first = 0
    for tree in range(trees):
        for level in range(depth):
            found = _histogram(cells, grown, first, tree, level, slots)
            for k, model in enumerate(grown):
                for place in range(2**level):
                    feature, cut, missing_left, left, right = best_split(found[k, place])
                    node = 2**level - 1 + place
                    model.feature[tree, node], model.threshold[tree, node], model.missing_left[tree, node] = feature, cut, missing_left
                    if level == depth - 1:
                        for leaf, (g, h, n) in ((2 * place, left), (2 * place + 1, right)):
                            model.value[tree, leaf], model.rows[tree, leaf] = -rate * g / (h + RIDGE), round(n)
        if (tree + 1) % STORED_EVERY == 0 and tree + 1 < trees:
            cells, first = materialise(_stored_margins(cells, grown, first, tree + 1), "tree-cells"), tree + 1
    lists = [[*c, np.inf] for c in cuts.values()]  # above the last bin only missing values go right
    for model in grown:
        for at in np.ndindex(model.feature.shape):
            if model.feature[at] >= 0:
                model.threshold[at] = lists[model.feature[at]][int(model.threshold[at]) - 1]
    return dict(zip(keys, grown, strict=True))


def _stored_margins(cells: DataFrame, grown: list[Boosted], first: int, last: int) -> DataFrame:
    names = cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _with_margins(batch, grown, first, last)[4] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(margin)], names)

    return cells.mapInArrow(run, cells.schema)


# --- scoring --------------------------------------------------------------------------------------------


def margin_of(model: Boosted) -> Column:
    """Log-odds of a row with the model's features, over Arrow batches."""

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(margins(model, np.column_stack([c.to_numpy("float64", na_value=np.nan) for c in columns])))

    return scored(*[F.col(name).cast("double") for name in model.features])


def chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


# --- the model as a table -------------------------------------------------------------------------------

NODES = "tree int, node int, feature string, threshold double, missing_left boolean, value double, rows long"


def node_rows(model: Boosted) -> list[tuple]:
    """(tree, node, feature, threshold, missing_left, value, rows) of all nodes; the children of node i are 2 i and 2 i + 1."""
    found = []
    for tree in range(len(model.value)):
        inner = model.value.shape[1] - 1
        rows = np.concatenate([np.zeros(inner), model.rows[tree]])
        for node in range(inner - 1, -1, -1):
            rows[node] = rows[2 * node + 1] + rows[2 * node + 2]
        for node in range(inner):
            feature = model.feature[tree, node]
            known = feature >= 0
            split = (model.features[feature], float(model.threshold[tree, node]), bool(model.missing_left[tree, node])) if known else (None, None, None)
            found.append((tree, node + 1, *split, None, int(rows[node])))
        found += [(tree, inner + leaf + 1, None, None, None, float(v), int(rows[inner + leaf])) for leaf, v in enumerate(model.value[tree])]
    return found


def node_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """The whole model as rows; ``from_nodes`` reads it back."""
    return spark.createDataFrame(node_rows(model), NODES)


def from_nodes(nodes: DataFrame, features: Sequence[str]) -> Boosted:
    """The model a node table describes; its size is that of the trees, not of any data."""
    rows = nodes.collect()
    trees, last = max(r["tree"] for r in rows) + 1, max(r["node"] for r in rows)
    model = empty_model(features, trees, (last + 1).bit_length() - 2)
    inner = model.feature.shape[1]
    for r in rows:
        if r["node"] > inner:
            model.value[r["tree"], r["node"] - inner - 1], model.rows[r["tree"], r["node"] - inner - 1] = r["value"], r["rows"]
        elif r["feature"] is not None:
            at = r["tree"], r["node"] - 1
            model.feature[at], model.threshold[at], model.missing_left[at] = list(features).index(r["feature"]), r["threshold"], r["missing_left"]
    return model


def scored_by_join(nodes: DataFrame, df: DataFrame, key: str, features: Sequence[str], depth: int) -> DataFrame:
    """(key, margin): every row walks down every tree by a join with the node table, level by level."""
    values = F.create_map(*[x for name in features for x in (F.lit(name), F.col(name).cast("double"))])
    roots = nodes.filter("node = 1").select("tree")
    at = df.select(key, values.alias("values")).join(F.broadcast(roots)).withColumn("node", F.lit(1))
    inner = nodes.select("tree", "node", "feature", "threshold", "missing_left")
    for _ in range(depth):
        value = F.try_element_at("values", "feature")
        missing = value.isNull() | F.isnan(value)
        left = F.col("feature").isNull() | F.when(missing, F.col("missing_left")).otherwise(value < F.col("threshold"))
        at = at.join(inner, ["tree", "node"]).select(key, "values", "tree", (2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"))
    leaves = nodes.select("tree", "node", "value")
    return at.join(leaves, ["tree", "node"]).groupBy(key).agg(F.sum("value").alias("margin"))


# --- attributions ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Path:
    """A leaf seen from its root: the features tested on the way, and for each the values that go this way.

    ``shares[i]`` is the share of training rows that go on at the splits of the i-th feature.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    missing: tuple[bool, ...]
    shares: tuple[float, ...]

    def follows(self, values: np.ndarray) -> np.ndarray:
        """[row, feature on the path]: whether the row's value goes this way wherever the feature is tested."""
        found = []
        for f, low, high, missing in zip(self.features, self.low, self.high, self.missing, strict=True):
            x = values[:, f]
            found.append(np.where(np.isnan(x), missing, (x >= low) & (x < high)))
        return np.column_stack(found) if found else np.zeros((len(values), 0), bool)


def paths_of(model: Boosted) -> list[Path]:
    """All leaves that training rows can reach; a child without training rows has share 0."""
    found: list[Path] = []

    def walk(tree: int, node: int, rows: np.ndarray, tests: dict[int, tuple[float, float, bool, float]]) -> None:
        inner = model.feature.shape[1]
        if node >= inner:
            parts = list(zip(*tests.values(), strict=True)) or [(), (), (), ()]
            found.append(Path(float(model.value[tree, node - inner]), tuple(tests), *parts))
            return
        feature = int(model.feature[tree, node])
        if feature < 0:
            walk(tree, 2 * node + 1, rows, tests)
            return
        cut, to_left = float(model.threshold[tree, node]), bool(model.missing_left[tree, node])
        low, high, missing, share = tests.get(feature, (-np.inf, np.inf, True, 1.0))
        for side in (0, 1):
            child = 2 * node + 1 + side
            part = share * (rows[child] / rows[node] if rows[node] else 0.5)
            interval = (max(low, cut), high) if side else (low, min(high, cut))
            walk(tree, child, rows, {**tests, feature: (*interval, missing and to_left != bool(side), part)})

    for tree in range(len(model.value)):
        rows = np.concatenate([np.zeros(model.feature.shape[1]), model.rows[tree]])
        for node in range(model.feature.shape[1] - 1, -1, -1):
            rows[node] = rows[2 * node + 1] + rows[2 * node + 2]
        walk(tree, 0, rows, {})
    return found


def _subset_weights(size: int) -> list[float]:
    return [factorial(k) * factorial(size - k - 1) / factorial(size) for k in range(size)]


def shapley(paths: Sequence[Path], values: np.ndarray) -> np.ndarray:
    """Exact Shapley values [row, feature] where an unknown feature follows the training rows at its splits.

    For a leaf the worth of a set of known features is a product, so only the features on its path matter.
    """
    phi = np.zeros(values.shape)
    for path in paths:
        size, follows, weights = len(path.features), path.follows(values), _subset_weights(len(path.features))
        for i, feature in enumerate(path.features):
            others = [j for j in range(size) if j != i]
            worth = np.zeros(len(values))
            for known in chain.from_iterable(combinations(others, k) for k in range(size)):
                factors = [follows[:, j] if j in known else path.shares[j] for j in others]
                worth += weights[len(known)] * reduce(lambda a, b: a * b, factors, np.ones(len(values)))
            phi[:, feature] += path.value * (follows[:, i] - path.shares[i]) * worth
    return phi


def base_of(paths: Sequence[Path]) -> float:
    """Expected log-odds when no feature is known."""
    return float(sum(p.value * np.prod(p.shares) for p in paths))


def background(model: Boosted, rows: DataFrame) -> list[np.ndarray]:
    """For each path how many of ``rows`` go this way in exactly a set of its features: counts by the set's bits.

    Rows are first collapsed to the bins between the model's thresholds, then one pass over these bins sums up a few counts a
    leaf, so nothing pairs a row to be explained with a row of the background.
    """
    cuts = {
        n: sorted({float(model.threshold[at]) for at in np.ndindex(model.feature.shape) if model.feature[at] == f} - {np.inf})
        for f, n in enumerate(model.features)
    }
    cells = rows.select(bins_of(cuts).alias("bins")).groupBy("bins").agg(F.count(F.lit(1)).alias("n"))
    paths, lists = paths_of(model), list(cuts.values())
    starts = np.cumsum([0, *[2 ** len(p.features) for p in paths]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(starts[-1], np.int64)
        for batch in batches:
            places = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            values = np.empty(places.shape)
            for f, c in enumerate(lists):  # any value inside the bin stands for it
                values[:, f] = np.array([np.nan, c[0] - 1 if c else 0.0, *c])[places[:, f] + 1]
            weight = batch.column(1).to_numpy()
            for start, path in zip(starts, paths, strict=False):
                code = path.follows(values) @ (1 << np.arange(len(path.features)))
                np.add.at(sums, start + code, weight)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["slot", "n"])

    found = cells.mapInArrow(partial, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(starts[-1], np.int64)
    for r in found:
        total[r["slot"]] = r["n"]
    return [total[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _tables(paths: Sequence[Path], counts: Sequence[np.ndarray], width: int) -> tuple[list[np.ndarray], float]:
    """For each path the Shapley values [set of features the row follows, feature]; second, the base value."""
    tables, base = [], 0.0
    for path, count in zip(paths, counts, strict=True):
        size, rows = len(path.features), max(int(count.sum()), 1)
        codes = np.arange(2**size)
        share = np.array([count[(codes & s) == s].sum() / rows for s in codes])  # of rows that go this way in at least these
        base += path.value * share[-1]
        table, weights = np.zeros((2**size, width)), _subset_weights(size)
        for own in codes:
            worth = np.array([share[(2**size - 1) & ~s] if s & own == s else 0.0 for s in codes])
            for i, feature in enumerate(path.features):
                bit = 1 << i
                without = [s for s in codes if not s & bit]
                table[own, feature] += path.value * sum(weights[int(s).bit_count()] * (worth[s | bit] - worth[s]) for s in without)
        tables.append(table)
    return tables, base


def _phi(model: Boosted, df: DataFrame, keep: Sequence[str], base: float, parts: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    names = [f"{n}_phi" for n in model.features]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def found(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(parts(np.column_stack([c.to_numpy("float64", na_value=np.nan) for c in columns])), columns=names)

    phi = found(*[F.col(n).cast("double") for n in model.features])
    return df.withColumn("_phi", phi).select(*keep, "_phi.*", F.lit(base).alias("base"))


def explain(model: Boosted, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Contribution of every feature to each row's log-odds, plus the base value, by the training rows at the splits."""
    paths = paths_of(model)
    return _phi(model, df, keep, base_of(paths), lambda values: shapley(paths, values))


def explain_against(model: Boosted, df: DataFrame, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Interventional Shapley values: unknown features take the values of all of ``rows`` together, one row after the other."""
    paths = paths_of(model)
    tables, base = _tables(paths, background(model, rows), len(model.features))

    def parts(values: np.ndarray) -> np.ndarray:
        phi = np.zeros(values.shape)
        for path, table in zip(paths, tables, strict=True):
            phi += table[path.follows(values) @ (1 << np.arange(len(path.features)))]
        return phi

    return _phi(model, df, keep, base, parts)
