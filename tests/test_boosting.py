"""Second-order trees and Newton steps against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.plans import boosting, logistic

NAMES = ("a", "b", "c")
CUTS = boosting.even_cuts(NAMES, 8)


@pytest.fixture(scope="module")
def table(spark):
    """Rows whose label depends on a missing value of ``a``, with nulls, NaN, values out of range and unknown labels."""
    draw = np.random.default_rng(4)
    data = []
    for i in range(900):
        a, b, c = (float(v) for v in np.round(draw.random(3) * 1.2 - 0.1, 2))
        if i % 6 == 0:
            a = None
        if i % 11 == 0:
            b = math.nan
        odds = 2.5 if a is None else 3 * a - 2 * (0.5 if math.isnan(b) else b) - 0.3
        data.append((i, a, b, c, None if i % 50 == 0 else int(draw.random() < 1 / (1 + math.exp(-odds)))))
    return spark.createDataFrame(data, "id long, a double, b double, c double, won int").cache()


def matrix(df):
    return np.array([[math.nan if r[n] is None else r[n] for n in NAMES] for r in df.orderBy("id").collect()])


def plain_fit(x, y, trees, depth=3, rate=0.1):
    """Log-odds after the trees; every cut of every feature is tried on the rows themselves."""
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731

        def grow(rows, level):
            if level == depth:
                margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)  # noqa: B023
                return
            best = (1e-6, None)
            for f, cut, missing_left in itertools.product(range(3), range(1, 9), (False, True)):
                v = x[:, f]
                edge = cut / 8 if cut < 8 else math.inf
                left = rows & np.where(np.isnan(v), missing_left, v < edge)
                right = rows & ~left
                if h[left].sum() >= 1 and h[right].sum() >= 1:  # noqa: B023
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left)
            if best[1] is None:
                grow(rows, depth)
            else:
                grow(best[1], level + 1), grow(rows & ~best[1], level + 1)

        grow(np.ones(len(y), bool), 0)
    return margin


@pytest.fixture(scope="module")
def model(table):
    return boosting.fit(table, "won", CUTS, {0: F.lit(True)}, 7)[0]


def test_trees_equal_those_grown_on_the_rows(table, model):
    known = table.filter("won IS NOT NULL")
    x, y = matrix(known), np.array([r["won"] for r in known.orderBy("id").collect()], float)
    assert boosting.margins(model, x) == pytest.approx(plain_fit(x, y, 7), abs=1e-9)
    assert model.rows.sum(axis=1) == pytest.approx([len(y)] * 7)


def test_missing_values_take_the_branch_that_was_learnt(table, model):
    scored = table.select("id", "a", boosting.margin_of(model).alias("odds"))
    missing, low = (scored.filter(c).agg(F.avg("odds")).first()[0] for c in ("a IS NULL", "a < 0.3"))
    assert missing > 0.3 > low


def test_models_side_by_side_equal_models_alone(table, model):
    parts = {3: F.col("id") < 500, 9: F.lit(True), 1: F.col("id") < 0}
    together = boosting.fit(table, "won", CUTS, parts, 7)
    alone = boosting.fit(table.filter("id < 500"), "won", CUTS, {0: F.lit(True)}, 7)[0]
    x = matrix(table)
    assert boosting.margins(together[3], x) == pytest.approx(boosting.margins(alone, x), abs=1e-12)
    assert boosting.margins(together[9], x) == pytest.approx(boosting.margins(model, x), abs=1e-12)
    assert not boosting.margins(together[1], x).any()


def test_node_table_gives_the_model_back_and_scores_by_join(spark, table, model):
    nodes = boosting.node_table(spark, model)
    back = boosting.from_nodes(nodes, NAMES)
    assert all(np.array_equal(getattr(back, n), getattr(model, n)) for n in ("feature", "value", "rows"))
    joined = boosting.scored_by_join(nodes, table, "id", NAMES, 3)
    both = joined.join(table.select("id", boosting.margin_of(model).alias("odds")), "id")
    assert both.count() == 900 and both.filter("abs(margin - odds) > 1e-12").count() == 0


def expected(paths, row, known):
    """Expected value when only the known features are looked at."""
    total = 0.0
    for p in paths:
        follows = p.follows(row[None])[0]
        total += p.value * math.prod(follows[i] if f in known else p.shares[i] for i, f in enumerate(p.features))
    return total


def all_subsets(worth, size):
    phi = []
    for i in range(size):
        others = [j for j in range(size) if j != i]
        sets = itertools.chain.from_iterable(itertools.combinations(others, k) for k in range(size))
        weigh = lambda s: math.factorial(len(s)) * math.factorial(size - len(s) - 1) / math.factorial(size)
        phi.append(sum(weigh(s) * (worth({*s, i}) - worth(set(s))) for s in sets))
    return phi


def test_contributions_against_all_subsets(table, model):
    x = matrix(table)[:8]
    paths = boosting.paths_of(model)
    for row, phi in zip(x, boosting.shapley(paths, x), strict=True):
        assert phi == pytest.approx(all_subsets(lambda known: expected(paths, row, known), 3), abs=1e-9)  # noqa: B023


def test_interventional_contributions_against_every_row_of_the_background(table, model):
    behind = table.filter("id % 3 = 0")
    rows = boosting.explain_against(model, table.filter("id < 8"), behind, ["id"]).orderBy("id").collect()
    x, other = matrix(table)[:8], matrix(behind)

    def worth(row, known):
        mixed = other.copy()
        mixed[:, list(known)] = row[list(known)]
        return boosting.margins(model, mixed).mean()

    for row, found in zip(x, rows, strict=True):
        assert [found[f"{n}_phi"] for n in NAMES] == pytest.approx(all_subsets(lambda known: worth(row, known), 3), abs=1e-9)  # noqa: B023
        assert sum(found[f"{n}_phi"] for n in NAMES) + found["base"] == pytest.approx(boosting.margins(model, row[None])[0])


def test_no_rows_give_empty_trees(table):
    none = boosting.fit(table.limit(0), "won", CUTS, {0: F.lit(True)}, 2)[0]
    assert not none.value.any() and (none.feature == -1).all()


def test_cuts_from_quantiles(table):
    cuts = boosting.quantile_cuts(table.filter("NOT isnan(b)"), NAMES, 4)
    assert all(len(c) == 3 and c == sorted(c) for c in cuts.values())
    assert cuts["c"][1] == pytest.approx(0.5, abs=0.08)


def test_newton_steps_for_several_models_far_from_the_origin(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (400, 3)) * [1, 1000, 0] + [5, 1e6, 3]
    y = (draw.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5) * 2))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, won int")
    dirty = df.unionByName(df.limit(20).withColumn("a", F.lit(None).cast("double"))).unionByName(df.limit(9).withColumn("won", F.lit(None).cast("int")))
    found = logistic.fit(dirty, "won", NAMES, {0: F.lit(True), 5: F.col("id") < 150, 7: F.lit(False)})
    for key, rows in ((0, 400), (5, 150)):
        part, label = x[:rows], y[:rows]
        deviation = part.std(axis=0)
        z = np.column_stack([(part - part.mean(axis=0)) / np.where(deviation < 1e-9, 1, deviation), np.ones(rows)])
        model = found[key]
        w = np.array([*model.coefficients, model.intercept])
        gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - label) + w * [1, 1, 1, 0]
        assert np.abs(gradient).max() < 1e-6 and model.coefficients[2] == 0
    assert found[7].coefficients == (0, 0, 0) and found[7].intercept == 0


def test_separable_labels_converge(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "a double, won int")
    model = logistic.fit(df, "won", ["a"], {0: F.lit(True)}, inverse_penalty=1e4)[0]
    assert 5 < model.coefficients[0] < 1000
    right = df.filter((logistic.margin_of(model) > 0).cast("int") == F.col("won")).count()
    assert right == 10


def test_bins_are_searched_and_not_compared_one_by_one(spark, table):
    """As many bins as cuts reached, -1 if missing, in a plan that does not grow with the cuts."""
    odd = spark.createDataFrame([(-1, math.inf, -math.inf, -0.0, 1), (-2, 0.125, 0.25, 1.0, 0)], table.schema)
    found = table.union(odd).select(*NAMES, boosting.bins_of(CUTS).alias("bins")).collect()
    for r in found:
        for name, place in zip(NAMES, r["bins"], strict=True):
            value = r[name]
            assert place == (-1 if value is None or math.isnan(value) else sum(value >= c for c in CUTS[name]))

    def plan(bins):
        cuts = boosting.even_cuts(NAMES, bins)
        return boosting.cells_of(table, cuts, "won", {0: F.lit(True)})._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(32)) < 1.1 * len(plan(4))
