import itertools
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyfield.plans import boosting, logistic, models
from tallyfield.plans.features import FEATURES


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(2)
    x = np.round(draw.random((600, 5)), 2)
    x[:, 4] = 1.0
    label = (x[:, 0] - x[:, 1] + 0.5 * x[:, 2] * x[:, 3] + draw.normal(0, 0.3, 600) > 0.1).astype(int)
    data = [(i, 700 + i // 7, *map(float, r), int(y)) for i, (r, y) in enumerate(zip(x, label, strict=True))]
    names = ", ".join(f"{n} double" for n in FEATURES)
    df = spark.createDataFrame(data, f"contest_id long, d int, {names}, side1_won int")
    return df.withColumn("contest_date", F.date_from_unix_date("d")).cache()


@pytest.fixture(scope="module")
def trees(frame):
    return models.fit_trees(frame, trees=12)


def test_fold_sizes():
    folds = models.time_folds(23)
    assert [f.train_rows for f in folds] == [8, 11, 14, 17, 20]
    assert [f.valid_rows for f in folds] == [3] * 5


def test_folds_are_expanding_and_disjoint(frame):
    numbered = models.in_time_order(frame, "contest_date", "contest_id", partitions=12)
    assert rows(numbered, "seq") == [(i,) for i in range(1, 601)]
    uses = models.fold_rows(numbered, models.time_folds(600), ["contest_id"])
    for fold in models.time_folds(600):
        part = {p: [s for (s,) in rows(uses.where(f"fold = {fold.number} AND part = '{p}'"), "seq")] for p in ("train", "valid")}
        assert part["train"] == list(range(1, fold.train_rows + 1))
        assert part["valid"] == list(range(fold.train_rows + 1, fold.train_rows + 101))


def test_scaling_uses_the_population_deviation_and_survives_constants(frame):
    stats = models.scaling(frame, FEATURES)
    first = np.array([v for (v,) in frame.select(FEATURES[0]).collect()])
    assert stats[FEATURES[0]] == pytest.approx((first.mean(), first.std()))
    assert stats["neutral_venue"] == (1.0, 1.0)


def newton(x, y, penalty=1.0):
    """Ridge logistic regression with a free intercept, solved directly."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [0.0]) / penalty
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_logistic_regression_matches_a_direct_solution(frame):
    model = models.fit_linear(frame)
    data = np.array(frame.select(*FEATURES, "side1_won").collect(), dtype=float)
    x, y = data[:, :5], data[:, 5]
    deviation = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(deviation < 1e-12, 1, deviation)
    solved = newton(z, y)
    fitted = model.stages[-1]
    assert list(fitted.coefficients) == pytest.approx(list(solved[:5]), abs=1e-4)
    assert fitted.intercept == pytest.approx(solved[5], abs=1e-4)
    ranked = [r["coefficient"] for r in models.coefficients(model).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_linear_contributions_add_up(frame):
    model = models.fit_linear(frame)
    phi = sum((F.col(f"{n}_phi") for n in FEATURES), F.col("base"))
    explained = models.explain_linear(model, frame, ["contest_id"]).select("contest_id", phi.alias("sum"))
    odds = model.transform(frame).select("contest_id", vector_to_array("rawPrediction")[1].alias("odds"))
    assert explained.join(odds, "contest_id").where("abs(sum - odds) > 1e-9").count() == 0


def test_trees_are_repeatable_and_useful(frame, trees):
    again = models.fit_trees(frame, trees=12)
    a, b = (rows(models.score(m, frame, ["contest_id"])) for m in (trees, again))
    assert a == b
    assert all(0 <= p <= 1 and p + q == pytest.approx(1) for _, p, q in a)
    row = models.accuracy(trees.transform(frame), []).first()
    assert row["rows"] == 600 and row["accuracy"] > 0.75


def test_tree_contributions_add_up_to_the_log_odds(frame, trees):
    phi = sum((F.col(f"{n}_phi") for n in FEATURES), F.col("base"))
    explained = models.explain_trees(trees, frame, ["contest_id"]).select("contest_id", phi.alias("sum"))
    odds = trees.transform(frame).select("contest_id", (2 * vector_to_array("rawPrediction")[1]).alias("odds"))
    both = explained.join(odds, "contest_id")
    assert both.count() == 600 and both.where("abs(sum - odds) > 1e-9").count() == 0


def expectation(node, row, known):
    """Value of one tree when only the known features are looked at, walked node by node."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    feature = node.split().featureIndex()
    left, right = node.leftChild(), node.rightChild()
    if feature in known:
        return expectation(left if row[feature] <= node.split().threshold() else right, row, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * expectation(left, row, known) + m * expectation(right, row, known)) / (n + m)


def test_tree_contributions_against_all_subsets(frame, trees):
    data = np.array(frame.select(*FEATURES).limit(4).collect(), dtype=float)
    model = trees.stages[-1]
    fast = models.shapley(models.leaves_of(model), data)
    roots = [(t._java_obj.rootNode(), 2.0 * w) for t, w in zip(model.trees, model.treeWeights, strict=True)]

    def worth(row, known):
        return sum(w * expectation(root, row, known) for root, w in roots)

    for at, row in enumerate(data):
        for i in range(5):
            others = [j for j in range(5) if j != i]
            total = 0.0
            for size in range(5):
                weight = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                for known in itertools.combinations(others, size):
                    total += weight * (worth(row, {*known, i}) - worth(row, set(known)))
            assert fast[at, i] == pytest.approx(total, abs=1e-9)


def test_selection_prefers_trees_only_if_strictly_better(spark):
    def chosen(a, b):
        scores = spark.createDataFrame([("logistic", 1, 10, a), ("trees", 1, 10, b)], "model string, fold int, rows long, accuracy double")
        return models.select_model(models.summarise(scores)).first()["model"]

    assert (chosen(0.5, 0.5), chosen(0.5, 0.6), chosen(0.6, 0.5)) == ("logistic", "trees", "logistic")


def test_cross_validation_and_persistence(spark, frame, tmp_path):
    numbered = models.in_time_order(frame, "contest_date", "contest_id")
    small = {models.LINEAR: models.fit_linear, models.TREES: lambda t: models.fit_trees(t, trees=3)}
    scores = models.cross_validate(numbered, small, models.time_folds(600)[:2])
    assert rows(scores, "model", "fold", "rows") == [("logistic", 1, 100), ("logistic", 2, 100), ("trees", 1, 100), ("trees", 2, 100)]
    summary = models.summarise(scores)
    name = models.select_model(summary).first()["model"]
    trained = models.Trained(name, models.fit_linear(frame), summary.withColumn("selected", F.col("model") == name))
    models.save(trained, str(tmp_path / "bundle"))
    back = models.load(spark, str(tmp_path / "bundle"))
    assert back.name == name
    assert rows(models.score(back.model, frame, ["contest_id"])) == rows(models.score(trained.model, frame, ["contest_id"]))


def test_training_in_one_call_and_models_as_tables(spark, frame, tmp_path):
    trained = models.train(frame, trees=4)
    assert {r["model"]: r["folds"] for r in trained.metrics.collect()} == {"logistic": 5, "trees": 5}
    linear = models.Trained(models.LINEAR, logistic.fit(frame, "side1_won", FEATURES, {0: F.lit(True)})[0], trained.metrics.withColumn("selected", F.col("model") == "logistic"))
    boosted = models.Trained(models.TREES, boosting.fit(frame, "side1_won", boosting.even_cuts(FEATURES), {0: F.lit(True)}, 4)[0], trained.metrics.withColumn("selected", F.col("model") == "trees"))
    for k, bundle in enumerate((trained, linear, boosted)):
        models.save(bundle, str(tmp_path / f"bundle{k}"))
        back = models.load(spark, str(tmp_path / f"bundle{k}"))
        assert back.name == bundle.name and back.metrics.columns == bundle.metrics.columns
        assert rows(models.score(back.model, frame, ["contest_id"])) == rows(models.score(bundle.model, frame, ["contest_id"]))
        phi = sum((F.col(f"{n}_phi") for n in FEATURES), F.col("base"))
        odds = frame.select("contest_id", models.margin_of(back.model).alias("odds"))
        both = models.explain(back, frame, ["contest_id"]).select("contest_id", phi.alias("sum")).join(odds, "contest_id")
        assert both.count() == 600 and both.where("abs(sum - odds) > 1e-9").count() == 0


def test_drivers_and_importance(spark):
    data = [(1, 0.1, -0.4, 0.2, 0.0, 0.4, 0.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    names = ", ".join(f"{n}_phi double" for n in FEATURES)
    df = spark.createDataFrame(data, f"id int, {names}, base double")
    top = rows(models.top_drivers(df, ["id"]), "id", "rank", "feature")
    assert top == [(1, 1, "neutral_venue"), (1, 2, "side2_form"), (2, 1, "head_to_head"), (2, 2, "neutral_venue")]
    weights = dict(rows(models.global_importance(df)))
    assert weights["side2_form"] == pytest.approx(0.2) and weights["venue_record"] == 0.0
