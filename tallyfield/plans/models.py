"""Win-probability models: chronological folds, two classifiers, selection, scoring, explanation.

``train`` fits both kinds of model, on all rows and on each fold's training part, side by side: ``plans.logistic`` by
Newton steps, ``plans.boosting`` by second-order trees. Their models are small tables. The same two kinds from Spark ML are
there too (``fit_linear``, ``fit_trees``). The per-row explanation of a tree model is a small vectorised function applied to
Arrow batches: it needs the row and the trees, hence no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import aggregates, ordered
from tallyfield.plans import boosting, logistic
from tallyfield.plans.features import FEATURES, LABEL
from tallyfield.session import enable_checkpoints, fresh_path, materialise

LINEAR, TREES = "logistic", "trees"

# Settings of the two classifiers and of the cross-validation.
FOLDS = 5
INVERSE_PENALTY = 1.0
LINEAR_ITERATIONS = 1000
TREE_COUNT = 100
TREE_DEPTH = 3
TREE_STEP = 0.1
SEED = 42

VECTOR = "features"


# --- folds -----------------------------------------------------------------------------------------------


def in_time_order(df: DataFrame, day: str, tiebreak: str, into: str = "seq", partitions: int | None = None):
    """Number all rows by date and tie-break; the numbering runs in ranges of both, so no day is too long."""
    partitions = partitions or ordered.tasks_for(df.sparkSession, df.count())
    ranges = ordered.in_ranges(df, [], [day, tiebreak], partitions)
    return ordered.whole(ordered.number_rows(ranges, [], [day, tiebreak], into, partitions))


@dataclass(frozen=True)
class Fold:
    """Rows 1..train_rows train, the next ``valid_rows`` validate."""

    number: int
    train_rows: int
    valid_rows: int

    def train(self, df: DataFrame, seq: str = "seq") -> DataFrame:
        return df.where(F.col(seq) <= self.train_rows)

    def valid(self, df: DataFrame, seq: str = "seq") -> DataFrame:
        return df.where((F.col(seq) > self.train_rows) & (F.col(seq) <= self.train_rows + self.valid_rows))


def time_folds(rows: int, folds: int = FOLDS) -> list[Fold]:
    """Expanding training part, equal validation parts, the remainder in the first training part."""
    size = rows // (folds + 1)
    return [Fold(k + 1, rows - (folds - k) * size, size) for k in range(folds)]


def fold_rows(df: DataFrame, folds: Sequence[Fold], keep: Sequence[str], seq: str = "seq") -> DataFrame:
    """(fold, part, row) for every use of a row; a row is repeated at most once per fold."""
    uses = F.array(
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                F.when(F.col(seq) <= f.train_rows, "train")
                .when(F.col(seq) <= f.train_rows + f.valid_rows, "valid")
                .alias("part"),
            )
            for f in folds
        ]
    )
    return df.select(*keep, seq, F.inline(uses)).where("part IS NOT NULL")


# --- scaling ---------------------------------------------------------------------------------------------


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column in one pass; a constant column gets deviation 1."""
    return _scaling_and_rows(df, columns)[0]


def _scaling_and_rows(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, tuple[float, float]], int]:
    row = aggregates.mean_and_spread(df, [], columns, count="rows").first()
    stats = {name: (row[f"{name}_mean"], row[f"{name}_std"] or 1.0) for name in columns}
    return stats, row["rows"]


def scaled(value: Column, mean: Column | float, deviation: Column | float) -> Column:
    return (value - mean) / deviation


def fold_scaling(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of each fold's training part: one row per fold."""
    stats = aggregates.mean_and_spread(rows.where("part = 'train'"), ["fold"], columns)
    safe = {f"{name}_std": F.when(F.col(f"{name}_std") == 0, 1.0).otherwise(F.col(f"{name}_std")) for name in columns}
    return stats.withColumns(safe)


def standardise_folds(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale both parts of each fold with what its training part showed. One statistics row per fold is broadcast."""
    stats = F.broadcast(fold_scaling(rows, columns))
    joined = rows.join(stats, "fold")
    values = {f"{n}_scaled": scaled(F.col(n), F.col(f"{n}_mean"), F.col(f"{n}_std")) for n in columns}
    return joined.withColumns(values).drop(*[f"{n}_{kind}" for n in columns for kind in ("mean", "std")])


def _scaling_stage(stats: dict[str, tuple[float, float]]) -> SQLTransformer:
    columns = ", ".join(f"(`{n}` - {m!r}D) / {d!r}D AS `{n}_scaled`" for n, (m, d) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


# --- classifiers -----------------------------------------------------------------------------------------


def _spread(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Needed columns only, in at least as many partitions as there are cores.

    Fitting passes over the rows a hundred times and more, so a stored table in a few files is spread once.
    """
    slim = train.select(*columns)
    cores = train.sparkSession.sparkContext.defaultParallelism
    return slim if slim.rdd.getNumPartitions() >= cores else slim.repartition(cores)


def fit_linear(train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL) -> PipelineModel:
    """Scaling, assembly and a ridge-penalised logistic regression.

    Spark averages the loss over the rows while the usual ``C`` weighs its sum, hence ``1 / (C * rows)``. The
    features are already scaled, so Spark's own sample-deviation scaling is off.
    """
    train = _spread(train, [*features, label])
    stats, rows = _scaling_and_rows(train, features)
    scaler = _scaling_stage(stats)
    assembler = VectorAssembler(inputCols=[f"{n}_scaled" for n in features], outputCol=VECTOR)
    classifier = LogisticRegression(
        featuresCol=VECTOR, labelCol=label, regParam=1.0 / (INVERSE_PENALTY * max(rows, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=LINEAR_ITERATIONS,
    )
    fitted = classifier.fit(assembler.transform(scaler.transform(train)))
    # The training summary holds the session, which no task can take along.
    fitted._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return PipelineModel([scaler, assembler, fitted])


def fit_trees(
    train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, trees: int = TREE_COUNT
) -> PipelineModel:
    enable_checkpoints(train.sparkSession)
    train = _spread(train, [*features, label])
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR)
    classifier = GBTClassifier(
        featuresCol=VECTOR, labelCol=label, maxIter=trees, maxDepth=TREE_DEPTH, stepSize=TREE_STEP, seed=SEED
    )
    return PipelineModel([assembler, classifier.fit(assembler.transform(train))])


def accuracy(predicted: DataFrame, keys: Sequence[str], label: str = LABEL, prediction: str = "prediction"):
    """Share of rows whose prediction equals the label, per key."""
    hit = F.count_if(F.col(prediction) == F.col(label))
    return predicted.groupBy(*keys).agg(
        hit.alias("hits"), F.count(F.lit(1)).alias("rows"), (hit.cast("double") / F.count(F.lit(1))).alias("accuracy")
    )


def cross_validate(frame: DataFrame, fitters: dict, folds: Sequence[Fold], label: str = LABEL) -> DataFrame:
    """Accuracy of every model on every fold: (model, fold, rows, accuracy).

    ``frame`` is numbered and stored; each fold reads its range of row numbers. One fit after the other: each
    passes over its whole training part with all cores.
    """
    results = []
    for name, fit in fitters.items():
        for fold in folds:
            scored = fit(fold.train(frame)).transform(fold.valid(frame))
            row = accuracy(scored, [], label).first()
            results.append((name, fold.number, int(row["rows"]), float(row["accuracy"])))
    return frame.sparkSession.createDataFrame(results, "model string, fold int, rows long, accuracy double")


#: Key of the model that is fitted on all rows.
ALL_ROWS = 0


def training_parts(folds: Sequence[Fold], seq: str = "seq") -> dict[int, Column]:
    """Which rows of a numbered frame each fold's models learn from; all rows under ``ALL_ROWS``."""
    return {ALL_ROWS: F.lit(True)} | {f.number: F.col(seq) <= f.train_rows for f in folds}


def fit_linear_parts(numbered: DataFrame, folds: Sequence[Fold], features: Sequence[str] = FEATURES, label: str = LABEL) -> dict[int, logistic.Logistic]:
    return logistic.fit(numbered, label, features, training_parts(folds), INVERSE_PENALTY)


def fit_tree_parts(
    numbered: DataFrame, folds: Sequence[Fold], features: Sequence[str] = FEATURES, label: str = LABEL, trees: int = TREE_COUNT
) -> dict[int, boosting.Boosted]:
    return boosting.fit(numbered, label, boosting.even_cuts(features), training_parts(folds), trees, TREE_DEPTH, TREE_STEP)


def margin_of(model: logistic.Logistic | boosting.Boosted) -> Column:
    """Log-odds that side 1 wins."""
    return (logistic if isinstance(model, logistic.Logistic) else boosting).margin_of(model)


def fold_scores(numbered: DataFrame, fitted: dict[str, dict], folds: Sequence[Fold], label: str = LABEL) -> DataFrame:
    """(model, fold, hits, rows, accuracy) of every model on the rows its fold validates, in one pass."""
    parts = []
    for fold in folds:
        guesses = [F.struct(F.lit(kind).alias("model"), (margin_of(by_fold[fold.number]) > 0).cast("int").alias("prediction")) for kind, by_fold in fitted.items()]
        scored = fold.valid(numbered).select(label, F.array(*guesses).alias("guesses"))
        parts.append(scored.select(F.lit(fold.number).alias("fold"), label, F.inline("guesses")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionAll(more)
    return accuracy(every, ["model", "fold"], label)


def summarise(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold accuracies per model."""
    return scores.groupBy("model").agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"), F.count(F.lit(1)).alias("folds")
    )


def select_model(summary: DataFrame, baseline: str = LINEAR) -> DataFrame:
    """Best mean accuracy; the baseline wins ties."""
    rank = F.struct("cv_mean", (F.col("model") == baseline).alias("is_baseline"))
    return summary.agg(F.max_by(F.struct("model", "cv_mean", "cv_std", "folds"), rank).alias("best")).select("best.*")


@dataclass(frozen=True)
class Trained:
    name: str
    model: logistic.Logistic | boosting.Boosted | PipelineModel
    metrics: DataFrame


def train(contest_frame: DataFrame, day: str = "contest_date", tiebreak: str = "contest_id", trees: int = TREE_COUNT) -> Trained:
    """Cross-validate both models, choose, and keep the choice as fitted on all rows."""
    numbered = materialise(in_time_order(contest_frame, day, tiebreak), "training")
    folds = time_folds(numbered.count())
    fitted = {LINEAR: fit_linear_parts(numbered, folds), TREES: fit_tree_parts(numbered, folds, trees=trees)}
    summary = materialise(summarise(fold_scores(numbered, fitted, folds)), "cv-summary")
    chosen = select_model(summary).first()["model"]
    return Trained(chosen, fitted[chosen][ALL_ROWS], summary.withColumn("selected", F.col("model") == chosen))


COEFFICIENTS = "feature string, mean double, deviation double, coefficient double"


def coefficient_table(spark: SparkSession, model: logistic.Logistic) -> DataFrame:
    """One row per feature, and one without a feature for the intercept."""
    rows = list(zip(model.features, model.means, model.deviations, model.coefficients, strict=True))
    return spark.createDataFrame([*rows, (None, None, None, model.intercept)], COEFFICIENTS)


def from_coefficients(table: DataFrame, features: Sequence[str] = FEATURES) -> logistic.Logistic:
    rows = {r["feature"]: r for r in table.collect()}
    columns = [tuple(rows[n][c] for n in features) for c in ("mean", "deviation", "coefficient")]
    return logistic.Logistic(tuple(features), *columns, rows[None]["coefficient"])


def save(trained: Trained, path: str) -> None:
    """The metrics and the model: tables of nodes or coefficients, or Spark's own folder for its pipelines."""
    spark = trained.metrics.sparkSession
    if isinstance(trained.model, PipelineModel):
        trained.model.write().overwrite().save(f"{path}/model")
    else:
        linear = isinstance(trained.model, logistic.Logistic)
        rows = coefficient_table(spark, trained.model) if linear else boosting.node_table(spark, trained.model)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{'coefficients' if linear else 'nodes'}")
    kind = "pipeline" if isinstance(trained.model, PipelineModel) else "tables"
    trained.metrics.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(f"{path}/metrics")


def load(spark: SparkSession, path: str) -> Trained:
    metrics = spark.read.parquet(f"{path}/metrics")
    chosen = metrics.where("selected").first()
    if chosen["kind"] == "pipeline":
        model = PipelineModel.load(f"{path}/model")
    elif chosen["model"] == LINEAR:
        model = from_coefficients(spark.read.parquet(f"{path}/coefficients"))
    else:
        model = boosting.from_nodes(spark.read.parquet(f"{path}/nodes"), FEATURES)
    return Trained(chosen["model"], model, metrics.drop("kind"))


# --- scoring and explanation -----------------------------------------------------------------------------


def score(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Win probability of both sides. Boosted trees take missing features as they are."""
    if not isinstance(model, PipelineModel):
        scored = df.withColumn("_first", boosting.chance(margin_of(model)))
        return scored.select(*keep, F.col("_first").alias("side1_win"), (1 - F.col("_first")).alias("side2_win"))
    first = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, first.alias("side1_win"), (1 - first).alias("side2_win"))


def linear_contributions(
    df: DataFrame, weights: dict[str, float], base: float, keep: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Weight times value per feature, with the intercept as base."""
    parts = [(F.lit(w) * F.col(f"{name}{suffix}")).alias(f"{name}_phi") for name, w in weights.items()]
    return df.select(*keep, *parts, F.lit(base).alias("base"))


def coefficients(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Coefficients of the linear model, highest first."""
    fitted = model.stages[-1]
    rows = [(name, float(w)) for name, w in zip(features, fitted.coefficients, strict=True)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"), "feature")


def explain_linear(model: PipelineModel, df: DataFrame, keep: Sequence[str], features: Sequence[str] = FEATURES):
    fitted = model.stages[-1]
    weights = {name: float(w) for name, w in zip(features, fitted.coefficients, strict=True)}
    return linear_contributions(model.stages[0].transform(df), weights, float(fitted.intercept), keep, "_scaled")


@dataclass(frozen=True)
class Leaf:
    """A leaf as seen from the root: its value and, per feature on its path, the interval and the share of
    training rows that go its way at that feature's splits."""

    value: float
    tests: tuple[tuple[int, float, float, float], ...]


def _leaves(nodes: dict[int, Row], at: int, weight: float, tests: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
    node = nodes[at]
    if node["leftChild"] < 0:
        yield Leaf(node["prediction"] * weight, tuple((f, *test) for f, test in tests.items()))
        return
    feature, threshold = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    low, high, share = tests.get(feature, (-np.inf, np.inf, 1.0))
    left, right = (nodes[node[side]]["rawCount"] / node["rawCount"] for side in ("leftChild", "rightChild"))
    yield from _leaves(nodes, node["leftChild"], weight, {**tests, feature: (low, min(high, threshold), share * left)})
    yield from _leaves(nodes, node["rightChild"], weight, {**tests, feature: (max(low, threshold), high, share * right)})


def leaves_of(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of Spark's trees, on the log-odds scale: its probability is ``1 / (1 + exp(-2 * margin))``.

    They are read from the table of nodes that Spark writes when it saves a model; it is as large as the trees.
    """
    spark = SparkSession.getActiveSession()
    path = fresh_path(spark, "saved-trees")
    model.write().save(path)
    by_tree: dict[int, dict[int, Row]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    return [leaf for k, weight in enumerate(model.treeWeights) for leaf in _leaves(by_tree[k], 0, 2.0 * weight, {})]


def tree_base(leaves: Sequence[Leaf]) -> float:
    """Expected log-odds when no feature is known: leaf values weighted by the training rows that reach them."""
    return float(sum(leaf.value * np.prod([share for *_, share in leaf.tests]) for leaf in leaves))


def shapley(leaves: Sequence[Leaf], rows: np.ndarray) -> np.ndarray:
    """Exact Shapley values where an unknown feature follows the training rows at its splits.

    For one leaf the worth of a set of known features is a product, so only the features on its path matter.
    """
    phi = np.zeros(rows.shape)
    for leaf in leaves:
        size = len(leaf.tests)
        follows = [(rows[:, f] > low) & (rows[:, f] <= high) for f, low, high, _ in leaf.tests]
        shares = [share for *_, share in leaf.tests]
        for i, (feature, *_) in enumerate(leaf.tests):
            others = [j for j in range(size) if j != i]
            worth = np.zeros(len(rows))
            for count in range(size):
                weight = factorial(count) * factorial(size - count - 1) / factorial(size)
                for known in combinations(others, count):
                    term = np.full(len(rows), weight)
                    for j in others:
                        term *= follows[j] if j in known else shares[j]
                    worth += term
            phi[:, feature] += leaf.value * (follows[i] - shares[i]) * worth
    return phi


def explain_trees(model: PipelineModel, df: DataFrame, keep: Sequence[str], features: Sequence[str] = FEATURES):
    """Contribution of every feature to the log-odds of each row, plus the base value; they add up to the log-odds."""
    leaves = leaves_of(model.stages[-1])
    base = tree_base(leaves)
    names = list(features)

    @F.pandas_udf(", ".join(f"{name}_phi double" for name in names))
    def contributions(*columns: pd.Series) -> pd.DataFrame:
        values = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        return pd.DataFrame(shapley(leaves, values), columns=[f"{name}_phi" for name in names])

    phi = contributions(*[F.col(name).cast("double") for name in names])
    return df.withColumn("_phi", phi).select(*keep, "_phi.*", F.lit(base).alias("base"))


def explain(trained: Trained, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    if isinstance(trained.model, boosting.Boosted):
        return boosting.explain(trained.model, df, keep)
    if isinstance(trained.model, logistic.Logistic):
        parts = [part.alias(f"{n}_phi") for n, part in logistic.contributions(trained.model).items()]
        return df.select(*keep, *parts, F.lit(trained.model.intercept).alias("base"))
    return (explain_linear if trained.name == LINEAR else explain_trees)(trained.model, df, keep)


def contribution_array(features: Sequence[str] = FEATURES) -> Column:
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}_phi").alias("contribution")) for n in features]
    return F.array(*pairs)


def global_importance(explained: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean absolute contribution per feature: one row is aggregated, then turned on its side."""
    means = explained.agg(*[F.avg(F.abs(f"{n}_phi")).alias(f"{n}_phi") for n in features])
    return means.select(F.inline(aggregates.rank_by_size(contribution_array(features)))).withColumnRenamed(
        "contribution", "mean_abs"
    )


def top_drivers(explained: DataFrame, keep: Sequence[str], count: int = 2, features: Sequence[str] = FEATURES):
    """The features that move a prediction most, and how far, largest first."""
    ranked = F.slice(aggregates.rank_by_size(contribution_array(features)), 1, count)
    return explained.select(*keep, F.posexplode(ranked).alias("_rank", "_driver")).select(
        *keep, (F.col("_rank") + 1).alias("rank"), "_driver.*"
    )
