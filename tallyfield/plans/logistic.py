"""Ridge-penalised logistic regression by Newton steps, several models in one pass.

A step needs one aggregate: the weighted products of the scaled features and the gradient, a few dozen sums for each model.
They are solved on the driver. Models that share rows, such as the folds of a cross-validation and the final fit, are further groups of the
same aggregate, so fitting all of them takes the passes of the slowest one.

Defined results: rows without a label or with a missing feature are not learnt from; a constant feature is scaled by 1 and gets
coefficient 0; a model without rows has coefficients 0 and intercept 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import materialise

# Inverse weight of the penalty, most steps.
INVERSE_PENALTY, MOST_STEPS = 1.0, 1000
#: Largest change of a coefficient in a last step; relative deviation below which a feature is constant.
TOLERANCE, CONSTANT = 1e-10, 1e-12


@dataclass(frozen=True)
class Logistic:
    """Log-odds are the intercept plus coefficient times (value - mean) / deviation, summed over the features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float


def _per_model(values: Sequence[float]) -> Column:
    """The value of the row's model; ``model`` counts from 0."""
    return F.expr(f"element_at(array({', '.join(f'{float(v)!r}D' for v in values)}), model + 1)")


def _uses(rows: DataFrame, label: str, features: Sequence[str], models: Mapping[int, Column]) -> DataFrame:
    """(model, y, features) once for each model whose condition the row meets."""
    known = rows.dropna(subset=[label, *features])
    used = F.array_compact(F.array(*[F.when(condition, F.lit(place)) for place, condition in enumerate(models.values())]))
    return known.select(used.alias("used"), F.col(label).cast("double").alias("y"), *[F.col(n).cast("double").alias(n) for n in features])


def fit(rows: DataFrame, label: str, features: Sequence[str], models: Mapping[int, Column], inverse_penalty: float = INVERSE_PENALTY) -> dict[int, Logistic]:
    """A model for each key of ``models``, fitted on the rows that meet its condition."""
    count, width = len(models), len(features)
    stored = materialise(_uses(rows, label, features, models), "logistic-rows")
    uses = stored.select(F.explode("used").alias("model"), "y", *features)
    means, deviations = np.zeros((count, width)), np.ones((count, width))
    for r in uses.groupBy("model").agg(*[F.avg(n).alias(n) for n in features]).collect():
        means[r["model"]] = [r[n] for n in features]
    moved = [F.col(n) - _per_model(means[:, j]) for j, n in enumerate(features)]
    for r in uses.groupBy("model").agg(*[F.avg(m * m).alias(n) for m, n in zip(moved, features, strict=True)]).collect():
        spread = np.sqrt([r[n] for n in features])
        deviations[r["model"]] = np.where(spread > CONSTANT * np.maximum(1, np.abs(means[r["model"]])), spread, 1)
    z = [m / _per_model(deviations[:, j]) for j, m in enumerate(moved)]
    scaled = uses.select("model", "y", *[c.alias(f"z{j}") for j, c in enumerate(z)], F.lit(1.0).alias(f"z{width}"))
    weights = _newton(scaled, count, width + 1, inverse_penalty)
    return {
        key: Logistic(tuple(features), tuple(means[k].tolist()), tuple(deviations[k].tolist()), tuple(weights[k, :-1].tolist()), float(weights[k, -1]))
        for k, key in enumerate(models)
    }


def _newton(scaled: DataFrame, count: int, size: int, inverse_penalty: float) -> np.ndarray:
    """Coefficients of each model on ``scaled(model, y, z0, ...)``, the last being the unpenalised one."""
    penalty = np.diag([1.0] * (size - 1) + [0.0]) / inverse_penalty
    names = [f"z{j}" for j in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    weights, kept, least = np.zeros((count, size)), np.zeros((count, size)), np.full(count, np.inf)
    open_ = np.ones(count, bool)
    for _ in range(MOST_STEPS):
        margin = sum((F.col(n) * _per_model(weights[:, j]) for j, n in enumerate(names)), F.lit(0.0))
        lossy = scaled.select("*", margin.alias("margin")).select("*", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))
        weight, miss = F.col("p") * (1 - F.col("p")), F.col("p") - F.col("y")
        # log(1 + exp(m)) - y m, written so that no exponent is positive
        loss = F.greatest("margin", F.lit(0.0)) - F.col("y") * F.col("margin") + F.log1p(F.exp(-F.abs("margin")))
        sums = lossy.groupBy("model").agg(
            F.sum(loss).alias("loss"),
            *[F.sum(miss * F.col(n)).alias(f"g{j}") for j, n in enumerate(names)],
            *[F.sum(weight * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs],
        )
        seen = {r["model"]: r for r in sums.collect()}
        for k in range(count):
            if k not in seen or not open_[k]:
                open_[k] = False
                continue
            r, w = seen[k], weights[k]
            total = r["loss"] + w @ penalty @ w / 2
            if total > least[k] + 1e-9 * abs(least[k]):  # too far: half the way back
                weights[k] = (w + kept[k]) / 2
                continue
            hessian = penalty.copy()
            for i, j in pairs:
                hessian[i, j] = hessian[j, i] = hessian[i, j] + r[f"h{i}_{j}"]
            step = np.linalg.lstsq(hessian, np.array([r[f"g{j}"] for j in range(size)]) + penalty @ w, rcond=None)[0]
            kept[k], least[k] = w, total
            weights[k] = w - step
            open_[k] = np.abs(step).max() > TOLERANCE
        if not open_.any():
            break
    return weights


def scaled_values(model: Logistic) -> dict[str, Column]:
    parts = zip(model.features, model.means, model.deviations, strict=True)
    return {n: (F.col(n).cast("double") - F.lit(m)) / F.lit(d) for n, m, d in parts}


def contributions(model: Logistic) -> dict[str, Column]:
    """Coefficient times scaled value of each feature; with the intercept they add up to the log-odds."""
    return {n: F.lit(w) * v for (n, v), w in zip(scaled_values(model).items(), model.coefficients, strict=True)}


def margin_of(model: Logistic) -> Column:
    return sum(contributions(model).values(), F.lit(model.intercept))
