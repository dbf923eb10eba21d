"""Predictors and cross-fitting.

Three predictors are fitted from sums that folds take their share out of, at any
size: the mean by category (crossfit_mean, also plain SQL), ridge regression of
several targets (crossfit_ridge), and scores of classes with a fitted temperature
(ClassScores). Any other is a function fit_predict(train, test)
-> values on pandas frames, applied by fold in applyInPandas to a bounded sample
(crossfit); given is a small multilayer perceptron with an asymmetric loss in NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .folds import assign, in_fold, training_rows
from .shared import written

EPOCHS, RATE, UNDER, HIDDEN = 20, 1e-3, 2.0, (128, 64, 128)
#: Cells that the models of crossfit() are fitted on, at most.
MOST_ROWS = 200_000


def crossfit_mean(cells: DataFrame, folds: DataFrame, category: str, y: str) -> DataFrame:
    """Centre cells with yhat: the mean y of their category over the fold's training rows.

    Sums over all rows less the fold's own: no row is repeated for each fold.
    """
    every = cells.groupBy(category).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    own = cells.join(F.broadcast(folds), "roi_idx").where(in_fold())
    held = own.groupBy("roi_idx", "fold_id", category).agg(F.sum(y).alias("fs"), F.count(y).alias("fn"))
    models = every.crossJoin(F.broadcast(folds.select("roi_idx", "fold_id"))).join(held, ["roi_idx", "fold_id", category], "left").na.fill(0, ["fs", "fn"])
    left = F.col("n") - F.col("fn")
    models = models.select("roi_idx", "fold_id", category, F.when(left > 0, (F.col("s") - F.col("fs")) / left).otherwise(0.0).alias("yhat"))
    return assign(cells, folds).join(models, ["roi_idx", "fold_id", category])


class Predictor(Protocol):
    """What the end-to-end plan asks of a predictor.

    fit(known, folds): known's centre cells with yhat of models that leave their
    fold out, and a function that gives any cells yhat by the model of all known
    ones (NULL where it knows nothing). reads_twice: whether known is to be written
    down first.
    """

    reads_twice: bool

    def fit(self, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]: ...


@dataclass(frozen=True)
class CategoryMeans:
    """The mean y of a category."""

    category: str
    y: str
    reads_twice: bool = True

    def fit(self, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        model = known.groupBy(self.category).agg((F.sum(self.y) / F.count(self.y)).alias("yhat"))
        return crossfit_mean(known, folds, self.category, self.y), lambda cells: cells.join(model, self.category, "left")


@dataclass(frozen=True)
class ClassScores:
    """Shares of classes, for targets that are sets of them: `unit` times the probability of a target's members.

    Each class has a linear score, fitted by least squares to its indicator from sums
    that folds take their share out of. Softmax turns a cell's scores into probabilities
    at the temperature of least cross-entropy on cross-fitted cells, whose own fold no
    score has seen; the model of all known cells, used elsewhere, has that temperature too.
    label: a cell's class, one of `classes`; other labels count for no class.
    """

    features: tuple[str, ...]
    classes: tuple[str, ...]
    members: dict[str, tuple[str, ...]]
    label: str = "label"
    unit: float = 1.0
    penalty: float = 1.0
    reads_twice: bool = True

    def fit(self, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        place = F.array_position(F.array(*map(F.lit, self.classes)), F.col(self.label)) - 1
        once = known.where(F.col("target") == next(iter(self.members)))  # rows are cells by target
        indicators = {f"_is_{i}": (F.coalesce(F.col(self.label), F.lit("")) == c).cast("double") for i, c in enumerate(self.classes)}
        models = linear.ridge_models(once.withColumns(indicators), folds, self.features, list(indicators), self.penalty)
        held, full = (t.withColumnRenamed("model", "_model") for t in linear.model_table(known, models, folds, []))
        scores = linear.linear_values(F.col("_model"), self.features)
        apart = assign(once, folds).join(F.broadcast(held), ["roi_idx", "fold_id"]).select(scores.alias("scores"), place.alias("place")).where("place >= 0")
        heat = temperature(written(apart, "class-scores"), "scores", "place")
        flags = F.create_map(*(x for t, m in self.members.items() for x in (F.lit(t), F.array(*(F.lit(float(c in m)) for c in self.classes)))))
        odds = F.transform("_scores", lambda z: F.exp((z - F.array_max("_scores")) / heat))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        share = F.lit(self.unit) * total(F.zip_with(odds, flags[F.col("target")], lambda a, b: a * b)) / total(odds)
        with_share = lambda df: df.withColumn("_scores", scores).withColumn("yhat", share).drop("_scores", "_model")
        fitted = with_share(assign(known, folds).join(F.broadcast(held), ["roi_idx", "fold_id"]))
        # one row, or none where nothing is known: an outer join keeps the cells
        return fitted, lambda cells: with_share(cells.join(F.broadcast(full), F.lit(True), "left"))


@dataclass(frozen=True)
class ByKind:
    """A predictor for each kind of target; kinds without one get NULL."""

    predictors: dict[str, Predictor]
    reads_twice: bool = True

    def fit(self, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        own = {k: p.fit(known.where(F.col("kind") == k), folds) for k, p in self.predictors.items()}
        fitted = [f.select("roi_idx", "target", "grid_row", "grid_col", F.col("yhat").cast("double").alias("yhat")) for f, _ in own.values()]

        def apply(cells: DataFrame) -> DataFrame:
            columns = [c for c in cells.columns if c != "yhat"]
            parts = [model(cells.where(F.col("kind") == k)).select(*columns, F.col("yhat").cast("double").alias("yhat")) for k, (_, model) in own.items()]
            rest = cells.where(~F.coalesce(F.col("kind").isin(*own), F.lit(False))).select(*columns, F.lit(None).cast("double").alias("yhat"))
            return reduce(DataFrame.unionByName, parts, rest)

        return reduce(DataFrame.unionByName, fitted), apply


def crossfit_ridge(cells: DataFrame, folds: DataFrame, features: Sequence[str], targets: Sequence[str], penalty: float = 1.0) -> tuple[DataFrame, list[list[float]]]:
    """Centre cells with yhat (array, by target) of ridge regressions that leave their fold out; and the full model's coefficients.

    A fold's normal equations are those of all cells less its own, so that cells
    are read once, whatever the number of folds. Coefficients: a list a target,
    constant first; apply with ridge_values().
    """
    models = linear.ridge_models(cells, folds, features, targets, penalty)
    if not models:
        return assign(cells, folds).withColumn("yhat", F.array().cast("array<double>")), [[0.0] * (len(features) + 1)] * len(targets)
    held, _ = linear.model_table(cells, models, folds, [])
    out = assign(cells, folds).join(F.broadcast(held), ["roi_idx", "fold_id"]).withColumn("yhat", ridge_values(F.col("model"), features)).drop("model")
    return out, models[(linear.WHOLE,)].tolist()


def ridge_values(model: Column, features: Sequence[str]) -> Column:
    """Values of each target: products of the coefficients with (1, features)."""
    return linear.linear_values(model, features)


def full_model_values(cells: DataFrame, coefficients: list[list[float]], features: Sequence[str]) -> DataFrame:
    """cells with yhat of the full model, as used outside the ROIs."""
    model = F.array(*(F.array(*map(F.lit, w)) for w in coefficients))
    return cells.withColumn("yhat", ridge_values(model, features))


def temperature(held_out: DataFrame, logits: str, label: str, lowest: float = 0.05, highest: float = 20.0, rounds: int = 4, steps: int = 24) -> float:
    """The temperature of least mean cross-entropy on held-out rows, by a search that narrows a grid.

    logits: array<double>, label: index from 0. Each round is one aggregate over all
    rows for all of its temperatures.
    """
    lo, hi = np.log(lowest), np.log(highest)
    best = 0.0
    for _ in range(rounds):
        grid = np.linspace(lo, hi, steps)
        top = F.array_max(logits)
        loss = lambda t: F.avg(F.ln(F.aggregate(logits, F.lit(0.0), lambda s, z: s + F.exp((z - top) / t))) - (F.get(logits, F.col(label).cast("int")) - top) / t)  # noqa: B023, E731
        row = held_out.agg(*(loss(float(np.exp(g))).alias(f"t{i}") for i, g in enumerate(grid))).collect()[0]
        if row[0] is None:
            return 1.0
        at = int(np.argmin(list(row)))
        best, lo, hi = grid[at], grid[max(0, at - 1)], grid[min(steps - 1, at + 1)]
    return float(np.exp(best))


def softmax(logits: str, temperature: float = 1.0) -> Column:
    e = F.transform(logits, lambda z: F.exp((z - F.array_max(logits)) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def crossfit(cells: DataFrame, folds: DataFrame, features: Sequence[str], y: str, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], most_rows: int = MOST_ROWS) -> DataFrame:
    """Centre cells with yhat of a model that was fitted by fold on its training rows.

    A fold's training rows meet in one task, as its model needs them; so models are
    fitted on a sample of about most_rows cells, chosen by a hash of the place. A
    fold's centre is bounded by the fold's width. crossfit_ridge has no such bound.
    """
    share = min(1.0, most_rows / max(1, cells.count()))
    sample = cells.where(F.pmod(F.xxhash64("roi_idx", "grid_row", "grid_col"), F.lit(1 << 30)) < share * (1 << 30))
    keys, cols = ["fold_roi", "fold_id"], [*features, y]
    # toDF: both sides come from the same tables and need column ids of their own
    train = training_rows(sample, folds).select(*keys, *cols).toDF(*keys, *cols)
    test = assign(cells, folds).select("roi_idx", "fold_id", "grid_row", "grid_col", *features).toDF(*keys, "grid_row", "grid_col", *features)
    schema = "fold_roi int, fold_id int, grid_row long, grid_col long, yhat double"

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"fold_roi": [], "fold_id": [], "grid_row": [], "grid_col": [], "yhat": []})
        yhat = fit_predict(a, b) if len(a) else np.zeros(len(b))
        return b[["fold_roi", "fold_id", "grid_row", "grid_col"]].assign(yhat=np.asarray(yhat, dtype=float))

    return train.groupBy(*keys).cogroup(test.groupBy(*keys)).applyInPandas(run, schema)


def asymmetric_loss(error: np.ndarray, under: float = UNDER) -> float:
    """Root mean square of truth minus prediction, too low predictions weighted."""
    return float(np.sqrt(np.mean(np.where(error > 0, under, 1.0) * error**2)))


def mlp_regressor(features: Sequence[str], y: str, hidden: Sequence[int] = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, under: float = UNDER, seed: int = 42, batch: int = 8096):
    """fit_predict of a perceptron with shifted-ELU output, Adam and the asymmetric loss."""
    names = list(features)

    def fit_predict(train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        rng = np.random.default_rng(seed)
        x, t = train[names].to_numpy(float), train[y].to_numpy(float)[:, None]
        mean, sd = x.mean(0), x.std(0) + 1e-9
        x = (x - mean) / sd
        top = t.max() if t.max() > 0 else 1.0
        sizes = [x.shape[1], *hidden, 1]
        w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        b = [np.zeros(n) for n in sizes[1:]]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in [*w, *b]]
        step = 0

        def forward(x):
            acts = [x]
            for k in range(len(w)):
                z = acts[-1] @ w[k] + b[k]
                acts.append(np.maximum(z, 0) if k < len(w) - 1 else np.where(z > 0, z, np.expm1(np.minimum(z, 0))) + 1)
            return acts

        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                acts, goal = forward(x[rows]), t[rows] / top
                error = goal - acts[-1]
                grad = -2 * np.where(error > 0, under, 1.0) * error / len(rows)
                grad *= np.where(acts[-1] > 1, 1.0, acts[-1])  # slope of the shifted ELU
                gw, gb = [None] * len(w), [None] * len(w)
                for k in range(len(w) - 1, -1, -1):
                    gw[k], gb[k] = acts[k].T @ grad, grad.sum(0)
                    if k:
                        grad = (grad @ w[k].T) * (acts[k] > 0)
                step += 1
                for p, g, (m, v) in zip([*w, *b], [*gw, *gb], state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return forward((test[names].to_numpy(float) - mean) / sd)[-1][:, 0] * top

    return fit_predict


def type_classifier(train: DataFrame, n_features: int, label: str = "label", features: str = "features", epochs: int = 100, seed: int = 42):
    """Spark ML perceptron of widths 128, 64, 128 with softmax output."""
    n = train.select(label).distinct().count()
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    net = MultilayerPerceptronClassifier(layers=[n_features, *HIDDEN, n + 1], featuresCol=features, labelCol="label_index", maxIter=epochs, seed=seed)
    return Pipeline(stages=[index, net]).fit(train)
