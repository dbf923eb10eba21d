"""Linear predictors from sums of products, cross-fitted by fold.

Tasks multiply blocks of rows (Arrow batches) by themselves and hand on one sum a
group and fold; the sums are added as vectors, and the driver solves systems of as
many unknowns as features. Ridge regression takes a fold's sums off the whole's, so
rows are read once whatever the number of folds. Expectile regression (squared loss,
too low predictions weighted `under` times) repeats that with the weights that the
last model gives each row, until they stay: a pass a round. No row is repeated or
sent for a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import assign

ROUNDS, SETTLED = 50, 1e-9
WHOLE = -1  # the place of the model of all rows
_AT = ["roi_idx", "grid_row", "grid_col"]


def _places(folds: DataFrame) -> list[tuple]:
    """(roi_idx, fold_id, top, bottom, left, right) of each fold; folds are few, as their table is broadcast anyway."""
    return [tuple(r) for r in folds.select("roi_idx", "fold_id", "f_top", "f_bottom", "f_left", "f_right").orderBy("roi_idx", "fold_id").collect()]


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def gram_sums(rows: DataFrame, by: Sequence[str], features: Sequence[str], targets: Sequence[str], places: Sequence[tuple], models: dict | None = None, under: float = 1.0) -> dict[tuple, np.ndarray]:
    """Sums of products of (1, features) with each other and with the targets, by (group, place).

    WHOLE: of all rows; place 0 ..: what has to be added for the rows outside that
    fold. With models, {(group, place): coefficients} of one target, rows above
    their model's value are weighted `under`; a fold's sums then differ from the
    whole's by its own rows and those few that the two models weigh differently.
    Rows with a NULL among features or targets are left out. by: strings.
    """
    n, up = len(features) + 1, _upper(len(features) + 1)
    width = len(up[0]) + n * len(targets)

    def within(r, row, col) -> list[np.ndarray]:
        return [(r == roi) & (row >= top) & (row < bottom) & (col >= left) & (col < right) for roi, _, top, bottom, left, right in places]

    def summed(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        wx = x * weight[:, None]
        return np.concatenate([(wx.T @ x)[up], (wx.T @ y).T.ravel()])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}

        def add(key: tuple, value: np.ndarray) -> None:
            found[key] = found[key] + value if key in found else value

        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            groups = {g: i for i, g in enumerate(dict.fromkeys(names))}
            of = np.array([groups[g] for g in names])
            at = [batch.column(len(by) + k).to_numpy() for k in range(3)]
            numbers = np.column_stack([batch.column(len(by) + 3 + k).to_numpy(zero_copy_only=False) for k in range(len(features) + len(targets))]).astype(float)
            for g, i in groups.items():
                own = of == i
                x, y = np.column_stack([np.ones(own.sum()), numbers[own, : len(features)]]), numbers[own, len(features) :]
                held = within(*(a[own] for a in at))
                above = y > x @ np.stack([models[(*g, k)] for k in [*range(len(held)), WHOLE]]).T if models else np.zeros((len(x), len(held) + 1), bool)
                weight = np.where(above[:, -1], under, 1.0)
                add((*g, WHOLE), summed(x, y, weight))
                for k, inside in enumerate(held):
                    change = np.where(inside, -weight, np.where(above[:, k], under, 1.0) - weight)
                    rows_of = np.flatnonzero(change)
                    if len(rows_of):
                        add((*g, k), summed(x[rows_of], y[rows_of], change[rows_of]))
        if found:
            keys = list(found)
            columns = [*(pa.array([k[i] for k in keys], pa.string()) for i in range(len(by))), pa.array([k[-1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "place", "sums"])

    given = rows.select(*(F.col(b).cast("string").alias(b) for b in by), *(F.col(c).cast("long") for c in _AT), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, *targets]))).na.drop(subset=[f"_{i}" for i in range(len(features) + len(targets))])
    parts = given.mapInArrow(blocks, ", ".join([*(f"{b} string" for b in by), "place int", "sums array<double>"]))
    total = parts.withColumn("_v", array_to_vector("sums")).groupBy(*by, "place").agg(Summarizer.sum(F.col("_v")).alias("_v")).select(*by, "place", vector_to_array("_v").alias("sums"))
    found = {(*r[: len(by)], r["place"]): np.array(r["sums"]) for r in total.collect()}  # groups x folds
    assert all(len(v) == width for v in found.values())
    return found


def solved(sums: np.ndarray, n: int, targets: int, penalty: float) -> np.ndarray:
    """Coefficients, a row a target: of least squares with a ridge on all but the constant."""
    up = _upper(n)
    a = np.zeros((n, n))
    a[up] = sums[: len(up[0])]
    a = a + np.triu(a, 1).T + penalty * np.diag([0.0] + [1.0] * (n - 1))
    return np.linalg.lstsq(a, sums[len(up[0]) :].reshape(targets, n).T, rcond=None)[0].T


def _solve_all(sums: dict[tuple, np.ndarray], places: int, n: int, targets: int, penalty: float) -> dict[tuple, np.ndarray]:
    out = {}
    for *group, _ in [k for k in sums if k[-1] == WHOLE]:
        whole = sums[(*group, WHOLE)]
        for k in [WHOLE, *range(places)]:
            out[(*group, k)] = solved(whole if k == WHOLE else whole + sums.get((*group, k), 0.0), n, targets, penalty)
    return out


def ridge_models(rows: DataFrame, folds: DataFrame, features: Sequence[str], targets: Sequence[str], penalty: float = 1.0, by: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """{(group, place): coefficients, a row a target}: each fold's leave it out, WHOLE's don't."""
    places = _places(folds)
    return _solve_all(gram_sums(rows, by, features, targets, places), len(places), len(features) + 1, len(targets), penalty)


def expectile_models(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, under: float = 2.0, penalty: float = 1.0, by: Sequence[str] = (), rounds: int = ROUNDS) -> dict[tuple, np.ndarray]:
    """As ridge_models, of one target, for the asymmetric squared loss. rows are read once a round."""
    places = _places(folds)
    models = ridge_models(rows, folds, features, [target], penalty, by)
    for _ in range(rounds):
        sums = gram_sums(rows, by, features, [target], places, {k: w[0] for k, w in models.items()}, under)
        new = _solve_all(sums, len(places), len(features) + 1, 1, penalty)
        settled = all(np.abs(new[k] - models[k]).max() <= SETTLED * (1 + np.abs(new[k]).max()) for k in new)
        models = new
        if settled:
            break
    return models


def model_table(like: DataFrame, models: dict[tuple, np.ndarray], folds: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(by, roi_idx, fold_id, model) of the folds, and (by, model) of all rows; model: array<array<double>>."""
    places = _places(folds)
    rows = [(*k[:-1], *places[k[-1]][:2], w.tolist()) for k, w in models.items() if k[-1] != WHOLE]
    full = [(*k[:-1], w.tolist()) for k, w in models.items() if k[-1] == WHOLE]
    names = "".join(f"{b} string, " for b in by)
    spark, kind = like.sparkSession, "model array<array<double>>"
    return spark.createDataFrame(rows, f"{names}roi_idx int, fold_id int, {kind}"), spark.createDataFrame(full, names + kind)


def linear_values(model: Column, features: Sequence[str]) -> Column:
    """Values of each target: products of the coefficients with (1, features)."""
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in features))
    return F.transform(model, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


@dataclass(frozen=True)
class Linear:
    """A predictor of the end-to-end plan: for each target a linear model of the features, expectile if `under` isn't 1."""

    features: tuple[str, ...]
    y: str = "y"
    by: tuple[str, ...] = ("target",)
    under: float = 2.0
    penalty: float = 1.0
    reads_twice: bool = True

    def fit(self, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        if self.under == 1:
            models = ridge_models(known, folds, self.features, [self.y], self.penalty, self.by)
        else:
            models = expectile_models(known, folds, self.features, self.y, self.under, self.penalty, self.by)
        held, full = model_table(known, models, folds, self.by)
        value = F.get(linear_values(F.col("model"), self.features), F.lit(0)).alias("yhat")
        # models are few and stood on the driver; joined by a shuffle, all rows of a target would meet in one task
        fitted = assign(known, folds).join(F.broadcast(held), [*self.by, "roi_idx", "fold_id"]).select("*", value).drop("model")
        return fitted, lambda cells: cells.join(F.broadcast(full), list(self.by), "left").select(*cells.columns, value)
