"""Cross-fit regressions, temperature, smoothing, stored models and ranges against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import audit, conformal, embedding, folds, models, tissue


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(4)
    rows = [(r // 12, r, c, *map(float, rng.normal(size=2))) for r in range(24) for c in range(20)]
    df = spark.createDataFrame(rows, "roi_idx int, grid_row int, grid_col int, a double, b double")
    return df.withColumns({"y": 2 * F.col("a") - F.col("b") + 1, "z": F.col("a") * F.col("b")})


def test_ridge_leaves_its_fold_out(spark, grid):
    table = folds.fold_table(spark, {0: [folds.whole(0, 0, 12, 20)], 1: [folds.whole(12, 0, 12, 20)]})
    out, full = models.crossfit_ridge(grid, table, ["a", "b"], ["y", "z"], penalty=0.5)
    p = grid.toPandas()
    x = np.c_[np.ones(len(p)), p[["a", "b"]]]

    def fit(rows):
        a = x[rows].T @ x[rows] + 0.5 * np.diag([0, 1, 1])
        return np.linalg.solve(a, x[rows].T @ p.loc[rows, ["y", "z"]].to_numpy())

    got = {(r["grid_row"], r["grid_col"]): r["yhat"] for r in out.collect()}
    for roi in (0, 1):
        want = x @ fit((p.roi_idx != roi).to_numpy())
        for i in np.flatnonzero(p.roi_idx == roi):
            assert got[p.grid_row[i], p.grid_col[i]] == pytest.approx(list(want[i]), abs=1e-8)
    assert np.array(full) == pytest.approx(fit(np.ones(len(p), bool)).T, abs=1e-8)
    one = models.full_model_values(grid, full, ["a", "b"]).first()
    assert one["yhat"] == pytest.approx([w[0] + w[1] * one["a"] + w[2] * one["b"] for w in full])
    assert models.crossfit_ridge(grid.limit(0), table, ["a", "b"], ["y"])[0].count() == 0


def test_temperature_is_least(spark):
    rng = np.random.default_rng(1)
    true = rng.normal(size=(800, 3))
    labels = [int(rng.choice(3, p=np.exp(t) / np.exp(t).sum())) for t in true]
    df = spark.createDataFrame([([float(3 * v) for v in t], k) for t, k in zip(true, labels, strict=True)], "logits array<double>, label int")
    got = models.temperature(df, "logits", "label")
    loss = lambda t: np.mean([np.log(np.exp(3 * v / t).sum()) - 3 * v[k] / t for v, k in zip(true, labels, strict=True)])
    assert loss(got) <= min(loss(t) for t in np.linspace(0.5, 10, 200)) + 1e-4 and 2 < got < 4.5
    p = df.select(models.softmax("logits", got).alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1)
    assert models.temperature(df.limit(0), "logits", "label") == 1.0


@pytest.mark.parametrize(("size", "kind"), [(4, "gaussian"), (3, "uniform"), (4, "uniform")])
def test_smoothing_mirrors_borders(spark, size, kind):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 9))
    df = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(7) for c in range(9)], "grid_row int, grid_col int, y double")
    taps = tissue.kernel(size, kind)
    reach = max(abs(d) for d, _ in taps)
    wide = np.pad(a, reach, mode="symmetric")
    want = sum(u * v * wide[reach + d : reach + d + 7, reach + e : reach + e + 9] for d, u in taps for e, v in taps)
    got = {(r["grid_row"], r["grid_col"]): r["y"] for r in tissue.smoothen(df, "y", size, kind).collect()}
    assert all(got[r, c] == pytest.approx(want[r, c]) for r in range(7) for c in range(9))
    holed = df.withColumn("y", F.when(F.col("grid_row") + F.col("grid_col") > 0, F.col("y")))
    out = {(r["grid_row"], r["grid_col"]): r["y"] for r in tissue.smoothen(holed, "y", size, kind).collect()}
    assert out[0, 0] is None and len(out) == 63 and out[6, 8] == pytest.approx(want[6, 8])


def test_reductions_are_made_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, r, c, [float(x) for x in rng.normal(size=8)]) for s in "ab" for r in range(6) for c in range(6)]
    slides = spark.createDataFrame(rows, "slide_id string, grid_row int, grid_col int, emb array<double>")
    rois = slides.where("grid_row < 4 AND grid_col < 4").withColumn("roi_idx", F.lit(0))
    one = embedding.reduce_slides(slides, rois, "emb", 8, 2, f"{tmp_path}/m", (1, 2))
    assert {(r["kind"], r["scale"]): r["n"] for r in one.groupBy("kind", "scale").agg(F.count(F.lit(1)).alias("n")).collect()} == {("slide", 1): 72, ("slide", 2): 18, ("roi", 1): 32, ("roi", 2): 8}
    again = embedding.reduce_slides(slides.limit(1), rois.limit(1), "emb", 8, 2, f"{tmp_path}/m")
    same = one.where("kind = 'roi' AND scale = 1").join(again.where("kind = 'roi'"), ["slide_id", "grid_row", "grid_col"])
    assert all(one_["a"] == pytest.approx(one_["b"]) for one_ in same.select(one["reduced"].alias("a"), again["reduced"].alias("b")).collect())


def test_ranges_by_count(spark):
    df = spark.createDataFrame([(k, float(i), 1, 1) for k in (0, 1) for i in range(50 if k else 7)], "k int, score double, n_calib long, n_test long")
    assert conformal.ranges_for(df, ["k"], 20) == 3 and conformal.ranges_for(df, ["k"]) == 1 and conformal.ranges_for(df.limit(0), ["k"]) == 1


def test_masked_discoveries(spark):
    df = spark.createDataFrame([(0, 0.02, 5.0, 1.0, True), (0, 0.02, 0.0, 1.0, False)], "k int, p_adj double, y double, null_number double, typed boolean")
    got = {round(r["fdr"], 2): (r["n_discover"], r["fdp"]) for r in audit.fdp_curve(df, ["k"], F.col("typed")).collect()}
    assert got[0.05] == (1, 0.0)
