"""Grid, folds and components against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import folds, grid, models, tissue


def cells(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a)], "grid_row long, grid_col long, v double")


def dense(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["grid_row"], r["grid_col"]] = r[col]
    return out


@pytest.mark.parametrize("width", [40, 184, 200, 201, 368, 504, 777])
def test_level_0_centres_tile(width):
    seen = np.zeros((width, width), int)
    for f in folds.split(folds.whole(0, 0, width, width), 200):
        t, b, left, r = f.centre
        seen[t:b, left:r] += 1
    assert (seen == 1).all()


def test_fold_geometry_worked_by_hand():
    got = folds.split(folds.whole(0, 0, 504, 504), 200, 16)
    assert len(got) == 9
    assert sorted({f.centre[:2] for f in got}) == [(0, 184), (184, 352), (352, 504)]


def test_recursive_split_ends_with_enough_outside(spark):
    a = spark.range(120 * 120).select((F.col("id") / 120).cast("long").alias("grid_row"), (F.col("id") % 120).alias("grid_col"), F.lit(0).alias("roi_idx"))
    a = a.withColumn("cluster", (F.col("grid_row") / 40).cast("int"))
    done = folds.generate(a, widths=(60, 30), border=4)[0]
    seen = np.zeros((120, 120), int)
    for f in done:
        t, b, left, r = f.centre
        seen[t:b, left:r] += 1
    assert seen.max() == 1 and len(done) > 4


def test_split_rejects_narrow_folds():
    with pytest.raises(ValueError):
        folds.split(folds.Fold(0, 30, 0, 30, (0, 30, 0, 30), (False,) * 4), 100, 16)


def test_pools(spark):
    a = np.random.default_rng(0).integers(0, 9, (11, 13))
    df = cells(spark, a)
    got = dense(grid.pyramid(df, [3], [F.sum("v").alias("s")]).where("scale = 3"), "s", (3, 4))
    assert np.array_equal(got, a[:9, :12].reshape(3, 3, 4, 3).sum((1, 3)))
    got = dense(grid.pool_strided(df, 3, 2, 11, 13, [F.sum("v").alias("s")]), "s", (5, 6))
    assert np.array_equal(got, [[a[r : r + 3, c : c + 3].sum() for c in range(0, 11, 2)] for r in range(0, 9, 2)])
    top = dense(grid.pool(df, 3, [grid.top_n_mean(F.col("v"), 4).alias("t")]), "t", (4, 5))
    assert top[1, 1] == pytest.approx(np.sort(a[3:6, 3:6].ravel())[-4:].mean())


def test_many_rectangles_equal_few(spark, monkeypatch):
    df = cells(spark, np.zeros((30, 30)))
    rects = [(i, i, i, 5, 4) for i in range(12)]
    few = sorted(map(tuple, grid.in_rects(df, rects).select("roi_idx", "grid_row", "grid_col").collect()))
    monkeypatch.setattr(grid, "FEW_RECTS", 3)
    monkeypatch.setattr(grid, "TILE", 7)
    assert few == sorted(map(tuple, grid.in_rects(df, rects).select("roi_idx", "grid_row", "grid_col").collect()))
    assert grid.with_membership(df, rects).where("in_roi").count() == len({(r, c) for _, r, c in few})


@pytest.mark.parametrize("rect", [(0, 0, 0, 0, 5), (0, -1, 0, 3, 5), (0, 8, 0, 3, 5)])
def test_bad_rectangles(rect):
    with pytest.raises(ValueError):
        grid.checked_rects([rect], (10, 10))


def test_label_scatter_golden(spark):
    mask = np.array([[1, 0, 1], [1, 1, 0], [0, 1, 0]])
    at = [tuple(map(int, x)) for x in np.argwhere(mask)]
    values = spark.createDataFrame([(r, c, v) for (r, c), v in zip(at, [0, 1, 2, 0, 1], strict=True)], "grid_row long, grid_col long, label int")
    got = {(r["grid_row"], r["grid_col"]): r["label"] for r in grid.scatter(cells(spark, mask), values, ["grid_row", "grid_col"]).collect()}
    assert [[got[r, c] for c in range(3)] for r in range(3)] == [[0, None, 1], [2, 0, None], [None, 1, None]]


def test_components(spark):
    rng = np.random.default_rng(5)
    a = rng.random((25, 25)) < 0.35
    df = cells(spark, a).where("v > 0")
    label = {}
    for r, c in np.argwhere(a):
        if (r, c) in label:
            continue
        stack, code = [(r, c)], r * (1 << 31) + c
        while stack:
            y, x = stack.pop()
            if (y, x) in label or not (0 <= y < 25 and 0 <= x < 25 and a[y, x]):
                continue
            label[y, x] = code
            stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = {(r["grid_row"], r["grid_col"]): r["component"] for r in tissue.connected_components(df).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == groups(label)


def test_smoothing_mirrors_borders(spark):
    h = np.zeros((5, 5))
    h[0, 0], h[4, 2] = 10, 4
    df = spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(h) if v], "x_bin int, y_bin int, n long")
    w = tissue.gaussian_weights(1.0)
    pad = np.pad(h, 4, mode="symmetric")
    for axis in (0, 1):
        pad = np.apply_along_axis(lambda v: np.convolve(v, w, mode="same"), axis, pad)
    got = np.zeros((5, 5))
    for r in tissue.smooth(df, 5, 1.0).collect():
        got[r["x_bin"], r["y_bin"]] = r["density"]
    assert np.allclose(got, pad[4:9, 4:9])


def test_cross_fitted_network_beats_the_mean(spark):
    a = spark.range(40 * 40).select((F.col("id") / 40).cast("long").alias("grid_row"), (F.col("id") % 40).alias("grid_col"), F.lit(0).alias("roi_idx"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("x"))
    a = a.withColumn("y", 3 * F.col("x") + 1)
    table = folds.fold_table(spark, {0: folds.split(folds.whole(0, 0, 40, 40), 24, 2)})
    fit = models.mlp_regressor(["x"], "y", hidden=(16, 16), epochs=200, rate=0.01, batch=256)
    out = models.crossfit(a, table, ["x"], "y", fit).join(a, ["grid_row", "grid_col"]).select("y", "yhat").toPandas()
    assert len(out) == 1600
    assert models.asymmetric_loss((out.y - out.yhat).to_numpy()) < 0.5 * models.asymmetric_loss((out.y - out.y.mean()).to_numpy())


def test_strided_query_pools_the_whole_grid(spark, tmp_path):
    """25 rows of 100 cells, against a loop over all windows."""
    from latticeconf.plans import grid_queries

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id < 2500")
    events.write.parquet(f"{tmp_path}/events.parquet")
    y = {(r["grid_row"], r["grid_col"]): r["y"] for r in grid_queries.cells(spark, str(tmp_path)).collect()}
    n_rows, n_cols = max(r for r, _ in y) + 1, max(c for _, c in y) + 1
    want = {(i, j): sum(y.get((2 * i + a, 2 * j + b), 0) for a in range(4) for b in range(4)) for i in range((n_rows - 4) // 2 + 1) for j in range((n_cols - 4) // 2 + 1)}
    assert n_rows > 20 and {(r["grid_row"], r["grid_col"]): r["total"] for r in grid_queries.pool_strided_overlap(spark, str(tmp_path)).collect()} == want
