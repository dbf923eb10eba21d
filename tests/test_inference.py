"""Quantiles by ranges, roll-ups, strata by scale, linear predictors, and what they do in the end-to-end plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import embedding, folds, grid, linear, quantiles, strata
from latticeconf.operators.models import CategoryMeans, temperature
from latticeconf.plans import inference
from latticeconf.plans.grid_queries import FOLDS
from latticeconf.plans.inference_queries import SCALES, target_cells
from latticeconf.sources.tables import ROIS, cells

def summed():
    return [F.sum("y").alias("y")]


# --- quantiles


@pytest.mark.parametrize("ranges", [None, 1, 3, 40])
def test_quantiles_of_keys(spark, ranges):
    rng = np.random.default_rng(0)
    rows = [("ties", float(x)) for x in rng.integers(0, 4, 400)] + [("many", float(x)) for x in rng.normal(size=900)] + [("one", 2.5), ("skew", -7.0)] + [("skew", 1.0)] * 50
    df = spark.createDataFrame([*rows, ("ties", None), ("none", None)], "k string, v double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.9999, 1.0]
    got = {(r["k"], r["place"]): r["quantile"] for r in quantiles.quantiles(df, ["k"], "v", probs, ranges).collect()}
    want = {(k, i): np.quantile([v for n, v in rows if n == k], p) for k in {n for n, _ in rows} for i, p in enumerate(probs)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quantiles_with_probabilities_by_key(spark):
    df = spark.createDataFrame([("a", float(i), 0.5) for i in range(11)] + [("b", float(i), 0.9) for i in range(11)], "k string, v double, p double")
    got = {r["k"]: r["quantile"] for r in quantiles.quantiles(df, ["k"], "v", F.array("p"), 4).collect()}
    assert got == {"a": 5.0, "b": 9.0}


def test_no_window_over_a_whole_key(spark, monkeypatch):
    """Keys of more values than a task takes are dealt to ranges by themselves."""
    monkeypatch.setattr(quantiles, "TASK_VALUES", 50)
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    values = quantiles.cumulated(df, ["k"], "v")
    sizes = [r["count"] for r in values.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 120
    assert quantiles.quantiles(df, ["k"], "v", [0.5]).collect()[0]["quantile"] == 499.5


# --- roll-ups


@pytest.mark.parametrize("scales", [(1, 2, 4), (1, 2, 3, 6), (2, 5), (4,)])
def test_roll_up_is_pooling(spark, data, scales):
    c = cells(spark, data).withColumn("half", (F.col("event_id") % 2).cast("int"))
    for keys in ([], ["half"]):
        a, b = (grid.pyramid(c, scales, summed(), keys, merge=m).select("scale", *keys, "grid_row", "grid_col", "y") for m in (summed(), None))
        assert sorted(a.collect()) == sorted(b.collect())


def test_each_level_reads_the_former_one(spark, data):
    held = []
    levels = grid.roll_up(cells(spark, data), (1, 2, 4), summed(), summed(), hold=lambda df: held.append(df) or df)
    assert list(levels) == [1, 2, 4] and len(held) == 2
    with pytest.raises(ValueError):
        grid.roll_up(cells(spark, data), (0, 1), summed(), summed())


# --- strata


def vectors(spark, data):
    rows = grid.to_grid(spark.read.parquet(f"{data}/embeddings.parquet"), "vec_id", 20)
    return rows.select(F.lit("s").alias("slide_id"), "grid_row", "grid_col", F.col("embedding").alias("emb"))


def test_strata_are_fitted_once(spark, data, tmp_path, monkeypatch):
    slides = vectors(spark, data)
    rois = grid.crop(slides, [(0, 2, 4, 8, 8)]).select("slide_id", "roi_idx", "grid_row", "grid_col", "emb")
    store = strata.StrataStore(spark, str(tmp_path / "models"))
    first = sorted(strata.strata(store, slides, rois, "emb", 64, [1, 2], k=4).collect(), key=repr)
    monkeypatch.setattr(strata, "stratify", lambda *a: pytest.fail("fitted again"))
    assert sorted(strata.strata(store, slides, rois, "emb", 64, [1, 2], k=4).collect(), key=repr) == first
    n = slides.count()
    assert sum(r["roi_idx"] is None and r["scale"] == 1 for r in first) == n and sum(r["roi_idx"] == 0 for r in first) == 64 + 16
    assert {r["cluster"] for r in first} <= set(range(4)) and len({r["cluster"] for r in first}) > 1
    # an ROI's windows that lie on the slide's own have the slide's strata
    label = {(r["roi_idx"], r["scale"], r["grid_row"], r["grid_col"]): r["cluster"] for r in first}
    assert all(c == label[None, s, r + 2 // s, x + 4 // s] for (roi, s, r, x), c in label.items() if roi == 0)


def test_strata_of_scales_have_models_of_their_own(spark, data, tmp_path):
    slides = vectors(spark, data)
    store = strata.StrataStore(spark, str(tmp_path / "models"))
    strata.strata(store, slides, grid.crop(slides, [(0, 0, 0, 4, 4)]).select("slide_id", "roi_idx", "grid_row", "grid_col", "emb"), "emb", 64, [1, 2], k=3).count()
    models = [embedding.stored(spark, f"{store.root}/scale={s}/k=3", lambda: pytest.fail("not kept")) for s in (1, 2)]
    assert not np.allclose(models[0].stages[-1].clusterCenters(), models[1].stages[-1].clusterCenters())


# --- linear predictors


def spots(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.gamma(1.0, 1.0, n)
    rows = [(int(i % 2), int(i // 25), int(i % 25), *map(float, x[i]), float(y[i]), "ab"[i % 3 == 0]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "roi_idx int, grid_row long, grid_col long, x0 double, x1 double, x2 double, y double, g string").repartition(3)


def small_folds(spark):
    return folds.fold_table(spark, {r: folds.split(folds.whole(0, 0, 24, 25), 14, 2) for r in (0, 1)})


def by_hand(x, y, under, penalty):
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.ones(len(y)), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(200):
        b = np.linalg.solve((x * w[:, None]).T @ x + ridge, (x * w[:, None]).T @ y)
        w = np.where(y > x @ b, under, 1.0)
    return b


@pytest.mark.parametrize("under", [1.0, 2.0, 9.0])
def test_models_leave_their_fold_out(spark, under):
    rows, df = spots(spark)
    table = small_folds(spark)
    places = linear._places(table)
    models = linear.ridge_models(df, table, ["x0", "x1", "x2"], ["y"], by=["g"]) if under == 1 else linear.expectile_models(df, table, ["x0", "x1", "x2"], "y", under, by=["g"])
    assert len(models) == 2 * (1 + len(places))
    for (g, k), w in models.items():
        out = (None, None, 0, 0, 0, 0) if k == linear.WHOLE else places[k]
        train = [r for r in rows if r[7] == g and not (r[0] == out[0] and out[2] <= r[1] < out[3] and out[4] <= r[2] < out[5])]
        want = by_hand(np.array([r[3:6] for r in train]), np.array([r[6] for r in train]), under, 1.0)
        assert np.allclose(w[0], want, atol=1e-7)


def test_expectile_lies_above_the_mean(spark):
    _, df = spots(spark)
    table = small_folds(spark)
    low, high = (linear.expectile_models(df, table, ["x0"], "y", u)[(linear.WHOLE,)][0][0] for u in (1.0, 5.0))
    assert high > low + 0.1


def test_models_of_nothing_and_of_nulls(spark):
    rows, df = spots(spark)
    table = small_folds(spark)
    assert linear.ridge_models(df.limit(0), table, ["x0"], ["y"]) == {}
    with_null = df.unionByName(df.limit(5).withColumn("x0", F.lit(None).cast("double")))
    assert np.allclose(linear.ridge_models(with_null, table, ["x0"], ["y"])[(linear.WHOLE,)], linear.ridge_models(df, table, ["x0"], ["y"])[(linear.WHOLE,)])


# --- end to end


def test_predictors_and_strata_end_to_end(spark, data):
    c = target_cells(spark, data).withColumn("x", (F.col("grid_col") % 10).cast("double"))
    table = folds.fold_table(spark, FOLDS)
    run = lambda **k: {(r["target"], r["scale"], r["grid_row"], r["grid_col"]): r for r in inference.confidence(c, ROIS, table, SCALES, **k).collect()}
    means, same, other = run(), run(predictor=CategoryMeans("category", "y")), run(predictor=linear.Linear(("x",)))
    assert means == same and other.keys() == means.keys()
    assert any(other[k]["p"] != means[k]["p"] for k in means) and all(0 < r["p"] <= 1 and r["p"] <= r["p_adj"] + 1e-12 for r in other.values())
    one = grid.pyramid(c.where("target = 'value'").select("grid_row", "grid_col"), SCALES, [F.lit(0).alias("cluster")]).withColumn("roi_idx", F.lit(None).cast("int"))
    bare = run(strata=one, everywhere=True)  # ROIs have no strata, so nothing is known
    assert bare.keys() > means.keys() and all(r["p"] == r["p_adj"] == 1 and r["confidence"] == 0 for r in bare.values())


def test_temperature_of_held_out_rows(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    label = [int(rng.choice(3, p=q)) for q in p]
    df = spark.createDataFrame([([float(v) for v in 3 * a], b) for a, b in zip(z, label, strict=True)], "logits array<double>, label int")
    assert 2.5 < temperature(df, "logits", "label") < 3.5
