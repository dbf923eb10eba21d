"""Sides stored in buckets, and class scores with their temperature."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import conformal, folds
from latticeconf.operators.models import ByKind, CategoryMeans, ClassScores
from latticeconf.sources.buckets import SideStore


def sides(spark, n=900):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], i % 3, None if i % 41 == 0 else int(i % 3 == 0), float(rng.integers(0, 2)), float(rng.integers(0, 30)), 0.0, bool(i % 4 == 0)) for i in range(n)]
    rows += [(n + i, "no calibration", 0, 0, 0.0, float(i), 0.0, False) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, target string, scale int, cluster int, y double, yhat double, null_number double, calib boolean")
    return df.where("calib").drop("calib"), df.where("NOT calib").drop("calib")


KEYS = ["target", "scale", "cluster"]


@pytest.mark.parametrize("most_rows", [1_000_000, 100, 1])
def test_stored_sides_rank_alike(spark, most_rows):
    cal, tes = sides(spark)
    want = {r["i"]: (r["p"], r["p_adj"], r["confidence"]) for r in conformal.adjusted(cal, tes, KEYS).collect()}
    store = SideStore.save(*conformal.scored(cal, tes, KEYS), buckets=4, most_rows=most_rows)
    got = {r["i"]: (r["p"], r["p_adj"], r["confidence"]) for r in store.ranks().collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    one = {r["i"]: r["p"] for r in store.ranks("target = 'a'").collect()}
    assert one and one == {r["i"]: want[r["i"]][0] for r in tes.where("target = 'a'").collect()}


def test_no_exchange_from_scan_to_ranks(spark):
    store = SideStore.save(*conformal.scored(*sides(spark), KEYS), "some_sides", buckets=4)
    plan = store.ranks("target IN ('a', 'b') AND cluster IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    again = SideStore.save(*conformal.scored(*sides(spark, 80), KEYS), "some_sides", buckets=4)
    assert again.ranks().count() == 65


def test_empty_sides(spark):
    cal, tes = sides(spark)
    assert SideStore.save(*conformal.scored(cal, tes.limit(0), KEYS), buckets=2).ranks().count() == 0
    alone = SideStore.save(*conformal.scored(cal.limit(0), tes, KEYS), buckets=2).ranks()
    assert {r["p"] for r in alone.select("p").distinct().collect()} == {1.0}


def typed(spark, n=500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    label = [str(np.argmax([a, b, 0.3]) if rng.random() < 0.8 else rng.integers(0, 3)) for a, b in x]
    rows = [(0, i // 25, i % 25, float(a), float(b), None if i == 7 else "other" if i == 9 else c, t, "type" if t != "v" else "expression", float(c == "0")) for i, ((a, b), c) in enumerate(zip(x, label, strict=True)) for t in ("zero", "one or two", "v")]
    return x, label, spark.createDataFrame(rows, "roi_idx int, grid_row long, grid_col long, a double, b double, label string, target string, kind string, y double")


MEMBERS = {"zero": ("0",), "one or two": ("1", "2")}


def test_class_scores_against_numpy(spark):
    x, label, df = typed(spark)
    table = folds.fold_table(spark, {0: folds.split(folds.whole(0, 0, 20, 25), 12, 2)})
    held, model = ClassScores(("a", "b"), ("0", "1", "2"), MEMBERS, unit=10.0).fit(df.where("kind = 'type'"), table)
    full = np.c_[np.ones(len(x)), x]
    kinds = np.array([[c == k and i not in (7, 9) for k in "012"] for i, c in enumerate(label)], float)
    solve = lambda rows: np.linalg.solve(full[rows].T @ full[rows] + np.diag([0, 1, 1]), full[rows].T @ kinds[rows])
    at = np.array([(i // 25, i % 25) for i in range(len(x))])
    scores = np.full((len(x), 3), np.nan)
    for f in table.collect():
        inside = lambda k, f=f: (at[:, 0] >= f[f"{k}_top"]) & (at[:, 0] < f[f"{k}_bottom"]) & (at[:, 1] >= f[f"{k}_left"]) & (at[:, 1] < f[f"{k}_right"])
        scores[inside("c")] = full[inside("c")] @ solve(~inside("f"))
    seen = (kinds.sum(1) > 0) & ~np.isnan(scores[:, 0])

    def loss(t):
        z = scores[seen] / t
        return np.mean(np.log(np.exp(z).sum(1)) - z[kinds[seen] > 0])

    heat = min(np.exp(np.linspace(np.log(0.05), np.log(20), 20_000)), key=loss)
    soft = lambda z: np.exp(z / heat) / np.exp(z / heat).sum(1, keepdims=True)
    for got, share in ((held, soft(scores)), (model(df.where("kind = 'type'")), soft(full @ solve(np.ones(len(x), bool))))):
        rows = got.collect()
        assert len(rows) == 2 * len(x) and all(abs(r["yhat"] - 10 * (share[r["grid_row"] * 25 + r["grid_col"], 0] if r["target"] == "zero" else share[r["grid_row"] * 25 + r["grid_col"], 1:].sum())) < 0.01 for r in rows)


def test_predictors_by_kind(spark):
    _, _, df = typed(spark, 100)
    table = folds.fold_table(spark, {0: [folds.whole(0, 0, 2, 25), folds.whole(2, 0, 2, 25)]})
    held, model = ByKind({"type": ClassScores(("a",), ("0", "1", "2"), MEMBERS), "expression": CategoryMeans("label", "y")}).fit(df, table)
    assert held.count() == 299  # a category mean knows nothing of the cell without a category
    out = model(df.unionByName(df.limit(3).withColumn("kind", F.lit("unheard of"))))
    assert out.count() == 303 and {r["kind"] for r in out.where("yhat IS NULL").collect()} <= {"unheard of", "expression"} and out.where("kind = 'unheard of' AND yhat IS NOT NULL").count() == 0
    none, blank = ClassScores(("a",), ("0",), MEMBERS).fit(df.limit(0), table)
    assert none.count() == 0 and blank(df).where("yhat IS NULL").count() == 300
