"""Ranks, adjustment, tolerance and confidence against NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeconf.functions.scores import LEVELS, confidence
from latticeconf.operators import audit, conformal


def brute(calib, test, c, tol=0.0):
    """p and adjusted p of one stratum in NumPy."""
    s = np.array([-yhat if y <= c else np.inf for y, yhat in calib])
    p = np.array([(np.sum(s + tol < -yhat) + 1) / (len(s) + 1) for yhat in test])
    order = np.argsort(p, kind="stable")
    raw = len(p) * p[order] / np.arange(1, len(p) + 1)
    adj = np.empty(len(p))
    adj[order] = np.clip(np.minimum.accumulate(raw[::-1])[::-1], 0, 1)
    return p, adj


def sides(spark, calib, test, c):
    cal = spark.createDataFrame([(k, float(y), float(h), c) for k, y, h in calib], "k int, y double, yhat double, null_number double")
    tes = spark.createDataFrame([(i, k, float(h), c) for i, (k, h) in enumerate(test)], "i int, k int, yhat double, null_number double")
    return cal, tes


@pytest.mark.parametrize("ranges", [1, 5])
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_ranks_and_adjustment(spark, ranges, seed):
    rng = np.random.default_rng(seed)
    calib = [(int(k), y, h) for k, y, h in zip(rng.integers(0, 3, 90), rng.integers(0, 4, 90), rng.integers(0, 12, 90), strict=True)]
    test = [(int(k), h) for k, h in zip(rng.integers(0, 3, 70), rng.integers(0, 12, 70), strict=True)]
    got = {r["i"]: r for r in conformal.adjusted(*sides(spark, calib, test, 1.0), ["k"], ranges=ranges).collect()}
    for k in range(3):
        ids = [i for i, t in enumerate(test) if t[0] == k]
        p, adj = brute([(y, h) for j, y, h in calib if j == k], [test[i][1] for i in ids], 1.0)
        for i, a, b in zip(ids, p, adj, strict=True):
            assert got[i]["p"] == pytest.approx(a, abs=1e-12) and got[i]["p_adj"] == pytest.approx(b, abs=1e-12)
            assert 0 < got[i]["p"] <= 1 and got[i]["p_adj"] >= got[i]["p"] - 1e-12 and 0 <= got[i]["confidence"] <= 1


def test_unknown_strata(spark):
    """No stratum, and a stratum without calibration rows, both give p = 1."""
    cal, tes = sides(spark, [(0, 0, 1)], [(0, 5), (None, 5), (7, 5)], 1.0)
    got = {r["i"]: r["p_adj"] for r in conformal.adjusted(cal, tes, ["k"]).collect()}
    assert got[1] == 1.0 and got[2] == 1.0


@pytest.mark.parametrize("strength", ["weak", "medium", "strong"])
def test_tolerance(spark, strength):
    rng = np.random.default_rng(3)
    calib = [(k, float(rng.integers(0, 3)), float(x)) for k in range(3) for x in rng.normal(0, 1, 200)]
    calib += [(9, 5.0, 1.0)] * 20  # no nulls: no tolerance
    test = [(k, float(x)) for k in range(3) for x in rng.normal(0.5, 1, 150)]
    cal, tes = sides(spark, calib, test, 1.0)
    got = {r["k"]: r["tolerance"] for r in conformal.tolerance(cal.withColumn("is_null", F.col("y") <= F.col("null_number")), tes, ["k"], strength).collect()}
    for k in range(3):
        c = np.array([h for j, _, h in calib if j == k])
        t = np.array([h for j, h in test if j == k])
        share = np.mean([y <= 1 for j, y, _ in calib if j == k])
        lo, hi = c[c <= np.quantile(c, share)], t[t <= np.quantile(t, share)]
        assert got[k] == pytest.approx(-np.max(np.clip(np.quantile(hi, LEVELS[strength]) - np.quantile(lo, LEVELS[strength]), 0, None)), abs=1e-9)
    assert got[9] == 0


def test_tolerance_names_and_numbers(spark):
    cal, tes = sides(spark, [(0, 0, 1)], [(0, 1)], 1.0)
    cal = cal.withColumn("is_null", F.lit(True))
    assert conformal.tolerance(cal, tes, ["k"], -0.25).collect()[0]["tolerance"] == -0.25
    with pytest.raises(ValueError):
        conformal.tolerance(cal, tes, ["k"], "huge")


def test_confidence_anchors(spark):
    p = spark.createDataFrame([(0.01,), (0.5,), (1.0,), (0.001,)], "p double")
    assert [r[0] for r in p.select(confidence(F.col("p"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_false_discoveries_stay_below_the_rate(spark):
    """Exchangeable data: the mean realised proportion doesn't exceed the nominal rate by much."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 6000) * rng.gamma(2, 1, 6000)
    h = y + rng.normal(0, 0.6, 6000)
    cal = spark.createDataFrame([(0, float(a), float(b), 0.0) for a, b in zip(y[:3000], h[:3000], strict=True)], "k int, y double, yhat double, null_number double")
    tes = spark.createDataFrame([(0, float(a), float(b), 0.0) for a, b in zip(y[3000:], h[3000:], strict=True)], "k int, y double, yhat double, null_number double")
    curve = {round(r["fdr"], 2): r for r in audit.fdp_curve(conformal.adjusted(cal, tes, ["k"]), ["k"]).collect()}
    assert len(curve) == 99
    for level in (0.05, 0.1, 0.2, 0.5):
        assert curve[level]["fdp"] <= level * 1.25 + 0.01
    assert curve[0.2]["n_discover"] > 500
