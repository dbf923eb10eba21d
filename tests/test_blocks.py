"""Neighbourhoods by blocks and resampling, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import blocks, tissue
from latticeconf.sources.files import rescaled


def cells_of(spark, a, **more):
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "grid_row int, grid_col int, y double").withColumns({k: F.lit(v) for k, v in more.items()})


def grid_of(df, shape, value="y"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["grid_row"], r["grid_col"]] = np.nan if r[value] is None else r[value]
    return out


def smooth_by_hand(a, taps):
    reach = max(abs(d) for d, _ in taps)
    wide = np.pad(a, reach, mode="symmetric")
    h, w = a.shape
    return sum(u * v * wide[reach + d : reach + d + h, reach + e : reach + e + w] for d, u in taps for e, v in taps)


@pytest.mark.parametrize(("shape", "size", "block"), [((23, 17), 4, 5), ((23, 17), 4, 128), ((2, 2), 16, 128), ((1, 30), 8, 4), ((40, 3), 6, 7)])
def test_filters_mirror_as_often_as_needed(spark, shape, size, block):
    a = np.random.default_rng(0).normal(size=shape)
    taps = tissue.kernel(size)
    got = grid_of(blocks.separable(cells_of(spark, a), "y", taps, block=block), shape)
    assert np.allclose(got, smooth_by_hand(a, taps))


def test_constant_fields_stay_constant(spark):
    """With keys, with one hole, with a hole wider than the fill, and on small grids."""
    wide, one, small = np.full((30, 30), 5.0), np.full((12, 9), 5.0), np.full((2, 2), 5.0)
    wide[8:20, 5:22] = np.nan
    one[3, 3] = np.nan
    df = cells_of(spark, wide, k="wide").unionByName(cells_of(spark, one, k="one")).unionByName(cells_of(spark, small, k="small"))
    for size in (4, 16):
        out = tissue.smoothen(df, "y", size, keys=["k"])
        for k, a in (("wide", wide), ("one", one), ("small", small)):
            got = grid_of(out.where(F.col("k") == k), a.shape)
            assert np.array_equal(np.isnan(got), np.isnan(a)) and np.allclose(got[~np.isnan(a)], 5.0)


def test_a_cell_goes_to_four_blocks_at_most(spark, monkeypatch):
    seen = []
    real = blocks._span
    monkeypatch.setattr(blocks, "_span", lambda *a: seen.append(a) or real(*a))
    df = cells_of(spark, np.zeros((50, 50)))
    blocks.context(df, "y", 6, block=6).count()
    sent = df.crossJoin(F.broadcast(spark.createDataFrame([(50, 50)], "_rows int, _cols int"))).withColumn("a", real("grid_row", "_rows", 13, 6)).withColumn("b", real("grid_col", "_cols", 13, 6))
    assert len(seen) == 2 and sent.groupBy("grid_row", "grid_col").count().agg(F.max("count")).collect()[0][0] <= 4


@pytest.mark.parametrize("block", [4, 128])
def test_context_of_cells(spark, block):
    a = np.random.default_rng(1).normal(size=(11, 14))
    df = cells_of(spark, a, k="x").where("NOT (grid_row = 4 AND grid_col = 4)")
    got = {(r["grid_row"], r["grid_col"]): r["patch"] for r in blocks.context(df, "y", 2, ["k"], block=block).collect()}
    a[4, 4] = 0
    wide = np.pad(a, 2)
    assert len(got) == 11 * 14 - 1
    assert all(np.allclose(p, wide[r : r + 5, c : c + 5].ravel()) for (r, c), p in got.items())


def test_nothing_in_gives_nothing(spark):
    none = cells_of(spark, np.zeros((1, 1))).limit(0)
    assert blocks.context(none, "y", 1).count() == 0 and tissue.smoothen(none, "y", 4).count() == 0 and blocks.rescale(none, "y", 1.3).count() == 0


@pytest.mark.parametrize("factor", [1.3, 0.4, 2.0, 1.0, 3.7])
def test_rescaling_equals_the_image_s(spark, factor):
    a = np.random.default_rng(2).integers(0, 256, (19, 26)).astype(float)
    want = rescaled(a[..., None].astype(np.uint8), factor)[..., 0]
    both = cells_of(spark, a, k="a").unionByName(cells_of(spark, a[:7, :5], k="b"))
    out = blocks.rescale(both, "y", factor, ["k"])
    got = grid_of(out.where("k = 'a'"), want.shape)
    assert out.where("k = 'a'").count() == want.size and np.allclose(np.rint(got), want, atol=1)
    assert np.abs(np.rint(got) - want).sum() <= 2  # halves may be rounded either way
    assert out.where("k = 'b'").count() == rescaled(a[:7, :5, None].astype(np.uint8), factor)[..., 0].size
