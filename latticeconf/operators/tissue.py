"""Tissue detection: patch statistics, density and ratio filters, texture, components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rejected_colour
from .blocks import separable
from .embedding import mixture
from .shared import written

PATCH, DENSITY, BIN_SHARE, SIGMA_SHARE, CUT_SHARE, OTSU_BINS, GREY_LEVELS, MIN_SIZE, GROUPS = 16, 100.0, 0.00005, 0.02, 0.9, 256, 64, 10, 3


def patch_statistics(pixels: DataFrame, key: str, channels: Sequence[str]) -> DataFrame:
    """Means of the channels and the deviation over all of a patch's values (population)."""
    n = len(channels)
    total = sum((F.sum(c) for c in channels[1:]), F.sum(channels[0]))
    squares = sum((F.sum(F.col(c) * F.col(c)) for c in channels[1:]), F.sum(F.col(channels[0]) * F.col(channels[0])))
    count = F.count(F.lit(1)) * n
    variance = squares / count - F.pow(total / count, 2)
    return pixels.groupBy(key).agg(*(F.avg(c).alias(f"mean_{c}") for c in channels), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("deviation"))


def variance_weighted_mean(patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds z: the columns' mean weighted by each column's variance over all patches."""
    v = patches.agg(*(F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    top = sum((F.col(c) * F.col(f"_v{i}") for i, c in enumerate(columns)), F.lit(0.0))
    bottom = sum((F.col(f"_v{i}") for i in range(len(columns))), F.lit(0.0))
    return patches.crossJoin(F.broadcast(v)).withColumn("z", F.try_divide(top, bottom)).drop(*(f"_v{i}" for i in range(len(columns))))


def min_max(df: DataFrame, columns: dict[str, str], shift: float = 0.0) -> DataFrame:
    """Adds each column scaled to shift .. shift + 1 under its new name; NULLs stay NULL."""
    m = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {new: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) + shift for c, new in columns.items()}
    return df.crossJoin(F.broadcast(m)).withColumns(scaled).drop(*m.columns)


def deviation_ratio(patches: DataFrame, deviation: str = "deviation", z: str = "z") -> DataFrame:
    """Adds ratio: normalised deviation over normalised mean, normalised again."""
    both = min_max(patches, {deviation: "deviation_norm", z: "z_norm"}, 1.0)
    return min_max(both.withColumn("_ratio", F.col("deviation_norm") / F.col("z_norm")), {"_ratio": "ratio"}).drop("_ratio")


def bin_count(n: int) -> int:
    return max(1, int(n * BIN_SHARE))


def edge_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bins for looking up: edges below x, less one; so the minimum lies in bin -1."""
    return F.ceil(F.try_divide(x - lo, hi - lo) * bins).cast("int") - 1


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bins for counting: equal widths, the last one closed."""
    return F.least(F.lit(bins - 1), F.floor(F.try_divide(x - lo, hi - lo) * bins).cast("int"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(x_bin, y_bin, n) over equal-width bins of both ranges."""
    m = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    at = df.crossJoin(F.broadcast(m)).select(histogram_bin(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("x_bin"), histogram_bin(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("y_bin"))
    return at.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(hist: DataFrame, bins: int, sigma: float) -> DataFrame:
    """(x_bin, y_bin, density): the histogram under a Gaussian, mirrored at its borders.

    Each count is sent to the bins in its reach, one axis after the other; partial
    sums keep the exchange at the size of the histogram.
    """
    kernel = gaussian_weights(sigma)
    r = len(kernel) // 2
    out = hist.withColumn("density", F.col("n").cast("double"))
    # a source bin reaches a target by itself and by its mirror images
    reach = F.array(*(F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel)))
    for axis, other in (("x_bin", "y_bin"), ("y_bin", "x_bin")):
        images = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-(r // bins) - 1), F.lit(r // bins + 1)), lambda q: F.array(2 * bins * q + F.col(axis), 2 * bins * q - 1 - F.col(axis)))))
        sent = out.select(other, F.explode(images).alias("_i"), "density").select(other, "_i", F.explode(reach).alias("_k"), "density")
        out = sent.select(other, (F.col("_i") + F.col("_k.d")).cast("int").alias(axis), (F.col("density") * F.col("_k.w")).alias("density")).where((F.col(axis) >= 0) & (F.col(axis) < bins)).groupBy("x_bin", "y_bin").agg(F.sum("density").alias("density"))
    return out


def density_lookup(df: DataFrame, smoothed: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Adds density: the smoothed count at each row's bin, 0 outside."""
    m = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    at = df.crossJoin(F.broadcast(m)).withColumns({"x_bin": edge_bin(F.col(x), F.col("_x0"), F.col("_x1"), bins), "y_bin": edge_bin(F.col(y), F.col("_y0"), F.col("_y1"), bins)}).drop("_x0", "_x1", "_y0", "_y1")
    return at.join(smoothed, ["x_bin", "y_bin"], "left").na.fill(0.0, ["density"])


def otsu(df: DataFrame, value: str, bins: int = OTSU_BINS) -> DataFrame:
    """(threshold): the bin centre that maximises the between-class variance.

    Rows are reduced to a histogram of the given size; windows run over that.
    """
    m = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    h = df.crossJoin(F.broadcast(m)).where("hi > lo").groupBy("lo", "hi", histogram_bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    up = Window.partitionBy("lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lo", "hi")
    s = h.select("bin", "centre", F.sum("n").over(up).alias("n1"), F.sum(F.col("n") * F.col("centre")).over(up).alias("s1"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("centre")).over(whole).alias("s"))
    n2 = F.col("n") - F.col("n1")
    s = s.where(n2 > 0).withColumn("between", F.col("n1").cast("double") * n2 * F.pow(F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / n2, 2))
    return s.orderBy(F.desc("between"), "bin").limit(1).select(F.col("centre").alias("threshold"))


def ratio_filter(df: DataFrame, ratio: str, passed: Column) -> DataFrame:
    """Adds low_ratio: under Otsu's threshold of the passed rows below their 90th percentile."""
    kept = df.where(passed)
    cut = kept.agg(F.percentile(ratio, F.lit(CUT_SHARE)).alias("_cut"))
    t = otsu(kept.crossJoin(F.broadcast(cut)).where(F.col(ratio) < F.col("_cut")), ratio)
    return df.join(F.broadcast(t), F.lit(True), "left").withColumn("low_ratio", F.coalesce(F.col(ratio) < F.col("threshold"), F.lit(False))).drop("threshold")


def glcm_features(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Energy, homogeneity and entropy of each patch's symmetric co-occurrence of grey levels.

    pairs holds the levels of neighbouring pixels. Both orders are counted, so a
    pair of equal levels counts twice.
    """
    both = pairs.select(key, F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))).alias("p"))
    n = both.groupBy(key, "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return p.groupBy(key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("energy"), F.sum(F.col("q") / (1 + F.pow(F.col("a") - F.col("b"), 2))).alias("homogeneity"), (-F.sum(F.col("q") * F.log2("q"))).alias("entropy"))


def patch_texture(tiles: DataFrame, levels: int = GREY_LEVELS, size: int = PATCH) -> DataFrame:
    """GLCM features and the Laplacian's variance from (grid_row, grid_col, rgb BINARY) tiles."""

    def run(frames):
        for f in frames:
            rows = []
            for r, c, rgb in zip(f["grid_row"], f["grid_col"], f["rgb"], strict=True):
                x = np.frombuffer(rgb, np.uint8).reshape(size, size, 3).astype(float)
                grey = x @ (0.2125, 0.7154, 0.0721)
                q = np.minimum(levels - 1, (grey * levels / 256).astype(int))
                m = np.zeros((levels, levels))
                np.add.at(m, (q[:, :-1], q[:, 1:]), 1)
                m = (m + m.T) / (2 * size * (size - 1))
                i, j = np.indices(m.shape)
                nz = m[m > 0]
                pad = np.pad(grey, 1, mode="reflect")
                lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * grey
                rows.append((r, c, *x.reshape(-1, 3).mean(0), math.sqrt((m * m).sum()), (m / (1 + (i - j) ** 2)).sum(), -(nz * np.log2(nz)).sum(), lap.var()))
            yield pd.DataFrame(rows, columns=["grid_row", "grid_col", "mean_r", "mean_g", "mean_b", "energy", "homogeneity", "entropy", "sharpness"])

    return tiles.select("grid_row", "grid_col", "rgb").mapInPandas(run, "grid_row long, grid_col long, mean_r double, mean_g double, mean_b double, energy double, homogeneity double, entropy double, sharpness double")


def group_means(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("size"))


def lowest_groups(means: DataFrame, label: str, score: Column, n: int = 2) -> DataFrame:
    """The n groups of the lowest score; ties go to the smaller label."""
    return means.withColumn("score", score).orderBy("score", label).limit(n)


def texture_rescue(textures: DataFrame, low: DataFrame) -> DataFrame:
    """(grid_row, grid_col) of low-density cells that their texture shows to be tissue.

    low: the low-density cells. Off-colour cells aren't looked at; of three texture
    groups the two with the lowest energy + homogeneity - entropy are tissue.
    """
    seen = textures.join(low.select("grid_row", "grid_col"), ["grid_row", "grid_col"], "left_semi").where(~rejected_colour(F.col("mean_r"), F.col("mean_g"), F.col("mean_b")))
    names = ["homogeneity", "energy", "entropy"]
    seen = written(seen, "low-textures")
    if seen.limit(GROUPS).count() < GROUPS:  # too few to tell groups apart
        return seen.limit(0).select("grid_row", "grid_col")
    scaled = min_max(seen, {c: f"{c}_norm" for c in names}).drop(*names)
    labelled = written(mixture(scaled, [f"{c}_norm" for c in names], GROUPS), "texture")
    keep = lowest_groups(group_means(labelled, "label", [f"{c}_norm" for c in names]), "label", F.col("energy_norm") + F.col("homogeneity_norm") - F.col("entropy_norm"))
    return labelled.join(F.broadcast(keep.select("label")), "label", "left_semi").select("grid_row", "grid_col")


def connected_components(cells: DataFrame) -> DataFrame:
    """Adds component: the smallest (row, col) code among 8-connected cells.

    Runs of a row are found by a window first, so that the graph has a vertex for
    each run; labels then spread along touching runs, with a jump to the label's
    own label, until nothing changes. Each round is written out. Joins are by shuffle:
    both sides grow with the cells, and broadcasts would send labels through the
    driver in every round. Where one label may have most rows, these aren't sorted.
    """
    at = cells.select("grid_row", "grid_col").distinct()
    w = Window.partitionBy("grid_row").orderBy("grid_col")
    runs = at.withColumn("run", F.col("grid_col") - F.row_number().over(w)).withColumn("start", F.min("grid_col").over(Window.partitionBy("grid_row", "run")))
    runs = written(runs.drop("run"), "runs")
    code = lambda r, c: F.col(r) * (1 << 31) + F.col(c)
    own = runs.select("grid_row", "grid_col", code("grid_row", "start").alias("v"))
    around = own.select((F.col("grid_row") + 1).alias("grid_row"), F.explode(F.array(F.col("grid_col") - 1, F.col("grid_col"), F.col("grid_col") + 1)).alias("grid_col"), F.col("v").alias("u"))
    touch = own.join(around.hint("merge"), ["grid_row", "grid_col"]).select("v", "u").distinct()
    edges = written(touch.unionByName(touch.select(F.col("u").alias("v"), F.col("v").alias("u"))), "run-edges")
    labels = written(own.select("v", F.col("v").alias("label")).distinct(), "run-labels")
    while True:
        heard = edges.join(labels.hint("merge"), "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("heard"))
        one = labels.join(heard.hint("merge"), "v", "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("one"))
        two = labels.select(F.col("v").alias("one"), F.col("label").alias("two"))
        new = written(one.join(two.hint("shuffle_hash"), "one").select("v", "was", F.least("one", "two").alias("label")), "run-labels")
        if not new.where("was <> label").take(1):
            break
        labels = new.select("v", "label")
    labelled = own.join(labels.hint("merge"), "v").select("grid_row", "grid_col", F.col("label").alias("component"))
    return cells.join(labelled.hint("merge"), ["grid_row", "grid_col"])


def without_small(cells: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """Cells of components of at least the given number of cells."""
    found = written(connected_components(cells), "components")
    big = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("component")
    return found.join(big.hint("shuffle_hash"), "component", "left_semi")


def tissue_mask(tiles: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """(grid_row, grid_col) of tissue cells of one image, from its RGB tiles.

    Low density (unless its texture says tissue) and low ratio are taken out, and
    then small components.
    """
    def stats(frames):
        for f in frames:
            x = [np.frombuffer(b, np.uint8).reshape(-1, 3).astype(float) for b in f["rgb"]]
            m = np.array([a.mean(0) for a in x]).reshape(-1, 3)
            yield pd.DataFrame({"grid_row": f["grid_row"], "grid_col": f["grid_col"], "mean_r": m[:, 0], "mean_g": m[:, 1], "mean_b": m[:, 2], "deviation": [a.std() for a in x]})

    patches = tiles.select("grid_row", "grid_col", "rgb").mapInPandas(stats, "grid_row long, grid_col long, mean_r double, mean_g double, mean_b double, deviation double")
    p = written(deviation_ratio(variance_weighted_mean(written(patches, "patches"), ["mean_r", "mean_g", "mean_b"])), "ratios")
    bins = bin_count(p.count())
    smoothed = smooth(histogram2d(p, "z", "deviation", bins), bins, max(1, int(bins * SIGMA_SHARE)))
    dense = written(density_lookup(p, smoothed, "z", "deviation", bins), "densities")
    low = dense.where(F.col("density") < DENSITY)
    rescued = texture_rescue(patch_texture(tiles), low).withColumn("_saved", F.lit(True))
    marked = dense.join(rescued, ["grid_row", "grid_col"], "left").withColumn("low_density", (F.col("density") < DENSITY) & F.col("_saved").isNull())
    final = ratio_filter(marked, "ratio", ~F.col("low_density")).where(~(F.col("low_density") | F.col("low_ratio")))
    return without_small(final.select("grid_row", "grid_col"), min_size).select("grid_row", "grid_col")


def majority_mask(cells: DataFrame, flag: str, factor: int) -> DataFrame:
    """Coarse cells more than half of whose cells have the flag."""
    at = cells.groupBy(F.floor(F.col("grid_row") / factor).alias("grid_row"), F.floor(F.col("grid_col") / factor).alias("grid_col"))
    return at.agg((F.avg(F.col(flag).cast("int")) > 0.5).alias(flag))


def neighbour_fill(cells: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """NULL values replaced by the mean of the known cells within radius."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b))
    sent = cells.where(F.col(value).isNotNull()).withColumn("_o", F.explode(around)).select((F.col("grid_row") + F.col("_o.a")).alias("grid_row"), (F.col("grid_col") + F.col("_o.b")).alias("grid_col"), value)
    mean = sent.groupBy("grid_row", "grid_col").agg(F.avg(value).alias("_mean"))
    return cells.join(mean, ["grid_row", "grid_col"], "left").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def kernel(size: int, kind: str = "gaussian") -> list[tuple[int, float]]:
    """(offset, weight) of a filter of the given size: a Gaussian of a quarter of it, out to four deviations, or a uniform one."""
    if kind == "uniform":
        return [(d, 1 / size) for d in range(-(size // 2), size - size // 2)]
    if kind != "gaussian":
        raise ValueError("kind is gaussian or uniform")
    reach = int(np.ceil(size / 4 * 4.0))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / (size / 4)) ** 2)
    return list(zip(range(-reach, reach + 1), map(float, w / w.sum()), strict=True))


def smoothen(cells: DataFrame, value: str, size: int, kind: str = "gaussian", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, grid_row, grid_col, value) smoothed along rows and columns by blocks; edges are mirrored.

    NULL values are filled from their neighbours first, those of wider holes have no
    weight, and all are NULL again in the result.
    """
    return separable(cells, value, kernel(size, kind), keys)


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def erode(cells: DataFrame, radius: int) -> DataFrame:
    """Cells all of whose disk of the given radius is in the mask."""
    disk = disk_offsets(radius)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk))
    votes = cells.select("grid_row", "grid_col").distinct().withColumn("_o", F.explode(around)).select((F.col("grid_row") - F.col("_o.a")).alias("grid_row"), (F.col("grid_col") - F.col("_o.b")).alias("grid_col"))
    return votes.groupBy("grid_row", "grid_col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(disk)).select("grid_row", "grid_col")
