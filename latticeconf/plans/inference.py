"""Confidence of all targets at all scales as one plan.

Cells with predictions and truth are pooled by ROI (calibration) and over the
slide (test), each scale from the one before; divided by the norm; and ranked,
adjusted and scored by (target, scale, cluster). A window's stratum is its own
scale's, where a table of strata is given, else the least of its tissue.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conformal import adjusted, scored
from ..operators.grid import RECT, checked_rects, extents, in_rects, roll_up, with_membership
from ..operators.members import running_norm
from ..operators.models import CategoryMeans, Predictor
from ..operators.shared import written
from ..sources.buckets import SideStore

KEYS = ["target", "scale", "cluster"]
AT = ["grid_row", "grid_col"]
SHOWN = ["target", "scale", *AT, "cluster", "y", "null_number", "p", "p_adj", "confidence"]


def _pooled(cells: DataFrame, scales: Sequence[int], keys: Sequence[str], size: DataFrame) -> DataFrame:
    """Windows of every scale: sums of truth and prediction, and the least stratum of their tissue."""
    first = [F.sum("y").alias("y"), F.sum(F.when(F.col("tissue"), F.col("yhat")).otherwise(0)).alias("yhat"), F.bool_or("tissue").alias("tissue"), F.min(F.when(F.col("tissue"), F.col("cluster"))).alias("cluster"), F.bool_or(~F.col("in_roi")).alias("out_roi")]
    merge = [F.sum("y").alias("y"), F.sum("yhat").alias("yhat"), F.bool_or("tissue").alias("tissue"), F.min("cluster").alias("cluster"), F.bool_or("out_roi").alias("out_roi")]
    every = [*keys, "target", "kind", "null_number"]
    rows = cells.join(F.broadcast(size), list(keys)) if keys else cells.crossJoin(F.broadcast(size))
    # the extent travels with the rows, since ROIs have extents of their own
    fenced = roll_up(rows.withColumnsRenamed({"n_rows": "_rows", "n_cols": "_cols"}), scales, [*first, F.first("_rows").alias("_rows"), F.first("_cols").alias("_cols")], [*merge, F.first("_rows").alias("_rows"), F.first("_cols").alias("_cols")], every, ("_rows", "_cols"), lambda df: written(df, "confidence-level"))
    p = reduce(DataFrame.unionByName, [df.withColumn("scale", F.lit(scale)) for scale, df in fenced.items()]).drop("_rows", "_cols")
    # types average predictions over a window but add up truth; expression adds up both
    return p.withColumn("yhat", F.when(F.col("kind") == "type", F.col("yhat") / (F.col("scale") * F.col("scale"))).otherwise(F.col("yhat").cast("double")))


def _with_strata(windows: DataFrame, strata: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Each window's stratum of its own scale; windows that the table lacks have none, and so p = 1."""
    if strata is None:
        return windows
    table = strata.where("roi_idx IS NOT NULL") if keys else strata.where("roi_idx IS NULL")
    on = [*keys, "scale", *AT]
    return windows.drop("cluster").join(table.select(*on, "cluster"), on, "left")


def confidence(cells: DataFrame, rects: Sequence[tuple], folds: DataFrame, scales: Sequence[int], strength: str | float = "medium", ranges: int | None = None, strata: DataFrame | None = None, predictor: Predictor | None = None, everywhere: bool = False, store: str | None = None) -> DataFrame:
    """(target, scale, grid_row, grid_col, cluster, y, null_number, p, p_adj, confidence) of windows that reach outside the ROIs.

    cells: grid_row, grid_col, tissue, cluster, and by target: target, kind,
    null_number, y (whole numbers) and what the predictor knows (the default one
    knows category). strata: (roi_idx, scale, grid_row, grid_col, cluster), of the
    slide where roi_idx is NULL, else of an ROI from its own corner. everywhere:
    also windows off the test mask (without tissue or within ROIs), with p = 1.
    store: a name for both sides stored in buckets ("" for one of its own), which
    other choices of targets can be ranked from later (sources.buckets.SideStore).
    """
    predictor = predictor or CategoryMeans("category", "y")
    in_roi = in_rects(cells, rects)
    known = in_roi.where("tissue")
    if predictor.reads_twice:
        known = written(known, "confidence-known")
    whole_number = F.floor("yhat").alias("yhat")  # sums don't depend on their order then
    fitted, model = predictor.fit(known, folds)
    fitted = fitted.select("roi_idx", "target", *AT, whole_number)
    calib = in_roi.join(fitted, ["roi_idx", "target", *AT], "left").na.fill(0, ["yhat"])
    calib = calib.withColumns({"in_roi": F.lit(True), "grid_row": F.col("grid_row") - F.col("row0"), "grid_col": F.col("grid_col") - F.col("col0")})
    sizes = cells.sparkSession.createDataFrame(checked_rects(rects), RECT).select("roi_idx", F.col("height").alias("n_rows"), F.col("width").alias("n_cols"))
    calib = written(_with_strata(_pooled(calib, scales, ["roi_idx"], sizes).where("tissue"), strata, ["roi_idx"]), "confidence-windows")
    norm = written(running_norm(calib.where("kind = 'expression'"), ["target", "scale"], "roi_idx", "y"), "confidence-norm")
    last = norm.groupBy("target", "scale").agg(F.max("norm").alias("norm"))
    divided = lambda df, by, keys: df.join(by, keys, "left").withColumns({"y": F.col("y") / F.coalesce("norm", F.lit(1.0)), "yhat": F.col("yhat") / F.coalesce("norm", F.lit(1.0))})
    test = model(with_membership(cells, rects)).withColumn("yhat", F.coalesce(F.floor("yhat"), F.lit(0)))
    test = _pooled(test, scales, [], extents(cells))
    on_mask = F.col("tissue") & F.col("out_roi")
    windows = written(test, "confidence-slide") if everywhere else test
    # both are read several times: for shares, quantiles and ranks
    sides = written(divided(calib, norm, ["target", "scale", "roi_idx"]), "confidence-calib"), written(divided(_with_strata(windows.where(on_mask), strata, []), last, ["target", "scale"]), "confidence-test")
    if store is None:
        out = adjusted(*sides, KEYS, strength, ranges=ranges).select(*SHOWN)
    else:
        out = SideStore.save(*scored(*sides, KEYS, strength, ranges=ranges), store).ranks(ranges=ranges).select(*SHOWN)
    if not everywhere:
        return out
    off = divided(_with_strata(windows.where(~on_mask), strata, []), last, ["target", "scale"])
    return out.unionByName(off.withColumns({"p": F.lit(1.0), "p_adj": F.lit(1.0), "confidence": F.lit(0.0)}).select(*SHOWN))
