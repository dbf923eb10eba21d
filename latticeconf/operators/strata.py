"""Strata of every scale: k-means of a scale's own pooled vectors, fitted once and kept.

A fitted model lies below a root by its scale and number of strata; whoever asks
again gets that one, so that strata of one slide, of its ROIs and of later slides
mean the same. Vectors are pooled by partial sums, models are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import K, SEED, pooled_vectors, stored, stratify


class StrataStore:
    """Models below root, a shared folder, by (scale, k)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def model(self, scale: int, k: int, fit: Callable[[], PipelineModel]) -> PipelineModel:
        return stored(self.spark, f"{self.root}/scale={scale}/k={k}", fit)


def _vectors(pooled: DataFrame) -> DataFrame:
    return pooled.withColumn("_v", array_to_vector("emb"))


def strata(store: StrataStore, slides: DataFrame, rois: DataFrame, emb: str, size: int, scales: Sequence[int], k: int = K, seed: int = SEED) -> DataFrame:
    """(slide_id, roi_idx, scale, grid_row, grid_col, cluster) of all slides' windows (roi_idx NULL) and all ROIs'.

    slides: slide_id, grid_row, grid_col and emb; rois: roi_idx as well, counted
    from the ROI's own corner. Each scale's model is fitted on all slides' windows.
    """
    out = None
    for scale in scales:
        of_slides = pooled_vectors(slides, emb, scale, ["slide_id"])
        model = store.model(scale, k, lambda: stratify(_vectors(of_slides), "_v", size, k, seed)[0])  # noqa: B023
        sides = of_slides.withColumn("roi_idx", F.lit(None).cast("int")), pooled_vectors(rois, emb, scale, ["slide_id", "roi_idx"])
        for side in sides:
            one = model.transform(_vectors(side)).select("slide_id", F.col("roi_idx").cast("int"), F.lit(scale).alias("scale"), "grid_row", "grid_col", F.col("cluster").cast("int"))
            out = one if out is None else out.unionByName(one)
    return out
