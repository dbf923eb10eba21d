"""Targets made of members (genes or cell types): standardising, weighting, norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import standardised
from .quantiles import quantiles

UPPER_SHARE, NORM_SHARE = 0.9999, 0.9999


def thresholds(counts: DataFrame, gene: str, count: str) -> DataFrame:
    """lo and hi of each gene: its exact 0 and 99.99 percentiles."""
    return counts.groupBy(gene).agg(F.min(count).cast("double").alias("lo"), F.percentile(count, F.lit(UPPER_SHARE)).alias("hi"))


def standardise(counts: DataFrame, gene: str, count: str, limits: DataFrame) -> DataFrame:
    """Adds scaled: the count clipped to its gene's limits, as 0 .. 1."""
    return counts.join(limits, gene).withColumn("scaled", standardised(F.col(count).cast("double"), F.col("lo"), F.col("hi")))


def target_members(targets: DataFrame) -> DataFrame:
    """(target, null_number, member): a row for each member of each target."""
    return targets.select("target", "null_number", F.explode("members").alias("member"))


def weighted_sum(pred: DataFrame, members: DataFrame, keys: Sequence[str], member: str, yhat: str = "yhat", weight: str = "hi") -> DataFrame:
    """Meta-gene prediction: sum of a target's members' yhat times weight, at each key."""
    joined = pred.join(members, pred[member] == members["member"])
    return joined.groupBy("target", *keys).agg(F.sum(F.col(yhat) * F.col(weight)).alias("yhat"))


def running_norm(truth: DataFrame, keys: Sequence[str], roi: str, y: str) -> DataFrame:
    """(keys, roi, norm): running maximum over the ROIs, in order, of the 99.99 percentile of y, at least 1."""
    q = quantiles(truth, [*keys, roi], y, [NORM_SHARE]).withColumnRenamed("quantile", "q")
    w = Window.partitionBy(*keys).orderBy(roi).rowsBetween(Window.unboundedPreceding, 0)
    return q.select(*keys, roi, F.greatest(F.lit(1.0), F.max("q").over(w)).alias("norm"))


def composite(ct: Column, members: Sequence[str]) -> Column:
    """1 where the cell's type is one of members, else 0; NULL types are 0."""
    return F.coalesce(ct.isin(*members), F.lit(False)).cast("int")
