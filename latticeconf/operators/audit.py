"""Realised false discoveries against the nominal rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 99


def discoveries(tested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, level, hits, true_hits): rows by the lowest of the levels 1 .. 99 (hundredths) that admits them."""
    level = F.element_at(F.filter(F.sequence(F.greatest(F.lit(1), F.floor(100 * F.col("p_adj")).cast("int")), F.least(F.lit(LEVELS), F.ceil(100 * F.col("p_adj")).cast("int") + 1)), lambda k: F.col("p_adj") <= k / F.lit(100.0)), 1)
    admitted = tested.where(F.col("p_adj") <= LEVELS / 100).withColumn("level", level)
    return admitted.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("y") > F.col("null_number")).alias("true_hits"))


def fdp_curve(tested: DataFrame, keys: Sequence[str], mask: Column | None = None) -> DataFrame:
    """(keys, fdr, fdp, n_discover) at 0.01 .. 0.99; mask: rows whose truth is known, as cells with a type are for type targets.

    Rows are counted by the lowest level that admits them; a cumulative sum over
    99 rows a key then replaces a product of levels and rows.
    """
    keys = list(keys)
    tested = tested if mask is None else tested.where(mask)
    levels = tested.select(*keys).distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    grown = levels.join(discoveries(tested, keys), [*keys, "level"], "left").na.fill(0, ["hits", "true_hits"])
    grown = grown.withColumns({"n_discover": F.sum("hits").over(w), "n_true": F.sum("true_hits").over(w)})
    fdp = F.when(F.col("n_discover") > 0, 1 - F.col("n_true") / F.col("n_discover")).otherwise(0.0)
    return grown.select(*keys, (F.col("level") / F.lit(100.0)).alias("fdr"), fdp.alias("fdp"), "n_discover")


def fdp_pivot(curve: DataFrame, keys: Sequence[str], scales: Sequence[int]) -> DataFrame:
    """One row a level, with fdp_s and n_discover_s for each scale s."""
    return curve.groupBy(*keys, "fdr").pivot("scale", list(scales)).agg(F.first("fdp").alias("fdp"), F.first("n_discover").alias("n_discover")).select(*keys, "fdr", *(F.col(f"{s}_{c}").alias(f"{c}_{s}") for s in scales for c in ("fdp", "n_discover")))
