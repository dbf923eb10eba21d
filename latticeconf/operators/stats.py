"""Small statistics by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_over_domain(df: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """(key, n) for every key of the domain, zeros kept."""
    return domain.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").na.fill(0, ["n"])


def mode_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("best")).select(*keys, F.col(f"best.{value}").alias("mode"), (-F.col("best.m")).alias("n"))


def rank_by_frequency(df: DataFrame, label: str, descending: bool = True) -> DataFrame:
    """(label, n, rank) with ranks from 0; ties in order of label. Labels are few: a window over their counts."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n") if descending else F.asc("n"), label)
    return n.withColumn("rank", F.row_number().over(w) - 1)


def quadratic_fit(df: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """Least squares a + b x + c x^2 from nine sums."""
    import numpy as np

    s = df.agg(*(F.sum(F.pow(x, F.lit(float(k)))).alias(f"x{k}") for k in range(5)), *(F.sum(F.col(y) * F.pow(x, F.lit(float(k)))).alias(f"y{k}") for k in range(3))).collect()[0]
    a, b, c = np.linalg.solve([[s[f"x{i + j}"] for j in range(3)] for i in range(3)], [s[f"y{i}"] for i in range(3)])
    return float(a), float(b), float(c)
