"""Column functions of the confidence method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

P_SURE, P_NONE = 0.01, 0.5
#: Quantile levels of the batch-shift tolerance (fixed values).
LEVELS = {
    "weak": (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99),
    "medium": (0.001, 0.005, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 0.995, 0.999),
    "strong": (0.001, 0.005, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 0.995, 0.999),
}


def clipped_score(y: Column, yhat: Column, null_number: Column) -> Column:
    """Nonconformity: -yhat for null truths, else infinite, so that they never count as smaller."""
    return F.when(y <= null_number, -yhat).otherwise(F.lit(float("inf")))


def signed_score(y: Column, yhat: Column, null_number: Column) -> Column:
    """Alternative nonconformity: how far the truth lies above the prediction."""
    return y - yhat


def confidence(p: Column, sure: float = P_SURE, none: float = P_NONE) -> Column:
    """1 for p <= sure, 0 for p >= none, linear in log p between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(F.lit(none) / p) / F.ln(F.lit(none / sure))))


def inside(row: Column, col: Column, rects) -> Column:
    """Whether a cell lies in any of (.., row0, col0, height, width)."""
    tests = [(row >= r) & (row < r + h) & (col >= c) & (col < c + w) for *_, r, c, h, w in rects]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def standardised(x: Column, lo: Column, hi: Column) -> Column:
    """x clipped to [lo, hi] and scaled to 0 .. 1; 0 where lo = hi."""
    return F.when(hi > lo, (F.least(F.greatest(x, lo), hi) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero; what rounds to zero keeps its sign, as in SQL on floating-point numbers."""
    return F.round(F.abs(x), digits) * F.signum(x)


def heat_colour(confidence: Column) -> Column:
    """Black-red-yellow-white ramp as an RGB struct, for confidence maps."""
    ramp = lambda a, b: F.round(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (confidence - a) / (b - a)))).cast("int")
    return F.struct(ramp(0.0, 0.375).alias("r"), ramp(0.375, 0.75).alias("g"), ramp(0.75, 1.0).alias("b"))


def rejected_colour(r: Column, g: Column, b: Column) -> Column:
    """Green, grey (population deviation of the means under 10) or too bright."""
    mean = (r + g + b) / 3
    deviation = F.sqrt((F.pow(r - mean, 2) + F.pow(g - mean, 2) + F.pow(b - mean, 2)) / 3)
    return ((g > r + 20) & (g > b + 20)) | (deviation < 10) | ((r > 230) & (g > 230) & (b > 230))
