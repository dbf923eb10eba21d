"""Exact order statistics of keys of any size.

Values are counted, dealt to ranges, and cumulated within each range on top of the
ranges below it; a wanted rank lies in one range, and only rows of such ranges are
looked at. So no task sorts or holds a whole key: ranges take about TASK_VALUES
distinct values each, and what a key adds is a row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Distinct values of a key that one task sorts; keys of more are dealt to ranges.
TASK_VALUES = 1_000_000


def spread(values: DataFrame, keys: Sequence[str], value: str, ranges: int) -> DataFrame:
    """Adds part: the number of the key's approximate quantiles that lie below the value.

    Equal values share a part, whatever the quantiles' error; only balance hangs on them.
    """
    if ranges < 2:
        return values.withColumn("part", F.lit(0))
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(50 * ranges)).alias("_cuts"))
    return values.join(cuts, list(keys)).withColumn("part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def ranges_for(values: DataFrame, keys: Sequence[str], most: int | None = None) -> int:
    """How many ranges the key of most rows needs, so that a range has about most of them."""
    largest = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    return max(1, -(-largest // (most or TASK_VALUES)))


def cumulated(rows: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """(keys, part, value, n, upto), written: distinct values, how often each occurs, and how many rows lie up to it.

    ranges: None takes as many as the counted values ask for. NULLs are left out.
    """
    keys = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if ranges is None:
        counts = written(counts, "quantile-counts")
        ranges = ranges_for(counts, keys)
    own = [*keys, "part"]
    s = spread(counts, keys, "value", ranges)
    up = Window.partitionBy(*own).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ranges < 2:
        return written(s.select(*own, "value", "n", F.sum("n").over(up).alias("upto")), "quantile-values")
    below = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy(*own).agg(F.sum("n").alias("_n")).select(*own, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    return written(s.join(before, own).select(*own, "value", "n", (F.col("_before") + F.sum("n").over(up)).alias("upto")), "quantile-values")


def totals(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, total) of cumulated()."""
    return values.groupBy(*keys).agg(F.max("upto").alias("total"))


def at_ranks(values: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rank, value, upto) for the wanted (keys, rank), ranks from 0; values: as cumulated() makes them."""
    keys = list(keys)
    own = [*keys, "part"]
    bounds = values.groupBy(*own).agg(F.min(F.col("upto") - F.col("n")).alias("_lo"), F.max("upto").alias("_hi"))
    placed = wanted.distinct().join(bounds, keys).where("rank >= _lo AND rank < _hi").groupBy(*own).agg(F.collect_set("rank").alias("_ranks"))
    own_ranks = F.filter("_ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    return values.join(placed, own).withColumn("rank", F.explode(own_ranks)).select(*keys, "rank", "value", "upto")


def interpolated_rank(share: Column, n: Column) -> tuple[Column, Column]:
    """0-based rank below the quantile of a sorted sample of n, and the weight of the next one."""
    h = (n - 1) * share
    return F.floor(h), h - F.floor(h)


def _between(low: Column, high: Column, weight: Column) -> Column:
    return low.cast("double") + (high.cast("double") - low.cast("double")) * weight


def by_probability(values: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, place, quantile, value_below, upto_below, value_above, upto_above) for the wanted (keys, place, prob, total).

    The quantile among the key's first `total` rows, between the values at two ranks.
    """
    keys = list(keys)
    low, weight = interpolated_rank(F.col("prob"), F.col("total"))
    asked = wanted.select(*keys, "place", low.alias("_low"), F.least(low + 1, F.col("total") - 1).alias("_high"), weight.alias("_weight"))
    found = at_ranks(values, asked.select(*keys, F.explode(F.array("_low", "_high")).alias("rank")), keys)
    for name, rank in (("below", "_low"), ("above", "_high")):
        asked = asked.join(found.select(*keys, F.col("rank").alias(rank), F.col("value").alias(f"value_{name}"), F.col("upto").alias(f"upto_{name}")), [*keys, rank])
    return asked.select(*keys, "place", _between(F.col("value_below"), F.col("value_above"), F.col("_weight")).alias("quantile"), "value_below", "upto_below", "value_above", "upto_above")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] | Column, ranges: int | None = None) -> DataFrame:
    """(keys, place, quantile): exact, with linear interpolation.

    probabilities: the same for all keys, or an array column, constant within a key.
    """
    keys = list(keys)
    if not isinstance(probabilities, Column):
        values = cumulated(rows, keys, value, ranges)
        asked = totals(values, keys).withColumn("_p", F.array(*map(F.lit, probabilities)))
    else:
        own = rows.groupBy(*keys).agg(F.first(probabilities).alias("_p"))
        values = cumulated(rows, keys, value, ranges)
        asked = totals(values, keys).join(own, keys)
    wanted = asked.select(*keys, "total", F.posexplode("_p").alias("place", "prob"))
    return by_probability(values, wanted, keys).select(*keys, "place", "quantile")
