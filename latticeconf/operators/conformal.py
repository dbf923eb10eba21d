"""Conformal p-values by stratum, their adjustment and batch-shift tolerance.

All work is by key (target, scale, cluster): no loop over them. Rows are first
reduced to distinct scores, so a window sees one row for each score of a key.
Where a key has very many distinct scores, spread() deals each key's scores to
ranges; windows then run by (key, range) and ranges are put together by prefix
sums over one row a range, so that no key is bound to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import LEVELS, clipped_score, confidence
from .quantiles import by_probability, cumulated, ranges_for, spread, totals
from .shared import written

DIGITS = 9


def _over(keys: Sequence[str], order: Column, down: bool = False):
    w = Window.partitionBy(*keys).orderBy(order.desc() if down else order.asc())
    return w.rangeBetween(Window.unboundedPreceding, Window.currentRow)


def distinct_scores(calib: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score, n_calib, n_test): both sides' counts of every score."""
    both = calib.select(*keys, "score", F.lit(1).alias("_c"), F.lit(0).alias("_t")).unionByName(test.select(*keys, "score", F.lit(0).alias("_c"), F.lit(1).alias("_t")))
    return both.groupBy(*keys, "score").agg(F.sum("_c").alias("n_calib"), F.sum("_t").alias("n_test"))


def rank_and_adjust(scores: DataFrame, keys: Sequence[str], ranges: int = 1) -> DataFrame:
    """(keys, score, p, p_adj) for scores that test rows have.

    p = (1 + calibration scores that are smaller) / (1 + calibration scores);
    p_adj is Benjamini and Hochberg's, within the key: ties take the value at
    their last rank, so a RANGE frame over p is exact.
    """
    keys = list(keys)
    if ranges < 2:
        whole = Window.partitionBy(*keys)
        up = _over(keys, F.col("score"))
        counted = scores.select(*keys, "score", "n_test", F.sum("n_test").over(whole).alias("_m"), F.sum("n_test").over(up).alias("_upto"), ((F.sum("n_calib").over(up) - F.col("n_calib") + 1) / (F.sum("n_calib").over(whole) + 1)).alias("p"))
        # a p shared by several scores has its rank at the last of them
        raw = counted.where("n_test > 0").withColumn("raw", F.col("_m") * F.col("p") / F.max("_upto").over(Window.partitionBy(*keys, "p")))
        return raw.select(*keys, "score", "p", F.least(F.lit(1.0), F.min("raw").over(_over(keys, F.col("p"), down=True))).alias("p_adj"))
    s = spread(scores, keys, "score", ranges)
    own = [*keys, "part"]
    each = s.groupBy(*own).agg(F.sum("n_calib").alias("part_calib"), F.sum("n_test").alias("part_test"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    each = each.select(*own, F.coalesce(F.sum("part_calib").over(before), F.lit(0)).alias("calib_before"), F.coalesce(F.sum("part_test").over(before), F.lit(0)).alias("test_before"), F.sum("part_calib").over(whole).alias("all_calib"), F.sum("part_test").over(whole).alias("all_test"))
    s = s.join(each, own)
    up = _over(own, F.col("score"))
    smaller = F.col("calib_before") + F.sum("n_calib").over(up) - F.col("n_calib")
    ranked = s.withColumn("p", (smaller + 1) / (F.col("all_calib") + 1)).withColumn("upto", F.col("test_before") + F.sum("n_test").over(up)).where("n_test > 0")
    last = ranked.groupBy(*keys, "p").agg(F.max("upto").alias("rank"))
    raw = ranked.join(last, [*keys, "p"]).withColumn("raw", F.col("all_test") * F.col("p") / F.col("rank"))
    low = raw.groupBy(*own).agg(F.min("raw").alias("part_raw"))
    after = Window.partitionBy(*keys).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    low = low.select(*own, F.min("part_raw").over(after).alias("raw_after"))
    inside = F.min("raw").over(_over(own, F.col("p"), down=True))
    return raw.join(low, own).select(*keys, "score", "p", F.least(F.lit(1.0), inside, F.coalesce("raw_after", F.lit(1.0))).alias("p_adj"))


def tolerance(calib: DataFrame, test: DataFrame, keys: Sequence[str], strength: str | float = "medium", ranges: int | None = None) -> DataFrame:
    """(keys, tolerance): minus the largest shift of low test over low calibration predictions.

    calib has yhat and is_null (truth <= null number), test has yhat. Keys of which a
    tenth of the calibration rows or less are null, and keys without test rows,
    get 0. A number as strength is the tolerance itself. ranges: as in cumulated().
    """
    keys = list(keys)
    share = calib.groupBy(*keys).agg(F.avg(F.col("is_null").cast("double")).alias("share"))
    if not isinstance(strength, str):
        return share.select(*keys, F.lit(float(strength)).alias("tolerance"))
    if strength not in LEVELS:
        raise ValueError(f"strength is a number or one of {', '.join(LEVELS)}")
    wide = share.where("share > 0.1")
    # both sides at once; a side's rows up to its own quantile at the share are its first ones
    sided = [*keys, "_side"]
    both = calib.select(*keys, F.lit(0).alias("_side"), F.col("yhat").cast("double").alias("_v")).unionByName(test.select(*keys, F.lit(1).alias("_side"), F.col("yhat").cast("double").alias("_v")))
    values = cumulated(both.join(wide.select(*keys), keys, "left_semi"), sided, "_v", ranges)
    own = by_probability(values, totals(values, sided).join(wide, keys).select(*sided, "total", F.lit(0).alias("place"), F.col("share").alias("prob")), sided)
    low = written(own.select(*sided, F.when(F.col("value_above") <= F.col("quantile"), F.col("upto_above")).otherwise(F.col("upto_below")).alias("total")), "tolerance-sides")
    grid = low.select(*sided, "total", F.posexplode(F.array(*map(F.lit, LEVELS[strength]))).alias("place", "prob"))
    ends = by_probability(values, grid, sided).groupBy(*keys, "place").pivot("_side", [0, 1]).agg(F.first("quantile")).where("`0` IS NOT NULL AND `1` IS NOT NULL")
    shift = ends.groupBy(*keys).agg((-F.max(F.greatest(F.lit(0.0), F.col("1") - F.col("0")))).alias("shift"))
    # rounded, so that equal scores stay equal whatever the order of the interpolation's sums
    return share.join(shift, keys, "left").select(*keys, (F.round(F.coalesce("shift", F.lit(0.0)), DIGITS) + 0.0).alias("tolerance"))


def scored(calib: DataFrame, test: DataFrame, keys: Sequence[str], strength: str | float = 0.0, score: Callable[[Column, Column, Column], Column] = clipped_score, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with their score, calibration rows of unknown keys left out; the tolerance is added to calibration scores."""
    keys = list(keys)
    c, t = F.col("null_number"), F.col("yhat")
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    cal = calib.where(known).withColumn("score", score(F.col("y"), t, c))
    out = test.withColumn("score", score(c, t, c))
    if isinstance(strength, str) or strength:
        tol = tolerance(cal.withColumn("is_null", F.col("y") <= c), test.where(known), keys, strength, ranges)
        cal = cal.join(tol, keys).withColumn("score", F.col("score") + F.col("tolerance")).drop("tolerance")
    return cal, out


def adjusted(calib: DataFrame, test: DataFrame, keys: Sequence[str], strength: str | float = 0.0, score: Callable[[Column, Column, Column], Column] = clipped_score, ranges: int | None = None) -> DataFrame:
    """Test rows with p, p_adj and confidence. ranges: None takes as many as the counted scores ask for.

    calib: keys, y, yhat, null_number; test: keys, yhat, null_number and whatever
    else is to be kept. Rows whose cluster key is NULL keep p = 1. A key without
    calibration rows has p = 1 as well.
    """
    return ranked(*scored(calib, test, keys, strength, score, ranges), keys, ranges)


def ranked(cal: DataFrame, out: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """out with p, p_adj and confidence, its score dropped; cal, out: as scored() gives them."""
    keys = list(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    scores = distinct_scores(cal, out.where(known), keys)
    if ranges is None:
        scores = written(scores, "conformal-scores")
        ranges = ranges_for(scores, keys)
    p = rank_and_adjust(scores, keys, ranges)
    joined = out.join(p, [*keys, "score"], "left").drop("score")
    filled = joined.withColumns({"p": F.coalesce("p", F.lit(1.0)), "p_adj": F.coalesce("p_adj", F.lit(1.0))})
    return filled.withColumn("confidence", confidence(F.col("p_adj")))


def ranked_in_place(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows with p, p_adj and confidence, by windows over rows of both sides (is_calib).

    Every window is over the keys or finer, so rows that are stored by the keys stay
    where they are. For keys whose rows one task can sort.
    """
    keys = list(keys)
    whole, up = Window.partitionBy(*keys), _over(keys, F.col("score"))
    c = F.col("is_calib").cast("long")
    smaller = F.sum(c).over(up) - F.sum(c).over(Window.partitionBy(*keys, "score"))
    p = rows.withColumn("p", (smaller + 1) / (F.sum(c).over(whole) + 1)).where("NOT is_calib")
    raw = p.withColumn("_raw", F.count(F.lit(1)).over(whole) * F.col("p") / F.count(F.lit(1)).over(_over(keys, F.col("p"))))
    out = raw.withColumn("p_adj", F.least(F.lit(1.0), F.min("_raw").over(_over(keys, F.col("p"), down=True))))
    return out.drop("_raw", "score", "is_calib").withColumn("confidence", confidence(F.col("p_adj")))
