"""Scoring a stream of cells against a fixed calibration table.

The batch method's ranks need only the calibration scores of a key, so a stream
of predictions can get its p-values (unadjusted: adjustment needs all tests) by
stream-static joins, without state. Ranks are exact at any size: a key's distinct
scores lie, with their counts, in ranges of one row each, and a cell meets the one
range that its own score falls into. Ranges are cut in two steps, parts of a key and
ranges of a part, so that their size is bounded and not their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clipped_score, confidence
from ..operators.shared import written

#: A key or part of more distinct calibration scores is cut, at CUTS - 1 of its scores: up to CUTS ** 2 ranges a key.
MOST_SCORES = 2_000
CUTS = 500
PLACE = ["score_part", "score_range"]


def _range(bounds: str, value):
    """Number of bounds that value has reached; 0 for a key without bounds."""
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= value)), F.lit(0))


def _bounds(scores: DataFrame, keys: Sequence[str], name: str, most_scores: int) -> DataFrame:
    """(keys, name): where the ranges of each key start. Approximate quantiles only place them; no rank hangs on them."""
    finite = F.when(F.col("score") < float("inf"), F.col("score"))
    cuts = F.percentile_approx(finite, F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), F.lit(20 * CUTS))
    each = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), cuts.alias("_q"))
    return each.select(*keys, F.coalesce(F.when(F.col("_n") > most_scores, F.array_sort(F.array_distinct("_q"))), F.array().cast("array<double>")).alias(name))


def calibration_table(calib: DataFrame, keys: Sequence[str], most_scores: int = MOST_SCORES) -> DataFrame:
    """(keys, score_part, score_range, n, parts, ranges, before, scores): a row for each range of a key's scores.

    scores: the range's distinct scores with their counts, about most_scores at most
    unless a part has more than most_scores * CUTS; before: scores in lower ranges;
    parts, ranges: where a key's parts and a part's ranges start, on their first row alone.
    """
    keys = list(keys)
    c = calib.withColumn("score", clipped_score(F.col("y"), F.col("yhat"), F.col("null_number")).cast("double"))
    distinct = written(c.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("m")), "stream-scores")
    coarse = distinct.join(_bounds(distinct, keys, "parts", most_scores), keys).withColumn("score_part", _range("parts", F.col("score")))
    coarse = written(coarse.drop("parts"), "stream-parts")
    placed = coarse.join(_bounds(coarse, [*keys, "score_part"], "ranges", most_scores), [*keys, "score_part"])
    placed = placed.withColumn("score_range", _range("ranges", F.col("score")))
    rows = placed.groupBy(*keys, *PLACE).agg(F.first("ranges").alias("ranges"), F.sum("m").alias("m"), F.collect_list(F.struct("score", "m")).alias("scores"))
    rows = written(rows, "stream-ranges")
    # running totals are made a part at a time: over a key there is one row a part
    part = Window.partitionBy(*keys, "score_part").orderBy("score_range")
    key = Window.partitionBy(*keys).orderBy("score_part")
    below = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "score_part").agg(F.sum("m").alias("m"))
    sums = sums.select(*keys, "score_part", F.coalesce(F.sum("m").over(key.rowsBetween(*below)), F.lit(0)).alias("_lower"), F.sum("m").over(Window.partitionBy(*keys)).alias("n"), (F.row_number().over(key) == 1).alias("_head"))
    sums = sums.join(_bounds(distinct, keys, "parts", most_scores), keys)
    out = rows.join(sums, [*keys, "score_part"])
    before = F.col("_lower") + F.coalesce(F.sum("m").over(part.rowsBetween(*below)), F.lit(0))
    first = F.row_number().over(part) == 1
    return out.select(*keys, *PLACE, "n", F.when(first & F.col("_head"), F.col("parts")).alias("parts"), F.when(first, F.col("ranges")).alias("ranges"), before.alias("before"), "scores")


def score_stream(stream: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stream with p and confidence; cells of unknown keys and cells without a prediction get p = 1.

    A cell finds its part, its range and its place there by three joins with the table;
    one that finds no range lies below all scores of its key.
    """
    keys = list(keys)
    at = -F.col("yhat").cast("double")
    parts = table.where("parts IS NOT NULL").select(*keys, "n", "parts")
    placed = stream.join(parts, keys, "left").withColumn("score_part", _range("parts", at)).drop("parts")
    ranges = table.where("ranges IS NOT NULL").select(*keys, "score_part", "ranges")
    placed = placed.join(ranges, [*keys, "score_part"], "left").withColumn("score_range", _range("ranges", at)).drop("ranges")
    joined = placed.join(table.select(*keys, *PLACE, "before", "scores"), [*keys, *PLACE], "left")
    less = F.aggregate(F.filter("scores", lambda s: s["score"] < at), F.lit(0).cast("long"), lambda a, s: a + s["m"])
    smaller = F.coalesce("before", F.lit(0)) + F.coalesce(less, F.lit(0))
    p = F.coalesce(F.when(at.isNotNull(), (smaller + 1) / (F.col("n") + 1)), F.lit(1.0))
    scored = joined.withColumn("p", p).withColumn("confidence", confidence(F.col("p")))
    return scored.select(*(c for c in stream.columns if c not in ("p", "confidence")), "p", "confidence")
