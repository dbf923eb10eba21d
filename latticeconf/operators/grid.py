"""Cells of a 2-D grid: crops, membership, pooling, pyramids and upsampling.

A cell is a row with grid_row and grid_col; other key columns (slide, scale, ROI)
are passed as keys. A positional scatter or gather is a join on those keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import inside

#: Rectangles up to this number are compared with every cell; more go by tiles.
FEW_RECTS = 256
TILE = 256
RECT = "roi_idx int, row0 int, col0 int, height int, width int"


def to_grid(df: DataFrame, index: str, width: int) -> DataFrame:
    """Row-major linear index to grid_row and grid_col."""
    return df.withColumns({"grid_row": F.floor(F.col(index) / width).cast("long"), "grid_col": (F.col(index) % width).cast("long")})


def checked_rects(rects: Sequence[tuple], bounds: tuple[int, int] | None = None) -> list[tuple]:
    """Rectangles of positive size, and inside (rows, columns) where bounds are given."""
    for i, r, c, h, w in rects:
        if h <= 0 or w <= 0 or r < 0 or c < 0:
            raise ValueError(f"rectangle {i} has no area or starts outside the grid")
        if bounds and (r + h > bounds[0] or c + w > bounds[1]):
            raise ValueError(f"rectangle {i} reaches outside the grid of {bounds[0]} x {bounds[1]} cells")
    return list(rects)


def in_rects(cells: DataFrame, rects: Sequence[tuple]) -> DataFrame:
    """cells joined to each rectangle (RECT's columns) that they lie in; overlaps repeat cells.

    Few rectangles are a broadcast range join. Many are first dealt to tiles of
    the grid, which makes the join an equi-join on tiles.
    """
    table = cells.sparkSession.createDataFrame(checked_rects(rects), RECT)
    r, c = F.col("grid_row"), F.col("grid_col")
    hit = (r >= F.col("row0")) & (r < F.col("row0") + F.col("height")) & (c >= F.col("col0")) & (c < F.col("col0") + F.col("width"))
    if len(rects) <= FEW_RECTS:
        return cells.join(F.broadcast(table), hit)
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(a) + F.col(n) - 1) / TILE)))
    tiled = table.withColumn("_tr", span("row0", "height")).withColumn("_tc", span("col0", "width"))
    return cells.withColumns({"_tr": F.floor(r / TILE), "_tc": F.floor(c / TILE)}).join(tiled, ["_tr", "_tc"]).where(hit).drop("_tr", "_tc")


def crop(cells: DataFrame, rects: Sequence[tuple], bounds: tuple[int, int] | None = None) -> DataFrame:
    """Cells of each rectangle, counted from its own corner."""
    got = in_rects(cells, checked_rects(rects, bounds))
    return got.withColumns({"grid_row": F.col("grid_row") - F.col("row0"), "grid_col": F.col("grid_col") - F.col("col0")})


def with_membership(cells: DataFrame, rects: Sequence[tuple]) -> DataFrame:
    """Adds in_roi: whether the cell lies in any rectangle."""
    if len(rects) <= FEW_RECTS:
        return cells.withColumn("in_roi", inside(F.col("grid_row"), F.col("grid_col"), rects))
    keys = in_rects(cells.select("grid_row", "grid_col"), rects).select("grid_row", "grid_col").distinct().withColumn("_in", F.lit(True))
    return cells.join(keys, ["grid_row", "grid_col"], "left").withColumn("in_roi", F.coalesce("_in", F.lit(False))).drop("_in")


def extents(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and columns (n_rows, n_cols) of each grid."""
    return cells.groupBy(*keys).agg((F.max("grid_row") + 1).alias("n_rows"), (F.max("grid_col") + 1).alias("n_cols"))


def whole_windows(cells: DataFrame, scale: Column, n_rows: Column, n_cols: Column) -> DataFrame:
    """Without cells of windows that the grid's edge cuts."""
    return cells.where((F.col("grid_row") < F.floor(n_rows / scale) * scale) & (F.col("grid_col") < F.floor(n_cols / scale) * scale))


def pool(cells: DataFrame, scale: int | Column, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of windows of scale x scale cells, which tile the grid from (0, 0)."""
    s = F.lit(scale) if isinstance(scale, int) else scale
    if isinstance(scale, int) and scale < 1:
        raise ValueError("a window has at least one cell a side")
    at = cells.withColumns({"grid_row": F.floor(F.col("grid_row") / s).cast("long"), "grid_col": F.floor(F.col("grid_col") / s).cast("long")})
    return at.groupBy(*keys, "grid_row", "grid_col").agg(*aggs)


def pool_strided(cells: DataFrame, size: int, stride: int, n_rows: int | Column, n_cols: int | Column, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of overlapping windows: each cell is sent to the windows that hold it."""
    if not 1 <= stride <= size:
        raise ValueError("stride lies between 1 and the window's size")

    def windows(x: str, n: int | Column) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        first = F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / stride)).cast("long")
        last = F.least(F.floor((n - size) / stride), F.floor(F.col(x) / stride)).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    sent = cells.withColumn("_r", F.explode(windows("grid_row", n_rows))).withColumn("_c", F.explode(windows("grid_col", n_cols)))
    return sent.drop("grid_row", "grid_col").withColumnsRenamed({"_r": "grid_row", "_c": "grid_col"}).groupBy(*keys, "grid_row", "grid_col").agg(*aggs)


def top_n_mean(value: Column, n: int) -> Column:
    """Mean of a window's n largest values; windows are small, so their list is too."""
    best = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, n)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(best))


def roll_up(cells: DataFrame, scales: Sequence[int], aggs: Sequence[Column], merge: Sequence[Column], keys: Sequence[str] = (), limits: tuple[str, str] | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, DataFrame]:
    """pool() at each scale, each from the largest former one that divides it: of n cells, scales 1, 2 and 4 read 2.25 n rows.

    aggs: over cells; merge: the same names over aggs' rows (sums of sums, the least
    of the least). Windows that the grid's edge cuts are left out at each scale.
    limits: columns of cells with the grid's rows and columns, which aggs and merge
    hand on; without, the extents by key are taken from the cells. hold: what is done
    with a level that further ones are made from (written down, so that it is made
    once); without, Spark may share its exchange.
    """
    found: dict[int, DataFrame] = {}
    size = None if limits else extents(cells, keys)
    n_rows, n_cols = map(F.col, limits or ("n_rows", "n_cols"))
    todo = sorted(set(scales))
    for i, scale in enumerate(todo):
        if scale < 1:
            raise ValueError("a window has at least one cell a side")
        below = max((s for s in found if scale % s == 0), default=None)
        step = scale // (below or 1)
        rows = cells if below is None else found[below]
        if size is not None:
            rows = rows.join(F.broadcast(size), list(keys)) if keys else rows.crossJoin(F.broadcast(size))
        whole = rows.where((F.col("grid_row") < F.floor(n_rows / scale) * step) & (F.col("grid_col") < F.floor(n_cols / scale) * step))
        found[scale] = pool(whole if limits else whole.drop("n_rows", "n_cols"), step, aggs if below is None else merge, keys)
        if hold and any(x % scale == 0 for x in todo[i + 1 :]):
            found[scale] = hold(found[scale])
    return found


def pyramid(cells: DataFrame, scales: Sequence[int], aggs: Sequence[Column], keys: Sequence[str] = (), merge: Sequence[Column] | None = None) -> DataFrame:
    """pool() at all scales, as one table with scale.

    With merge by roll_up(), whose steps Spark shares between scales; without (for aggregates
    that don't compose) every cell is sent to every scale.
    """
    if merge is not None:
        levels = [df.withColumn("scale", F.lit(scale)) for scale, df in roll_up(cells, scales, aggs, merge, keys).items()]
        return reduce(DataFrame.unionByName, levels)
    every = cells.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    size = extents(cells, keys)
    joined = every.join(F.broadcast(size), list(keys)) if keys else every.crossJoin(F.broadcast(size))
    return pool(whole_windows(joined, F.col("scale"), F.col("n_rows"), F.col("n_cols")), F.col("scale"), aggs, [*keys, "scale"])


def upsample(coarse: DataFrame, scale: int) -> DataFrame:
    """Every coarse cell as its scale x scale fine cells."""
    offsets = F.sequence(F.lit(0), F.lit(scale - 1))
    fine = coarse.withColumn("_r", F.explode(offsets)).withColumn("_c", F.explode(offsets))
    return fine.withColumns({"grid_row": F.col("grid_row") * scale + F.col("_r"), "grid_col": F.col("grid_col") * scale + F.col("_c")}).drop("_r", "_c")


def scatter(cells: DataFrame, values: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """values at their cells; others get fill, or NULL."""
    return cells.join(values, list(keys), "left").na.fill(fill or {})
