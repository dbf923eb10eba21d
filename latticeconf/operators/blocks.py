"""Neighbourhoods of cells, worked out by square blocks with a border strip of their neighbours.

A cell is sent to the block that it lies in and to those whose border holds it: at
most four, whatever the neighbourhood's size, as a block is no narrower than its
border. A block is one group of bounded size, turned into an array in its task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
_RECT = ["_block_row", "_block_col", "_rows", "_cols"]


def _span(at: str, n: str, size: int, border: int) -> Column:
    """The blocks along an axis whose area, with its border, holds the cell."""
    first = F.greatest(F.lit(0), F.floor((F.col(at) - border) / size))
    last = F.least(F.floor((F.col(n) - 1) / size), F.floor((F.col(at) + border) / size))
    return F.explode(F.sequence(first.cast("long"), last.cast("long")))


def by_blocks(cells: DataFrame, values: Sequence[str], border: int, work: Callable[[np.ndarray, tuple[int, int], tuple[int, int], tuple[int, int]], dict[str, np.ndarray]], out: str, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(keys, grid_row, grid_col, out) of the cells that are there.

    work(area, start, inner, shape): area: the values' arrays (value, row, column) of
    a block with its border, cut at the grid's edge, NaN where there is no value;
    start: where the block begins within it; inner: its own size; shape: the
    grid's. It returns arrays (row, column, ..) of the block's own cells by the names
    in out, a schema.
    Repeated cells: one of them counts.
    """
    keys, block = list(keys), max(block, border, 1)
    size = cells.groupBy(*keys).agg((F.max("grid_row") + 1).alias("_rows"), (F.max("grid_col") + 1).alias("_cols"))
    given = cells.select(*keys, F.col("grid_row").cast("long"), F.col("grid_col").cast("long"), *(F.col(v).cast("double").alias(v) for v in values))
    given = given.join(size, keys) if keys else given.crossJoin(F.broadcast(size))
    sent = given.withColumn("_block_row", _span("grid_row", "_rows", block, border)).withColumn("_block_col", _span("grid_col", "_cols", block, border))
    names = [x.split()[0] for x in out.split(", ")]
    kinds = dict(sent.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "grid_row long", "grid_col long", out])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        block_row, block_col, rows, cols = (int(pdf[c].iloc[0]) for c in _RECT)
        top, left = max(0, block_row * block - border), max(0, block_col * block - border)
        bottom, right = min(rows, (block_row + 1) * block + border), min(cols, (block_col + 1) * block + border)
        start = block_row * block - top, block_col * block - left
        inner = min(rows, (block_row + 1) * block) - block_row * block, min(cols, (block_col + 1) * block) - block_col * block
        area, there = np.full((len(values), bottom - top, right - left), np.nan), np.zeros((bottom - top, right - left), bool)
        r, c = pdf["grid_row"].to_numpy() - top, pdf["grid_col"].to_numpy() - left
        there[r, c] = True
        for k, v in enumerate(values):
            area[k, r, c] = pdf[v].to_numpy(float)
        found = work(area, start, inner, (rows, cols))
        at = np.nonzero(there[start[0] : start[0] + inner[0], start[1] : start[1] + inner[1]])
        made = {k: [pdf[k].iloc[0]] * len(at[0]) for k in keys} | {"grid_row": at[0] + block_row * block, "grid_col": at[1] + block_col * block}
        return pd.DataFrame(made | {n: list(found[n][at]) for n in names})

    return sent.groupBy(*keys, "_block_row", "_block_col").applyInPandas(one, schema)


def _filled(a: np.ndarray) -> np.ndarray:
    """NaN as the mean of the known cells around, where there are any."""
    wide, known = np.pad(a, 1, constant_values=np.nan), ~np.isnan(a)
    total, n = np.zeros_like(a), np.zeros_like(a)
    for i in range(3):
        for j in range(3):
            near = wide[i : i + a.shape[0], j : j + a.shape[1]]
            total += np.nan_to_num(near)
            n += ~np.isnan(near)
    return np.where(known | (n == 0), a, total / np.maximum(n, 1))


def separable(cells: DataFrame, value: str, taps: Sequence[tuple[int, float]], keys: Sequence[str] = (), fill: bool = True, block: int = BLOCK) -> DataFrame:
    """(keys, grid_row, grid_col, value) filtered along rows and columns; the edges mirror the grid as often as the filter needs.

    Cells without a value are filled from their neighbours first (fill); what is still
    unknown has no weight, so a constant field stays constant around any hole.
    Cells without a value have none in the result either.
    """
    reach = max(abs(d) for d, _ in taps)

    def along(a: np.ndarray, axis: int, n: int) -> np.ndarray:
        out = np.zeros([n if i == axis else s for i, s in enumerate(a.shape)])
        for d, w in taps:
            out += w * np.take(a, range(reach + d, reach + d + n), axis=axis)
        return out

    def work(area, start, inner, shape):
        a, lo, hi = area[0], [], []
        own = a[start[0] : start[0] + inner[0], start[1] : start[1] + inner[1]]
        a = _filled(a) if fill else a
        for axis in (0, 1):  # what the border holds beyond the filter's reach goes, what it lacks at the grid's edge is mirrored
            before, after = start[axis], a.shape[axis] - start[axis] - inner[axis]
            a = np.take(a, range(before - min(before, reach), a.shape[axis] - (after - min(after, reach))), axis=axis)
            lo.append(reach - min(before, reach))
            hi.append(reach - min(after, reach))
        a = np.pad(a, list(zip(lo, hi, strict=True)), mode="symmetric")
        known = ~np.isnan(a)
        total = along(along(np.where(known, a, 0.0), 0, inner[0]), 1, inner[1])
        weight = along(along(known.astype(float), 0, inner[0]), 1, inner[1])
        smooth = total if known.all() else total / np.where(weight > 0, weight, np.nan)
        return {value: np.where(np.isnan(own), np.nan, smooth)}

    made = by_blocks(cells, [value], reach + fill, work, f"{value} double", keys, block)
    return made.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def context(cells: DataFrame, value: str, radius: int, keys: Sequence[str] = (), beyond: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(keys, grid_row, grid_col, patch): the (2 radius + 1)^2 values around each cell, row by row; beyond stands for cells that aren't there."""
    side = 2 * radius + 1

    def work(area, start, inner, shape):
        a = np.where(np.isnan(area[0]), beyond, area[0])
        pads = [(radius - start[k], radius - (a.shape[k] - start[k] - inner[k])) for k in (0, 1)]
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, pads, constant_values=beyond), (side, side))
        return {"patch": wide.reshape(*wide.shape[:2], side * side)}

    return by_blocks(cells, [value], radius, work, "patch array<double>", keys, block)


def rescale(cells: DataFrame, value: str, factor: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, grid_row, grid_col, value) of the grid at factor times its size, sampled bilinearly; the grid is whole.

    Each cell makes the target cells whose place falls on it or up to the next one;
    these ask four cells for their values: one equi-join, weights by arithmetic.
    """
    keys = list(keys)
    size = cells.groupBy(*keys).agg((F.max("grid_row") + 1).alias("_grid_row"), (F.max("grid_col") + 1).alias("_grid_col"))
    at = cells.select(*keys, "grid_row", "grid_col")
    at = at.join(size, keys) if keys else at.crossJoin(F.broadcast(size))
    asks = []
    for axis in ("grid_row", "grid_col"):
        r, n = F.col(axis), F.col(f"_{axis}")
        most = F.greatest(F.lit(1), F.bround(n * factor)) - 1
        first = F.when(r == 0, F.lit(0)).otherwise(F.ceil((r + 0.5) * factor - 0.5))
        last = F.when(r == n - 1, most).otherwise(F.least(most, F.ceil((r + 1.5) * factor - 0.5) - 1))
        place = lambda x, n=n: F.least(F.greatest((x + 0.5) / factor - 0.5, F.lit(0.0)), n - 1.0)
        at = at.withColumn(f"_to_{axis}", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
        w = place(F.col(f"_to_{axis}")) - r
        asks.append(F.array(F.struct(r.cast("long").alias("at"), (1 - w).alias("w")), F.struct(F.least(r + 1, n - 1).cast("long").alias("at"), w.alias("w"))))
    to = [F.col(f"_to_{a}") for a in ("grid_row", "grid_col")]
    asked = at.select(*keys, *to, F.explode(asks[0]).alias("a"), asks[1].alias("_b")).select(*keys, *to, "a", F.explode("_b").alias("b"))
    asked = asked.select(*keys, *to, F.col("a.at").alias("grid_row"), F.col("b.at").alias("grid_col"), (F.col("a.w") * F.col("b.w")).alias("_w")).where("_w <> 0")
    found = asked.join(cells.select(*keys, "grid_row", "grid_col", F.col(value).cast("double").alias("_v")), [*keys, "grid_row", "grid_col"])
    return found.groupBy(*keys, F.col("_to_grid_row").alias("grid_row"), F.col("_to_grid_col").alias("grid_col")).agg(F.sum(F.col("_w") * F.col("_v")).alias(value))
