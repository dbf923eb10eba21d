"""Spatial cross-fit folds: rectangles, their split by strata, and cell-fold joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BORDER = 16
WIDTHS = (200, 100, 50)
RETAINED = 0.8
FOLD = "roi_idx int, fold_id int, f_top int, f_bottom int, f_left int, f_right int, c_top int, c_bottom int, c_left int, c_right int"


@dataclass(frozen=True)
class Fold:
    """A fold's rectangle, its centre, and which sides of the centre may reach the ROI's edge."""

    top: int
    bottom: int
    left: int
    right: int
    centre: tuple[int, int, int, int]
    free: tuple[bool, bool, bool, bool] = (True, True, True, True)  # left, right, top, bottom

    def row(self, roi: int, k: int) -> tuple:
        return (roi, k, self.top, self.bottom, self.left, self.right, *self.centre)


def whole(top: int, left: int, height: int, width: int) -> Fold:
    """One fold that is its own centre."""
    return Fold(top, top + height, left, left + width, (top, top + height, left, left + width))


def _spans(lo: int, hi: int, width: int, border: int, low_free: bool, high_free: bool):
    """(start, end, centre start, centre end, low free, high free) of one axis, overlapping by two borders."""
    step = width - 2 * border
    if step <= 0:
        raise ValueError("folds must be wider than two borders")
    for start in range(lo, hi, step):
        end = min(start + width, hi)
        low, high = start == lo and low_free, end == hi and high_free
        c0, c1 = start + (0 if low else border), end - (0 if high else border)
        yield start, end, c0, c1, low, high
        if c1 == hi:
            return


def split(fold: Fold, width: int, border: int = BORDER) -> list[Fold]:
    """Overlapping squares of the given width whose centres tile the fold's own centre.

    A centre stays a border away from the fold's sides, save those sides that may
    reach the ROI's edge. Centres without area are left out.
    """
    left, right, top, bottom = fold.free
    if fold.right - fold.left <= border * ((not left) + (not right)) or fold.bottom - fold.top <= border * ((not top) + (not bottom)):
        raise ValueError("the fold is too small for its borders")
    out = []
    for y0, y1, cy0, cy1, t, b in _spans(fold.top, fold.bottom, width, border, top, bottom):
        for x0, x1, cx0, cx1, lf, r in _spans(fold.left, fold.right, width, border, left, right):
            if cx1 > cx0 and cy1 > cy0:
                out.append(Fold(y0, y1, x0, x1, (cy0, cy1, cx0, cx1), (lf, r, t, b)))
    return out


def fold_table(spark, folds: dict[int, Sequence[Fold]]) -> DataFrame:
    return spark.createDataFrame([f.row(roi, k) for roi, some in folds.items() for k, f in enumerate(some)], FOLD)


def _in(kind: str):
    r, c = F.col("grid_row"), F.col("grid_col")
    return (r >= F.col(f"{kind}_top")) & (r < F.col(f"{kind}_bottom")) & (c >= F.col(f"{kind}_left")) & (c < F.col(f"{kind}_right"))


def in_fold():
    """Whether a cell lies in the fold that it is joined to."""
    return _in("f")


def assign(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """Cells with the fold whose centre holds them; folds are few, so this is a broadcast join."""
    return cells.join(F.broadcast(folds), "roi_idx").where(_in("c"))


def training_rows(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """For each fold, the cells that it may be trained on: outside it, or of another ROI."""
    other = folds.withColumnRenamed("roi_idx", "fold_roi")
    return cells.crossJoin(F.broadcast(other)).where((F.col("roi_idx") != F.col("fold_roi")) | ~_in("f"))


def training_sums(cells: DataFrame, folds: DataFrame, y: str) -> DataFrame:
    """(fold_roi, fold_id, n, total) of the cells that each fold may be trained on: all cells' sums less the fold's own."""
    every = cells.agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"))
    own = cells.join(F.broadcast(folds), "roi_idx").where(in_fold()).groupBy("roi_idx", "fold_id").agg(F.count(F.lit(1)).alias("_own_n"), F.sum(y).alias("_own_y"))
    left = folds.select("roi_idx", "fold_id").join(own, ["roi_idx", "fold_id"], "left").na.fill(0, ["_own_n", "_own_y"]).crossJoin(F.broadcast(every))
    return left.select(F.col("roi_idx").alias("fold_roi"), "fold_id", (F.col("_n") - F.col("_own_n")).alias("n"), (F.col("_y") - F.col("_own_y")).alias("total")).where("n > 0")


def retention(cells: DataFrame, folds: DataFrame, stratum: str = "cluster") -> DataFrame:
    """(roi_idx, fold_id, stratum, n_total, n_outside): each stratum's cells of the ROI, and those outside the fold."""
    joined = cells.join(F.broadcast(folds), "roi_idx")
    return joined.groupBy("roi_idx", "fold_id", stratum).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~_in("f")).alias("n_outside"))


def bounding_box(cells: DataFrame, key: str) -> DataFrame:
    """The rectangle around each key's cells, and whether they fill it."""
    box = cells.groupBy(key).agg(*(f(c).alias(n) for c, f, n in (("grid_row", F.min, "top"), ("grid_col", F.min, "left"), ("grid_row", F.max, "bottom"), ("grid_col", F.max, "right"))), F.count(F.lit(1)).alias("n"))
    size = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    return box.select(key, "top", "left", (F.col("bottom") - F.col("top") + 1).alias("height"), (F.col("right") - F.col("left") + 1).alias("width"), (F.col("n") == size).alias("solid"))


def generate(cells: DataFrame, widths: Sequence[int] = WIDTHS, border: int = BORDER, retained: float = RETAINED, stratum: str = "cluster") -> dict[int, list[Fold]]:
    """Folds of each ROI; a fold is split on until it leaves every stratum enough cells.

    Geometry is arithmetic on the driver; the counts of each level are one grouped
    range join for all open folds. cells holds the ROI's tissue: roi_idx,
    grid_row, grid_col and the stratum.
    """
    spark = cells.sparkSession
    boxes = bounding_box(cells, "roi_idx").collect()  # a row a ROI
    opened = {b["roi_idx"]: [whole(b["top"], b["left"], b["height"], b["width"])] for b in boxes}
    done: dict[int, list[Fold]] = {r: [] for r in opened}
    for level in range(len(widths) + 1):
        if level:
            bad = {(r["roi_idx"], r["fold_id"]) for r in retention(cells, fold_table(spark, opened), stratum).where(F.col("n_outside") < retained * F.col("n_total")).select("roi_idx", "fold_id").distinct().collect()}
            for roi, some in opened.items():
                done[roi] += [f for k, f in enumerate(some) if (roi, k) not in bad or level == len(widths)]
                opened[roi] = [f for k, f in enumerate(some) if (roi, k) in bad and level < len(widths)]
        nxt: dict[int, list[Fold]] = {}
        for roi, some in opened.items():
            for f in some:
                try:
                    nxt.setdefault(roi, []).extend(split(f, widths[level], border))
                except ValueError:
                    if not level:
                        raise
                    done[roi].append(f)
        opened = nxt
        if not any(opened.values()):
            break
    return done


def one_per_roi(rects: Sequence[tuple]) -> dict[int, list[Fold]]:
    """A single fold for each rectangle."""
    return {i: [replace(whole(r, c, h, w))] for i, r, c, h, w in rects}
