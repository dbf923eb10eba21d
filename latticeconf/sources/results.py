"""Results and maps of any size, written by executors and committed together.

A version is a folder of Parquet, partitioned by (target, scale), under a name of its
own; it counts once its name is in place, which one rename does. A lost task is
repeated by Spark, a failed job's folder is removed, and readers see the version
before throughout. The driver handles names, never cells.

Maps are tiles of SIDE x SIDE cells as raw RGB bytes: each tile is a group of bounded
size that a task turns into an array; cells that aren't there are white.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import heat_colour
from .part_source import located, opened

KEYS = ["target", "scale"]
SIDE = 256
_CURRENT = "_current"


def _version(path: str) -> str | None:
    system, root = opened(path)
    if system.get_file_info(f"{root}/{_CURRENT}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{root}/{_CURRENT}") as f:
        return json.loads(f.read())["version"]


def save(results: DataFrame, path: str, keep_former: bool = True) -> str:
    """Writes and commits a version; returns its name. keep_former: readers that have begun on the version before can end."""
    path = located(results.sparkSession, path)
    (system, root), name, former = opened(path), f"v-{uuid.uuid4().hex}", _version(path)
    try:
        results.repartition(*KEYS, F.pmod(F.xxhash64(*[c for c in results.columns if c not in KEYS]), F.lit(8))).write.partitionBy(*KEYS).parquet(f"{path.rstrip('/')}/{name}")
    except Exception:
        if system.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{name}")
        raise
    aside = f"{root}/_{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(json.dumps({"version": name}).encode())
    system.move(aside, f"{root}/{_CURRENT}")
    if former and not keep_former:
        system.delete_dir(f"{root}/{former}")
    return name


def load(spark: SparkSession, path: str) -> DataFrame:
    """The committed version; a filter on target and scale reads their folders alone."""
    path = located(spark, path)
    if (name := _version(path)) is None:
        raise FileNotFoundError(f"nothing has been committed in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def map_tiles(cells: DataFrame, confidence: str = "confidence", side: int = SIDE) -> DataFrame:
    """(target, scale, tile_row, tile_col, side, n_cells, rgb) of target, scale, grid_row, grid_col and a confidence."""
    at = cells.select(*KEYS, F.floor(F.col("grid_row") / side).cast("long").alias("tile_row"), F.floor(F.col("grid_col") / side).cast("long").alias("tile_col"), (F.col("grid_row") % side).cast("int").alias("_r"), (F.col("grid_col") % side).cast("int").alias("_c"), heat_colour(F.col(confidence)).alias("_rgb"))
    at = at.select(*KEYS, "tile_row", "tile_col", "_r", "_c", *(F.col(f"_rgb.{x}").alias(f"_{x}") for x in ("r", "g", "b"))).toDF(*KEYS, "tile_row", "tile_col", "row", "col", "red", "green", "blue")
    kinds = dict(at.dtypes)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.full((side, side, 3), 255, np.uint8)
        image[pdf["row"], pdf["col"]] = pdf[["red", "green", "blue"]].to_numpy()
        head = {k: [pdf[k].iloc[0]] for k in [*KEYS, "tile_row", "tile_col"]}
        return pd.DataFrame(head | {"side": [side], "n_cells": [len(pdf)], "rgb": [image.tobytes()]})

    return at.groupBy(*KEYS, "tile_row", "tile_col").applyInPandas(tile, f"target {kinds['target']}, scale {kinds['scale']}, tile_row long, tile_col long, side int, n_cells long, rgb binary")
