"""Grid views over the star-schema tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
#: (roi_idx, row0, col0, height, width); the second overlaps the first, and small tables lack the last ones.
ROIS = [(0, 0, 0, 8, 40), (1, 4, 30, 6, 50), (2, 40, 16, 40, 64), (3, 400, 0, 400, 100)]

ROI_SQL = f"roi(roi_idx, row0, col0, height, width) AS (VALUES {', '.join(map(str, ROIS))})"
SPX_SQL = "spx AS (SELECT event_id, event_id // 100 AS grid_row, event_id % 100 AS grid_col, user_id % 15 AS cluster, user_id % 15 <> 14 AS tissue, event_type AS ct, CAST(round(value * 100) AS BIGINT) AS y, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a grid of 100 columns: stratum user_id % 15, truth in whole cents."""
    return as_cells(table(spark, sf_dir, "events"))


def as_cells(e: DataFrame) -> DataFrame:
    cluster = F.col("user_id") % 15
    return e.select("event_id", F.floor(F.col("event_id") / WIDTH).alias("grid_row"), (F.col("event_id") % WIDTH).alias("grid_col"), cluster.alias("cluster"), (cluster != 14).alias("tissue"), F.col("event_type").alias("ct"), F.round(F.col("value") * 100).cast("long").alias("y"), "value")
