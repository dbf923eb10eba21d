"""Committed results and map tiles."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.functions.scores import heat_colour
from latticeconf.sources import results


def cells(spark, n=20, shift=0.0):
    c = spark.range(n * n).select((F.col("id") / n).cast("long").alias("grid_row"), (F.col("id") % n).alias("grid_col"), ((F.col("id") % 11) / 10 + shift).alias("confidence"))
    return c.withColumn("target", F.explode(F.array(F.lit("a"), F.lit("b c")))).withColumn("scale", F.explode(F.array(F.lit(1), F.lit(2))))


def test_a_failed_job_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        results.load(spark, path)
    results.save(cells(spark), path)
    total = lambda: results.load(spark, path).agg(F.count(F.lit(1)), F.round(F.sum("confidence"), 6)).collect()[0]
    before = total()
    bad = cells(spark, shift=1.0).withColumn("confidence", F.when(F.col("grid_row") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("confidence")))
    with pytest.raises(Exception, match="lost"):
        results.save(bad, path)
    assert total() == before and len([x for x in os.listdir(path) if x.startswith("v-")]) == 1
    results.save(cells(spark, shift=1.0), path, keep_former=False)
    assert total()[1] == pytest.approx(before[1] + 1600) and len([x for x in os.listdir(path) if x.startswith("v-")]) == 1


def test_filters_read_their_folders_alone(spark, tmp_path):
    results.save(cells(spark), str(tmp_path / "r"))
    one = results.load(spark, str(tmp_path / "r")).where("target = 'b c' AND scale = 2")
    assert one.count() == 400 and one.select(F.input_file_name()).distinct().count() <= 8
    assert "PartitionFilters: [isnotnull(target" in one._jdf.queryExecution().toString()


def test_tiles_hold_each_cell_s_colour(spark, tmp_path):
    df = cells(spark)
    results.save(results.map_tiles(df, side=8), str(tmp_path / "maps"))
    got = results.load(spark, str(tmp_path / "maps")).where("target = 'a' AND scale = 1").collect()
    assert len(got) == 9 and sum(r["n_cells"] for r in got) == 400
    image = np.full((24, 24, 3), 255, np.uint8)
    for r in got:
        image[r["tile_row"] * 8 : r["tile_row"] * 8 + 8, r["tile_col"] * 8 : r["tile_col"] * 8 + 8] = np.frombuffer(r["rgb"], np.uint8).reshape(8, 8, 3)
    want = {(r["grid_row"], r["grid_col"]): tuple(r["c"]) for r in df.where("target = 'a' AND scale = 1").select("grid_row", "grid_col", heat_colour(F.col("confidence")).alias("c")).collect()}
    assert all(tuple(image[at]) == c for at, c in want.items()) and (image[20:] == 255).all()
