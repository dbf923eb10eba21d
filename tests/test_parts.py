"""Part files as a data source: ranges, push-down, checks and the commit."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.sources import part_source as ps


@pytest.fixture
def parts(tmp_path):
    a = np.arange(23 * 6, dtype=np.float32).reshape(23, 6)
    for k in range(3):
        np.save(tmp_path / f"embeddings_part_{k}.npy", a[k * 10 : k * 10 + 10])
    return str(tmp_path), a


def test_ranges_within_files(spark, parts):
    path, a = parts
    df = ps.read_parts(spark, path, 4, rows_per_range=4)
    assert df.rdd.getNumPartitions() == 3 + 3 + 1
    rows = {r["index"]: r for r in df.collect()}
    assert len(rows) == 23 and all(r["grid_row"] == i // 4 and r["grid_col"] == i % 4 and r["part"] == i // 10 and r["at"] == i % 10 for i, r in rows.items())
    assert all(r["emb_global"] + r["emb_local"] == list(a[i]) for i, r in rows.items())


def test_filters_and_halves_are_pushed_down(spark, parts):
    path, a = parts
    reader = ps.PartReader({"path": path, "width": "4", "rows_per_range": "4"})
    assert list(reader.pushFilters([ps.EqualTo(("part",), 1), ps.GreaterThan(("index",), 13), ps.LessThanOrEqual(("index",), 16), ps.EqualTo(("at",), 3)]))
    assert [(r.part.number, r.lo, r.hi) for r in reader.partitions()] == [(1, 4, 7)]
    got = ps.read_parts(spark, path, 4, halves="local").where("part = 1 AND index > 13 AND index <= 16").collect()
    assert sorted(r["index"] for r in got) == [14, 15, 16] and all(r["emb_global"] is None and r["emb_local"] == list(a[r["index"], 3:]) for r in got)
    assert ps.read_parts(spark, path, 4).where("part IN (0, 2)").count() == 13
    assert ps.read_parts(spark, path, 4).where("part = 9").count() == 0


def test_no_task_reads_beyond_its_range(parts, monkeypatch):
    path, a = parts
    monkeypatch.setattr(ps, "CHUNK", 3)
    reader = ps.PartReader({"path": path, "width": "4", "rows_per_range": "7"})
    first = reader.partitions()[0]
    got = list(reader.read(first))
    assert [b.num_rows for b in got] == [3, 3, 1] and sum((b.column(5).to_pylist() for b in got), []) == a[:7, :3].tolist()


def test_bad_parts_are_told(parts):
    path, a = parts
    os.rename(f"{path}/embeddings_part_1.npy", f"{path}/kept")
    with pytest.raises(ValueError, match="missing"):
        ps.listed(path)
    np.save(f"{path}/embeddings_part_1.npy", a[:10, :4])
    with pytest.raises(ValueError, match="differ"):
        ps.listed(path)
    np.save(f"{path}/embeddings_part_1.npy", a[:9])
    with pytest.raises(ValueError, match="fewer"):
        ps.listed(path)
    with open(f"{path}/kept", "rb") as f, open(f"{path}/embeddings_part_1.npy", "wb") as g:
        g.write(f.read()[:-8])
    with pytest.raises(ValueError, match="header"):
        ps.listed(path)
    assert ps.listed(f"{path}/nowhere") == []


def numbered(spark, a, n):
    return spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(n)], "i long, emb array<double>").repartition(5)


def test_written_parts_are_committed_together(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(57, 8)).astype(np.float32)
    path = str(tmp_path / "out")
    ps.write_parts(numbered(spark, a, 40), path, "i", "emb", 10)
    read = lambda: {r["index"]: r["emb_global"] + r["emb_local"] for r in ps.read_parts(spark, path, 5).collect()}
    assert read() == {i: a[i].tolist() for i in range(40)}
    ps.write_parts(numbered(spark, a, 57), path, "i", "emb", 20)
    assert read() == {i: a[i].tolist() for i in range(57)} and [p.rows for p in ps.listed(path)] == [20, 20, 17]
    # a hole: the commit fails, and the version before stays
    with pytest.raises(Exception, match="out of order|missing|per_part"):
        ps.write_parts(numbered(spark, a, 57).where("i <> 25"), path, "i", "emb", 20)
    broken = numbered(spark, a, 57).withColumn("emb", F.when(F.col("i") == 33, F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("emb")))
    with pytest.raises(Exception, match="lost"):
        ps.write_parts(broken, path, "i", "emb", 20)
    assert read() == {i: a[i].tolist() for i in range(57)}
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == 2  # aborted ones are gone
