"""Readers and writers: round trips and the formats' rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.operators import conformal, tissue
from latticeconf.sources import files
from latticeconf.streaming import scoring


def test_png_round_trip():
    a = np.random.default_rng(0).integers(0, 256, (17, 23, 3), dtype=np.uint8)
    assert np.array_equal(files.decode_png(files.encode_png(a)), a)
    assert np.array_equal(files.decode_png(files.encode_png(a[..., 0]))[..., 0], a[..., 0])
    with pytest.raises(ValueError):
        files.decode_png(b"GIF89a")


def test_tiles_and_masks(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (40, 50, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(files.encode_png(a))
    tiles = files.read_tiles(spark, f"{tmp_path}/a.png")
    assert tiles.count() == 14 * 14  # padded to 224 x 224
    first = tiles.where("grid_row = 0 AND grid_col = 0").collect()[0]["rgb"]
    assert np.array_equal(np.frombuffer(first, np.uint8).reshape(16, 16, 3), a[:16, :16])
    m = files.read_mask(spark, f"{tmp_path}/a.png")
    assert m.count() == 2000
    texture = tissue.patch_texture(tiles).where("grid_row = 13").collect()[0]
    assert texture["energy"] == pytest.approx(1.0) and texture["entropy"] == pytest.approx(0.0) and texture["sharpness"] == 0


def test_npy_parts(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(20, 3)
    for k in range(2):
        np.save(tmp_path / f"embeddings_part_{k}.npy", a[k * 10 : k * 10 + 10])
    got = files.embedding_parts(spark, f"{tmp_path}/*.npy", 10, 4)
    rows = {(r["grid_row"], r["grid_col"]): r["emb"] for r in got.collect()}
    assert len(rows) == 20 and rows[3, 1] == list(a[13])


def test_roi_discovery(spark, tmp_path):
    for i in (0, 3):
        np.save(tmp_path / f"embeddings_roi_{i}_scale_2.npy", np.zeros((1, 1)))
    assert [r[0] for r in files.roi_indices(spark, str(tmp_path)).collect()] == [0, 3]


def test_targets(spark, tmp_path):
    groups = {"gene": {"0.05": [{"genes": ["A"]}, {"genes": ["A", "B"], "name": "pair"}]}, "cell_type": {"0": [{"cell_types": ["T"], "name": "t"}]}}
    (tmp_path / "t.json").write_text(json.dumps(groups, indent=2))
    got = sorted(map(tuple, files.read_targets(spark, f"{tmp_path}/t.json").select("kind", "target", F.size("members"), "null_number").collect()))
    assert got == [("cell_type", "t", 1, 0.0), ("gene", "A", 1, 0.05), ("gene", "pair", 2, 0.05)]
    (tmp_path / "bad.json").write_text(json.dumps({"gene": {"0": [{"genes": ["A", "B"]}]}}))
    with pytest.raises(Exception, match="needs a name"):
        files.read_targets(spark, f"{tmp_path}/bad.json").collect()


def test_config():
    got = files.read_config("[roi]\nroi_top_left = 1,2; 3,4\nroi_width = 10 20\n[scale]\nscales = 1 2 4\n")
    assert got["roi"]["roi_top_left"] == [(1, 2), (3, 4)] and got["roi"]["roi_width"] == [10, 20] and got["scale"]["scales"] == [1, 2, 4]


def test_result_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", 1, 0, 0, 0.2, 0.4), ("a", 2, 0, 1, 0.01, 1.0)], "target string, scale int, grid_row long, grid_col long, p_adj double, confidence double")
    files.write_results(r, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/target=a/scale=2").count() == 1
    image = files.decode_png(files.confidence_png(r.where("scale = 2"), 1, 2))
    assert tuple(image[0, 1]) == (255, 255, 255) and tuple(image[0, 0]) == (128, 128, 128)
    assert files.existing(spark, f"{tmp_path}/nothing", "a int") is None


def test_stream_scores_like_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    cal = spark.createDataFrame([(int(k), float(y), float(h), 0.0) for k, y, h in zip(rng.integers(0, 2, 80), rng.integers(0, 2, 80), rng.normal(0, 1, 80), strict=True)], "k int, y double, yhat double, null_number double")
    tes = spark.createDataFrame([(i, int(k), float(h), 0.0) for i, (k, h) in enumerate(zip(rng.integers(0, 3, 50), rng.normal(0, 1, 50), strict=True))], "i int, k int, yhat double, null_number double")
    tes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(tes.schema).parquet(f"{tmp_path}/in")
    q = scoring.score_stream(stream, scoring.calibration_table(cal, ["k"]), ["k"]).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = {r["i"]: r["p"] for r in conformal.adjusted(cal, tes, ["k"]).collect()}
    assert {r["i"]: r["p"] for r in spark.table("scored").collect()} == pytest.approx(batch)


@pytest.mark.parametrize("most_scores", [scoring.MOST_SCORES, 3])
def test_large_keys_are_ranked_exactly(spark, most_scores):
    """More scores than MOST_SCORES, or than parts hold, with ties, infinite scores alone, a small key and NULL predictions."""
    rng = np.random.default_rng(5)
    few = 3 * scoring.MOST_SCORES
    k = np.concatenate([np.zeros(few, int), np.ones(40, int), np.full(few, 2)])
    y = np.where(k == 2, 1, rng.random(len(k)) < 0.4).astype(float)
    h = np.where(rng.random(len(k)) < 0.2, 0.25, rng.normal(0, 1, len(k)))
    cal = spark.createDataFrame([(int(a), float(b), float(c), 0.0) for a, b, c in zip(k, y, h, strict=True)], "k int, y double, yhat double, null_number double")
    tes = spark.createDataFrame([(i, i % 4, 0.25 if i % 50 < 4 else float(x), 0.0) for i, x in enumerate(rng.normal(0, 1.5, 400))], "i int, k int, yhat double, null_number double")
    table = scoring.calibration_table(cal, ["k"], most_scores)
    assert table.agg(F.max(F.size("scores"))).first()[0] <= (150 if most_scores > 3 else 20) and table.where("k = 0").count() > (400 if most_scores > 3 else 800)
    nothing = scoring.score_stream(tes.limit(4).withColumn("yhat", F.lit(None).cast("double")), table, ["k"])
    assert {r["p"] for r in nothing.collect()} == {1.0}
    got = {r["i"]: r["p"] for r in scoring.score_stream(tes, table, ["k"]).collect()}
    lists = {a: np.sort(-h[(k == a) & (y <= 0)]) for a in range(3)}
    want = {r["i"]: 1.0 if r["k"] == 3 else (np.searchsorted(lists[r["k"]], -r["yhat"]) + 1) / ((k == r["k"]).sum() + 1) for r in tes.collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_tissue_mask_runs_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(4)
    image = np.full((320, 320, 3), 245, np.uint8)
    image[64:256, 64:256] = rng.integers(60, 200, (192, 192, 3))
    (tmp_path / "he.png").write_bytes(files.encode_png(image))
    got = {(r["grid_row"], r["grid_col"]) for r in tissue.tissue_mask(files.read_tiles(spark, f"{tmp_path}/he.png")).collect()}
    assert got <= {(r, c) for r in range(28) for c in range(28)}
