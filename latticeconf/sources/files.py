"""Readers and writers of the pipeline's file formats.

Files are listed and opened by Spark's own readers (binaryFile, text, csv), so any
store that Spark reaches will do; only decoding happens in Python, per file.
"""

from __future__ import annotations

import configparser
import io
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH, MULTIPLE, PIXEL_MICRONS = 16, 224, 0.5
_ROWS = 4096


def _binary(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_index(path: Column, stem: str, tail: str = "") -> Column:
    """The number in names like stem_3.npy or stem_3_scale_2.npy."""
    return F.regexp_extract(path, rf"{stem}_(\d+){tail}\.[A-Za-z]+$", 1).cast("int")


def roi_indices(spark: SparkSession, path: str, stem: str = "embeddings_roi", tail: str = r"_scale_\d+") -> DataFrame:
    """ROI numbers found in file names, in order."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return names.select(file_index(F.col("path"), stem, tail).alias("roi_idx")).where("roi_idx IS NOT NULL").distinct().orderBy("roi_idx")


def read_npy(spark: SparkSession, path) -> DataFrame:
    """(path, at, values): arrays as rows along their first axis, the others flattened."""

    def rows(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(a.shape[0], -1) if a.ndim else a.reshape(1, 1)
                for lo in range(0, len(a), _ROWS):
                    part = a[lo : lo + _ROWS].astype(float)
                    yield pd.DataFrame({"path": name, "at": range(lo, lo + len(part)), "values": list(part)})

    return _binary(spark, path).mapInPandas(rows, "path string, at long, values array<double>")


def embedding_parts(spark: SparkSession, path, per_part: int, width: int) -> DataFrame:
    """Full-grid embeddings from part files: part number and place give the cell."""
    parts = read_npy(spark, path).withColumn("part", file_index(F.col("path"), "embeddings_part"))
    at = F.col("part").cast("long") * per_part + F.col("at")
    return parts.where("part IS NOT NULL").select(F.floor(at / width).alias("grid_row"), (at % width).alias("grid_col"), F.col("values").alias("emb"))


def decode_png(content: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA PNG without interlacing, as (height, width, channels)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in (0, 2, 4, 6):
        raise ValueError("only 8-bit grey or RGB images without interlacing are read")
    k = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * k + 1)
    out = np.zeros((height, width * k), np.uint8)
    for y in range(height):
        line, up = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(width * k, int)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) % 256
        else:
            left = np.zeros(k, int)
            corner = np.zeros(k, int)
            for x in range(0, width * k, k):
                above = up[x : x + k]
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                left = (line[x : x + k] + guess) % 256
                corner = above
                out[y, x : x + k] = left
    return out.reshape(height, width, k)


def encode_png(image: np.ndarray) -> bytes:
    """An (height, width[, 3]) uint8 array as PNG."""
    image = np.atleast_3d(image).astype(np.uint8)
    height, width, k = image.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * k)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[k], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def padded(image: np.ndarray, multiple: int = MULTIPLE) -> np.ndarray:
    """White margins on the right and below, up to a multiple of the given size."""
    h, w = image.shape[:2]
    return np.pad(image, ((0, -h % multiple), (0, -w % multiple), (0, 0)), constant_values=255)


def rescaled(image: np.ndarray, factor: float) -> np.ndarray:
    """The image at factor times its size, sampled bilinearly."""
    h, w = max(1, round(image.shape[0] * factor)), max(1, round(image.shape[1] * factor))
    y = np.clip((np.arange(h) + 0.5) / factor - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / factor - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a = image.astype(float)
    return np.rint((a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy).astype(np.uint8)


def read_tiles(spark: SparkSession, path, size: int = PATCH, micron: float = PIXEL_MICRONS) -> DataFrame:
    """(slide_id, grid_row, grid_col, rgb): images as tiles of size x size pixels.

    micron: the files' pixel size; they are brought to PIXEL_MICRONS and padded.
    """

    def tiles(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                image = decode_png(content)
                image = np.repeat(image[..., :1], 3, axis=2) if image.shape[2] < 3 else image[..., :3]
                if micron != PIXEL_MICRONS:
                    image = rescaled(image, micron / PIXEL_MICRONS)
                image = padded(image)
                for r in range(image.shape[0] // size):
                    band = image[r * size : (r + 1) * size]
                    yield pd.DataFrame({"slide_id": name, "grid_row": r, "grid_col": range(image.shape[1] // size), "rgb": [band[:, c * size : (c + 1) * size].tobytes() for c in range(image.shape[1] // size)]})

    return _binary(spark, path).mapInPandas(tiles, "slide_id string, grid_row long, grid_col long, rgb binary")


def read_mask(spark: SparkSession, path) -> DataFrame:
    """(slide_id, grid_row, grid_col, tissue): any channel above 0."""

    def cells(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                m = decode_png(content).max(axis=2) > 0
                r, c = np.indices(m.shape)
                yield pd.DataFrame({"slide_id": name, "grid_row": r.ravel(), "grid_col": c.ravel(), "tissue": m.ravel()})

    return _binary(spark, path).mapInPandas(cells, "slide_id string, grid_row long, grid_col long, tissue boolean")


def confidence_png(result: DataFrame, height: int, width: int, most_cells: int = 4_000_000) -> bytes:
    """A map of confidence by colour; cells without a result are grey. One target and scale."""
    from ..functions.scores import heat_colour

    if height * width > most_cells:
        raise ValueError("maps are drawn on the driver; pool the result first")
    image = np.full((height, width, 3), 128, np.uint8)
    for r in result.select("grid_row", "grid_col", heat_colour(F.col("confidence")).alias("c")).toLocalIterator():
        image[r["grid_row"], r["grid_col"]] = (r["c"]["r"], r["c"]["g"], r["c"]["b"])
    return encode_png(image)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(kind, target, members, null_number) from a multi-line JSON of groups.

    {kind: {null: [{members, name}, ..]}}: a single member names its target; several
    members without a name are an error.
    """
    text = spark.read.text(path, wholetext=True).select("value")
    groups = "map<string,array<struct<genes:array<string>,cell_types:array<string>,name:string>>>"
    rows = text.select(F.explode(F.from_json("value", f"map<string,{groups}>")).alias("kind", "by_null")).select("kind", F.explode("by_null").alias("null_number", "groups")).select("kind", F.col("null_number").cast("double").alias("null_number"), F.explode("groups").alias("g"))
    members = F.coalesce("g.genes", "g.cell_types")
    name = F.when(F.col("g.name").isNotNull() & (F.col("g.name") != ""), F.col("g.name")).when(F.size(members) == 1, members[0]).otherwise(F.raise_error(F.lit("a target of several members needs a name")))
    return rows.select("kind", name.alias("target"), members.alias("members"), "null_number")


def read_config(text: str) -> dict[str, dict]:
    """Sections of an INI text; scales and rectangles as numbers."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    out: dict[str, dict] = {s: dict(parser[s]) for s in parser.sections()}
    for section in out.values():
        for key, value in section.items():
            if key == "scales":
                section[key] = [int(x) for x in value.split()]
            elif key.startswith("roi_top_left"):
                section[key] = [tuple(int(v) for v in x.split(",")) for x in value.split(";") if x.strip()]
            elif key.startswith(("roi_width", "roi_height")):
                section[key] = [int(x) for x in value.replace(";", " ").replace(",", " ").split()]
    return out


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_results(result: DataFrame, path: str) -> None:
    """p-values and confidence by target and scale."""
    result.write.mode("overwrite").partitionBy("target", "scale").parquet(path)


def write_fdr_csv(curve: DataFrame, path: str) -> None:
    curve.orderBy("fdr").coalesce(1).write.mode("overwrite").csv(path, header=True)  # 99 rows a target


def write_embedding_parts(emb: DataFrame, path: str, rows: int = 1_000_000) -> None:
    emb.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at path, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def names_to_indices(names: Sequence[str]) -> dict[str, int]:
    """The inverse of a dictionary from index to name."""
    return {n: i for i, n in enumerate(names)}
