"""Embedding parts as a Spark data source: .npy files of rows, numbered along the grid.

register(spark) makes the format "embedding_parts" known. Reading splits every file
into ranges of rows, by its header and size alone, so that no task reads more than
its range, in CHUNK rows at a time, however large a file is. Filters on part and
index leave out files and ranges before anything is read; halves says which half
of each row is wanted, and the other isn't handed on. Part numbers must be gapless, widths
and types equal, and parts but the last full.

Writing stages each task's whole parts under names of their own in a new version's folder; the
driver's commit checks that the parts are whole and puts the version's name in place
by one rename. Until then, and when a task is lost or the job fails, readers see the
version before. Rows have to come with a part's rows together and in order
(in_parts() deals them so).

Options: path (a URI or a mounted folder), width (cells of a grid row), rows_per_range,
halves (both, global or local), per_part and dtype (for writing).
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "embedding_parts"
ROWS_PER_RANGE, CHUNK = 65_536, 1024
_NAME = re.compile(r"embeddings_part_(\d+)\.npy")
_CURRENT = "_current"
SCHEMA = "part int, at long, index long, grid_row long, grid_col long, emb_global array<float>, emb_local array<float>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path.rstrip("/")))


def located(spark: SparkSession, path: str) -> str:
    """The path with its file system, which the session's default gives where it has none."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)).toString()


@dataclass
class Part:
    number: int
    path: str
    begins: int
    rows: int
    size: int
    dtype: str


@dataclass
class Range(InputPartition):
    part: Part
    first: int
    lo: int
    hi: int


def header(system: fs.FileSystem, path: str) -> tuple[int, int, str, int]:
    """(rows, numbers a row, type, where the numbers begin) of a .npy file, checked against its length."""
    with system.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        begins, length = f.tell(), f.size()
    if fortran or dtype.hasobject or not shape:
        raise ValueError(f"{path}: rows of numbers in C order are read")
    size = math.prod(shape[1:])
    if length != begins + shape[0] * size * dtype.itemsize:
        raise ValueError(f"{path}: the file doesn't hold the {shape[0]} rows that its header names")
    return shape[0], size, dtype.str, begins


def listed(path: str) -> list[Part]:
    """The parts of the current version, or of the folder itself where none was committed; none is missing."""
    system, root = opened(path)
    pointer = f"{root}/{_CURRENT}"
    if system.get_file_info(pointer).type == fs.FileType.File:
        with system.open_input_stream(pointer) as f:
            root = f"{root}/{json.loads(f.read())['version']}"
    names = {int(m[1]): x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if (m := _NAME.fullmatch(x.base_name))}
    parts = []
    for number in sorted(names):
        rows, size, dtype, begins = header(system, names[number])
        parts.append(Part(number, names[number], begins, rows, size, dtype))
    checked(parts)
    return parts


def checked(parts: list[Part]) -> None:
    if [p.number for p in parts] != list(range(len(parts))):
        raise ValueError(f"parts are missing: found {[p.number for p in parts]}")
    if len({(p.size, p.dtype) for p in parts}) > 1:
        raise ValueError("parts differ in width or type")
    if any(p.rows != parts[0].rows for p in parts[:-1]) or parts and parts[-1].rows > parts[0].rows:
        raise ValueError("only the last part may have fewer rows than the others")


class PartReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.width = options["path"], int(options["width"])
        self.step, self.halves = int(options.get("rows_per_range", ROWS_PER_RANGE)), options.get("halves", "both")
        if self.halves not in ("both", "global", "local") or self.step < 1 or self.width < 1:
            raise ValueError("halves is both, global or local; rows_per_range and width are positive")
        self.bounds = {"part": (0, math.inf), "index": (0, math.inf)}  # inclusive

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and value not in (None, ()):
                few, most = (min(value), max(value)) if isinstance(f, In) else (value, value)
                lo, hi = self.bounds[column]
                lo = lo if isinstance(f, (LessThan, LessThanOrEqual)) else max(lo, few + isinstance(f, GreaterThan))
                hi = hi if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else min(hi, most - isinstance(f, LessThan))
                self.bounds[column] = lo, hi
            yield f  # ranges are cut by it; Spark still checks rows

    def partitions(self) -> list[Range]:
        parts = listed(self.path)
        (p0, p1), (i0, i1) = self.bounds["part"], self.bounds["index"]
        out = []
        for p in parts:
            first = p.number * parts[0].rows
            lo, hi = max(0, i0 - first), min(p.rows, i1 + 1 - first)
            if p0 <= p.number <= p1 and lo < hi:
                out += [Range(p, first, a, min(hi, a + self.step)) for a in range(int(lo), int(hi), self.step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.part is None:
            return
        p, (system, _) = partition.part, opened(self.path)
        dtype, half = np.dtype(p.dtype), p.size // 2
        with system.open_input_file(p.path) as f:
            for lo in range(partition.lo, partition.hi, CHUNK):
                n = min(partition.hi, lo + CHUNK) - lo
                f.seek(p.begins + lo * p.size * dtype.itemsize)
                a = np.frombuffer(f.read(n * p.size * dtype.itemsize), dtype).reshape(n, p.size).astype(np.float32, copy=False)
                at = np.arange(lo, lo + n)
                index = partition.first + at
                halves = [self._lists(a[:, :half] if self.halves != "local" else None, n), self._lists(a[:, half:] if self.halves != "global" else None, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p.number, np.int32)), *(pa.array(x) for x in (at, index, index // self.width, index % self.width)), *halves], names=[x.split()[0] for x in SCHEMA.split(", ")])

    @staticmethod
    def _lists(a: np.ndarray | None, n: int) -> pa.Array:
        if a is None:
            return pa.nulls(n, pa.list_(pa.float32()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * a.shape[1], max(1, a.shape[1]))[: n + 1] if a.shape[1] else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(a).ravel()))


@dataclass
class Staged(WriterCommitMessage):
    parts: list[Part]


class PartWriter(DataSourceArrowWriter):
    """Rows (part, at, emb) to one file a part; a task holds one part's chunk at a time."""

    def __init__(self, options: dict[str, str]):
        self.path, self.dtype, self.version = options["path"], np.dtype(options.get("dtype", "<f4")), f"v-{uuid.uuid4().hex}"
        self.per_part = int(options["per_part"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.path)
        system.create_dir(f"{root}/{self.version}", recursive=True)
        done: list[Part] = []
        stream = None
        for batch in iterator:
            part, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "at"))
            emb = batch.column(batch.schema.get_field_index("emb"))
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: len(part)]
            for lo, hi in zip(starts, [*starts[1:], len(part)], strict=True):
                number, rows = int(part[lo]), np.array(emb.slice(lo, hi - lo).to_pylist(), self.dtype)
                if not done or done[-1].number != number:
                    if any(p.number == number for p in done):
                        raise ValueError(f"the rows of part {number} don't come together")
                    if stream:
                        stream.close()
                    # the rows' number is known at the end only: numbers first, under a name of their own
                    done.append(Part(number, f"{root}/{self.version}/_{number}-{uuid.uuid4().hex}", 0, 0, rows.shape[1], self.dtype.str))
                    stream = system.open_output_stream(done[-1].path)
                p = done[-1]
                if rows.shape[1] != p.size or list(at[lo:hi]) != list(range(p.rows, p.rows + hi - lo)):
                    raise ValueError(f"part {number}: rows out of order or of another width")
                stream.write(rows.tobytes())
                p.rows += int(hi - lo)
        if stream:
            stream.close()
        for p in done:  # a header and what has been staged, in one file
            raw, p.path = p.path, f"{p.path}.npy"
            with system.open_output_stream(p.path) as to, system.open_input_stream(raw) as given:
                np.lib.format.write_array_header_1_0(to, {"descr": p.dtype, "fortran_order": False, "shape": (p.rows, p.size)})
                while piece := given.read(1 << 24):
                    to.write(piece)
            system.delete_file(raw)
        return Staged(done)

    def commit(self, messages: list[Staged]) -> None:
        """Names the staged parts and then the version; a name is given by a rename."""
        system, root = opened(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p.number)
        checked(parts)
        if any(p.rows != self.per_part for p in parts[:-1]) or parts and parts[-1].rows > self.per_part:
            raise ValueError("a part is split between tasks, or has other than per_part rows")
        system.create_dir(f"{root}/{self.version}", recursive=True)
        for p in parts:
            system.move(p.path, f"{root}/{self.version}/embeddings_part_{p.number}.npy")
        aside = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(json.dumps({"version": self.version}).encode())
        system.move(aside, f"{root}/{_CURRENT}")

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.version}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.version}")


class EmbeddingParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PartReader:
        return PartReader(self.options)

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EmbeddingParts)


def read_parts(spark: SparkSession, path: str, width: int, **options) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(path=located(spark, path), width=width, **options).load()


def in_parts(cells: DataFrame, index: str, emb: str, per_part: int) -> DataFrame:
    """(part, at, emb) of rows numbered from 0 by index, each part's rows together and in order."""
    rows = cells.select(F.floor(F.col(index) / per_part).cast("int").alias("part"), (F.col(index) % per_part).alias("at"), F.col(emb).cast("array<float>").alias("emb"))
    return rows.repartition("part").sortWithinPartitions("part", "at")


def write_parts(cells: DataFrame, path: str, index: str, emb: str, per_part: int, dtype: str = "<f4") -> None:
    """Writes whole parts and commits them together; readers of path see the parts before until then."""
    register(cells.sparkSession)
    parts = in_parts(cells, index, emb, per_part)
    parts.write.format(FORMAT).options(path=located(cells.sparkSession, path), per_part=per_part, dtype=dtype).mode("append").save()
