"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset in local mode
    (tests) a temporary folder of this machine is set for the session; elsewhere
    executors couldn't see such a folder, and it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="latticeconf-checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    """The path, and the Hadoop file system that it lies in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(found), fs


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if it doesn't exist."""
    at, fs = _located(spark, path)
    found = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
    return [x for x in found if x[0] not in "._"]


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _located(spark, path)
    return fs.exists(at)


def note_at(spark: SparkSession, path: str) -> str:
    """The text of a file that claim() made."""
    at, fs = _located(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, note: str) -> bool:
    """Makes a file of the given text, whole or not at all; False if the path is taken.

    The text is written under another name and renamed without overwriting, which
    is one atomic step of HDFS and of file systems like it.
    """
    at, fs = _located(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    stream = fs.create(aside, True)
    stream.write(bytearray(note.encode()))
    stream.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, at, how)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    at, fs = _located(spark, path)
    fs.delete(at, True)


def without(docs: DataFrame, gone: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The rows whose doc_id isn't in gone (doc_id); rows without one stay.

    Up to broadcast_ids ids (about 30 MB) are broadcast, more are joined by a
    shuffle, in which rows without an id are spread by their text.
    """
    ids = written(gone.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "gone")
    if ids.limit(broadcast_ids + 1).count() <= broadcast_ids:
        return docs.join(F.broadcast(ids), "doc_id", "left_anti").select(docs.columns)
    ids = ids.select(F.col("doc_id").alias("__gone"), F.lit(0).cast("long").alias("__spread"))
    spread = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(0)
    return docs.join(ids, (docs["doc_id"] == ids["__gone"]) & (spread == ids["__spread"]), "left_anti").select(docs.columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body uses it.

    A lambda variable is bound to the value, so the optimizer can't copy the
    expression into each place of use (or into another lambda's loop).
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, unlike lower(), which follows Unicode."""
    return F.translate(text, UPPER, LOWER)


def fixed_slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
