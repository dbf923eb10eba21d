"""Sharding by size-tiered compaction under a versioned manifest.

append() writes arrivals as small immutable shards (each task writes its own
rows, at most ARRIVAL_ROWS to a file: no shuffle). compact() puts runs of similar
size in one tier and merges FAN_IN or more of a tier into files of about
TARGET_BYTES. Both write their files first, then a manifest under a name of its
own, and commit by one rename of a small file that names it to the next version's
place, which fails if another writer has taken that place. So a driver or executor
lost at any point leaves unreferenced files, never a half-changed table, and the
next call goes on from the last version. A writer that loses the race reads the
new version and tries again: new shards are added to it as they are, a merge only
if the shards that it replaces are still there (else it is planned anew). Readers
take the highest version, whose shards are never altered; expire() removes older
versions and the shards that no kept version has.

Planning works on manifest rows alone (one a shard, in lanes of LANE shards, so
that no window grows with the table); data moves once for each merge, to the
task that writes its target file.

Defined cases: an empty append commits a version with the same shards; null
values are data like others; repeated rows are kept; ties of run and size are
ordered by name; columns of the data named like the manifest's don't clash, as the
manifest is a table of its own.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, names_in, note_at, removed, shared_dir, written

ARRIVAL_ROWS = 8192
TARGET_BYTES = 64 << 20
FAN_IN = 4
TIER_RATIO = 4
SMALLEST = 64 << 10
LANE = 4096
BROADCAST_SHARDS = 100_000
MANIFEST = "shard string, tier int, n_rows long, n_bytes long, run long"


class ShardedTable:
    """A table of shards below root: data/, manifests/ and commits/VERSION."""

    def __init__(self, spark: SparkSession, root: str, arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.arrival_rows, self.target_bytes, self.fan_in = arrival_rows, target_bytes, fan_in

    def versions(self) -> list[int]:
        """Committed versions that haven't been removed."""
        return [int(x) for x in names_in(self.spark, f"{self.root}/commits")]

    def version(self) -> int:
        """The highest committed version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{note_at(self.spark, self._place(v))}")

    def _place(self, version: int) -> str:
        return f"{self.root}/commits/{version:010d}"

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of a committed version."""
        return self._shards(schema, self.manifest(version))

    def _shards(self, schema, shards: DataFrame) -> DataFrame:
        """Rows of the given shards with their _shard; whole directories are listed by Spark and other files' rows left out."""
        folders = sorted({r[0] for r in shards.select(F.substring_index("shard", "/", 1)).distinct().collect()})  # one a commit
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{x}" for x in folders))
        name = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name"))
        few = shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
        keep = shards.select(F.col("shard").alias("_shard"))
        return rows.withColumn("_shard", name).join(F.broadcast(keep) if few else keep, "_shard", "left_semi")

    def _commit(self, shards: DataFrame, base: int) -> int | None:
        """The new version with these shards; None if another writer has made it meanwhile."""
        name = f"{base + 1:010d}-{uuid.uuid4().hex}"
        shards.select(*(f.split()[0] for f in MANIFEST.split(", "))).write.parquet(f"{self.root}/manifests/{name}")
        if claim(self.spark, self._place(base + 1), name):
            return base + 1
        removed(self.spark, f"{self.root}/manifests/{name}")
        return None

    def _written(self, rows: DataFrame, folder: str, run: int) -> DataFrame:
        """Writes rows and describes the new files."""
        path = f"{self.root}/data/{folder}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", self.arrival_rows if run >= 0 else 0).parquet(path)
        files = self.spark.read.schema(rows.schema).parquet(path)
        n_bytes = F.max("_metadata.file_size").alias("n_bytes")
        found = files.groupBy(F.concat_ws("/", F.lit(folder), F.col("_metadata.file_name")).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), n_bytes)
        return found.select("shard", self._tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes", F.lit(abs(run)).cast("long").alias("run"))

    def _tier(self, n_bytes):
        return F.greatest(F.lit(0), F.floor(F.log(float(TIER_RATIO), n_bytes / float(SMALLEST)))).cast("int")

    def append(self, rows: DataFrame) -> int:
        """Adds rows as new small shards; returns the committed version."""
        base = self.version()
        new = self._written(rows, f"a{base + 1:08d}-{uuid.uuid4().hex[:8]}", base + 1)
        while True:
            try:
                shards = written(self.manifest(base).unionByName(new), "shards-next")
            except (Py4JJavaError, PySparkException):
                if self.version() == base:
                    raise
                shards = None  # expired meanwhile, so that there is a later version to go on from
            if shards is not None and (v := self._commit(shards, base)):
                return v
            base = self.version()

    def plan(self, shards: DataFrame) -> DataFrame:
        """(shard, lane, grp, k, b) for the shards that are to be merged now: their group, its shards and bytes.

        Within a lane, shards under half the target are put in order of tier and
        age and cut into groups of about one target file; a group of FAN_IN
        shards or more, or of a full target, is merged.
        """
        small = shards.where(F.col("n_bytes") < self.target_bytes // 2)
        lane = F.floor(F.pmod(F.xxhash64("shard"), F.lit(1 << 40)) / math.ceil((1 << 40) / max(1, math.ceil(shards.count() / LANE))))
        placed = small.withColumn("lane", lane)
        w = Window.partitionBy("lane", "tier").orderBy("run", "shard")
        cut = placed.withColumn("part", F.floor((F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))) / self.target_bytes)).na.fill(0, ["part"])
        grp = Window.partitionBy("lane", "tier", "part")
        merged = cut.withColumn("k", F.count(F.lit(1)).over(grp)).withColumn("b", F.sum("n_bytes").over(grp)).where((F.col("k") >= self.fan_in) | ((F.col("k") > 1) & (F.col("b") >= self.target_bytes)))
        return merged.select("shard", "lane", F.concat_ws("-", "lane", "tier", "part").alias("grp"), "k", "b")

    def compact(self, schema) -> int | None:
        """Merges once; the committed version, or None if nothing is to be merged.

        Groups are numbered, and a group's number is its partition: by a hash, two
        groups could meet in one task and one oversized file.
        """
        base = self.version()
        shards = self.manifest(base)
        todo = written(self.plan(shards).select("shard", "lane", "grp"), "shard-plan")
        groups = todo.select("lane", "grp").distinct()  # one row a target file
        n = groups.count()
        if not n:
            return None
        before = F.sum("size").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))  # over lanes: one row for LANE shards
        first = groups.groupBy("lane").agg(F.count(F.lit(1)).alias("size")).select("lane", F.coalesce(before, F.lit(0)).alias("first"))
        within = F.row_number().over(Window.partitionBy("lane").orderBy("grp")) - 1
        numbered = groups.withColumn("within", within).join(first, "lane").select("grp", (F.col("first") + F.col("within")).cast("int").alias("place"))
        todo = written(todo.join(numbered, "grp").select("shard", "place"), "shard-places")
        merged = todo.count()
        plan = todo.select(F.col("shard").alias("_shard"), F.col("place").alias("_place"))
        rows = self._shards(schema, todo).join(F.broadcast(plan) if merged <= BROADCAST_SHARDS else plan, "_shard").drop("_shard")
        new = self._written(rows.repartitionById(n, "_place").drop("_place"), f"m{base + 1:08d}-{uuid.uuid4().hex[:8]}", -(base + 1))
        while shards.join(todo, "shard", "left_semi").count() == merged:
            if v := self._commit(shards.join(todo, "shard", "left_anti").unionByName(new), base):
                return v
            base = self.version()
            shards = self.manifest(base)
        return self.compact(schema)  # another writer has merged some of these shards

    def settle(self, schema, keep: int | None = None) -> int:
        """compact() until nothing is left to merge, which ends as each merge leaves fewer shards; keep: as for expire()."""
        while self.compact(schema) is not None:
            if keep:
                self.expire(keep)
        return self.version()

    def expire(self, keep: int = 1) -> None:
        """Removes all but the latest versions, and their shards and manifests that no kept version has.

        Commits go first, so that no version is left without its shards. Only
        metadata passes the driver, a row at a time. Not while readers use an old version.
        """
        kept = self.versions()[-keep:]
        old = [v for v in self.versions() if v not in kept]
        if not old:
            return
        live = written(reduce(DataFrame.unionByName, map(self.manifest, kept)).select("shard").distinct(), "shards-live")
        dead = written(reduce(DataFrame.unionByName, map(self.manifest, old)).select("shard").distinct().join(live, "shard", "left_anti"), "shards-dead")
        folders = {r[0] for r in live.select(F.substring_index("shard", "/", 1)).distinct().collect()}
        for v in old:
            name = note_at(self.spark, self._place(v))
            removed(self.spark, self._place(v))
            removed(self.spark, f"{self.root}/manifests/{name}")
        whole = {r[0] for r in dead.select(F.substring_index("shard", "/", 1)).distinct().collect()} - folders  # one a commit
        for folder in sorted(whole):
            removed(self.spark, f"{self.root}/data/{folder}")
        for r in dead.where(~F.substring_index("shard", "/", 1).isin(*whole)).toLocalIterator():
            removed(self.spark, f"{self.root}/data/{r['shard']}")


def shard(docs: DataFrame, arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardedTable:
    """docs appended to a new table in the shared folder and compacted; superseded shards are removed."""
    t = ShardedTable(docs.sparkSession, shared_dir(docs.sparkSession, "shards"), arrival_rows, target_bytes, fan_in)
    t.append(docs)
    t.settle(docs.schema, keep=1)
    return t


def assignment(t: ShardedTable, schema, columns: list[str]) -> DataFrame:
    """columns of every row with its shard, and the shard's tier, rows, bytes and version.

    The five added names win over columns of the data with the same name.
    """
    v = t.version()
    named = {"tier": "shard_tier", "n_rows": "shard_rows", "n_bytes": "shard_bytes"}
    added = {"shard", "shard_version", *named.values()}
    rows = t.read(schema, v).select(*(c for c in columns if c.lower() not in added), F.col("_shard").alias("shard"))
    shards = t.manifest(v).select("shard", *(F.col(a).alias(b) for a, b in named.items()))
    few = shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    return rows.join(F.broadcast(shards) if few else shards, "shard").withColumn("shard_version", F.lit(v).cast("long"))
