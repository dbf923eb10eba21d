"""Both sides of the conformal method, stored in buckets by (target, scale, cluster).

For runs over thousands of targets: predictions are dealt to buckets once, when they
are stored, and ranks and adjustment of any choice of targets then read whole buckets,
without an exchange. A key of more rows than one task should sort isn't bucketed: its
rows go to a table of their own, evenly dealt, and are ranked by ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conformal import ranked, ranked_in_place
from ..operators.quantiles import TASK_VALUES
from ..operators.shared import shared_path, written

KEYS = ("target", "scale", "cluster")
BUCKETS = 200
#: Large keys up to this number (a few MB of them) are broadcast to the rows; more are joined by a shuffle.
BROADCAST_KEYS = 10_000


@dataclass(frozen=True)
class SideStore:
    """Tables NAME (bucketed) and NAME_large in the session's catalogue.

    Rows have is_calib and a score besides their own columns. Test rows with a NULL
    among the keys are in NAME_large, and get p = 1 as rows of keys without
    calibration rows do.
    """

    spark: SparkSession
    name: str
    keys: Sequence[str] = KEYS

    @classmethod
    def save(cls, calib: DataFrame, test: DataFrame, name: str = "", keys: Sequence[str] = KEYS, buckets: int = BUCKETS, most_rows: int = TASK_VALUES) -> SideStore:
        """Stores the sides (as scored() gives them) as name, or a name of its own; an older store of that name is replaced."""
        store = cls(test.sparkSession, name or f"sides_{uuid.uuid4().hex}", tuple(keys))
        keys = list(keys)
        of_calib = [F.col(c) if c in calib.columns else F.lit(None).cast(t).alias(c) for c, t in test.dtypes if c != "is_calib"]
        both = calib.select(*of_calib, F.lit(True).alias("is_calib")).unionByName(test.withColumn("is_calib", F.lit(False)))
        both = written(both, "sides")  # read for counts and for both tables
        large = written(both.groupBy(*keys).count().where(F.col("count") > most_rows).select(*keys), "sides-large")
        n = large.limit(BROADCAST_KEYS + 1).count()
        hint = F.broadcast(large) if n <= BROADCAST_KEYS else large
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        apart = both.where(null).unionByName(both.join(hint, keys, "left_semi")) if n else both.where(null)
        small = both.where(~null).join(hint, keys, "left_anti") if n else both.where(~null)
        # one task a bucket, so that a bucket is one file
        small.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, "score").option("path", shared_path(store.spark, "sides-buckets")).mode("overwrite").saveAsTable(store.name)
        apart.write.option("path", shared_path(store.spark, "sides-apart")).mode("overwrite").saveAsTable(f"{store.name}_large")
        return store

    def ranks(self, where: str = "true", ranges: int | None = None) -> DataFrame:
        """Test rows with p, p_adj and confidence; where: a condition on the keys, such as the targets wanted."""
        near = ranked_in_place(self.spark.table(self.name).where(where), self.keys)
        apart = self.spark.table(f"{self.name}_large").where(where)
        if apart.isEmpty():
            return near
        far = ranked(apart.where("is_calib").drop("is_calib"), apart.where("NOT is_calib").drop("is_calib"), self.keys, ranges)
        return near.unionByName(far)
