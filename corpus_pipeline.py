"""The corpus pipeline: language, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all the rows that its
predecessor kept; run() writes each stage's rows as Parquet to the shared folder
and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeconf.llm import hyperlang, near_copies, poisson_mix, size_tiered, template_decontam
from latticeconf.llm.common import table, without, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of none that was learned, go.

    So do null, empty and letterless texts. Each row is judged by its text alone, so
    repeated rows, ids and rows without an id fare as their texts do. Languages are
    learned from the labelled rows of docs itself; a table without any keeps nothing.
    """
    return hyperlang.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id.

    Groups are linked at a five-word Jaccard similarity of 0.8 or more: SimHash
    proposes the closest pairs, MinHash bands those beyond 64 bits' reach, and the
    exact similarity confirms both (near_copies).
    Null and empty texts are one group; rows of one doc_id are one document; rows
    without a doc_id can't be named and stay; an empty table stays empty.
    """
    groups = near_copies.copies(docs)
    extra = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("goes")).where("goes").select("doc_id")
    return without(docs, extra)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go.

    All rows of an id that was found go; rows without an id can't be named and stay, as
    do null and empty texts. Without benchmark items nothing goes.
    """
    found = template_decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in global random order; rows without an id draw by their text, an empty table stays empty."""
    return poisson_mix.mix(docs, poisson_mix.TARGETS, absent="spread").select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard that each one lies in.

    Every row is kept as often as it comes, whatever is null in it; a column named
    as the shard's is replaced; an empty table has no shards.
    """
    return size_tiered.assignment(size_tiered.shard(docs), docs.schema, docs.columns)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixture),
    ("sharding", sharding),
]

#: Prototypes of random vectors, component search and file layout aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + "-".join(name.lower().split()))
    return docs
