"""Mixing sources to target weights by Poisson replication.

A source that should supply the share w of a mixture of E * N documents and has n
of the N documents is repeated at the mean rate r = E * N * w / n. Each document
draws its number of copies from a Poisson distribution of mean r by inverting it
at a number in [0, 1) that a keyed hash of its id gives, so the draw doesn't
depend on partitioning, order or retries. Copies are exploded and dealt to
partitions and sorted within them by another hash: reading the partitions in
order gives a global shuffle, without a sampling pass.

Only rates (one row a source) are joined to the documents: broadcast if there are
at most BROADCAST_SOURCES of them, else by a join on (source, salt) with the
rates repeated for each salt, so that no source's documents meet in one task.

Defined cases: null source is a source of its own; a row without a doc_id draws by
its text; repeated rows draw alike, but are dealt to SPREAD partitions; a rate over
STEP is drawn as a sum of independent parts of STEP at most; sources with no weight
given share what the given weights leave over in proportion to n ** TEMPERATURE
(where there are none, the mixture is that much smaller); weights must be
non-negative numbers of sum 1 at most; a weight of a source that isn't there is an
error, or with absent="spread" goes to the sources without a weight; an empty table
gives an empty result; all columns are carried, but for names of this operator's own
(copy_no, shuffle_key), which replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

TEMPERATURE = 0.5
EPOCHS = 1.0
SEED = 17
STEP = 32.0
BROADCAST_SOURCES = 10_000
SALTS = 64
SPREAD = 16
#: Target weights of the registered query and of the pipeline; other sources share the rest.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.025}
#: Copies beyond this are less likely than 1e-17 at a mean of STEP.
_MOST = 112


def name_of(docs: DataFrame) -> Column:
    """What a row's draws hang on: its id, or without one its text."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def uniform(name: Column, seed: int, part: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of name, seed and part."""
    digest = F.md5(F.concat_ws("|", name.cast("string"), F.lit(str(seed)), part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, absent: str = "error") -> DataFrame:
    """(source, n, rate): mean repetitions of each source's documents."""
    weights = weights or {}
    if not all(0 <= w <= 1 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are numbers from 0 to 1 of sum 1 at most")
    n = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    if weights and absent == "error":
        there = {r["source"] for r in n.where(F.col("source").isin(*weights)).collect()}  # of the named ones alone
        if there and (gone := sorted(set(weights) - there)):
            raise ValueError(f"no documents of {', '.join(gone)}")
    given = F.lit(None).cast("double")
    for source, w in weights.items():
        given = F.when(F.col("source") == source, F.lit(float(w))).otherwise(given)
    named = n.withColumn("given", given)
    whole = named.agg(F.sum("n").alias("all_n"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("all_given"), F.sum(F.when(F.col("given").isNull(), F.pow(F.col("n"), F.lit(temperature)))).alias("all_rest"))
    share = F.coalesce("given", F.greatest(F.lit(0.0), 1 - F.col("all_given")) * F.pow("n", F.lit(temperature)) / F.col("all_rest"))
    return named.join(F.broadcast(whole), F.lit(True)).select("source", "n", (F.lit(float(epochs)) * F.col("all_n") * share / F.col("n")).alias("rate"))


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..: a row of the distribution table."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_MOST)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c")),
        lambda a: a["c"],
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES, absent: str = "error") -> DataFrame:
    """docs with each row repeated by its draw, in global random order.

    Adds copy_no (from 1) and shuffle_key; ordering by shuffle_key gives the
    order of the mixture.
    """
    table = rates(docs, weights, epochs, temperature, absent).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    table = table.select(F.col("source").alias("__mix_source"), F.col("parts").alias("__mix_parts"), _cumulative(F.col("rate") / F.col("parts")).alias("__mix_cdf"))
    table = written(table, "mix-rates")
    # numbered where rows still have their input's order, which a join by shuffling doesn't keep: a repeated task deals alike
    own = docs.drop("copy_no", "shuffle_key").withColumns({"__mix_name": name_of(docs), "__mix_spread": F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))})
    if table.limit(broadcast_sources + 1).count() <= broadcast_sources:
        drawn = own.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__mix_source")))
    else:
        salted = table.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = own.withColumn("__mix_own_salt", F.pmod(F.xxhash64("__mix_name"), F.lit(SALTS)).cast("int"))
        drawn = drawn.join(salted, F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_own_salt") == F.col("__mix_salt"))).drop("__mix_own_salt", "__mix_salt")
    # each part's number is bound to a lambda variable: hashed once, not for every entry of the distribution
    one = lambda part: let(uniform(F.col("__mix_name"), seed, part), lambda u: F.size(F.filter("__mix_cdf", lambda c: c <= u)))
    copies = F.when(F.col("__mix_parts") == 1, one(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("__mix_parts")), F.lit(0), lambda a, part: a + one(part)))
    repeated = drawn.withColumn("__mix_copies", copies).where("__mix_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    digest = F.md5(F.concat_ws("|", F.col("__mix_name"), F.lit(f"{seed}-order"), F.col("copy_no").cast("string")))
    keyed = repeated.withColumn("shuffle_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    return keyed.repartition("shuffle_key", "__mix_spread").sortWithinPartitions("shuffle_key").drop("__mix_source", "__mix_parts", "__mix_cdf", "__mix_copies", "__mix_name", "__mix_spread")


def expected_copies(rate: float, u: float) -> int:
    """Inverse distribution function in plain Python, for tests."""
    parts = max(1, math.ceil(rate / STEP))
    r, k = rate / parts, 0
    p = c = math.exp(-r)
    while c <= u:
        k += 1
        p *= r / k
        c += p
    return k


_GIVEN = "CASE " + " ".join(f"WHEN source = '{k}' THEN {w}" for k, w in TARGETS.items()) + " END"
_NAMES = "coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))"
ORACLE = rf"""
WITH n AS (SELECT source, count(*) AS n, {_GIVEN} AS given FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS all_n, coalesce(sum(given), 0) AS all_given, sum(CASE WHEN given IS NULL THEN pow(n, {TEMPERATURE}) END) AS all_rest FROM n),
r AS (SELECT source, {EPOCHS} * all_n * coalesce(given, greatest(0, 1 - all_given) * pow(n, {TEMPERATURE}) / all_rest) / n AS rate FROM n, whole),
pmf AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p
        FROM r, (SELECT unnest(range(0, {_MOST + 1}))::DOUBLE AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
draw AS (SELECT *, {_NAMES} AS name, ('0x' || substr(md5({_NAMES} || '|{SEED}|1'), 1, 13))::BIGINT / {float(1 << 52)} AS u, row_number() OVER () AS own FROM documents),
copies AS (SELECT d.own, count(*) FILTER (WHERE c.c <= d.u) AS copies FROM draw d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.own)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5(name || '|{SEED}-order|' || x.copy_no::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM draw d JOIN (SELECT own, unnest(range(1, copies + 1)) AS copy_no FROM copies) x USING (own)
"""
