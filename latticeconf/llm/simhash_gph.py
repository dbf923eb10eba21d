"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Two 64-bit fingerprints at Hamming distance TAU or less are linked; groups are
the connected components of the links. With the bits dealt to m partitions and
a threshold t_i for each (-1: partition not probed), every linked pair agrees to
within t_i on some probed partition as soon as sum(t_i) = TAU - m + 1. Bits that
vary together share a partition, so that the partitions are as independent as
they can be, and a dynamic programme hands out unequal thresholds so that the
estimated number of candidate pairs is least.

Scale. Only distinct fingerprints are probed (copies meet in one row by a
partially aggregated groupBy). A key of more than HEAVY fingerprints isn't
expanded into pairs: its members are keyed again on partitions of the bits that
the key hasn't fixed, under the same principle, until keys are light or all bits
are fixed, so candidates stay near-linear and no link is lost. Statistics that
reach the driver have a fixed size (64 x 64 bit counts). Components come from
min-label propagation with pointer jumping, each round cut by checkpoint().

Defined cases: null or wordless text has fingerprint zero and is linked like any
other; repeated rows of a doc_id collapse to the rows' own fingerprints and all
carry the component's smallest id; a null doc_id keeps its row but never names a
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TAU = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
HEAVY = 256
_CHUNK = 1 << 16
_NO_ID = (1 << 63) - 1


def shingle_hashes(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the text's shingles of so many words, repeats included; none for a text without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n, digest = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + size]), HASH_SEED) for i in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def simhash64(text: bytes | None) -> int:
    """Fingerprint of one text: majority bits of its shingles' XXH64."""
    return majority(shingle_hashes(text))


def _fingerprint_batches(batches):
    for batch in batches:
        prints = np.array([simhash64(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _bit_counts(batches):
    total = np.zeros((64, 64), dtype=np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"cell": np.arange(4096, dtype=np.int32), "n": total.ravel()})


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for bits i, j how many have both set."""
    rows = distinct.select("fp").mapInArrow(_bit_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096, dtype=np.int64)
    for r in rows:  # 4,096 cells at most
        both[r["cell"]] = r["n"]
    return distinct.count(), both.reshape(64, 64)


def correlated_groups(bits: list[int], m: int, n: int, both: np.ndarray) -> list[list[int]]:
    """Deals bits to m partitions of near-equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, groups = list(bits), []
    for k in range(m):
        room = -(-len(left) // (m - k))
        group = [max(left, key=lambda b: (p[b] * (1 - p[b]), -b))]
        left.remove(group[0])
        while len(group) < room:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def estimated_candidates(group: list[int], n: int, both: np.ndarray, most: int = TAU) -> list[float]:
    """Estimated pairs within distance t on these bits, t = -1 .. most.

    Each bit differs between two fingerprints with probability 2q(1-q); the
    number of differing bits is taken as a sum of independent trials.
    """
    q = np.diag(both)[group] / max(n, 1)
    spread = np.zeros(most + 1)
    spread[0] = 1.0
    for x in 2 * q * (1 - q):
        spread = spread * (1 - x) + np.concatenate(([0.0], spread[:-1])) * x
    return [0.0, *(np.cumsum(spread) * n * max(n - 1, 0) / 2)]


def allocate(costs: list[list[float]], probes: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 of sum total with the least cost, by dynamic programming.

    costs[i][t + 1] and probes[i][t + 1]: candidate pairs, and keys to write, of
    partition i at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c, w in zip(costs, probes, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, plan) in best.items():
            for t in range(-1, len(c) - 1):
                x = cost + c[t + 1] + w[t + 1]
                if s + t not in new or x < new[s + t][0]:
                    new[s + t] = (x, [*plan, t])
        best = new
    return best[total][1]


def plan_partitions(n: int, both: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition; of 2 to tau + 2 partitions the cheapest number."""
    found = []
    for m in range(2, tau + 3):
        groups = correlated_groups(list(range(64)), m, n, both)
        costs = [estimated_candidates(g, n, both, tau) for g in groups]
        probes = [[0.0] + [float(n) * sum(_choose(len(g), k) for k in range(t + 1)) for t in range(tau + 1)] for g in groups]
        t = allocate(costs, probes, tau - m + 1)
        cost = sum(c[x + 1] + w[x + 1] for c, w, x in zip(costs, probes, t, strict=True))
        found.append((cost, m, [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0]))
    return min(found)[2]


def _choose(n: int, k: int) -> int:
    return math.comb(n, k)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def _keyed(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """Array of (wild, key) structs: the partition with 0..t of its bits wild.

    Two fingerprints within t on a partition share the key in which the bits on
    which they differ (and perhaps more) are wild; so equal keys, of equal wild
    bits, find all such pairs.
    """
    out = []
    for bits, t in plan:
        full = _mask(bits)
        wilds = [full & ~_mask(wild) for wild in combinations(bits, min(t, len(bits)))]
        out += [F.struct(F.lit(_signed(w)).alias("mask"), fp.bitwiseAND(F.lit(_signed(w))).alias("key")) for w in wilds]
    return F.array(*out)


def linked_pairs(distinct: DataFrame, tau: int = TAU, heavy: int = HEAVY, plan=None) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints at distance 1 .. tau.

    heavy bounds the members of a key that is expanded into pairs; larger keys
    are refined on the bits that they leave open, which loses no pair.
    """
    n, both = bit_statistics(distinct)
    plan = plan or plan_partitions(n, both, tau)
    keyed = distinct.select("fp", F.explode(_keyed(F.col("fp"), plan)).alias("k")).select("fp", "k.mask", "k.key")
    pairs = None
    while True:
        members = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowded = written(members, "gph-keys")
        masks = sorted(crowded.where(F.col("n") > heavy).agg(F.collect_set("mask")).first()[0])  # one for each partition and refinement
        if not masks:
            return _within(keyed, tau, pairs).distinct()
        hot = crowded.where(F.col("n") > heavy).select("mask", "key")
        pairs = _within(keyed.join(hot, ["mask", "key"], "left_anti"), tau, pairs)
        dense = keyed.join(hot, ["mask", "key"], "left_semi")
        step, closed = F.lit(None).cast("array<struct<mask:bigint,key:bigint>>"), []
        for mask in masks:
            open_bits = [b for b in range(64) if not mask >> b & 1]
            if len(open_bits) <= tau:
                closed.append(mask)  # a key holds 2 ** tau fingerprints at most
                continue
            parts = min(tau + 1, len(open_bits))
            finer = [_signed(_mask(g) | mask & (1 << 64) - 1) for g in correlated_groups(open_bits, parts, n, both)]
            keys = F.array(*(F.struct(F.lit(x).alias("mask"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for x in finer))
            step = F.when(F.col("mask") == F.lit(mask), keys).otherwise(step)
        if closed:
            pairs = _within(dense.where(F.col("mask").isin(closed)), tau, pairs)
        keyed = written(dense.select("fp", F.explode(step).alias("k")).select("fp", "k.mask", "k.key").distinct(), "gph-finer")


def _within(keyed: DataFrame, tau: int, pairs: DataFrame | None) -> DataFrame:
    a = keyed.select("mask", "key", F.col("fp").alias("a"))
    b = keyed.select("mask", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    found = a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return found if pairs is None else pairs.unionByName(found)


def components(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints that have a link; ids: (fp, low).

    root is the smallest low reachable. A label is (low, fingerprint): rows of one
    doc_id with different texts share a low but not a label, so they don't join
    groups. Each round every fingerprint takes the least label among its own, its
    neighbours' and that of the fingerprint which its label names; and the one that
    its label before named is told its label, so that whole groups join: rounds
    grow with the logarithm of a chain's length. A round is one join and one
    partial aggregation, written to the shared folder; they stop when no label changes.
    """
    edges = written(pairs.select(F.col("a").alias("fp"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("to"))), "gph-edges")
    touched = edges.select("fp").distinct()
    own = F.struct(F.coalesce("low", F.lit(_NO_ID)).alias("low"), F.col("fp").alias("leader"))
    labels = written(ids.join(touched, "fp", "left_semi").select("fp", own.alias("root"), own.alias("was")), "gph-labels")
    while True:
        named = labels.select(F.col("root.leader").alias("fp"), F.col("fp").alias("to"))
        left = labels.select("fp", F.col("was.leader").alias("to"))
        ways = edges.unionByName(named.unionByName(left).where("fp <> to"))
        told = ways.join(labels.select("fp", "root"), "fp").select(F.col("to").alias("fp"), "root")
        kept = labels.select("fp", "root", F.col("root").alias("was"))
        new = written(kept.unionByName(told, allowMissingColumns=True).groupBy("fp").agg(F.min("root").alias("root"), F.max("was").alias("was")), "gph-labels")
        if not new.where("was <> root").take(1):
            return new.select("fp", F.nullif(F.col("root.low"), F.lit(_NO_ID)).alias("root"))
        labels = new


def grouped(prints: DataFrame, tau: int = TAU, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, fp): the distinct fingerprints with their smallest doc_id, their links, and the groups of those that have one."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "gph-distinct")
    pairs = written(linked_pairs(distinct.select("fp"), tau, heavy), "gph-pairs")
    return distinct, pairs, components(pairs, distinct.select("fp", "low"))


def near_duplicate_groups(docs: DataFrame, tau: int = TAU, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links), a row for each row of docs."""
    prints = written(fingerprints(docs), "gph-prints")
    distinct, pairs, roots = grouped(prints, tau, heavy)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    classes = distinct.join(roots, "fp", "left").join(links, "fp", "left").select("fp", F.coalesce("root", "low").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
