"""Near copies at a five-word Jaccard similarity of 0.8: how far the pipeline's near-dedup stage has to reach.

SimHash groups (simhash_gph, on five-word shingles) propose the closest copies. At
a similarity of 0.8 about ten of 64 bits differ, and pigeonhole keys for so many
bits are a few bits long and hold nearly everything; so pairs beyond SimHash's
reach are proposed by bands of a MinHash signature. Every proposed link is
confirmed by the exact similarity of the two sets of shingles. With BANDS bands of
ROWS values a pair at similarity s shares none with probability
(1 - s^ROWS)^BANDS: 0.00007 at 0.8.

Scale. Texts of one set of shingles meet in one row. A key (a band's value, or a
SimHash group) of up to FEW sets is expanded into all pairs. In a larger key one
set leads: the one whose bands are shared by the most sets, which in a group of
copies is the text that they were made from. All others are compared with it. Then
the rest is done exactly, so that no link within a key is lost:

- Distance (1 - similarity) is a metric. A set that matched the leader leaves the key
  if, by the triangle inequality, no set that didn't match can be similar to it.
- A key whose remaining sets are in one group already is done.
- The sets of the other keys are joined by the prefix filter (_rest): two sets at SIMILAR
  or more share one of the rarest 1 - SIMILAR of their shingles, in any one order of
  all shingles. Passages that many sets hold are frequent, so they come last and propose
  nothing. Pairs in one group already, or too far apart by size or by place of the
  shingle, aren't compared. A shingle's sets are dealt to blocks, so that no task has
  the square of a large group; no step orders or gathers a key's members.

What isn't found are pairs that share no band and no SimHash group at all.

Defined cases: texts of fewer than five words are one shingle; null and wordless
texts have the empty set and form one group; rows of one doc_id are judged text
by text; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .simhash_gph import HASH_SEED, components, grouped, majority, shingle_hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS, FEW = 24, 5, 8
#: A set less similar than this to a key's leader is similar to none that matched it.
RING = 2 * SIMILAR - 1
#: Counters of shingles (their leading bits), and members of a block.
_CELL_BITS, BLOCK = 18, 256
_CHUNK = 1 << 11
_RNG = np.random.default_rng(HASH_SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 of the text's five-word shingles."""
    return np.unique(shingle_hashes(text, WORDS))


def bands(found: np.ndarray) -> list[int]:
    """A 64-bit key for each band of the set's MinHash signature."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), _CHUNK):
        x = found[lo : lo + _CHUNK, None] * _TIMES + _PLUS
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


_SIGNED = "doc_id long, text string, fp long, n long, sim long, bands array<long>"


def _signature_batches(batches):
    for batch in batches:
        prints, sizes, sims, keys = [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            h = shingle_hashes(text, WORDS)
            found = np.unique(h)
            prints.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
            sizes.append(len(found))
            sims.append(majority(h) - (1 << 63))
            keys.append(bands(found))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sims, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text", "fp", "n", "sim", "bands"])


def _gram_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(shingles, batch.column(1).cast(pa.binary()).to_pylist()), pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False)], names=["fp", "grams"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, s, linked) of the pairs of sets at a similarity s of RING or more, linked from SIMILAR on; sets: (fp, grams). Compared row by row in the JVM: no batch of long texts."""
    one = sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    two = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all_n"))
    least = lambda t: (F.col("all_n") == 0) | (F.col("both") >= F.lit(t) * (F.col("all_n") - F.col("both")) - 1e-9)
    return rows.where(least(RING)).select("a", "b", F.coalesce(F.try_divide(F.col("both"), F.col("all_n") - F.col("both")), F.lit(1.0)).alias("s"), least(SIMILAR).alias("linked"))


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows whose key has another row, with the key's number of rows."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return keyed.join(sizes, "key")


def _fits(n: Column, m: Column, least: float) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) >= least * F.greatest(n, m) - 1e-9


def _tried(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, a, b) to compare, a before b: all pairs of small keys, and the leader of each crowded key with its others."""
    mine = F.struct("rank", "low", "fp", "n")
    few, many = keyed.where(f"members <= {FEW}"), keyed.where(f"members > {FEW}")
    first = (few.select("key", mine.alias("x")), few, SIMILAR), (many.groupBy("key").agg(F.min(mine).alias("x")), many, RING)
    return tuple(x.join(y, "key").where(_fits(F.col("n"), F.col("x.n"), least) & (F.col("x") < mine)).select("key", F.col("x.fp").alias("a"), F.col("fp").alias("b")) for x, y, least in first)


def links(keyed: DataFrame, prints: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) between sets, None if no key is shared; groups are those of all links within keys.

    keyed: (key, fp, low, n); prints: (fp, text).
    """
    keyed = written(_shared(keyed), "copies-keys")
    if not keyed.take(1):
        return None
    # how many sets share each set's keys, the most first; narrow, since it meets all texts
    ranks = written(keyed.groupBy("fp").agg((-F.sum("members")).alias("rank")), "copies-ranks")
    texts = prints.join(ranks, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    grams = written(texts.mapInArrow(_gram_batches, "fp long, grams array<long>"), "copies-grams")
    keyed = written(keyed.join(ranks, "fp"), "copies-keys")
    few, many = _tried(keyed)
    many = written(many, "copies-tried")
    tried = written(similar(few.unionByName(many).select("a", "b").distinct(), grams), "copies-links")
    found = tried.where("linked").select("a", "b")
    crowded = keyed.where(f"members > {FEW}")
    if not crowded.take(1):
        return found
    rest = _left(crowded, many.join(tried, ["a", "b"]), found, ranks)
    return found.unionByName(_rest(rest, grams)) if rest.take(1) else found


def _left(crowded: DataFrame, seen: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, n, root) of the sets that may have links within crowded keys beside those to the leaders; root: their group by the links found.

    seen: (key, a, b, s, linked) of the leaders' comparisons.
    """
    ring = seen.groupBy("key").agg(F.max(F.when(~F.col("linked"), F.col("s"))).alias("ring"))
    safe = F.col("ring").isNull() | (F.col("s") > F.col("ring") + (1 - SIMILAR) + 1e-6)
    gone = seen.where("linked").join(ring, "key").where(safe).select("key", F.col("b").alias("fp"))
    gone = gone.unionByName(crowded.groupBy("key").agg(F.min(F.struct("rank", "low", "fp")).alias("x")).select("key", "x.fp"))
    roots = components(found, sets.select("fp", F.col("fp").alias("low")))  # by set: a doc_id may have several
    left = crowded.join(gone, ["key", "fp"], "left_anti").join(roots, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    left = written(left, "copies-left")
    apart = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return written(left.join(apart, "key", "left_semi").select("fp", "n", "root").distinct(), "copies-rest")


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - _CELL_BITS)).astype(np.int64)


def _count_batches(batches):
    total = np.zeros(1 << _CELL_BITS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_cells(batch.column(0).flatten().to_numpy()), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])


def prefixes(sets: DataFrame, grams: DataFrame) -> DataFrame:
    """(token, fp, n, root, at): each set's rarest shingles, as many as a similar set must share one of; at: their place from 1.

    Shingles are ordered by counters, which many shingles share, and then by themselves:
    any one order is exact. One whose counter is 1 is in no other set.
    """
    counts = np.zeros(1 << _CELL_BITS, dtype=np.int64)
    # 2 ** _CELL_BITS counters at most, 4 MB in columns; as rows they would take the driver a hundred
    summed = grams.select("grams").mapInArrow(_count_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()

    def run(batches):
        for batch in batches:
            tokens, rows, places = [], [], []
            for row, x in enumerate(batch.column(3)):
                x = x.values.to_numpy()
                often = counts[_cells(x)]
                order = np.lexsort((x, often))[: len(x) - int(np.ceil(SIMILAR * len(x) - 1e-6)) + 1]
                at = np.flatnonzero(often[order] > 1)
                tokens.append(x[order[at]])
                places.append(at + 1)
                rows.append(np.full(len(at), row))
            if rows:
                row = pa.array(np.concatenate(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), *(batch.column(k).take(row) for k in range(3)), pa.array(np.concatenate(places), pa.int64())], names=["token", "fp", "n", "root", "at"])

    return sets.join(grams, "fp").where("n > 0").select("fp", "n", "root", "grams").mapInArrow(run, "token long, fp long, n long, root long, at long")


def _rest(sets: DataFrame, grams: DataFrame) -> DataFrame:
    """All links (a, b) between sets (fp, n, root) of different groups."""
    tokens = written(prefixes(sets, grams), "copies-prefixes")
    apart = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = tokens.join(apart.select("token", n_blocks.alias("n_blocks")), "token").withColumn("own", F.pmod(F.xxhash64("fp"), "n_blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    one = rows.select("token", F.col("own").alias("i"), every.alias("j"), F.col("fp").alias("a"), F.struct("n", "root", "at").alias("x"))
    two = rows.select("token", F.col("own").alias("j"), every.alias("i"), F.col("fp").alias("b"), F.struct("n", "root", "at").alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    # if it is the first shingle that both have, they have no more than what follows it
    most = F.least(n - F.col("x.at"), m - F.col("y.at")) + 1
    near = _fits(n, m, SIMILAR) & (most * (1 + SIMILAR) >= SIMILAR * (n + m) - 1e-6) & (F.col("x.root") != F.col("y.root"))
    pairs = one.join(two, ["token", "i", "j"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return written(similar(pairs, grams).where("linked").select("a", "b"), "copies-links")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = written(rows.mapInArrow(_signature_batches, _SIGNED), "copies-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    distinct = written(distinct.withColumn("low", F.coalesce("low", F.lit((1 << 63) - 1))), "copies-sets")
    _, _, groups = grouped(distinct.select(F.col("low").alias("doc_id"), F.col("sim").alias("fp")))
    near = groups.select(F.col("fp").alias("sim"), F.col("root").alias("group"))
    by_print = distinct.join(near, "sim", "left").select(F.xxhash64(F.coalesce("group", "sim"), F.col("group").isNull()).alias("key"), "fp", "low", "n")
    by_band = distinct.select(F.posexplode("bands").alias("band", "value"), "fp", "low", "n").select(F.xxhash64("band", "value").alias("key"), "fp", "low", "n")
    pairs = links(by_print.unionByName(by_band), prints)
    ids = distinct.select("fp", F.nullif("low", F.lit((1 << 63) - 1)).alias("low"))
    if pairs is None:
        return prints.join(ids, "fp").select("doc_id", F.col("low").alias("component_id"))
    classes = ids.join(components(pairs, ids), "fp", "left").select("fp", F.coalesce("root", "low").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "component_id")
