"""Operators 2, 3, 4, 5, 7 and 10, and the pipeline."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeconf.llm import common, near_copies, poisson_mix, queries, simhash_gph, size_tiered, template_decontam, token_rollup, weak_quality

from .brute import fingerprint, groups, quality_base


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall()), key=key)


def compare_with_sql(df, sql, data):
    tables = {os.path.basename(f)[:-8]: (f"{f}/*.parquet" if os.path.isdir(f) else f) for f in glob.glob(f"{data}/*.parquet")}
    want = in_duckdb(sql, **tables)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


@pytest.fixture(scope="module")
def edge_dir(edge, docs, spark, data, tmp_path_factory):
    """A data directory whose documents are the edge cases with ids of their own, and some ordinary ones."""
    path = str(tmp_path_factory.mktemp("edge"))
    own = edge.select(docs.columns).dropDuplicates(["doc_id"])
    docs.limit(60).withColumn("doc_id", F.col("doc_id") + 1000).unionByName(own).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, data, edge_dir, name):
    for d in (data, edge_dir):
        compare_with_sql(queries.QUERIES[name](spark, d), queries.ORACLE_SQL[name], d)


# --- 2: token counts


def test_rollup_counts_and_retries(spark, docs, edge, nothing):
    counter = token_rollup.BpeCounter(token_rollup.ranks_of(open(token_rollup.VOCABULARY, "rb").read()))
    for df in (docs, edge, nothing):
        want = Counter()
        for r in df.select("source", "lang", "text").collect():
            n = len(counter.encoding.encode_ordinary(r["text"] or ""))
            want[r["source"], r["lang"], "docs"] += 1
            want[r["source"], r["lang"], "tokens"] += n
            want[r["source"], r["lang"], "chars"] += len(r["text"] or "")
        got = Counter()
        for r in token_rollup.rollup_of(df).collect():
            assert r["tokenizer"] == "byte_bpe_50k"
            for c in ("docs", "tokens", "chars"):
                got[r["source"], r["lang"], c] += r[c]
        assert got == want


def test_registered_rollup_counts_every_row(spark, docs, edge, tmp_path):
    """Null and empty texts are documents; a group of nothing else keeps its row."""
    none = spark.createDataFrame([(90, None, "xx", "bare", 0), (91, "", "xx", "bare", 0)], docs.schema)
    docs.limit(40).unionByName(edge.select(docs.columns)).unionByName(none).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_token_counts(spark, str(tmp_path))
    assert rows(got, "source", "lang", "docs", "chars") == rows(df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")), "source", "lang", "docs", "chars")
    assert ("bare", "xx", 2, 0) in rows(got, "source", "lang", "docs", "tokens")


def test_rollup_commits_once(spark):
    t = token_rollup.TokenRollup(spark)
    new = spark.createDataFrame([("a", "en", "v1", 1, 10, 40)], token_rollup.DELTA)
    assert t.totals().count() == 0
    assert t.commit("one", token_rollup.signed(new=new)) and not t.commit("one", token_rollup.signed(new=new))
    revised = spark.createDataFrame([("a", "de", "v2", 1, 12, 40)], token_rollup.DELTA)
    assert t.commit("two", token_rollup.signed(new=revised, old=new))
    assert rows(t.totals(), "lang", "tokenizer", "docs", "tokens") == [("de", "v2", 1, 12)]
    assert t.commit("three", token_rollup.signed(old=revised)) and t.totals().count() == 0
    with pytest.raises(ValueError):
        t.commit("../x", new)


def test_rollup_snapshots(spark, tmp_path, monkeypatch):
    """Totals are the same before and after a snapshot, after one that was cut short, and with two writers of one batch."""
    t, u = (token_rollup.TokenRollup(spark, f"{tmp_path}/r") for _ in "tu")
    one = lambda n: spark.createDataFrame([("a", "en", "v1", 1, n, 4 * n)], token_rollup.DELTA)
    total = lambda: t.totals().collect()[0]["tokens"]
    for k in range(3):
        assert t.commit(f"b{k}", one(10**k))
    assert total() == 111 and t.snapshot() and total() == 111
    assert not t.commit("b1", one(5)) and t.commit("b3", one(1000)) and total() == 1111
    monkeypatch.setattr(token_rollup.TokenRollup, "_put_away", lambda self, snapshot: None)
    assert t.snapshot() and total() == 1111 and not u.commit("b3", one(1))  # cut short before its batches were put away
    monkeypatch.undo()
    assert t.commit("b4", one(10_000)) and t.snapshot() and total() == 11_111 and common.names_in(spark, f"{tmp_path}/r/batches") == []
    assert [x.commit(f"b{k}", one(1)) for k in range(5) for x in (t, u)] == [False] * 10
    real = token_rollup.claim
    monkeypatch.setattr(token_rollup, "claim", lambda *a: monkeypatch.setattr(token_rollup, "claim", real) or u.commit("b5", one(100_000)) and real(*a))
    assert not t.commit("b5", one(7)) and total() == 111_111


def test_rollup_batch_claimed_after_two_snapshots(spark, tmp_path, monkeypatch):
    """A writer that has found a batch open, and then sleeps over its commit by another and two snapshots, adds nothing."""
    t, u = (token_rollup.TokenRollup(spark, f"{tmp_path}/r") for _ in "tu")
    one = lambda n: spark.createDataFrame([("a", "en", "v1", 1, n, n)], token_rollup.DELTA)
    real = token_rollup.claim

    def late(*a):
        monkeypatch.setattr(token_rollup, "claim", real)
        assert u.commit("b1", one(1)) and u.snapshot() and u.commit("b2", one(100)) and u.snapshot()
        return real(*a)

    monkeypatch.setattr(token_rollup, "claim", late)
    assert not t.commit("b1", one(1))
    assert rows(t.totals(), "docs", "tokens") == [(2, 101)] and t.snapshot() and rows(u.totals(), "docs", "tokens") == [(2, 101)]


def test_slices_lose_no_token():
    counter = token_rollup.BpeCounter(token_rollup.ranks_of(open(token_rollup.VOCABULARY, "rb").read()))
    text = "some words 12, and  more;\n\n" * 40_000 + "x" * 30
    assert counter.count(text) == len(counter.encoding.encode_ordinary(text))


# --- 3: near-duplicates


def test_groups_against_all_pairs(spark, docs, edge, nothing):
    for df in (docs, edge, nothing):
        want = groups([(r["doc_id"], fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()])
        got = simhash_gph.near_duplicate_groups(df)
        assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", c) for i, f, c in want), key=key)


def test_rows_of_one_id_keep_groups_apart(spark):
    """Two texts of one doc_id, each in a group of its own: no group is joined and no row repeated."""
    a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "ab")
    data = [(5, a), (7, f"{a} end"), (5, b), (3, f"{b} end"), (None, f"{a} tail"), (5, a)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = groups([(i, fingerprint(t)) for i, t in data])
    assert rows(simhash_gph.near_duplicate_groups(df), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", c) for i, f, c in want), key=key)
    pairs = spark.createDataFrame([(1, 2), (3, 4), (6, 7)], "a long, b long")
    ids = spark.createDataFrame([(1, 5), (2, 7), (3, 5), (4, 3), (6, None), (7, None), (9, 1)], "fp long, low long")
    assert rows(simhash_gph.components(pairs, ids), "fp", "root") == [(1, 5), (2, 5), (3, 3), (4, 3), (6, None), (7, None)]


def test_rounds_of_a_chain_grow_with_its_logarithm(spark, monkeypatch):
    """A chain of 300 whose ids are in no order, and a pair; each round is written once."""
    rounds = []
    monkeypatch.setattr(simhash_gph, "written", lambda df, purpose, f=simhash_gph.written: (rounds.append(purpose), f(df, purpose))[1])
    low = list(range(300))
    random.Random(2).shuffle(low)
    pairs = spark.createDataFrame([*((i, i + 1) for i in range(299)), (400, 401)], "a long, b long")
    ids = spark.createDataFrame([*enumerate(low), (400, 9), (401, None), (402, 1)], "fp long, low long")
    got = rows(simhash_gph.components(pairs, ids), "fp", "root")
    assert got == [*((i, 0) for i in range(300)), (400, 9), (401, 9)]
    assert rounds.count("gph-labels") <= 20


@pytest.mark.parametrize("plan", [None, [([*range(32)], 1), ([*range(32, 64)], 0)], [([*range(40)], 0), ([*range(40, 64)], 1)], [([*range(64)], 2)]])
@pytest.mark.parametrize("heavy", [4, 10_000])
def test_no_link_is_lost(spark, plan, heavy):
    """Dense neighbourhoods, equal and unequal thresholds, with and without refinement of crowded keys."""
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0) for c in centres for _ in range(40)} | {rng.getrandbits(64) for _ in range(60)}
    want = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    mask = (1 << 64) - 1
    got = {(min(r["a"] & mask, r["b"] & mask), max(r["a"] & mask, r["b"] & mask)) for r in simhash_gph.linked_pairs(df, heavy=heavy, plan=plan).collect()}
    assert got == want


def test_allocation_is_least():
    """The dynamic programme against all allocations."""
    from itertools import product

    rng = random.Random(1)
    for m in (2, 3, 4):
        costs = [[0.0, *sorted(rng.random() * 100 for _ in range(3))] for _ in range(m)]
        probes = [[0.0, 1, 20, 300]] * m
        total = 2 - m + 1
        price = lambda t: sum(costs[i][x + 1] + probes[i][x + 1] for i, x in enumerate(t))  # noqa: B023, E731
        got = simhash_gph.allocate(costs, probes, total)
        assert sum(got) == total
        assert price(got) == pytest.approx(min(price(t) for t in product(range(-1, 3), repeat=m) if sum(t) == total))


@pytest.mark.parametrize("tau", [3, 4])
def test_no_link_is_lost_beyond_two_bits(spark, tau):
    rng = random.Random(tau)
    c = rng.getrandbits(63)
    prints = {c ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for _ in range(60)} | {rng.getrandbits(63) for _ in range(20)}
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= tau}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for plan in [None] if tau < 4 else [[([*range(16)], 3), ([*range(16, 64)], 0)]]:
        assert {tuple(r) for r in simhash_gph.linked_pairs(df, tau, plan=plan).collect()} == want


def near_pairs(texts):
    """All pairs at a five-word Jaccard of 0.8, by comparing all."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return {i: {j for j in sets if i != j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0)} for i in sets}


def near_copy_groups(texts):
    """The smallest doc_id of each group."""
    near, want, seen = near_pairs(texts), set(), set()
    for i in sorted(near):
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                if (j := todo.pop()) not in seen:
                    seen.add(j)
                    todo += near[j]
    return want


def test_shared_passages_split_by_further_bands(spark):
    """Sets that share a passage crowd keys without being similar; the similar pairs among them are still linked."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(40):
        own = [f"o{i}-{k}" for k in range(22)]
        texts[2 * i] = " ".join(passage + own)
        at = rng.randrange(22)
        texts[2 * i + 1] = " ".join(passage + own[:at] + ["x"] + own[at + 1 :])
    got = {}
    for r in near_copies.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r["doc_id"]] = r["component_id"]
    near = near_pairs(texts)
    for i in texts:
        assert got[i] in near[i] | {i}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(40)) >= 39


def recall(spark, texts):
    """Of the pairs at a similarity of 0.8, how many are in one group; none may be in a group that such pairs don't make."""
    near = near_pairs(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    reached = {}
    for root in sorted(near):
        todo = [root] * (root not in reached)
        while todo:
            if (j := todo.pop()) not in reached:
                reached[j] = root
                todo += near[j]
    assert all(reached[i] == reached[got[i]] for i in texts)
    links = [(i, j) for i in near for j in near[i]]
    return sum(got[i] == got[j] for i, j in links) / len(links)


def changed(rng, words, n, mark):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = f"{mark}-{at}"
    return out


def test_recall_in_a_large_group_of_copies(spark):
    """Copies of one text, and copies of those, most of them beyond 0.8 of each other; the text itself comes last."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    first = [changed(rng, base, rng.randint(1, 4), f"a{i}") for i in range(250)]
    second = [changed(rng, rng.choice(first), rng.randint(1, 4), f"b{i}") for i in range(150)]
    assert recall(spark, {i: " ".join(x) for i, x in enumerate([*second, *first, base])}) >= 0.98


def test_recall_under_a_passage_in_all_texts(spark):
    """A passage of three quarters of each text; pairs of copies just within 0.8, and small groups."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(200)]
    texts = []
    for i in range(120):
        own = [f"o{i}-{k}" for k in range(66)]
        texts.append(passage + own)
        texts += [passage + changed(rng, own, rng.randint(1, 5), f"x{i}-{k}") for k in range(rng.randint(0, 3))]
    rng.shuffle(texts)
    assert recall(spark, {i: " ".join(x) for i, x in enumerate(texts)}) >= 0.98


def band_groups(texts):
    """The least id of each text's group by all pairs that share a band at a similarity of 0.8."""
    keys, near = {}, near_pairs(texts)
    for i, x in texts.items():
        keys[i] = set(enumerate(near_copies.bands(near_copies.shingles(x.encode()))))
    got = {}
    for root in sorted(texts):
        todo = [root] * (root not in got)
        while todo:
            if (i := todo.pop()) not in got:
                got[i] = root
                todo += [j for j in near[i] if keys[i] & keys[j]]
    return got


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Chains of copies whose links mostly miss the leaders of their keys, in many keys beside a passage."""
    monkeypatch.setattr(near_copies, "FEW", 2)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rng = random.Random(8)
    passage, texts = [f"p{i}" for i in range(60)], []
    for c in range(12):
        chain = [passage + [f"c{c}-{i}" for i in range(60)]]
        for k in range(10):
            chain.append(changed(rng, chain[-1], 2, f"x{c}-{k}"))
        texts += chain
    rng.shuffle(texts)
    texts = {i: " ".join(x) for i, x in enumerate(texts)}
    got = {r["doc_id"]: r["component_id"] for r in near_copies.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = band_groups(texts)
    assert len(set(want.values())) < 40 and sum(got[i] != want[i] for i in texts) == 0


def test_driver_gets_no_rows_by_shingle(spark, monkeypatch):
    """Sets of crowded keys that are joined by their rarest shingles: the driver takes the shingles' counters in columns."""
    monkeypatch.setattr(near_copies, "FEW", 2)
    rng = random.Random(8)
    passage, texts = [f"p{i}" for i in range(60)], []
    for c in range(12):
        chain = [passage + [f"c{c}-{i}" for i in range(60)]]
        for k in range(10):
            chain.append(changed(rng, chain[-1], 2, f"x{c}-{k}"))
        texts += chain
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    taken, frame, counted = [], type(df), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: (got := f(self), taken.append(len(got)))[0])
    monkeypatch.setattr(near_copies, "prefixes", lambda *a, f=near_copies.prefixes: (counted.append(1), f(*a))[1])
    near_copies.copies(df)
    assert counted and max(taken, default=0) <= 64 * 64


def test_pipeline_drops_copies_at_similarity(spark, docs):
    """No kept pair at a five-word Jaccard of 0.8, none dropped without a chain of such links; keys of more sets than are expanded."""
    import corpus_pipeline

    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    crowd = []
    for i in range(60):  # copies of which many differ from each other by more than 0.8 allows
        one = list(words)
        for at in rng.sample(range(120), rng.randint(0, 3)):
            one[at] = f"x{i}-{at}"
        crowd.append((1000 + i, " ".join(one)))
    made = spark.createDataFrame([*crowd, (None, " ".join(words)), (2000, None), (2001, " "), (2002, "one two")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(made)
    texts = {(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None}
    near, want = near_pairs(dict(texts)), near_copy_groups(dict(texts))
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    named = {i for i in kept if i is not None}
    assert kept.count(None) == 1 and not any(near[i] & named for i in named) and named >= want
    assert named & set(range(1000)) == want & set(range(1000))


# --- 4: mixture


def test_draws_invert_the_distribution(spark, docs):
    mixed = poisson_mix.mix(docs, {"src0": 0.5})
    rate = {r["source"]: r["rate"] for r in poisson_mix.rates(docs, {"src0": 0.5}).collect()}
    u = {r[0]: r[1] for r in docs.select("doc_id", poisson_mix.uniform(F.col("doc_id"), poisson_mix.SEED, F.lit(1))).collect()}
    want = {r["doc_id"]: poisson_mix.expected_copies(rate[r["source"]], u[r["doc_id"]]) for r in docs.select("doc_id", "source").collect() if rate[r["source"]] <= poisson_mix.STEP}
    got = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert all(got[i] == n for i, n in want.items())


def test_shares_reach_their_targets(spark, docs):
    """Rows without an id, and sources in a third of all rows, too."""
    many = docs.where("text IS NOT NULL").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    many = many.select("lang", "n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "source", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"), F.substring("text", 1, 60).alias("t"))
    many = many.withColumns({"text": F.concat_ws(" ", "t", "k", "doc_id", F.xxhash64("t", "k").cast("string")), "doc_id": F.col("doc_id") * 100 + F.col("k")}).drop("t", "k")
    n = many.count()
    targets = {"hot": 0.1, "s1": 0.5}
    got = {r["source"]: r["n"] for r in poisson_mix.mix(many, targets).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    for s, w in targets.items():
        copies = poisson_mix.rates(many, targets).where(F.col("source") == s).collect()[0]["rate"]
        assert abs(got[s] - w * n) < 5 * np.sqrt(w * n * max(1, copies))
    assert abs(sum(got.values()) - n) < 6 * np.sqrt(3 * n)
    null = poisson_mix.mix(many.where("doc_id IS NULL"), epochs=1.0)
    assert abs(null.count() - many.where("doc_id IS NULL").count()) < 6 * np.sqrt(n)
    keys = null.select("shuffle_key").distinct().count()
    assert keys > 0.5 * null.count()


def test_weights_are_checked(spark, docs):
    for bad in ({"src0": 0.9, "src1": 0.9}, {"src0": -0.1}, {"src0": float("nan")}, {"no such": 0.5, "src0": 0.1}):
        with pytest.raises(ValueError):
            poisson_mix.mix(docs, bad)
    assert poisson_mix.mix(docs, {"no such": 0.5, "src0": 0.1}, absent="spread").count() > 0


def test_high_rates_reach_their_mean(spark, docs):
    n = docs.count()
    many = poisson_mix.mix(docs, epochs=90.0).count()
    assert abs(many - 90 * n) < 6 * np.sqrt(90 * n)


def test_salted_join_gives_the_same(spark, docs, edge, nothing):
    a = rows(poisson_mix.mix(docs), "doc_id", "copy_no", "shuffle_key")
    assert a == rows(poisson_mix.mix(docs, broadcast_sources=0), "doc_id", "copy_no", "shuffle_key")
    assert poisson_mix.mix(nothing).count() == 0
    out = poisson_mix.mix(edge)
    assert set(out.columns) == set(edge.columns)
    assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in edge.select("doc_id").collect()}


def test_rows_are_dealt_before_joins(spark, docs):
    """Above the join by shuffling nothing hangs on the order of rows, which a repeated task needn't keep."""
    plan = poisson_mix.mix(docs, broadcast_sources=0)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "monotonically_increasing_id" not in above and "monotonically_increasing_id" in below


def test_order_is_a_shuffle(spark, docs):
    mixed = poisson_mix.mix(docs, epochs=3.0)
    ids = [r["doc_id"] for r in mixed.orderBy("shuffle_key").collect()]
    assert ids != sorted(ids) and abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.15


# --- 5: quality


def test_quality_base_columns(spark, docs, edge, nothing):
    for df in (docs, edge, nothing):
        got = rows(weak_quality.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((r["doc_id"], *quality_base(r["text"])) for r in df.select("doc_id", "text").collect()), key=key)
    assert weak_quality.judge(docs).where("base_failed AND kept").count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label")).dropDuplicates(["doc_id"])
    t = weak_quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").toPandas()
    good, bad = t[t.label == 1], t[t.label == 0]
    assert good.kept.mean() >= 0.97 and bad.kept.mean() <= 0.05


@pytest.mark.parametrize("junk", [0.1, 0.5, 0.75])
@pytest.mark.parametrize("n", [78, 250])
def test_quality_whatever_share_is_junk(spark, junk, n):
    """Also where most documents are bad, and few in all."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label")).dropDuplicates(["doc_id"])
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id")
    held = docs.select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string"))).toPandas()
    bad = held[held.label == 0].head(int(n * junk))
    ids = [*map(int, bad.doc_id), *map(int, held[held.label == 1].head(int(len(bad) / junk) - len(bad)).doc_id)]
    t = weak_quality.judge(docs.where(F.col("doc_id").isin(ids))).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert t[t.label == 1].kept.mean() >= 0.97 and (t[t.label == 0].kept.mean() <= 0.05 or not len(t[t.label == 0]))


def test_quality_ties_are_kept(spark, docs):
    got = weak_quality.judge(docs, rounds=0, keep=weak_quality.PRIOR).where("NOT base_failed")
    assert got.where("quality = 0.9").count() == got.where("quality = 0.9 AND kept").count() > 0


# --- 7: shards


def test_shards_hold_each_row_once(spark, docs, tmp_path):
    t = size_tiered.ShardedTable(spark, f"{tmp_path}/t", arrival_rows=10, target_bytes=300_000, fan_in=3)
    assert t.version() == 0 and t.read(docs.schema).count() == 0
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    assert t.append(first) == 1
    before = t.manifest(1).count()
    assert t.append(second) == 2
    last = t.settle(docs.schema)
    assert last > 2 and t.manifest().count() < before
    assert rows(t.read(docs.schema), "doc_id") == rows(docs, "doc_id")
    assert rows(t.read(docs.schema, 1), "doc_id") == rows(first, "doc_id")  # an older version reads as it was
    assert t.compact(docs.schema) is None
    assert t.manifest().agg(F.sum("n_rows")).collect()[0][0] == docs.count()


def test_uncommitted_versions_do_not_exist(spark, docs, tmp_path):
    """Whatever a lost writer has left behind, the table is as it was and takes the next append."""
    t = size_tiered.ShardedTable(spark, f"{tmp_path}/t")
    t.append(docs.limit(20))
    docs.limit(5).write.parquet(f"{tmp_path}/t/data/a00000002-lost")  # lost after the data
    t.manifest(1).write.parquet(f"{tmp_path}/t/manifests/0000000002-lost")  # lost after the manifest
    os.makedirs(f"{tmp_path}/t/commits", exist_ok=True)
    with open(f"{tmp_path}/t/commits/_lost", "w") as f:  # lost before the rename
        f.write("0000000002-lost")
    assert t.version() == 1 and t.read(docs.schema).count() == 20
    assert t.append(docs.limit(7)) == 2 and t.read(docs.schema).count() == 27


def test_writers_that_race_for_a_version(spark, docs, tmp_path, monkeypatch):
    """The later commit goes on from the earlier one's version; no row is lost or doubled."""
    a, b = (size_tiered.ShardedTable(spark, f"{tmp_path}/t", arrival_rows=5, target_bytes=100_000, fan_in=2) for _ in "ab")
    a.append(docs.limit(40))
    real = size_tiered.ShardedTable._commit

    def beaten(self, shards, base, other):
        monkeypatch.setattr(size_tiered.ShardedTable, "_commit", real)
        other()
        return real(self, shards, base)

    for write, other in ((lambda: a.append(docs.limit(10)), lambda: b.append(docs.limit(3))), (lambda: a.compact(docs.schema), lambda: b.append(docs.limit(2))), (lambda: a.append(docs.limit(4)), lambda: b.compact(docs.schema)), (lambda: a.compact(docs.schema), lambda: b.settle(docs.schema))):
        before, n = a.version(), a.read(docs.schema).count()
        monkeypatch.setattr(size_tiered.ShardedTable, "_commit", lambda self, shards, base, other=other: beaten(self, shards, base, other))
        write()
        assert a.version() > before + 1 or n == 59
    assert a.read(docs.schema).count() == 40 + 10 + 3 + 2 + 4
    assert a.versions() == list(range(1, a.version() + 1))


def test_claims_are_made_once(spark, tmp_path):
    assert common.claim(spark, f"{tmp_path}/x/1", "one") and not common.claim(spark, f"{tmp_path}/x/1", "two")
    assert common.note_at(spark, f"{tmp_path}/x/1") == "one" and common.names_in(spark, f"{tmp_path}/x") == ["1"]
    assert common.names_in(spark, f"{tmp_path}/none") == [] and not common.exists(spark, f"{tmp_path}/x/2")


def test_expired_versions_leave_the_last_one_whole(spark, docs, tmp_path):
    t = size_tiered.ShardedTable(spark, f"{tmp_path}/t", arrival_rows=10, target_bytes=300_000, fan_in=3)
    t.append(docs)
    t.settle(docs.schema)
    t.append(docs.limit(12))
    live = {r["shard"] for r in t.manifest().collect()}
    t.expire()
    assert t.versions() == [t.version()] and len(os.listdir(f"{tmp_path}/t/manifests")) == 1
    files = {os.path.relpath(f, f"{tmp_path}/t/data") for f in glob.glob(f"{tmp_path}/t/data/*/*.parquet")}
    assert files == live and t.read(docs.schema).count() == docs.count() + 12


@pytest.mark.parametrize("late", [False, True])
def test_a_version_expired_during_an_append(spark, docs, tmp_path, monkeypatch, late):
    """The append goes on from the version that took its place, whether the note or the manifest is gone."""
    a, b = (size_tiered.ShardedTable(spark, f"{tmp_path}/t", arrival_rows=5) for _ in "ab")
    a.append(docs.limit(20))
    real = size_tiered.ShardedTable.manifest

    def overtaken(self, version=None):
        monkeypatch.setattr(size_tiered.ShardedTable, "manifest", real)
        before = real(self, version) if late else None
        b.append(docs.limit(3))
        b.expire()
        return before if late else real(self, version)

    monkeypatch.setattr(size_tiered.ShardedTable, "manifest", overtaken)
    assert a.append(docs.limit(7)) == 3
    assert a.read(docs.schema).count() == 30 and a.versions() == [2, 3]


def test_merge_plan_against_a_plain_one(spark, tmp_path):
    """Groups of a tier in order of age, cut at the target, merged from FAN_IN shards or a full target on."""
    rng = random.Random(5)
    t = size_tiered.ShardedTable(spark, f"{tmp_path}/t", target_bytes=1 << 20, fan_in=3)
    shards = [(f"a/{i:04d}", None, 1, rng.choice([rng.randrange(1, 1 << 17), rng.randrange(1, 1 << 21)]), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(shards, size_tiered.MANIFEST).withColumn("tier", t._tier(F.col("n_bytes")))
    tiers = {}
    for r in df.where(f"n_bytes < {1 << 19}").orderBy("run", "shard").collect():
        tiers.setdefault(r["tier"], []).append(r)
    want = set()
    for rows_ in tiers.values():
        at, parts = 0, {}
        for r in rows_:
            parts.setdefault(at // (1 << 20), []).append(r)
            at += r["n_bytes"]
        for p in parts.values():
            if len(p) >= 3 or len(p) > 1 and sum(r["n_bytes"] for r in p) >= 1 << 20:
                want.add(frozenset(r["shard"] for r in p))
    got = {}
    for r in t.plan(df).collect():
        got.setdefault(r["grp"], set()).add(r["shard"])
    assert set(map(frozenset, got.values())) == want and want


def test_shards_of_edge_cases(spark, edge, nothing):
    for df in (edge, nothing):
        t = size_tiered.shard(df)
        out = size_tiered.assignment(t, df.schema, df.columns)
        assert rows(out, "doc_id") == rows(df, "doc_id") and len({c.lower() for c in out.columns}) == len(out.columns)


# --- 10: decontamination

ITEM = "If a train leaves Dover at 40 km per hour and another leaves Calais at 60 km per hour when do they meet on the 300 km line"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"Some words before. {ITEM} And after it, more words.", "verbatim"),
        (f"All before. {ITEM.upper()} and after", "verbatim"),
        (ITEM.lower(), "verbatim"),
        (ITEM.lower().replace("40", "1,250.5").replace("60", "80").replace("300", "9"), "re-parameterised"),
        (ITEM.replace("40", "55").replace("60", "80").replace("300", "940").replace("Dover", "Lyon").replace("Calais", "Ghent"), "re-parameterised"),
        (ITEM.replace("40 km", "4,050.5km").replace("Dover", "San Marino").replace("Calais", "Val d"), "re-parameterised"),
        ("If a train leaves the yard it may be late. " * 5, None),
        (ITEM[:60], None),
        (None, None),
        ("", None),
    ],
)
def test_template_matches(spark, text, kind):
    docs = spark.createDataFrame([(1, text), (None, text), (2, "something else entirely, of no interest to anyone at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM), (9, ITEM), (None, "x"), (8, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in template_decontam.contaminated(docs, bench).collect()] == ([(1, 9, kind)] if kind else [])


def test_slots_must_change_alike(spark):
    """A name that changes in many ways tells a list of similar phrases from a question put anew; numbers stand for themselves."""
    item = "give the box that Tom holds to the boy then tell the aunt that Tom was kind and wait until 5 more boxes reach Tom with 5 bows"
    docs = {1: item.replace("Tom", "Ann Lee"), 2: item.replace("5 more", "7 more").replace("5 bows", "9 bows"), 3: item.replace("Tom", "Ann", 1).replace("Tom was", "Eve was")}
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = template_decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench)
    assert rows(found, "doc_id", "kind") == [(1, "re-parameterised"), (2, "re-parameterised")]


SHORT_ITEMS = ["Who wrote Hamlet?", "Name the largest moon.", "What boils at 100?", "Define entropy", "Is 7 prime?"]


def test_short_items_inside_documents(spark):
    """Items of three and four tokens are found in any case wherever they stand; shorter ones, or with less plain text, where they are the document."""
    bench = spark.createDataFrame(list(enumerate(SHORT_ITEMS)), "item_id long, text string")
    docs = [(10 * i + k, f(x)) for i, x in enumerate(SHORT_ITEMS) for k, f in enumerate((lambda x: f"A quiz of ours asks: {x} And then some more.", lambda x: f"a quiz, {x.upper()} then", lambda x: x.lower()))]
    docs.append((99, "who wrote the play and named the largest boat at 100"))
    found = template_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert rows(found, "doc_id", "item_id") == [(0, 0), (1, 0), (2, 0), (10, 1), (11, 1), (12, 1), (20, 2), (21, 2), (22, 2), (32, 3), (42, 4)]


def test_items_of_another_case_are_found(spark, data):
    """Every benchmark item, in upper, lower and title case within another text."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [(i * 10 + k, f"Words of our own go before it, {f(t)} and some others after.") for i, t in items for k, f in enumerate((str.upper, str.lower, str.title))]
    found = template_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{data}/benchmark.parquet"))
    hit = set(rows(found, "doc_id", "item_id")) & {(i * 10 + k, i) for i, _ in items for k in range(3)}
    assert len(hit) >= 0.95 * len(docs)  # letters such as sharp s are spelt anew in another case
    assert hit >= {(i * 10 + k, i) for i, t in items for k in range(3) if t.upper().lower() == t.lower()}


def test_values_stand_by_their_tokens(spark):
    """The tokens with values and the template tokens are one for one."""
    texts = ["Tom Ann paid 1,200.50usd for 5km, in May 2020. iPhone7 X", "ÀB 3.4.5 cÉd 7Kg \ue000 x", "", "  ", "km 5 km 6 mm 7", "A1 B2,3 C"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    for form in template_decontam.FORMS:
        own = template_decontam.template(template_decontam.numbered(F.col("text")), form)
        for r in df.select(own.alias("t"), template_decontam._bare(template_decontam.valued(F.col("text"), form)).alias("v")).collect():
            assert r["t"] == r["v"]


def test_long_runs_take_no_stack(spark):
    """Names, numbers and words without end, in texts of 100,000 tokens."""
    texts = ["To " * 100_000, "1,2" * 100_000, "A1" * 100_000, "x" * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert template_decontam.contaminated(df, bench).count() == 0


def test_clashing_names_with_a_hit(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("h", "form", "item_id", "kind", "w", "t", "r", "at", "size")})
    found = template_decontam.contaminated(docs, spark.createDataFrame([(9, ITEM, "x")], "item_id long, text string, form string"))
    assert rows(found, "doc_id", "item_id", "kind") == [(1, 9, "verbatim")]


def test_decontamination_without_broadcast(spark, docs, data, edge, nothing):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    cols = ("doc_id", "item_id", "n_windows", "kind")
    want = rows(template_decontam.contaminated(docs, bench), *cols)
    assert want == rows(template_decontam.contaminated(docs, bench, broadcast_keys=0), *cols) and want == rows(template_decontam.contaminated(docs, bench, broadcast_keys=0, broadcast_hashes=0), *cols)
    assert template_decontam.contaminated(edge, bench).count() == 0
    assert template_decontam.contaminated(nothing, bench).count() == 0
    assert template_decontam.contaminated(docs, bench.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stage_by_stage(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(p.STAGES)
    kept = stages["language ID"](spark, docs, data)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    single = stages["SimHash near-dedup"](spark, kept, data)
    assert rows(single, "doc_id") == [(i,) for i in sorted(near_copy_groups({r["doc_id"]: r["text"] for r in kept.collect()}))]
    clean = stages["benchmark decontamination"](spark, single, data)
    bench = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in single.collect() if any(" ".join(b.split()) in " ".join((r["text"] or "").split()) for b in bench)}
    assert {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()} >= dirty
    assert clean.count() >= single.count() - 2 * len(dirty) - 1
    mixed = stages["mixing to target weights"](spark, clean, data)
    assert mixed.columns == docs.columns
    sharded = stages["sharding"](spark, mixed, data)
    assert rows(sharded, "doc_id") == rows(mixed, "doc_id")
    assert rows(p.run(spark, data), "doc_id") == rows(mixed, "doc_id")


def test_pipeline_takes_edge_cases(spark, edge_dir):
    import corpus_pipeline as p

    assert p.run(spark, edge_dir).count() > 0


def test_stages_define_edge_cases(spark, data, docs, edge, nothing):
    """Each stage on null, empty, long and repeated rows with clashing columns, and on an empty table."""
    import corpus_pipeline as p

    clashes = [c for c in edge.columns if c not in docs.columns]
    df = docs.withColumns({c: F.lit("y") for c in clashes} | {"doc_id": F.col("doc_id") + 1000}).unionByName(edge)
    df = common.written(df, "edge-rows")
    count = lambda d: Counter((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    given = count(df)
    bare = {(1, None), (2, ""), (3, " \n\t ")}
    texts = {(i, t) for i, t in given if t is not None}
    out = {}
    for name, stage in p.STAGES:
        made = stage(spark, df, data)
        if name != "sharding":
            assert made.columns == df.columns
        out[name] = count(made)
        if name != "mixing to target weights":
            assert all(out[name][k] in (0, given[k]) for k in given) and out[name].keys() <= given.keys()
    assert not bare & out["language ID"].keys() and len(out["language ID"]) > 0.9 * len(texts)
    single = out["SimHash near-dedup"]
    words = "the same words in the same order, twice over"
    assert (5, words) in single and (6, words) not in single and any(i is None for i, _ in single) and sum(k in single for k in bare) == 1
    assert {k for k in given if k in bare or k[0] in (None, 4, 5, 6, 7)} <= out["benchmark decontamination"].keys()
    assert out["mixing to target weights"].keys() <= given.keys() and out["sharding"] == given
    for _, stage in p.STAGES:
        assert stage(spark, nothing.withColumns({c: F.lit("x") for c in clashes}), data).count() == 0
