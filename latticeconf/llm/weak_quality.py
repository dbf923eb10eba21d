"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on every document.
Expectation-maximisation over the counts of vote patterns (3 ** rules rows at
most, whatever the corpus) estimates how often each rule votes good on good and
on bad documents; the posterior probability of quality then replaces a filter
that demands that all rules pass. Two bounds tie the class called good to goodness,
whatever share of the corpus is junk: a rule that votes on a good document votes
good with probability TRUST at least, and on a bad one bad with probability CATCH
at least, so that each rule is better than chance.

Native: features are expressions over one row (no shuffle; a text is never
exploded), pattern counts are one partially aggregated groupBy, read once (6,561
rows at most), and the posterior is an expression over the votes.

Defined cases: null and empty texts have no words and fail the base rule;
repeated rows vote alike; equal posteriors are kept from KEEP on; texts of any
length are evaluated whole; windows are compared by 64-bit hash within one text;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, written

KEEP = 0.5
ROUNDS = 12
PRIOR = 0.9
#: Least probability of a good vote of a rule on a good document, and of a bad vote on a bad one, given that it votes.
TRUST, CATCH = 0.99, 0.2
#: Each kind of junk should trip two rules: EM tells a class of bad documents by
#: votes that go together, and can't see junk that a single rule knows of.
#: (good, bad) conditions on the features; neither: the rule abstains. Valid in Spark and in DuckDB.
RULES = {
    "length": ("n_words >= 100", "n_words < 50"),
    "symbols": ("n_symbols = 0", "50 * n_symbols > word_chars"),
    "plain": ("100 * n_plain >= 92 * word_chars", "100 * n_plain < 90 * word_chars"),
    "dup_lines": ("n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("5 * n_repeat_words <= n_words", "2 * n_repeat_words > n_words"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 12 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "capitals": ("10 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    "shouts": ("n_shouts = 0", "10 * n_shouts > n_words"),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain", "n_capitals", "n_shouts")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(w: Column) -> Column:
        twin = lambda x, k, step: F.coalesce(F.get(w, k + step)["h"] == x["h"], F.lit(False))
        found = F.filter(w, lambda x, k: twin(x, k, -1) | twin(x, k, 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(words) < 4, 0).otherwise(let(F.sort_array(windows), covered))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES, all long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(F.col("doc_id").cast("long"), text.alias("t")).select(
        "doc_id",
        let(F.array_remove(F.split("t", ASCII_SPACE), ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[\p{L}\p{N}]")).alias("n_plain"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).alias("n_shouts"),
    )
    return out.select("doc_id", *(F.expr({"n_words": "w.n_words", "word_chars": "w.word_chars", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines"}.get(c, c)).cast("long").alias(c) for c in FEATURES))


def _vote(good: str, bad: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def _posterior(prior: float, good: dict[str, float], bad: dict[str, float]) -> str:
    """SQL for P(good | votes) with the given shares of good votes."""
    terms = [f"CAST({math.log(prior / (1 - prior))!r} AS DOUBLE)"]
    for r in RULES:
        up, down = _weight(good[r], bad[r], 1), _weight(good[r], bad[r], -1)
        terms.append(f"CASE v_{r} WHEN 1 THEN CAST({up!r} AS DOUBLE) WHEN -1 THEN CAST({down!r} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


#: Start of EM: a document without any bad vote is likely good.
_START = f"CASE WHEN least({', '.join(f'v_{r}' for r in RULES)}) < 0 THEN 0.1D ELSE {PRIOR}D END"


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> str:
    """SQL for the posterior after EM on (v_rule.., n), one row a pattern."""
    rows = sorted(([r[f"v_{k}"] for k in RULES], r["n"]) for r in patterns.collect())
    total = sum(n for _, n in rows)
    if not total or not rounds:
        return _START
    p = [0.1 if min(v) < 0 else PRIOR for v, _ in rows]
    for _ in range(rounds):
        good, bad = {}, {}
        for i, r in enumerate(RULES):
            up = [n * x for (v, n), x in zip(rows, p, strict=True) if v[i] == 1]
            all_good = [n * x for (v, n), x in zip(rows, p, strict=True) if v[i]]
            down = [n * (1 - x) for (v, n), x in zip(rows, p, strict=True) if v[i] == 1]
            all_bad = [n * (1 - x) for (v, n), x in zip(rows, p, strict=True) if v[i]]
            good[r] = max(TRUST, (sum(up) + 1) / (sum(all_good) + 2))
            bad[r] = min(1 - CATCH, (sum(down) + 1) / (sum(all_bad) + 2))
        prior = (sum(n * x for (_, n), x in zip(rows, p, strict=True)) + 1) / (total + 2)
        start = math.log(prior / (1 - prior))
        p = [1 / (1 + math.exp(-start - sum(_weight(good[r], bad[r], x) for r, x in zip(RULES, v, strict=True)))) for v, _ in rows]
    return _posterior(prior, good, bad)


def _weight(good: float, bad: float, vote: int) -> float:
    return math.log(good / bad) if vote > 0 else math.log((1 - good) / (1 - bad)) if vote < 0 else 0.0


def judge(docs: DataFrame, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """doc_id, FEATURES, the votes, quality (posterior), base_failed and kept."""
    voted = written(features(docs).select("*", *(F.expr(_vote(*RULES[r])).alias(f"v_{r}") for r in RULES)), "weak-votes")
    patterns = written(voted.groupBy(*(f"v_{r}" for r in RULES)).agg(F.count(F.lit(1)).alias("n")), "weak-patterns")
    quality = F.expr(estimate(patterns, rounds))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return voted.select("*", quality.alias("quality"), failed.alias("base_failed"), (~failed & (quality >= keep)).alias("kept"))


def oracle(rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in DuckDB, with EM's rounds as a chain of subqueries."""
    space = r"[\x20\x09-\x0D]+"
    votes = ", ".join(f"{_vote(*RULES[r])} AS v_{r}" for r in RULES)
    names = ", ".join(f"v_{r}" for r in RULES)
    sql = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 3),
g3 AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s FROM g),
d3 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g3) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d3, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
      (length(t) - length(regexp_replace(t, '[\p{{L}}\p{{N}}]', '', 'g')))::BIGINT AS n_plain,
      (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts
      FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
v AS (SELECT *, {votes} FROM f),
pat AS (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
e0 AS (SELECT *, CASE WHEN least({names}) < 0 THEN 0.1::DOUBLE ELSE {PRIOR}::DOUBLE END AS p FROM pat)"""
    for k in range(rounds):
        sums = ", ".join(f"(sum(n * {w}) FILTER (WHERE v_{r} = 1) + 1) / (sum(n * {w}) FILTER (WHERE v_{r} <> 0) + 2) AS {a}_{r}" for r in RULES for a, w in (("g", "p"), ("b", "(1 - p)")))
        fall = sums.replace("(sum(", "(coalesce(sum(").replace(" = 1) + 1)", " = 1), 0) + 1)").replace(" <> 0) + 2)", " <> 0), 0) + 2)")
        held = ", ".join(f"greatest({TRUST}, g_{r}) AS g_{r}, least({1 - CATCH}, b_{r}) AS b_{r}" for r in RULES)
        terms = " + ".join(f"CASE v_{r} WHEN 1 THEN ln(g_{r} / b_{r}) WHEN -1 THEN ln((1 - g_{r}) / (1 - b_{r})) ELSE 0 END" for r in RULES)
        sql += f""",
m{k} AS (SELECT prior, {held} FROM (SELECT (sum(n * p) + 1) / (sum(n) + 2) AS prior, {fall} FROM e{k})),
e{k + 1} AS (SELECT {names}, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {terms}))) AS p FROM pat, m{k})"""
    return sql + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {keep} AS kept, round(p, 6) AS quality
FROM (SELECT v.*, e.p, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v JOIN e{rounds} e USING ({names}))"""
