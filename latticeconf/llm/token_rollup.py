"""Token counts as delta-maintained rollups.

A batch of changes carries documents with their old and new counts: an insert
adds, a delete takes away, a revision does both (also when the source, language
or tokenizer version changes). A batch is first reduced to signed sums by
(source, lang, tokenizer), which are additive, and written as one immutable
delta under a name of its own; a small file named by the batch's id, put in place by
one exclusive rename, names the delta and makes it count. That name is never given
up, so a batch id counts once, whoever sends it, however often and however late: a
second writer's rename fails and its delta isn't read. Totals are the last snapshot
and the deltas since; snapshot() folds these into the next one and notes each as
folded, so that deltas read don't grow with the number of batches; names listed do.

Only signed sums are kept, so a delta's size is the number of groups, not of
documents. Hot sources are pre-aggregated by every task before the shuffle.

Tokens are counted per text in Arrow batches; the vocabulary file is a parameter
and is sent to the executors as a broadcast of a few hundred kB.

Defined cases: null text has no tokens and no characters but counts as a
document; null source or lang is a group of its own; repeated rows count again;
texts of any length are counted whole, in slices cut at white space; extra
columns are ignored; an empty batch commits an empty delta.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, exists, names_in, note_at, removed, shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
_SLICE = 1 << 18
_KNOWN = 1 << 18


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank from a .tiktoken file's lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


class BpeCounter:
    """Counts tokens of byte-level BPE; pieces seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.known = regex.compile(PATTERN).findall, {}

    def count(self, text: str | None) -> int:
        total, known = 0, self.known
        for s in _slices(text or ""):
            for piece in self.pieces(s):
                n = known.get(piece)
                if n is None:
                    if len(known) >= _KNOWN:
                        known.clear()
                    n = len(self.encoding.encode_ordinary(piece))
                    if len(piece) < 64:
                        known[piece] = n
                total += n
        return total


_CUT = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")


def _slices(text: str) -> Iterator[str]:
    """The text in pieces of about _SLICE characters, cut where no token crosses: before a space and a letter."""
    at = 0
    while len(text) - at > 2 * _SLICE:
        m = _CUT.search(text, at + _SLICE, at + 2 * _SLICE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, source, lang, tokenizer, docs, tokens, chars, bytes), a row for each document."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = BpeCounter(ranks_of(held.value))
        for pdf in batches:
            tokens = [counter.count(t) for t in pdf.pop("text")]
            yield pdf.assign(tokens=pd.Series(tokens, dtype="int64"))[["doc_id", "source", "lang", "chars", "bytes", "tokens"]]

    rows = docs.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.col("text").cast("string"))
    out = rows.mapInPandas(count, "doc_id long, source string, lang string, chars long, bytes long, tokens long")
    return out.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), "tokens", "chars", "bytes")


def signed(new: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """One batch's delta: new counts add, old ones are taken away."""
    parts = [df.select(*KEYS, *((F.lit(sign) * F.col(c)).alias(c) for c in SUMS)) for df, sign in ((new, 1), (old, -1)) if df is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))


class TokenRollup:
    """Totals by source, language and tokenizer version below a shared root."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_dir(spark, "token-rollup")).rstrip("/")

    def _snapshot(self) -> dict:
        """The last snapshot's number, its folder (none before the first) and the batches that it has folded in."""
        last = max(names_in(self.spark, f"{self.root}/snapshots"), default="")
        return json.loads(note_at(self.spark, f"{self.root}/snapshots/{last}")) | {"at": int(last)} if last else {"at": 0, "data": None, "folded": []}

    def _open(self, snapshot: dict) -> list[str]:
        """Committed batches that the snapshot doesn't hold."""
        folded = {*snapshot["folded"], *names_in(self.spark, f"{self.root}/folded")}
        return [b for b in names_in(self.spark, f"{self.root}/claims") if b not in folded]

    def is_committed(self, batch_id: str) -> bool:
        return exists(self.spark, f"{self.root}/claims/{batch_id}")

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Adds a batch once; False if it had been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][\w-]*", batch_id):
            raise ValueError("a batch id consists of letters, digits, _ and -, and starts with a letter or digit")
        if self.is_committed(batch_id):
            return False
        name = f"{batch_id}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.root}/deltas/{name}")
        if not claim(self.spark, f"{self.root}/claims/{batch_id}", name):
            removed(self.spark, f"{self.root}/deltas/{name}")
            return False
        return True

    def _paths(self, snapshot: dict, batches: list[str]) -> list[str]:
        paths = [f"{self.root}/deltas/{note_at(self.spark, f'{self.root}/claims/{b}')}" for b in batches]
        return paths + ([f"{self.root}/snapshot-data/{snapshot['data']}"] if snapshot["data"] else [])

    def _sums(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        sums = self.spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        return sums.where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def totals(self) -> DataFrame:
        """Sums over the committed batches; groups that came to nothing are left out."""
        while True:
            snapshot = self._snapshot()
            paths = self._paths(snapshot, self._open(snapshot))
            if self._snapshot()["at"] == snapshot["at"]:  # else another was made meanwhile, whose batches may be noted as folded
                return self._sums(paths)

    def snapshot(self) -> bool:
        """Folds the batches since the last snapshot into a new one; False if another writer did meanwhile.

        Run by one maintainer at a time, as no batch may be folded twice: the
        snapshot's own exclusive rename sees to it. Readers and committing writers
        needn't wait.
        """
        last = self._snapshot()
        self._put_away(last)  # in case the one before was cut short
        batches = self._open(last)
        name = uuid.uuid4().hex
        self._sums(self._paths(last, batches)).coalesce(1).write.parquet(f"{self.root}/snapshot-data/{name}")
        if not claim(self.spark, f"{self.root}/snapshots/{last['at'] + 1:010d}", json.dumps({"data": name, "folded": batches})):
            removed(self.spark, f"{self.root}/snapshot-data/{name}")
            return False
        self._put_away({"folded": batches})
        return True

    def _put_away(self, snapshot: dict) -> None:
        for b in snapshot["folded"]:
            if not exists(self.spark, f"{self.root}/folded/{b}"):
                claim(self.spark, f"{self.root}/folded/{b}", "")


def _revised(docs: DataFrame, vocabulary: str, tokenizer: str) -> tuple[TokenRollup, DataFrame, DataFrame]:
    """A rollup with the batches load and revise, and the documents' counts of now and at first.

    load inserts every document under a first tokenizer version, that of plain
    bytes; revise moves every document to the BPE's counts.
    """
    rollup = TokenRollup(docs.sparkSession)
    now = written(counted(docs, vocabulary, tokenizer), "token-counts")
    first = now.withColumn("tokens", F.col("bytes")).withColumn("tokenizer", F.lit("bytes"))
    rollup.commit("load", signed(new=first))
    rollup.commit("revise", signed(new=now, old=first))
    return rollup, now, first


def rollup_of(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Totals of all documents, those of no tokens too, after four batches, a snapshot and two retries.

    After load and revise a snapshot is taken; withdraw deletes documents of no
    tokens and restore inserts them again; revise and withdraw are sent again and
    skipped.
    """
    rollup, now, first = _revised(docs, vocabulary, tokenizer)
    rollup.snapshot()
    empty = now.where("tokens = 0")
    rollup.commit("withdraw", signed(old=empty))
    rollup.commit("restore", signed(new=empty))
    rollup.commit("revise", signed(new=now, old=first))
    rollup.commit("withdraw", signed(old=empty))
    return rollup.totals()
