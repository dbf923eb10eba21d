"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair does so.

A document's two encodings are cut into groups at the byte offsets where tokens of
both end; tokens whose byte ranges overlap are linked. A link's pair of ids is
packed into one int64 (first id in the high half). How many documents hold a pair is
counted over the whole corpus:

1. `aligned`: one pass over the texts encodes them and writes each document's
   distinct keys with their times; the tokenizers run once.
2. `pair_shards`: np.unique sums the keys of each partition, a range partitioning
   sorts these partial counts globally, and one scan of each range sums runs of
   equal keys, writing a shard: two flat files, sorted keys and their counts.
3. `best_links`: each task maps the shards into memory and looks its documents'
   keys up with searchsorted. Shards are paged in where they are touched; the
   driver holds the list of shards and a number for each id of the first vocabulary.

Scale. One shuffle, of partial counts: a key that every document holds has one row a
task. Tasks write shards under names of their own and report them, so a repeated
task leaves a file that nobody reads, never a half-written one. On a file system
that isn't mounted a task copies a shard to its own disk before mapping it.

Defined cases: null and empty texts, invalid UTF-8, and texts whose joined tokens
aren't the text with a space before it (such as those holding U+2581) have no
tokens: zeros and an empty groups_sha256. Repeated rows count as documents of their
own; a null doc_id stays null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed_slots, shared_dir, written

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HELD = 1 << 22  # keys that a task sums at a time
SLICE = 256  # documents looked up at a time
SEGMENT = 1 << 20  # characters of a text that the tokenizers get at a time
#: A space after a character that isn't white space, in either vocabulary's sense.
_CUT = re.compile(r"(?<=[^\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]) ")


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest counted on from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers of a task, with the bytes of every id."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken

        with open(first, encoding="utf-8") as f:
            entries = json.load(f)
        chars, added = _bytes_of_chars(), {x["content"] for x in entries["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in entries["model"]["vocab"].items() if t not in added}
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        #: whether no piece goes on over a space, so that texts can be cut before one
        self.cuts = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        of_a = [b""] * (1 + max(ranks.values()))
        for t, i in ranks.items():
            of_a[i] = t
        of_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = of_a, of_b
        self.sizes = [np.array([*map(len, x)], np.int64) for x in self.bytes]
        # an id within a group and at its end, for the first vocabulary and then the second
        self.shown = [b"%d%b" % (i, end) for n, last in ((len(of_a), b"|"), (len(of_b), b";")) for i in range(n) for end in (b",", last)]

    def encode(self, text: str) -> list[np.ndarray] | None:
        """Both encodings; None if either one's bytes aren't a space and the text.

        The first vocabulary has every single byte and merges bytes alone, so its
        total size tells; the second one may put other characters for the text's.
        """
        found = [self._encode_part(part) for part in self._parts(text)]
        return None if None in found else [np.concatenate(x) for x in zip(*found, strict=True)]

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts of about SEGMENT characters, without the space before each, which the encodings put back."""
        at = 0
        while self.cuts and len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def _encode_part(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:  # a last space alone
            ids = self.first.encode_ordinary(" "), [self.second.piece_to_id("▁")]
            return tuple(np.array(x, np.int64) for x in ids)
        raw = b" " + text.encode()
        a, b = self.first.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), self.second.encode(text, num_threads=1)
        if int(self.sizes[0][a].sum()) != len(raw) or b"".join(map(self.bytes[1].__getitem__, b)) != raw:
            return None
        return a, np.array(b, np.int64)

    def related(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, bytes]:
        """Packed links in order, the number of groups, and the groups as text.

        Each stretch between neighbouring ends, of whichever tokenizer, lies in one
        token of each: it is one link.
        """
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ending = np.zeros(int(ends_a[-1]) + 1, np.int8)
        ending[ends_a] += 1
        ending[ends_b] += 2
        stretches = ending[np.flatnonzero(ending)]
        in_a, in_b = stretches & 1, stretches >> 1
        links = a[np.cumsum(in_a, dtype=np.int64) - in_a] << 32 | b[np.cumsum(in_b, dtype=np.int64) - in_b]
        last_a, last_b = ending[ends_a] == 3, ending[ends_b] == 3
        done_a, done_b = (np.r_[0, np.flatnonzero(x) + 1] for x in (last_a, last_b))  # tokens by the end of each group
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + done_b[group_a]] = 2 * a + last_a
        shown[np.arange(len(b)) + done_a[group_b + 1]] = 2 * (len(self.bytes[0]) + b) + last_b
        return links, len(done_a) - 1, b"".join(map(self.shown.__getitem__, shown.tolist()))[:-1]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys array<long>, times array<int>"
_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]
_NONE = (0, 0, 0, 0, "", "", np.empty(0, np.int64), np.empty(0, np.int32))


def _document(pair: Pair, raw: bytes | None, keep_groups: bool) -> tuple:
    try:
        text = (raw or b"").decode()
    except UnicodeDecodeError:
        return _NONE
    ids = pair.encode(text) if text else None
    if ids is None:
        return _NONE
    links, n_groups, groups = pair.related(*ids)
    keys, times = np.unique(links, return_counts=True)
    return *map(len, ids), n_groups, len(links), hashlib.sha256(groups).hexdigest(), groups.decode() if keep_groups else None, keys, times.astype(np.int32)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, keep_groups: bool = False) -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, the groups' hash (and text, if wanted), distinct keys and their times."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(first, second)
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                *plain, keys, times = zip(*(_document(pair, raw, keep_groups) for raw in part.column(1).to_pylist()), strict=True)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, plain, kinds), _lists(keys, pa.int64()), _lists(times, pa.int32())], names=_NAMES)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(encoded, _ALIGNED), "align-documents")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added; keys sorted."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the partition hold each key, in runs of up to HELD distinct ones."""
    total, waiting, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        return _summed(np.r_[total[0], keys], np.r_[total[1], counts])

    def out() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(total[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in total], names=["key", "n"])

    for batch in batches:
        waiting.append(batch.column(0).flatten().to_numpy())
        if (n := n + len(waiting[-1])) >= HELD:
            total, waiting, n = merged(), [], 0
            if len(total[0]) >= HELD:
                yield from out()
                total = (np.empty(0, np.int64), np.empty(0, np.int64))
    if n:
        total = merged()
    yield from out()


def _stream(path: str, write: bool):
    """An open file of any file system that pyarrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_output_stream(at) if write else system.open_input_stream(at)


def _mapped(path: str) -> np.ndarray:
    """A shard's file, mapped into memory; one that isn't on a mounted file system is copied to this machine first."""
    if re.match("file:|/", path):
        return np.memmap(re.sub("^file:/*", "/", path), np.int64, "r")
    own = os.path.join(tempfile.gettempdir(), "align-" + hashlib.sha256(path.encode()).hexdigest())
    if not os.path.exists(own):
        with _stream(path, False) as given, open(aside := f"{own}-{uuid.uuid4().hex}", "wb") as f:
            while part := given.read(1 << 24):
                f.write(part)
        os.rename(aside, own)
    return np.memmap(own, np.int64, "r")


@dataclass(frozen=True)
class Shards:
    """Sorted counts of packed keys. paths[i] + "-keys" and + "-counts" hold the keys from lows[i] on; tops: the highest count of each first id."""

    lows: np.ndarray
    paths: list[str]
    tops: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, each of which is in a shard."""
        found, at = np.empty(len(keys), np.int64), np.searchsorted(keys, self.lows)
        for lo, hi, path in zip(at, [*at[1:], len(keys)], self.paths, strict=True):
            if lo < hi:
                found[lo:hi] = _mapped(path + "-counts")[np.searchsorted(_mapped(path + "-keys"), keys[lo:hi])]
        return found


def pair_shards(aligned_docs: DataFrame, shards: int | None = None) -> Shards:
    """How many documents hold each key, as sorted shards in the shared folder."""
    spark = aligned_docs.sparkSession
    root = re.sub("^(?=/)", "file:", shared_dir(spark, "align-shards"))

    def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, low, last, files, tops = f"{root}-{uuid.uuid4().hex}", None, None, None, {}

        def put(keys: np.ndarray, counts: np.ndarray) -> None:
            for f, x in zip(files, (keys, counts), strict=True):
                f.write(x.tobytes())
            of, top = keys >> 32, np.maximum.reduceat(counts, starts := np.flatnonzero(np.r_[True, (keys[1:] >> 32) != (keys[:-1] >> 32)]))
            for a, n in zip(of[starts].tolist(), top.tolist(), strict=True):
                tops[a] = max(tops.get(a, 0), n)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = (batch.column(k).to_numpy() for k in (0, 1))
            if last is None:
                low, files = int(keys[0]), [_stream(path + kind, True) for kind in ("-keys", "-counts")]
            else:  # the last run may go on
                keys, counts = np.r_[last[0], keys], np.r_[last[1], counts]
            keys, counts = _summed(keys, counts)
            last = keys[-1:], counts[-1:]
            if len(keys) > 1:
                put(keys[:-1], counts[:-1])
        if last is not None:
            put(*last)
            for f in files:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([low], pa.int64()), pa.array([list(tops)], pa.list_(pa.int64())), pa.array([list(tops.values())], pa.list_(pa.int64()))], names=["path", "low", "first", "top"])

    partial = written(aligned_docs.select("keys").mapInArrow(_partial_counts, "key long, n long"), "align-partial")
    ranged = partial.repartitionByRange(shards or fixed_slots(spark), "key").sortWithinPartitions("key")
    listed = written(ranged.mapInArrow(summed_runs, "path string, low long, first array<long>, top array<long>"), "align-list")
    # as many rows as shards, and as ids of the first vocabulary
    places = listed.select("low", "path").orderBy("low").collect()
    best = listed.select(F.explode(F.arrays_zip("first", "top")).alias("x")).groupBy(F.col("x.first").alias("first")).agg(F.max("x.top").alias("top")).collect()
    tops = np.zeros(1 + max((r["first"] for r in best), default=0), np.int64)
    for r in best:
        tops[r["first"]] = r["top"]
    return Shards(np.array([r["low"] for r in places], np.int64), [r["path"] for r in places], tops)


def best_links(aligned_docs: DataFrame, shards: Shards) -> DataFrame:
    """aligned_docs without keys, with count_sum and n_best."""
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                held = part.column(len(shown))
                keys, times = held.flatten().to_numpy(), part.column(len(shown) + 1).flatten().to_numpy().astype(np.int64)
                distinct, places = np.unique(keys, return_inverse=True)
                counts = shards.counts(distinct)[places]
                best = times * (counts == shards.tops[keys >> 32])
                ends = np.cumsum([0, *held.value_lengths().to_pylist()])
                sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (best, times * counts)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(shown)], *map(pa.array, sums)], names=[*shown, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {'string' if 'groups' in c and c != 'n_groups' else 'long'}" for c in [*shown, "n_best", "count_sum"])
    return aligned_docs.select(*shown, "keys", "times").mapInArrow(looked_up, kinds)


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, keep_groups: bool = False) -> DataFrame:
    """Alignment of every document, with the corpus-wide counts of its links."""
    found = aligned(docs, first, second, keep_groups)
    return best_links(found, pair_shards(found))
