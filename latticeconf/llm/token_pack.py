"""Packing: documents' token ids laid end to end, in order, and cut into sequences by dynamic programming.

A document is its ids and END. A partition's documents form one stream, which is
cut at document ends (free), sentence ends (SENTENCE) or, where a stretch without
either is longer than GAP ids, inside it (INSIDE). A sequence of WINDOW ids or fewer
is padded to WINDOW unless its length is a power of two. The cuts minimise padding
plus these penalties:

    cost(j) = penalty(j) + min over i with c_j - c_i <= WINDOW of cost(i) + padding(c_j - c_i)

With full padding the inner term is cost(i) + c_i, apart from what depends on j
alone, so a monotone queue holds its minimum over the window and each place costs
constant time; lengths that are powers of two are looked up besides, at most twelve
a place. Places are found with NumPy, tokens being looked up by white-space piece:
white space always separates this vocabulary's words, so a piece's ids hold wherever
it stands.

Scale. No shuffle: each task packs its own documents in the order in which it reads
them, BLOCK ids at a time; the last two sequences of a block are cut again together
with the next block. Only a task's last sequences could be left short, and there every
id is a place to cut, so that they end at powers of two. A task holds a block, its longest
document and up to PIECES known pieces. A repeated task reads the same rows and so cuts
alike; a sequence's id holds its partition, so tasks need no common counter.

Defined cases: null and empty texts are END alone; rows of one doc_id are documents
of their own; a null doc_id stays null; bytes that aren't UTF-8 become U+FFFD; an
empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WINDOW, END = 4096, 2
SENTENCE, INSIDE, GAP = 4, 32, 128
BLOCK = 1 << 18
PIECES, PIECE_BYTES = 200_000, 100  # kept pieces of a task, and how long one may be
SEGMENT = 1 << 20  # bytes of a text at a time
#: Characters that the fast way takes: visible ones up to U+024F whose lower case and composition are themselves or one letter.
_OTHER = re.compile("[^!-~¡-įı-ɏ\n]|<\\|")
_LETTER, _NUMBER = "a-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}\n]+|\n")
_SPACE = re.compile(rb"[\t-\r ]")


class Words:
    """The vocabulary of a task: ids of texts, and which ids end a sentence.

    New pieces are encoded together, one a line. Word ends are part of the
    vocabulary, and stand here as a newline after each word: the merges of a byte and
    its word end come before all others, so merging by rank gives the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        from .token_align import _bytes_of_chars

        self.plain = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
        chars, added = _bytes_of_chars(), {x["content"] for x in entries["added_tokens"]}
        vocabulary = {t: i for t, i in entries["model"]["vocab"].items() if t not in added}
        ranks = {bytes(chars[c] for c in t.removesuffix("</w>")) + b"\n" * t.endswith("</w>"): i for t, i in vocabulary.items()}
        self.between = 1 + max(self.plain.get_vocab().values())
        self.by_rank = tiktoken.Encoding("words", pat_str=r"\n\n|[^\n]+\n", mergeable_ranks=ranks | {b"\n\n": self.between}, special_tokens={})
        shown = [self.plain.id_to_token(i) or "" for i in range(self.between)]
        marks = re.compile(r"[^\w\s]*[.!?][^\w\s]*</w>")
        self.closes = np.array([bool(marks.fullmatch(t)) for t in shown])
        self.number = np.array([t[:1].isdigit() for t in shown])
        self.known: dict[bytes, bytes] = {}

    def learn(self, pieces: list[bytes]) -> None:
        """Puts the pieces' ids, as 32-bit integers, among the known."""
        lines = b"\n".join(pieces).decode(errors="replace")
        if _OTHER.search(lines):
            other = [p for p in pieces if _OTHER.search(p.decode(errors="replace"))]
            for p in other:
                self.known[p] = np.array(self.plain.encode(p.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()
            pieces = [p for p in pieces if p not in self.known]
            lines = b"\n".join(pieces).decode()
        if pieces:
            words = _WORD.findall(lines.lower() + "\n")
            ids = self.by_rank.encode_to_numpy("\n".join(words) + "\n", disallowed_special=()).astype("<u4")
            ends, raw, lo = (4 * np.flatnonzero(ids == self.between)).tolist(), ids.tobytes(), 0
            for p, hi in zip(pieces, ends, strict=True):
                self.known[p] = raw[lo:hi]
                lo = hi + 4

    def ids(self, text: bytes | None) -> np.ndarray:
        """The ids of a text, with END."""
        text, found, lo = text or b"", [], 0
        while lo < len(text):
            cut = _SPACE.search(text, lo + SEGMENT)
            hi = cut.start() if cut else len(text)
            pieces, lo = text[lo:hi].split(), hi
            if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
                self.learn(new)
            found += map(self.known.__getitem__, pieces)
            for p in new:
                if len(p) > PIECE_BYTES:
                    del self.known[p]
            if len(self.known) > PIECES:
                self.known.clear()
        return np.frombuffer(b"".join([*found, np.uint32(END).tobytes()]), "<u4")


def places(ids: np.ndarray, ends: np.ndarray, words: Words, free_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut (0 first, its end last), with penalties; ends: after each document; from free_from on anywhere."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[free_from:] = INSIDE
    closing = np.flatnonzero(words.closes[ids[:-1]] & ~words.number[ids[1:]]) + 1
    penalty[closing] = SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(at) > GAP)
    for k in wide.tolist():
        penalty[at[k] + GAP : at[k + 1] : GAP] = INSIDE
    at = np.flatnonzero(penalty >= 0) if len(wide) else at
    return at, penalty[at]


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The cuts of least cost, from at[0] to at[-1], as indices into at. No two neighbours may be more than window apart."""
    n = len(at)
    index = np.full(at[-1] - at[0] + 1, -1, np.int64)
    index[at - at[0]] = np.arange(n)
    # (place, earlier place) a power of two apart
    pairs = []
    for k in range(window.bit_length() - 1):
        later = np.flatnonzero(at - at[0] >= 1 << k)
        earlier = index[at[later] - at[0] - (1 << k)]
        pairs.append(np.stack([later[earlier >= 0], earlier[earlier >= 0]]))
    later, earlier = np.concatenate(pairs, axis=1)
    order = np.argsort(later, kind="stable")
    starts, earlier = np.searchsorted(later[order], np.arange(n + 1)).tolist(), earlier[order].tolist()
    c, p = at.tolist(), penalty.tolist()
    cost, level, came = [0] * n, [c[0]] + [0] * (n - 1), [0] * n  # level: cost(i) + c_i, the queue's order
    queue, head = [0], 0
    for j in range(1, n):
        here = c[j]
        while c[queue[head]] < here - window:
            head += 1
        i = queue[head]
        best = level[i] + window - here
        for k in earlier[starts[j] : starts[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], came[j] = best + p[j], i
        level[j] = x = cost[j] + here
        while len(queue) > head and level[queue[-1]] >= x:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return np.array(path[::-1])


class _Stream:
    """Documents not yet laid out: of each its id, its ids from `begun` on, and their number in all."""

    def __init__(self, words: Words, keep_ids: bool):
        self.words, self.keep_ids, self.waiting, self.n = words, keep_ids, [], 0
        self.sequence = TaskContext.get().partitionId() << 40

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, 0, len(ids), ids))
        self.n += len(ids)

    def packed(self, last: bool) -> pa.RecordBatch:
        """The pieces of all sequences that are settled."""
        ids, ends = np.concatenate([x[3] for x in self.waiting]), np.cumsum([len(x[3]) for x in self.waiting])
        at, penalty = places(ids, ends, self.words, max(0, len(ids) - 2 * WINDOW) if last else len(ids))
        chosen = at[cuts(at, penalty)]
        if not last:
            chosen = chosen[: max(1, np.searchsorted(chosen, len(ids) - 2 * WINDOW, "right"))]
        starts, stop = np.r_[0, ends[:-1]], int(chosen[-1])
        bounds = np.union1d(chosen, starts[starts < stop])
        lows, highs = bounds[:-1], bounds[1:]
        doc, sequence = np.searchsorted(starts, lows, "right") - 1, np.searchsorted(chosen, lows, "right") - 1
        of = [self.waiting[k] for k in doc.tolist()]
        columns = {
            "doc_id": pa.array([x[0] for x in of], pa.int64()),
            "start": pa.array(lows - starts[doc] + np.array([x[1] for x in of], np.int64)),
            "length": pa.array(highs - lows),
            "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)], pa.int64()),
            "doc_tokens": pa.array([x[2] for x in of], pa.int64()),
            "sequence_id": pa.array(self.sequence + sequence),
            "offset": pa.array(lows - chosen[sequence]),
        }
        if self.keep_ids:
            columns["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(lows, highs, strict=True)], pa.list_(pa.int32()))
        self.sequence += len(chosen) - 1
        k = int(np.searchsorted(ends, stop, "right"))
        if k < len(self.waiting):
            doc_id, begun, total, own = self.waiting[k]
            done = stop - int(starts[k])
            self.waiting = [(doc_id, begun + done, total, own[done:]), *self.waiting[k + 1 :]]
        else:
            self.waiting = []
        self.n = len(ids) - stop
        return pa.RecordBatch.from_pydict(columns)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence; keep_ids: with its ids."""

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            stream = stream or _Stream(Words(vocabulary), keep_ids)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream.add(doc_id, stream.words.ids(text.as_py()))
                if stream.n >= BLOCK:
                    yield stream.packed(False)
        if stream and stream.n:
            yield stream.packed(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(laid_out, _PIECES + ", ids array<int>" * keep_ids)
