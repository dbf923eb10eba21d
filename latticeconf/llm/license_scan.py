"""Fuzzy short-notice search for licence statements.

A notice of length L with k allowed edits is split into k + 1 pieces; by the
pigeonhole principle any occurrence with k edits or fewer holds one piece
unchanged, so exact substring search for the pieces yields every candidate
window. The regex library's bounded-error matching then verifies each window and
reports the span and its number of edits. The four base phrases are counted
exactly as runs of consecutive words; fuzzy hits only add labels.

Each row is scanned by itself (mapInArrow, no shuffle); a text is a run of bytes
in one row, so hot sources and copies don't concentrate work.

Defined cases: null text is the empty text (no words, no spans, score 0); ties
between notices at one place are all reported; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 2048
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (notice, label, allowed edits); all in the words' normal form.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("this work is licensed under the gnu general public license version 3", "gpl", 5),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution", "cc-by", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("bsd 3 clause license", "bsd", 1),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge to any person", "mit", 5),
)
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b in _LETTERS or b >= 128 else 32 for b in range(256))


@dataclass
class Notice:
    text: str
    label: str
    edits: int
    pieces: list[tuple[int, bytes]] = field(default_factory=list)
    verify: regex.Pattern | None = None

    def __post_init__(self):
        n, k = len(self.text), self.edits
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        self.pieces = [(a, self.text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.verify = regex.compile(rf"(?b)(?<= )(?:{regex.escape(self.text)}){{e<={k}}}(?= )")


def candidate_windows(normal: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged [start, end) windows of normal that may hold the notice, in order.

    Long runs of windows are cut every RUN bytes, with an overlap that holds a whole
    occurrence: the search for the best match stays linear.
    """
    n, k, found = len(notice.text), notice.edits, []
    for offset, piece in notice.pieces:
        p = normal.find(piece)
        while p >= 0:
            found.append((max(0, p - offset - 4 * k - 1), min(len(normal), p - offset + n + 4 * k + 2)))  # an edit may put in a character of 4 bytes
            p = normal.find(piece, p + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    overlap = n + 4 * k + 2
    return [(p, min(b, p + RUN + overlap)) for a, b in merged for p in range(a, max(a + 1, b - overlap), RUN)]


def matches(window: str, notice: Notice) -> list[regex.Match]:
    """Matches of a window. The search takes the best one first, so what lies before and after it is searched again."""
    found, parts = [], [(0, len(window))]
    while parts:
        a, b = parts.pop()
        if m := notice.verify.search(window, a, b):
            found.append(m)
            parts += [(a, m.start()), (m.end(), b)]
    return found


def scan(text: bytes | None, notices: list[Notice], base: dict[str, str] = BASE) -> tuple:
    """n_words, starts and labels of base phrases, fuzzy spans (label, first word, end word, edits, length)."""
    words = (text or b"").translate(_WORD_BYTES).split()
    normal = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in base.items():
        needle = f" {phrase} ".encode()
        p, at, before = normal.find(needle), 0, 0
        while p >= 0:
            before += normal.count(b" ", at, p)
            at = p
            starts.append(before)
            labels.add(label)
            p = normal.find(needle, p + 1)
    spans = []
    for x in notices:
        lead = at = 0
        for a, b in candidate_windows(normal, x):
            window = normal[a:b].decode("utf-8", "ignore")
            lead, at = lead + normal.count(b" ", at, a), a
            for m in matches(window, x):
                first = lead + window.count(" ", 0, m.start()) - 1
                spans.append((x.label, first, first + 1 + m.group().count(" "), sum(m.fuzzy_counts), len(x.text)))
    return len(words), starts, labels, sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[3]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])))])


def _scan_batches(table):
    def run(batches):
        notices = [Notice(*x) for x in table]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                n, starts, base, spans = scan(text, notices)
                score = 1.0 if starts else max((1.0 - e / length for *_, e, length in spans), default=0.0)
                rows.append({"doc_id": doc_id, "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})), "score": max(0.0, score), "spans": [{"label": s[0], "first_word": s[1], "end_word": s[2], "edits": s[3]} for s in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def license_scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """Licence labels and word spans of every document; see the module's notes."""
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(_scan_batches(notices), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:int>>")
