"""Language identification by hyperdimensional letter-trigram profiles.

Each letter has a random vector of +1 and -1; a trigram's vector binds the three
letters' vectors, permuted (rotated) by place, by elementwise products; a text's
vector bundles (sums) its trigrams' vectors; a language's prototype bundles the
unit vectors of its training texts. A text goes to the prototype with the
greatest cosine.

Learning takes at most about TRAIN_DOCS texts of each language, chosen by a hash
of the id among all rows, and reduces on the executors to one vector a language;
prediction is one pass without shuffle, with the prototypes (languages x D
floats) as a broadcast. Letters' vectors come from a hash of the code point, so
every task makes the same ones.

Defined cases: null text, or text without a letter, is "und" with score 0, as is
everything when nothing can be learned; equal cosines go to the language first
in order of name; a null doc_id is neither held out nor learned from; texts over
SLICE characters are read whole, in slices; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

D = 1024
TRAIN_DOCS = 2000
SLICE = 1 << 20
SEED = 20240601
#: A text whose best cosine is less is rejected by the filtering stage. With D = 1024 texts of no learned
#: language reach about 0.05 by chance; of SHORT_CHARS characters or fewer, so do texts of a learned one.
MIN_SCORE, SHORT_SCORE, SHORT_CHARS = 0.1, 0.05, 30
#: Languages whose rates are broadcast; beyond that they are joined by a shuffle.
BROADCAST_LANGS = 10_000
_SCALE = 1 << 20


class Letters:
    """Rotated letter vectors, made when a letter is first seen."""

    ROOM = 4096

    def __init__(self, d: int = D):
        self.d, self.index = d, {}
        self.rolled = [np.zeros((64, d), np.int8) for _ in range(3)]
        self.alpha = np.zeros(0x110000, bool)
        self.alpha[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def rows(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int64)
        for k, c in enumerate(codes.tolist()):
            at = self.index.get(c)
            if at is None:
                at = len(self.index)
                if at == len(self.rolled[0]):
                    self.rolled = [np.concatenate([x, np.zeros_like(x)]) for x in self.rolled]
                v = np.random.default_rng((SEED, c)).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
                for r in range(3):
                    self.rolled[r][at] = np.roll(v, r)
                self.index[c] = at
            out[k] = at
        return out

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the trigrams' vectors; None if the text has no letter."""
        if not text:
            return None
        total = None
        for lo in range(0, len(text), SLICE):
            codes = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "ignore"), np.uint32)
            letter = self.alpha[codes]
            if not letter.any():
                continue
            keep = letter | np.concatenate(([True], letter[:-1]))  # a run of other characters is one space
            codes = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32]))
            if len(self.index) > self.ROOM:
                self.__init__(self.d)
            distinct, at = np.unique(codes, return_inverse=True)
            n = len(distinct)
            grams, counts = np.unique((at[:-2] * n + at[1:-1]) * n + at[2:], return_counts=True)
            rows = self.rows(distinct)
            total = np.zeros(self.d) if total is None else total
            for k in range(0, len(grams), 2048):
                g = grams[k : k + 2048]
                bound = self.rolled[2][rows[g // (n * n)]] * self.rolled[1][rows[g // n % n]] * self.rolled[0][rows[g % n]]
                total += counts[k : k + 2048].astype(np.float32) @ bound.astype(np.float32)
        return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _profile_batches(batches):
    letters, sums = Letters(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = letters.bundle(text)
            if v is not None and (norm := np.linalg.norm(v)):
                sums[lang] = sums.get(lang, 0) + np.rint(v / norm * _SCALE).astype(np.int64)  # whole numbers: the order of sums doesn't matter
    for lang, v in sorted(sums.items()):
        yield pa.RecordBatch.from_pydict({"lang": [lang] * D, "place": np.arange(D, dtype=np.int32), "x": v})


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Unit prototype of each language from rows that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    share = written(known.groupBy("lang").agg((F.lit(float(train_docs)) / F.count(F.lit(1))).alias("share")), "lang-shares")
    few = share.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    taken = known.join(F.broadcast(share) if few else share, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = taken.select("lang", "text").mapInArrow(_profile_batches, "lang string, place int, x long").groupBy("lang", "place").agg(F.sum("x").alias("x")).collect()  # languages x D numbers
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(D))[r["place"]] = r["x"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v)}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


class Teller:
    """Languages and scores of texts by their nearest prototypes."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names, self.matrix, self.letters = list(prototypes), np.array([*prototypes.values()]), Letters()

    def tell(self, text: str | None) -> tuple[str, float]:
        v = self.letters.bundle(text) if self.names else None
        if v is None:
            return "und", 0.0
        norm = np.linalg.norm(v)
        if not norm:
            return self.names[0], 0.0
        cosine = self.matrix @ (v / norm)
        best = int(cosine.argmax())
        return self.names[best], float(min(1.0, max(0.0, cosine[best])))


def _predictor(prototypes):
    def run(batches):
        teller = Teller(prototypes.value)
        for batch in batches:
            told = [teller.tell(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], schema=_SCHEMA)

    return run


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    prototypes = docs.sparkSession.sparkContext.broadcast(learn(docs, train_docs))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_predictor(prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_score: float = MIN_SCORE, short_score: float = SHORT_SCORE) -> DataFrame:
    """The rows whose language is told with a cosine of min_score or more; for short texts, of short_score.

    Each row is judged by itself, so rows of one doc_id or of none need no join.
    """
    prototypes = docs.sparkSession.sparkContext.broadcast(learn(docs, train_docs))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        teller = Teller(prototypes.value)
        for texts in batches:
            told = [teller.tell(x) for x in texts.to_pylist()]
            yield pa.array([None if lang == "und" else x for lang, x in told], pa.float64())

    least = F.when(F.length("text") <= SHORT_CHARS, short_score).otherwise(min_score)
    return docs.where(score(F.col("text").cast("string")) >= least)
