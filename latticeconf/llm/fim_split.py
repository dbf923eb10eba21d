"""Fill-in-the-middle: documents cut at unit boundaries and put together anew, prefix and suffix first.

A unit grammar (`Units`) is a class of closing characters, alone or in runs: a line
closes with one newline, a word with its run of non-spaces, a sentence with its run
of marks. `boundary` translates a grammar to a regex that matches nothing but a place:
behind it a closing character, ahead of it the class that may follow. Spark's
`split` at such a place loses no character, so the pieces are the units
(`pattern` states the same units as a plain regex; the tests hold both together). An empty text has no unit,
where split would give one empty piece.

Each document draws two cuts, whether it is changed, and the order from the SHA-256
of seed and doc_id, so a retried task, another partitioning or another order of
rows draws the same. Everything is row by row in Spark's own expressions: no
shuffle, no Python.

Defined cases: null and empty texts are empty and stay plain; texts that hold a
sentinel stay plain, since the parts could not be told apart again; rows of one
doc_id draw alike; a null doc_id draws as the empty string; a text without any
closing character is one unit; an empty table gives an empty one; other columns
are kept, but for those that the result adds (a clashing one is replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Units:
    """closing: the inside of a character class; runs: whether a unit closes with a whole run of it."""

    closing: str
    runs: bool

    @property
    def pattern(self) -> str:
        """The units as a regex, to be matched left to right."""
        return f"[^{self.closing}]*[{self.closing}]{'+' * self.runs}|[^{self.closing}]+"

    @property
    def boundary(self) -> str:
        """The zero-width place between two units."""
        return f"(?<=[{self.closing}])(?=[{'^' + self.closing if self.runs else chr(92) + 's' + chr(92) + 'S'}])"


UNITS = {"line": Units(r"\n", False), "word": Units(r"\S", True), "sentence": Units(".!?", True)}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(x) for x in (self.prefix, self.suffix, self.middle))


SEED, RATE, SPM = 7, 100, 50


def units(text: Column, grammar: Units) -> Column:
    """The text's units in order; their concatenation is the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, grammar: Units = UNITS["line"], marks: Sentinels = Sentinels(), seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    rate: how many of a hundred documents are changed; spm: how many of these put the suffix first.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = (text == "") | text.rlike(marks.pattern) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    def parts(pieces: Column) -> Column:
        n = F.size(pieces)
        a, b = F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")
        some = [F.array_join(F.slice(pieces, lo + 1, hi - lo), "") for lo, hi in ((F.lit(0), a), (a, b), (b, n))]
        return F.struct(n.cast("long").alias("n"), *(x.alias(k) for x, k in zip(some, ("prefix", "middle", "suffix"), strict=True)))

    cut = docs.withColumns({"form": form, "__cut": let(units(text, grammar), parts)})
    p, m, s = (F.when(F.col("form") != "plain", F.col(f"__cut.{k}")) for k in ("prefix", "middle", "suffix"))
    psm = F.concat(F.lit(marks.prefix), p, F.lit(marks.suffix), s, F.lit(marks.middle), m)
    spm_text = F.concat(F.lit(marks.suffix), s, F.lit(marks.prefix), p, F.lit(marks.middle), m)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm_text)
    return cut.withColumns({"n": F.col("__cut.n"), "prefix": p, "middle": m, "suffix": s, "output": output}).drop("__cut")


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that output was made from; nothing else of the row is needed."""

    def together(x: Column) -> Column:
        return F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1]))

    return F.when(form == "plain", output).otherwise(let(F.split(output, marks.pattern, -1), together))


def fim_digest(changed: DataFrame) -> DataFrame:
    """Lengths and hashes of what fill_in_middle() returned."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return changed.select(
        F.col("doc_id").cast("long"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM c
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM f
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END AS output FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
