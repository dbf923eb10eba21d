"""Benchmark decontamination by template canonicalisation.

Numbers, runs of capitalised words and units become typed placeholders; windows of
five template tokens of documents and of benchmark items are joined by hash. An item
is found in a document that holds CONTAIN of its windows. The slots' raw values
are then compared: a name that turns up changed must have changed the same way
wherever it stands, and the number or unit of each place must be one and the same in
all windows over that place, which tells a re-parameterised question from texts
that merely share phrases. Names can't be told once the case has changed, so a
second form of both sides, in lower case and with placeholders for numbers and units
alone, finds copies of another case.

Scale. A first pass looks for pairs of words: of every eight places of an item one
pair of plain words, the rarest of five, so that no window holds two of them. A pair
that a document lacks takes all windows over it along, so by the pigeonhole principle
a document that holds enough of an item's windows holds a known number of its pairs,
and no document is lost. The pass cuts each text into its pairs of words (native
expressions on the row, no shuffle) and joins their hashes to the benchmark's pairs:
broadcast up to BROADCAST_KEYS, beyond that shuffled, after a broadcast of the bare
hashes (8 bytes each, up to BROADCAST_HASHES) has dropped all others. Only documents
that may hold an item are read again, for the windows, the count and the slot check.
Items whose pairs promise nothing (of a few placeholders, say) are looked for by their
windows in all texts. Nothing groups by window, so a passage that many documents share
meets only as counts by document and item.

Defined cases: null text has no tokens and is never found; rows of one doc_id
count as one document, and rows without a doc_id can't be named and stay out of
the report (and in the data when filtering); an item of SHORT lower-case tokens is
found wherever they stand in a row, one of fewer only where a document is that same
sequence; an item with no window of LITERALS plain tokens uses all its windows; ties
between items are all reported; extra columns are ignored; an empty table on
either side finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
#: Lengths of items under WINDOW that are looked for inside documents.
SHORT = (3, 4)
CONTAIN = 0.8
LITERALS = 3
#: Share of an item's slots that may change in more than one way.
INCONSISTENT = 0.2
BROADCAST_KEYS = 200_000
BROADCAST_HASHES = 4_000_000
#: Of so many places one pair is looked for, among the first few of them: then pairs are WINDOW - 1 places apart at least.
BLOCK, CHOICE = 8, 5
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Unit words that become a placeholder after a number.
UNITS = "km cm mm kg mg lb lbs oz ml mph kph hz khz mhz ghz kb mb gb tb usd eur gbp percent dollars dollar euros euro cents cent pounds pound meters meter metres metre kilometers kilometer kilometres kilometre centimeters centimetres miles mile feet foot inches inch hours hour minutes minute seconds second days day weeks week months month years year grams gram kilograms kilogram liters liter litres litre degrees degree".split()
#: Repetition is possessive, which Java's expressions run in a loop; by recursion a long run would overflow the stack.
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
_NAMED = r"(^| )\p{Lu}[^ ]*+(?: \p{Lu}[^ ]*+)*+"
_SLOT = f"[{NUM}{NAME}{UNIT}]"
_UNIT = rf"((?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))( |$)"
#: The forms: 0 with names, 1 in lower case without; windows of form 1 have a separator of their own, so that hashes differ.
FORMS = (0, 1)
_BETWEEN = (" ", "\x1f")


def _source(text: Column) -> Column:
    """The text without characters that would pass for a number's placeholder."""
    return F.when(F.contains(text, F.lit(NUM)), F.translate(text, NUM, " ")).otherwise(text)


def numbered(text: Column) -> Column:
    """The text's words, numbers and units as placeholders, joined by spaces; case is kept."""
    t = F.regexp_replace(F.regexp_replace(_source(text), _NUMBER, f" {NUM} "), rf"[^\p{{L}}{NUM}]+", " ")
    return F.regexp_replace(F.trim(t), f"{NUM} {_UNIT}", f"{NUM} {UNIT}$2")


def template(numbers: Column, form: int) -> Column:
    """Template tokens of numbered() text in a form, joined by spaces."""
    return F.lower(numbers if form else F.regexp_replace(numbers, _NAMED, f"$1{NAME}"))


def _filled(text: Column, pattern: str, clean, said) -> Column:
    """The text with clean() of what lies between the pattern's matches and said() of these."""
    pieces = F.arrays_zip(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))
    whole = F.array_join(F.transform(pieces, lambda z: F.concat(clean(z["p"]), F.coalesce(said(z["v"]), F.lit("")))), "")
    return F.trim(F.regexp_replace(whole, " +", " "))


def valued(text: Column, form: int) -> Column:
    """As template() of numbered(), with each placeholder followed by its value in lower case; spaces in it become _."""
    t = _filled(_source(text), _NUMBER, lambda p: F.regexp_replace(p, r"[^\p{L}]+", " "), lambda v: F.concat(F.lit(f" {NUM}"), v, F.lit(" ")))
    t = F.regexp_replace(t, f"({NUM}[^ ]*) {_UNIT}", f"$1 {UNIT}$2$3")
    if not form:
        t = _filled(t, _NAMED, lambda p: p, lambda v: F.concat(F.lit(f" {NAME}"), F.translate(F.trim(v), " ", "_")))
    return F.lower(t)


def _bare(values: Column) -> Column:
    """template() from valued()."""
    return F.regexp_replace(values, f"({_SLOT})[^ ]*", "$1")


def _grams(t: Column, n: int, form: int) -> Column:
    """All runs of n tokens of a template, joined by the form's separator."""
    sep = _BETWEEN[form]
    run = rf"(?<![^{sep}])(?=([^{sep}]++(?:{sep}[^{sep}]++){{{n - 1}}}))[^{sep}]++"  # tried at a token's start alone: a token may be very long
    return F.regexp_extract_all(t, F.lit(run), F.lit(1))


def window_hashes(docs: DataFrame, key: str, short: list[int]) -> DataFrame:
    """(key, h): a row for each window of each text in either form.

    Windows are runs of WINDOW tokens, or the whole of a shorter text; in form 1 runs
    of the short lengths as well. Each step is a column of its own, computed once.
    """
    own = docs.select(key, numbered(F.col("text")).alias("n"))
    own = own.select(key, template(F.col("n"), 0).alias("t0"), F.replace(template(F.col("n"), 1), F.lit(" "), F.lit(_BETWEEN[1])).alias("t1"))
    spare = lambda n: lambda w: F.length(w) - F.length(F.translate(w, NUM + UNIT, "")) <= n - LITERALS
    few = lambda t, sep: ~t.rlike(rf"^[^{sep}]++(?:{sep}[^{sep}]++){{{WINDOW - 1}}}")
    parts = [F.when(few(F.col(f"t{form}"), _BETWEEN[form]), F.array_remove(F.array(f"t{form}"), "")).otherwise(_grams(F.col(f"t{form}"), WINDOW, form)) for form in FORMS]
    parts += [F.filter(_grams(F.col("t1"), n, 1), spare(n)) for n in short]
    return own.select(key, F.explode(F.concat(*parts)).alias("w")).select(key, F.xxhash64("w").alias("h"))


def windows_with_values(docs: DataFrame, key: str) -> DataFrame:
    """(key, form, at, size, h, t, r): windows with their template tokens and values."""
    out = None
    for form in FORMS:
        one = docs.select(key, valued(F.col("text"), form).alias("v")).where("v <> ''")
        one = one.select(key, F.split(_bare(F.col("v")), " ").alias("t"), F.split("v", " ").alias("r"))
        size = F.least(F.size("t"), F.lit(WINDOW))
        cut = lambda i: F.struct(i.alias("at"), size.alias("size"), F.slice("t", i + 1, size).alias("t"), F.slice("r", i + 1, size).alias("r"))  # noqa: B023, E731
        w = one.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - size), cut)).alias("x"))
        w = w.select(key, F.lit(form).alias("form"), "x.*").withColumn("h", F.xxhash64(F.array_join("t", _BETWEEN[form])))
        out = w if out is None else out.unionByName(w)
    return out


def placed_windows(filled: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, row, form, doc_at, h) for the windows of texts in valued() form."""
    out = None
    for form in FORMS:
        sep = _BETWEEN[form]
        one = filled.where(F.col("form") == form).select("doc_id", "row", "form", F.translate(_bare(F.col("v")), " ", sep).alias("t"))
        few = ~F.col("t").rlike(rf"^[^{sep}]++(?:{sep}[^{sep}]++){{{WINDOW - 1}}}")
        spare = lambda n: F.length("w") - F.length(F.translate("w", NUM + UNIT, "")) <= n - LITERALS
        for n in [WINDOW, *(short if form else ())]:
            grams = F.when(few, F.array("t")).otherwise(_grams(F.col("t"), n, form)) if n == WINDOW else _grams(F.col("t"), n, form)
            w = one.select("doc_id", "row", "form", F.posexplode(grams).alias("doc_at", "w"))
            w = (w if n == WINDOW else w.where(spare(n))).select("doc_id", "row", "form", "doc_at", F.xxhash64("w").alias("h"))
            out = w if out is None else out.unionByName(w)
    return out


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of items that take part in the join: (item_id, form, at, size, h, t, r, n_tokens, n_item_windows)."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    w = windows_with_values(items, "item_id")
    w = w.withColumn("plain", F.size(F.filter("t", lambda x: ~x.rlike(_SLOT))))
    rich = w.groupBy("item_id", "form").agg(F.max("plain").alias("most"))
    w = w.join(rich, ["item_id", "form"]).where(f"plain >= {LITERALS} OR most < {LITERALS}")
    n = w.groupBy("item_id", "form").agg(F.countDistinct("h").alias("n_item_windows"))
    return w.drop("most").join(n, ["item_id", "form"])


def pair_hashes(docs: DataFrame, key: str) -> DataFrame:
    """(key, h): a row for each pair of neighbouring words of each text, in lower case; what stands between them doesn't count."""
    words = docs.select(key, F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ").alias("t"))
    return words.select(key, F.explode(_grams(F.col("t"), 2, 0)).alias("w")).select(key, F.xxhash64("w").alias("h"))


def seed_pairs(bench: DataFrame, contain: float) -> tuple[DataFrame, DataFrame]:
    """(item_id, form, h): pairs to look for; (item_id, form, least): how many of them a document must have, 0 or less where that says nothing."""
    key = ["item_id", "form"]
    once = bench.groupBy(*key, "h").agg(F.count(F.lit(1)).alias("k")).where("k = 1")  # a repeated window could be lost by either place
    pairs = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.slice("t", i + 1, 2))
    at = bench.where(F.size("t") > 1).join(once, [*key, "h"], "left_semi").select(*key, "at", F.posexplode(pairs).alias("j", "two"))
    at = at.select(*key, (F.col("at") + F.col("j")).alias("place"), F.array_join("two", " ").alias("w"))
    cover = at.where(~F.col("w").rlike(_SLOT)).groupBy(*key, "place", "w").agg(F.count(F.lit(1)).alias("kills"))
    spread = cover.groupBy("w").agg(F.countDistinct("item_id").alias("items"))
    choice = F.max(F.struct("kills", (-F.col("items")).alias("rare"), F.length("w").alias("size"), "w")).alias("x")
    seeds = cover.where(F.col("place") % BLOCK < CHOICE).join(spread, "w").groupBy(*key, F.floor(F.col("place") / BLOCK).alias("block")).agg(choice)
    # one pair of two blocks counts once, with what its better place takes along
    seeds = written(seeds.groupBy(*key, F.col("x.w").alias("w")).agg(F.max("x.kills").alias("kills")), "decontam-seeds")
    missing = F.col("n_item_windows") - F.ceil(F.lit(contain) * F.col("n_item_windows") - 1e-9)
    may_miss = bench.groupBy(*key).agg(F.first(missing).alias("missing"))
    lost = F.sum("kills").over(Window.partitionBy(*key).orderBy("kills", "w").rowsBetween(Window.unboundedPreceding, 0))  # over an item's pairs
    least = may_miss.join(seeds.withColumn("lost", lost), key, "left").groupBy(*key).agg(F.count_if(F.col("lost") > F.col("missing")).alias("least"))
    return seeds.select(*key, F.xxhash64("w").alias("h")), least


def contaminated(docs: DataFrame, benchmark: DataFrame, contain: float = CONTAIN, broadcast_keys: int = BROADCAST_KEYS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """A row for each document and item that it holds."""
    key = ["doc_id", "item_id", "form"]
    bench = written(benchmark_windows(benchmark), "decontam-items")
    short = sorted(r["size"] for r in bench.where(f"form = 1 AND plain >= {LITERALS}").where(F.col("size").isin(*SHORT)).select("size").distinct().collect())  # two numbers at most
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def holders(found: DataFrame, keys: DataFrame, least: DataFrame) -> DataFrame:
        """(doc_id, item_id, form) with at least the given number of the item's keys (h, item_id, form)."""
        n_keys = keys.limit(broadcast_hashes + 1).count()
        aside = F.broadcast if n_keys <= broadcast_keys else (lambda x: x)
        if broadcast_keys < n_keys <= broadcast_hashes:
            found = found.join(F.broadcast(keys.select("h").distinct()), "h", "left_semi")
        hits = found.join(aside(keys), "h").groupBy(*key).agg(F.countDistinct("h").alias("n"))
        return hits.join(aside(least), ["item_id", "form"]).where("n >= least").select(*key)

    seeds, least = seed_pairs(bench, contain)
    least = written(least, "decontam-least")
    promising = least.where("least > 0")
    may = holders(pair_hashes(texts, "doc_id"), seeds.join(promising, ["item_id", "form"], "left_semi"), promising)
    rest = bench.join(least.where("least <= 0"), ["item_id", "form"], "left_semi")
    if rest.take(1):
        every = rest.select("item_id", "form", "h").distinct()
        enough = rest.groupBy("item_id", "form").agg((F.lit(contain) * F.first("n_item_windows")).alias("least"))
        may = may.unionByName(holders(window_hashes(texts, "doc_id", short), every, enough))
    may = written(may, "decontam-may")
    n_items = bench.limit(broadcast_keys + 1).count()
    aside = F.broadcast if n_items <= broadcast_keys else (lambda x: x)
    found = texts.join(may.select("doc_id").distinct(), "doc_id", "left_semi")
    # written, as the values would else be made again for each use
    forms = F.array(*(F.struct(F.lit(form).alias("form"), valued(F.col("text"), form).alias("v")) for form in FORMS))
    filled = written(found.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(forms).alias("x")).select("doc_id", "row", "x.*"), "decontam-texts").where("v <> ''")
    ours = bench.select("item_id", "form", F.col("at").alias("item_at"), "h", F.col("r").alias("item_r"), F.col("t").alias("item_t"), "n_item_windows")
    hits = placed_windows(filled, short).join(aside(ours), ["h", "form"]).join(may, key, "left_semi")
    said = filled.select("row", "form", F.split("v", " ").alias("said"))
    pairs = hits.join(said, ["row", "form"]).withColumn("r", F.slice("said", F.col("doc_at") + 1, F.size("item_r"))).drop("said", "row")
    pairs = written(pairs, "decontam-pairs")
    held = pairs.groupBy(*key, "n_item_windows").agg(F.countDistinct("h").alias("n_windows")).where(F.col("n_windows") >= F.lit(contain) * F.col("n_item_windows"))
    held = written(held, "decontam-held")
    pairs = pairs.join(held.select(*key), key, "left_semi")
    verbatim = pairs.where(F.array_join("r", " ") == F.array_join("item_r", " ")).groupBy(*key).agg(F.countDistinct("h").alias("n_verbatim"))
    # a template that an item repeats meets itself at several places: of these the
    # one in line with most other windows of the item counts
    lined = pairs.withColumn("shift", F.col("doc_at") - F.col("item_at"))
    support = lined.groupBy(*key, "shift").agg((-F.countDistinct("item_at")).alias("against"))
    best = F.min(F.struct("against", "shift", "item_t", "item_r", "r")).alias("b")
    placed = lined.join(support, [*key, "shift"]).groupBy(*key, "item_at").agg(best).select(*key, "item_at", "b.*")
    slots = placed.select(*key, "item_at", F.posexplode(F.arrays_zip("item_t", "item_r", "r")).alias("j", "s")).where(F.col("s.item_t").rlike(_SLOT))
    place = F.when(F.col("s.item_t") == NAME, F.col("s.item_r")).otherwise((F.col("item_at") + F.col("j")).cast("string"))
    values = slots.groupBy(*key, place.alias("place")).agg(F.countDistinct("s.r").alias("ways"))
    slot = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("ways") > 1).alias("n_inconsistent"))
    out = held.join(verbatim, key, "left").join(slot, key, "left").na.fill(0, ["n_verbatim", "n_slots", "n_inconsistent"])
    is_verbatim = F.col("n_verbatim") >= F.lit(contain) * F.col("n_item_windows")
    consistent = F.col("n_inconsistent") <= F.lit(INCONSISTENT) * F.col("n_slots")
    out = out.withColumn("kind", F.when(is_verbatim, "verbatim").when(consistent, "re-parameterised")).where("kind IS NOT NULL")
    # of both forms a verbatim finding counts, else that with names
    named = ["n_windows", "n_item_windows", "n_verbatim", "n_slots", "n_inconsistent", "kind"]
    out = out.groupBy("doc_id", "item_id").agg(F.min(F.struct(F.col("kind") != "verbatim", "form", *named)).alias("x")).select("doc_id", "item_id", *(f"x.{c}" for c in named))
    return out.select("doc_id", "item_id", "n_windows", "n_item_windows", (F.col("n_windows") / F.col("n_item_windows")).alias("containment"), "n_verbatim", "n_slots", "n_inconsistent", "kind")


def _sql_pattern(pattern: str) -> str:
    """The same expression without Java's possessive repetition."""
    return pattern.replace("++", "+").replace("*+", "*")


def _sql_filled(text: str, pattern: str, clean: str, said: str) -> str:
    pattern = _sql_pattern(pattern)
    whole = f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}', 0)), lambda z: {clean} || coalesce({said}, '')), '')"
    return f"trim(regexp_replace({whole}, ' +', ' ', 'g'))"


_SQL_VALUED = rf"regexp_replace({_sql_filled(f"replace(text, '{NUM}', ' ')", _NUMBER, r"regexp_replace(z[1], '[^\p{L}]+', ' ', 'g')", f"' {NUM}' || z[2] || ' '")}, '({NUM}[^ ]*) {_UNIT}', '\1 {UNIT}\2\3', 'g')"
_SQL_NAMED = _sql_filled("v", _NAMED, "z[1]", f"' {NAME}' || replace(trim(z[2]), ' ', '_')")


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT *, row_number() OVER () AS u FROM (SELECT DISTINCT doc_id AS id, text, 0 AS side FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
           UNION ALL SELECT DISTINCT item_id, text, 1 FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
v0 AS MATERIALIZED (SELECT id, side, u, {_SQL_VALUED} AS v FROM d),
v1 AS (SELECT id, side, u, 0 AS form, lower({_SQL_NAMED}) AS v FROM v0 UNION ALL SELECT id, side, u, 1, lower(v) FROM v0),
k AS MATERIALIZED (SELECT id, side, u, form, string_split(v, ' ') AS r, string_split(regexp_replace(v, '({_SLOT})[^ ]*', '\1', 'g'), ' ') AS t FROM v1 WHERE v <> ''),
lens AS (SELECT DISTINCT len(t) AS n FROM k WHERE side = 1 AND form = 1 AND len(t) IN {SHORT} AND len(list_filter(t, lambda x: NOT regexp_matches(x, '{_SLOT}'))) >= {LITERALS}),
tok AS (SELECT id, side, u, form, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS t, unnest(r) AS r FROM k),
five AS (SELECT id, side, form, n, i, [t, {', '.join(f'lead(t, {j}) OVER w' for j in range(1, WINDOW))}] AS t, [r, {', '.join(f'lead(r, {j}) OVER w' for j in range(1, WINDOW))}] AS r FROM tok WINDOW w AS (PARTITION BY u, form ORDER BY i)),
g AS (SELECT id, side, form, i, t, r FROM five WHERE i <= n - {WINDOW - 1} UNION ALL SELECT id, side, form, i, t[1:n], r[1:n] FROM five WHERE n < {WINDOW} AND i = 1
      UNION ALL SELECT id, side, form, i, t[1:m], r[1:m] FROM five, (SELECT n AS m FROM lens) WHERE side = 0 AND form = 1 AND i <= n - m + 1 AND len(list_filter(t[1:m], lambda x: NOT regexp_matches(x, '{_SLOT}'))) >= {LITERALS}),
p AS (SELECT id AS item_id, form, i, t, r, len(list_filter(t, lambda x: NOT regexp_matches(x, '{_SLOT}'))) AS plain FROM g WHERE side = 1),
q AS (SELECT * FROM (SELECT *, max(plain) OVER (PARTITION BY item_id, form) AS most FROM p) WHERE plain >= {LITERALS} OR most < {LITERALS}),
b AS (SELECT q.item_id, q.form, i, t, r, n AS n_item_windows FROM q JOIN (SELECT item_id, form, count(DISTINCT t) AS n FROM q GROUP BY ALL) c ON q.item_id = c.item_id AND q.form = c.form),
m AS (SELECT DISTINCT g.id AS doc_id, b.item_id, b.form, b.n_item_windows, b.t, g.r AS r, b.r AS item_r, b.i AS item_i, g.i - b.i AS shift FROM g JOIN b ON g.side = 0 AND g.form = b.form AND g.t = b.t),
held AS (SELECT doc_id, item_id, form, n_item_windows, count(DISTINCT t) AS n_windows, count(DISTINCT t) FILTER (WHERE r = item_r) AS n_verbatim
         FROM m GROUP BY ALL HAVING count(DISTINCT t) >= {CONTAIN} * n_item_windows),
x AS (SELECT doc_id, item_id, form, shift, count(DISTINCT item_i) AS support FROM m GROUP BY ALL),
y AS (SELECT m.* FROM m SEMI JOIN held USING (doc_id, item_id, form) JOIN x USING (doc_id, item_id, form, shift) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, form, item_i ORDER BY support DESC, shift) = 1),
s AS (SELECT doc_id, item_id, form, item_i, unnest(range(1, len(t) + 1)) AS j, t, r, item_r FROM y),
v AS (SELECT doc_id, item_id, form, CASE WHEN t[j] = '{NAME}' THEN item_r[j] ELSE (item_i + j)::VARCHAR END AS place, count(DISTINCT r[j]) AS ways FROM s WHERE regexp_matches(t[j], '{_SLOT}') GROUP BY ALL),
u AS (SELECT doc_id, item_id, form, count(*) AS n_slots, count(*) FILTER (WHERE ways > 1) AS n_inconsistent FROM v GROUP BY ALL),
o AS (SELECT h.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_inconsistent, 0) AS n_inconsistent FROM held h LEFT JOIN u USING (doc_id, item_id, form)),
e AS (SELECT *, CASE WHEN n_verbatim >= {CONTAIN} * n_item_windows THEN 'verbatim' WHEN n_inconsistent <= {INCONSISTENT} * n_slots THEN 're-parameterised' END AS kind FROM o)
SELECT doc_id, item_id, n_windows, n_item_windows, n_windows / n_item_windows AS containment, n_verbatim, n_slots, n_inconsistent, kind
FROM e WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY kind <> 'verbatim', form) = 1
"""
