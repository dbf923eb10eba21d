"""Operators 1, 6, 8 and 9: one row in, one row out."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeconf.llm import hyperlang, license_scan, pii, queries, text_density

from .brute import base_licenses, base_pii

NOTICES = [license_scan.Notice(*n) for n in license_scan.NOTICES]


# --- 1: licences


def check_licenses(spark, df):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = license_scan.license_scan(df).collect()
    key = lambda x: tuple((v is not None, v) if not isinstance(v, str) else v for v in x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(((i, *base_licenses(t)) for i, t in texts), key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_base_phrases(spark, docs, edge, nothing):
    check_licenses(spark, docs)
    check_licenses(spark, edge)
    check_licenses(spark, nothing)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the M.I.T. licence, 2020", {"mit"}),
        ("relased under teh mit licence", {"mit"}),
        ("this work is lisenced under the gnu generl public license, version 3", {"gpl"}),
        ("Licensed under the Apach License, Version 2.0", {"apache"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
        ("redistribution and use in sorce and binary form", {"bsd"}),
        ("é " * 30 + "mozila public license", {"mpl"}),
        ("the driver of the car with a license to sing", set()),
        ("general public transport", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_fuzzy_labels(text, labels):
    _, _, base, spans = license_scan.scan(text and text.encode(), NOTICES)
    assert base | {s[0] for s in spans} == labels


@pytest.mark.parametrize("text", ["under the \u201cApache License, Version 2.0", "the \u201cmit license\u201d here"])
def test_characters_of_three_bytes_before_a_notice(text):
    """One put-in character, however many bytes it has, is one edit."""
    notice = next(x for x in NOTICES if x.text in ("apache license", "mit license") and x.text[:3] in text.lower())
    spans = license_scan.scan(text.replace("\u201d", "").encode(), NOTICES)[3]
    assert any(s[0] == notice.label and s[3] == 1 for s in spans)


def test_weaker_matches_before_a_better_one():
    """The best match of a window doesn't hide those before it."""
    spans = license_scan.scan(b"mozila public license or mozilla public license", NOTICES)[3]
    assert [(s[1], s[3]) for s in spans if s[0] == "mpl"] == [(0, 1), (4, 0)]


def test_fuzzy_spans_count_words():
    text = "ä b c " * 50 + "Relesed under the MIT license today"
    n, starts, _, spans = license_scan.scan(text.encode(), NOTICES)
    assert n == 156 and starts == [153]
    assert ("mit", 150, 155, 1, len("released under the mit license")) in spans


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(NOTICES) - 1), st.integers(0, 2**32), st.integers(0, 6))
def test_seeds_miss_no_match(which, seed, edits):
    """Whatever bounded edits are made, candidate windows hold each match that a search of the whole text finds."""
    import random

    rng, x = random.Random(seed), NOTICES[which]
    s = list(x.text)
    for _ in range(min(edits, x.edits)):
        k = rng.randrange(1, len(s) - 1)
        s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
    text = " ".join(rng.choice(["the", "under", "license", "public"]) for _ in range(8)) + " " + "".join(s) + " and so on"
    normal = b" " + b" ".join(text.encode().translate(license_scan._WORD_BYTES).split()) + b" "
    if x.verify.search(normal.decode()):
        assert any(x.verify.search(normal[a:b].decode()) for a, b in license_scan.candidate_windows(normal, x))


# --- 6: personal data


def digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in base_pii(text)).encode()).hexdigest()


def test_pii_base(spark, docs, edge, nothing):
    for df in (docs, edge, nothing):
        texts = sorted(((r["doc_id"] or -1, digest(r["text"])) for r in df.select("doc_id", "text").collect()))
        assert sorted((r["doc_id"] or -1, r["base_sha256"]) for r in pii.pii_digest(pii.find_pii(df)).collect()) == texts


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+-_%( )0459é", max_size=60))
def test_pii_equals_plain_expressions(text):
    got = [(a, pii.KINDS.index(k), k, b) for k, a, b, _ in pii.spans_of(text) if k in pii.BASE_KINDS]
    assert got == base_pii(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("pay to IBAN GB82 WEST 1234 5698 7654 32 please", ["iban"]),
        ("DE89370400440532013000", ["iban"]),
        ("DE89370400440532013001", []),
        ("my social security number is 123-45-6789", ["ssn"]),
        ("part 123-45-6789 in stock", []),
        ("4111 1111 1111 1111", ["card"]),
        ("4111 1111 1111 1112", []),
        ("1.2.3.4 and 1.2.3.400", ["ip"]),
        ("9" * 5000 + ".1.1.1", []),
    ],
)
def test_pii_validators(text, kinds):
    found = [k for k, *_ in pii.spans_of(text)]
    assert found == kinds


@pytest.mark.parametrize(
    ("text", "ibans"),
    [
        ("ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", ["ES91 2100 0418 4502 0005 1332"]),
        ("BE68 5390 0754 7034 EUR 50", ["BE68 5390 0754 7034"]),
        ("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 OK", ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 BIC X", ["DE89370400440532013000"]),
        ("ES91 2100 0418 4502 0005 1333 BIC CAIXESBB", []),
    ],
)
def test_ibans_before_other_words(text, ibans):
    assert [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "iban"] == ibans


def test_pii_context_and_redaction():
    near, far = pii.context_score("call my phone +1 (555) 010-9999 now", "phone", 14, 31), pii.context_score("x" * 90, "phone", 40, 50)
    assert near > far
    assert pii.redact("mail a@b.co or c@d.org") == "mail [EMAIL] or [EMAIL]" and pii.redact(None) is None


# --- 8: main text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>One <b>bold</b>\n word.<p>Two &amp; three</article><footer>&copy; x</footer>", "A title\nOne bold word.\nTwo & three"),
        ("<html><body><div id=menu><a>x</a><a>y</a></div><div class=post><p>" + "text here " * 20 + "</p><p>" + "more of it " * 20 + "</p></div><div class='sidebar'><p>" + "not this " * 60 + "</p></div></body>", ("text here " * 20).strip() + "\n" + ("more of it " * 20).strip()),
        ("<article><p>kept</p><section class='comments'><p>reader says hello at length, again and again</p></section><form>send</form><aside>ad</aside></article>", "kept"),
        ("<p>bare</p><script>var a='<p>no</p>'</script><style>p{}</style>", "bare"),
        ("<article><header><h1>Title</h1></header><p>Body</p><!-- <p>gone</p> --></article>", "Title\nBody"),
        ("<body><header>Site</header><main><p>Only this.</p></main>", "Only this."),
        ("plain text", "plain text"),
        ("", ""),
        (None, ""),
        ("<article></article><nav>menu</nav>", ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_main_text(html, text):
    assert text_density.extract(html) == text


LEAD, BODY = "a lead that says at some length what follows below it here " * 3, "many words of body text that go on and on for a while " * 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div><h1>Title</h1><p class=lead>{LEAD}</p><div class=body>{f'<p>{BODY}</p>' * 5}</div></div></body>", ["Title", LEAD, *[BODY] * 5]),
        ("<body><div class='content has-sidebar'><article><h1>T</h1><p>Some text.</p></article></div></body>", ["T", "Some text."]),
        ("<body><div id='header-fixed-page'><div><main><p>Some text.</p></main></div><div class='sidebar'>x</div></div></body>", ["Some text."]),
        ("<article><div class='entry-header'><h1>T</h1></div><p>Some text.</p><div class='share'>tell all</div></article>", ["T", "Some text."]),
        (f"<body><div class='page-with-sidebar'>{f'<p>{BODY}</p>' * 3}</div><p class=footer>short foot</p></body>", [BODY] * 3),
        (f"<body><main><p>{BODY}</p></main><div class=related><article><p>another story</p></article></div></body>", [BODY]),
    ],
)
def test_marks_and_leaves_lose_no_content(html, text):
    assert text_density.extract(html) == "\n".join(x.strip() for x in text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><h2 id='share-prices-fell'>Share prices fell</h2><p>{LEAD}</p></article>", ["T", "Share prices fell", LEAD]),
        (f"<article><h1>T</h1><section id='related-work'><h2 id='comments'>Comments</h2><p>{LEAD}</p></section></article>", ["T", "Comments", LEAD]),
        (f"<article><section id='notice'><p>{LEAD}</p></section><p>{BODY}</p></article>", [LEAD, BODY]),
        (f"<article><div class='entry social-science'><h1>T</h1><p>{BODY}</p></div></article>", ["T", BODY]),
        ("<article><p class='comment-free'>short</p><blockquote class='side-note'>a quote</blockquote><figure class='promo-image'><figcaption>caption</figcaption></figure><p>end</p></article>", ["short", "a quote", "caption", "end"]),
        (f"<body><div class='content no-sidebar'>{f'<p>{BODY}</p>' * 3}</div><div>{f'<p>{BODY}</p>' * 2}</div></body>", [BODY] * 5),
        (f"<article><p>{BODY}</p><div class='related-reads'><a href=x>one more</a> <a href=y>and another</a></div><div class='post-comments'><p>{LEAD}</p></div><div id='ad-slot-2'>{LEAD}</div></article>", [BODY]),
        (f"<body><div class='page'><p>{BODY}</p><p>{BODY}</p></div><div class='site-footer'><p>{LEAD}</p></div><ul class='comment-list'><li>{LEAD}</li></ul></body>", [BODY] * 2),
    ],
)
def test_marks_propose(page, text):
    """Names that merely hold a mark, and ids made from headings, take no text out; whole names do."""
    assert text_density.extract(page) == "\n".join(x.strip() for x in text)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><article><p>Some text.</p></article>", "Some text."),
        ("<head><title>t</title><link rel=x><p>Some text.</p>", "Some text."),
        (f"<body><form action=/ method=post><input name=x><div><h1>T</h1>{f'<p>{BODY}</p>' * 3}</div><button>Go</button></form></body>", "\n".join(["T", *[BODY.strip()] * 3])),
        ("<form><article><p>Some text.</p><form>tell us</form></article></form>", "Some text."),
        ("<body><div class='side-by-side'><article><p>Some text.</p></article></div><div class='no-sidebar'><p>x</p></div></body>", "Some text."),
        ("<body><div class='social-science'><article><p>Some text.</p></article></div></body>", "Some text."),
    ],
)
def test_heads_and_forms(html, text):
    assert text_density.extract(html) == text


def test_densities_against_a_plain_version():
    """Composite text density and its sums of every block of a well-formed page, by recursion."""
    import math
    from xml.etree import ElementTree as E

    page = f"<body><div><p>{LEAD}</p><p>{BODY}<a>link one</a> and <a>two</a></p><ul><li><a>x</a></li><li>words <b>here</b></li></ul></div><div><p>short</p><section><p>{BODY}</p><p><a>{LEAD}</a></p></section></div></body>"
    root = E.fromstring(page)
    size = lambda s: len("".join((s or "").split()))
    chars = lambda e: sum(size(t) for t in e.itertext())
    linked = lambda e: chars(e) if e.tag == "a" else sum(map(linked, e))
    counted = lambda e: sum(1 for x in e.iter() if x is not e and (x.tag == "a" or x.tag in text_density.BLOCK))
    share = linked(root) / chars(root)

    def density(e):
        c, lc, t, lt = chars(e), linked(e), max(1, counted(e)), sum(1 for x in e.iter("a") if x is not e)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / (1 + math.log(base))

    tree = text_density._Tree()
    tree.feed(page)
    tree.close()
    got, total, _ = text_density.densities(tree)
    assert tree.tag[1:] == [e.tag for e in root.iter()]
    for i, e in enumerate(root.iter(), 1):
        assert got[i] == pytest.approx(density(e))
        below = [x for x in e if x.tag == "a" or x.tag in text_density.BLOCK]
        if below and e.tag in text_density.BLOCK:
            assert total[i] == pytest.approx(sum(map(density, below))) or not sum(map(density, below))


def test_pages_of_null_html_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (2, "u", "")], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "node")})
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in text_density.main_text(df).collect()) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3), (2, "", 0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_fuzzy_spans_against_edit_distances(seed):
    """Every place where a notice ends within its edits, by a plain table of edit distances, lies in a reported span or beside one that overlaps it, and no span has more edits than the table says it needs."""
    import random

    rng = random.Random(seed)
    x = rng.choice([n for n in NOTICES if len(n.text) < 45])
    parts = []
    for _ in range(3):
        s = list(x.text)
        for _ in range(rng.randint(0, x.edits)):
            k = rng.randrange(1, len(s) - 1)
            s[k : k + 1] = rng.choice([[], ["q"], ["q", s[k]]])
        parts += [rng.choice(["and then", "or", "a b c"]), "".join(s)]
    words = " ".join([*parts, "so it ends"]).split()
    spans = [s for s in license_scan.scan(" ".join(words).encode(), [x], {})[3]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for _, first, end, edits, _ in spans:
        assert distance(" ".join(words[first:end]), x.text) <= edits <= x.edits
    n = len(x.text.split())
    for i in range(len(words)):
        for k in range(max(1, n - 2), n + 3):
            if i + k <= len(words) and distance(" ".join(words[i : i + k]), x.text) <= x.edits:
                assert any(a < i + k and i < b for _, a, b, *_ in spans), (words[i : i + k], spans)


def test_main_text_of_pages(spark, data):
    """Against the pages' own template: the article's h1 and p blocks."""
    import html as h
    import re

    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = {}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", b) if "<br" in b else re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", a)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r for r in text_density.main_text(pages.withColumn("text", F.lit("clash"))).collect()}
    assert {k: v["text"] for k, v in got.items()} == want
    assert all(v["n_chars"] == len(v["text"]) for v in got.values())
    assert text_density.main_text(pages.limit(0)).count() == 0


# --- 9: language


def test_language_held_out(spark, data):
    rows = queries.op9_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_edges(spark, docs, edge, nothing):
    both = docs.unionByName(edge.select(docs.columns))
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]) for r in hyperlang.identify(both).where("lang_pred = 'und' OR doc_id IS NULL").collect()}
    assert {1, 2, 3} <= {i for i, lang, _ in got if lang == "und"}
    assert (None, "en", False) in got
    assert {(r["lang_pred"], r["score"]) for r in hyperlang.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert hyperlang.identify(nothing).count() == 0


def test_texts_of_no_learned_language_go(spark, docs):
    """Scripts that were not learned are rejected; ties go to the language first by name."""
    foreign = ["Это обычный русский текст о погоде и природе в нашей стране, где люди живут", "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό και τη φύση", "قطة صغيرة تجلس على الطاولة في البيت الكبير وتنظر", "漢字の文章です。今日は天気がとてもいいので散歩に行きましょう、公園まで歩きます"]
    own = spark.createDataFrame([(10**6 + i, t, None, "f", 0) for i, t in enumerate(foreign)], docs.schema)
    assert hyperlang.accepted(docs.unionByName(own)).where("source = 'f'").count() == 0
    v = hyperlang.Letters().bundle("some text of letters")
    assert hyperlang.Teller({"a": v, "b": v}).tell("some text of letters")[0] == "a"


def test_language_ignores_labels(spark, docs):
    """Held-out rows' labels and any row's source don't matter to predictions."""
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hyperlang.identify(docs).collect()}
    changed = docs.withColumn("lang", F.when(hyperlang.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hyperlang.identify(changed).collect()}


def test_long_texts_are_read_whole():
    letters = hyperlang.Letters(64)
    whole = letters.bundle("ab " * (hyperlang.SLICE // 2))
    assert whole is not None and abs(whole).max() > 0
    assert letters.bundle("12 34") is None and letters.bundle("") is None


def test_rejected_rows_go_one_by_one(spark, docs):
    """Rows without an id, and rows that share one, are each judged by their own text."""
    text = docs.where("lang IS NOT NULL AND length(text) > 200").first()["text"]
    own = spark.createDataFrame([(None, text), (None, "1 2 3"), (8, None), (8, text), (9, "")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    kept = hyperlang.accepted(docs.select(own.columns).unionByName(own.select(own.columns)).where("source = 's' OR doc_id IS NOT NULL"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.where("source = 's'").collect()) == [(0, text), (8, text)]
    assert kept.columns == own.columns


def test_dense_texts_take_linear_time():
    """Long runs of candidates, digits and stray tags, scanned whole."""
    notices = [license_scan.Notice(*x) for x in license_scan.NOTICES]
    k = 5000
    n, starts, labels, spans = license_scan.scan(b"see the MIT Licence " * k, notices)
    assert (n, starts, labels) == (4 * k, [], set())
    assert {s[1] for s in spans if s[0] == "mit"} >= {4 * i + 2 for i in range(k)}
    assert pii.spans_of("7" * 300_000 + " 10.1.1.1") == [("ip", 300_001, 300_009, 0.7)]
    assert text_density.extract("<article><p>" + "<i>x</b>" * 30_000 + "</article>") == "x" * 30_000
