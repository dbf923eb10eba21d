"""Operators 11 to 13: fill-in-the-middle, alignment of tokenizers, packing."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticeconf.llm import fim_split, queries, token_align, token_pack

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
ODD = [None, "", " ", "\n", "\n\n", "a\n", "\na", "a\r\nb", "x<P>y\nz", "don't I'LL x's", "café CAFÉ İ ΣΑΣ ﬁ ½ 3.5", "a\x1cb\x00c\xa0d　e", "<|endoftext|> x </s> <s>", "日本語 テキスト", "é é", "... !!! ?!\"", "ſ K ẞ ß ŉ ǅ", "🙂👍🏽 ok", "a<|b ''s''t", "٣٤ ١", "▁a b", "a ▁", "  two  spaces  ", ");\r\n{\r\n", "q" * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*enumerate(ODD), (None, "no id\nat all"), (3, ODD[3])], "doc_id long, text string")


# --- 11: fill-in-the-middle


def by_hand(doc_id, text):
    text = text or ""
    pieces = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(pieces) + 1), h2 % (len(pieces) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(pieces), "plain", None, None, sha(text), sha(text)
    p, m, s = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(pieces), form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("rows", ["docs", "edge", "nothing", "odd"])
def test_fim_by_hand(request, rows):
    df = request.getfixturevalue(rows)
    got = fim_split.fim_digest(fim_split.fill_in_middle(df)).collect()
    want = [by_hand(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("grammar", sorted(fim_split.UNITS))
def test_boundaries_are_the_grammar(spark, grammar):
    units = fim_split.UNITS[grammar]
    texts = [x for x in ODD if x] + ["One. Two!! Three? four", "...", "a.b. c", " lead and trail  "]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", fim_split.units(F.col("text"), units).alias("u")).collect()
    # Java and Python differ in what \S takes beyond ASCII; both must at least lose nothing
    assert all("".join(r["u"]) == r["text"] and all(r["u"]) for r in got)
    assert all(r["u"] == re.findall(units.pattern, r["text"]) for r in got if r["text"].isascii() and "\x1c" not in r["text"])


def test_rates_and_other_marks(spark, docs):
    marks = fim_split.Sentinels("[[", "$1", "\\E)")
    some = fim_split.fill_in_middle(docs, fim_split.UNITS["sentence"], marks, seed=3, rate=40, spm=0)
    share = some.groupBy("form").count().collect()
    assert {r["form"] for r in share} == {"plain", "psm"} and 0.2 < sum(r["count"] for r in share if r["form"] == "psm") / docs.count() < 0.6
    assert some.where(fim_split.restored(F.col("output"), F.col("form"), marks) != F.coalesce("text", F.lit(""))).count() == 0


# --- 12: alignment


def aligned_by_hand(texts):
    """Per text: ids of both, the groups and the links, found place by place."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        of_a = [bytes(chars[c] for c in first.id_to_token(i)) for i in a]
        of_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw or not text:
            found.append(None)
            continue
        owner_a, owner_b = ([k for k, x in enumerate(of) for _ in x] for of in (of_a, of_b))
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, lo = [], 0
        for at in range(1, len(raw) + 1):
            if at == len(raw) or owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]:
                groups.append(",".join(str(a[k]) for k in sorted(set(owner_a[lo:at]))) + "|" + ",".join(str(b[k]) for k in sorted(set(owner_b[lo:at]))))
                lo = at
        found.append((len(a), len(b), groups, [(a[x], b[y]) for x, y in links]))
    return found


def check_alignment(df):
    rows = df.select("doc_id", "text").collect()
    found = aligned_by_hand([r["text"] for r in rows])
    held = Counter(p for x in found if x for p in set(x[3]))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    want = [
        (r["doc_id"], x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == top[p[0]] for p in x[3]), sum(held[p] for p in x[3]), sha(";".join(x[2]))) if x else (r["doc_id"], 0, 0, 0, 0, 0, 0, "")
        for r, x in zip(rows, found, strict=True)
    ]
    got = token_align.align(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows", ["docs", "edge", "nothing", "odd"])
def test_alignment_by_hand(request, rows):
    check_alignment(request.getfixturevalue(rows).repartition(3))


def test_long_texts_are_encoded_in_parts(docs, monkeypatch):
    """The same ids wherever a text is cut; a place without a space before or after white space isn't one."""
    pair = token_align.Pair(token_align.FIRST, token_align.SECOND)
    texts = [*filter(None, ODD), *(r["text"] for r in docs.limit(60).collect() if r["text"]), "ends in a space ", "a\u3000 b  c \n d\t e", "x" * 90 + " y"]
    whole = [pair.encode(t) for t in texts]
    for size in (1, 7, 40):
        monkeypatch.setattr(token_align, "SEGMENT", size)
        for t, want in zip(texts, whole, strict=True):
            got = pair.encode(t)
            assert (got is None) == (want is None) and (got is None or all(np.array_equal(x, y) for x, y in zip(got, want, strict=True)))
    assert pair.cuts and max(len(list(pair._parts(t))) for t in texts) > 5


def test_partial_counts_in_runs(spark, docs, monkeypatch):
    """Counts are the same when a task sums few keys at a time, and shards many."""
    few = docs.limit(40).repartition(4)
    want = token_align.align(few).collect()
    monkeypatch.setattr(token_align, "HELD", 500)
    monkeypatch.setattr(token_align, "fixed_slots", lambda _: 13)
    assert sorted(token_align.align(few).collect()) == sorted(want)


def test_groups_as_text_and_a_copied_shard(spark, docs, tmp_path, monkeypatch):
    got = token_align.align(docs.limit(5), keep_groups=True).collect()
    assert all(sha(r["groups"]) == r["groups_sha256"] for r in got if r["n_a"])
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr(token_align.tempfile, "tempdir", None)
    (tmp_path / "shard-keys").write_bytes(np.arange(9).tobytes())
    monkeypatch.setattr(token_align, "_stream", lambda path, write: open(tmp_path / "shard-keys", "rb"))
    assert token_align._mapped("store://x/shard-keys").tolist() == list(range(9))


# --- 13: packing


@pytest.fixture(scope="module")
def words():
    return token_pack.Words(token_pack.VOCABULARY)


def plain_ids(words, text):
    return [*words.plain.encode(text or "", add_special_tokens=False).ids, token_pack.END]


def test_ids_are_the_tokenizer_s(words, docs):
    for text in [*ODD, *(r["text"] for r in docs.select("text").collect()), "x" * 150 + " y " + "é" * 60 + " z"]:
        assert words.ids(text and text.encode()).tolist() == plain_ids(words, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_of_any_text(words, text):
    assert words.ids(text.encode()).tolist() == plain_ids(words, text)


def test_known_pieces_are_given_up(words, monkeypatch):
    monkeypatch.setattr(token_pack, "PIECES", 5)
    monkeypatch.setattr(token_pack, "SEGMENT", 16)
    text = " ".join(f"w{i % 40}, Ü{i}" for i in range(200))
    assert words.ids(text.encode()).tolist() == plain_ids(words, text)


def padding(n, window):
    return 0 if n & (n - 1) == 0 else window - n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=40))
def test_cuts_cost_least(steps):
    at, penalty, window = np.cumsum([0, *(n for n, _ in steps)]), np.array([0, *(p for _, p in steps)]), 16
    least = [0]
    for j in range(1, len(at)):
        least.append(int(penalty[j]) + min(least[i] + padding(int(at[j] - at[i]), window) for i in range(j) if at[j] - at[i] <= window))
    chosen = token_pack.cuts(at, penalty, window)
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1
    assert least[-1] == sum(padding(int(at[b] - at[a]), window) + int(penalty[b]) for a, b in zip(chosen, chosen[1:]))


def check_packing(words, df, got):
    """Each id in one piece, sequences gapless and full; the number of ids and of padding."""
    ids = Counter()
    whole = {}
    for r in df.select("doc_id", "text").collect():
        own = np.array(plain_ids(words, r["text"]), "<u4")
        ids[(r["doc_id"], len(own))] += len(own)
        whole.setdefault((r["doc_id"], len(own)), own)
    for p in got:
        own = whole[p["doc_id"], p["doc_tokens"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] > 0 and zlib.crc32(own.tobytes()) == p["ids_crc32"]
        ids[p["doc_id"], p["doc_tokens"]] -= p["length"]
    assert not any(ids.values())
    assert len({(p["sequence_id"], p["offset"]) for p in got}) == len(got)
    starts = Counter((p["doc_id"], p["doc_tokens"], p["start"]) for p in got)
    copies = Counter((r["doc_id"], len(plain_ids(words, r["text"]))) for r in df.select("doc_id", "text").collect())
    assert all(n <= copies[d, t] for (d, t, _), n in starts.items())
    sequences = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert sequences.get(p["sequence_id"], 0) == p["offset"]
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= token_pack.WINDOW for n in sequences.values())
    return sum(sequences.values()), sum(padding(n, token_pack.WINDOW) for n in sequences.values())


@pytest.mark.parametrize("rows", ["docs", "edge", "nothing", "odd"])
def test_packing_is_whole(request, words, rows):
    df = request.getfixturevalue(rows)
    n, pad = check_packing(words, df, token_pack.pack(df).collect())
    assert pad <= 0.01 * n + 64


def test_packing_over_blocks(spark, docs, words, monkeypatch):
    """Small blocks carry their last sequences on, long documents over several."""
    monkeypatch.setattr(token_pack, "BLOCK", 3 * token_pack.WINDOW)
    long = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.repeat(F.lit("word and more "), 20_000)}))
    got = token_pack.pack(long.coalesce(1), keep_ids=True).collect()
    n, pad = check_packing(words, long, got)
    assert pad < 0.01 * n
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in got)


def test_packing_keeps_the_order(docs):
    got = [r["doc_id"] for r in token_pack.pack(docs.coalesce(1)).orderBy("sequence_id", "offset").collect()]
    assert list(dict.fromkeys(got)) == [r["doc_id"] for r in docs.coalesce(1).select("doc_id").collect()]


def test_registered():
    assert {"op11_fill_in_middle", "op12_token_alignment", "op13_pack_sequences"} <= set(queries.QUERIES)
