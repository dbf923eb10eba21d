"""Personal data: expressions propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) are accepted by their own rules alone. The
further kinds (iban by mod-97, ssn by number ranges) must also reach a score:
a prior for the confirmed pattern, raised by words such as "iban" close by.

Rows are scanned one by one (mapInArrow, no shuffle). Defined cases: null text is
empty (no spans, the digest of nothing); spans of equal start are ordered by
kind; repeated rows repeat; extra columns are ignored; very long runs of digits
are judged by their count, never converted whole to a number.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can't start within a run of digits: what follows the run is the same from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
#: Characters of an IBAN by country; a shorter end than IBAN's is tried at this length alone, where it is known.
IBAN_CHARS = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Words that raise a kind's score when they stand within CONTEXT_CHARS of it.
CONTEXT = {
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT_CHARS, CONTEXT_GAIN, ACCEPT = 40, 0.2, 0.5
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
_WORD, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile("[0-9]")
_FAR = 320  # characters of a local part looked at in one step


def luhn(digits: str) -> bool:
    """Mod-10 check: every second digit from the right counts doubled, less 9 if over 9."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(_DOUBLED[int(x)] for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: country and check digits go last, letters count 10..35, remainder 1."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _apart(text: str, start: int) -> bool:
    """No letter, digit or hyphen stands right before start."""
    return not start or not (text[start - 1].isalnum() or text[start - 1] in "_-")


def emails(text: str):
    """EMAIL's leftmost matches; the search starts where the run before each @ starts."""
    at, end = text.find("@"), 0
    local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
    while at >= 0:
        first = at
        while first > end:
            piece = text[max(end, first - _FAR) : first]
            kept = len(piece) - len(piece.rstrip(local))
            first -= kept
            if kept < len(piece):
                break
        if first < at and (m := EMAIL.match(text, first)):
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ibans(text: str):
    """(start, end) of valid IBANs. IBAN takes in short upper-case words that follow; so ends at earlier words are tried too."""
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        if _apart(text, start):
            whole = end
            while end > start:
                said = text[start:end].replace(" ", "")
                if mod97(said) and (end == whole or len(said) == IBAN_CHARS.get(said[:2], len(said))):
                    yield start, end
                    break
                end = text.rfind(" ", start, end)
        m = IBAN.search(text, max(start + 1, end))


def proposed(text: str):
    """(kind, start, end) confirmed by validators, base kinds first."""
    for m in emails(text):
        yield "email", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if _apart(text, m.start()) and m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            yield "ssn", m.start(), m.end()


def context_score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall((text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Accepted spans by start, then kind as listed."""
    text = text or ""
    found = [(k, a, b, context_score(text, k, a, b)) for k, a, b in proposed(text)]
    return sorted((x for x in found if x[0] in BASE_KINDS or x[3] >= ACCEPT), key=lambda x: (x[1], KINDS.index(x[0])))


_TYPE = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def _span_batches(batches):
    for batch in batches:
        rows = [{"doc_id": i, "spans": [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t)]} for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every document; positions in code points, end exclusive."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_span_batches, _TYPE)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' digest, and all spans as text."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", said)).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


def redact(text: str | None) -> str | None:
    """The text with each accepted span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in spans_of(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])
