"""Personal data: patterns propose spans, validators confirm them, context adjusts a score.

Base kinds are email, ip, card and phone: leftmost matches that do not overlap within a kind, dropped
when their validator fails (parts up to 255; 16 to 19 digits with a right Luhn sum; 8 to 15 digits).
Base spans always stay.  Further kinds need their score to reach ``THRESHOLD``: a checksum (mod-97 for
iban) or a strict form gives most of it, words near the span add to or take from it.

Edge cases: null and empty texts have no spans; very long texts and runs of digits or letters are handled
whole, in time that grows with their length; rows are judged one by one, so repeated rows repeat; extra columns are kept by ``mask_pii`` and ignored by
``find_pii``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, id_text, small_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
FOUND = "doc_id long, kind string, start long, end long, score double"
COUNTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, scores string"
# The base patterns, written so that every match begins at the first character that can begin it: a run of
# digits or address characters is then read once, not once per character.  Same matches as the plain forms.
_ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_EMAIL, _EMAIL_ON = re.compile(r"(?<![A-Za-z0-9._%+-])" + _ADDRESS), re.compile(_ADDRESS)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_/+-]{16,}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
#: Whole words of letters within WINDOW characters before or after a span, and what they add.
WINDOW, THRESHOLD = 40, 0.6
CONTEXT = {
    "email": {"mail": 0.1, "contact": 0.1}, "ip": {"ip": 0.1, "host": 0.1, "version": -0.2}, "card": {"card": 0.1, "visa": 0.1, "order": -0.2}, "phone": {"tel": 0.1, "call": 0.1, "phone": 0.1},
    "iban": {"iban": 0.2, "account": 0.1, "konto": 0.1}, "ssn": {"ssn": 0.4, "social": 0.3, "part": -0.2},
    "secret": {"token": 0.5, "password": 0.5, "passwd": 0.5, "secret": 0.5, "apikey": 0.5, "api": 0.3, "key": 0.3, "http": -0.4, "https": -0.4, "sha": -0.2},
}
_WORD = re.compile(r"[a-z]+")
BEFORE_VALIDATION = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "secret": 0.2}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        for d in c if c.isdigit() else str(ord(c) - 55):
            rest = (rest * 10 + ord(d) - 48) % 97
    return rest == 1


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_DIGIT.findall(s)) <= 15


def _iban_ok(s: str) -> bool:
    d = s.replace(" ", "")
    return 15 <= len(d) <= 34 and mod97(d)


def _secret_ok(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches; after one, the next may begin within the same run of characters."""
    at = 0
    while True:
        m = (_EMAIL_ON.match(text, at) if at else None) or _EMAIL.search(text, at)
        if m is None:
            return
        yield m
        at = m.end()


#: kind, finder, validator, a string every match contains (a cheap first look; "" for none)
RULES = (
    ("email", _emails, None, "@"), ("ip", _IP.finditer, _ip_ok, "."), ("card", _CARD.finditer, _card_ok, ""), ("phone", _PHONE.finditer, _phone_ok, "+"),
    ("iban", _IBAN.finditer, _iban_ok, ""), ("ssn", _SSN.finditer, None, "-"), ("secret", _SECRET.finditer, _secret_ok, ""),
)


def near_words(text: str, start: int, end: int) -> set[str]:
    """Words of letters of which some part is near the span."""
    a, b = max(0, start - WINDOW), min(len(text), end + WINDOW)
    while a > 0 and start - a < 2 * WINDOW and text[a - 1].isalpha():  # not the tail of a longer word
        a -= 1
    while b < len(text) and b - end < 2 * WINDOW and text[b].isalpha():
        b += 1
    return {*_WORD.findall(text[a:start].lower()), *_WORD.findall(text[end:b].lower())}


def context_score(kind: str, text: str, start: int, end: int) -> float:
    near = near_words(text, start, end)
    return BEFORE_VALIDATION[kind] + sum(v for w, v in CONTEXT[kind].items() if w in near)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    out = []
    digits = _DIGIT.search(text) is not None
    for kind, find, valid, sign in RULES:
        if (kind != "email" and not digits) or sign not in text:
            continue
        for m in find(text):
            if valid is not None and not valid(m[0]):
                continue
            score = min(1.0, max(0.0, context_score(kind, text, m.start(), m.end())))
            if kind in BASE or score >= THRESHOLD:
                out.append((kind, m.start(), m.end(), round(score, 3)))
    return out


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base spans, all spans and their scores, one row per document."""
    form = arrow(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1):
                found = spans(t.as_py() or "")
                kinds = [f[0] for f in found]
                row = (*(kinds.count(k) for k in BASE), _joined([f for f in found if f[0] in BASE]), _joined(found), ",".join(str(f[3]) for f in found))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(form)[1:], strict=True))], schema=form)

    return id_text(docs).mapInArrow(run, COUNTS)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            new = [None if t is None else mask(t) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "scores")
