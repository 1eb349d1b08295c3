"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds are email, ip, card (Luhn) and phone; their matches stay whatever their score.
The method adds iban (mod-97) and secret (a key, token or password set to a value) where
the score, after checksums and whole words within CONTEXT characters on either side, weighted by
their distance, reaches THRESHOLD: a code beside "sample" or "part" is left out.

Defined cases: null or empty text has no spans; a null doc_id is carried along; repeated
rows each get their result; an empty table gives an empty result; extra columns are not read.
Every scan is linear in the text: anchors ('@', '+', the first digit of a run) are found
first and each run of characters is looked at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import _text

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
CONTEXT, THRESHOLD = 48, 0.5

# Patterns of the base kinds.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind keeps a failing digit run from being tried again at each of its digits.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Kinds that the method adds.
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"\b(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})", re.I)

# Words near a span that raise or lower its score, and what lowers it inside.
_RAISE = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account", "transfer"), "secret": ("secret", "private", "auth", "login"),
}
_LOWER = {
    "email": ("noreply",), "ip": ("version", "release", "section"), "card": ("order", "isbn", "hash"),
    "phone": ("order",), "iban": ("sample", "part", "serial"), "secret": ("sample", "example", "dummy"),
}
_INSIDE = {"email": ("example.com", "noreply"), "phone": ("555-01",), "secret": ("xxxx", "<your", "placeholder")}
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "secret": 0.65}
#: What a word directly beside a span adds or takes; it falls to nothing at CONTEXT characters.
UP, DOWN = 0.2, 0.3
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    compact = code.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ends(m: re.Match) -> Iterator[int]:
    """The match's end, and the ends of its words before: a word that follows a code may look like a part of it."""
    end = m.end()
    while end - m.start() >= 15:
        yield end
        end = m.string.rfind(" ", m.start(), end)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
            at = m.end() - 1
        at = text.find("+", at + 1)


def _near(text: str, start: int, end: int) -> dict[str, float]:
    """Whole words on both sides of a stretch, each with its nearness: 1 directly beside it, 0 at CONTEXT characters."""
    out: dict[str, float] = {}
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    for m in _WORD.finditer(text, lo, start):
        if m.start() > lo or lo == 0 or not text[lo - 1].isalpha():
            out[m[0].lower()] = 1 - (start - m.end()) / CONTEXT
    for m in _WORD.finditer(text, end, hi):
        if m.end() < hi or hi == len(text) or not text[hi].isalpha():
            out[m[0].lower()] = max(out.get(m[0].lower(), 0.0), 1 - (m.start() - end) / CONTEXT)
    return out


def _score(text: str, kind: str, start: int, end: int, around: tuple[int, int] | None = None) -> float:
    """A span's score from its kind, the words around it (or around a wider stretch) and what is inside."""
    near = _near(text, *(around or (start, end)))
    up, down = (max((near.get(w, 0.0) for w in words[kind]), default=0.0) for words in (_RAISE, _LOWER))
    inside = any(w in text[start:end].lower() for w in _INSIDE.get(kind, ()))
    return round(min(1.0, max(0.0, _START[kind] + UP * up - DOWN * max(down, inside))), 2)


def find(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then kind as in KINDS; code points, end exclusive."""
    if not text:
        return []
    out = [Span(k, s, e, _score(text, k, s, e)) for k, s, e in _base(text)]
    for m in _IBAN.finditer(text):
        for end in _ends(m):
            if mod97(text[m.start() : end]):
                if (score := _score(text, "iban", m.start(), end)) >= THRESHOLD:
                    out.append(Span("iban", m.start(), end, score))
                break
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            mixed = any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])
            score = _score(text, "secret", *m.span(1), m.span()) - 0.2 * (not mixed)
            if score >= THRESHOLD:
                out.append(Span("secret", *m.span(1), round(score, 2)))
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id, found array<struct<kind,start,end,score>> and, if asked for, the text with <KIND> in place of spans."""

    def masked(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for x in spans:
            if x.start >= at:
                out += [text[at : x.start], f"<{x.kind.upper()}>"]
            at = max(at, x.end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                part = batch.slice(block.lo, block.n)
                texts = part.column(1).to_pylist()
                found = [find(t) for t in texts]
                columns = [part.column(0), pa.array([[x._asdict() for x in f] for f in found], kind)]
                if redact:
                    columns.append(pa.array([masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "found", *["text"] * redact]
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>" + ", text string" * redact)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[Span(**x) for x in f] for f in batch.column(1).to_pylist()]
            base = [[x for x in f if x.kind in KINDS[:4]] for f in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([sum(x.kind == k for x in f) for f in base], pa.int64()) for k in KINDS[:4]), pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string()), pa.array([_joined(f) for f in rows], pa.string()), pa.array([min((x.score for x in f), default=None) for f in rows], pa.float64())], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, least_score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return found.mapInArrow(digest, schema)
