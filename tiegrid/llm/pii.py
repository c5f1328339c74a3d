"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

The base spans follow fixed patterns: e-mail addresses, IPv4 addresses with
parts of at most 255, card numbers of 12 to 19 digits that pass Luhn, phone
numbers of 9 to 15 digits after a plus. Beyond them, IBANs that pass mod-97 are
confirmed by the checksum alone; national numbers, local phone numbers and
secrets need a context word nearby.
Every pattern runs in time linear in the text: runs are matched possessively
and only from their first character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from tiegrid.llm.common import id_type, map_texts, release_others, text_bytes

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "local_phone", "secret")
KINDS = BASE + EXTRA

#: What the part before the at sign may hold besides letters and digits.
LOCAL_MARKS = "._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")
DIGIT_BYTE = re.compile(rb"[0-9]")

#: Words near a span that speak for a kind, and how far to both sides they are looked for.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "key", "secret", "password"),
}
WINDOW = 40
#: The score of a confirmed pattern by kind; context adds BOOST, and what reaches KEEP is reported.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3, "secret": 0.3}
BOOST, KEEP = 0.3, 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str):
    """Spans of the e-mail pattern: each at sign takes the run before it and the domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in LOCAL_MARKS):
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str):
    """(kind, start, end) of what the patterns match and the validators confirm."""
    for start, end in emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m.group()):
            yield "iban", *m.span()
    for kind, pattern in (("ssn", SSN), ("local_phone", LOCAL_PHONE), ("secret", SECRET)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def find_spans(text: str) -> list[Span]:
    """All spans that are kept, by start and then kind. Base kinds are always kept."""
    found, taken = [], []
    for kind, start, end in proposals(text):
        score = SCORE[kind]
        near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
        if any(word in near for word in CONTEXT[kind]):
            score = min(1.0, score + BOOST)
        if kind in BASE:
            taken.append((start, end))
        elif score < KEEP:
            continue
        found.append(Span(kind, start, end, score))
    if any(s.kind not in BASE for s in found):
        found = [s for s in found if s.kind in BASE or not any(s.start < b and a < s.end for a, b in taken)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        elif s.end > at:
            at = s.end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, redacted): all spans with their scores, and the text without them.

    Offsets count code points and the end is exclusive. A null text counts as
    empty and has no spans; its redacted text is empty. Repeated rows each give
    their row; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    schema = f"{id_col} {id_type(docs, id_col)}, spans array<struct<kind:string,start:int,end:int,score:double>>, redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.decode() for t in text_bytes(batch.column(1))]
            found = [find_spans(t) for t in texts]
            clean = [redact(t, s) for t, s in zip(texts, found, strict=True)]
            columns = [batch.column(0), pa.array([[vars(s) for s in f] for f in found], kind), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "spans", "redacted"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the texts replaced by its kind in brackets; all columns and rows stay, null texts too."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(None)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                if text and (spans := find_spans(text)):
                    texts[k] = redact(text, spans)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, all spans as text."""

    def rows(texts: list[bytes]) -> list[pa.Array]:
        counts = [[0] * len(texts) for _ in BASE]
        digests, shown = [], []
        for row, raw in enumerate(texts):
            spans = find_spans(raw.decode()) if b"@" in raw or DIGIT_BYTE.search(raw) else []
            for s in spans:
                if s.kind in BASE:
                    counts[BASE.index(s.kind)][row] += 1
            digests.append(sha256(",".join(str(s) for s in spans if s.kind in BASE).encode()).hexdigest())
            shown.append(",".join(map(str, spans)))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(shown)]

    fields = ", ".join([*(f"n_{k} bigint" for k in BASE), "base_sha256 string", "spans string"])
    return map_texts(docs, rows, fields, id_col, text_col)
