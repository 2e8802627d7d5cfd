"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score.

Four base kinds (email, ip, card, phone) are reported by rule: each pattern's leftmost matches without overlap, dropped when
a check fails. Further kinds are reported when their score, with checksum and context, reaches a threshold. All patterns
take time in proportion to the text: runs are matched possessively or grown from a fixed character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import store

#: The kinds in the order in which spans at one place are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z]+")

#: What a match scores before its context is read, words near it that raise or lower the score, by how much.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
RAISE = {
    "email": {"email", "mail", "contact", "address"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
LOWER = {"version", "example", "order", "item", "invoice", "isbn", "part", "sample"}
STEP = 0.3
NEAR = 48
THRESHOLD = 0.5


#: Characters of an account number by country.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN.values())}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number with its country code passes the mod-97 check."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; each grows from its @, so long runs cost nothing."""
    free = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = m.end()
                yield start, free
        at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, with or without single blanks, that pass the check; what follows may be in capitals."""
    free = 0
    for head in _IBAN.finditer(text):
        size = IBAN.get(text[head.start() : head.start() + 2])
        rest = _IBAN_REST[size].match(text, head.end()) if size and head.start() >= free else None
        if rest and mod97(text[head.start() : rest.end()].replace(" ", "")):
            free = rest.end()
            yield head.start(), free


def _ip_ok(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def _ssn_ok(match: str) -> bool:
    area, group, serial = match.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start]) + _WORD.findall(text[end : end + NEAR])}
    return max(0.0, min(1.0, START[kind] + STEP * bool(near & RAISE[kind]) - STEP * bool(near & LOWER)))


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind; places are code points, ends exclusive. Null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("iban", *x) for x in ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text) if _ssn_ok(m[0])]
    spans = [Span(k, a, b, _score(k, text, a, b)) for k, a, b in found]
    return sorted((s for s in spans if s.kind in BASE_KINDS or s.score >= THRESHOLD), key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``pii``, an array of (kind, start, end, score); empty for null and empty texts.

    One row per input row, repeated ones included; other columns, whatever their names, are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "pii"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id long, pii {SPANS}")



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = detect(store.documents(spark, sf_dir))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), F.transform("pii", lambda s: s["score"]).alias("scores"))
