"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their listed order; the first four are the base kinds, whose spans always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "amex", "national")
BASE = 4
THRESHOLD = 0.6
# Code points looked at before and after a span for context words.
BEFORE, AFTER = 48, 24

# The base patterns, in forms that look at no character twice.  A run can't start inside itself, as its
# continuation would be the same, so looking behind for its start finds the same leftmost matches.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of the added kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
AMEX = re.compile(r"(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}(?:[\x20-]?)[0-9]{6}(?:[\x20-]?)[0-9]{5}(?![\x20-]?[0-9])")
NATIONAL = re.compile(r"(?<![0-9+.)(-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-][0-9]{3,4}(?:[\x20.-][0-9]{2,5}){1,3}(?![0-9])")

# IBAN lengths by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Score of a confirmed match without context, and the words that raise or lower it, in the languages of the corpus.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "amex": 0.5, "national": 0.3}
STEP = 0.3
RAISE = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write|reply",
    "ip": "ip|address|adresse|direcci[oó]n|host|server|client|login|peer",
    "card": "card|visa|mastercard|credit|debit|payment|karte|kreditkarte|carte|tarjeta|cc",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[oó]vil",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta|virement",
    "ssn": "ssn|social security|social|security|taxpayer|tin",
    "amex": "card|amex|american express|credit|payment|karte|carte|tarjeta",
    "national": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[oó]vil",
}
LOWER = {
    "email": "example|noreply", "ip": "version|release|section|chapter|kapitel|chapitre|build",
    "card": "order|tracking|serial|isbn|invoice|sku", "phone": "order|isbn|serial|version",
    "iban": "serial|part|sku", "ssn": "part|order|serial|sku|isbn|ticket", "amex": "order|tracking|serial|isbn|sku",
    "national": "order|isbn|serial|version|part|sku|invoice",
}


def _words(alternatives: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![^\W\d_])(?:{alternatives})(?![^\W\d_])", re.IGNORECASE)


_RAISE, _LOWER = ({k: _words(v) for k, v in table.items()} for table in (RAISE, LOWER))


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    score: float
    value: str


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """Whether the check digits of an IBAN (no spaces) hold."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for tail in EMAIL_TAIL.finditer(text):
        start = tail.start()
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < tail.start():
            last = tail.end()
            yield start, last


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        # a part of hundreds of digits is no number to parse
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        if not length:
            continue
        at, code = m.start(), ""
        while len(code) < length and at < len(text):
            c = text[at]
            if c == " " and code and text[at - 1] != " ":
                at += 1
                continue
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            code += c
            at += 1
        follows = text[at : at + 1]
        if len(code) == length and not (follows.isascii() and follows.isalnum()) and mod97(code):
            yield m.start(), at


def _plain(pattern: re.Pattern[str], holds: Callable[[str], bool] = lambda _: True) -> Callable[[str], Iterator[tuple[int, int]]]:
    def find(text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(text) if holds("".join(filter(str.isdigit, m.group()))))

    return find


FINDERS = (
    _emails, _ips, _cards, _phones, _ibans, _plain(SSN), _plain(AMEX, luhn), _plain(NATIONAL, lambda d: 8 <= len(d) <= 13),
)


def score(text: str, kind: int, start: int, end: int) -> float:
    """Score of a confirmed span: that of its kind, moved by context words at most ``BEFORE`` or ``AFTER`` code points away."""
    name = KINDS[kind]
    near = f"{text[max(0, start - BEFORE) : start]}\n{text[end : end + AFTER]}"
    points = SCORES[name] + STEP * bool(_RAISE[name].search(near)) - STEP * bool(_LOWER[name].search(near))
    return round(min(1.0, max(0.0, points)), 2)


def text_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of one text by kind, then start; see ``find_personal``."""
    if not text:
        return []
    found: list[Span] = []
    for kind, finder in enumerate(FINDERS):
        taken = sorted((x.start, x.end) for x in found) if kind >= BASE else []
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for start, end in finder(text):
            points = score(text, kind, start, end)
            before = bisect_left(starts, end)  # spans that start before this one's end
            if kind >= BASE and (points < threshold or before and ends[before - 1] > start):
                continue
            found.append(Span(kind, start, end, points, text[start:end]))
    return found


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans``: personal data in every whole text.

    Spans are structs of kind number, start, end (exclusive, in code points), score and value, by kind and start.  The base
    kinds (e-mail, IP address, card with Luhn's check, phone) take the leftmost matches that do not overlap within their
    kind; those that fail their check are dropped and not tried again in other lengths.  Further kinds are IBANs (length of
    the country, remainder 1 modulo 97), social security numbers, 15-digit cards and national phone numbers: they need a
    score of ``threshold`` and overlap no span found before.  The score of a kind rises or falls by 0.3 for a
    context word nearby; it never removes a base span.

    Null and empty texts have an empty list; very long texts are searched whole in linear time; repeated rows and rows with
    a null id each get their row; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("kind", "s", "e", "score", "value"), x)) for x in text_spans(t.as_py(), threshold)]
                for t in batch.column(1)
            ]
            yield pa.record_batch([batch.column(0), pa.array(rows, type=shape)], names=["doc_id", "spans"])

    schema = f"doc_id {kind}, spans array<struct<kind:int,s:int,e:int,score:double,value:string>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_personal`` gives."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = "array_join(transform({}, x -> concat_ws(':', element_at(array(" + names + "), x.kind + 1), x.s, x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(text.format(f"filter(spans, x -> x.kind < {BASE})")), 256).alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )
