"""Personal data against the patterns as they are written, and cases of the added kinds."""

import hashlib
import random
import re
import time

import pytest

from pelagica.llm import pii
from pelagica.llm.common import ready

WRITTEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    holds = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(d := re.sub("[ -]", "", v)) <= 19 and luhn(d),
        "phone": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in WRITTEN.items() for m in re.finditer(p, text or "") if holds[k](m.group())]


def texts():
    rng = random.Random(4)
    out = [None, "", "é 4111 1111 1111 1111 x", "a@b@c.de@f.g@h.i..j", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "++49 (30) 1234-567. +1 2"]
    out += ["".join(rng.choice("a@.1 -+(9é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(300):
        digits = [rng.choice("0123456789") for _ in range(rng.randint(14, 20))]
        digits[-1] = next(d for d in "0123456789" if luhn("".join(digits[:-1]) + d))
        out.append("x" * rng.randint(0, 3) + "".join(d + rng.choice(["", "", "", " ", "-"]) for d in digits) + rng.choice(["", "1", " 2", "."]))
    return out


def test_base_spans_follow_the_written_patterns(spark):
    ready(spark)
    rows = [(i if i % 9 else None, t, i, "y") for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans long, kind string").repartition(3)
    found = pii.find_personal(frame)
    want = sorted((str(i), str([(pii.KINDS.index(k), s, e) for k, s, e in base(t)])) for i, t, *_ in rows)
    got = sorted((str(r.doc_id), str([(x.kind, x.s, x.e) for x in r.spans if x.kind < pii.BASE])) for r in found.collect())
    assert got == want and sum(w[1] != "[]" for w in want) > 100
    for r in pii.digest(found).collect():
        kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in WRITTEN]
        first = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in WRITTEN)
        assert r.base_sha256 == hashlib.sha256(first.encode()).hexdigest()
    assert pii.find_personal(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Konto DE89 3704 0044 0532 0130 00 AND", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("GB83WEST12345698765432.", None, None),  # wrong remainder
        ("DE89 3704 0044 0532 0130 001", None, None),  # too long
        ("her social security number is 123-45-6789.", "ssn", "123-45-6789"),
        ("part 123-45-6789", None, None),
        ("SSN 666-45-6789", None, None),
        ("credit card 3782 822463 10005 ok", "amex", "3782 822463 10005"),
        ("card 3782 822463 10006", None, None),  # wrong check digit
        ("call (555) 555-1234 now", "national", "(555) 555-1234"),
        ("Telefon 030 1234 5678", "national", "030 1234 5678"),
        ("scores (555) 555-1234 now", None, None),
    ],
)
def test_added_kinds_need_checks_and_context(text, kind, value):
    found = pii.text_spans(text)
    assert [(pii.KINDS[x.kind], x.value) for x in found] == ([(kind, value)] if kind else [])
    for x in found:
        assert text[x.start : x.end] == x.value and x.score >= pii.THRESHOLD


def test_context_moves_the_score_and_keeps_base_spans():
    scores = [pii.text_spans(t)[0].score for t in ("your ip 10.0.0.1", "then 10.0.0.1", "version 10.0.0.1")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3


def test_added_spans_overlap_no_others():
    text = "phone +1 (555) 555-1234, card 4111-1111-1111-1111"
    assert [pii.KINDS[x.kind] for x in pii.text_spans(text)] == ["card", "phone"]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1", "a@", "@a", "+1 ", "(", "DE89", "3", "12-", "a@b.", "(12) 345 ", "1.1.1.1 call (555) 555-1234 "])
def test_very_long_texts_take_linear_time(unit):
    start = time.time()
    pii.text_spans(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 40
