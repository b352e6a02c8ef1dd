"""Added spans of the secret scan against the ratio computed string by string."""

import random
import re
import string

import pytest

from pelagica.llm import secrets
from pelagica.llm.common import ready


@pytest.fixture(scope="module")
def fitted(spark):
    ready(spark)
    rng = random.Random(6)
    words = ["configuration", "session", "handler", "connection", "internationalisation", "response_code", "maximum-value", "path/to/file"]
    texts = []
    for _ in range(300):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(16, 40)))
        texts.append(f"{' '.join(rng.choices(words, k=30))} token={value} {' '.join(rng.choices(words, k=9))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return secrets.fit_markov(docs)


def ratio(model, value):
    at = [secrets.LETTERS.index(c) for c in value]
    return sum(round(model[a * len(secrets.LETTERS) + b], 5) for a, b in zip(at, at[1:])) / (len(at) - 1)


def brute(model, text):
    kept = []
    for kind, pattern in enumerate((secrets.ASSIGN.replace("(?i:", "(?:"), secrets.ACCESS, secrets.HEX)):
        for m in re.finditer(pattern, text, re.I if kind == 0 else 0):
            if kind or len(m.group(2)) >= 8:
                kept.append(m.span())
    hidden = list(text)
    for s, e in kept:
        hidden[s:e] = ["\u0002"] * (e - s)
    return [m.span() for m in re.finditer(secrets.STRING, "".join(hidden)) if ratio(model, m.group()) > secrets.MARGIN]


def test_added_spans_follow_the_ratio_alone(spark, fitted):
    rng = random.Random(7)
    alphabets = [string.ascii_lowercase, string.digits, string.ascii_letters + string.digits, string.ascii_uppercase, "0123456789abcdef"]
    made = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randint(10, 50)))
    plain = ["configurationhandlerconnection", "internationalisation", "sessionhandlerresponse_code", "é", "token = abc", "AKIA" + "B" * 20]
    texts = [" ".join(rng.choice([made(), rng.choice(plain), f"secret:{made()}", made() + "deadbeef" * 5 + made()]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, base string").repartition(3)
    got = {r.doc_id: [(x.s, x.e) for x in r.added] for r in secrets.find_secrets(frame, model=fitted).collect()}
    want = {i: brute(fitted, t or "") for i, t in enumerate([*texts, None, ""])}
    assert got == want and sum(map(len, want.values())) > 100
    assert secrets.find_secrets(frame.limit(0), model=fitted).count() == 0


@pytest.mark.parametrize("alphabet, size, share", [(string.ascii_lowercase, 16, 0.8), (string.digits, 24, 0.99), (string.ascii_letters + string.digits, 16, 0.97)])
def test_random_strings_of_any_alphabet_are_found(fitted, alphabet, size, share):
    rng = random.Random(8)
    found = sum(ratio(fitted, "".join(rng.choice(alphabet) for _ in range(size))) > secrets.MARGIN for _ in range(300))
    assert found >= share * 300


def test_what_is_left_beside_a_base_span_is_rated(spark, fitted):
    left = "Zk3xQ9vLw2TbY7Rj58Hn"
    text = f"{left}{'0123456789abcdef' * 2}"
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=fitted).first()
    assert [(x.s, x.e) for x in row.base] == [(20, 52)] and [(x.s, x.e) for x in row.added] == [(0, 20)]
