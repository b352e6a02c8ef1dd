"""License texts as they are normally written: wrapped, commented, numbered."""

import random
import textwrap
import time
from itertools import accumulate

import pytest

from pelagica.llm import licenses

LONG = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts if len(text) > 80]


@pytest.mark.parametrize("width", [40, 60, 80])
@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_line_ends_do_not_matter(width, prefix):
    for name, text in LONG:
        wrapped = textwrap.fill(text, width, break_long_words=False, initial_indent=prefix, subsequent_indent=prefix)
        found = licenses.scan(f"Copyright 2020 Somebody\n\n{wrapped}\n\nOther words follow here.\n")
        assert [(f[2], f[6], f[7]) for f in found] == [(name, "", "")], (text, found)


@pytest.mark.parametrize("name,n", [("BSD-2-Clause", 2), ("BSD-3-Clause", 3)])
@pytest.mark.parametrize("width", [70, 10_000])
def test_numbered_clauses(name, n, width):
    text = licenses.TEMPLATES[name][1]
    for i, start in enumerate(["Redistributions of source", "Redistributions in binary", "Neither the name"][:n]):
        text = text.replace(start, f"\n\n{i + 1}. {start}")
    wrapped = "\n".join(textwrap.fill(p, width) for p in text.split("\n"))
    assert [f[2] for f in licenses.scan(wrapped)] == [name]


def test_more_than_eight_ranked_before_the_one_that_passes(monkeypatch):
    text = "Released under the MIT License."
    right = next(t for t in licenses.templates() if t.text == text)
    others = [t for t in licenses.templates() if t.license != "MIT"][:12]
    monkeypatch.setattr(licenses, "rank", lambda block: [(1.0, t) for t in others] + [(0.5, right)])
    assert [f[2] for f in licenses.scan(text)] == ["MIT"]


def test_long_notice_files_take_time_in_proportion():
    """Notices in a row, as one block of a megabyte: every one is found where it stands, whatever the window."""
    pick = [random.Random(n).choice(licenses.templates()).text for n in range(7_000)]
    text, starts = "\n".join(pick), list(accumulate((len(p) + 1 for p in pick), initial=0))
    assert len(text) > 1_000_000
    began = time.monotonic()
    found = licenses.scan(text)
    assert time.monotonic() - began < 60
    assert [(f[0], f[3]) for f in found] == list(zip(starts, pick))


@pytest.mark.parametrize("window", [3, 5, 40])
def test_windows_decide_nothing(monkeypatch, window):
    """Notices with words changed and other text between them: the same finds as from one window over all."""
    rng = random.Random(5)
    parts = []
    for _ in range(60):
        words = rng.choice(licenses.templates()).text.split()
        if len(words) > 20 and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        parts += [" ".join(words), " ".join(rng.choice("see file notes of copyright by hand".split()) for _ in range(rng.randrange(40))) + "."]
    text = "\n".join(parts)
    monkeypatch.setattr(licenses, "WINDOW", 10_000)
    whole = [(f[0], f[1], f[2]) for f in licenses.scan(text)]
    monkeypatch.setattr(licenses, "WINDOW", window)
    assert len(whole) >= 55
    assert [(f[0], f[1], f[2]) for f in licenses.scan(text)] == whole
