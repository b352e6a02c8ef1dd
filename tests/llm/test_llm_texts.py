"""Secrets, toxicity, licenses, benchmark leaks and page text."""

import hashlib
import os
import random
import time
import re
from collections import Counter

import pytest

from pelagica.llm import decontaminate, html_text, licenses, secrets, toxicity
from pelagica.llm.common import ready

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.1"

# secrets


def brute_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def digest(spans):
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return joined, hashlib.sha256(joined.encode()).hexdigest()


CASES = [
    "",
    None,
    "password=hunter2hunter",
    'x "API_KEY" : "abcdefgh"  é😀 token= 1234567 secret :  12345678',
    "token=api_key: longvalue123 passwd==abcdefgh",
    "AKIA" + "A1" * 6 + " AKIA" + "A" * 11 + "AKIAAKIAAKIAAKIA",
    "ab" * 16 + " zz " + "0123456789abcdef" * 2 + "g" + "f" * 31,
    "\u0001token=abcdefgh\u0001AKIA" + "B" * 12 + "\u0001\u0001",
    "é" * 50 + "secret=" + "ab" * 20 + "\npassword:\nx",
    "Token = 'ZZZZZZZZ' toKEN:   \"yyyyyyyyyy\" apikey=--------",
]


def test_base_spans(spark):
    rng = random.Random(1)
    pieces = ["token", "=", ":", " ", '"', "password", "abcdef12", "AKIA", "AKIAQQQQQQQQQQQQQQ", "0" * 31, "é", "😀", "\n", "API_KEY", "apikey", "ff", "-", "\u0001"]
    texts = CASES + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    model = [0.0] * len(secrets.LETTERS) ** 2
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs, model=model)).collect()}
    for i, text in enumerate(texts):
        spans = brute_spans(text)
        joined, sha = digest(spans)
        assert (got[i].spans, got[i].base_sha256) == (joined, sha), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_markov_adds_random_strings(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = ["er", "the", "in", "on", "tion", "al", "ment", "re", "st", "ou"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    rows = []
    for i in range(300):
        text = " ".join(word(rng.randint(1, 7)) for _ in range(60))
        if i % 3 == 0:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" end'
        rows.append((i, text))
    mixed = "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(32))
    rows += [(1000, f"see {mixed} and {word(12)}"), (1001, f"{word(9)}_{word(9)}")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert got[1000].spans == "random:4:36"
    assert sum("random" in r.spans for r in got.values()) == 1
    assert got[0].n_assign == 1 and got[0].n_hex == 1 and "random" not in got[0].spans


def test_secrets_stay_in_the_jvm_and_keep_rows(spark):
    docs = spark.createDataFrame([(None, "AKIA" + "X" * 20, 1), (4, None, 2), (4, None, 2)], DOCS + ", spans int")
    found = secrets.digest(secrets.find_secrets(docs))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert sorted((str(r.doc_id), r.n_access) for r in found.collect()) == [("4", 0), ("4", 0), ("None", 1)]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


# toxicity


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_severity_of_held_out_labels(spark):
    ready(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.rate(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select(labels["toxic"].alias("label"), "severity").collect()
    hit = Counter((r.label, r.severity >= 0.5) for r in held)
    assert hit[(1, True)] / (hit[(1, True)] + hit[(1, False)]) > 0.9
    assert hit[(0, True)] / (hit[(0, True)] + hit[(0, False)]) < 0.02
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3


def test_ordinal_scores_grow_with_marks(spark):
    ready(spark)
    rng = random.Random(4)
    plain = [f"p{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(50)]
        if i % 4 == 0:
            words += ["grobian"] * rng.randint(1, 9)
        rows.append((i, " ".join(words), "kept"))
        labels.append((i, 0, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(900, None, "n"), (901, "", "n"), (None, "grobianisch " * 20, "n"), (0, rows[0][1], "again")], DOCS + ", severity string")
    label = spark.createDataFrame(labels + [(900, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, label)
    scores = [model.severity(model.score(Counter({"grobian": n}))) for n in (0, 1, 2, 4, 8)]
    assert scores == sorted(scores) and scores[0] < 0.2 and scores[1] > 0.5 and scores[-1] > 2
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(400) if i % 4] + [900, 901])
    assert toxicity.rate(docs.limit(0), model).count() == 0


def test_no_labels_reject_nothing(spark):
    ready(spark)
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.drop_toxic(docs, model).count() == 1 and toxicity.rate(docs, model).first().severity == 0


# licenses


def test_every_wording_is_its_own_license():
    for name, wordings in licenses.TEMPLATES.items():
        for text in wordings:
            padded = f"Some words come first. {text} More words follow here.\nAnd a line."
            found = licenses.scan(padded)
            assert [f[2] for f in found] == [name], text
            assert not found[0][6] and not found[0][7]
            assert padded[found[0][0] : found[0][1]].split()[0].strip('"(') == text.split()[0].strip('"(')


def test_wording_differences_and_rejects():
    changed = licenses.TEMPLATES["MIT"][2].replace("free of charge", "without charge").replace("\n", " ")
    found = licenses.scan("Intro text.\n" + changed)
    assert [f[2] for f in found] == ["MIT"] and "free" in found[0][6] and "without" in found[0][7]
    assert licenses.scan("This work is licensed under the GNU General Public License, version 4.") == []
    assert licenses.scan("You need a license to drive a car, and permission to park it.") == []
    two = licenses.scan("Licensed under CC BY-NC 4.0. Released under the MIT License.")
    assert [f[2] for f in two] == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.scan(None) == licenses.scan("") == []
    assert licenses.scan("word " * 100_000 + "\nReleased under the MIT License.")[0][2] == "MIT"


def test_license_rows(spark):
    ready(spark)
    data = [(1, "é Released under the MIT License.", "x"), (1, "é Released under the MIT License.", "x"), (None, "Licensed under CC BY 4.0.", "x"), (2, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(data, DOCS + ", license string")
    got = sorted(((r.doc_id, r.start, r.end, r.license, r.exact) for r in licenses.find_licenses(docs).collect()), key=str)
    assert got == [(1, 2, 32, "MIT", True), (1, 2, 32, "MIT", True), (None, 0, 24, "CC-BY-4.0", True)]
    assert licenses.find_licenses(docs.limit(0)).count() == 0


# benchmark leaks


def bench_items(rng, n):
    vocabulary = ["the", "of", "in", "and"] * 12 + [f"w{i}" for i in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + rng.choice(".?")
    return [(i, " ".join(sentence(rng.randint(4, 15)) for _ in range(rng.randint(1, 4)))) for i in range(n)], sentence


def test_search_finds_all_above_the_threshold():
    rng = random.Random(6)
    items, sentence = bench_items(rng, 120)
    for block in (1, 4, 64):
        index = decontaminate.Index(items, block)
        for _ in range(30):
            text = " ".join(sentence(60) + " " + rng.choice(items)[1][: rng.randint(20, 200)] for _ in range(4))
            words = decontaminate.words_of(text)
            passage, term = index.passages(words)
            for threshold in (0.3, 0.6):
                want = {}
                for p in range(-(-len(words) // index.stride)):
                    own = set(words[p * index.stride : (p + 1) * index.stride + index.longest])
                    scores = Counter()
                    for w in own & index.terms.keys():
                        t = index.terms[w]
                        for at in range(index.first[t], index.first[t + 1]):
                            scores[int(index.item[at])] += index.score[at]
                    want |= {(p, k): round(float(s), 9) for k, s in scores.items() if s >= threshold - 1e-6}
                got = index.search(passage, term, threshold)
                assert {(int(p), int(k)): round(float(s), 9) for p, k, s in zip(*got)} == want


def test_leaks_against_brute_force(spark):
    ready(spark)
    rng = random.Random(7)
    items, sentence = bench_items(rng, 60)
    items += [(500, "Capital of France? Paris"), (501, None), (502, ""), (503, "?!"), (504, "Paris"), (None, items[3][1]), items[5]]
    docs = []
    for i in range(150):
        parts = [sentence(rng.randint(5, 120)) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            text = rng.choice(items[:60])[1].split()
            if i % 2 and len(text) > 20:
                text[rng.randrange(len(text))] = "other"
            parts.insert(rng.randint(0, len(parts)), " ".join(text))
        if i % 7 == 0:
            parts.append(rng.choice(items[:60])[1][: rng.randint(10, 80)])
        docs.append((i, " ".join(parts)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (1, docs[1][1]), (902, "paris."), (903, "It was Paris, capital of France?")]
    docs += [(904, sentence(200) + " the capital of France - Paris! " + sentence(90))]
    want = set()
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, item in items:
            whole = decontaminate.words_of(item)
            if 1 < len(whole) < 5 and any(words[k : k + len(whole)] == whole for k in range(len(words))) or len(whole) == 1 and words == whole:
                want.add((d, i))
            if len(whole) >= 5:
                q, a = decontaminate.question_and_answer(item)
                if all(decontaminate.overlap(decontaminate._shingles(p), words) >= 0.8 for p in (q, a)):
                    want.add((d, i))
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS + ", item_id int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 40
    clean = decontaminate.drop_leaks(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(frame, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(frame.limit(0), benchmark).count() == 0
    assert {(904, 500), (902, 504)} <= want and 903 not in {d for d, _ in want}


def test_one_index_equals_several(spark, monkeypatch):
    """Scores, passages and rows don't change with the number of indexes, nor with the portions a text is searched in."""
    ready(spark)
    rng = random.Random(8)
    items, sentence = bench_items(rng, 80)
    items += [(500, "Capital of France? Paris"), (501, None), (502, "")]
    docs = [(i, " ".join([sentence(40), rng.choice(items[:81])[1], sentence(90)])) for i in range(80)]
    docs.append((99, " ".join(sentence(30) for _ in range(3000)) + " " + items[7][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    (one,) = decontaminate.indexes(benchmark)
    many = list(decontaminate.indexes(benchmark, most=1500))
    assert len(many) > 5 and sum(len(i.items) for i in many) == len(one.items) == 81
    assert {(i.stride, i.longest) for i in many} == {(one.stride, one.longest)}
    for _, text in docs:
        assert sorted(leak for index in many for leak in index.leaks(text)) == sorted(one.leaks(text))
    whole = sorted(map(tuple, decontaminate.find_leaks(frame, benchmark).collect()))
    kept = sorted(r.doc_id for r in decontaminate.drop_leaks(frame, benchmark).collect())
    assert len(whole) > 50
    monkeypatch.setattr(decontaminate, "ENTRIES", 40)
    assert one.leaks(docs[-1][1]) == [leak[1:] for leak in whole if leak[0] == 99]
    monkeypatch.undo()
    monkeypatch.setattr(decontaminate, "indexes", lambda b, f=decontaminate.indexes: f(b, 1500))
    assert sorted(map(tuple, decontaminate.find_leaks(frame, benchmark).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame, benchmark).collect()) == kept


# page text


def text_of(page):
    return MODEL.text(page)


MODEL = html_text.fit([html_text.label_by_mark(html_text.parse(html_text.made_page(random.Random(i)))) for i in range(160)])
BODY = "<p>It was the first morning of the year, and nobody in the town had slept. The boats were late.</p>"


def test_blocks_and_references():
    page = f"""<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{{x:1}}</style></head><body>
      <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
      <article><h1>A  title &amp;amp; more</h1><!-- a <p>comment</p> --><p>One&nbsp;<b>bold</b>word<br>next
      line &lt;tag&gt; &#233;&copy;</p><script>var t = "</p><p>not text</p>";</script>{BODY}<p>open <b>bold<p>last one.</article>
      <footer>&copy; somebody</footer></body></html>"""
    assert text_of(page).split("\n") == [
        "A title &amp; more",
        "One boldword next line <tag> é©",
        BODY[3:-4],
        "open bold",
        "last one.",
    ]


@pytest.mark.parametrize(
    "left",
    [
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">More of it</a></li></ul></aside>',
        '<div class="cookie-notice"><p>We use cookies on this site.</p></div>',
        '<div id="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot.</p></div></div>',
        '<form action="/s"><label>Search</label><input name=q><button>Go</button></form>',
        '<div class="ad">Buy this now.</div>',
        '<header class="site-header"><div>The Daily</div></header>',
        "<noscript>Please turn it on.</noscript><template><p>hidden</p></template>",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_other_parts_are_left_out(left, inside):
    content = f"<article><h1>Title</h1>{BODY}{left if inside else ''}<p>The end came soon after that, quietly.</p></article>"
    page = f"<html><body>{'' if inside else left}{content}</body></html>"
    assert text_of(page).split("\n") == ["Title", BODY[3:-4], "The end came soon after that, quietly."]


@pytest.mark.parametrize(
    "before",
    [
        "<datalist><option value=a><option value=b></datalist>",
        "<button>Go",
        "<div class=bar><button>Go</div>",
        "<div class=bar><span hidden>Not shown</div>",
        "<select><option>One<option>Two",
        "<p><span style='display: none'>Not <span>shown</span> here</span></p>",
    ],
)
def test_controls_without_end_tags_hide_nothing_else(before):
    article = f"<article><h1>Title</h1>{BODY}<p>The end came soon after that, quietly.</p></article>"
    assert text_of(f"<html><body>{before}{article}</body></html>").split("\n") == ["Title", BODY[3:-4], "The end came soon after that, quietly."]


def test_heads_end_by_what_follows():
    article = f"<article><h1>Title</h1>{BODY}</article>"
    for page in (f"<head><title>No</title><meta charset=x>{article}", f"<html><head><script>x</script></html>{article}"):
        assert text_of(page).split("\n") == ["Title", BODY[3:-4]]


def test_buttons_and_hidden_spans_are_left_out():
    inside = "<p>One <span hidden>two <span>three</span> four</span><button><div>Press</div></button> five, and it was late.</p>"
    assert text_of(f"<article>{BODY}{inside}</article>").split("\n") == [BODY[3:-4], "One five, and it was late."]
    assert text_of(f"<article>{BODY}<p data-hidden=x>It was <b data-hidden=x>bold</b> of them.</p></article>").endswith("It was bold of them.")
    assert "div" not in text_of(f"<article>{BODY}</article><div class=x") and "seen" not in text_of(f"{BODY}<!-- a > b not seen")


@pytest.mark.parametrize(
    "broken",
    ["<div " * 200_000, "<div>" * 200_000 + "</p>" * 2000, "<!-- " * 200_000, "<a '" * 200_000 + ">", "<li><blockquote>" * 60_000, "<b hidden><i>" * 80_000, "<" * 1_000_000],
)
def test_broken_pages_of_a_megabyte_take_seconds(broken):
    start = time.monotonic()
    html_text.parse(f"<article>{BODY}</article>" + broken)
    assert time.monotonic() - start < 20


def test_made_pages_are_told_apart():
    right = total = 0
    for i in range(200):
        nodes = html_text.label_by_mark(html_text.parse(html_text.made_page(random.Random(5000 + i))))
        chance, _ = MODEL.marginals(nodes, html_text.features(nodes))
        for node, c in zip(nodes, chance):
            if node.blocks:
                total += 1
                right += (c > 0.5) == bool(node.label)
    assert right / total > 0.97


def test_sum_product_is_exact():
    """Marginals of a small tree against the sum over all labellings."""
    from itertools import product
    from math import exp

    nodes = html_text.parse("<div><p>a</p><ul><li>b<li>c</ul></div><footer>d</footer>")
    rng = random.Random(1)
    model = html_text.TreeModel({f: rng.uniform(-1, 1) for row in html_text.features(nodes) for f in row}, [[0.3, -0.7], [0.2, 0.9]])
    rows = html_text.features(nodes)
    total, one = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        s = sum(sum(model.weights[f] for f in row) * y for row, y in zip(rows, labels))
        s += sum(model.edges[labels[n.parent]][y] for n, y in zip(nodes[1:], labels[1:]))
        total += exp(s)
        for i, y in enumerate(labels):
            one[i] += exp(s) * y
    chance, _ = model.marginals(nodes, rows)
    assert chance == pytest.approx([x / total for x in one], abs=1e-9)


def test_pages(spark):
    ready(spark)
    page = f"<body><article>{BODY}</article></body>"
    broken = "<p" * 50 + '<a href="x>' + "<!-- never closed " + "<div>" * 2000
    data = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", broken, "x"), (4, "y", "plain text only", "x"), (5, "z", page * 3000, "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages, html_text.train(pages)).collect()}
    assert len(got) == 6 and got[(1, "u")] == (BODY[3:-4], len(BODY[3:-4])) and got[(2, None)] == ("", 0) and got[(None, "v")] == ("", 0)
    assert got[(5, "z")][0].count("boats") == 3000
    assert html_text.extract(pages.limit(0), MODEL).count() == 0
