"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_ids

# Fixed values of HTML: elements without content, with raw text, that are never shown, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noframes iframe object svg math canvas audio video textarea select datalist option button title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
# Elements that a start tag of the same group closes, and what a paragraph's end needs no tag for.
CLOSED_BY_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = frozenset("table ul ol dl body html article section div main".split())

# Unseen elements that a reader's page would lose by a missing end tag, and the parts of a page that can't stand inside them.
SOFT = frozenset("button option select datalist object audio video canvas".split())
PARTS = frozenset("article main section nav aside header footer form table body".split())
HEAD = ("head", False)
IN_HEAD = frozenset("html head title base link meta style script noscript template".split())

# Groups give nothing back, so that a tag that never ends is looked at once.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style|textarea|title|noscript|iframe|noframes|xmp)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>",  # a tag with a quote that never ends
    re.S | re.I,
)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Training: pages made by rule, and labelled pages of the corpus (a bound on the fit only).
MADE_PAGES = 160
CORPUS_PAGES = 40
SAMPLE_BYTES = 20_000
ROUNDS = 12
SEED = 7
# Names that page authors give to the parts of a page.
CONTENT_NAMES = "article content post entry story body main text post-body entry-content article-body story-body page-content".split()
OTHER_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar pagination pager toc skip-link".split(),
    "header": "header masthead site-header banner branding logo hero-header".split(),
    "footer": "footer site-footer copyright legal colophon bottom-bar".split(),
    "aside": "sidebar aside related recommended widget trending popular most-read more-stories links rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense".split(),
    "notice": "notice cookie cookies consent gdpr alert privacy popup modal overlay paywall subscribe-notice announcement".split(),
    "form": "form search newsletter subscribe signup login contact-form feedback".split(),
    "comments": "comments comment comment-list responses discussion replies disqus respond".split(),
    "share": "share social sharing share-buttons social-links follow tags byline-links author-links".split(),
}


@dataclass
class Node:
    """An element: its tag, names of class and id, place in the tree, and own blocks of text."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    own: int = 0
    linked: int = 0
    blocks: list[tuple[int, str]] = field(default_factory=list)
    label: int | None = None


def parse(page: str) -> list[Node]:
    """Elements in page order; a node's blocks carry their place in the page.

    Inline elements belong to the block around them, ``br`` is white space.  Missing end tags of paragraphs,
    items and cells are closed as browsers do, unknown end tags are passed over, and a tag cut off by the page's end is dropped.  ``head``
    ends at the first thing that can't stand in it.  What is not shown (``UNSEEN``, and inline elements that are hidden) ends with
    its own tag; controls and hidden inline elements also with the block around them, or where a part of the page (``PARTS``) starts.
    """
    nodes = [Node("html", -1)]
    stack = [0]
    standing: Counter[str] = Counter()
    inline: list[str] = []
    pieces: list[str] = []
    links = 0
    places = 0
    # unseen elements that are open, each with whether it is a soft one, how many of each tag and kind, and the blocks opened inside them
    hidden: list[tuple[str, bool]] = []
    covered: Counter[str | bool] = Counter()
    inner: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal places
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                nodes[stack[-1]].blocks.append((places, text))
                places += 1

    def show() -> None:
        hidden.clear()
        covered.clear()
        inner.clear()

    def hide(tag: str, soft: bool) -> None:
        hidden.append((tag, soft))
        covered[tag] += 1
        covered[soft] += 1

    def leave(depth: int) -> None:
        for i in stack[depth:]:
            standing[nodes[i].tag] -= 1
        del stack[depth:]

    def add(text: str) -> None:
        if hidden == [HEAD] and not text.isspace():
            show()
        if hidden or not text:
            return
        pieces.append(text)
        n = len(text.strip())
        nodes[stack[-1]].own += n
        if links:
            nodes[stack[-1]].linked += n

    at = 0
    cut = False
    # no tag ends after the last of these
    last = page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            cut = at == last and (
                m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->"))
                or m[1] is not None and not re.search(rf"</{m[1]}\s*>$", m[0], re.I)
            )
            continue
        if m[2]:
            if hidden:
                if covered[tag]:
                    name = ""
                    while name != tag:
                        name, is_soft = hidden.pop()
                        covered[name] -= 1
                        covered[is_soft] -= 1
                    if not hidden:
                        inner.clear()
                    continue
                if inner[tag]:
                    inner[tag] -= 1
                    continue
                if not (not covered[False] and standing[tag] or hidden == [HEAD] and tag in ("body", "html")):
                    continue
                show()
            if tag in BLOCKS:
                end_block()
                if standing[tag]:
                    depth = len(stack) - 1
                    while nodes[stack[depth]].tag != tag:
                        depth -= 1
                    leave(depth)
                    inline.clear()
                    links = 0
            elif tag in inline:
                while inline.pop() != tag:
                    pass
                links = inline.count("a")
            continue
        closed = m[4].rstrip().endswith("/")
        if hidden:
            if tag in PARTS and not covered[False] or hidden == [HEAD] and tag not in IN_HEAD or tag == "body" and hidden[0] == HEAD:
                show()
            elif tag in BLOCKS:
                inner[tag] += 1
                continue
            else:
                if tag not in VOID and not closed and (tag in UNSEEN or covered[tag]) and not (tag == "option" == hidden[-1][0]):
                    hide(tag, tag in SOFT or tag not in UNSEEN)
                continue
        if tag == "br":
            add(" ")
            continue
        if tag in UNSEEN:
            if not (closed and tag in ("svg", "math")):
                hide(tag, tag in SOFT)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        names: list[str] = []
        gone = False
        if m[4].strip():
            for a in ATTRIBUTE.finditer(m[4]):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key in ("class", "id", "role", "itemprop"):
                    names += [n.lower() for n in NAMES.findall(value)]
                elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    gone = True
                elif key == "aria-hidden" and value == "true":
                    gone |= tag in BLOCKS
        if tag not in BLOCKS:
            if gone and not closed:
                hide(tag, True)
                continue
            inline.append(tag)
            links += tag == "a"
            continue
        end_block()
        links = 0
        inline.clear()
        if tag in ("html", "body"):
            nodes[stack[-1] if tag == "body" else 0].names += tuple(names)
            continue
        closes = CLOSED_BY_SAME.get(tag, set())
        if nodes[stack[-1]].tag == "p":
            leave(len(stack) - 1)
        if closes and any(standing[c] for c in closes):
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in closes:
                    leave(depth)
                    if tag not in ("tbody", "tfoot", "tr"):
                        break
                elif nodes[stack[depth]].tag in SCOPES:
                    break
        nodes.append(Node(tag, stack[-1], tuple(names) + (("hidden",) if gone else ())))
        stack.append(len(nodes) - 1)
        standing[tag] += 1
    if not cut:
        tail = UNENDED.split(page[at:], maxsplit=1)[0]
        if tail:
            add(tail)
    end_block()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the binary features of every node."""
    below = [n.own for n in nodes]
    linked = [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
        linked[nodes[i].parent] += linked[i]
    found = []
    for i, node in enumerate(nodes):
        text = " ".join(t for _, t in node.blocks)
        row = ["bias", f"tag={node.tag}", *(f"name={n}" for n in set(node.names))]
        row.append(f"size={min(9, below[i].bit_length())}")
        row.append(f"links={int(4 * linked[i] / below[i]) if below[i] else 'none'}")
        if text:
            row.append(f"own={min(10, len(text).bit_length())}")
            row.append("ends" if text[-1] in ".!?…\"'”’»:" else "open")
            if "©" in text:
                row.append("copyright")
        if node.parent >= 0:
            row.append(f"in={nodes[node.parent].tag}")
        found.append(row)
    return found


@dataclass
class TreeModel:
    """Weights of node features, and the potential of each pair of parent and child labels."""

    weights: dict[str, float]
    edges: list[list[float]]

    def marginals(self, nodes: list[Node], rows: list[list[str]]) -> tuple[list[float], list[list[list[float]]]]:
        """Chance of every node to be content, and of every pair of parent and child labels.

        Sum-product: messages go up from the leaves, then down from the root, in page order, in which parents
        stand before their children.
        """
        n = len(nodes)
        e = [[math.exp(x) for x in row] for row in self.edges]
        get = self.weights.get
        here = []
        for row in rows:
            s = max(-30.0, min(30.0, sum(get(f, 0.0) for f in row)))
            here.append([1 / (1 + math.exp(s)), 1 / (1 + math.exp(-s))])
        up = [h[:] for h in here]  # a node's belief from itself and all below
        sent = [[1.0, 1.0] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            a, b = (e[x][0] * up[i][0] + e[x][1] * up[i][1] for x in (0, 1))
            sent[i] = [a / (a + b), b / (a + b)]
            x, y = up[p][0] * sent[i][0], up[p][1] * sent[i][1]
            up[p] = [x / (x + y), y / (x + y)]
        whole = [u[:] for u in up]
        pairs = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
        for i in range(1, n):
            p = nodes[i].parent
            rest = [whole[p][x] / max(sent[i][x], 1e-300) for x in (0, 1)]
            pair = [[rest[x] * e[x][y] * up[i][y] for y in (0, 1)] for x in (0, 1)]
            total = sum(map(sum, pair))
            pairs[i] = [[v / total for v in row] for row in pair]
            whole[i] = [pairs[i][0][0] + pairs[i][1][0], pairs[i][0][1] + pairs[i][1][1]]
        return [w[1] for w in whole], pairs

    def text(self, page: str | None) -> str:
        """Blocks of the content nodes in page order, one a line."""
        nodes = parse(page or "")
        chance, _ = self.marginals(nodes, features(nodes))
        return "\n".join(t for _, t in sorted(b for node, c in zip(nodes, chance) if c > 0.5 for b in node.blocks))


def fit(pages: list[list[Node]], rounds: int = ROUNDS, rate: float = 0.3, ridge: float = 0.002) -> TreeModel:
    """Gradient steps on the likelihood of the labelled trees (adaptive step sizes)."""
    model = TreeModel({}, [[0.5, -0.5], [-0.5, 0.5]])
    rows = [features(nodes) for nodes in pages]
    seen: dict[str, float] = {}
    seen_e = [[1e-6, 1e-6], [1e-6, 1e-6]]
    order = list(range(len(pages)))
    chooser = random.Random(SEED)
    for _ in range(rounds):
        chooser.shuffle(order)
        for k in order:
            nodes = pages[k]
            chance, pairs = model.marginals(nodes, rows[k])
            slope: dict[str, float] = {}
            for node, row, c in zip(nodes, rows[k], chance):
                for f in row:
                    slope[f] = slope.get(f, 0.0) + node.label - c
            for f, g in slope.items():
                g -= ridge * model.weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            for x in (0, 1):
                for y in (0, 1):
                    g = -sum(p[x][y] for p in pairs[1:])
                    g += sum(nodes[n.parent].label == x and n.label == y for n in nodes[1:])
                    seen_e[x][y] += g * g
                    model.edges[x][y] += rate * g / math.sqrt(seen_e[x][y])
    return model


def label_by_mark(nodes: list[Node]) -> list[Node]:
    """Labels from the names ``keep`` and ``leave`` that made pages carry; children follow their parents."""
    for node in nodes:
        before = nodes[node.parent].label if node.parent >= 0 else 0
        node.label = 1 if "keepthis" in node.names else 0 if "leavethis" in node.names else before
        node.names = tuple(n for n in node.names if n not in ("keepthis", "leavethis"))
    return nodes


def label_by_structure(nodes: list[Node]) -> list[Node] | None:
    """Labels of a corpus page that names its one article by tag; None if it doesn't."""
    inside = {"article"}
    outside = {"nav", "header", "footer", "aside", "form", "menu", "search", "dialog"}
    if sum(n.tag in inside for n in nodes) != 1:
        return None
    known = {w for names in OTHER_NAMES.values() for name in names for w in NAMES.findall(name)}
    for node in nodes:
        before = nodes[node.parent].label if node.parent >= 0 else 0
        left = node.tag in outside or bool(known & set(node.names)) or "hidden" in node.names
        node.label = 0 if left else 1 if node.tag in inside else before
    return nodes


def made_page(rng: random.Random) -> str:
    """A page made by rule, with the parts to keep and to leave marked.

    Parts stand in varying order, under tags and names that differ from page to page.
    """

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(4, 16)).capitalize() + rng.choice("....?!")

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 5)))

    def name(kind: str, mark: str) -> str:
        chosen = rng.sample(OTHER_NAMES[kind], 1) if kind in OTHER_NAMES else rng.sample(CONTENT_NAMES, 1)
        return f'{rng.choice(["class", "class", "id"])}="{chosen[0]}" role="{mark}"'

    def content() -> str:
        tag = rng.choice(["article", "article", "main", "div", "section"])
        named = name("content", "keepthis") if tag in ("div", "section") or rng.random() < 0.5 else 'role="keepthis"'
        parts = [f"<h1>{words(6)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.65:
                parts.append(f"<p>{paragraph()}</p>")
            elif kind < 0.72:
                parts.append(f"<p><b>{sentence()}<br><p>{paragraph()}</p>")
            elif kind < 0.8:
                parts.append(f"<h2>{words(4)}</h2><p>{paragraph()}</p>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{paragraph()}</p></blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                parts.append(f"<div><p>{paragraph()} <a href='/x'>{words(2)}</a> {words(3)}.</p></div>")
            else:
                parts.append(f"<figure><figcaption>{sentence()}</figcaption></figure><pre>{words(8)}</pre>")
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), other(rng.choice(["ad", "share", "notice", "aside"])))
        if rng.random() < 0.2:
            parts.append(other(rng.choice(["comments", "form"])))
        return f"<{tag} {named}>" + "".join(parts) + f"</{tag}>"

    def linked(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(rng.randint(1, 4))}</a></li>' for _ in range(n)) + "</ul>"

    def other(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = rng.random() < 0.5 and tag != "div"
        named = 'role="leavethis"' if plain else name(kind, "leavethis")
        if tag != "div" and not plain and rng.random() < 0.6:
            tag = "div"
        if kind == "nav":
            inside = linked(rng.randint(2, 8))
        elif kind in ("aside", "share"):
            inside = rng.choice([f"<h3>{words(2)}</h3>", ""]) + rng.choice([linked(4), f"<p>{paragraph()}</p>"])
        elif kind == "comments":
            inside = f"<h3>{words(2)}</h3>" + "".join(f'<div class="comment"><p>{paragraph()}</p></div>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inside = f"<p>{sentence()}</p><label>{words(1)}</label><input name=q>"
        elif kind == "footer":
            inside = rng.choice([f"© {words(2)} · {sentence()}", f"<p>© {words(2)}</p>" + linked(3)])
        elif kind == "header":
            inside = rng.choice([words(3), f"<div>{words(2)}</div><p>{sentence()}</p>"])
        else:
            inside = rng.choice([sentence(), f"<p>{paragraph()}</p>", f"<p>{sentence()}</p><a href='/y'>{words(2)}</a>"])
        return f"<{tag} {named}>{inside}</{tag}>"

    kinds = [k for k in OTHER_NAMES if rng.random() < 0.5]
    before = [k for k in kinds if k in ("nav", "header", "ad", "notice", "form") or rng.random() < 0.2]
    after = [k for k in kinds if k not in before]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = content()
    if rng.random() < 0.3:
        middle = f'<div class="{rng.choice(["container", "wrapper", "page", "layout", "row"])}">' + middle + (other("aside") if rng.random() < 0.5 else "") + "</div>"
    return "<body>" + "".join(map(other, before)) + middle + "".join(map(other, after)) + "</body>"


def train(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = CORPUS_PAGES, made: int = MADE_PAGES,
    most_bytes: int = SAMPLE_BYTES,
) -> TreeModel:
    """Fit on ``made`` pages made by rule and on up to ``sample`` pages of the corpus, chosen by the hash of their id.

    The sample is for weights only, so it takes pages of fewer than ``most_bytes`` bytes, which bounds what the driver reads.

    A corpus page is labelled by its own structure if it has exactly one ``article`` element.
    """
    rng = random.Random(SEED)
    trees = [label_by_mark(parse(made_page(rng))) for _ in range(made)]
    chosen = sample_ids(pages, id_col, 4 * sample)
    few = pages.join(chosen, pages[id_col] == chosen["x_id"], "left_semi")
    usual = few.where(F.col(html_col).rlike("(?i)<article") & (F.octet_length(html_col) < most_bytes))
    for row in usual.select(F.xxhash64(html_col).alias("k"), F.col(html_col).alias("h")).orderBy("k").limit(sample).collect():
        labelled = label_by_structure(parse(row["h"]))
        if labelled:
            trees.append(labelled)
    return fit(trees)


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    Null or empty html, and pages without content, give an empty text; null ids and urls are kept, repeated rows
    give repeated results, other columns, of whatever name, are ignored; an empty table gives no rows.  Pages of any length, broken ones
    too, take time in proportion to their length; a node at exactly even odds is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
