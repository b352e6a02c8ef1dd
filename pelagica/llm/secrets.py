"""Secret scan in DataFrame operations: fixed patterns and a character Markov model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_ids, stored

# The patterns of the base kinds, in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 8

# The Markov model: characters it knows, strings it rates, and the sample it is fitted on.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STRING = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
SAMPLE_DOCS = 20_000
# Chosen on held-out strings: see the README for what it finds and what it reports wrongly.
MARGIN = 0.8
SMOOTH = 8.0
USED = 3

# Marks around a match; a text's own mark becomes a character that no pattern knows.
MARK, OTHER = "\u0001", "\u0002"


def _java(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _parts(text: str, pattern: str) -> Column:
    """The text cut at the matches of a pattern: every second part is a match.

    Nothing but the pattern's own leftmost matching decides; positions follow from the lengths of the parts.
    """
    return F.expr(f"split(regexp_replace({text}, '{_java(pattern)}', '{MARK}$0{MARK}'), '{MARK}')")


def _spans(parts: str, kind: int, keep: str = "true") -> str:
    """SQL for the spans of cut text: an array of (start, end, kind, value) in code points."""
    return f"""if(size({parts}) < 2, cast(array() as array<struct<s:int,e:int,k:int,v:string>>), filter(transform(
        sequence(1, int(size({parts}) / 2)),
        i -> named_struct(
          's', aggregate(slice({parts}, 1, 2 * i - 1), 0, (n, p) -> n + length(p)),
          'e', aggregate(slice({parts}, 1, 2 * i), 0, (n, p) -> n + length(p)),
          'k', {kind}, 'v', element_at({parts}, 2 * i))), x -> {keep}))"""


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, x_text, x_base``: the spans of the three base kinds by start, then kind."""
    long_value = f"length(regexp_extract(x.v, '{_java(ASSIGN)}', 2)) >= {ASSIGN_LENGTH}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    return (
        docs.select(F.col(id_col).alias("doc_id"), clean.alias("x_text"))
        .select(
            "doc_id", "x_text",
            _parts("x_text", ASSIGN).alias("x_a"), _parts("x_text", ACCESS).alias("x_k"), _parts("x_text", HEX).alias("x_h"),
        )
        .withColumn(
            "x_base",
            F.expr(f"array_sort(concat({_spans('x_a', 0, long_value)}, {_spans('x_k', 1)}, {_spans('x_h', 2)}))"),
        )
        .drop("x_a", "x_k", "x_h")
    )


def _masked(text: str, pattern: str, keep: str = "true") -> Column:
    """The text with every match that ``keep`` takes (as ``x``) replaced by as many characters that no pattern knows."""
    cut = f"split(regexp_replace({text}, '{_java(pattern)}', '{MARK}$0{MARK}'), '{MARK}')"
    return F.expr(f"array_join(transform({cut}, (x, i) -> if(i % 2 = 1 and {keep}, repeat('{OTHER}', length(x)), x)), '')")


def _pairs(strings: DataFrame, column: str) -> DataFrame:
    """Counts of neighbouring characters in a column of strings: ``pair, n``."""
    pair = F.explode(F.expr(f"transform(sequence(1, length({column}) - 1), i -> substr({column}, i, 2))"))
    return strings.where(F.length(column) > 1).select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _log_table(counts: dict[str, int], blend: float) -> list[list[float]]:
    """Log-probabilities of the next character; ``blend`` of them uniform.

    Pairs are smoothed towards the frequency of the next character alone, and that by one for each character.
    """
    size = len(LETTERS)
    single = {b: 1 + sum(counts.get(a + b, 0) for a in LETTERS) for b in LETTERS}
    whole = sum(single.values())
    table = []
    for a in LETTERS:
        total = sum(counts.get(a + b, 0) for b in LETTERS)
        row = [(counts.get(a + b, 0) + SMOOTH * single[b] / whole) / (total + SMOOTH) for b in LETTERS]
        table.append([math.log((1 - blend) * p + blend / size) for p in row])
    return table


def fit_markov(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS
) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every pair of known characters.

    The labelled samples come from ``sample_docs`` documents, chosen by the hash of their id
    (a bound on the training rows only): values that the base patterns mark are the random strings, other strings
    of six or more known characters that ``USED`` or more of the documents hold, in the forms that programs give
    to words, the ordinary identifiers.  Of the random model half is
    uniform, so that alphabets which the samples don't show are covered.  At most
    ``len(LETTERS) ** 2`` counts for each model reach the driver.
    """
    chosen = sample_ids(docs, id_col, sample_docs)
    few = docs.join(chosen, docs[id_col] == chosen["x_id"], "left_semi")
    spans = stored(base_spans(few, id_col, text_col), "spans")
    value = F.expr(f"transform(x_base, x -> if(x.k = 0, regexp_extract(x.v, '{_java(ASSIGN)}', 2), x.v))")
    random = spans.select(F.explode(value).alias("v"))
    # take the marked values out before the ordinary strings are collected
    rest = F.expr("aggregate(x_base, x_text, (t, x) -> replace(t, x.v, ' '))")
    words = F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))
    # an identifier is used again and again, a random string is not
    used = spans.select(F.explode(F.array_distinct(words)).alias("v")).groupBy("v").count().where(f"count >= {USED}")
    # the forms in which programs write such words
    forms = "array(v, upper(v), concat(v, initcap(v)), concat(v, '_', v), concat(v, '-', v), concat(upper(v), '_', upper(v)), concat(v, '/', v))"
    ordinary = used.select(F.expr(f"explode({forms})").alias("v"))
    tables = []
    for strings, blend in ((random, 0.5), (ordinary, 0.0)):
        known = _pairs(strings, "v").where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
        tables.append(_log_table({r["pair"]: r["n"] for r in known.collect()}, blend))
    return [x - y for a, b in zip(*tables) for x, y in zip(a, b)]


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: list[float] | None = None,
    margin: float = MARGIN,
) -> DataFrame:
    """``doc_id, base, added``: spans of secrets in every whole text.

    ``base`` holds the spans of the fixed patterns, ``added`` the further strings of 16 or more
    known characters, what is left beside base spans among them, whose mean log-likelihood ratio for each pair of characters
    exceeds ``margin``: the ratio alone decides.  Spans are structs of start, end (exclusive, in code points), kind number and
    value.  Null and empty texts have no spans, very long ones are searched whole; repeated rows each get their row, an empty table
    gives none; other columns are ignored.
    """
    ratios = fit_markov(docs, id_col, text_col) if model is None else model
    table = f"cast(split('{','.join(f'{r:.5f}' for r in ratios)}', ',') as array<double>)"
    n = len(LETTERS)
    codes = f"transform(split(x.v, ''), c -> locate(c, '{LETTERS}'))"
    mean = f"""aggregate(sequence(2, size(x.c)), 0D,
        (t, i) -> t + element_at(x_table, (x.c[i - 2] - 1) * {n} + x.c[i - 1])) / (size(x.c) - 1)"""
    free = "not exists(x_base, b -> b.s < x.e and x.s < b.e)"
    return (
        base_spans(docs, id_col, text_col)
        .withColumn("x_text", _masked("x_text", ASSIGN, f"length(regexp_extract(x, '{_java(ASSIGN)}', 2)) >= {ASSIGN_LENGTH}"))
        .withColumn("x_text", _masked("x_text", ACCESS))
        .withColumn("x_text", _masked("x_text", HEX))
        .withColumn("x_parts", _parts("x_text", STRING))
        .drop("x_text")
        .withColumn("x_more", F.expr(_spans("x_parts", 3)))
        .withColumn("x_more", F.expr(f"filter(x_more, x -> {free})"))
        .withColumn("x_more", F.expr(f"transform(x_more, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', x.v, 'c', {codes}))"))
        .withColumn("x_table", F.expr(table))
        .withColumn("x_more", F.expr(f"filter(x_more, x -> {mean} > {margin})"))
        .select(
            "doc_id",
            F.col("x_base").alias("base"),
            F.expr("transform(x_more, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', x.v))").alias("added"),
        )
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` gives."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = "array_join(transform({}, x -> concat_ws(':', element_at(array(" + names + "), x.k + 1), x.s, x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(text.format("base")), 256).alias("base_sha256"),
        F.expr(text.format("array_sort(concat(base, added))")).alias("spans"),
    )
