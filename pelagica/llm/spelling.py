"""Spelling variants: words one edit apart, found through two disjoint chunks of the one and positional grams of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Characters of words, and how an occurrence in 97 is damaged.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED = 97
LENGTH, COUNT = 5, 3
# Code points of a piece, and the most pieces a half is cut into.
PIECE, PIECES = 3, 8


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = None) -> DataFrame:
    """``word``: every run of letters of every whole text, only A-Z lower-cased.

    With ``damaged`` given, a run loses one code point where the CRC-32 of ``<id>:<run>`` is a multiple of it.  Null and
    empty texts have no runs; a null id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if damaged is None:
        return rows.select(F.col("run").alias("word"))
    cut = F.expr("concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2))")
    hashed = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    return hashed.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``length`` code points and ``count`` occurrences."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _keys(longer: int) -> Column:
    """The ways to leave out one piece of a word: what stays is the join key, what is left out is compared.

    For ``longer`` 0 the word's own halves are the two chunks.  For 1 they are those of a word shorter by one code point,
    looked up as grams of this one: a chunk before the left-out piece at its own position, a chunk behind it one on.
    """
    size = f"(length(word) - {longer})"
    half = f"({size} div 2)"
    lo, width = f"if(i = 0, 0, {half})", f"if(i = 0, {half}, {size} - {half})"
    pieces = f"greatest(2, least({PIECES}, ceil(({size} - {half}) / {PIECE})))"
    a, b = f"int({lo} + ({width} * k) div {pieces})", f"int({lo} + ({width} * (k + 1)) div {pieces})"
    one = f"""transform(sequence(0, int({pieces}) - 1), k -> named_struct(
        'size', {size}, 'half', i, 'piece', k,
        'stays', concat(left(word, {a}), substr(word, {b} + {longer} + 1)),
        'mid', substr(word, {a} + 1, {b} + {longer} - {a})))"""
    return F.expr(f"flatten(transform(sequence(0, 1), i -> {one}))")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of words that differ by one inserted, deleted or replaced code point, once.

    ``words`` has distinct ``word`` and their ``n``.  The shorter word (of equal ones either) gives two disjoint chunks, its
    halves; one edit leaves one of them whole, and the other word has it as a gram at the same position, or one on.
    Buckets of a chunk are cut by the same rule: of the pieces of the half with the edit all but one stay.  So the key is
    all but one piece of a word, the rows of a key differ in at most ``PIECE`` code points (longer pieces only in words of more than 48),
    and the left-out pieces are compared inside the equality join.  A replaced code point lies in one piece; an
    inserted one between pieces counts for the earlier piece alone.  So no pair comes twice and none is lost.
    """
    def side(longer: int) -> DataFrame:
        keyed = words.where(F.length("word") > longer + 1).select("word", "n", F.explode(_keys(longer)).alias("k"))
        return keyed.select("word", "n", "k.*", F.lit(longer).alias("longer"))

    chunks = side(0).drop("longer").withColumnsRenamed({"word": "a", "n": "a_n", "mid": "a_mid"})
    grams = side(0).union(side(1)).withColumnsRenamed({"word": "b", "n": "b_n", "mid": "b_mid"})
    one_edit = F.levenshtein("a_mid", "b_mid", 1) == 1
    once = F.expr("if(longer = 0, a < b, (half = 0 and piece = 0) or a_mid <> substr(b_mid, 2))")
    both = chunks.join(grams, ["size", "half", "piece", "stays"]).where(one_edit & once)
    return both.select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of every chain of ``word, form``, by doubling the steps; chains have no circles.

    Each round doubles the steps known.  Counts at least double along a chain of forms, so that it has less than 64 steps.
    """
    reach = stored(forms.select("word", F.col("form").alias("root")), "reach")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(reach.join(on, "root", "left"), "reach")
        if further.where("next is not null").isEmpty():
            return reach
        reach = further.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (distinct ``word`` and their ``n``).

    ``form`` is the near word of the largest ``n`` (of equal ones the smallest in code-point order) if that is at least
    twice the word's own, else null; ``root`` follows forms to the last and is the word itself without one.  Words with
    no near word have ``n_near`` 0.  An empty table gives no rows; other columns are ignored; a null word or null ``n`` is left out.
    """
    words = stored(words.select("word", "n").where("word is not null and n is not null"), "words")
    ways = F.explode(F.expr("array(named_struct('word', a, 'near', b, 'm', b_n), named_struct('word', b, 'near', a, 'm', a_n))"))
    pairs = near_pairs(words).select(ways.alias("w")).select("w.*")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(-best.m >= 2 * n, best.near, null)").alias("form"),
        F.expr("if(-best.m >= 2 * n, -best.m, null)").alias("form_n"),
    )
    known = stored(joined, "forms")
    reach = roots(known.where("form is not null"))
    found = known.join(reach, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = None, length: int = LENGTH, count: int = COUNT
) -> DataFrame:
    """Variant groups (see ``group_variants``) of the words of all texts.

    Words come from whole texts of all rows, repeated rows counting again; null and empty texts have none; a very long
    run is a word like any other.  Columns besides the id and the text are ignored, whatever their names.
    """
    return group_variants(count_words(occurrences(docs, id_col, text_col, damaged), length, count))
