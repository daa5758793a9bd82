"""Line-first quality rules, in DataFrame functions only: no shuffle, every text in one row of one scan.

Each line is judged by itself; lines that fail are removed; a document that loses too much of its text is rejected. The
base statistics (words, symbols, repeated lines and word windows) are of the whole text as it came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.scratch import unused

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Phrases of page furniture, lower-cased.
BOILERPLATE = ("accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
               "share this page", "sign up for our newsletter", "subscribe to our newsletter", "terms of service", "terms of use")


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules, all inclusive on the passing side.

    max_symbols: symbols per hundred words of a line. max_bars: navigation separators (bars, bullets, arrows) per hundred
    words between them, in lines of two separators or more. max_bangs:
    words ending in "!!" per hundred. max_repeats: words that the next one repeats, per hundred.
    min_words: lines with fewer words are short; the boilerplate and navigation rules alone judge them, and those without
    punctuation at the end fail as a menu in runs of min_run or more, blank lines aside. Longer lines must end in sentence
    punctuation; from max_unended words on, a paragraph may break off but must have a mark for every so many words. min_kept: hundredths of the
    document's words that must survive. min_total, max_window_repeats: the base rules.
    """

    min_words: int = 5
    max_symbols: int = 10
    max_bars: int = 20
    max_bangs: int = 30
    max_repeats: int = 30
    max_unended: int = 60
    min_run: int = 4
    min_kept: int = 70
    min_total: int = 20
    max_window_repeats: int = 30


def _words(col: Column) -> Column:
    return F.filter(F.split(col, SPACE), lambda w: w != "")


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


MARK = "[.!?:;,…。！？：；，、؟،؛।॥։።]"
ENDED = MARK + "[\"')\\]}»«”“’‘›‹*_`）」』】〉》]*+[ \\t\\x0B\\f\\r]*+$"
SEPARATOR = "[|•·●■▪◦‣▶►▸→←⇒¦]"


WORD = "[^ \\t\\n\\x0B\\f\\r]++"


def line_fails(line: Column, rules: LineRules, furniture: Column, symbols: Column, marked: Column) -> Column:
    """Whether a line is page furniture or broken text. Blank lines never fail.

    furniture, symbols, marked: whether the whole text has one of the phrases; any symbol; and a word that ends in "!!"
    or that the next one repeats. A line can't have what its text has not, so these only save the counting.
    """
    def broken(n):
        many = lambda pattern, limit: _count(line, pattern) * 100 > n * limit
        repeats = many("!!(?=[ \\t\\x0B\\f\\r]|$)", rules.max_bangs) | many("(?<![^ \\t\\x0B\\f\\r])([^ \\t\\x0B\\f\\r]++)(?=[ \\t\\x0B\\f\\r]++\\1(?:[ \\t\\x0B\\f\\r]|$))", rules.max_repeats)
        unended = ~line.rlike(ENDED) & ((n < rules.max_unended) | (_count(line, MARK) * rules.max_unended < n))
        return (n >= rules.min_words) & ((symbols & many("[#*$%&<>]", rules.max_symbols)) | (marked & repeats) | unended)

    # closed quotes are no arrows; the words are those between separators, spaced or not
    bars = _count(line, SEPARATOR) + F.when(line.rlike("[«‹]"), 0).otherwise(_count(line, "[»›]"))
    menu = F.exists(F.array(bars), lambda k: (k >= 2) & (k * 100 > _count(line, "[\\p{L}\\p{N}]++") * rules.max_bars))
    words = F.array(_count(line, WORD))  # an array of one, so that its lambda counts the words once
    return (furniture & F.exists(F.array(F.lower(line)), _has_phrase)) | menu | F.exists(words, broken)


def line_kind(line: Column, rules: LineRules) -> Column:
    """b: blank; s: short, without punctuation at the end; x: other."""
    return F.transform(F.array(_count(line, WORD)), lambda n: F.when(n == 0, "b").when((n < rules.min_words) & ~line.rlike(ENDED), "s").otherwise("x"))[0]


def _menus(kinds: Column, rules: LineRules) -> Column:
    """The kinds of all lines, one letter each, with m for s in runs of min_run or more."""
    pieces = F.regexp_extract_all(kinds, F.lit("s[sb]*+|[^s]++"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(F.length(F.translate(x, "bx", "")) >= rules.min_run, F.translate(x, "s", "m")).otherwise(x)), "")


def _has_phrase(low: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | low.contains(phrase)
    return out


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with a struct column ``quality``: the base statistics, the cleaned text and the verdict.

    quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines, n_kept_words (all
    BIGINT), base_failed, kept (BOOLEAN), clean_text (STRING). A null text counts as no text: no words, so it fails the
    base rules, and its clean_text is null. All other columns and repeated rows pass through as they are; a column
    named like one of these fields is untouched, as the fields are inside the struct, and one named ``quality`` is an error.
    """
    if "quality" in docs.columns:
        raise ValueError("the table has a column named quality already")
    whole = F.coalesce(F.col(text), F.lit(""))
    size = 8
    packed = F.struct(whole.alias("text"), _words(whole).alias("w"), F.split(whole, "\n").alias("lines"))
    step = docs.withColumn("quality", packed)
    q = F.col("quality")
    n = F.size(q["w"])
    # a window is known by the hash of its words
    stutter = F.size(F.filter(q["w"], lambda x, i: F.coalesce(x == F.get(q["w"], i + 1), F.lit(False)) | x.endswith("!!")))
    worded = F.filter(q["lines"], lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    step = step.withColumn("quality", F.struct(
        q["text"].alias("text"), n.cast("long").alias("n_words"), F.length(F.array_join(q["w"], "")).cast("long").alias("word_chars"),
        _count(q["text"], "[#*$%&|<>]").cast("long").alias("n_symbols"), F.transform(q["w"], lambda x: F.xxhash64(x)).alias("h"), worded.alias("worded"), q["lines"].alias("lines"),
        F.exists(F.array(F.lower(q["text"])), _has_phrase).alias("furniture"), (stutter > 0).alias("marked")))
    # hashes of 2, 4 and then 8 words
    fields = ("text", "n_words", "word_chars", "n_symbols", "worded", "lines", "furniture", "marked")
    for k in (1, 2, 4):
        left = F.size(q["h"]) - k
        joined = F.when(left > 0, F.zip_with(F.slice(q["h"], 1, left), F.slice(q["h"], k + 1, left), lambda x, y: F.xxhash64(x, y)))
        step = step.withColumn("quality", F.struct(*[q[c].alias(c) for c in fields], F.coalesce(joined, F.array().cast("array<bigint>")).alias("h")))
    lines = F.transform(q["lines"], lambda x: F.struct(x.alias("line"), line_fails(
        x, rules, q["furniture"], q["n_symbols"] > 0, q["marked"]).alias("fails")))
    # only a text with a repeated window needs their places: equal hashes are neighbours once sorted
    repeated = F.size(F.array_distinct(q["h"])) < F.size(q["h"])
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    s = F.when(repeated, F.sort_array(F.transform(q["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    step = step.withColumn("quality", F.struct(
        *[q[c].alias(c) for c in ("text", "n_words", "word_chars", "n_symbols")], s.alias("s"), lines.alias("lines"),
        (F.size(q["worded"]) - F.size(F.array_distinct(q["worded"]))).cast("long").alias("n_dup_lines"),
        F.array_join(F.transform(q["lines"], lambda x: line_kind(x, rules)), "").alias("kinds")))
    lines = F.zip_with(q["lines"], F.split(_menus(q["kinds"], rules), ""), lambda x, kind: F.struct(
        x["line"].alias("line"), (x["fails"] | (kind == "m")).alias("fails")))
    step = step.withColumn("quality", F.struct(
        *[q[c].alias(c) for c in ("text", "n_words", "word_chars", "n_symbols", "s", "n_dup_lines")], lines.alias("lines")))
    s = q["s"]
    twice = F.filter(F.transform(s, lambda x, k: F.when(
        (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    step = step.withColumn("quality", F.struct(
        *[q[c].alias(c) for c in ("text", "n_words", "word_chars", "n_symbols", "lines", "n_dup_lines")], F.sort_array(twice).alias("t")))
    t = q["t"]
    # words that repeated windows cover: each start brings its window up to the next start
    covered = F.aggregate(F.transform(t, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(t, k + 1) - i, F.lit(size)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    passed = F.filter(q["lines"], lambda x: ~x["fails"])
    step = step.withColumn("quality", F.struct(
        *[q[c].alias(c) for c in ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines")], covered.alias("n_repeat_words"),
        F.size(q["lines"]).cast("long").alias("n_lines"), F.transform(passed, lambda x: x["line"]).alias("passed")))
    clean = F.array_join(q["passed"], "\n")
    step = step.withColumn("quality", F.struct(
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        (q["n_lines"] - F.size(q["passed"])).alias("n_removed_lines"), clean.alias("clean")))
    kept_words = F.when(q["n_removed_lines"] == 0, q["n_words"]).otherwise(
        _count(q["clean"], WORD).cast("long"))
    base_failed = (q["n_words"] < rules.min_total) | (100 * q["n_repeat_words"] > rules.max_window_repeats * q["n_words"])
    kept = ~base_failed & (100 * kept_words >= rules.min_kept * q["n_words"]) & (kept_words >= rules.min_total)
    return step.withColumn("quality", F.struct(
        q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["n_lines"], q["n_removed_lines"], kept_words.alias("n_kept_words"),
        base_failed.alias("base_failed"), kept.alias("kept"), F.when(F.col(text).isNotNull(), q["clean"]).alias("clean_text")))


def quality_table(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """(key, statistics, base_failed, kept) of every row."""
    out = clean_lines(docs.select(key, text), text, rules)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "n_kept_words")
    return out.select(key, *[F.col("quality")[c].alias(c) for c in fields])


def keep_clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows that pass, with their failed lines removed; ``n_chars`` follows the text if there is one.

    Null and empty texts fail the base rules and go; repeated rows are judged alike; other columns stay as they are.
    """
    # the row number keeps the filter above the nested expressions: pushed below, it would repeat them over and over
    (at,) = unused(docs, "_at")
    out = clean_lines(docs, text, rules).withColumn(at, F.monotonically_increasing_id()).where(F.col("quality")["kept"] & (F.col(at) >= 0))
    fresh = {text: F.col("quality")["clean_text"]}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(F.col("quality")["clean_text"]).cast(dict(docs.dtypes)["n_chars"])
    return out.withColumns(fresh).select(*docs.columns)
