"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Fixed values of the line rules.
SPACE = " \t\n\x0b\x0c\r"
TERMINAL = (".", "!", "?", ":", ";", ",", "…", '"', "'", "”", "’", "»", ")", "]", "}")
SEPARATOR = r"(?:^|[\x20\x09])(?:[|»›•·]|>{1,2})(?=[\x20\x09]|$)"
NAVIGATION = r"(?i)^[\x20\x09]*(?:home|menu|search|log ?in|log ?out|sign ?(?:in|up)|register|next|previous|back to top|share|tweet|read more|skip to content|site ?map|contact us|about us)[\x20\x09.:>»|]*$"
BOILERPLATE = (
    "all rights reserved",
    "copyright ©",
    "copyright (c)",
    "privacy policy",
    "cookie policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "licensed under",
    "licenced under",
    "we use cookies",
    "accept all cookies",
    "subscribe to our newsletter",
    "lorem ipsum",
)

#: A line without closing punctuation may have so many words at most; longer prose may break off.
MIN_UNPUNCTUATED = 12
#: So many menu separators make a line navigation.
MIN_SEPARATORS = 3
#: A document that keeps less than this share of its words is rejected.
MIN_KEPT_SHARE = 0.5
#: A document with more than this share of symbol characters to words is rejected.
MAX_SYMBOLS_PER_WORD = 0.3
WINDOW = 5


def _covered(h):
    """Words in the windows whose hash stands in ``h`` twice or more: one sort of (hash, place)."""

    def places(s):
        twice = F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
        )
        return F.aggregate(F.array_sort(twice), start, step, lambda a: a["n"])

    return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)


def _repeat_words(words):
    """Words that lie in a five-word window which the text has twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Texts without
    a repeated hash, most of them, stop after one hash set.
    """

    def windows(h):
        whole = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(whole, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            windows(h),
            lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(_covered(v)),
        ),
    )


def _words(line):
    return F.regexp_count(line, F.lit(WORD))


def line_verdict(line, has_separator, has_phrase):
    """Name of the first rule that a line with a word fails; null if it passes all.

    The two flags say of the whole text whether a separator or a boilerplate
    phrase stands in it at all; without it the rule isn't tried line by line.
    """
    phrase = let(F.lower(line), lambda low: reduce(or_, [low.contains(p) for p in BOILERPLATE]))
    closed = F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1)).isin(*TERMINAL)
    return (
        F.when(has_separator & (F.regexp_count(line, F.lit(SEPARATOR)) >= MIN_SEPARATORS), "navigation")
        .when(line.rlike(NAVIGATION), "navigation")
        .when(has_phrase & phrase, "boilerplate")
        .when(~closed & (_words(line) < MIN_UNPUNCTUATED), "punctuation")
    )


def _failed(rule: str):
    return F.size(F.filter("l.judged", lambda x: x["rule"] == rule)).cast("long")


def quality(docs: DataFrame) -> DataFrame:
    """Clean every text line by line and judge the document by what is left.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean), lines failed
    by each rule, kept_words (long) and text (the lines that
    passed; null where the text was null).

    A null or empty text has no words, so it fails the base rules and is not
    kept. Rows are judged one by one: repeated rows give repeated results. All
    work is on one row, without a shuffle; other columns of ``docs`` are
    dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.filter(F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    phrase = let(F.lower(text), lambda low: reduce(or_, [low.contains(p) for p in BOILERPLATE]))
    flags = F.struct(text.rlike("[|»›•·>]").alias("sep"), phrase.alias("phrase"))
    base = docs.select(
        "doc_id",
        F.col("text").alias("raw"),
        let(
            split,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda a: F.struct(
                (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
                let(
                    flags,
                    lambda f: F.transform(
                        a, lambda x: F.struct(x.alias("line"), line_verdict(x, f["sep"], f["phrase"]).alias("rule"))
                    ),
                ).alias("judged"),
            ),
        ).alias("l"),
    )
    picked = lambda test: F.transform(F.filter("l.judged", test), lambda x: x["line"])
    lost = F.aggregate(picked(lambda x: x["rule"].isNotNull()), F.lit(0), lambda n, x: n + _words(x))
    base = base.select(
        "doc_id",
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        ((F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))).alias("base_failed"),
        F.when(F.col("raw").isNotNull(), F.array_join(picked(lambda x: x["rule"].isNull()), "\n")).alias("text"),
        *[_failed(rule).alias(f"n_{rule}_lines") for rule in ("punctuation", "navigation", "boilerplate")],
        (F.col("w.n_words") - lost).alias("kept_words"),
    )
    enough = F.col("kept_words") >= MIN_KEPT_SHARE * F.col("n_words")
    quiet = F.col("n_symbols") <= MAX_SYMBOLS_PER_WORD * F.col("n_words")
    return base.withColumn("kept", ~F.col("base_failed") & enough & quiet)
