"""Texts that hold a given string inside them, found by an index of character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

GRAM = 4
#: Bounds of a task's memory: words whose hits it remembers, and hits summed up at once.
REMEMBERED, AT_ONCE = 100_000, 500_000
#: So many questions go to every task; more meet the words by a join.
FEW = 100_000


def grams(text, size):
    """Distinct pieces of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size))
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text_id): which of ``texts`` (text_id, text) hold which of ``needles`` (needle).

    A needle is looked up by the rarest of its four-character pieces (a shorter
    one by itself), so no needle meets a text that shares nothing with it. Only
    sizes that a needle needs are indexed, and of them only pieces of a needle.
    Empty needles are in no text.
    """
    needles = needles.where("needle <> ''").select("needle").distinct()
    size = F.least(F.lit(GRAM), F.length("needle"))
    sizes = sorted(r[0] for r in needles.select(size.alias("size")).distinct().collect())
    pieces = needles.select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
    wanted = pieces.select("gram").distinct()
    posted = None
    for n in sizes:
        part = texts.select("text_id", F.explode(grams(F.col("text"), F.lit(n))).alias("gram"))
        posted = part if posted is None else posted.unionByName(part)
    if posted is None:
        return needles.join(texts.select("text_id"), F.lit(False))
    posted = posted.join(wanted, "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    best = pieces.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    met = best.select("needle", "b.gram").join(posted, "gram").join(texts.select("text_id", "text"), "text_id")
    return met.where(F.contains("text", F.col("needle"))).select("needle", "text_id")


_split = re.compile("[^a-z0-9_-]+").split


def words_of(line: str | None) -> list[str]:
    """The words of a lowered line that can hold a keyword."""
    return [w for w in _split(line or "") if len(w) >= GRAM]


def keyword_hits(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(question_id, word, hits): how often the keywords of a question stand in a word, none overlapping another.

    ``asked``: question_id, keywords (array; letters, digits, _ and - only).
    ``words``: word, lowered, of the same signs. Of keywords that begin at one
    place the first of the question counts.
    """
    said = asked.select("question_id", F.posexplode("keywords").alias("nth", "keyword"))
    distinct = words.select(F.col("word").alias("text_id"), F.col("word").alias("text")).distinct()
    found = containing(said.select(F.col("keyword").alias("needle")), distinct)
    met = said.join(found, said["keyword"] == found["needle"]).groupBy("question_id", F.col("text_id").alias("word"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "keyword"))), lambda x: x["keyword"]), "|")
    return met.agg(listed.alias("pattern")).select("question_id", "word", F.regexp_count("word", F.col("pattern")).alias("hits"))


class _Hits:
    """How often the keywords of each question (by its place in ``asked``) stand in a word; as ``keyword_hits`` counts."""

    def __init__(self, asked: list[list[str]]) -> None:
        self.asked, self.holders, self.starts, self.known = asked, {}, {}, {}
        for i, keywords in enumerate(asked):
            for k in keywords:
                self.holders.setdefault(k, []).append(i)
        for k in self.holders:
            self.starts.setdefault(k[:GRAM], []).append(k)

    def of(self, word: str):
        """(places, hits) as arrays."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._count(word)
        return found

    def _count(self, word: str):
        held = {k for i in range(len(word) - GRAM + 1) for k in self.starts.get(word[i : i + GRAM], ()) if word.startswith(k, i)}
        by: dict[int, list[str]] = {}
        for k in held:
            for i in self.holders[k]:
                by.setdefault(i, []).append(k)
        hits = [word.count(k[0]) if len(k) == 1 else len(re.findall("|".join(x for x in self.asked[i] if x in held), word)) for i, k in by.items()]
        return np.fromiter(by, np.int64, len(by)), np.array(hits, np.int64)


def few(asked: DataFrame) -> bool:
    return asked.limit(FEW + 1).count() <= FEW


def keyword_sums(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Every question's keywords in every text: the columns of ``texts`` but ``texts``, question_id, n, lines.

    ``asked`` as for ``keyword_hits``, keywords of four characters at least;
    ``texts``: keys and ``texts``, an array of lowered lines; see ``keyword_counter``.
    """
    keys = [c for c in texts.columns if c != "texts"]
    if few(asked):
        told = texts.select(*keys, keyword_counter(asked)("texts").alias("t"))
        told = told.select(*keys, F.explode(F.arrays_zip("t.question_id", "t.n", "t.lines")).alias("t"))
        return told.select(*keys, "t.question_id", "t.n", "t.lines")
    words = texts.select(*keys, F.posexplode("texts").alias("i", "line"))
    words = words.select(*keys, "i", F.explode(F.split("line", r"[^a-z0-9_-]+")).alias("word")).where(F.length("word") >= GRAM)
    words = words.groupBy(*keys, "i", "word").agg(F.count("*").alias("n"))
    hits = words.join(keyword_hits(asked, words.select("word")), "word")
    hits = hits.groupBy(*keys, "question_id", "i").agg(F.sum(F.col("n") * F.col("hits")).alias("n"))
    return hits.groupBy(*keys, "question_id").agg(F.sum("n").alias("n"), F.count("*").alias("lines"))


def keyword_counter(asked: DataFrame):
    """A function of a column of texts, each an array of lowered lines: the arrays question_id, n and lines side by side.

    ``n``: how often the question's keywords (array ``keywords``; letters,
    digits, _ and -, four at least) stand in the text's words, ``lines``: in how
    many of its lines one does. The questions go to the tasks, so that neither
    words nor pairs of a question and a text are shuffled; they are to be few.
    """
    ship(asked.sparkSession)
    kind = asked.schema["question_id"].dataType.simpleString()
    rows = asked.select("question_id", "keywords").collect()
    ids, words = [r[0] for r in rows], [list(r[1] or ()) for r in rows]

    @F.arrow_udf(f"struct<question_id:array<{kind}>,n:array<bigint>,lines:array<bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        return count_keywords(texts, _counter(words), ids)

    return count


_counters: dict[int, tuple] = {}


def _counter(asked: list[list[str]]) -> _Hits:
    """The counter of a list that a worker unpickles once for all its batches."""
    held = _counters.get(id(asked))
    if held is None or held[0] is not asked:
        _counters.clear()
        held = _counters[id(asked)] = (asked, _Hits(asked))
    return held[1]


def count_keywords(texts: pa.Array, hits: _Hits, ids: list) -> pa.Array:
    """The result of ``keyword_counter`` for one batch."""
    part = re.compile("[^a-z0-9_-]+").split
    width, n_lines, waiting = len(ids), 0, 0
    line_of, places, counts, text_of, done = [], [], [], [], []

    def flush():
        nonlocal n_lines, waiting
        if places:
            place, n = np.concatenate(places), np.concatenate(counts)
            line = np.repeat(np.array(line_of), [len(p) for p in places])
            # sums by line and question, then by text and question
            key, at = np.unique(line * width + place, return_inverse=True)
            n = np.bincount(at, n, len(key)).astype(np.int64)
            key, at = np.unique(np.array(text_of)[key // width] * width + key % width, return_inverse=True)
            done.append((key, np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))))
        for x in (line_of, places, counts, text_of):
            x.clear()
        n_lines = waiting = 0

    for i, lines in enumerate(texts):
        for line in lines.as_py() or ():
            text_of.append(i)
            for word in part(line or ""):
                if len(word) >= GRAM and len((found := hits.of(word))[0]):
                    line_of.append(n_lines)
                    places.append(found[0])
                    counts.append(found[1])
                    waiting += len(found[0])
            n_lines += 1
        if waiting >= AT_ONCE:
            flush()
    flush()
    key, n, lines = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
    ends = pa.array(np.searchsorted(key // max(width, 1), np.arange(len(texts) + 1)), pa.int32())
    asked = pa.array(ids).take(pa.array(key % max(width, 1))) if len(key) else pa.array(ids).slice(0, 0)
    columns = (asked, pa.array(n), pa.array(lines.astype(np.int64)))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, c) for c in columns], ["question_id", "n", "lines"])
