"""Spelling variants by reduced-alphabet generation.

1. *Words* are counted in tasks, whole texts, and summed by Spark.
2. *Reduced words.* Every letter is hashed to one of SYMBOLS symbols. A word's
   reduced form is kept as a 64-bit polynomial hash of its symbols.
3. *Generation.* For every word the full one-edit neighbourhood of its reduced
   form is generated, itself included: every deletion, replacement and
   insertion of a symbol. Hashes of neighbours follow from prefix sums in
   constant time each, so a very long word costs no square of its length.
4. *Join.* Neighbours meet the reduced vocabulary by hash. Words at distance one
   have reduced forms at distance one or none, so no near pair is lost, and a
   collision of hashes only makes one more candidate.
5. *Verification* on the original strings, by edit distance.
6. *Forms and roots.* The commonest near word wins if it is common enough; roots
   follow by pointer doubling, since a form is at least twice as common as its word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch
from .words import mix

MIN_LENGTH, MIN_COUNT = 5, 3
#: A run is damaged where this divides its hash.
DAMAGE = 97
#: A form is at least so many times as common as its word.
TIMES = 2
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Letters whose neighbours are generated at once.
AT_ONCE = 1 << 15

_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _symbols(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point up to 255, value of each symbol): letters in a hashed order, dealt round to the symbols."""
    order = np.argsort(mix(np.arange(256, dtype=np.uint64) + np.uint64(1)))
    symbol = np.zeros(256, np.int64)
    letters = order[np.isin(order, [*range(0x61, 0x7B), *range(0xC0, 0x100)])]
    plain = letters[letters < 0x80]
    for some in (plain, letters[letters >= 0x80]):
        symbol[some] = np.arange(len(some)) % n
    return symbol, mix(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every result of at least MIN_LENGTH letters, summed over some documents at a time."""
    total: Counter = Counter()

    def told():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text:
                continue
            doc_id = ids[i].as_py()
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # bytes.lower changes A-Z alone
            for run, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                if len(run) < MIN_LENGTH:
                    continue
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < MIN_LENGTH:
                        continue
                total[run] += n
            if len(total) >= COUNTED:
                yield told()
                total.clear()
    yield told()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sums(symbol, values, words: list[str]):
    """Of words laid end to end: symbol, word and place of each letter, sums of the hash before each letter and of each whole word, lengths."""
    length = np.array([len(w) for w in words])
    letters = symbol[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    word = np.repeat(np.arange(len(words)), length)
    begin = np.cumsum(length) - length
    place = np.arange(len(letters)) - begin[word]
    up = _powers(_BASE, int(length.max()) + 2)
    part = values[letters] * up[place]
    running = np.concatenate([[np.uint64(0)], np.cumsum(part)])
    before = running[:-1] - running[begin][word]
    whole = running[begin + length] - running[begin]
    return letters, word, place, part, before, whole, length, up


def _named(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of a reduced word, its length mixed in."""
    return mix(hashes + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The hash of each word's reduced form."""
    symbol, values = _symbols(symbols)
    *_, whole, length, _ = _sums(symbol, values, words)
    return _named(whole, length)


def neighbours(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word's place, hash) of every reduced form at one edit or none from each word's own, in pieces."""
    symbol, values = _symbols(symbols)
    letters, word, place, part, before, whole, length, up = _sums(symbol, values, words)
    yield np.arange(len(words)), _named(whole, length)
    for lo in range(0, len(letters), AT_ONCE):
        at = slice(lo, lo + AT_ONCE)
        w, k, b, p, n = word[at], letters[at], before[at], part[at], length[word[at]]
        after = whole[w] - b - p
        where, found = [w], [_named(b + after * _INVERSE, n - 1)]
        for s in range(symbols):
            other = k != s
            where += [w[other], w]
            found += [_named((b + values[s] * up[place[at]] + after)[other], n[other]), _named(b + values[s] * up[place[at]] + (after + p) * _BASE, n + 1)]
        yield _distinct(np.concatenate(where), np.concatenate(found))
    for s in range(symbols):
        yield np.arange(len(words)), _named(whole + values[s] * up[length], length + 1)


def _distinct(where: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, where))
    where, found = where[order], found[order]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (found[1:] != found[:-1])
    return where[new], found[new]


def _pieces(batch: pa.RecordBatch):
    """Runs of rows of about AT_ONCE letters: (ids, words)."""
    ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
    lo, letters = 0, 0
    for i, w in enumerate(words):
        letters += len(w)
        if letters >= AT_ONCE or i + 1 == len(words):
            yield ids[lo : i + 1], words[lo : i + 1]
            lo, letters = i + 1, 0


def _own(batches):
    for batch in batches:
        for ids, words in _pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(reduced(words))], ["id", "form"])


def _around(batches):
    for batch in batches:
        for ids, words in _pieces(batch):
            for where, found in neighbours(words):
                yield pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(found)], ["of", "form"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts, after the contract's deletions."""
    counted = map_arrow(docs.select("doc_id", "text"), _counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(of, near): ids of all ordered pairs of words of ``vocabulary`` (id, word) at edit distance one."""
    words = vocabulary.select("id", "word")
    own = map_arrow(words, _own, "id long, form long")
    around = map_arrow(words, _around, "of long, form long")
    met = materialize(around.join(own, "form").where("of <> id").select("of", F.col("id").alias("near")), "spelling-candidates")
    of, near = words.withColumnsRenamed({"id": "of", "word": "a"}), words.withColumnsRenamed({"id": "near", "word": "b"})
    return met.join(of, "of").join(near, "near").where(F.levenshtein("a", "b", 1) == 1).select("of", "near").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where the chain of ``forms`` (id, form) from each id ends. Chains have no cycles."""
    to = materialize(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = to.join(to.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
        further = materialize(further.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        to = further.drop("moved")
        if further.where("moved").isEmpty():
            return to


@scratch
def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per distinct word of at least MIN_LENGTH letters and MIN_COUNT occurrences.

    form is the near word (edit distance one) of largest n, of equals the first
    in code-point order, if it is at least TIMES as common as the word, else
    null; root is where the forms lead, the word itself without one. Null and
    empty texts have no words; repeated rows count each time; a null doc_id is
    hashed as an empty string. Words of any length are handled whole. An empty
    table gives an empty result. Columns other than doc_id and text, of any
    name, are not read.
    """
    counted = materialize(word_counts(docs), "spelling-counts")
    vocabulary = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-vocabulary")
    pairs = near_words(vocabulary)
    told = vocabulary.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word"), F.col("near").alias("id"))).alias("best")
    best = pairs.join(told, "near").groupBy(F.col("of").alias("id")).agg(best, F.count("*").alias("n_near"))
    joined = vocabulary.join(best, "id", "left")
    fits = -F.col("best.less") >= TIMES * F.col("n")
    fitted = lambda c: F.when(fits, c)
    joined = joined.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        fitted(F.col("best.word")).alias("form"), fitted(-F.col("best.less")).alias("form_n"), fitted(F.col("best.id")).alias("form_id"),
    )
    joined = materialize(joined, "spelling-forms")
    ends = roots(joined.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    ends = ends.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = joined.join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
