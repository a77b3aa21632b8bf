"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. Any
other word is scored by its longest n-grams of which some are known, with a
penalty per step down; single letters come last. The language with the highest
sum wins, and the score is its share under a softmax.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The fit reads about so many labelled documents, those with the least hashes of their ids; all of their words and
#: n-grams are learned.
FIT_DOCS = 4_000
LONGEST = 5
PENALTY = 0.5
SMOOTH = 0.5
CACHE = 500_000
_RUN = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The words of a text: runs of letters, lowered; marks and numerals alone are no words."""
    return _RUN.findall(text.lower()) if text else []


def _grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


@dataclass
class LanguageModel:
    """Log frequencies per language of the words and n-grams of the sampled documents."""

    langs: list[str]
    logs: list[dict[str, tuple]]  # [0]: words; [n]: n-grams -> log frequency in each language

    @classmethod
    def of_counts(cls, langs: list[str], tables: list[dict[str, tuple]]) -> LanguageModel:
        """``tables`` hold counts per language. Equal counts share one row: most words are seen once, in one language."""
        logs = []
        for table in tables:
            below = np.array(list(table.values()) or [(0,) * len(langs)], float).sum(0) + SMOOTH * (len(table) + 1)
            rows = {c: tuple((np.log(np.array(c) + SMOOTH) - np.log(below)).tolist()) for c in set(table.values())}
            logs.append({k: rows[c] for k, c in table.items()})
        return cls(langs, logs)

    def word(self, word: str) -> tuple:
        """Score of one word in each language."""
        found = self.logs[0].get(word)
        if found is not None:
            return found
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            get = self.logs[n].get
            known = [c for c in map(get, _grams(word, n)) if c is not None]
            if known:
                k, low = len(known), PENALTY * (LONGEST - n + 1)
                return tuple([sum(column) / k - low for column in zip(*known)])
        return (0.0,) * len(self.langs)


def fit_on(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Fit on ``docs`` with a lang: about ``fit_docs`` of them, the same whatever the partitioning."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    total = docs.count()
    if total > fit_docs:
        part = int(2**31 * fit_docs / total)
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < part)

    def told(seen: Counter, kinds: list[tuple[str, pa.DataType]]):
        columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[] for _ in kinds]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], [name for name, _ in kinds])

    as_words = [("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]
    as_grams = [("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())]

    def words(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for word, n in Counter(letters(text.as_py())).items():
                    seen[lang, word] += n
                if len(seen) > 500_000:
                    yield told(seen, as_words)
        yield told(seen, as_words)

    def grams(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                seen[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for g in _grams(word, size):
                        seen[lang, size, g] += n
                if len(seen) > 500_000:
                    yield told(seen, as_grams)
        yield told(seen, as_grams)

    # each distinct word is cut once, whatever the texts repeat
    counted = map_arrow(docs, words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = map_arrow(counted, grams, "lang string, size int, gram string, n long")
    counted = counted.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("size", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))
    kept = counted.collect()  # what about FIT_DOCS documents hold
    langs = sorted({k for r in kept for k in r["counts"]})
    tables: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in sorted(kept, key=lambda r: (r["size"], r["gram"])):
        tables[r["size"]][r["gram"]] = tuple(r["counts"].get(k, 0) for k in langs)
    return LanguageModel.of_counts(langs, tables)


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, n_words) of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned; equal sums go to the first language by name. Rows are
    judged one by one; other columns are not read.
    """
    langs = model.langs

    def run(batches):
        known: dict[str, int] = {}
        scores = np.zeros((1 << 14, max(1, len(langs))))
        for batch in batches:
            out, share, sizes = [], [], []
            for i in range(batch.num_rows):
                words = letters(batch.column("text")[i].as_py())
                sizes.append(len(words))
                if not langs or not any(c.isalpha() for w in words for c in w):
                    out.append("und")
                    share.append(0.0)
                    continue
                at = list(map(known.get, words))
                if None in at:
                    if len(known) > CACHE:
                        known.clear()
                    for w in set(words):
                        if w not in known:
                            n = len(known)
                            if n == len(scores):
                                scores = np.concatenate([scores, np.zeros_like(scores)])
                            scores[n] = model.word(w)
                            known[w] = n
                    at = list(map(known.__getitem__, words))
                total = scores[at].sum(0)
                best = int(np.argmax(total))
                out.append(langs[best])
                share.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(share, pa.float64()), pa.array(sizes, pa.int64())],
                ["doc_id", "lang_pred", "score", "n_words"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, n_words long")
