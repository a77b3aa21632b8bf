"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

Two dictionaries are trained by zstandard and loaded as trained: one on ordinary
text, one on the telling words of toxic text. A window is one word of at least
LEAST_BYTES bytes, said REPEATS times: the repeats cost next to nothing, so that
the block always compresses and its length tells what the word costs under a
dictionary. A window's evidence is the bytes that it is shorter under the toxic
dictionary. The document's score is a logistic function of how many windows pass
each of the thresholds GAINS, calibrated on the sample.

A word is telling if it holds a segment that stands in toxic text CONTRAST times
as often, per distinct place (word with both neighbours, so that copied passages
count once), as in ordinary text. Trained on all of the toxic documents' text,
the dictionary is filled with ordinary words, which most of it is (figures in
the README).

The model is fitted on a bounded sample: at most TOXIC_DOCS and ORDINARY_DOCS
labelled documents with the least hashes of their ids, whole texts. Spark counts
their words and takes their features; the driver sees distinct words and one row
per document. Scoring covers every window of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .words import mix

TOXIC_DOCS = 600
ORDINARY_DOCS = 1500
LEAST_BYTES = 4
REPEATS = 4
LEVEL = 6
#: Thresholds of a window's gain in bytes; words are counted at each.
GAINS = (1, 2, 3, 4, 5)
#: Sizes of the dictionaries, and segment and unit lengths for the trainer.
ORDINARY_BYTES, TOXIC_BYTES = 8192, 1024
ORDINARY_COVER, TOXIC_COVER = {"k": 32, "d": 6}, {"k": 16, "d": 6}
#: The trainer gets samples of about so many bytes, and words in proportion to their places, about so many in all.
SAMPLE_BYTES, SAMPLE_WORDS = 200, 400_000
SEGMENTS = (5, 6, 7, 8, 9)
CONTRAST = 40
MIN_PLACES = 5
#: A missed toxic document weighs so many false alarms in the calibration.
COST = 2
#: Words whose gains a worker remembers.
CACHE = 400_000
_NOT_LETTER = re.compile(rb"[^a-z\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    return _NOT_LETTER.sub(b" ", text.lower().encode("utf-8", "replace")).split() if text else []


def _segments(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + n] for n in SEGMENTS for i in range(len(w) - n + 1)}


def _telling(toxic: dict[bytes, int], ordinary: dict[bytes, int]) -> set[bytes]:
    """Words of toxic text (with their distinct places) that hold a segment which ordinary text lacks."""
    count: Counter = Counter()
    for word, n in toxic.items():
        for s in _segments(word):
            count[s] += n
    count = Counter({s: n for s, n in count.items() if n >= MIN_PLACES})
    usual: Counter = Counter()
    for word, n in ordinary.items():
        for s in _segments(word):
            if s in count:
                usual[s] += n
    ours, theirs = sum(toxic.values()), max(1, sum(ordinary.values()))
    told = {s for s, n in count.items() if n / ours >= CONTRAST * (usual[s] + 0.5) / theirs}
    return {w for w in toxic if _segments(w) & told}


def _samples(counts: dict[bytes, int]) -> list[bytes]:
    """Words in proportion to their places, in a seeded order, joined to samples for the trainer."""
    words = sorted(counts)
    n = np.array([counts[w] for w in words], float)
    n = np.ceil(n * min(1.0, SAMPLE_WORDS / max(1.0, n.sum()))).astype(int)
    which = np.repeat(np.arange(len(words)), n)
    which = which[np.argsort(mix(np.arange(len(which), dtype=np.uint64) + np.uint64(1)))]
    text = b" " + b" ".join([words[i] for i in which.tolist()]) + b" "
    return [text[i : i + SAMPLE_BYTES] for i in range(0, len(text), SAMPLE_BYTES)]


def _trained(counts: dict[bytes, int], size: int, cover: dict) -> bytes:
    """A dictionary of zstandard's trainer. Too few words to train on are said over until it has enough samples."""
    import zstandard as z

    samples = _samples(counts)
    while len(samples) < 64:
        samples = samples * 2
    for length in (size, size // 2, size // 4):
        try:
            return z.train_dictionary(length, samples, level=LEVEL, **cover).as_bytes()
        except z.ZstdError:
            continue
    raise ValueError("zstandard can't train a dictionary on these words")


@dataclass
class ToxicityModel:
    """Two trained dictionaries, feature scales and logistic weights: some tens of kB."""

    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(GAINS) + 4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(GAINS) + 4))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(GAINS) + 5))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Scorer:
    """Gains of words under a model's dictionaries, remembered in the worker."""

    def __init__(self, model: ToxicityModel):
        import zstandard as z

        def made(data: bytes):
            form = z.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(data), source_size=64, format=z.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_FULLDICT), compression_params=form)

        self.pair = (made(model.ordinary), made(model.toxic)) if model.toxic and model.ordinary else None
        self.gain: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        if self.pair is None:
            self.gain.update(dict.fromkeys(words, 0))
            return
        some = list(words)
        data = [(b" " + w) * REPEATS + b" " for w in some]
        one, two = ([len(x) for x in c.multi_compress_to_buffer(data, threads=1)] for c in self.pair)
        self.gain.update(zip(some, (a - b for a, b in zip(one, two))))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: its windows, and how many pass each threshold."""
        if len(self.gain) > CACHE:
            self.gain = {}
        said = [[w for w in _words(t) if len(w) >= LEAST_BYTES] for t in texts]
        gain = self.gain
        new = {w for words in said for w in words if w not in gain}
        if new:
            self.learn(new)
        out = np.zeros((len(texts), len(GAINS) + 4))
        for k, words in enumerate(said):
            x = np.array([gain[w] for w in words] or [0])
            often = np.array([(x >= g).sum() for g in GAINS])
            n = max(1, len(words))
            out[k] = [np.log(n), *np.log1p(often), *np.minimum(1.0, 40 * often[:3] / n)]
        return out


def calibrated(model: ToxicityModel, x: np.ndarray, y: np.ndarray, share: float) -> ToxicityModel:
    """Scales and logistic weights of features ``x`` and labels ``y``, for a ``share`` of toxic documents, each weighing COST."""
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    share = min(max(share * COST / (share * COST + 1 - share), 1e-3), 1 - 1e-3)
    sample = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w)) * 1e-3 * len(y)
    for _ in range(50):  # Newton steps of penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (sample * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (sample * (p - y)) + ridge @ w)
    model.weights = w
    return model


def trained(toxic: dict[bytes, int], ordinary: dict[bytes, int]) -> ToxicityModel:
    """The dictionaries of two vocabularies with their places. With one side empty the model knows one answer."""
    model = ToxicityModel()
    telling = _telling(toxic, ordinary) if toxic and ordinary else set()
    if not toxic or not ordinary:
        model.weights[-1] = -20.0 if not toxic else 20.0
    elif telling:
        model.ordinary = _trained(ordinary, ORDINARY_BYTES, ORDINARY_COVER)
        model.toxic = _trained({w: toxic[w] for w in telling}, TOXIC_BYTES, TOXIC_COVER)
    return model


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            w = _words(text.as_py())
            if w:
                sides = [pa.array(x, pa.binary()) for x in ([b"", *w[:-1]], w, [*w[1:], b""])]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(w), pa.int32()), *sides], ["toxic", "before", "word", "after"])


def fit_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) with the texts of ``docs``.

    A document with several labels is toxic if one of them says so; null ids
    and labels are left out. Without toxic or without ordinary documents every
    text gets the other answer.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    picked = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))
    ]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most TOXIC_DOCS + ORDINARY_DOCS rows
    texts = docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"])
    sample = materialize(texts, "toxicity-sample")
    places = map_arrow(sample.select("text", "toxic"), _places, "toxic int, before binary, word binary, after binary").distinct()
    words: tuple[dict, dict] = ({}, {})
    for toxic, word, n in places.groupBy("toxic", "word").count().toLocalIterator():
        words[toxic][bytes(word)] = n
    model = trained(words[1], words[0])
    if not words[1] or not words[0]:
        return model

    def featured(batches):
        scorer = _Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x = scorer.features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = map_arrow(sample.select("doc_id", "text", "toxic"), featured, "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    total = sum(counts.values())
    return calibrated(model, np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]), counts.get(1, 0) / total if total else 0.0)


def _scored(model: ToxicityModel, column):
    """(slice of a batch, scores of its texts) for a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = _Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield part, model.probability(scorer.features(part.column(column).to_pylist()))

    return run


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score): the probability that a text is toxic, from all of its windows.

    A null text, or one without letters, has no window and gets the model's
    score of no evidence. Rows are scored one by one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for part, score in _scored(model, "text")(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns of whatever names, whose text scores under ``threshold``.

    Each row is judged by its own text: repeated rows stay or go together, rows
    with a null or empty text have the score of no evidence, and an empty table
    gives an empty result.
    """

    at = docs.columns.index("text")

    def run(batches):
        for part, score in _scored(model, at)(batches):
            yield part.filter(pa.array(score < threshold))

    return map_arrow(docs, run, docs.schema)
