"""Alignment of two tokenizers over a corpus, by exact-text deduplication.

1. *Distinct texts.* Texts are shuffled by their full text and counted; each
   distinct one goes on once, with its multiplicity.
2. *Tokens.* Each is tokenised once by both tokenizers. Byte offsets where a
   token of both ends cut the tokens into groups; all pairs of an A and a B
   token occurrence in one group are links. A text's measures, its distinct id
   pairs and their occurrences are written.
3. *Counts.* A pair counts a text's multiplicity once for each text that holds
   it; the counts are summed by Spark, and each A id's highest marked.
4. *Measures.* The COMMON most frequent pairs go to the tasks, a table of
   bounded size; a text's other pairs, if any, meet the counts by a join.
5. Measures go to the doc_ids by the digest of the full text.

Where both tokenizers surely cut (before a space that follows a letter, digit or
sign), texts are cut into chunks, and a worker remembers a chunk's alignment.
The byte-level pattern looks at nothing left of a match and cuts before such a
space; no piece of the other vocabulary holds its space mark after another
character (checked when it is loaded), so no merge crosses the cut.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch

#: Pairs that are handed to every task at most: 16 bytes each.
COMMON = 1 << 20
#: Chunks and bytes of chunks that a worker remembers at most.
CACHE, CACHE_BYTES = 500_000, 32 << 20
#: Characters of a text that are cut into chunks at once.
AT_ONCE = 1 << 20
#: Pairs that a task counts before it hands them on.
COUNTED = 2_000_000
MARK = "▁"
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_CUT = re.compile("(?<=[!-~¡-˿Ͱ-҂Ҋ-֐]) ")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)


def align(chunk_a: np.ndarray, ends_a: np.ndarray, chunk_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, chunk of each group) for tokens laid end to end.

    A group ends at every byte offset where tokens of both sides end.
    """
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    groups = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    return *groups, chunk_a[np.searchsorted(ends_a, both)]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, where each begins, and its length."""
    size = np.array([len(t) for t in tokens])
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


class _Grown:
    """Rows of integers that are added in blocks."""

    def __init__(self, columns: int):
        self.rows, self.n = np.zeros((1 << 12, columns), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.rows):
            more = np.zeros((max(len(self.rows), len(rows)), self.rows.shape[1]), np.int64)
            self.rows = np.concatenate([self.rows, more])
        self.rows[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.rows[places]


class Aligner:
    """Both tokenizers, and what a worker remembers of chunks: sizes, the groups as text, and coded id pairs of all links."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from .tokens import _byte_alphabet

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.alphabet = _byte_alphabet()
        back = {c: b for b, c in self.alphabet.items()}
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.n_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.tables = [_table(x) for x in (a_bytes, b_bytes)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.last = self.b.encode("x ")[len(self.b.encode("x")) :]  # a text's last space, which has no text after it to be put before
        # an id as text, with what follows it: another of its side, the other side, the next group
        ids = [str(i) for i in range(max(len(a_bytes), self.n_b))]
        self.said_as = [[i + mark for i in ids] for mark in ",|;"]
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.said: list[str] = []
        self.sizes = _Grown(6)  # tokens of A, of B, groups, links, 1 if bytes differ, where the links' codes begin
        self.codes = _Grown(1)

    def _tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that begin with a space; B adds its own, and a word alone is one unit of A's pattern."""
        tokenize, alphabet = self.a.model.tokenize, self.alphabet
        rest = [c for c in chunks if not _WORD.fullmatch(c)]
        whole = dict(zip(rest, (e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)))) if rest else {}
        ids_a = [whole[c] if c in whole else [t.id for t in tokenize(c.encode().decode("latin-1").translate(alphabet))] for c in chunks]
        ids_b = [b or self.last for b in self.b.encode([c[1:] for c in chunks], num_threads=1)]
        return ids_a, ids_b

    def _learn(self, chunks: list[str]) -> None:
        base = len(self.said)
        raw = [c.encode("utf-8", "replace") for c in chunks]
        length = np.array([len(r) for r in raw])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(length) - length
        same = np.ones(len(chunks), bool)
        sides = []
        for lists, (table, start, size) in zip(self._tokens(chunks), self.tables):
            chunk = np.repeat(np.arange(len(chunks)), [len(x) for x in lists])
            ids = np.fromiter(chain.from_iterable(lists), np.int64, len(chunk))
            sides.append((chunk, ids, size[ids]))
            total = np.bincount(chunk, size[ids], len(chunks)).astype(np.int64)
            same &= total == length
            fits = same[chunk]
            told = table[_ranges(start[ids[fits]], size[ids[fits]])]
            ours = joined[_ranges(begin[same], length[same])]
            if not np.array_equal(told, ours):
                where = np.repeat(np.flatnonzero(same), length[same])
                same[where[told != ours]] = False
        chunk_a, ids_a, chunk_b, ids_b, ends = *(x[same[c]] for c, i, _ in sides for x in (c, i)), [np.cumsum(n[same[c]]) for c, _, n in sides]
        sizes = np.zeros((len(chunks), 6), np.int64)
        sizes[:, 4] = ~same
        if len(ids_a):
            ga, gb, of = align(chunk_a, ends[0], chunk_b, ends[1])
            many_a, many_b = np.bincount(ga), np.bincount(gb)
            sizes[:, 0], sizes[:, 1] = np.bincount(chunk_a, minlength=len(chunks)), np.bincount(chunk_b, minlength=len(chunks))
            sizes[:, 2], sizes[:, 3] = np.bincount(of, minlength=len(chunks)), np.bincount(of, many_a * many_b, len(chunks))
            sizes[:, 5] = self.codes.n + np.cumsum(sizes[:, 3]) - sizes[:, 3]
            first_b = np.cumsum(many_b) - many_b
            partner = _ranges(first_b[ga], many_b[ga])
            self.codes.add((np.repeat(ids_a, many_b[ga]) * self.n_b + ids_b[partner])[:, None])
            last_a, last_b = np.r_[ga[1:] != ga[:-1], True], np.r_[gb[1:] != gb[:-1], True]
            order = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable")
            ids, mark = np.r_[ids_a, ids_b][order].tolist(), np.r_[np.where(last_a, 1, 0), np.where(last_b, 2, 0)][order].tolist()
            said = [self.said_as[m][i] for i, m in zip(ids, mark)]
        else:
            said = []
        self.sizes.add(sizes)
        ends_at = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        lo = 0
        for k, (chunk, hi) in enumerate(zip(chunks, ends_at)):
            self.at[chunk] = base + k
            self.said.append("".join(said[lo:hi]))
            lo = hi
        self.held += len(joined)

    def _look_up(self, chunks: list[str]) -> np.ndarray:
        if len(self.at) > CACHE or self.held > CACHE_BYTES:
            self._reset()
        at = self.at
        found = [at.get(c, -1) for c in chunks]
        if -1 in found:
            new = list(dict.fromkeys(c for c, k in zip(chunks, found) if k < 0))
            self._learn(new)
            found = [at[c] if k < 0 else k for c, k in zip(chunks, found)]
        return np.array(found)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Chunks of the text with a space before it, some at a time."""
        text = " " + text
        if not self.cuts:
            yield [text]
            return
        lo = 0
        while lo < len(text):
            cut = _CUT.search(text, lo + AT_ONCE)
            hi = cut.start() if cut else len(text)
            parts = _CUT.split(text[lo:hi])
            yield [parts[0], *[" " + p for p in parts[1:]]]
            lo = hi

    def prepare(self, texts: list[str | None]) -> None:
        """Learn the new chunks of several short texts at once: calls of the tokenizers cost as much as hundreds of chunks."""
        if len(self.at) > CACHE or self.held > CACHE_BYTES:
            self._reset()
        new: dict[str, None] = {}
        size = 0
        for text in texts:
            size += len(text or "")
            if size > AT_ONCE:
                break
            if text:
                new.update((c, None) for chunks in self._pieces(text) for c in chunks if c not in self.at)
        if new:
            self._learn(list(new))

    def measure(self, text: str | None):
        """(tokens of A, of B, groups, links, digest of the groups, sorted coded pairs, occurrences of each), or None without tokens."""
        if not text:
            return None
        digest, total = hashlib.sha256(), np.zeros(6, np.int64)
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        between = ""
        for chunks in self._pieces(text):
            at = self._look_up(chunks)
            sizes = self.sizes.of(at)
            total += sizes.sum(0)
            if total[4]:
                return None
            said = self.said
            digest.update((between + "".join([said[k] for k in at.tolist()])[:-1]).encode())
            between = ";"
            mine, often = _counted(np.sort(self.codes.of(_ranges(sizes[:, 5], sizes[:, 3]))[:, 0]))
            if len(codes):
                mine, often = _summed(np.concatenate([codes, mine]), np.concatenate([times, often]))
            codes, times = mine, often
        return (*total[:4].tolist(), digest.hexdigest(), codes, times)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    """The worker's aligner, kept from task to task."""
    if paths not in _aligners:
        _aligners.clear()
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


MEASURED = "key binary, n_same long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _measured(byte_path: str, piece_path: str):
    """One row per distinct text. Codes are written byte plane by byte plane: sorted, their upper planes compress to little."""

    def run(batches):
        tool = _aligner(byte_path, piece_path)
        for batch in batches:
            texts, same = batch.column("text"), batch.column("n_same")
            for lo in range(0, batch.num_rows, 64):
                rows = []
                some = texts.slice(lo, 64).to_pylist()
                tool.prepare(some)
                for i, text in enumerate(some, lo):
                    found = tool.measure(text) or (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                    codes, times = (x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in found[5:])
                    rows.append((batch.column("key")[i].as_py(), same[i].as_py(), *found[:5], codes, times))
                kinds = [pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MEASURED.split(", ")])

    return run


def _plain(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): documents that hold each pair, summed over some texts at a time."""
    held, weight, size = [], [], 0

    def told():
        codes, n = _summed(np.concatenate(held or [np.zeros(0, np.int64)]), np.concatenate(weight or [np.zeros(0, np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    for batch in batches:
        for data, same in zip(batch.column("codes"), batch.column("n_same").to_pylist()):
            codes = _plain(data.as_py())
            held.append(codes)
            weight.append(np.full(len(codes), same, np.int64))
            size += len(codes)
            if size > COUNTED:
                codes, n = _summed(np.concatenate(held), np.concatenate(weight))
                held, weight, size = [codes], [n], len(codes)
                if size > COUNTED // 2:
                    yield told()
                    held, weight, size = [], [], 0
    yield told()


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each stands in it."""
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(n, first)


def pair_counts(measured: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): documents that hold each id pair, and whether no pair of its A id has more."""
    pairs = map_arrow(measured.select("codes", "n_same"), _pair_counts, "code long, n long")
    pairs = materialize(pairs.groupBy("code").agg(F.sum("n").alias("n")), "alignment-pairs")
    a_id = F.floor(F.col("code") / n_b).cast("long").alias("a_id")
    most = pairs.groupBy(a_id).agg(F.max("n").alias("most"))
    both = pairs.withColumn("a_id", a_id).join(most, "a_id")
    return materialize(both.select("code", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-counts")


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and marks of the pairs above the lowest power of two that at most ``most`` pairs reach, sorted by code."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        least = 1 << step
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    table = counts.where(F.col("n") >= least).toArrow()
    code, n, best = (table.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    return code[order], n[order], best[order]


def _judged(shared):
    """(key, n_best, count_sum, rest): sums over a text's common pairs, and its other pairs with their occurrences."""

    def run(batches):
        known, n, best = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = ([], [], [])
                for codes, times in zip(part.column("codes").to_pylist(), part.column("times").to_pylist()):
                    codes, times = _plain(codes), _plain(times)
                    at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                    hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                    at = at[hit]
                    out[0].append(int((times[hit] * best[at]).sum()))
                    out[1].append(int((times[hit] * n[at]).sum()))
                    out[2].append([{"code": c, "times": t} for c, t in zip(codes[~hit].tolist(), times[~hit].tolist())])
                rest = pa.array(out[2], pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), rest], ["key", "n_best", "count_sum", "rest"])

    return run


@scratch
def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of ``docs``.

    ``byte_path`` is a byte-level tokenizer of the tokenizers library (A),
    ``piece_path`` a sentencepiece model (B); every executor must find both. A
    text that is null or empty, or whose tokens' bytes differ from a space and
    the text on either side, has no tokens: zeros, and '' as digest. Rows of one
    text share its measures and count one document each, whatever their doc_ids,
    null included. An empty table gives an empty result. Columns other than
    doc_id and text, of any name, are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("n_same"))
    measured = map_arrow(texts.select("text", "n_same", digest.alias("key")), _measured(byte_path, piece_path), MEASURED)
    measured = materialize(measured, "alignment-texts", compression="zstd")
    counts = pair_counts(measured, _aligner(byte_path, piece_path).n_b)
    shared = spark.sparkContext.broadcast(_common(counts, common))
    judged = map_arrow(measured.select("key", "codes", "times"), _judged(shared), "key binary, n_best long, count_sum long, rest array<struct<code:long,times:long>>")
    judged = materialize(judged, "alignment-judged")
    rest = judged.where(F.size("rest") > 0).select("key", F.explode("rest").alias("r")).select("key", "r.code", "r.times")
    rest = rest.join(counts, "code").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    judged = judged.drop("rest").join(rest, "key", "left")
    told = measured.drop("codes", "times", "n_same").join(judged, "key")
    out = docs.select("doc_id", F.when(F.col("text") != "", digest).alias("key")).join(told, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        *[zero(F.col(c)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        zero(F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        zero(F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
