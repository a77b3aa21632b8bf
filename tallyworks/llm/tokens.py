"""Token ids in a file format with random access: directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first
chunk of every id, level k the k-th chunk of the ids that have one. A
continuation bitmap over level k marks the ids that go on, and a rank directory
(ones before every 512 bits) tells where in level k + 1 they go on. So id i is
found by at most one rank per level, without decoding what stands before it.

One record of the format, little-endian:

    magic "DAC1" | levels u32 | ids u64 | documents u64
    document offsets: (documents + 1) x u64, in ids from the record's start
    for each level: length u64 | chunks u8 x length
                    | bitmap u64 words x ceil(length / 64)
                    | directory u64 x (ceil(length / 512) + 1)

Records are rows of Parquet files (shard, seq, first document, record): Spark
writes and commits them, so a lost executor leaves no half files, and any store
that Spark reaches will do. Documents lie in ascending doc_id order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_folder
from .words import _powers, mix, text_slices

MAGIC = b"DAC1"
END_ID = 2
#: A record is closed at so many ids, after the slice of texts that reaches them; one document is never split.
RECORD_IDS = 1 << 19
#: Pieces of text whose ids a worker remembers, about 50 bytes each; then it starts anew.
CACHE = 1_000_000
#: Pieces of more bytes are not remembered.
LONGEST = 255


def encode_record(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """The record of ``ids`` (uint32), whose documents begin at ``offsets``."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        go_on = rest > 0xFF
        bits = np.packbits(go_on, bitorder="little")
        bitmap = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        bitmap[: len(bits)] = bits
        ones = np.add.reduceat(go_on.astype(np.uint64), np.arange(0, len(rest), 512)) if len(rest) else np.zeros(0, np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        if not go_on.any():
            break
        rest = rest[go_on] >> 8
    head = MAGIC + struct.pack("<IQQ", len(levels), len(ids), len(offsets) - 1)
    return head + offsets.astype("<u8").tobytes() + b"".join(levels)


class Record:
    """A view of one record with random access to ids and documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 record")
        n_levels, self.n_ids, self.n_docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            words = -(-n // 64)
            bitmap = np.frombuffer(data, "<u8", words, at) if at % 8 == 0 else np.frombuffer(data[at : at + 8 * words], "<u8")
            at += 8 * words
            dirs = -(-n // 512) + 1
            directory = np.frombuffer(data[at : at + 8 * dirs], "<u8")
            at += 8 * dirs
            self.levels.append((chunks, bitmap, directory))

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at any ``places`` of the record, each found on its own by rank."""
        out = np.zeros(len(places), np.uint32)
        which, at = np.arange(len(places)), np.asarray(places, np.int64)
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            on = (bitmap[word] >> bit) & np.uint64(1) == 1
            if not on.any():
                break
            which, at, word, bit = which[on], at[on], word[on], bit[on]
            rank = directory[at >> 9].astype(np.int64)
            first = (at >> 9) << 3
            for step in range(7):  # whole 64-bit words between the directory's place and this one
                w = first + step
                rank += np.where(w < word, np.bitwise_count(bitmap[np.minimum(w, len(bitmap) - 1)]), 0).astype(np.int64)
            below = bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))
            at = rank + np.bitwise_count(below).astype(np.int64)
        return out

    def _rank(self, level: int, at: int) -> int:
        """Ones before place ``at`` of the level's bitmap."""
        _, bitmap, directory = self.levels[level]
        if at >> 9 >= len(directory) - 1:
            return int(directory[-1])
        words = bitmap[(at >> 9) << 3 : at >> 6]
        rank = int(directory[at >> 9]) + int(np.bitwise_count(words).sum())
        if at & 63:
            rank += (int(bitmap[at >> 6]) & ((1 << (at & 63)) - 1)).bit_count()
        return rank

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of places ``start`` to ``end``: two ranks per level, the rest is copying."""
        out = np.zeros(end - start, np.uint32)
        which: np.ndarray | slice = slice(None)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[which] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            if k + 1 == len(self.levels):
                break
            bits = np.unpackbits(bitmap[start >> 6 : (end + 63) >> 6].view(np.uint8), bitorder="little")
            on = np.flatnonzero(bits[start & 63 : (start & 63) + end - start])
            which = on if isinstance(which, slice) else which[on]
            start, end = self._rank(k, start), self._rank(k, end)
            if start == end:
                break
        return out

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.offsets[i]), int(self.offsets[i + 1]))


#: Classes of bytes. The tokenizer's byte-level pattern never joins two of SPACE, LETTER, DIGIT and MARK in one
#: piece, but for one space before a piece; at OTHER (apostrophes, controls, most of non-ASCII) no cut is made.
OTHER, SPACE, LETTER, DIGIT, MARK = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    out[ord("'")] = OTHER
    out[[*range(0x09, 0x0E), 0x20]] = SPACE
    return out


_CLASSES = _byte_classes()
#: White space beyond ASCII in UTF-8; a text with any goes to the library whole.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    Texts are cut, in arrays, where the byte-level pattern surely begins a new
    piece: between letters, digits and marks, and before the last white space
    ahead of a word (a space goes with the word, another one stands alone). The
    distinct pieces of a slice of texts are found by hash, looked up in a table
    of packed ids that the worker keeps from task to task, and only unseen ones
    go to the library. A piece of more than LONGEST bytes and a text with white
    space beyond ASCII go to it every time. Strings of special tokens in a text
    are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens in a text are those tokens, as the library has it, so a text with one isn't cut
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.uncut = re.compile(b"|".join([_WIDE_SPACE.pattern, *map(re.escape, special)]))
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _put(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Append id lists to the pool; return where each begins and its length."""
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum()))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        first = self.filled + np.cumsum(count) - count
        self.filled += len(flat)
        return first, count

    def _library(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, pieces: list[bytes], words: np.ndarray) -> list[list[int]]:
        """Ids of new pieces; a word (letters, perhaps after a space) is one unit of the pattern and goes to the model at once."""
        out: list[list[int]] = [[]] * len(pieces)
        rest = [i for i, w in enumerate(words.tolist()) if not w]
        tokenize, alphabet = self.model.tokenize, self.alphabet
        for i in np.flatnonzero(words).tolist():
            out[i] = [t.id for t in tokenize(pieces[i].decode("latin-1").translate(alphabet))]
        for i, ids in zip(rest, self._library([pieces[i] for i in rest])):
            out[i] = ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of the texts laid end to end in ``data``."""
        n, n_texts = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        if len(self.keys) > CACHE or self.filled > 8 * CACHE:
            self._reset()
        kind = _CLASSES[data]
        # two-byte Latin letters (U+00C0 to U+00FF without the signs for times and divided)
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        begin = np.zeros(n, bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        fresh = begin.copy()  # the first byte of a text
        before, after = kind[:-1], kind[1:]
        begin[1:] |= (before != after) & (before > SPACE) & (after > SPACE)
        space = kind == SPACE
        begin[1:] |= space[1:] & ~space[:-1]  # white space begins
        ends = np.zeros(n, bool)  # the last white space before something else of the same text
        ends[:-1] = space[:-1] & ~space[1:] & ~fresh[1:]
        begin |= ends
        begin[1:] |= ends[:-1] & (data[:-1] != 0x20)
        raw = data.tobytes()
        for m in self.uncut.finditer(raw) if (data >= 0xC2).any() or self.special and self.special.search(raw) else ():
            t = int(np.searchsorted(offsets, m.start(), "right")) - 1
            begin[offsets[t] + 1 : offsets[t + 1]] = False
            kind[offsets[t] : offsets[t + 1]] = OTHER
        first = np.flatnonzero(begin)
        size = np.diff(np.append(first, n))
        whole = np.zeros(len(first), bool)  # those that no table remembers
        whole[size > LONGEST] = True
        wide = kind[first] == OTHER
        if wide.any():
            whole[wide] |= [bool(self.uncut.search(data[a : a + s])) for a, s in zip(first[wide], size[wide])]
        up, down = _powers(1 << max(16, (n - 1).bit_length()))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])
        last = first + size - 1
        key = mix((sums[last] - np.where(first > 0, sums[first - 1], 0)) * down[first] + size.astype(np.uint64))
        at, n_ids = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)

        known = np.flatnonzero(~whole)
        unique, where, back = np.unique(key[known], return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        seen = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not seen.all():
            new = known[where[~seen]]
            letter = np.concatenate([[0], np.cumsum(kind == LETTER)])
            inner = first[new] + (data[first[new]] == 0x20)
            words = (letter[first[new] + size[new]] - letter[inner] == first[new] + size[new] - inner) & (first[new] + size[new] > inner)
            raw = data.tobytes()
            got = self._put(self._learned([raw[a : a + s] for a, s in zip(first[new].tolist(), size[new].tolist())], words))
            order = np.searchsorted(self.keys, unique[~seen])
            self.keys = np.insert(self.keys, order, unique[~seen])
            self.first, self.count = np.insert(self.first, order, got[0]), np.insert(self.count, order, got[1])
            place = np.searchsorted(self.keys, unique)
        if len(known):
            at[known], n_ids[known] = self.first[place][back], self.count[place][back]
        if whole.any():
            alone = np.flatnonzero(whole)
            raw = [data[a : a + s].tobytes() for a, s in zip(first[alone], size[alone])]
            at[alone], n_ids[alone] = self._put(self._library(raw))
        done = np.cumsum(n_ids)
        ids = self.pool[np.repeat(at - (done - n_ids), n_ids) + np.arange(done[-1])]
        per_text = np.diff(np.append(0, done)[np.searchsorted(first, offsets)])
        return ids, per_text


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for the tokenizer at ``path``; its table of pieces outlives the task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _records(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(path).encode
        shard, seq, held, sizes, docs = None, 0, [], [np.zeros(1, np.int64)], []

        def close():
            offsets = np.cumsum(np.concatenate(sizes))
            data = encode_record(np.concatenate(held), offsets.astype(np.uint64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([seq], pa.int64()),
                    pa.array([int(offsets[-1])], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                ["shard", "seq", "n_ids", "docs", "record"],
            )

        for batch in batches:
            if shard is None and batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            for a, b, data, offsets in text_slices(batch, "text"):
                ids, per_text = encode(data, offsets)
                held.append(np.insert(ids, np.cumsum(per_text), np.uint32(END_ID)))
                sizes.append(per_text + 1)
                docs += batch.column(key).slice(a, b - a).to_pylist()
                if sum(map(len, held)) >= RECORD_IDS:
                    yield close()
                    held, sizes, docs, seq = [], [np.zeros(1, np.int64)], [], seq + 1
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> str:
    """Write the ids of every text, each followed by END_ID, in ascending doc_id order; return the folder.

    A null or empty text is END_ID alone; a null doc_id comes first; rows that
    share a doc_id follow each other, by text. An empty table makes an empty
    folder. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ranged = ranged.withColumn("shard", F.spark_partition_id())
    records = map_arrow(ranged, _records(tokenizer_path, "doc_id"), "shard int, seq long, n_ids long, docs array<long>, record binary"
    )
    records.write.parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of ``folder``.

    ``start`` adds the ids of the shards before (one row per shard in one
    window), of the shard's records before, and of the record's documents before.
    """
    files = spark.read.schema("shard int, seq long, n_ids long, docs array<long>, record binary").parquet(folder)
    heads = files.select("shard", "seq", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.withColumn("first", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard").orderBy("seq")
    heads = heads.withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids")).join(shards, "shard")
    firsts = heads.select("shard", "seq", (F.col("first") + F.col("before")).alias("first"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                record = Record(batch.column("record")[row].as_py())
                bounds = record.offsets.astype(np.int64)
                ids = record.span(0, record.n_ids).astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = record.n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("docs")[row].values,
                        pa.array(bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.array(crc, pa.int64()),
                        pa.array([batch.column("shard")[row].as_py()] * n, pa.int32()),
                        pa.array([batch.column("seq")[row].as_py()] * n, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "seq"],
                )

    found = map_arrow(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, seq long")
    return found.join(firsts, ["shard", "seq"]).select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_at(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """(doc_id, at, id) for every asked (doc_id, at), at counted in ids from the document's start.

    Only the asked ids are fetched, by rank, from the records that hold them;
    a place outside its document gives a null id.
    """
    files = spark.read.schema("shard int, seq long, n_ids long, docs array<long>, record binary").parquet(folder)
    where = files.select("shard", "seq", F.posexplode("docs").alias("i", "doc_id"))
    asked = places.select("doc_id", "at").join(where, "doc_id")
    asked = asked.groupBy("shard", "seq").agg(F.collect_list(F.struct("doc_id", "i", "at")).alias("asked"))
    held = files.select("shard", "seq", "record").join(asked, ["shard", "seq"]).select("record", "asked")

    def run(batches):
        for batch in batches:
            for data, asked in zip(batch.column("record").to_pylist(), batch.column("asked").to_pylist()):
                record = Record(data)
                at = np.array([x["at"] for x in asked], np.int64)
                i = np.array([x["i"] for x in asked], np.int64)
                lo, hi = record.offsets[i].astype(np.int64), record.offsets[i + 1].astype(np.int64)
                ok = (at >= 0) & (lo + at < hi)
                ids = np.zeros(len(at), np.int64)
                ids[ok] = record.ids((lo + at)[ok])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["doc_id"] for x in asked], pa.int64()),
                        pa.array(at),
                        pa.array([int(x) if o else None for x, o in zip(ids, ok)], pa.int64()),
                    ],
                    ["doc_id", "at", "id"],
                )

    return map_arrow(held, run, "doc_id long, at long, id long")
