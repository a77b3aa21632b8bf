"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. *Shingle weights.* A shingle is five words. Its weight in a text is
   tf * idf, idf = 1 + ln(N / max(df, N * RARE)). Every shingle in more than
   RARE of the documents is counted exactly: all documents are first counted
   into CELLS cells by shingle hash; a shingle above RARE lies in a cell above
   RARE, so only the shingles of such cells are then counted one by one. At
   most (mean distinct shingles of a document) / RARE of them are kept,
   whatever the size of the corpus; all rarer ones weigh alike. Without that
   floor an edit's own shingles outweigh the text around them and hot groups
   of near copies fall apart (figures in the README).
2. *Samples.* Every text gets SAMPLES consistent weighted samples; two texts
   share a sample with the probability of their weighted Jaccard similarity.
   ROWS samples make a band key.
3. *Exact copies* (same words in the same order) fall together by a 128-bit
   hash; only one of them goes on.
4. *Links.* Within a bucket of equal band keys the least id leads, is compared
   with all others by exact weighted Jaccard similarity and leaves the bucket;
   so does a second leader. That takes members times LEADERS comparisons and
   gathers hot groups of copies. In a bucket where members of several classes
   are left, those outside its largest class are compared exactly with all
   members of other classes, in blocks of about BLOCK_BYTES of text. No pair
   becomes a row: a block pair is worked off in arrays and gives a spanning
   forest of its links.
5. *Classes* are the connected components of the links, by contraction;
   exact copies then take the class of the one that went on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import map_arrow, materialize, scratch
from .words import mix, shingles, text_slices, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
SAMPLES = BANDS * ROWS
#: So many rounds of leaders come before the blocks.
LEADERS = 2
#: Text of one block of a bucket, in bytes, about.
BLOCK_BYTES = 1 << 20
#: Shingles in at most this share of the documents have the full idf.
RARE = 0.01
#: Cells of the first count of shingles; a power of two.
CELLS = 1 << 18
_ID_BITS = np.uint64(0xFFFFFFFFFFFF)


def _gamma_table(size: int = 1 << 14, seed: int = 7) -> np.ndarray:
    """Draws of Gamma(2, 1), sorted: sample q of the table is its quantile (q + 0.5) / size."""
    u = np.linspace(0.5 / size, 1 - 0.5 / size, size)
    x = np.full(size, 1.0)
    for _ in range(60):  # Newton steps on the distribution function 1 - (1 + x) e^-x
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 4, x * 4 + 1)
    return x.astype(np.float32)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _weighted(data, offsets, common_ids, common_idf, full_idf):
    """Distinct shingles by text: (id, text number, weight, words hash per text pair, word counts)."""
    words, counts = word_hashes(data, offsets)
    ids, text = shingles(words, counts, WIDTH)
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (ids & _ID_BITS))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    ids, text = key & _ID_BITS, (key >> np.uint64(48)).astype(np.int64)
    idf = np.full(len(ids), full_idf, np.float32)
    if len(common_ids) and len(ids):
        pos = np.minimum(np.searchsorted(common_ids, ids), len(common_ids) - 1)
        hit = common_ids[pos] == ids
        idf[hit] = common_idf[pos[hit]]
    return ids, text, tf.astype(np.float32) * idf, words, counts


def _samples(ids: np.ndarray, weight: np.ndarray, starts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The consistent weighted samples, one row per text that begins at ``starts``."""
    out = np.empty((len(starts), len(salts)), np.uint32)
    log_w = np.log(weight)
    low = ids.astype(np.uint32)
    for j, salt in enumerate(salts):
        u = mix(ids ^ salt)
        r = _GAMMA[(u & np.uint64(0x3FFF)).astype(np.int32)]
        log_c = _LOG_GAMMA[((u >> np.uint64(14)) & np.uint64(0x3FFF)).astype(np.int32)]
        beta = (u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        bits = log_a.view(np.uint32)  # ordered as the floats are
        bits = bits ^ ((np.uint32(0) - (bits >> np.uint32(31))) | np.uint32(0x80000000))
        name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | name, starts)
        out[:, j] = best.astype(np.uint32)
    return out


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 18):
    for batch in batches:
        for a, b, data, offsets in text_slices(batch, "text", most):
            for c in range(0, b - a, 60000):  # the text number has 16 bits
                d = min(c + 60000, b - a)
                yield batch.column("doc_id").slice(a + c, d - c), data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by cell of their distinct shingles, summed over the task."""
    total = np.zeros(CELLS, np.int64)
    for _, data, offsets in _rows(batches):
        ids, *_ = _weighted(data, offsets, (), (), 1.0)
        total += np.bincount((ids & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def _counted(heavy: np.ndarray):
    """df of the shingles in heavy cells, summed over some documents at a time."""

    def run(batches):
        held, size = [], 0

        def flush():
            ids, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n)], ["shingle", "n"])

        for _, data, offsets in _rows(batches):
            ids, *_ = _weighted(data, offsets, (), (), 1.0)
            ids = ids[heavy[(ids & np.uint64(CELLS - 1)).astype(np.int64)]]
            held.append(ids)
            size += len(ids)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    return run


def common_shingles(docs: DataFrame, n_docs: int) -> dict[int, int]:
    """df of every shingle that is in more than RARE of the documents.

    At most (mean distinct shingles of a document) / RARE entries, whatever the corpus' size.
    """
    texts = docs.select("doc_id", "text")
    cells = map_arrow(texts, _cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    heavy = np.zeros(CELLS, bool)
    heavy[[r[0] for r in cells.where(F.col("n") > RARE * n_docs).select("cell").collect()]] = True
    if not heavy.any():
        return {}
    counted = map_arrow(texts, _counted(heavy), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(r[0]): int(r[1]) for r in counted.where(F.col("n") > RARE * n_docs).collect()}


class _Weights:
    """The idf table, small by the bound above; it goes to the tasks with their code."""

    def __init__(self, df: dict[int, int], n_docs: int):
        ids = np.array(sorted(df), np.int64)
        self.ids = ids.astype(np.uint64)
        self.idf = np.array([1 + np.log(n_docs / df[int(i)]) for i in ids], np.float32)
        self.full = np.float32(1 + np.log(1 / RARE))

    def apply(self, data, offsets):
        return _weighted(data, offsets, self.ids, self.idf, self.full)


def _signatures(weights: _Weights):
    def run(batches):
        for doc_ids, data, offsets in _rows(batches):
            ids, text, w, words, counts = weights.apply(data, offsets)
            has = np.flatnonzero(counts > 0)
            if not len(has):
                continue
            starts = np.searchsorted(text, has)
            rows = _samples(ids, w, starts, _SALTS)
            rows = rows.reshape(len(has), BANDS, ROWS).astype(np.uint64)
            bands = np.zeros((len(has), BANDS), np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            for k in range(ROWS):
                bands = mix(bands * np.uint64(31) + rows[:, :, k])
            begin = (np.cumsum(counts) - counts)[has]
            place = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, counts[has]).astype(np.uint64)
            copies = [np.add.reduceat(mix(words ^ mix(place + np.uint64(s))), begin).astype(np.int64) for s in (11, 977)]
            flat = pa.array(bands.astype(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(has)),
                    pa.array(copies[0]),
                    pa.array(copies[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat),
                ],
                ["doc_id", "copy1", "copy2", "bands"],
            )

    return run


def _similarity(weights: _Weights):
    """Exact weighted Jaccard similarity of the texts of each pair."""

    def sides(batch, name):
        renamed = pa.RecordBatch.from_arrays([batch.column(name)], ["text"])
        out = []
        for _a, _b, data, offsets in text_slices(renamed, "text", 1 << 18):
            ids, text, w, *_ = weights.apply(data, offsets)
            cut = np.searchsorted(text, np.arange(len(offsets)))
            out += [(ids[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in range(len(offsets) - 1)]
        return out

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sims = []
                for (ia, wa), (ib, wb) in zip(sides(part, "ta"), sides(part, "tb")):
                    both, xa, xb = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
                    inter = float(np.minimum(wa[xa], wb[xb]).sum())
                    union = float(wa.sum() + wb.sum()) - inter
                    sims.append(inter / union if union > 0 else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"]
                )

    return run


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, class): the least node of the connected component, for every node of ``links`` (a, b).

    Every round, each node moves to its least neighbour if that is less, links
    are rewritten to where their ends moved, and links within one node go. A
    star around its least node is done in one round. After a few rounds the
    order is a seeded hash instead of the id, which also folds long chains in a
    number of rounds that grows with the logarithm of their length.
    """
    links = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct()
    links = materialize(links, f"{tag}-links")
    nodes = links.select(F.col("src").alias("node")).union(links.select(F.col("dst"))).distinct()
    label = materialize(nodes.withColumn("label", F.col("node")), tag)
    turn = 0
    while not links.isEmpty():
        rank = (lambda c: F.col(c)) if turn < 3 else (lambda c, k=turn: F.xxhash64(F.lit(k), F.col(c)))
        both = links.union(links.select("dst", "src"))
        best = both.groupBy("src").agg(F.min(F.struct(rank("dst").alias("r"), F.col("dst").alias("to"))).alias("m"))
        least = F.least(F.col("m"), F.struct(rank("src").alias("r"), F.col("src").alias("to")))
        moved = materialize(best.select("src", least["to"].alias("to")), f"{tag}-moved")
        to = lambda key, name: moved.select(F.col("src").alias(key), F.col("to").alias(name))
        label = label.join(to("label", "_to"), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
        label = materialize(label, tag)
        links = links.join(to("src", "_s"), "src").join(to("dst", "_d"), "dst").where("_s <> _d")
        links = links.select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).distinct()
        links = materialize(links, f"{tag}-links")
        turn += 1
    least = label.groupBy("label").agg(F.min("node").alias("class"))
    return materialize(label.join(least, "label").select("node", "class"), f"{tag}-classes")


@scratch
def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_class): one row per row of ``docs``; class_id is the least doc_id of its class.

    Two documents are linked if they have the same words in the same order, or
    share a band and reach ``threshold`` in weighted Jaccard similarity; a
    class is all documents that links join. A null text, or one without words,
    is a class of its own (class_id = doc_id). Rows that share a doc_id are one
    document and share its class; a row with a null doc_id has a null class. An
    empty table gives an empty result. Columns other than doc_id and text are
    not read.
    """
    docs = docs.select("doc_id", "text")
    n_docs = docs.count()
    weights = _Weights(common_shingles(docs, n_docs), n_docs)
    signed = map_arrow(docs.where(F.col("doc_id").isNotNull()), _signatures(weights), "doc_id long, copy1 long, copy2 long, bands array<long>"
    )
    signed = materialize(signed, "neardup-signatures")
    keys = signed.select("copy1", "copy2", "doc_id", "bands")
    reps = keys.groupBy("copy1", "copy2").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    copies = keys.join(reps.drop("bands"), ["copy1", "copy2"]).where(F.col("doc_id") != F.col("node"))
    copies = copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    member = reps.select(F.explode("bands").alias("band"), "node")
    shared = member.groupBy("band").count().where("count > 1").select("band")
    member = materialize(member.join(shared, "band"), "neardup-members")
    nodes = member.select(F.col("node").alias("doc_id")).distinct()
    # always by shuffle: the table grows with the corpus
    texts = materialize(docs.join(nodes.hint("merge"), "doc_id", "left_semi"), "neardup-texts")

    links = _linked(member, texts, weights, threshold)
    classes = components(links, "neardup-classes")
    copied = copies.join(classes.withColumnRenamed("node", "a"), "a", "left")
    copied = copied.select(F.col("b").alias("doc_id"), F.coalesce("class", "a").alias("class"))
    found = classes.select(F.col("node").alias("doc_id"), "class").unionByName(copied)
    found = found.groupBy("doc_id").agg(F.min("class").alias("class"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count_distinct("doc_id").alias("n_class"))
    return out.join(sizes, "class_id", "left").select("doc_id", "class_id", "n_class")


def _blocks(weights: _Weights, threshold: float):
    """Links between different classes of a block pair's members, a spanning forest of them, every pair compared exactly."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, classes, block = (table.column(c).to_numpy() for c in ("node", "class", "block"))
        mine = pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], ["text"])
        parts, starts, done = [], [], 0
        for a, b, data, offsets in text_slices(mine, "text", 1 << 18):
            ids, text, w, *_ = weights.apply(data, offsets)
            parts.append((ids, w))
            starts.append(np.searchsorted(text, np.arange(b - a)) + done)
            done += len(ids)
        ids, w = (np.concatenate(x) for x in zip(*parts))
        cut = np.append(np.concatenate(starts), done)
        _, ids = np.unique(ids, return_inverse=True)
        mass = np.add.reduceat(w, cut[:-1], dtype=np.float64)
        row = np.zeros(ids.max() + 1, np.float32)
        root = {c: c for c in set(classes.tolist())}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        first, second = [], []
        low = block.min()
        within = block.max() == low
        for x in np.flatnonzero(block == low):
            at = slice(cut[x], cut[x + 1])
            row[ids[at]] = w[at]
            inter = np.add.reduceat(np.minimum(row[ids], w), cut[:-1], dtype=np.float64)
            row[ids[at]] = 0
            alike = inter / (mass + mass[x] - inter) >= threshold
            alike &= (nodes > nodes[x]) if within else (block != low)
            for y in np.flatnonzero(alike & (classes != classes[x])):
                cx, cy = top(int(classes[x])), top(int(classes[y]))
                if cx != cy:
                    root[cx] = cy
                    first.append(min(nodes[x], nodes[y]))
                    second.append(max(nodes[x], nodes[y]))
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})

    return run


def _linked(member: DataFrame, texts: DataFrame, weights: _Weights, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket and reach the threshold, enough to join every class.

    A member that has led has met all others of its bucket and leaves it; a
    bucket is done when those left in it are of one class.
    """

    def judge(pairs):
        ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        both = pairs.hint("merge").join(ta, "a").join(tb.hint("merge"), "b").select("a", "b", "ta", "tb")
        both = map_arrow(both, _similarity(weights), "a long, b long, sim double")
        return materialize(both.where(F.col("sim") >= threshold).select("a", "b"), "neardup-links")

    left = member.select("band", "node", F.col("node").alias("class"))
    links = tried = None
    for _ in range(LEADERS):
        leader = left.groupBy("band").agg(F.min("node").alias("lead"), F.min_by("class", "node").alias("led"))
        met = left.join(leader, "band")
        pairs = met.where("class <> led").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "neardup-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = judge(pairs) if links is None else links.union(judge(pairs))
        rest = met.where("node <> lead").select("band", "node")
        rest = rest.join(components(links, "neardup-round"), "node", "left").withColumn("class", F.coalesce("class", "node"))
        several = rest.groupBy("band").agg((F.min("class") < F.max("class")).alias("more")).where("more").select("band")
        left = materialize(rest.join(several, "band", "left_semi").select("band", "node", "class"), "neardup-left")
        if left.isEmpty():
            return links
    sized = left.join(texts.select(F.col("doc_id").alias("node"), F.octet_length("text").alias("size")).hint("merge"), "node")
    by_class = sized.groupBy("band", "class").agg(F.count("*").alias("n"))
    largest = by_class.groupBy("band").agg(F.max(F.struct("n", "class"))["class"].alias("largest"))
    sized = sized.join(largest, "band").withColumn("main", F.col("class") == F.col("largest"))
    n_blocks = sized.groupBy("band").agg(*[
        F.ceil(F.coalesce(F.sum(F.when(F.col("main") == flag, F.col("size"))), F.lit(0)) / BLOCK_BYTES).cast("int").alias(name)
        for name, flag in (("n_others", False), ("n_main", True))
    ])
    # blocks of others come first; each meets itself, the later ones and every block of the largest class
    sized = sized.join(n_blocks, "band")
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    sized = sized.withColumn("block", F.when(F.col("main"), F.col("n_others") + own(F.col("n_main"))).otherwise(own(F.col("n_others"))))
    last = F.when(F.col("main"), F.col("n_others") - 1).otherwise(F.col("n_others") + F.col("n_main") - 1)
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("node", "class", "band", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    dealt = dealt.join(texts.select(F.col("doc_id").alias("node"), "text").hint("merge"), "node")
    ship(dealt.sparkSession)
    found = dealt.groupBy("band", "p", "q").applyInArrow(_blocks(weights, threshold), "a long, b long")
    return links.union(materialize(found.distinct(), "neardup-links"))
