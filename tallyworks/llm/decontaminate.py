"""Benchmark decontamination with a positional inverted index.

The benchmark is a stated set of test passages, taken in blocks of bounded
size. For each block:

1. count in how many documents each of the block's terms occurs;
2. every window (ten consecutive words of an item, or the whole of a shorter
   item) takes its two rarest terms as anchors;
3. index: one posting per occurrence of an anchor term in the corpus (term,
   document row, place); the rarest anchors' postings also carry the nine words
   on either side;
4. from the rarest list, every posting is shifted by its anchor's place in the
   window and kept if the second list has the place where that window wants its
   second anchor; the words around the kept ones are then compared one by one.

Proximity matches of a window start from either of its anchors and want AGREE of
its terms, each within a slop of its place from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch
from .words import TRANSLATE

WIDTH = 10
#: Benchmark text handled at once, in bytes: this bounds the term table that goes to the tasks.
BLOCK_BYTES = 8 << 20
#: The anchor table is broadcast up to so many rows and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Proximity: terms may stand so many words off their places, and this share of them must be there.
SLOP = 2
AGREE = 0.8


def split_words(text) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(TRANSLATE).split() if text else []


def windows(items: DataFrame) -> DataFrame:
    """(item, window, place, size, words): all windows of all items; equal items have equal windows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [x.decode("utf-8", "replace") for x in split_words(text)]
                size = min(WIDTH, len(w))
                rows += [
                    {"item": item, "place": p, "size": size, "words": w[p : p + size]}
                    for p in range(len(w) - size + 1 if w else 0)
                ]
            schema = pa.schema(
                [("item", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("words", pa.list_(pa.string()))]
            )
            yield pa.RecordBatch.from_pylist(rows, schema)

    items = items.select(F.col("item_id").cast("string").alias("item"), "text")
    found = map_arrow(items, run, "item string, place int, size int, words array<string>")
    return found.withColumn("window", F.xxhash64("words"))


def _document_counts(terms: dict[bytes, int]):
    def run(batches):
        total = [0] * len(terms)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for w in set(split_words(text)) & terms.keys():
                    total[terms[w]] += 1
        some = [(i, n) for i, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in some], pa.int32()), pa.array([n for _, n in some], pa.int64())], ["id", "n"]
        )

    return run


def _postings(first: dict[bytes, int], second: dict[bytes, int], reach: int):
    """Per document: its row, id, number of words, and the postings of the anchor terms."""
    near = pa.list_(pa.struct([("id", pa.int32()), ("at", pa.int32()), ("words", pa.string())]))
    plain = pa.list_(pa.struct([("id", pa.int32()), ("at", pa.int32())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts, nears, plains = [], [], []
                for text in part.column("text").to_pylist():
                    w = split_words(text)
                    counts.append(len(w))
                    nears.append(
                        [
                            {"id": t, "at": i, "words": b" ".join(w[max(0, i - reach) : i + reach + 1]).decode("utf-8", "replace")}
                            for i, t in enumerate(map(first.get, w))
                            if t is not None
                        ]
                    )
                    plains.append([{"id": t, "at": i} for i, t in enumerate(map(second.get, w)) if t is not None])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(nears, near),
                        pa.array(plains, plain),
                    ],
                    ["row", "doc_id", "n_words", "near", "plain"],
                )

    return run


def anchor_table(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, id, offset, id2, offset2): the two rarest places of every distinct window; the earlier one at ties.

    ``counts`` has term, id and n; a window of one word has no second anchor.
    """
    each = wins.dropDuplicates(["window"]).select("window", F.posexplode("words").alias("offset", "term"))
    each = each.join(counts, "term").select("window", F.struct("n", "offset", "id").alias("a"))
    two = each.groupBy("window").agg(F.slice(F.sort_array(F.collect_list("a")), 1, 2).alias("a"))
    return two.select(
        "window",
        F.col("a")[0]["id"].alias("id"),
        F.col("a")[0]["offset"].alias("offset"),
        F.get("a", F.lit(1))["id"].alias("id2"),
        F.get("a", F.lit(1))["offset"].alias("offset2"),
    )


@scratch
def contamination(docs: DataFrame, benchmark: DataFrame, slop: int | None = None) -> DataFrame:
    """Hits of every benchmark window in every document.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit (words inside
    any occurrence of a window), items (sorted item ids, as strings, with an
    occurring window), spans (array of start, end in words, end exclusive) and,
    if ``slop`` is given, near_items (items with a window of which an anchor
    occurs with AGREE of the window's terms within ``slop`` words of their
    places around it, exact occurrences included).

    A null or empty text has no words and no hits; a null or empty item has no
    window; rows that share a doc_id are judged one by one; equal items all
    count. Other columns of the tables are not read.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    wins = materialize(windows(items), "decon-windows")
    hits = near = stats = None
    for block in range(blocks):
        mine = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        index, anchors = _index(docs, mine, WIDTH - 1 + (slop or 0))
        if stats is None:
            stats = index.select("row", "doc_id", "n_words")
        found, close = _matches(index, anchors, mine, slop)
        hits = found if hits is None else hits.union(found)
        if slop is not None:
            near = close if near is None else near.union(close)

    per_row = hits.groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("hit"),
    )
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(
        "hit",
        nothing,
        lambda a, h: F.struct(
            (a["n"] + F.greatest(h["end"] - F.greatest(h["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], h["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    per_row = per_row.select("row", "items", F.col("hit").alias("spans"), n_hit.cast("long").alias("n_hit"))
    out = stats.join(per_row, "row", "left")
    columns = [
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    ]
    if slop is not None:
        near_items = near.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("near_items"))
        out = out.join(near_items, "row", "left")
        columns.append(F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"))
    return out.select(*columns)


def _index(docs: DataFrame, wins: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """The postings of the block's anchor terms, by document, and the anchor table with term numbers."""
    spark = docs.sparkSession
    vocabulary = [r[0] for r in wins.select(F.explode("words")).distinct().collect()]  # bounded by BLOCK_BYTES
    numbers = {w.encode(): i for i, w in enumerate(vocabulary)}
    ids = spark.createDataFrame(list(enumerate(vocabulary)), "id int, term string")
    counted = map_arrow(docs.select("text"), _document_counts(numbers), "id int, n long")
    counts = ids.join(counted.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = materialize(anchor_table(wins, counts), "decon-anchors")
    chosen = anchors.select("id", "id2").distinct().collect()
    first = {vocabulary[i].encode(): i for r in chosen for i in ((r.id, r.id2) if reach >= WIDTH else (r.id,)) if i is not None}
    second = {vocabulary[r.id2].encode(): r.id2 for r in chosen if r.id2 is not None}
    index = map_arrow(
        docs.select("row", "doc_id", "text"),
        _postings(first, second, reach),
        "row long, doc_id long, n_words long, near array<struct<id:int,at:int,words:string>>, plain array<struct<id:int,at:int>>",
    )
    return materialize(index, "decon-index"), anchors


def _matches(index: DataFrame, anchors: DataFrame, wins: DataFrame, slop: int | None):
    # wins has a row for every item and window, equal items included, so it bounds all three tables
    small = wins.count() <= BROADCAST_ROWS
    held = F.broadcast if small else (lambda df: df)
    rarest = index.where(F.size("near") > 0).select("row", F.explode("near").alias("p")).select("row", "p.*")
    reach = WIDTH - 1 + (slop or 0)
    begin = (F.col("at") - F.col("offset")).alias("start")
    place = (F.least(F.col("at"), F.lit(reach)) - F.col("offset")).alias("from")
    begun = rarest.join(held(anchors), "id").select(
        "row",
        "window",
        begin,
        place,
        F.col("words").alias("seen"),
        "id2",
        (F.col("at") - F.col("offset") + F.col("offset2")).alias("at2"),
    )
    begun = begun.where(F.col("start") >= 0)
    second = index.where(F.size("plain") > 0).select("row", F.explode("plain").alias("q"))
    second = second.select("row", F.col("q.id").alias("id2"), F.col("q.at").alias("at2"))
    met = begun.where("id2 is not null").join(second, ["row", "id2", "at2"], "left_semi")
    met = met.select(*begun.columns).unionByName(begun.where("id2 is null"))
    texts = wins.dropDuplicates(["window"]).select("window", "size", "words")
    exact = met.join(held(texts), "window")
    exact = exact.where(
        (F.col("from") >= 0) & (F.slice(F.split("seen", " "), F.col("from") + 1, F.col("size")) == F.col("words"))
    )
    items = held(wins.select("window", "item").distinct())
    hits = exact.join(items, "window").select("row", "item", "start", (F.col("start") + F.col("size")).alias("end"))
    if slop is None:
        return hits, None
    around = F.split("words", " ")

    def there(word, j):
        """Whether the window's j-th word stands within ``slop`` of its place."""
        lo, hi = F.greatest(F.col("from") + j - slop, F.lit(0)), F.col("from") + j + slop
        return F.array_contains(F.slice(F.col("around"), (lo + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int")), word)

    either = anchors.select("window", "id", "offset").union(anchors.where("id2 is not null").select("window", "id2", "offset2"))
    postings = rarest.select("row", "id", "at", around.alias("around"))
    close = postings.join(held(either), "id").select("row", "window", begin, place, "around").where("start >= 0")
    close = close.join(held(texts), "window")
    # so many terms may be missing; a window with more that don't stand around the anchor at all needs no look at places
    spare = F.col("size") - F.ceil(F.lit(AGREE) * F.col("size"))
    close = close.where((F.size(F.array_except("words", "around")) <= spare) & (F.size(F.filter("words", there)) >= F.col("size") - spare))
    return hits, close.select("row", "window").distinct().join(items, "window").select("row", "item")
