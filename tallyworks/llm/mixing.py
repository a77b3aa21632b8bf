"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions.

The text of each source is cut into blocks of BLOCK words, shard by shard. The
blocks of the mix go to the sources by the highest quotients target / (2 k + 1),
and a source's to its regions and their shards by words / (2 k + 1); a shard
takes its quota as whole passes and, for the rest, the blocks with the least
seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, by_row, let, materialize, scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SEED = "mix-1"
#: A shard holds about so many documents, so a hot source has many shards.
SHARD_DOCS = 2000
#: So many shards are a region.
REGION_SHARDS = 1000
#: So often the range of a divisor is halved: enough to part any two quotients that doubles part.
BISECTIONS = 100


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. None gets more than ``most`` times its size; what
    is above goes to the others by weight until none is above. That level is
    found in one sort: with the sources by cap / weight, the first one whose
    fair part of what the earlier, capped ones leave is within its cap sets it.
    One row per source, so the two windows are over a short list.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("left", total * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("left") / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("v")))).over(
        Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ranked.withColumn("level", level["v"]).select(
        "source",
        "rank",
        "source_size",
        F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"),
    )


def apportion(cells: DataFrame, group: list[str], cell: list[str], size: str, seats: str) -> DataFrame:
    """Add ``quota``: ``seats`` (equal within a group) dealt to the cells by the highest quotients size / (2 k + 1).

    A cell has as many seats as it has quotients above the group's last winning
    one, which is floor(size / d + 1/2) for a divisor d; d is found by
    bisection over the sizes of the group, one array per group. Quotients equal
    to the last one go to the earlier cells. Sizes are positive.
    """
    held = lambda sizes, d: F.aggregate(sizes, F.lit(0.0), lambda a, x: a + F.floor(x / d + 0.5).cast("double"))
    groups = cells.groupBy(*group).agg(F.collect_list(F.col(size).cast("double")).alias("_sizes"), F.max(seats).cast("double").alias("_seats"))
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)),
        F.struct(F.lit(0.0).alias("lo"), (2 * F.array_max("_sizes") + 1).alias("hi")),
        lambda r, _: let(
            (r["lo"] + r["hi"]) / 2,
            lambda mid: let(
                held(F.col("_sizes"), mid) <= F.col("_seats"),
                lambda fits: F.struct(F.when(fits, r["lo"]).otherwise(mid).alias("lo"), F.when(fits, mid).otherwise(r["hi"]).alias("hi")),
            ),
        ),
        lambda r: r["hi"],
    )
    divisors = groups.select(*group, halved.alias("_d"))
    dealt = cells.join(divisors, group).withColumn("_sure", F.floor(F.col(size) / F.col("_d") + 0.5))
    order = Window.partitionBy(*group).orderBy((F.col(size) / (2 * F.col("_sure") + 1)).desc(), *cell)
    dealt = dealt.withColumn("_open", F.col(seats) - F.sum("_sure").over(Window.partitionBy(*group))).withColumn("_r", F.row_number().over(order))
    return dealt.select(*cells.columns, (F.col("_sure") + (F.col("_r") <= F.col("_open")).cast("long")).cast("long").alias("quota"))


def quotas(aims: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``quota``, a number of blocks, to ``cells`` (rank, region, shard, words): source by source, then region, then shard.

    The blocks of the whole mix go to the sources by the highest quotients of
    their targets, each source's to its regions and each region's to its shards
    by those of their words. So no window holds more than the sources, the
    regions of a source or the shards of a region.
    """
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long")
    sources = aims.where("target > 0").select((F.col("rank") * 0).alias("mix"), "rank", "target", seats.alias("seats"))
    sources = apportion(sources, ["mix"], ["rank"], "target", "seats")
    regions = cells.groupBy("rank", "region").agg(F.sum("words").alias("held"))
    regions = regions.join(sources.select("rank", F.col("quota").alias("seats")), "rank")
    regions = materialize(apportion(regions, ["rank"], ["region"], "held", "seats"), "mix-regions")
    shards = cells.join(regions.select("rank", "region", F.col("quota").alias("seats")), ["rank", "region"])
    return apportion(shards, ["rank", "region"], ["shard"], "words", "seats").drop("seats")


@scratch
def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED, **kw) -> DataFrame:
    """What the mix takes of every document.

    Returns one row per row of ``docs``: row (its number), doc_id, size,
    source_size, target, taken (words, repeats counted) and picks (array of
    pass, start, end in words of the text, end exclusive).

    A null text has size 0 and is never taken; a null source is a source of its
    own; rows that share a doc_id are taken one by one; an empty table gives an
    empty result. The same rows give the same mix, whatever their order and
    partitioning.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("content"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = materialize(
        targets(sources.select("source", "source_size"), **kw)
        .join(sources.select(F.col("source").alias("_s"), "n_docs"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s"),
        "mix-targets",
    )
    rows = rows.join(aims, rows.source.eqNullSafe(aims.source)).drop("source")
    order_key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("content").cast("string")))
    shards = F.ceil(F.col("n_docs") / SHARD_DOCS)
    rows = rows.withColumn("key", order_key)
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), shards))
    place = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "row")
    rows = rows.withColumn("end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = materialize(rows.withColumn("start", F.col("end") - F.col("size")), "mix-rows")

    cells = rows.groupBy("rank", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    cells = materialize(cells.withColumn("region", F.floor(F.col("shard") / REGION_SHARDS)), "mix-cells")
    cells = quotas(aims, cells, block)
    blocks = F.ceil(F.col("words") / block)
    cells = cells.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.col("blocks") * MOST))
    cells = cells.withColumn("passes", F.floor(F.col("quota") / F.col("blocks")))
    cells = cells.withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
    # the blocks are many though the shards are few: keep them spread, and never broadcast them
    spread = cells.where("rest > 0").repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    drawn = spread.select("rank", "shard", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    draw = Window.partitionBy("rank", "shard").orderBy(
        F.md5(F.concat_ws(":", F.lit(seed), F.col("rank").cast("string"), F.col("shard").cast("string"), F.col("block").cast("string"))),
        "block",
    )
    drawn = drawn.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= F.col("rest"))
    drawn = drawn.select("rank", "shard", "block")

    touched = rows.where("size > 0").select(
        "row",
        "rank",
        "shard",
        "start",
        "end",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"),
    )
    parts = touched.join(drawn.hint("merge"), ["rank", "shard", "block"]).select(
        "row",
        (F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).alias("from"),
        (F.least(F.col("end"), (F.col("block") + 1) * block) - F.col("start")).alias("to"),
    )
    parts = parts.groupBy("row").agg(
        F.sum(F.col("to") - F.col("from")).alias("extra"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts")
    )
    out = rows.join(cells.select("rank", "shard", "passes"), ["rank", "shard"], "left").join(parts, "row", "left")
    passes = F.coalesce("passes", F.lit(0))
    picks = F.concat(
        F.when(
            (passes > 0) & (F.col("size") > 0),
            F.transform(
                F.sequence(F.lit(1).cast("long"), passes),
                lambda p: F.struct(p.alias("pass"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end")),
            ),
        ).otherwise(F.array().cast("array<struct<pass:bigint,start:bigint,end:bigint>>")),
        F.transform(
            F.coalesce("parts", F.array().cast("array<struct<from:bigint,to:bigint>>")),
            lambda x: F.struct((passes + 1).alias("pass"), x["from"].alias("start"), x["to"].alias("end")),
        ),
    )
    return out.select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        (passes * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long").alias("taken"),
        picks.alias("picks"),
    )


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per document and pass that the mix takes.

    A document taken whole keeps its text; of one taken in part the text is its
    picked words in order, joined by spaces. n_chars, if there, is counted anew.
    Rows without words aren't taken; rows are taken one by one whatever their
    doc_id; an empty table gives an empty result; further columns, of any name,
    are carried along.
    """
    numbered = by_row(docs, "mix-numbered")
    named = numbered.select(F.col("row").alias("doc_id"), "doc.source", "doc.text")
    taken = mix(named, **kw).where("taken > 0").select(F.col("doc_id").alias("row"), "size", F.explode("picks").alias("p"))
    taken = taken.groupBy("row", "size", "p.pass").agg(F.sort_array(F.collect_list(F.struct("p.start", "p.end"))).alias("picks"))
    whole = (F.size("picks") == 1) & (F.col("picks")[0]["start"] == 0) & (F.col("picks")[0]["end"] == F.col("size"))
    pieces = let(
        F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)),
        lambda w: F.array_join(
            F.flatten(F.transform("picks", lambda p: F.slice(w, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))), " "
        ),
    )
    out = numbered.join(taken, "row").select("doc", F.when(whole, F.col("doc.text")).otherwise(pieces).alias("picked"))
    new = {"text": F.col("picked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("picked").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
