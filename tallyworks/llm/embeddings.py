"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors are compared by their chord, which is sqrt(2 - 2 * cosine). Every
node of a tree has a centre, which is one of its points, and a covering radius,
measured: the largest chord from the centre to a point below it. The centres of
a node's children lie more than half the node's radius apart, so radii halve
from level to level, and a node's centre is again the centre of one child. Two
nodes hold no pair within the threshold if their centres are further apart than
both radii and the threshold together; then nothing below them is compared.

1. *Copies* (equal vectors of one label) are one point with a count.
2. *Upper levels*, by Spark. A node of more than BLOCK points is split around
   centres taken farthest first from FAN or fewer of its points; every point
   goes to its nearest centre. Points of a node are dealt to tasks in chunks,
   so no task gathers a large node. Only the choice of centres looks at a
   sample; radii are measured over all points.
3. *Blocks*. A node of at most BLOCK points is a block (a larger one, whose
   points cannot be told apart or that LEVELS splits did not cut down, is dealt
   into several blocks). One task builds its lower levels.
4. *Dual traversal*. Pairs of upper nodes are pruned level by level by the
   bound, then block pairs; one task walks down both trees of a block pair and
   compares points in arrays. It returns each point's number of links and a
   spanning forest of them; no link becomes a row.
5. *Components* are joined from the forests by contraction.

The bounds are exact, so every pair that reaches the threshold is found and no
other. How much is pruned depends on the data: of vectors spread evenly in many
dimensions hardly any block pair is pruned, and within them the centres of
single points are compared, as the method has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize, numbered, scratch
from .neardup import components

THRESHOLD = 0.93
#: Points of a block.
BLOCK = 4096
#: Children of an upper node at most, and levels that Spark splits at most.
FAN, LEVELS = 32, 6
#: Points of a lower node that is not split any more.
LEAF = 16
#: Slack of the bounds for rounding; far above the error of a chord in double precision.
SLACK = 1e-7


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _farthest_first(points: np.ndarray, apart: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the centres, nearest centre of each point, chord to it): the first point, then always the one farthest from all centres."""
    centres, nearest = [0], np.zeros(len(points), np.int64)
    chord = _chords(points, points[:1])[:, 0]
    while len(centres) < most:
        far = int(chord.argmax())
        if chord[far] <= apart:
            break
        to_new = _chords(points, points[far : far + 1])[:, 0]
        closer = to_new < chord
        nearest[closer], chord[closer] = len(centres), to_new[closer]
        nearest[far], chord[far] = len(centres), 0.0
        centres.append(far)
    return np.array(centres), nearest, chord


def unit(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, scaled to length 1 in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # else very long or short vectors leave the range of squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Tree:
    """Lower levels over the points of a block, reordered so that each node's points and children lie together."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        centre, radius, first, last, child, children = [], [], [], [], [], []

        def add(lo: int, hi: int, c: int, r: float):
            for values, x in ((centre, c), (radius, r), (first, lo), (last, hi), (child, -1), (children, 0)):
                values.append(x)

        add(0, len(points), 0, float(_chords(points, points[:1]).max()))
        at = 0
        while at < len(centre):
            lo, hi = first[at], last[at]
            if hi - lo > LEAF and radius[at] > SLACK:
                mine = self.order[lo:hi]
                # the node's own centre comes first and is the centre of its first child
                mine = np.concatenate([[centre[at]], mine[mine != centre[at]]])
                picked, nearest, chord = _farthest_first(points[mine], radius[at] / 2, len(mine))
                sort = np.argsort(nearest, kind="stable")
                self.order[lo:hi] = mine[sort]
                cut = np.searchsorted(nearest[sort], np.arange(len(picked) + 1))
                child[at], children[at] = len(centre), len(picked)
                reach = np.maximum.reduceat(chord[sort], cut[:-1])
                for k, p in enumerate(picked):
                    add(lo + int(cut[k]), lo + int(cut[k + 1]), int(mine[p]), float(reach[k]))
            at += 1
        self.points = points[self.order]
        self.centres, self.radius = points[np.array(centre)], np.array(radius)
        self.first, self.last = np.array(first), np.array(last)
        self.child, self.children = np.array(child), np.array(children)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        return _ranges(self.child[nodes], self.children[nodes])

    def held(self, nodes: np.ndarray) -> np.ndarray:
        return _ranges(self.first[nodes], self.last[nodes] - self.first[nodes])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of start .. start + n - 1, for each pair, one after another."""
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)


def traverse(a: Tree, b: Tree, threshold: float):
    """Yield (places in a, places in b, hits): point pairs that no bound excludes, and which of them reach ``threshold``."""
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, others = stack.pop()
        ends = b.child[others] < 0
        if a.child[node] < 0:
            if ends.any():
                mine, theirs = np.arange(a.first[node], a.last[node]), b.held(others[ends])
                yield mine, theirs, a.points[mine] @ b.points[theirs].T >= threshold
            if ends.all():
                continue
            nodes, others = np.array([node]), b.below(others[~ends])
        else:
            nodes = np.arange(a.child[node], a.child[node] + a.children[node])
            others = np.concatenate([others[ends], b.below(others[~ends])])
        near = _chords(a.centres[nodes], b.centres[others]) <= a.radius[nodes][:, None] + b.radius[others] + reach
        stack += [(int(nodes[i]), others[near[i]]) for i in np.flatnonzero(near.any(1))]


def _links(threshold: float):
    """(a, b, n) of one block pair: how many vectors each point a is linked with (b null), and a spanning forest of the links (n 0)."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [(np.frombuffer(x["nodes"], np.int64), np.frombuffer(x["counts"], np.int64), Tree(unit(pa.array(x["vectors"])))) for x in table.to_pylist()]
        (na, ma, a), (nb, mb, b) = blocks[0], blocks[-1]
        within = len(blocks) == 1
        na, ma, nb, mb = na[a.order], ma[a.order], nb[b.order], mb[b.order]
        found_a, found_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
        part = np.arange(len(na) + (0 if within else len(nb)))
        shift = 0 if within else len(na)
        first, second = [], []
        for mine, theirs, hits in traverse(a, b, threshold):
            if within:
                hits &= mine[:, None] != theirs
            if not hits.any():
                continue
            found_a[mine] += hits @ mb[theirs]
            found_b[theirs] += ma[mine] @ hits
            for i in np.flatnonzero(hits.any(1)):
                at = part[mine[i]]
                met = theirs[hits[i]]
                fresh, where = np.unique(part[met + shift], return_index=True)
                for p, j in zip(fresh.tolist(), where.tolist()):
                    if p != at:
                        part[part == p] = at
                        first.append(na[mine[i]])
                        second.append(nb[met[j]])
        some_a, some_b = np.flatnonzero(found_a), np.flatnonzero(found_b) if not within else np.zeros(0, np.int64)
        nodes = np.concatenate([na[some_a], nb[some_b], np.array(first, np.int64)])
        to = pa.array(np.concatenate([np.zeros(len(some_a) + len(some_b), np.int64), np.array(second, np.int64)]), mask=np.arange(len(nodes)) < len(some_a) + len(some_b))
        return pa.table({"a": pa.array(nodes), "b": to, "n": pa.array(np.concatenate([found_a[some_a], found_b[some_b], np.zeros(len(first), np.int64)]))})

    return run


def _pick(table: pa.Table) -> pa.Table:
    """The centres of the children of one upper node, from its sampled points."""
    radius, fan = table.column("radius")[0].as_py(), table.column("fan")[0].as_py()
    points = unit(table.column("vector"))
    first = int(np.argmin(table.column("chord").to_numpy()))  # the node's centre, or the sampled point next to it
    turn = np.r_[first, np.delete(np.arange(len(points)), first)]
    picked, *_ = _farthest_first(points[turn], radius / 2, fan)
    own = table.select(["label", "dim", "path"]).slice(0, 1)
    return own.append_column("centres", pa.array([points[turn][picked].tobytes()], pa.binary()))


def _assign(points: pa.Table, centres: pa.Table) -> pa.Table:
    """A chunk of a node's points, each under its nearest centre: path, chord."""
    if not points.num_rows:
        return points.select(KEYS + POINT + ["chord"])
    u = unit(points.column("vector"))
    c = np.frombuffer(centres.column("centres")[0].as_py(), np.float64).reshape(-1, u.shape[1])
    chord = _chords(u, c)
    child = chord.argmin(1)
    path = pa.array([f"{points.column('path')[0].as_py()}/{k}" for k in child])
    out = points.select(["label", "dim"]).append_column("path", path)
    for name in POINT:
        out = out.append_column(name, points.column(name))
    return out.append_column("chord", pa.array(chord[np.arange(len(child)), child]))


def _pack(table: pa.Table) -> pa.Table:
    """The row of one block: its points, and a centre with the radius around it."""
    table = table.combine_chunks()
    u = unit(table.column("vector"))
    chord = _chords(u, u[:1])[:, 0]
    own = table.select(["label", "dim", "path", "chunk"]).slice(0, 1)
    for name, kind, x in (
        ("centre", pa.list_(pa.float64()), u[0]),
        ("radius", pa.float64(), chord.max()),
        ("nodes", pa.binary(), table.column("node").to_numpy().astype(np.int64).tobytes()),
        ("counts", pa.binary(), table.column("count").to_numpy().astype(np.int64).tobytes()),
        ("vectors", pa.list_(table.schema.field("vector").type), table.column("vector").to_pylist()),
    ):
        own = own.append_column(name, pa.array([x], kind))
    return own


KEYS, POINT = ["label", "dim", "path"], ["node", "count", "vector"]


def _upper_levels(points: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The points with the path of their node, and the number of levels below the roots."""
    label, vector = points.schema["label"].dataType.simpleString(), points.schema["vector"].dataType.simpleString()
    keys = f"label {label}, dim int, path string"
    level = 0
    while level < LEVELS:
        sized = points.groupBy(KEYS).agg(F.count("*").alias("n"), F.max("chord").alias("radius"))
        large = materialize(sized.where((F.col("n") > block) & (F.col("radius") > SLACK)), "covertree-large")
        if large.isEmpty():
            break
        large = large.withColumn("fan", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block)).cast("int"))
        told = points.join(large, KEYS, "left")
        inside = told.where("n is not null")
        # the point next to the centre and FAN others: a small group of partial aggregates per node
        salted = inside.groupBy(*KEYS, "radius", "fan", F.pmod(F.xxhash64("node"), F.lit(FAN)).alias("salt"))
        sample = salted.agg(F.min_by(F.struct("vector", "chord"), F.xxhash64("node", F.lit(level))).alias("s"))
        next_to = inside.groupBy(*KEYS, "radius", "fan").agg(F.min_by(F.struct("vector", "chord"), F.struct("chord", "node")).alias("s"))
        sample = sample.drop("salt").unionByName(next_to).select(*KEYS, "radius", "fan", "s.*")
        centres = materialize(sample.groupBy(KEYS).applyInArrow(_pick, f"{keys}, centres binary"), "covertree-centres")
        chunks = F.ceil(F.col("n") / block).cast("int")
        centres = centres.join(large, KEYS).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        dealt = inside.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
        dealt = dealt.select(*KEYS, "chunk", *POINT, "chord")
        by = ["label", "dim", "path", "chunk"]
        split = dealt.groupBy(by).cogroup(centres.select(*by, "centres").groupBy(by)).applyInArrow(
            _assign, f"{keys}, node long, count long, vector {vector}, chord double"
        )
        rest = told.where("n is null").withColumn("path", F.concat("path", F.lit("/0")))
        points = materialize(rest.select(*KEYS, *POINT, "chord").unionByName(split.select(*KEYS, *POINT, "chord")), "covertree-points")
        level += 1
    return points, level


def _parent(path: str, level: int):
    return F.substring_index(path, "/", level + 1)


def _pairs(blocks: DataFrame, levels: int, threshold: float) -> DataFrame:
    """(label, dim, p, q) with p <= q: pairs of block names that the bounds leave, walked down from the roots.

    An upper node's ball is the smallest around its first block's centre that holds the balls of all its blocks.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    gap = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    blocks = blocks.select("label", "dim", "path", "name", "centre", "radius")
    pairs = None
    for level in range(levels + 2):
        last = level == levels + 1
        up = F.col("name") if last else _parent("path", level)
        placed = blocks.withColumn("at", up).withColumn("up", _parent("path", max(level - 1, 0) if not last else levels))
        heads = placed.groupBy("label", "dim", "up", "at").agg(F.min_by("centre", "name").alias("head"))
        balls = placed.join(heads, ["label", "dim", "up", "at"])
        balls = balls.groupBy("label", "dim", "up", "at", "head").agg(F.max(gap("head", "centre") + F.col("radius")).alias("r"))
        side = lambda s: balls.select(*["label", "dim"], *[F.col(x).alias(f"{x}_{s}") for x in ("up", "at", "head", "r")])
        if pairs is None:
            pairs = balls.select("label", "dim", F.col("at").alias("p"), F.col("at").alias("q"))
            continue
        met = pairs.withColumnsRenamed({"p": "up_a", "q": "up_b"}).join(side("a"), ["label", "dim", "up_a"]).join(side("b"), ["label", "dim", "up_b"])
        met = met.where("(up_a < up_b or at_a <= at_b)").where(gap("head_a", "head_b") <= F.col("r_a") + F.col("r_b") + reach)
        pairs = materialize(met.select("label", "dim", F.col("at_a").alias("p"), F.col("at_b").alias("q")), "covertree-pairs")
    return pairs


@scratch
def near_embeddings(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``rows`` (vec_id, embedding, label).

    n_links counts the other vectors of the same label whose cosine is at least
    ``threshold``, in double precision; component_id is the least vec_id that
    links reach, the row's own included; kept says whether the two are equal.
    A vector that is null, empty, zero or holds a null or non-finite component,
    or whose label is null, has no links and its own vec_id as component.
    Vectors of different lengths have no cosine and no link. Rows that share a
    vec_id are vectors of their own and count each other if they are close; a
    row without vec_id counts as a vector, but gives no component its name
    (component_id is null where no member has one) and is not kept. Rows equal
    in all columns stay. An empty table gives an empty result. Columns other
    than the three, of any name, are not read.
    """
    given = numbered(rows.select("vec_id", "embedding", "label"), "vec_id", "covertree-rows")
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    fine = F.coalesce((F.size("embedding") > 0) & fine & (size > 0) & F.col("label").isNotNull(), F.lit(False))
    valid = given.where(fine).select("row", "vec_id", "label", F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
    copies = valid.groupBy("label", "dim", "vector").agg(F.min("row").alias("node"), F.count("*").alias("count"), F.min("vec_id").alias("low"))
    copies = materialize(copies, "covertree-copies")
    ship(rows.sparkSession)
    points = copies.select("label", "dim", F.lit("r").alias("path"), "node", "count", "vector", F.lit(2.0).alias("chord"))
    points, levels = _upper_levels(points, block)
    sized = points.groupBy(KEYS).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    dealt = points.join(sized, KEYS).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    keys = ", ".join(f"{c} {t}" for c, t in dealt.select(*KEYS, "chunk").dtypes)
    kind = points.schema["vector"].dataType.simpleString()
    schema = f"{keys}, centre array<double>, radius double, nodes binary, counts binary, vectors array<{kind}>"
    blocks = dealt.select(*KEYS, "chunk", *POINT).groupBy(*KEYS, "chunk").applyInArrow(_pack, schema)
    blocks = materialize(blocks.withColumn("name", F.concat_ws("#", "path", "chunk")), "covertree-blocks")
    pairs = _pairs(blocks, levels, threshold)
    other = pairs.where("p < q").select("label", "dim", F.col("q").alias("name"), "p", "q")
    partners = pairs.select("label", "dim", F.col("p").alias("name"), "p", "q").unionByName(other)
    met = blocks.select("label", "dim", "name", "nodes", "counts", "vectors").join(partners, ["label", "dim", "name"])
    found = met.groupBy("label", "dim", "p", "q").applyInArrow(_links(threshold), "a long, b long, n long")
    found = materialize(found, "covertree-links")
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    classes = components(found.where("b is not null").select("a", "b"), "covertree-components")
    named = copies.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = materialize(named.join(linked, "node", "left").select("label", "dim", "vector", "class", "low", "count", "others"), "covertree-named")
    least = named.groupBy("class").agg(F.min("low").alias("component"))
    told = named.join(least, "class").select("label", "dim", "vector", "component", (F.col("count") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    told = valid.select("row", "label", "dim", "vector").join(told, ["label", "dim", "vector"]).select("row", "component", "n", F.lit(True).alias("valid"))
    out = given.select("row", "vec_id").join(told, "row", "left")
    out = out.withColumn("component_id", F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id")))
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
