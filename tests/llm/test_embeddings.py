"""Near-duplicate embeddings against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from tallyworks.llm.embeddings import Tree, near_embeddings, traverse

SCHEMA = "vec_id long, embedding array<float>, label int, row long, path string, node long"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    by, links, root = {}, [0] * len(rows), list(range(len(rows)))
    for i, (_, e, label, *_) in enumerate(rows):
        v = np.array([np.nan if x is None else x for x in e or []], float)
        if label is not None and len(v) and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            by.setdefault((label, len(v)), []).append((i, v / np.sqrt((v * v).sum())))
    for group in by.values():
        at, u = [i for i, _ in group], np.array([v for _, v in group])
        near = u @ u.T >= threshold
        for x, i in enumerate(at):
            links[i] = int(near[x].sum()) - 1
            for y in np.flatnonzero(near[x]):
                old, new = root[at[y]], root[i]
                if old != new:
                    root = [new if r == old else r for r in root]
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[root[i]] = min(least.get(root[i], v), v)
    return sorted(((v, links[i], least.get(root[i]), v is not None and v == least[root[i]]) for i, (v, *_) in enumerate(rows)), key=str)


def found(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_embeddings(df, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def clustered():
    """Clusters of many widths, one with a third of all rows, chains, copies, scaled copies, over two labels and two lengths."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(24):
        centre = draw.normal(size=8)
        for _ in range(120 if k == 0 else 10):
            rows.append((centre + draw.normal(size=8) * (0.02, 0.15, 0.4)[k % 3], k % 2))
    a, b = draw.normal(size=8), draw.normal(size=8)
    rows += [(a * np.cos(t) + b * np.sin(t), 0) for t in np.arange(0, 1.2, 0.2)]
    rows += [rows[3], rows[3], (rows[3][0] * 7, rows[3][1]), (a[:5], 0), (a[:5] * 2, 0)]
    order = draw.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[j][0]], rows[j][1], 0, "p", 1) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [4096, 40, 8])
def test_clusters_equal_brute_force(spark, clustered, block):
    want = brute(clustered)
    assert sum(n for _, n, _, _ in want) > 1000
    assert found(spark.createDataFrame(clustered, SCHEMA).repartition(5), block=block) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [1.0, inf], 0), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [1.0, 0.1], 0), (None, [0.0, 1.0], 0), (10, [1.0, 0.0, 0.0], 0),
        (11, [1.0, 0.0], 1), (12, [-1.0, 0.0], 0), (13, [1e-38, 0.0], 0), (14, [3e38, 1e30], 0), (None, None, None),
    ]
    rows = [(*r, 1, "p", 2) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    assert got == brute(rows)
    assert (7, 0, 7, True) in got and (9, 5, 8, False) in got and (None, 0, None, False) in got and (None, 5, 8, False) in got
    assert near_embeddings(df.where("false")).collect() == []


def test_whole_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert found(df) == brute(rows)
    assert found(df, block=32, threshold=0.3) == brute(rows, 0.3)


def test_bounds_prune_without_loss():
    """Of clusters apart from each other only the pairs within clusters are looked at."""
    draw = np.random.default_rng(1)
    points = np.repeat(np.eye(40), 25, 0) + draw.normal(size=(1000, 40)) * 0.01
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = Tree(points)
    seen = sum(hits.size for *_, hits in traverse(tree, tree, 0.93))
    hit = sum(int(hits.sum()) for *_, hits in traverse(tree, tree, 0.93))
    assert hit == int((points @ points.T >= 0.93).sum()) == 40 * 25 * 25
    assert seen <= 2 * hit
    for node in range(len(tree.radius)):
        held = tree.points[tree.first[node] : tree.last[node]]
        assert np.sqrt(np.maximum(2 - 2 * held @ tree.centres[node], 0)).max() <= tree.radius[node] + 1e-7
        kids = slice(tree.child[node], tree.child[node] + tree.children[node])
        if tree.child[node] >= 0:
            apart = np.linalg.norm(tree.centres[kids][:, None] - tree.centres[kids], axis=2) + 9 * np.eye(tree.children[node])
            assert apart.min() > tree.radius[node] / 2 - 1e-7
            assert (tree.centres[kids][0] == tree.centres[node]).all()
