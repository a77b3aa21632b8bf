"""The pipeline's stages against brute force, stage by stage."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from test_operators import WORD, brute_classes, brute_hits

import corpus_pipeline as pipeline
from tallyworks.llm import queries, toxicity
from tallyworks.llm.common import materialize


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]

    kept = materialize(stages["toxicity"](spark, docs, sf), "t")
    model = toxicity.fit_on(docs, queries.training_labels(spark, sf))
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in score.items() if s < 0.5}

    one = materialize(stages["near_dedup"](spark, kept, sf), "t")
    classes = brute_classes({r.doc_id: r.text for r in kept.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, c in classes.items() if d == c)

    clean = materialize(stages["decontamination"](spark, one, sf), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in one.collect()}
    hits = brute_hits(rows.items(), items)
    assert {r.doc_id for r in clean.collect()} == {d for d in rows if not hits[d][1]}

    mixed = materialize(stages["mixing"](spark, clean, sf), "t")
    assert kept.columns == one.columns == clean.columns == mixed.columns == docs.columns
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in clean.collect()}
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())

    t = Tokenizer.from_file(queries.tokenizer_path())
    sums = sorted((r.doc_id, zlib.crc32(np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed.collect())
    got = stages["token_ids"](spark, mixed, sf).orderBy("start").collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sums
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_rows_without_or_with_shared_ids(spark, sf):
    """A row is judged by its own text, whatever other rows share its id or have none."""
    leak = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    one, two, other = (" ".join(f"{p}{i}" for i in range(60)) for p in ("one", "two", "other"))
    stages = dict(pipeline.STAGES)

    def texts(stage, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return sorted((r.doc_id or 0, r.text) for r in stages[stage](spark, df, sf).collect())

    got = texts("decontamination", [(None, leak, "a"), (None, one, "a"), (5, leak, "a"), (5, two, "a"), (6, other, "a")])
    assert got == sorted([(0, one), (5, two), (6, other)])
    got = texts("near_dedup", [(5, one, "a"), (5, two, "a"), (8, one, "a"), (9, two, "a"), (None, other, "a"), (None, other, "b")])
    assert got == sorted([(5, one), (5, two), (0, other)])


def test_stages_take_odd_rows(spark, sf):
    """Null, empty, repeated and long rows and columns named like the operators' own: no stage fails, columns stay."""
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(1, None, None, "x"), (2, "", "a", "x"), (3, long, "a", "x"), (3, long, "a", "x"), (None, "one two three four five six", "b", "y"), (4, "\n \t", None, None)]
    schema = "doc_id long, text string, source string, row string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS size", "2 AS doc", "3 AS class_id", "'k' AS rank", "0.5 AS score")
    counts = {"toxicity": 6, "near_dedup": 5, "decontamination": 6}
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, sf)
        assert name == "token_ids" or out.columns == df.columns
        got = out.collect()
        assert len(got) == counts.get(name, len(got))
        if name == "mixing":
            assert {r.doc_id for r in got} <= {3, None} and {(r.size, r.doc, r.class_id, r["rank"]) for r in got} == {(1, 2, 3, "k")}
        assert stage(spark, df.where("false"), sf).count() == 0


def test_workers_give_freed_memory_back(spark):
    """A worker that has held a large batch keeps little of it while it waits for its next task."""
    from tallyworks.llm.common import map_arrow

    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def first(batches):
        import pyarrow as pa

        for _ in batches:
            texts = [b"x" * 1000 * (i % 7 + 1) for i in range(40_000)]
            column = pa.array(texts)
            yield pa.RecordBatch.from_pydict({"pid": [__import__("os").getpid()], "n": [held()]})
            del texts, column

    def later(batches):
        import pyarrow as pa

        now = held()
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [__import__("os").getpid()], "n": [now]})

    one = spark.range(1).coalesce(1)
    before = map_arrow(one, first, "pid long, n long").collect()[0]
    after = [r for _ in range(8) for r in map_arrow(one, later, "pid long, n long").collect() if r.pid == before.pid]
    assert before.n > 250e6 and after and min(r.n for r in after) < before.n - 200e6
