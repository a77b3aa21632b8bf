"""Streams over files equal their batch forms."""

from __future__ import annotations

import json
import tempfile
import time

from pyspark.sql import functions as F
from tallyworks.operators import distill
from tallyworks.plans.views import view
from tallyworks.streaming import dropped, jobs


def streamed(spark, df, job, mode="append"):
    """Write ``df`` as three files in order, stream them one per micro-batch, and return what comes out."""
    root = tempfile.mkdtemp(prefix="spark-")
    cut = df.selectExpr("percentile(seq, array(0.33, 0.66)) AS c").first()["c"]
    parts = [df.where(F.col("seq") <= cut[0]), df.where((F.col("seq") > cut[0]) & (F.col("seq") <= cut[1])), df.where(F.col("seq") > cut[1])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.run_once(job(stream), f"{root}/state", jobs.parquet_sink(f"{root}/out"), mode)
    return spark.read.parquet(f"{root}/out").drop("batch")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_delta_serves(spark, sf):
    serves = view(spark, sf, "v_serves").where("seq < 400")
    got = streamed(spark, serves, lambda d: jobs.delta_serves(d, idle="60 days"))
    assert rows(got, "session_id", "path", "seq", "mode", "ref") == rows(distill.delta_serves(serves), "session_id", "path", "seq", "mode", "ref")
    assert got.where("late").count() == 0


def test_error_fix_pairs(spark, sf):
    from tallyworks.operators import mining

    audit = view(spark, sf, "v_audit").where("seq < 600")
    got = streamed(spark, audit, lambda d: jobs.error_fix_pairs(d, idle="60 days"))
    columns = ("session_id", "profile", "fail_seq", "pass_seq")
    assert rows(got, *columns) == rows(mining.error_fix_pairs(audit), *columns)


def test_attribution(spark, sf):
    a = view(spark, sf, "v_audit").where("seq < 400").withColumn("repo", F.col("path"))
    registration = F.col("action") == "rewrite"
    events = a.select("repo", "ts", "seq", F.when(registration, F.col("session_id")).alias("registered"), F.when(F.col("seq") % 2 == 0, F.col("session_id")).alias("provided"))
    batch = distill.attributed_sessions(
        events.where("registered IS NULL"), events.where("registered IS NOT NULL").withColumn("session_id", F.col("registered"))
    )
    got = streamed(spark, events, lambda d: jobs.attributed_events(d, idle="60 days"))
    assert rows(got, "repo", "seq", "session_id") == rows(batch, "repo", "seq", "session_id")


def test_redaction(spark):
    df = spark.createDataFrame([(i, f"API_KEY=value{i}") for i in range(9)], "seq long, text string")
    got = streamed(spark, df, jobs.redacted)
    assert rows(got, "seq", "text") == rows(distill.redact(df), "seq", "text")


def in_batches(spark, batches, schema, job, mode="append"):
    """Each list of rows is a micro-batch; returns what comes out with its batch number."""
    root = tempfile.mkdtemp(prefix="spark-")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.run_once(job(stream), f"{root}/state", jobs.parquet_sink(f"{root}/out"), mode)
    return spark.read.parquet(f"{root}/out")


def record(session, key, second, tools, out=5, usage=True):
    content = [{"type": "tool_use", "name": t} for t in tools]
    message = {"id": key, "model": f"m{out}", "content": content} | ({"usage": {"input_tokens": 3, "output_tokens": out}} if usage else {})
    at = f"2024-01-{1 + second // 86400:02d}T{second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    return json.dumps({"type": "assistant", "sessionId": session, "timestamp": at, "message": message})


def test_folded_turns_equal_the_batch_form(spark):
    """Tool blocks of later micro-batches join their turn; far later records close all; each line is a turn or told as rejected."""
    from tallyworks.sources import transcripts

    values = [record("s", f"k{i % 7}", 20 * i, ["Read"] if i % 3 else [], out=i) for i in range(40)] + [record("t", "k1", 900, ["Bash"], usage=False), record("t", None, 950, [])]
    bad = ["{bad", "[1]", '{"type":"odd"}', '{"type":"user"}', json.dumps({"type": "assistant", "sessionId": "s", "message": {"id": "x"}}), record(None, "k", 5, [])]
    far = [record("z", "far", 200_000, [])]
    lines = list(enumerate(values + bad + far))
    batches = [lines[:15], lines[15:44], lines[44:]]
    schema = "seq long, value string"
    got = in_batches(spark, batches, schema, lambda d: jobs.folded_turns(jobs.transcript_records(d), gap="30 minutes"))
    assert got.where("late").count() == 0
    df = spark.createDataFrame([(r[1].split('"sessionId": "')[1][0], *r) for r in lines if "assistant" in r[1] and '"timestamp"' in r[1] and '"sessionId": "' in r[1]], "file string, line_no long, value string")
    batch = transcripts.fold_turns(transcripts.classify(df)).where("file <> 'z'")
    columns = ["model", "tools", *jobs.COUNTERS]
    mine, theirs = got.withColumn("file", F.col("session_id")), batch
    assert sorted(map(str, mine.select("file", *columns).collect())) == sorted(map(str, theirs.select("file", *columns).collect()))
    assert got.agg(F.sum("records")).first()[0] == 42
    rejected = {r.seq: r.reason for r in jobs.rejected_lines(spark.createDataFrame(lines, schema)).collect()}
    assert list(rejected.values()) == ["malformed", "malformed", "unknown type", "no time", "no session"]


def test_closed_turns_flag_late_records_and_leave_state(spark):
    batches = [
        [(1, record("s", "a", 0, ["Read"])), (2, record("s", "b", 3_000, []))],
        [(3, record("s", "c", 3_100, []))],  # the clock is past the gap of a: it comes out
        [(4, record("s", "a", 300, ["Bash"], 9))],  # within an hour of the clock: told, flagged
        [(5, record("t", "d", 20_000, []))],
        [(9, record("t", "d", 20_001, ["Read"]))],  # rows are measured by the watermark of the micro-batch before
        [(6, record("s", "a", 5, ["Edit"], 9))],  # older than the watermark: dropped and counted
        [(7, record("s", "a", 19_000, ["Grep"]))],  # the mark of a has gone: a turn of its own
        [(8, record("t", "e", 190_000, []))],
    ]
    path = tempfile.mkdtemp(prefix="spark-")
    watching = dropped.watch(spark, path)
    got = in_batches(spark, batches, "seq long, value string", lambda d: jobs.folded_turns(jobs.transcript_records(d)))
    found = sorted((r.session_id, r.key, r.tools, r.late, r.records) for r in got.collect())
    watching.drain()
    spark.streams.removeListener(watching)
    assert found == [
        ("s", "a", ["Bash"], True, 1), ("s", "a", ["Grep"], False, 1), ("s", "a", ["Read"], False, 1), ("s", "b", [], False, 1), ("s", "c", [], False, 1), ("t", "d", ["Read"], False, 2)
    ]
    told = dropped.dropped_rows(spark, path).collect()
    assert len(told) == 1 and told[0].rows_dropped == 1


def test_idle_keys_leave_state(spark):
    """After ``idle`` a key's next row is its first; a row behind the state's is flagged; one behind the watermark is dropped."""
    at = lambda hours: f"2024-01-01 {hours // 60:02d}:{hours % 60:02d}:00"
    batches = [
        [("s", "p", at(0), 1, "one"), ("s", "q", at(10), 2, "x")],
        [("s", "p", at(20), 4, "one"), ("s", "p", at(15), 3, "two")],
        [("s", "p", at(18), 5, "three")],
        [("t", "r", at(400), 6, "z")],
        [("s", "p", at(390), 7, "one")],
    ]
    schema = "session_id string, path string, ts string, seq long, content string"
    got = in_batches(spark, batches, schema, lambda d: jobs.delta_serves(d, idle="2 hours", lateness="30 minutes"))
    assert {(r.seq, r["mode"], r.late) for r in got.collect()} == {
        (1, "full", False), (2, "full", False), (3, "diff", False), (4, "diff", False), (5, "diff", True), (6, "full", False), (7, "full", False)
    }


def test_live_totals_end_sessions(spark):
    turns = [
        [("s", "2024-01-01 00:00:00", 1, 130_000, 1, 0), ("t", "2024-01-01 00:00:10", 1, 1, 3, 0)],
        [("s", "2024-01-01 00:01:00", 2, 10, 2, 5), ("t", "2024-01-01 00:02:00", 2, 100_000, 4, 30_000)],
        [("u", "2024-01-02 00:00:00", 1, 1, 1, 1)],
    ]
    got = in_batches(spark, turns, "session_id string, ts string, turn int, input long, output long, cache_read long", jobs.live_totals, "update")
    ended = {r.session_id: (r.input, r.output, r.turns, r.context, r.split) for r in got.where("ended").collect()}
    assert ended == {"s": (130_010, 3, 2, 15, False), "t": (100_001, 7, 2, 130_000, True)}
    assert got.where("session_id = 's' AND NOT ended AND turns = 1 AND split").count() == 1


def test_session_end_mining(spark, sf):
    """Sessions that end in two micro-batches, the second one repeated, give the state of one merge after another."""
    from tallyworks.operators import mining
    from tallyworks.plans.mining import _artifacts

    audit, art = view(spark, sf, "v_audit").where("seq < 600"), _artifacts(spark, sf)
    path = tempfile.mkdtemp(prefix="spark-")
    sink = jobs.session_end_mining(lambda ended: audit.join(ended, "session_id", "left_semi"), lambda: art, path)
    ends = [r.session_id for r in audit.select("session_id").distinct().orderBy("session_id").collect()]
    for number, part in ((0, ends[::2]), (1, ends[1::2]), (1, ends[1::2]), (2, ends[1::2])):
        sink(spark.createDataFrame([(e, "session-end") for e in part], "session_id string, action string"), number)
    one = spark.read.parquet(f"{path}/candidates/version=1")
    kinds = {r.type: r.n for r in one.groupBy("type").agg(F.sum("occurrences").alias("n")).collect()}
    whole = mining.merge_mined(spark.createDataFrame([], mining.STATE), mining.mined_candidates(audit, art))[0]
    assert rows(one.where("type <> 'recurrence'"), "id", "occurrences") == rows(whole, "id", "occurrences")
    assert set(kinds) == {"error-fix", "zoom-hotspot", "recurrence"}
    # sessions that end once more add nothing, whatever they recur in now
    again = spark.read.parquet(f"{path}/runs/batch=2").first()
    assert again.skipped > 0 and rows(spark.read.parquet(f"{path}/candidates/version=2").where("type <> 'recurrence'"), "id", "occurrences") == rows(whole, "id", "occurrences")


def test_file_refresh(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    sink = jobs.file_refresh(path)
    schema = "path string, seq long, hash string, detector int"
    first = spark.createDataFrame([("a", 1, "h0", 1), ("a", 2, "h1", 1), ("b", 3, "h", 1), ("c", 4, "h", 1)], schema)
    second = spark.createDataFrame([("a", 5, "h1", 1), ("b", 6, "h", 2), ("c", 7, None, None), ("d", 8, "h", 1), ("e", 9, None, None)], schema)
    for number, batch in ((0, first), (1, second), (1, second)):
        sink(batch, number)
    got = {x.path: x.status for x in spark.read.parquet(f"{path}/status/batch=1").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert sorted((x.path, x.stamp) for x in jobs.current_files(spark, path).collect()) == [("a", 0), ("b", 1), ("d", 1)]
    for number in range(2, 7):
        sink(spark.createDataFrame([(f"n{number}", 10, "h", 1)], schema), number)
    import os

    assert sorted(os.listdir(f"{path}/files")) == ["version=4", "version=5", "version=6"]  # what a batch reads doesn't grow
    assert jobs.current_files(spark, path).count() == 8


def test_session_windows(spark):
    times = [(1, "s", "2024-01-01 00:00:00"), (2, "s", "2024-01-01 00:20:00"), (3, "s", "2024-01-01 02:00:00"), (4, "t", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(times, "seq long, session_id string, ts string")
    got = streamed(spark, df, jobs.session_windows)
    assert sorted((x.session_id, x.events) for x in got.collect()) == [("s", 1), ("s", 2)]


def test_late_rows_of_windows_are_counted(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    watching = dropped.watch(spark, path)
    batches = [[(1, "s", "2024-01-01 00:00:00")], [(2, "s", "2024-01-02 00:00:00")], [(5, "u", "2024-01-02 00:00:01")], [(3, "s", "2024-01-01 01:00:00")], [(4, "t", "2024-01-03 00:00:00")]]
    in_batches(spark, batches, "seq long, session_id string, ts string", jobs.session_windows)
    watching.drain()
    spark.streams.removeListener(watching)
    assert [r.rows_dropped for r in dropped.dropped_rows(spark, path).collect()] == [1]
