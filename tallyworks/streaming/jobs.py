"""Structured Streaming forms of the live paths.

Jobs that need the row before keep one value per key as state (``keyed``). Rows
of a micro-batch are put in order by (ts, seq) first, so a stream equals its
batch form if its input arrives in order across micro-batches; a row that comes
after a later one of its key was already seen is passed on with ``late`` set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distill, mining, sections
from ..sources import transcripts
from . import keyed

def delta_serves(serves: DataFrame, idle: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Live form of distill.delta_serves: full, unchanged or diff by the content hash served before."""
    hashed = serves.withColumn("hash", F.sha2("content", 256))
    seen = keyed.with_previous(hashed, ["session_id", "path"], "hash", idle=idle, lateness=lateness)
    mode = F.when(F.col("before").isNull(), "full").when(F.col("before") == F.col("hash"), "unchanged").otherwise("diff")
    ref = F.concat(F.lit("F"), F.substring(F.sha2("path", 256), 1, 4), F.lit("@"), F.substring("hash", 1, 16))
    return seen.select("session_id", "path", "seq", mode.alias("mode"), ref.alias("ref"), "late")


def error_fix_pairs(audit: DataFrame, idle: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Live pairs of a fail and the pass after it, per session and profile."""
    verdicts = audit.where(F.col("verdict").isNotNull()).select("session_id", "profile", "ts", "seq", "verdict")
    seen = keyed.with_previous(verdicts, ["session_id", "profile"], "verdict", idle=idle, lateness=lateness)
    pairs = seen.where((F.col("verdict") == "pass") & (F.col("before") == "fail"))
    return pairs.select("session_id", "profile", F.col("before_seq").alias("fail_seq"), F.col("seq").alias("pass_seq"), "late")


def attributed_events(events: DataFrame, idle: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Session of each event: ``events`` has repo, ts, seq, registered (a session id on registrations, else null) and provided."""
    seen = keyed.with_previous(events, ["repo"], "registered", carry=True, idle=idle, lateness=lateness)
    return seen.where(F.col("registered").isNull()).select(
        "repo", "seq", F.coalesce("before", "provided", F.lit("unknown")).alias("session_id"), "late"
    )


def redacted(artifacts: DataFrame) -> DataFrame:
    """Stateless redaction of a stream of texts."""
    return distill.redact(artifacts)


def session_windows(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without an event, for sources that send no end event."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = marked.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select("session_id", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "events")


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there and stop; ``sink`` gets every micro-batch and its number, so it can write idempotently."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to a folder of its own number, so that a repeated one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _parsed(lines: DataFrame) -> DataFrame:
    """Transcript lines (``value``, seq) with what an assistant record needs, and why a line is none."""
    r = lines.select("seq", "value", F.try_parse_json("value").alias("r"))
    get = lambda path, kind="string": F.try_variant_get("r", path, kind)
    blocks = F.coalesce(get("$.message.content", "array<struct<type:string,name:string>>"), F.array())
    tools = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), lambda b: b["name"])
    rows = r.select(
        "seq",
        "value",
        get("$.type").alias("type"),
        get("$.sessionId").alias("session_id"),
        # a record without an id is a turn of its own
        F.coalesce(get("$.message.id"), get("$.uuid"), F.concat(F.lit("line-"), F.sha2("value", 256))).alias("key"),
        F.try_to_timestamp(get("$.timestamp")).alias("ts"),
        F.coalesce(get("$.message.model"), F.lit("unknown-model")).alias("model"),
        F.try_variant_get("r", "$.message.usage", "variant").alias("usage"),
        tools.alias("tools"),
    )
    reason = (
        F.when(F.col("type").isNull(), "malformed")
        .when(~F.col("type").isin(*transcripts.KNOWN_TYPES), "unknown type")
        .when((F.col("type") == "assistant") & F.col("session_id").isNull(), "no session")
        .when((F.col("type") == "assistant") & F.col("ts").isNull(), "no time")
    )
    return rows.withColumn("reason", reason)


def transcript_records(lines: DataFrame) -> DataFrame:
    """Assistant records of a stream of transcript lines (``value``, seq): session_id, key, ts, seq, model, counters, tools.

    Lines that can't be folded are told by ``rejected_lines``.
    """
    rows = _parsed(lines).where("type = 'assistant' AND reason IS NULL")
    return transcripts.tally(rows).drop("usage", "value", "type", "reason")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(seq, value, reason) of the lines that no turn can be made of: malformed, unknown type, no session, no time."""
    return _parsed(lines).where("reason IS NOT NULL").select("seq", "value", "reason")


COUNTERS = ("input", "output", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "cache_write_assumed", "thinking")


def folded_turns(records: DataFrame, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Live form of turn folding, by session and key; see ``keyed.folded_turns``."""
    return keyed.folded_turns(records, COUNTERS, gap, lateness)


def live_totals(turns: DataFrame, split_at: int = 120_000, idle: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """Running totals per session and whether its last turn's context calls for a split; see ``keyed.live_totals``."""
    return keyed.live_totals(turns, split_at, idle, lateness)


def _latest(spark, path: str, before: int) -> str | None:
    """The folder of the newest version under ``path`` that is older than ``before``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.getPath().getName().startswith("version=")]
    older = [v for v in found if v < before]
    return f"{path}/version={max(older)}" if older else None


def _keep(spark, path: str, number: int, versions: int = 3) -> None:
    """Delete versions of a snapshot that no repeated micro-batch can read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("version=") and int(name.split("=")[1]) <= number - versions:
            fs.delete(x.getPath(), True)


def session_end_mining(audit: Callable[[DataFrame], DataFrame], artifacts: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that mines the sessions that end in a micro-batch (rows with action session-end) and merges them into the candidates.

    ``audit`` gives the stored audit rows of the sessions it is handed
    (session_id), ``artifacts`` the artifact table. Error-fix pairs, hotspots and
    recurrences of earlier records are mined. A micro-batch reads its own
    sessions and the newest snapshot of the state before it and writes
    ``path/candidates/version=N`` and ``path/runs/batch=N`` (mined, merged,
    skipped): a repeated one gives the same snapshot, and the cost of one doesn't
    grow with their number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ended = batch.where("action = 'session-end'").select("session_id").distinct()
        at = _latest(spark, f"{path}/candidates", number)
        prior = spark.createDataFrame([], mining.STATE) if at is None else spark.read.schema(mining.STATE).parquet(at)
        # records as of these sessions: the state before them; a session's own records have the session in them
        text = F.concat_ws("\n", "key", "signature", "details")
        records = prior.select("id", text.alias("text"), F.get("sessions", F.size("sessions") - 1).alias("session_id"), F.lit(-1).cast("long").alias("made"), F.lit(None).cast("long").alias("until"))
        mined = mining.mined_candidates(audit(ended), artifacts(), records)
        state, counts = mining.merge_mined(prior, mined)
        state.write.mode("overwrite").parquet(f"{path}/candidates/version={number}")
        counts.write.mode("overwrite").parquet(f"{path}/runs/batch={number}")
        _keep(spark, f"{path}/candidates", number)

    return write


FILES = "path string, hash string, detector int, stamp long"


def file_refresh(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for change events (path, seq, hash, detector; hash null: the file is gone) that keeps an index of files.

    A micro-batch is reduced to the last event of every path and merged into the
    newest snapshot before it: ``path/files/version=N``. Each path's status
    (added, changed, unchanged or removed) is written to ``path/status/batch=N``.
    An unchanged file keeps the stamp of the batch that last changed it. A
    micro-batch reads one snapshot and itself, whatever came before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max_by(F.struct("hash", "detector"), "seq").alias("f")).select("path", "f.*")
        at = _latest(spark, f"{path}/files", number)
        prior = spark.createDataFrame([], FILES) if at is None else spark.read.schema(FILES).parquet(at)
        touched = prior.join(last.select("path"), "path", "left_semi")
        done = sections.ingest(last.where("hash IS NOT NULL"), touched, F.lit(number).cast("long"))
        done.select("path", "status").write.mode("overwrite").parquet(f"{path}/status/batch={number}")
        kept = prior.join(last.select("path"), "path", "left_anti")
        kept.unionByName(done.where("status <> 'removed'").select("path", "hash", "detector", "stamp")).write.mode("overwrite").parquet(f"{path}/files/version={number}")
        _keep(spark, f"{path}/files", number)

    return write


def current_files(spark, path: str) -> DataFrame:
    """(path, hash, detector, stamp) of the newest snapshot that ``file_refresh`` has written to ``path``."""
    at = _latest(spark, f"{path}/files", 1 << 62)
    return spark.createDataFrame([], FILES) if at is None else spark.read.schema(FILES).parquet(at)
