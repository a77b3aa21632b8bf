"""Keyed state in event time: processors whose keys leave the state once the stream's clock has passed them.

The clock is the largest event time seen, that is the watermark plus ``lateness``.
Spark drops rows that are older than the watermark and counts them (see
``dropped``); younger ones always reach the processor, also those behind rows of
their key that were seen before: they come out with ``late`` set, so no row is
lost in silence. Idle keys are removed by timers in event time, not by a time to
live, which Spark measures in processing time and which a replay would change.

These jobs need the RocksDB state store; the functions here set it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "_ms"


def prepare(spark: SparkSession) -> None:
    """Set the state store that keyed processors need, and send the package along."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship(spark)


def clocked(stream: DataFrame, lateness: str) -> DataFrame:
    """``stream`` with its event time as a watermarked timestamp and in milliseconds."""
    prepare(stream.sparkSession)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn(CLOCK, F.unix_millis("ts"))


def milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00 UTC' + INTERVAL {interval}) AS BIGINT) AS ms").first()["ms"]


class _Timed(StatefulProcessor):
    """One timer per key, moved on with the key's rows. ``lateness_ms`` is how far the watermark trails the clock."""

    def __init__(self, lateness_ms: int):
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def wake(self, clock_ms: int) -> None:
        """Fire once the clock has reached ``clock_ms``."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(0, clock_ms - self.lateness_ms))

    def close(self) -> None:
        pass


class Previous(_Timed):
    """For each row the value that its key had before it; the key goes ``idle_ms`` after its last row."""

    def __init__(self, columns: list[str], value: str, carry: bool, idle_ms: int, lateness_ms: int):
        super().__init__(lateness_ms)
        self.columns, self.value, self.carry, self.idle_ms = columns, value, carry, idle_ms

    def open(self, handle):
        self.last = handle.getValueState("last", "value string, seq long, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, place, latest = self.last.get() if self.last.exists() else (None, None, None)
        told = Row(*self.columns, "before", "before_seq", "late")
        for row in sorted(rows, key=lambda r: (r[CLOCK], r["seq"])):
            if latest is not None and row[CLOCK] > latest + self.idle_ms:  # the timer may not have fired yet
                held = place = latest = None
            at = (row[CLOCK], row["seq"])
            late = latest is not None and at < (latest, place)
            yield told(*[row[c] for c in self.columns], held, place, late)
            v = row[self.value]
            if not late and (v is not None or not self.carry):
                held, place, latest = v, row["seq"], row[CLOCK]
        if latest is not None:
            self.last.update((held, place, latest))
            self.wake(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


def with_previous(
    stream: DataFrame, keys: list[str], value: str, carry: bool = False, idle: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Add before, before_seq and late to every row of ``stream`` (with ts and seq): the key's value before it, in order of (ts, seq).

    With ``carry`` a null value leaves the state as it is, so ``before`` is the
    last value that was set. One value and its place per key are kept and go
    once the clock is ``idle`` past the row that set it; a later row then counts
    as its key's first. A row behind the one that set the value is ``late``: it
    is told the present value and doesn't change it.
    """
    spark = stream.sparkSession
    rows = clocked(stream, lateness)
    schema = T.StructType(
        [
            *[f for f in rows.schema.fields if f.name != CLOCK],
            T.StructField("before", T.StringType()),
            T.StructField("before_seq", T.LongType()),
            T.StructField("late", T.BooleanType()),
        ]
    )
    columns = [c for c in rows.columns if c != CLOCK]
    step = Previous(columns, value, carry, milliseconds(spark, idle), milliseconds(spark, lateness))
    return rows.groupBy(*keys).transformWithState(step, schema, "append", "EventTime")


class FoldTurns(_Timed):
    """Records of one message: held as a list until the clock is ``gap_ms`` past the last one, then told as one turn.

    A closed turn leaves a mark for as long as rows of it can still come. Such
    rows come out alone, flagged, with their own tally, model and tools; a row
    that is younger than that begins a turn anew.
    """

    def __init__(self, counters: tuple[str, ...], gap_ms: int, lateness_ms: int):
        super().__init__(lateness_ms)
        self.counters, self.gap_ms = counters, gap_ms

    def open(self, handle):
        numbers = ", ".join(f"{c} long" for c in self.counters)
        self.records = handle.getListState("records", f"ms long, seq long, model string, {numbers}, tools array<string>")
        self.closed = handle.getValueState("closed", "ended long")

    def _row(self, key, begun, head, tools, n, late):
        told = Row("session_id", "key", "begun_ms", "model", *self.counters, "tools", "records", "late")
        return told(key[0], key[1], begun, *head, tools, n, late)

    def _turn(self, key, held):
        return self._row(key, held[0][0], held[0][2:-1], [t for r in held for t in r[-1]], len(held), False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        ended = self.closed.get()[0] if self.closed.exists() else None
        last = max((r[0] for r in held), default=None)
        for r in sorted(((r[CLOCK], r["seq"], r["model"], *[r[c] for c in self.counters], r["tools"] or []) for r in rows), key=lambda r: r[:2]):
            if held and r[0] > last + self.gap_ms:  # the timer has not fired yet
                yield self._turn(key, sorted(held, key=lambda r: r[:2]))
                held, ended = [], last
            if ended is not None and r[0] > ended + self.gap_ms + self.lateness_ms:
                ended = None
            if ended is not None:
                yield self._row(key, r[0], r[2:-1], r[-1], 1, True)
            else:
                held.append(r)
                last = max(r[0], last) if len(held) > 1 else r[0]
        self._keep(held, ended)

    def _keep(self, held, ended) -> None:
        self.records.clear()
        self.closed.clear()
        if held:
            self.records.appendList(held)
            self.wake(max(r[0] for r in held) + self.gap_ms)
        elif ended is not None:
            self.closed.update((ended,))
            # past that no row of the turn can be younger than the watermark
            self.wake(ended + self.gap_ms + self.lateness_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.records.exists():
            self.closed.clear()
            return
        held = sorted((tuple(r) for r in self.records.get()), key=lambda r: r[:2])
        yield self._turn(key, held)
        self._keep([], held[-1][0])


def folded_turns(records: DataFrame, counters: tuple[str, ...], gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Turns of ``records`` (session_id, key, ts, seq, model, ``counters``, tools), folded by session and key.

    Tally and model are the earliest record's, tools of all are joined in order
    of (ts, seq). A turn comes out once the clock is ``gap`` past its last
    record, with late false and its number of records; a record that comes after
    that comes out alone, with late true.
    """
    spark = records.sparkSession
    rows = clocked(records.select("session_id", "key", "ts", "seq", "model", *counters, "tools"), lateness)
    numbers = ", ".join(f"{c} long" for c in counters)
    schema = f"session_id string, key string, begun_ms long, model string, {numbers}, tools array<string>, records int, late boolean"
    step = FoldTurns(counters, milliseconds(spark, gap), milliseconds(spark, lateness))
    out = rows.groupBy("session_id", "key").transformWithState(step, schema, "append", "EventTime")
    return out.withColumn("begun", F.timestamp_millis("begun_ms")).drop("begun_ms")


class LiveTotals(_Timed):
    """Running totals of a session; after ``idle_ms`` without a turn a last row with ``ended`` and the session goes."""

    def __init__(self, split_at: int, idle_ms: int, lateness_ms: int):
        super().__init__(lateness_ms)
        self.split_at, self.idle_ms = split_at, idle_ms

    def open(self, handle):
        self.total = handle.getValueState("total", "input long, output long, turns long, turn long, context long, ms long")

    def _row(self, key, total, ended):
        told = Row("session_id", "input", "output", "turns", "context", "split", "ended")
        return told(key[0], total[0], total[1], total[2], total[4], total[4] > self.split_at, ended)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given, out, n, turn, context, ms = self.total.get() if self.total.exists() else (0, 0, 0, None, 0, 0)
        for r in rows:
            given, out, n, ms = given + (r["input"] or 0), out + (r["output"] or 0), n + 1, max(ms, r[CLOCK])
            if turn is None or r["turn"] >= turn:
                turn, context = r["turn"], (r["input"] or 0) + (r["cache_read"] or 0)
        total = (given, out, n, turn, context, ms)
        self.total.update(total)
        self.wake(ms + self.idle_ms)
        yield self._row(key, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total = self.total.get()
        self.total.clear()
        yield self._row(key, total, True)


def live_totals(turns: DataFrame, split_at: int = 120_000, idle: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """After each micro-batch the totals of the sessions in it, and whether their last turn's context calls for a split.

    ``turns``: session_id, ts, turn, input, output, cache_read. Update mode. A session's last row has ``ended``.
    """
    spark = turns.sparkSession
    rows = clocked(turns.select("session_id", "ts", "turn", "input", "output", "cache_read"), lateness)
    schema = "session_id string, input long, output long, turns long, context long, split boolean, ended boolean"
    step = LiveTotals(split_at, milliseconds(spark, idle), milliseconds(spark, lateness))
    return rows.groupBy("session_id").transformWithState(step, schema, "update", "EventTime")
