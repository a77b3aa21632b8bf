"""Queries of the corpus ledger, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import ledger as l
from .registry import Registry, rounded
from .views import duckdb, view

R = Registry()
add = R.add
_TOK = "CAST(floor({} / 4.0 + 0.5) AS BIGINT)"
_DONE = f"""done AS (SELECT v.*, {_TOK.format('raw_bytes')} AS raw_tokens, {_TOK.format('served_bytes')} AS served_tokens,
 CAST(greatest(0, {_TOK.format('raw_bytes')} - {_TOK.format('served_bytes')}) AS BIGINT) AS avoided_tokens FROM v_ledger v),
full_lines AS (SELECT d.*, avoided_tokens / 1e6 * p_in AS cost, avoided_tokens / 1e6 * wh_base AS base, avoided_tokens / 1e6 * wh_low AS low, avoided_tokens / 1e6 * wh_high AS high
 FROM done d, prices p, energy e WHERE p.model = 'm-large' AND e.model = 'm-large')"""
_L = duckdb("v_ledger", "prices", "energy") + ", " + _DONE
_SUMS = "CAST(coalesce(sum(raw_tokens) FILTER (WHERE kind <> 'ask'), 0) AS BIGINT) AS raw_tokens, CAST(coalesce(sum(served_tokens) FILTER (WHERE kind <> 'ask'), 0) AS BIGINT) AS served_tokens, CAST(coalesce(sum(avoided_tokens) FILTER (WHERE kind <> 'ask'), 0) AS BIGINT) AS avoided_tokens"
_COST = "round(coalesce(sum(cost) FILTER (WHERE kind <> 'ask'), 0), 6) AS cost"


def lines(spark, sf_dir):
    rate = l.reference_rate(dims.frame(spark, "prices"), dims.frame(spark, "energy"), "m-large")
    return l.complete_lines(view(spark, sf_dir, "v_ledger"), rate)


@add("l01_complete_lines", _L + " SELECT id, raw_tokens, served_tokens, avoided_tokens, round(cost, 6) AS cost, round(base, 6) AS base, round(low, 6) AS low, round(high, 6) AS high FROM full_lines")
def l01(spark, sf_dir):
    return rounded(lines(spark, sf_dir).select("id", "raw_tokens", "served_tokens", "avoided_tokens", "cost", "base", "low", "high"))


_ASKS = "asks AS (SELECT DISTINCT session_id AS ask_id FROM v_audit)"


@add(
    "l02_lines_of_asks",
    duckdb("v_audit")
    + f""", {_ASKS} SELECT session_id AS ask_id, 'serve' AS kind, bytes_in AS raw_bytes, bytes_out AS served_bytes, coalesce(profile, module) AS label FROM v_audit WHERE bytes_in IS NOT NULL AND bytes_out IS NOT NULL
 UNION ALL SELECT session_id, 'ask', CAST(coalesce(sum(bytes_in), 0) AS BIGINT), CAST(100 AS BIGINT), NULL FROM v_audit GROUP BY session_id""",
)
def l02(spark, sf_dir):
    """Each session's audit events as one ask of 100 served bytes."""
    a = view(spark, sf_dir, "v_audit").withColumn("ask_id", F.col("session_id"))
    asks = a.groupBy("ask_id").agg(F.max("ts").alias("ts")).select(
        "ask_id", F.lit("corpus").alias("corpus"), F.col("ask_id").alias("session_id"), "ts", F.lit(100).cast("long").alias("served_bytes"), F.lit("high").alias("confidence")
    )
    events = a.select("ask_id", "id", "bytes_in", "bytes_out", "profile", "module")
    return l.lines_of_asks(events, asks).select("ask_id", "kind", "raw_bytes", "served_bytes", "label")


@add(
    "l03_document_attribution",
    duckdb("v_audit")
    + ", art AS (SELECT input_ref AS artifact, min(path) AS path FROM v_audit WHERE seq % 2 = 0 GROUP BY input_ref)"
    + """, doc AS (SELECT input_ref AS artifact_id, max(path) AS path FROM v_audit GROUP BY input_ref)
 SELECT id, coalesce(art.path, doc.path) AS document FROM v_audit v LEFT JOIN art ON art.artifact = v.input_ref LEFT JOIN doc ON doc.artifact_id = v.input_ref""",
)
def l03(spark, sf_dir):
    a = view(spark, sf_dir, "v_audit")
    art = a.where("seq % 2 = 0").groupBy(F.col("input_ref").alias("artifact")).agg(F.min("path").alias("path"))
    doc = a.groupBy(F.col("input_ref").alias("artifact_id")).agg(F.max("path").alias("path"))
    return l.attributed(a.select("id", F.col("input_ref").alias("ref")), art, doc).select("id", "document")


_ROLL = " UNION ALL ".join(
    f"SELECT corpus, '{scope}' AS scope, {key} AS key, count(*) AS lines, count(*) FILTER (WHERE kind = 'ask') AS asks, count(*) FILTER (WHERE kind = 'zoom') AS zooms, count(*) FILTER (WHERE kind = 'serve') AS serves, count(DISTINCT session_id) AS sessions, {_SUMS}, {_COST} FROM full_lines WHERE {key} IS NOT NULL GROUP BY corpus{'' if key == chr(39) * 2 else ', ' + key}"
    for scope, key in (("session", "session_id"), ("day", "strftime(ts, '%Y-%m-%d')"), ("month", "strftime(ts, '%Y-%m')"), ("document", "document"), ("corpus", "''"))
)


@add("l04_rollup_totals", _L + " " + _ROLL)
def l04(spark, sf_dir):
    return rounded(l.rollup_totals(lines(spark, sf_dir)))


@add("l05_documents", _L + " SELECT corpus, document, count(*) AS reads, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(avoided_tokens) AS BIGINT) AS avoided_tokens, round(sum(cost), 6) AS cost FROM full_lines WHERE kind <> 'ask' AND document IS NOT NULL GROUP BY corpus, document")
def l05(spark, sf_dir):
    return rounded(l.documents_rollup(lines(spark, sf_dir)))


@add("l06_sessions", _L + f" SELECT corpus, session_id, count(*) FILTER (WHERE kind = 'ask') AS asks, CAST(coalesce(sum(avoided_tokens) FILTER (WHERE kind <> 'ask'), 0) AS BIGINT) AS avoided_tokens, {_COST} FROM full_lines GROUP BY corpus, session_id")
def l06(spark, sf_dir):
    return rounded(l.sessions_rollup(lines(spark, sf_dir)))


@add("l07_asks_by_confidence", _L + " SELECT corpus, " + ", ".join(f"count(*) FILTER (WHERE confidence = '{b}') AS {b}" for b in ("high", "medium", "low")) + ", count(*) FILTER (WHERE confidence IS NULL) AS unrated FROM full_lines WHERE kind = 'ask' GROUP BY corpus")
def l07(spark, sf_dir):
    return l.asks_by_confidence(lines(spark, sf_dir))


@add("l08_top_serves", _L + " SELECT corpus, CAST(rank AS INT) AS rank, id, avoided_tokens FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY avoided_tokens DESC, seq) AS rank FROM full_lines WHERE kind = 'serve') x WHERE rank <= 3")
def l08(spark, sf_dir):
    return l.top_serves(lines(spark, sf_dir))


_MONTH = "2024-01"
_RES = "res AS (SELECT corpus, CAST(floor(sum(raw_bytes) / 4.0 + 0.5) AS BIGINT) AS resident_tokens FROM (SELECT *, row_number() OVER (PARTITION BY corpus, coalesce(document, id) ORDER BY ts DESC, id DESC) AS r FROM full_lines) x WHERE r = 1 GROUP BY corpus)"


def _resident(spark, sf_dir):
    arts = lines(spark, sf_dir).select("corpus", "id", "ts", "raw_bytes", F.col("document").alias("path"))
    return l.resident_bytes(arts)


def _top(key: str, kind: str) -> str:
    return f"SELECT corpus, '{kind}' AS kind, CAST(rank AS INT) AS rank, {key} AS key, tokens FROM (SELECT corpus, {key}, CAST(sum(avoided_tokens) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY corpus ORDER BY sum(avoided_tokens) DESC, {key}) AS rank FROM mine WHERE kind <> 'ask' GROUP BY corpus, {key}) x WHERE rank <= 5"


@add(
    "l09_statement",
    _L
    + f""", {_RES}, mine AS (SELECT * FROM full_lines WHERE strftime(ts, '%Y-%m') = '{_MONTH}')
 SELECT corpus, 'total' AS kind, 0 AS rank, '{_MONTH}' AS key, CAST(coalesce(sum(avoided_tokens) FILTER (WHERE kind <> 'ask'), 0) AS BIGINT) AS tokens FROM mine GROUP BY corpus
 UNION ALL {_top('document', 'document')} UNION ALL {_top('session_id', 'session')}
 UNION ALL SELECT corpus, 'resident', 0, '', resident_tokens FROM res WHERE corpus IN (SELECT corpus FROM mine)""",
)
def l09(spark, sf_dir):
    resident = _resident(spark, sf_dir).select("corpus", F.floor(F.col("resident_bytes") / 4.0 + 0.5).cast("long").alias("resident_tokens"))
    return l.statement(lines(spark, sf_dir), _MONTH, resident)


@add("l10_receipts", _L + f" SELECT corpus, count(*) FILTER (WHERE kind = 'ask') AS asks, {_SUMS}, {_COST} FROM full_lines GROUP BY corpus")
def l10(spark, sf_dir):
    return rounded(l.receipts(lines(spark, sf_dir)))


@add(
    "l11_reconciliation",
    _L.replace("WITH ", duckdb("v_audit") + ", ", 1)
    + """ SELECT audit_id, issue FROM (SELECT coalesce(x.audit_id, a.id) AS audit_id, CASE WHEN x.audit_id IS NULL THEN 'no ledger line' WHEN a.id IS NULL THEN 'no audit event'
 WHEN x.raw_bytes IS DISTINCT FROM a.bytes_in OR x.served_bytes IS DISTINCT FROM a.bytes_out THEN 'bytes differ' END AS issue FROM (SELECT * FROM full_lines WHERE seq % 3 > 0) x FULL JOIN (SELECT * FROM v_audit WHERE seq % 5 > 0) a ON a.id = x.audit_id) y WHERE issue IS NOT NULL""",
)
def l11(spark, sf_dir):
    """Every third ledger line and every fifth audit event is left out, so that each kind of issue occurs."""
    return l.reconcile(lines(spark, sf_dir).where("seq % 3 > 0"), view(spark, sf_dir, "v_audit").where("seq % 5 > 0"))


@add("l12_resident_size", _L + f", {_RES} SELECT r.corpus, resident_tokens, avoided_tokens FROM res r JOIN (SELECT corpus, CAST(sum(avoided_tokens) FILTER (WHERE kind <> 'ask') AS BIGINT) AS avoided_tokens FROM full_lines GROUP BY corpus) t USING (corpus)")
def l12(spark, sf_dir):
    r = _resident(spark, sf_dir).select("corpus", F.floor(F.col("resident_bytes") / 4.0 + 0.5).cast("long").alias("resident_tokens"))
    return r.join(l.receipts(lines(spark, sf_dir)).select("corpus", "avoided_tokens"), "corpus")


@add("a30_resident_bytes", _L + " SELECT corpus, CAST(sum(raw_bytes) AS BIGINT) AS resident_bytes, count(*) AS artifacts FROM (SELECT *, row_number() OVER (PARTITION BY corpus, coalesce(document, id) ORDER BY ts DESC, id DESC) AS r FROM full_lines) x WHERE r = 1 GROUP BY corpus")
def a30(spark, sf_dir):
    return _resident(spark, sf_dir)


@add("s11_ledger_scan", _L + f" SELECT id, session_id, kind FROM full_lines WHERE strftime(ts, '%Y-%m-%d') = '{_MONTH}-05' AND session_id = 's1'")
def s11(spark, sf_dir):
    return l.scan(lines(spark, sf_dir), session="s1", day=f"{_MONTH}-05").select("id", "session_id", "kind")


@add("s12_session_audit", duckdb("v_audit") + " SELECT id, seq, action FROM v_audit WHERE session_id = 's7'")
def s12(spark, sf_dir):
    return view(spark, sf_dir, "v_audit").where("session_id = 's7'").orderBy("seq").select("id", "seq", "action")
