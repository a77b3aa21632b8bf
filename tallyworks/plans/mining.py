"""Queries of lesson mining, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import RuleBook
from ..operators import mining as m
from ..operators import profiles as pr
from ..settled import settled
from .distill import _build_logs
from .ledger import _L, lines
from .registry import Registry, rounded
from .views import duckdb, view

R = Registry()
add = R.add
_A = duckdb("v_audit")


def audit(spark, sf_dir):
    return view(spark, sf_dir, "v_audit")


_SIG = r"substr(trim(regexp_replace(regexp_replace(regexp_replace({}, '\(\d+,\d+\)', '(#)', 'g'), ':\d+(:\d+)?', ':#', 'g'), '\s+', ' ', 'g')), 1, 200)"


@add(
    "m02_error_signatures",
    duckdb("v_log_lines") + f" SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, {_SIG.format('first')} AS signature FROM (SELECT artifact_id, min_by(line, line_no) AS first FROM v_log_lines WHERE regexp_matches(line, '(?i)error|fail') AND NOT starts_with(line, 'VERDICT:') GROUP BY artifact_id) x",
)
def m02(spark, sf_dir):
    """Of every build log, by its distillate or else its raw text.

    The signature is an aggregate of its one artifact: a condition on a plain
    column would be pushed down and distil every log again for each use in it.
    """
    done = pr.distil(_build_logs(spark, sf_dir), RuleBook.built_in())
    signed = done.groupBy("artifact_id").agg(F.max(m.error_signature(F.col("distilled"), F.col("raw"))).alias("signature"))
    return signed.where("signature IS NOT NULL")


@add(
    "m03_error_fix_pairs",
    _A
    + """, v AS (SELECT session_id, profile, seq, verdict, lag(verdict) OVER w AS was, lag(seq) OVER w AS fail_seq FROM v_audit WHERE verdict IS NOT NULL WINDOW w AS (PARTITION BY session_id, profile ORDER BY ts, seq))
 SELECT session_id, profile, fail_seq, seq AS pass_seq, coalesce((SELECT string_agg(DISTINCT path, ',' ORDER BY path) FROM v_audit c WHERE c.session_id = v.session_id AND c.action = 'distill' AND c.mode = 'diff' AND c.seq BETWEEN v.fail_seq AND v.seq), '') AS files,
 (SELECT max_by(command, seq) FROM v_audit c WHERE c.session_id = v.session_id AND command IS NOT NULL AND c.seq <= v.seq) AS command FROM v WHERE verdict = 'pass' AND was = 'fail'""",
)
def m03(spark, sf_dir):
    return m.error_fix_pairs(audit(spark, sf_dir))


_ART = "art AS (SELECT input_ref AS artifact_id, min(path) AS path FROM v_audit WHERE seq % 2 = 0 AND action = 'distill' GROUP BY input_ref)"


def _artifacts(spark, sf_dir):
    """Every second distilled artifact has a file; none has texts."""
    a = audit(spark, sf_dir).where("seq % 2 = 0 AND action = 'distill'").groupBy(F.col("input_ref").alias("artifact_id")).agg(F.min("path").alias("path"))
    return a.withColumns({"distilled": F.lit(None).cast("string"), "raw": F.lit(None).cast("string")})


@add(
    "m04_zoom_hotspots",
    _A
    + f""", {_ART}, fst AS (SELECT session_id, input_ref, min_by(profile, seq) AS profile FROM v_audit WHERE module = 'distill' GROUP BY ALL),
 z AS (SELECT v.session_id, v.seq, v.id, v.query, coalesce(a.path, f.profile, 'unknown-artifact') AS target, CASE WHEN a.path IS NOT NULL THEN 'file' WHEN f.profile IS NOT NULL THEN 'artifact-class' ELSE 'unknown' END AS kind
 FROM v_audit v LEFT JOIN art a ON a.artifact_id = v.input_ref LEFT JOIN fst f ON f.session_id = v.session_id AND f.input_ref = v.input_ref WHERE action = 'zoom')
 SELECT session_id, target, min_by(kind, seq) AS target_kind, count(*) AS zooms, array_to_string(list_slice(list(id ORDER BY seq, id), 1, 20), ',') AS evidence,
 coalesce((SELECT string_agg(query, ',' ORDER BY q) FROM (SELECT query, min(seq) AS q FROM z y WHERE y.session_id = z.session_id AND y.target = z.target AND query <> '' GROUP BY query) w), '') AS queries FROM z GROUP BY session_id, target""",
)
def m04(spark, sf_dir):
    return m.zoom_hotspots(audit(spark, sf_dir), _artifacts(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("evidence", "queries")})


_CAND = """cand AS (SELECT 'zoom' AS type, path AS key, count(DISTINCT session_id) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, concat('cand-', substr(sha256(concat('zoom', chr(10), path)), 1, 8)) AS id FROM v_audit WHERE action = 'zoom' GROUP BY path
 UNION ALL SELECT 'command', command, count(DISTINCT session_id), min(ts), max(ts), concat('cand-', substr(sha256(concat('command', chr(10), command)), 1, 8)) FROM v_audit WHERE command IS NOT NULL GROUP BY command)"""
_CONF = "greatest(0, least(1, (1 - pow(CAST(0.5 AS DOUBLE), occurrences / CAST(40.0 AS DOUBLE))) * pow(CAST(0.5 AS DOUBLE), CAST(date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-10') AS DOUBLE) / 14) - CAST(0.25 AS DOUBLE) * (occurrences % 2)))"


def _candidates(spark, sf_dir):
    a = audit(spark, sf_dir)
    z = a.where("action = 'zoom'").select(F.lit("zoom").alias("type"), F.col("path").alias("key"), "session_id", "ts")
    c = a.where("command IS NOT NULL").select(F.lit("command").alias("type"), F.col("command").alias("key"), "session_id", "ts")
    return m.merge_candidates(z.unionByName(c))


def _confident(spark, sf_dir):
    age = F.date_diff(F.lit("2024-02-10").cast("date"), F.col("last_seen").cast("date")).cast("double")
    c = _candidates(spark, sf_dir)
    return c.withColumns({"contradictions": F.col("occurrences") % 2, "confidence": m.confidence(F.col("occurrences") / 20.0, age, F.col("occurrences") % 2)})


@add("m07_candidates", _A + f", {_CAND} SELECT type, key, occurrences, id, CAST(strftime(first_seen, '%Y-%m-%d') AS VARCHAR) AS first_day, CAST(strftime(last_seen, '%Y-%m-%d') AS VARCHAR) AS last_day FROM cand")
def m07(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("type", "key", "occurrences", "id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_day"))


@add("m08_confidence", _A + f", {_CAND} SELECT id, round({_CONF}, 4) AS confidence FROM cand")
def m08(spark, sf_dir):
    return _confident(spark, sf_dir).select("id", "confidence")


_DECIDED = (
    _A
    + f""", {_CAND}, k AS (SELECT id, occurrences % 2 AS contradictions, round({_CONF}, 4) AS confidence, CASE WHEN type = 'zoom' THEN 'graduated' ELSE 'candidate' END AS status FROM cand)
, decided AS (SELECT id, CASE WHEN status = 'candidate' AND confidence >= 0.5 THEN 'graduate' WHEN status = 'graduated' AND contradictions > 0 AND confidence < 0.3 THEN 'withdraw' ELSE 'keep' END AS decision FROM k)"""
)


@add("m09_decisions", _DECIDED + " SELECT * FROM decided")
def m09(spark, sf_dir):
    c = _confident(spark, sf_dir).withColumn("status", F.when(F.col("type") == "zoom", "graduated").otherwise("candidate"))
    return m.decisions(c).select("id", "decision")


@add(
    "m14_candidate_report",
    _A + f", {_CAND} SELECT id, CAST(row_number() OVER (ORDER BY occurrences DESC, last_seen DESC, id) AS INT) AS rank, concat(CAST(floor(epoch(TIMESTAMP '2024-02-10' - first_seen) / 86400) AS BIGINT), 'd') AS age FROM cand",
)
def m14(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    seconds = F.unix_timestamp(F.lit("2024-02-10").cast("timestamp")) - F.unix_timestamp(F.col("first_seen").cast("timestamp"))
    return m.ranked_report(c.withColumn("age", m.age_label(seconds))).select("id", "rank", "age")


@add(
    "m15_corpus_candidates",
    _L
    + " SELECT document, occurrences, sessions, round((1 - pow(CAST(0.5 AS DOUBLE), occurrences / CAST(2 AS DOUBLE))) * (1 - pow(CAST(0.5 AS DOUBLE), sessions)), 2) AS confidence FROM (SELECT document, count(*) AS occurrences, count(DISTINCT session_id) AS sessions FROM full_lines WHERE kind = 'zoom' GROUP BY document) x WHERE sessions >= 2 AND occurrences >= 3 AND document NOT LIKE '%7'",
)
def m15(spark, sf_dir):
    """Documents whose name ends in 7 have graduated before."""
    led = lines(spark, sf_dir)
    prior = led.where("document LIKE '%7'").select("document")
    return rounded(m.corpus_candidates(led.where("kind = 'zoom'"), prior), 2)


@add("m16_directive_matches", _A + ", d AS (SELECT DISTINCT concat('f', event_id % 9, '.ts') AS target, CAST(event_id % 9 AS INT) AS ord FROM events UNION SELECT 'src/f1.ts', -1 UNION SELECT 'src/f2.ts', 99) SELECT path, min_by(target, ord) AS target, min(ord) AS ord FROM (SELECT DISTINCT path FROM v_audit) p JOIN d ON path = target OR suffix(path, concat('/', target)) GROUP BY path")
def m16(spark, sf_dir):
    """Targets are file names and two longer paths, one before and one after them all."""
    from .views import table

    n = F.col("event_id") % 9
    targets = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), n, F.lit(".ts")).alias("target"), n.cast("int").alias("ord")).distinct()
    targets = targets.unionByName(spark.createDataFrame([("src/f1.ts", -1), ("src/f2.ts", 99)], "target string, ord int"))
    return m.directive_matches(audit(spark, sf_dir).select("path").distinct(), targets)


_SIGNALS = "CASE WHEN action = 'distill' AND mode = 'diff' THEN path END"
_ERRORS = "CASE WHEN verdict = 'fail' THEN concat(path, '(#): ', profile) END"
_SIG_SQL = f"""sig AS (SELECT session_id, kind, value, min(seq) AS begun, array_to_string(list_slice(list(id ORDER BY seq, id), 1, 20), ',') AS evidence FROM
 (SELECT session_id, id, seq, 'command' AS kind, command AS value FROM v_audit UNION ALL SELECT session_id, id, seq, 'path', {_SIGNALS} FROM v_audit UNION ALL SELECT session_id, id, seq, 'error-signature', {_ERRORS} FROM v_audit) x WHERE value <> '' GROUP BY session_id, kind, value)"""


def _signals(spark, sf_dir):
    a = audit(spark, sf_dir).select("session_id", "id", "seq", "command", F.expr(_SIGNALS).alias("changed"), F.expr(_ERRORS).alias("error_signature"))
    return m.session_signals(a)


@add("m05_session_signals", _A + f", {_SIG_SQL} SELECT * FROM sig")
def m05(spark, sf_dir):
    return _signals(spark, sf_dir).withColumn("evidence", F.array_join("evidence", ","))


_RECORDS = "SELECT id, seq, concat('[k:', path, '](#): ', coalesce(command, profile)) AS text FROM v_audit WHERE action = 'zoom' OR command IS NOT NULL"


@add(
    "m06_recurrences",
    _A + f", {_SIG_SQL}, rec AS ({_RECORDS}), hit AS (SELECT session_id, kind, value, id, r.seq FROM sig s JOIN rec r ON contains(r.text, s.value) AND r.seq < s.begun) SELECT session_id, kind, value, array_to_string(list_slice(list(id ORDER BY seq, id), 1, 5), ',') AS matched FROM hit GROUP BY session_id, kind, value",
)
def m06(spark, sf_dir):
    """Zooms and commands stand for records of before."""
    rec = spark.sql(_RECORDS.replace("v_audit", "{a}"), a=audit(spark, sf_dir))
    return m.recurrences(_signals(spark, sf_dir), rec).withColumn("matched", F.array_join("matched", ","))


_GRADUATED = """SELECT id, CASE WHEN action = 'zoom' THEN 'zoom-hotspot' ELSE 'error-fix' END AS type, CASE WHEN action = 'zoom' THEN concat('f', seq % 9, '.ts') ELSE concat(path, '/', profile) END AS target, seq AS graduated_seq, concat('s', seq % 7) AS was
 FROM v_audit WHERE (action = 'zoom' OR verdict = 'pass') AND seq % 10 = 0"""


@add(
    "m10_contradictions",
    _A
    + f""", g AS ({_GRADUATED}), fails AS (SELECT DISTINCT session_id, concat(path, '/', profile) AS target, max(seq) AS seq FROM v_audit WHERE verdict = 'fail' GROUP BY ALL), z AS (SELECT session_id, path, max(seq) AS seq FROM v_audit WHERE action = 'zoom' GROUP BY ALL)
 SELECT DISTINCT id, session_id FROM (SELECT g.*, f.session_id, f.seq FROM g JOIN fails f USING (target) WHERE type = 'error-fix'
 UNION ALL SELECT g.*, z.session_id, z.seq FROM g JOIN z ON suffix(concat('/', path), concat('/', target)) OR suffix(concat('/', target), concat('/', path)) WHERE type = 'zoom-hotspot') x WHERE seq > graduated_seq AND was <> session_id""",
)
def m10(spark, sf_dir):
    """Every tenth zoom and pass stands for a graduated record, with one session counted before; a session's last event decides."""
    return m.contradictions(*_against(spark, sf_dir))


def _against(spark, sf_dir):
    a = audit(spark, sf_dir)
    g = spark.sql(_GRADUATED.replace("v_audit", "{a}"), a=a).withColumn("counted", F.array("was"))
    fails = a.where("verdict = 'fail'").groupBy("session_id", F.concat_ws("/", "path", "profile").alias("signature")).agg(F.max("seq").alias("seq"))
    zooms = a.where("action = 'zoom'").groupBy("session_id", "path").agg(F.max("seq").alias("seq"))
    return g, fails, zooms


@add(
    "m12_queried_symbols",
    _A + " SELECT session_id, array_to_string(list_slice(list_distinct(list(query)), 1, 12), ',') AS symbols FROM (SELECT session_id, min(query) AS query FROM v_audit WHERE query IS NOT NULL GROUP BY session_id) x GROUP BY session_id",
)
def m12(spark, sf_dir):
    """The first query of each session, asked as two calls of the same name."""
    q = audit(spark, sf_dir).where("query IS NOT NULL").groupBy("session_id").agg(F.min("query").alias("q"))
    return q.select("session_id", F.array_join(m.queried_symbols(F.array(F.concat("q", F.lit("()")), F.concat(F.lit("."), "q"))), ",").alias("symbols"))


@add(
    "m13_fix_summaries",
    _A + " SELECT id, CASE WHEN seq % 5 = 0 THEN 'lesson' ELSE concat(CASE WHEN mode = 'diff' THEN concat('edit ', path, ', b.ts') ELSE 're-run until green' END, CASE WHEN command IS NOT NULL THEN concat(' (', command, ')') ELSE '' END) END AS summary FROM v_audit",
)
def m13(spark, sf_dir):
    files = F.when(F.col("mode") == "diff", F.array("path", F.lit("b.ts")))
    return audit(spark, sf_dir).select("id", m.fix_summary(F.when(F.col("seq") % 5 == 0, "lesson"), files, F.col("command")).alias("summary"))


_TOUCHED = "SELECT l_orderkey AS event_id, concat('s', l_orderkey % 10) AS session_id, concat('d', l_partkey % 3) AS document, concat('x', l_linenumber % 3) AS section FROM lineitem"


@add(
    "m15_ask_neighbourhoods",
    f"""WITH t AS ({_TOUCHED}), l AS (SELECT event_id, session_id, document, string_agg(DISTINCT section, '|' ORDER BY section) AS sections FROM t GROUP BY ALL),
 k AS (SELECT event_id, session_id, concat(min(document), '#', min_by(sections, document)) AS key FROM l GROUP BY event_id, session_id)
 SELECT key, occurrences, sessions, round((1 - pow(CAST(0.5 AS DOUBLE), occurrences / CAST(2 AS DOUBLE))) * (1 - pow(CAST(0.5 AS DOUBLE), sessions)), 2) AS confidence FROM (SELECT key, count(*) AS occurrences, count(DISTINCT session_id) AS sessions FROM k GROUP BY key) x WHERE sessions >= 2 AND occurrences >= 3""",
)
def m15n(spark, sf_dir):
    """Every order is a question, each of its lines a section that it touched."""
    from .views import table

    return m.ask_neighbourhoods(spark.sql(_TOUCHED.replace("lineitem", "{t}"), t=table(spark, sf_dir, "lineitem")))


_PASS = """SELECT concat('cand-', seq) AS id, CASE WHEN action = 'zoom' THEN 'zoom-hotspot' WHEN verdict IS NOT NULL THEN 'error-fix' ELSE 'lesson' END AS type,
 CASE seq % 3 WHEN 0 THEN 'graduate' WHEN 1 THEN 'withdraw' ELSE 'keep' END AS decision, CASE WHEN profile = 'build-log' THEN 'file' ELSE 'profile' END AS target_kind, path AS target, query, concat(path, ' fix: ', profile) AS summary, 0.5 AS confidence, seq FROM v_audit"""
_CODEX = """SELECT CASE type WHEN 'zoom-hotspot' THEN 'learned' WHEN 'error-fix' THEN 'pitfalls' ELSE 'conventions' END AS section, id AS candidate, CASE WHEN type <> 'zoom-hotspot' THEN summary END AS text, CASE WHEN type = 'zoom-hotspot' THEN target END AS path,
 CASE WHEN type = 'zoom-hotspot' THEN query END AS symbols, CASE WHEN seq % 2 = 0 THEN 'graduated' ELSE 'human' END AS source, seq % 7 = 0 AS locked, 0.5 AS confidence FROM dec WHERE decision = 'withdraw' OR seq % 5 = 0"""
_PASSED = _A + f""", dec AS ({_PASS}), codex AS ({_CODEX}), k AS (SELECT c.* FROM codex c LEFT JOIN dec d ON d.id = c.candidate AND d.decision = 'withdraw' WHERE d.id IS NULL OR NOT (section = 'learned' OR (source = 'graduated' AND NOT locked))),
 new AS (SELECT d.*, section FROM (SELECT *, CASE WHEN type = 'zoom-hotspot' THEN CASE WHEN target_kind = 'file' AND query IS NOT NULL THEN 'learned' END WHEN type = 'error-fix' THEN 'pitfalls' ELSE 'conventions' END AS section FROM dec WHERE decision = 'graduate') d WHERE section IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.section = d.section AND k.candidate = d.id))"""


def _graduation(spark, sf_dir):
    d = spark.sql(_PASS.replace("v_audit", "{a}"), a=audit(spark, sf_dir))
    codex = spark.sql(_CODEX.replace("FROM dec", "FROM {d}"), d=d).withColumn("symbols", F.when(F.col("symbols").isNotNull(), F.array("symbols")))
    return m.graduation_pass(d.withColumn("symbols", F.array_compact(F.array("query"))).drop("query", "seq"), codex)


@add(
    "m11_knowledge",
    _PASSED + " SELECT section, candidate, text, path, symbols, source, locked FROM k UNION ALL SELECT section, id, CASE WHEN section <> 'learned' THEN summary END, CASE WHEN section = 'learned' THEN target END, CASE WHEN section = 'learned' THEN query END, 'graduated', false FROM new",
)
def m11(spark, sf_dir):
    """Every event is a candidate; those withdrawn and every fifth have an entry, of a person or graduated, some locked."""
    return _graduation(spark, sf_dir)[0].withColumn("symbols", F.array_join("symbols", ",")).drop("confidence")


@add(
    "m11_outcomes",
    _PASSED + " SELECT id, 'graduate' AS action, section, '' AS locked_kept FROM new UNION ALL SELECT d.id, 'withdraw', NULL, coalesce((SELECT max(section) FROM codex c WHERE c.candidate = d.id AND source = 'graduated' AND locked AND section <> 'learned'), '') FROM dec d WHERE decision = 'withdraw'",
)
def m11_outcomes(spark, sf_dir):
    return _graduation(spark, sf_dir)[1]


_SEEN = """SELECT 'zoom' AS type, path AS key, session_id, ts, seq, id, profile AS detail, query FROM v_audit WHERE action = 'zoom' UNION ALL SELECT 'command', command, session_id, ts, seq, id, path, query FROM v_audit WHERE command IS NOT NULL"""


def _seen(spark, sf_dir):
    return spark.sql(_SEEN.replace("v_audit", "{a}"), a=audit(spark, sf_dir))


@add(
    "m07_evidence",
    _A
    + f""", o AS ({_SEEN}), s AS (SELECT type, key, session_id, max(ts) AS t, max_by(seq, (ts, seq)) AS q FROM o GROUP BY ALL)
 SELECT type, key, detail, evidence, sessions FROM (SELECT type, key, max_by(detail, (ts, seq)) AS detail, array_to_string(list_slice(list(id ORDER BY ts, seq, id), 1, 20), ',') AS evidence FROM o GROUP BY type, key) x
 JOIN (SELECT type, key, array_to_string(list_slice(list(session_id ORDER BY t DESC, q DESC, session_id), 1, 50), ',') AS sessions FROM s GROUP BY type, key) y USING (type, key)""",
)
def m07_evidence(spark, sf_dir):
    return m.candidate_evidence(_seen(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("evidence", "sessions")})


@add("m07_queries", _A + f", o AS ({_SEEN}) SELECT DISTINCT type, key, query FROM o WHERE query IS NOT NULL")
def m07_queries(spark, sf_dir):
    return m.candidate_queries(_seen(spark, sf_dir))


_RUNS = f"""o AS ({_SEEN}), row_ AS (SELECT type, key, session_id, max(ts) AS ts, min(seq) AS begun FROM o GROUP BY ALL), p AS (SELECT * FROM row_ WHERE CAST(substr(session_id, 2) AS BIGINT) % 2 = 0),
 pk AS (SELECT type, key, session_id FROM (SELECT *, row_number() OVER (PARTITION BY type, key ORDER BY ts DESC, session_id DESC) AS r FROM p) x WHERE r <= 50),
 fresh AS (SELECT r.* FROM row_ r ANTI JOIN pk USING (type, key, session_id)),
 old AS (SELECT type, key, count(*) AS n, min(ts) AS a FROM p GROUP BY ALL), neu AS (SELECT type, key, count(*) AS n FROM fresh GROUP BY ALL), every AS (SELECT type, key, count(*) AS n, min(ts) AS a, max(ts) AS b FROM row_ GROUP BY ALL)"""


def _runs(spark, sf_dir):
    """Two mining runs: over sessions of even number, then over all; each session's zooms of a file and commands are one mined row."""
    seen = _seen(spark, sf_dir).groupBy("type", "key", "session_id").agg(
        F.max("ts").alias("ts"), F.min("seq").alias("nth"), F.slice(F.array_sort(F.collect_list("id")), 1, 3).alias("evidence"), F.array_sort(F.collect_set("query")).alias("queries")
    )
    mined = seen.select(
        "session_id", "ts", F.col("nth").cast("int").alias("nth"), "type", "key", F.concat_ws(" ", "type", "key").alias("signature"), "evidence", "queries", F.col("session_id").alias("details")
    )
    even = F.substring("session_id", 2, 20).cast("long") % 2 == 0
    first, _ = m.merge_mined(spark.createDataFrame([], m.STATE), mined.where(even))
    return m.merge_mined(first, mined)


@add(
    "m07_merged",
    _A + f""", {_RUNS} SELECT concat('cand-', substr(sha256(concat(e.type, chr(10), e.key)), 1, 8)) AS id, coalesce(old.n, 0) + coalesce(neu.n, 0) AS occurrences, CAST(least(50, e.n) AS INT) AS n_sessions,
 CAST(strftime(coalesce(old.a, e.a), '%Y-%m-%d') AS VARCHAR) AS first_day, CAST(strftime(b, '%Y-%m-%d') AS VARCHAR) AS last_day FROM every e LEFT JOIN old USING (type, key) LEFT JOIN neu USING (type, key)""",
)
def m07_merged(spark, sf_dir):
    state, _ = _runs(spark, sf_dir)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return state.select("id", "occurrences", F.size("sessions").alias("n_sessions"), day("first_seen").alias("first_day"), day("last_seen").alias("last_day"))


@add(
    "m17_run_summary",
    _DECIDED + f""", {_RUNS}, g AS ({_GRADUATED}), fails AS (SELECT DISTINCT session_id, concat(path, '/', profile) AS target, max(seq) AS seq FROM v_audit WHERE verdict = 'fail' GROUP BY ALL), zz AS (SELECT session_id, path, max(seq) AS seq FROM v_audit WHERE action = 'zoom' GROUP BY ALL),
 con AS (SELECT DISTINCT id FROM (SELECT g.*, f.session_id, f.seq FROM g JOIN fails f USING (target) WHERE type = 'error-fix' UNION ALL SELECT g.*, zz.session_id, zz.seq FROM g JOIN zz ON suffix(concat('/', path), concat('/', target)) OR suffix(concat('/', target), concat('/', path)) WHERE type = 'zoom-hotspot') x WHERE seq > graduated_seq AND was <> session_id)
 SELECT (SELECT count(*) FROM row_) AS mined, (SELECT CAST(sum(n) AS BIGINT) FROM neu) - (SELECT count(*) FROM every ANTI JOIN old USING (type, key)) AS merged, (SELECT count(*) FROM row_) - (SELECT CAST(sum(n) AS BIGINT) FROM neu) AS skipped,
 (SELECT count(*) FROM con) AS contradicted, (SELECT count(*) FROM decided WHERE decision = 'graduate') AS graduated, (SELECT count(*) FROM decided WHERE decision = 'withdraw') AS withdrawn""",
)
def m17(spark, sf_dir):
    return m.run_summary(_runs(spark, sf_dir)[1], m09(spark, sf_dir), m.contradicted(*_against(spark, sf_dir)))


@add("m07_mined")
def m07_mined(spark, sf_dir):
    """Every session of the audit trail mined and merged with no prior state: one row per candidate.

    What the sessions teach is mined once for the records' versions and for the
    candidates; these and the recurrences are tables before they are merged.
    """
    a, art = audit(spark, sf_dir), _artifacts(spark, sf_dir)
    begun = a.groupBy("session_id").agg(F.min("seq").alias("seq"))
    first = settled(m.mined_candidates(a, art), "mined-first")
    records = settled(m.record_versions(first, begun), "mined-records")
    mined = settled(m.mined_candidates(a, art, records, first), "mined")
    state, _ = m.merge_mined(spark.createDataFrame([], m.STATE), mined)
    return state.withColumns({c: F.array_join(c, ",") for c in ("evidence", "sessions", "queries")})
