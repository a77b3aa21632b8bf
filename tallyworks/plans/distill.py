"""Queries of artifact distillation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.rules import RuleBook
from ..operators import distill as d
from ..operators import profiles as pr
from ..sources import records
from .registry import Registry, rounded
from .views import duckdb, table, view

R = Registry()
add = R.add
_LOG = duckdb("v_log_lines")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(column: str, names) -> str:
    return f"regexp_matches({column}, {_sql('(?im)' + '|'.join(f'(?:{p})' for p in names))})"


_FAIL, _PASS = _any("raw", patterns.BUILD_LOG["fail"]), _any("raw", patterns.BUILD_LOG["pass"])
_RAW = "raws AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM v_log_lines GROUP BY artifact_id)"


def logs(spark, sf_dir):
    return view(spark, sf_dir, "v_log_lines")


@add("a04_explode_lines", _LOG + f", {_RAW} SELECT artifact_id, CAST(sum(len(line)) AS BIGINT) AS chars, count(*) AS n FROM v_log_lines GROUP BY artifact_id")
def a04(spark, sf_dir):
    """Artifacts are assembled to raw text and split into lines again."""
    again = d.explode_lines(d.assemble(logs(spark, sf_dir)))
    return again.groupBy("artifact_id").agg(F.sum(F.length("line")).alias("chars"), F.count("*").alias("n"))


@add("a05_distinct_lines", _LOG + " SELECT artifact_id, line, min(line_no) AS line_no FROM v_log_lines GROUP BY artifact_id, line")
def a05(spark, sf_dir):
    return d.distinct_lines(logs(spark, sf_dir))


_BAD = "regexp_matches(line, '(?i)error|failed')"
_LF, _LP = _any("line", patterns.BUILD_LOG["fail"]), _any("line", patterns.BUILD_LOG["pass"])


@add(
    "a06_build_contract",
    _LOG
    + rf""" SELECT artifact_id, CASE WHEN bool_or({_LF}) THEN 'fail' WHEN bool_or({_LP}) THEN 'pass' ELSE 'unknown' END AS verdict, trim(min_by(line, line_no) FILTER (WHERE {_BAD})) AS first_error,
 count(*) FILTER (WHERE {_BAD}) AS errors, count(DISTINCT nullif(regexp_extract(trim(line), '^([^\s(:]+)[(:]', 1), '')) FILTER (WHERE {_BAD}) AS files,
 CASE WHEN count(*) FILTER (WHERE {_BAD}) = 0 THEN max_by(line, line_no) END AS last_line FROM v_log_lines WHERE trim(line) <> '' GROUP BY artifact_id""",
)
def a06(spark, sf_dir):
    return d.build_contract(logs(spark, sf_dir))


def _bool(kind: str) -> str:
    return f"coalesce(bool_or({_any('line', patterns.TEST_OUTPUT[kind])}), false)"


@add(
    "a07_test_output",
    duckdb("v_test_lines")
    + f""", v AS (SELECT artifact_id, concat('VERDICT: ', CASE WHEN {_bool('fail')} THEN 'fail' WHEN {_bool('pass')} THEN 'pass' ELSE 'unknown' END) AS line FROM v_test_lines GROUP BY artifact_id),
 rel AS (SELECT artifact_id, line, min(line_no) AS line_no FROM v_test_lines WHERE regexp_matches(line, {_sql('(?i)' + patterns.TEST_OUTPUT['relevant'])}) GROUP BY artifact_id, line),
 u AS (SELECT artifact_id, 0 AS part, 0 AS line_no, line FROM v UNION ALL SELECT artifact_id, 1, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY line_no) AS r FROM rel) x WHERE r <= 60
 UNION ALL SELECT artifact_id, 2, line_no, line FROM v_test_lines WHERE regexp_matches(line, {_sql(patterns.TEST_OUTPUT['summary'])}))
 SELECT artifact_id, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY part, line_no) AS INT) AS place, line FROM (SELECT artifact_id, line, min(part) AS part, arg_min(line_no, part * 1000000 + line_no) AS line_no FROM u WHERE line <> '' GROUP BY artifact_id, line) y""",
)
def a07(spark, sf_dir):
    return d.test_output(view(spark, sf_dir, "v_test_lines"))


@add(
    "a08_search_results",
    duckdb("v_search_hits")
    + r""", h AS (SELECT artifact_id, line_no, regexp_extract(line, '^(.+?):(\d+):(.*)$', 1) AS path, regexp_extract(line, '^(.+?):(\d+):(.*)$', 2) AS "at", trim(regexp_extract(line, '^(.+?):(\d+):(.*)$', 3)) AS text FROM v_search_hits),
 f AS (SELECT artifact_id, path, count(*) AS n, row_number() OVER (PARTITION BY artifact_id ORDER BY count(*) DESC, min(line_no)) AS file_rank, sum(count(*)) OVER (PARTITION BY artifact_id) AS total, count(*) OVER (PARTITION BY artifact_id) AS n_files FROM h GROUP BY artifact_id, path)
 SELECT artifact_id, CAST(file_rank AS INT) AS file_rank, CAST(hit AS INT) AS hit, path, "at", text, CAST(total AS BIGINT) AS total, n_files FROM (SELECT h.*, file_rank, total, n_files, row_number() OVER (PARTITION BY h.artifact_id, h.path ORDER BY line_no) AS hit FROM h JOIN f ON f.artifact_id = h.artifact_id AND f.path = h.path WHERE file_rank <= 10) x WHERE hit <= 3""",
)
def a08(spark, sf_dir):
    return d.search_results(view(spark, sf_dir, "v_search_hits"))


@add(
    "a09_head_tail",
    duckdb("v_search_hits") + " SELECT artifact_id, line_no, line, CASE WHEN n <= 25 THEN 0 ELSE n - 25 END AS omitted FROM (SELECT *, count(*) OVER (PARTITION BY artifact_id) AS n FROM v_search_hits) x WHERE n <= 25 OR line_no <= 15 OR line_no > n - 10",
)
def a09(spark, sf_dir):
    return d.head_tail(view(spark, sf_dir, "v_search_hits"))


@add("a10_verdicts", _LOG + f", {_RAW} SELECT artifact_id, CASE WHEN {_FAIL} AND NOT {_PASS} THEN 'fail' WHEN {_PASS} AND NOT {_FAIL} THEN 'pass' ELSE 'unknown' END AS verdict, CASE WHEN {_FAIL} THEN 'VERDICT: fail' WHEN {_PASS} THEN 'VERDICT: pass' ELSE 'VERDICT: unknown' END AS line FROM raws")
def a10(spark, sf_dir):
    raws, p = d.assemble(logs(spark, sf_dir)), patterns.BUILD_LOG
    return raws.select("artifact_id", d.verdict(F.col("raw"), p).alias("verdict"), d.verdict_line(F.col("raw"), p).alias("line"))


_ENT = "list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(line, {_sql(p)}, {g})" for p, g in patterns.CODE_ENTITIES) + ", lambda x: trim(x)))"


@add("a11_entities", _LOG + f" SELECT artifact_id, line_no, len({_ENT}) AS n, array_to_string(list_sort({_ENT}), '|') AS entities FROM v_log_lines")
def a11(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn("e", d.entities(F.col("line")))
    return rows.select("artifact_id", "line_no", F.size("e").cast("long").alias("n"), F.array_join(F.array_sort("e"), "|").alias("entities"))


_SECOND = _any("raw", patterns.BUILD_LOG["fail2"])
_SAID_P = _any("distilled", [*patterns.BUILD_LOG["pass"], r"\bVERDICT: pass\b"])
_SAID_F = _any("distilled", [*patterns.BUILD_LOG["fail"], *patterns.BUILD_LOG["fail2"], r"\bVERDICT: fail\b"])
_only = lambda p, f: f"CASE WHEN {f} AND NOT {p} THEN 'fail' WHEN {p} AND NOT {f} THEN 'pass' ELSE 'unknown' END"
_DISTIL = rf"""{_RAW}, con AS (SELECT artifact_id, CASE WHEN bool_or({_LF}) THEN 'fail' WHEN bool_or({_LP}) THEN 'pass' ELSE 'unknown' END AS verdict, coalesce(min_by(line, line_no) FILTER (WHERE {_BAD}), '') AS region,
 count(*) FILTER (WHERE {_BAD}) AS errors, count(DISTINCT nullif(regexp_extract(trim(line), '^([^\s(:]+)[(:]', 1), '')) FILTER (WHERE {_BAD}) AS files, max_by(line, line_no) AS last_line FROM v_log_lines WHERE trim(line) <> '' GROUP BY artifact_id),
 dis AS (SELECT artifact_id, raw, region, concat('VERDICT: ', verdict, chr(10), CASE WHEN errors = 0 THEN last_line ELSE concat('first error: ', trim(region), chr(10), 'errors: ', errors, ' lines across ', files, ' files') END, chr(10), '[full log elided, zoom: zoom("', artifact_id, '", query?)]') AS distilled FROM con JOIN raws USING (artifact_id)),
 ext AS (SELECT *, {_only(_PASS, _FAIL)} AS one, CASE WHEN {_SECOND} THEN 'fail' ELSE 'pass' END AS two, {_only(_SAID_P, _SAID_F)} AS said, {_ENT.replace('(line,', '(region,')} AS e FROM dis),
 gate AS (SELECT *, len(list_filter(e, lambda x: NOT contains(distilled, x))) = 0 AS entity_ok, one <> 'unknown' AND one = two AND said = one AS verdict_ok,
 CASE WHEN len(e) = 0 THEN 'no entities in relevant region' ELSE concat(len(list_filter(e, lambda x: contains(distilled, x))), '/', len(e), ' entities preserved') END AS entity_detail,
 CASE WHEN one = 'unknown' OR one <> two THEN concat('extractions disagree or are inconclusive on raw: primary=', one, ', secondary=', two) WHEN said = one THEN concat('verdict ', one, ' agreed by both extractions and the distillate') ELSE concat('raw verdict ', one, ' but distillate reads ', said) END AS verdict_detail,
 concat(strlen(distilled), 'B of ', strlen(raw), 'B (max ratio 0.4, min 12B)') AS size_detail, strlen(raw) > 0 AND CAST(strlen(distilled) AS DOUBLE) / strlen(raw) <= 0.4 AND strlen(distilled) >= 12 AS size_ok FROM ext),
 done AS (SELECT *, entity_ok AND verdict_ok AND size_ok AS passed, CASE WHEN entity_ok AND verdict_ok AND size_ok THEN distilled ELSE raw END AS text FROM gate)"""


def _build_logs(spark, sf_dir):
    """Every order's log lines as one build log of the session of its order."""
    raw = d.assemble(logs(spark, sf_dir))
    return raw.select(
        F.col("artifact_id").cast("string").alias("artifact_id"), F.concat(F.lit("s"), F.col("artifact_id") % 97).alias("session_id"),
        F.lit("build-log").alias("profile"), F.lit(None).cast("string").alias("path"), "raw",
    )


def _gate(name: str, part: str):
    return F.filter("gates", lambda g: g["gate"] == name)[0][part]


@add("a13_entity_gate", _LOG + f", {_DISTIL} SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, entity_ok, entity_detail FROM done")
def a13(spark, sf_dir):
    """The distillates of build logs against the entities of their first error lines."""
    rows = pr.distillates(_build_logs(spark, sf_dir), RuleBook.built_in())
    return rows.select("artifact_id", _gate("entity-preservation", "passed").alias("entity_ok"), _gate("entity-preservation", "detail").alias("entity_detail"))


@add("a14_gates", _LOG + f", {_DISTIL} SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, verdict_ok, verdict_detail, size_ok, size_detail, passed FROM done")
def a14(spark, sf_dir):
    rows = pr.distillates(_build_logs(spark, sf_dir), RuleBook.built_in())
    parts = [_gate(g, p).alias(f"{n}_{'ok' if p == 'passed' else p}") for g, n in (("verdict-fidelity", "verdict"), ("size-sanity", "size")) for p in ("passed", "detail")]
    return rows.select("artifact_id", *parts, F.forall("gates", lambda g: g["passed"]).alias("passed"))


_TOKENS = "CAST(ceil(length({}) / 4.0) AS BIGINT)"


@add(
    "a17_distil_job",
    _LOG + f""", {_DISTIL} SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, CASE WHEN passed THEN 'distilled' ELSE 'raw' END AS served, md5(text) AS text_md5, strlen(raw) AS bytes_in, strlen(text) AS bytes_out,
 concat('[artifact ', artifact_id, ', raw ', {_TOKENS.format('raw')}, ' tok to ', {_TOKENS.format('text')}, ' tok, zoom: zoom("', artifact_id, '", query?)]') AS handle FROM done""",
)
def a17(spark, sf_dir):
    """No line of these logs holds a secret, so the served text is what the gates chose."""
    done = pr.distil(_build_logs(spark, sf_dir), RuleBook.built_in())
    return done.select("artifact_id", "served", F.md5("text").alias("text_md5"), "bytes_in", "bytes_out", "handle")


@add(
    "a17_audit_rows",
    _LOG + f""", {_DISTIL} SELECT concat(CASE WHEN passed THEN 'distilled-' ELSE 'raw-' END, artifact_id) AS id, concat('s', artifact_id % 97) AS session_id, CASE WHEN passed THEN 'distill' ELSE 'serve-raw' END AS action,
 CASE WHEN passed THEN concat('profile build-log served ', strlen(text), 'B for ', strlen(raw), 'B raw') ELSE concat('profile build-log gate failure, raw served: ', concat_ws('; ', CASE WHEN NOT entity_ok THEN concat('entity-preservation (', entity_detail, ')') END,
 CASE WHEN NOT verdict_ok THEN concat('verdict-fidelity (', verdict_detail, ')') END, CASE WHEN NOT size_ok THEN concat('size-sanity (', size_detail, ')') END)) END AS reason FROM done""",
)
def a17_audit(spark, sf_dir):
    book = RuleBook.built_in()
    return pr.audit_rows(pr.distil(_build_logs(spark, sf_dir), book), book).select("id", "session_id", "action", "reason")


_ZOOM = """concat('zoom: zoom("', doc_id, '", query?)')"""
_SPLIT = r"string_split_regex(text, '\r?\n')"


@add(
    "a17_text_profiles",
    f"""WITH t AS (SELECT doc_id, text, {_SPLIT} AS w, list_filter({_SPLIT}, lambda x: trim(x) <> '') AS full_ FROM documents),
 dis AS (SELECT doc_id, text, 'generic-stdout' AS profile, 0.4 AS most, 20 AS least, CASE WHEN len(w) <= 25 THEN text ELSE concat(array_to_string(list_slice(w, 1, 15), chr(10)), chr(10), '[omitted ', len(w) - 25, ' middle lines, ', {_ZOOM}, ']', chr(10), array_to_string(list_slice(w, len(w) - 9, len(w)), chr(10))) END AS distilled FROM t
 UNION ALL SELECT doc_id, text, 'doc-search', 1.5, 40, CASE WHEN len(full_) = 0 THEN '' ELSE concat(len(full_), ' hits across ', len(list_distinct(list_transform(full_, lambda x: split_part(x, ' §', 1)))), ' documents', CASE WHEN len(full_) > 24 THEN ' (showing top 24; full set: ' ELSE ' (full set: ' END, {_ZOOM}, ')', chr(10), array_to_string(list_slice(full_, 1, 24), chr(10))) END FROM t)
 SELECT CAST(doc_id AS VARCHAR) AS artifact_id, profile, md5(distilled) AS distilled_md5, strlen(text) > 0 AND CAST(strlen(distilled) AS DOUBLE) / strlen(text) <= most AND strlen(distilled) >= least AS size_ok FROM dis""",
)
def a17_texts(spark, sf_dir):
    """Every document as the output of a command and as a list of hits."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.col("source").alias("session_id"), F.lit(None).cast("string").alias("path"), F.col("text").alias("raw"),
        F.explode(F.array(F.lit("generic-stdout"), F.lit("doc-search"))).alias("profile"),
    )
    rows = pr.distillates(docs, RuleBook.built_in())
    return rows.select("artifact_id", "profile", F.md5("distilled").alias("distilled_md5"), _gate("size-sanity", "passed").alias("size_ok"))


@add("m01_gate_verdicts", _LOG + f", {_DISTIL} SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, coalesce(nullif(regexp_extract(verdict_detail, 'verdict (pass|fail) agreed', 1), ''), nullif(regexp_extract(verdict_detail, 'raw verdict (pass|fail) but', 1), '')) AS verdict FROM done")
def m01(spark, sf_dir):
    rows = pr.distillates(_build_logs(spark, sf_dir), RuleBook.built_in())
    return rows.select("artifact_id", d.gate_verdict(_gate("verdict-fidelity", "detail")).alias("verdict"))


@add(
    "a01_command_routes",
    duckdb("v_commands") + r" SELECT id, CASE WHEN regexp_matches(command, '\b(tsc|build)\b') THEN 'build-log' WHEN regexp_matches(command, '\b(vitest|jest|test|verify|check)\b') THEN 'test-output' ELSE 'generic-stdout' END AS profile FROM v_commands",
)
def a01(spark, sf_dir):
    return view(spark, sf_dir, "v_commands").select("id", d.route(F.col("command")).alias("profile"))


@add(
    "a02_skeleton_routes",
    duckdb("v_commands") + r" SELECT id, CASE WHEN ext IN ('ts', 'tsx', 'mts', 'js', 'mjs', 'cjs', 'jsx', 'py') THEN 'file-skeleton' WHEN ext IN ('md', 'markdown', 'txt', 'text', 'pdf', 'docx') THEN 'doc-skeleton' WHEN ext IN ('html', 'htm') THEN 'html-skeleton' END AS profile FROM (SELECT id, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM v_commands) x",
)
def a02(spark, sf_dir):
    return view(spark, sf_dir, "v_commands").select("id", d.skeleton_route(F.col("path")).alias("profile"))


@add(
    "a20_read_tiers",
    """SELECT doc_id, CASE WHEN posture = 'idle' AND (sliced OR size < 131072) THEN 'pass' WHEN size <= 16384 THEN 'pass' WHEN size <= 65536 THEN 'capped' WHEN sliced THEN 'pass' ELSE 'skeleton' END AS tier
 FROM (SELECT doc_id, strlen(text) * 8 AS size, doc_id % 9 = 0 AS sliced, CASE WHEN source = 'web' OR doc_id % 4 = 0 THEN 'idle' ELSE 'full' END AS posture FROM documents) x""",
)
def a20(spark, sf_dir):
    """Files of eight times a document's size; every ninth is read by an explicit slice, some in idle sessions."""
    docs = table(spark, sf_dir, "documents")
    posture = F.when((F.col("source") == "web") | (F.col("doc_id") % 4 == 0), "idle").otherwise("full")
    return docs.select("doc_id", d.read_tier(F.octet_length("text") * 8, F.col("doc_id") % 9 == 0, posture).alias("tier"))


@add("a21_full_rewrites", "SELECT doc_id, doc_id % 2 = 0 AND strlen(text) > 16384 AS flagged FROM documents")
def a21(spark, sf_dir):
    """Each document is written; every second one exists already."""
    return table(spark, sf_dir, "documents").select("doc_id", d.full_rewrite(F.col("doc_id") % 2 == 0, F.octet_length("text")).alias("flagged"))


@add(
    "a22_prompt_tiers",
    f"SELECT conv_id, turn, CASE WHEN text <> '' THEN CASE WHEN regexp_matches(text, {_sql(patterns.HARD_PROMPT)}) THEN 'hard' WHEN length(text) <= 120 AND NOT contains(text, chr(10)) THEN 'trivial' ELSE 'standard' END END AS tier FROM conversations WHERE role = 'user'",
)
def a22(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select("conv_id", "turn", d.prompt_tier(F.col("text")).alias("tier"))


_PROSE = "list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(text, {_sql(p)}, {g})" for p, g in patterns.PROSE_ENTITIES) + ", lambda x: trim(x)))"


@add("a12_prose_entities", f"SELECT doc_id, len({_PROSE}) AS n, md5(array_to_string(list_sort({_PROSE}), '|')) AS entities_md5 FROM documents")
def a12(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("e", d.prose_entities(F.col("text")))
    return rows.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("e"), "|")).alias("entities_md5"))


def _redaction_sql() -> str:
    steps, cols, prev = [], [], "v0"
    for i, (kind, p) in enumerate(patterns.REDACTION):
        rep = f"\\1[REDACTED:{kind}]" if kind == "env-assignment" else f"[REDACTED:{kind}]"
        cols.append(f"n{i}")
        steps.append(f"v{i + 1} AS (SELECT * EXCLUDE (text), len(regexp_extract_all(text, {_sql(p)})) AS n{i}, regexp_replace(text, {_sql(p)}, {_sql(rep)}, 'g') AS text FROM {prev})")
        prev = f"v{i + 1}"
    return "v0 AS (SELECT doc_id, concat(text, chr(10), line) AS text FROM v_secret_lines), " + ", ".join(steps)


def seeded(spark, sf_dir):
    v = view(spark, sf_dir, "v_secret_lines")
    return v.select("doc_id", F.concat("text", F.lit("\n"), "line").alias("text"))


@add("a15_redaction", duckdb("v_secret_lines") + f", {_redaction_sql()} SELECT doc_id, md5(text) AS text_md5, CAST(" + " + ".join(f"n{i}" for i in range(7)) + " AS BIGINT) AS found FROM v7")
def a15(spark, sf_dir):
    r = d.redact(seeded(spark, sf_dir))
    return r.select("doc_id", F.md5("text").alias("text_md5"), F.aggregate("findings", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("found"))


@add(
    "a16_redaction_audit",
    duckdb("v_secret_lines") + f", {_redaction_sql()} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(n{i} AS BIGINT) AS count FROM v7 WHERE n{i} > 0" for i, (k, _) in enumerate(patterns.REDACTION)),
)
def a16(spark, sf_dir):
    return d.redaction_audit(d.redact(seeded(spark, sf_dir)), "doc_id")


_RATIO = "CASE WHEN action = 'distill' AND bytes_out > 0 THEN bytes_in / CAST(bytes_out AS DOUBLE) END"


@add(
    "a19_ratio_statistics",
    duckdb("v_audit")
    + f" SELECT profile, count(*) FILTER (WHERE action = 'distill') AS distillations, round(median({_RATIO}), 6) AS median_ratio, round(max({_RATIO}), 6) AS peak_ratio, CAST(sum(bytes_in) FILTER (WHERE action = 'distill') AS BIGINT) AS bytes_in, CAST(sum(bytes_out) FILTER (WHERE action = 'distill') AS BIGINT) AS bytes_out, count(*) FILTER (WHERE action = 'serve-raw') AS raw_serves, count(*) FILTER (WHERE action = 'zoom') AS zooms FROM v_audit GROUP BY profile",
)
def a19(spark, sf_dir):
    return rounded(d.ratio_statistics(view(spark, sf_dir, "v_audit")))


@add(
    "a23_delta_serves",
    duckdb("v_serves")
    + " SELECT session_id, path, seq, CASE WHEN before IS NULL THEN 'full' WHEN before = hash THEN 'unchanged' ELSE 'diff' END AS mode, concat('F', substr(sha256(path), 1, 4), '@', substr(hash, 1, 16)) AS ref FROM (SELECT *, lag(hash) OVER (PARTITION BY session_id, path ORDER BY ts, seq) AS before FROM (SELECT *, sha256(content) AS hash FROM v_serves) x) y",
)
def a23(spark, sf_dir):
    return d.delta_serves(view(spark, sf_dir, "v_serves"))


@add(
    "a24_line_delta",
    _LOG
    + """ SELECT key, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM (SELECT key, line, sum(n) AS n FROM (SELECT artifact_id - artifact_id % 2 AS key, line, CASE WHEN artifact_id % 2 = 0 THEN -1 ELSE 1 END AS n FROM v_log_lines) x GROUP BY key, line HAVING sum(n) <> 0) y GROUP BY key""",
)
def a24(spark, sf_dir):
    """An artifact of odd id is the next version of the one before it."""
    rows = logs(spark, sf_dir).withColumn("key", F.col("artifact_id") - F.col("artifact_id") % 2)
    return d.line_delta(rows.where("artifact_id % 2 = 0"), rows.where("artifact_id % 2 = 1"))


@add(
    "a25_text_zoom",
    duckdb("v_search_hits")
    + """, f AS (SELECT *, contains(lower(line), 'match n17') AS p, contains(lower(line), 'match') OR contains(lower(line), 'n17') AS w FROM v_search_hits),
 g AS (SELECT *, bool_or(p) OVER (PARTITION BY artifact_id) AS anyp FROM f),
 n AS (SELECT *, bool_or(CASE WHEN anyp THEN p ELSE w END) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM g)
 SELECT artifact_id, line_no, line, omitted FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY line_no) AS r, greatest(count(*) OVER (PARTITION BY artifact_id) - 20, 0) AS omitted FROM n WHERE near) x WHERE r <= 20""",
)
def a25(spark, sf_dir):
    return d.text_zoom(view(spark, sf_dir, "v_search_hits"), "match n17", most=20)


@add(
    "a29_dead_handles",
    duckdb("v_audit", "v_error_signature") + " SELECT DISTINCT input_ref AS artifact_id FROM v_audit WHERE input_ref NOT IN (SELECT artifact_id FROM v_error_signature WHERE first_error_line LIKE '%TS2301%')",
)
def a29(spark, sf_dir):
    handles = view(spark, sf_dir, "v_audit").select(F.col("input_ref").alias("artifact_id")).distinct()
    stored = view(spark, sf_dir, "v_error_signature").where("first_error_line LIKE '%TS2301%'")
    return d.live_handles(handles, stored)[1]


@add(
    "a31_rolling_state",
    duckdb("v_audit")
    + " SELECT key, seq, used FROM (SELECT session_id AS key, seq, CAST(ceil((sum(len(concat(action, ' ', path)) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC) - 1) / 4.0) AS BIGINT) AS used, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM v_audit) x WHERE used <= 60 OR r = 1",
)
def a31(spark, sf_dir):
    e = view(spark, sf_dir, "v_audit").select(F.col("session_id").alias("key"), "seq", F.concat_ws(" ", "action", "path").alias("entry"))
    return d.rolling_state(e, 60)


@add(
    "a32_budgeted_selection",
    duckdb("v_audit")
    + " SELECT id, key, CAST(ceil((sum(len(path) + 1) OVER (PARTITION BY session_id ORDER BY bytes_in DESC, id) + 40) / 4.0) AS BIGINT) <= 100 AS included FROM (SELECT *, session_id AS key FROM v_audit WHERE bytes_in IS NOT NULL) x",
)
def a32(spark, sf_dir):
    items = view(spark, sf_dir, "v_audit").where("bytes_in IS NOT NULL").select("id", F.col("session_id").alias("key"), F.col("bytes_in").alias("confidence"), F.col("path").alias("text"))
    return d.within_budget(items, 40, 100).select("id", "key", "included")


@add("a33_prior_paths", duckdb("v_serves") + " SELECT s.seq, p.prior_path FROM v_serves s JOIN (SELECT content, max_by(path, seq) AS prior_path FROM v_serves GROUP BY content) p USING (content)")
def a33(spark, sf_dir):
    s = view(spark, sf_dir, "v_serves")
    return d.prior_paths(s.select("seq", "content"), s).select("seq", "prior_path")


@add(
    "a34_session_attribution",
    duckdb("v_audit")
    + """ SELECT repo, seq, coalesce(last, provided, 'unknown') AS session_id FROM (SELECT *, last_value(reg IGNORE NULLS) OVER (PARTITION BY repo ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM
 (SELECT path AS repo, ts, 1 AS kind, seq, CAST(NULL AS VARCHAR) AS reg, CASE WHEN seq % 2 = 0 THEN session_id END AS provided FROM v_audit WHERE action <> 'rewrite'
 UNION ALL SELECT path, ts, 0, NULL, session_id, NULL FROM v_audit WHERE action = 'rewrite') x) y WHERE kind = 1""",
)
def a34(spark, sf_dir):
    """Rewrite events stand for session registrations of their path's repository."""
    a = view(spark, sf_dir, "v_audit").withColumn("repo", F.col("path"))
    events = a.where("action <> 'rewrite'").withColumn("provided", F.when(F.col("seq") % 2 == 0, F.col("session_id")))
    return d.attributed_sessions(events, a.where("action = 'rewrite'"))


@add("s10_served_files", duckdb("v_serves") + " SELECT session_id, path, content, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY ts DESC, seq DESC) AS r FROM v_serves) x WHERE r = 1")
def s10(spark, sf_dir):
    return d.latest_serves(view(spark, sf_dir, "v_serves")).select("session_id", "path", "content", "seq")


def _rewrites(command: str) -> str:
    tail = f"regexp_replace({command}, {_sql(patterns.CD_PREFIX)}, '')"
    denied = " OR ".join(f"regexp_matches(regexp_replace({tail}, {_sql(patterns.MERGED_OUTPUT)}, ' ', 'g'), {_sql('(?i)' + p)})" for _, p in patterns.REWRITE_DENY)
    return f"CASE WHEN {denied} THEN NULL " + " ".join(f"WHEN regexp_matches({tail}, {_sql('(?i)' + p)}) THEN '{n}'" for n, p in patterns.REWRITE_ALLOW) + " END"


_COMMANDS = """CASE event_id % 9 WHEN 0 THEN 'cd app && npm run build' WHEN 1 THEN 'TSC -p . 2>&1' WHEN 2 THEN 'npm test >&out' WHEN 3 THEN 'rm -rf dist' WHEN 4 THEN 'pnpm run lint'
 WHEN 5 THEN 'node scripts/verify-a.mjs' WHEN 6 THEN 'npx vitest | tail' WHEN 7 THEN 'cd a && cd b && jest' ELSE concat('node run.js ', user_id) END"""


@add("a03_rewrite_rules", f"SELECT event_id, command, {_rewrites('command')} AS rule FROM (SELECT event_id, {_COMMANDS} AS command FROM events) x")
def a03(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", F.expr(_COMMANDS).alias("command"))
    return c.withColumn("rule", d.rewrite_rule(F.col("command")))


_REPOS = "CASE event_id % 4 WHEN 0 THEN '/work/a' WHEN 1 THEN '/work/a/' WHEN 2 THEN '/work/b' END"


@add("a35_foreign_events", "SELECT concat('refuse-', event_id) AS id, concat('s', user_id) AS session_id, 'refuse' AS action, 'event of another repository refused: /work/b' AS reason FROM events WHERE event_id % 4 = 2")
def a35(spark, sf_dir):
    """Every fourth event comes from another repository."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(_REPOS).alias("repo"))
    return d.foreign_events(e, "/work/a")[1]


_JSON = """CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{"id":"e', event_id, '"}') WHEN 2 THEN concat('{"id":"e', event_id, '","timestamp":"2024-01-01T00:00:00Z","module":"m","action":"zoom","reason":"r","bytesIn":-1}')
 WHEN 3 THEN '' ELSE concat('{"id":"e', event_id, '","timestamp":"2024-01-01T00:00:00Z","sessionId":"s', user_id, '","module":"m","action":"', event_type, '","reason":"r","bytesIn":', event_id, '}') END"""


def _json_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id") % 3).alias("file"), F.col("event_id").alias("line_no"), F.expr(_JSON).alias("value"))


@add("s04_audit_scan", "SELECT concat('e', event_id) AS id, concat('s', user_id) AS session_id, event_type AS action, event_id AS bytes_in FROM events WHERE event_id % 6 > 3 AND user_id = 7")
def s04(spark, sf_dir):
    """Of JSON lines of which most are no audit events, those of one session."""
    return records.audit_events(_json_lines(spark, sf_dir), session="s7").select("id", "session_id", "action", "bytes_in")


@add("s04_malformed_audit", "SELECT concat('f', user_id % 3) AS file, count(*) AS lines, count(*) FILTER (WHERE event_id % 6 < 3) AS malformed FROM events WHERE event_id % 6 <> 3 GROUP BY user_id % 3")
def s04m(spark, sf_dir):
    return records.malformed(records.audit_lines(_json_lines(spark, sf_dir)))


_CANDIDATE = """concat('{"id":"c', event_id, '","type":"', CASE event_id % 4 WHEN 0 THEN 'error-fix' WHEN 1 THEN 'recurrence' WHEN 2 THEN 'zoom-hotspot' ELSE 'other' END, '","key":"k","signature":"x","firstSeen":"2024-01-01T00:00:00Z","lastSeen":"2024-01-02T00:00:00.5Z","occurrences":', event_id % 5, '}')"""


@add("s05_candidate_scan", "SELECT concat('c', event_id) AS id, CASE event_id % 4 WHEN 0 THEN 'error-fix' WHEN 1 THEN 'recurrence' ELSE 'zoom-hotspot' END AS type, event_id % 5 AS occurrences, 0::BIGINT AS contradictions, 'candidate' AS status FROM events WHERE event_id % 4 < 3 AND event_id % 5 > 0")
def s05(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), F.expr(_CANDIDATE).alias("value"))
    return records.candidate_records(lines).select("id", "type", "occurrences", "contradictions", "status")


_PATHS = "concat(CASE doc_id % 4 WHEN 0 THEN 'dist/' WHEN 1 THEN 'a/' ELSE '' END, doc_id, CASE doc_id % 5 WHEN 0 THEN '.MD' WHEN 1 THEN '.py' WHEN 2 THEN '.bin' WHEN 3 THEN '.txt' ELSE '' END)"


@add("s07_file_catalogue", f"SELECT {_PATHS} AS path, strlen(text) AS bytes, CASE doc_id % 5 WHEN 0 THEN 'document' WHEN 3 THEN 'document' WHEN 1 THEN 'source' ELSE 'catalogued' END AS status FROM documents WHERE doc_id % 4 > 0")
def s07(spark, sf_dir):
    return records.catalogue(table(spark, sf_dir, "documents").select(F.expr(_PATHS).alias("path"), F.octet_length("text").cast("long").alias("bytes")))


@add(
    "a18_gate_config",
    duckdb("v_audit", "profiles")
    + """, g AS (SELECT *, relevant_pattern IS NOT NULL OR entity_set IS NOT NULL AS on_ FROM profiles)
 SELECT id, profile, on_ AS entity_on, CASE WHEN on_ THEN coalesce(entity_set, 'code') END AS entity_set, CASE WHEN on_ THEN least_ratio END AS least_ratio, CASE WHEN on_ THEN line_limit END AS line_limit, coalesce(verdict, false) AS verdict_on, most_ratio, least_bytes,
 concat_ws(',', CASE WHEN NOT on_ THEN 'entity' END, CASE WHEN NOT coalesce(g.verdict, false) THEN 'verdict' END) AS off FROM (SELECT id, profile AS own, event_id_ FROM (SELECT id, profile, seq AS event_id_ FROM v_audit) y) a JOIN g ON g.profile = CASE event_id_ % 4 WHEN 0 THEN 'doc-serve' WHEN 1 THEN 'generic-stdout' ELSE own END""",
)
def a18(spark, sf_dir):
    """The gates that hold for every event, by its profile."""
    from ..functions import dims

    own = F.when(F.col("seq") % 4 == 0, "doc-serve").when(F.col("seq") % 4 == 1, "generic-stdout").otherwise(F.col("profile"))
    events = view(spark, sf_dir, "v_audit").select("id", own.alias("profile"))
    return events.join(F.broadcast(d.gate_config(dims.frame(spark, "profiles"))), "profile")
