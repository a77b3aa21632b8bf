"""Queries of the usage ledger, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import usage as u
from ..sources import transcripts as tr
from .registry import Registry, rounded
from .views import duckdb, view

R = Registry()
add = R.add


def turns(spark, sf_dir):
    t = view(spark, sf_dir, "v_usage_turns")
    return t.withColumn("tools", F.when(F.col("tools") == "", F.array().cast("array<string>")).otherwise(F.split("tools", ",")))


def audit(spark, sf_dir):
    return view(spark, sf_dir, "v_audit")


def transcript_lines(spark, sf_dir):
    """v_usage_turns as JSON lines: a user line before every turn, a turn with two tools as two records of one
    message id, and at the end of each file a line of broken JSON, one without type, one of unknown type, an array and a blank one."""
    t = turns(spark, sf_dir)
    split = F.struct(F.col("cache_write_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h").alias("ephemeral_1h_input_tokens"))

    def usage(extra):
        return F.struct(
            (F.col("input") + extra).alias("input_tokens"),
            F.col("output").alias("output_tokens"),
            F.col("cache_read").alias("cache_read_input_tokens"),
            F.col("cache_write").alias("cache_creation_input_tokens"),
            F.when(F.col("cache_write_assumed") == 0, split).alias("cache_creation"),
            F.col("thinking").alias("thinking_tokens"),
        )

    def record(tool, extra):
        content = F.when(tool.isNotNull(), F.array(F.struct(F.lit("tool_use").alias("type"), tool.alias("name")))).otherwise(
            F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name")))
        )
        message = F.struct(
            F.concat_ws("-", F.lit("m"), "session_id", "turn").alias("id"), "model", content.alias("content"), usage(F.lit(extra)).alias("usage")
        )
        return F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("session_id").alias("sessionId"), message.alias("message")))

    user = F.to_json(F.struct(F.lit("user").alias("type"), F.col("session_id").alias("sessionId")))
    lines = F.array_compact(F.array(user, record(F.get("tools", F.lit(0)), 0), F.when(F.size("tools") > 1, record(F.get("tools", F.lit(1)), 1))))
    good = t.select(
        F.concat("session_id", F.lit(".jsonl")).alias("file"), "turn", F.posexplode(lines).alias("i", "value")
    ).select("file", (F.col("turn") * 10 + F.col("i")).cast("long").alias("line_no"), "value")
    bad = F.array(*[F.lit(x) for x in ("{broken", '{"x": 1}', '{"type": "progress"}', "[1]", "  \r")])
    tail = t.select(F.concat("session_id", F.lit(".jsonl")).alias("file")).distinct()
    tail = tail.select("file", F.posexplode(bad).alias("i", "value")).select("file", (F.col("i") + 1_000_000).cast("long").alias("line_no"), "value")
    return tr.tidy_lines(good.unionByName(tail))


T, P, E, C, G, A = "v_usage_turns", "prices", "energy", "curve", "grid", "v_audit"
_N = "CASE tools WHEN '' THEN 0 WHEN 'Read' THEN 1 ELSE 2 END"


@add(
    "s01_transcript_lines",
    duckdb(T) + f" SELECT concat(session_id, '.jsonl') AS file, CAST(count(*) + sum(CASE WHEN tools = 'Read,Bash' THEN 2 ELSE 1 END) + 4 AS BIGINT) AS lines FROM {T} GROUP BY session_id",
)
def s01(spark, sf_dir):
    return transcript_lines(spark, sf_dir).groupBy("file").agg(F.count("*").alias("lines"))


_COUNTS = (
    f"SELECT concat(session_id, '.jsonl') AS file, CAST(count(*) + sum(CASE WHEN tools = 'Read,Bash' THEN 2 ELSE 1 END) + 4 AS BIGINT) AS lines,"
    f" CAST(count(*) + sum(CASE WHEN tools = 'Read,Bash' THEN 2 ELSE 1 END) AS BIGINT) AS known, CAST(1 AS BIGINT) AS unknown_type, CAST(3 AS BIGINT) AS malformed FROM {T} GROUP BY session_id"
)


@add("s02_line_classes", duckdb(T) + " " + _COUNTS)
def s02(spark, sf_dir):
    return tr.line_counts(tr.classify(transcript_lines(spark, sf_dir)))


@add(
    "s03_skip_audit",
    duckdb(T)
    + f" SELECT file, 'meter.parser' AS module, 'skip' AS action, concat('skipped ', unknown_type + malformed, ' of ', lines, ' lines while parsing (', unknown_type, ' unknown type, ', malformed, ' malformed)') AS reason FROM ({_COUNTS}) c",
)
def s03(spark, sf_dir):
    return tr.skip_audit(tr.line_counts(tr.classify(transcript_lines(spark, sf_dir))))


_TALLY = "input, output, cache_read, cache_write, cache_write_5m, cache_write_1h, cache_write_assumed, thinking"
# a split that is there but for an assumed tier is left out of the line, so it comes back as assumed
_FOLD = f"SELECT session_id, turn, model, tools, {_TALLY} FROM {T}"


@add("u05_turn_folding", duckdb(T) + " " + _FOLD)
def u05(spark, sf_dir):
    classified = tr.classify(transcript_lines(spark, sf_dir))
    ledger = tr.turn_ledger(tr.fold_turns(classified), tr.session_ids(classified))
    return ledger.select("session_id", "turn", "model", F.array_join("tools", ",").alias("tools"), *u.COUNTERS)


@add("u02_cache_write_tiers", duckdb(T) + f" SELECT CAST(sum(cache_write_5m) AS BIGINT) AS five, CAST(sum(cache_write_1h) AS BIGINT) AS hour, CAST(sum(cache_write_assumed) AS BIGINT) AS assumed, model FROM {T} GROUP BY model")
def u02(spark, sf_dir):
    folded = tr.fold_turns(tr.classify(transcript_lines(spark, sf_dir)))
    return folded.groupBy("model").agg(
        F.sum("cache_write_5m").alias("five"), F.sum("cache_write_1h").alias("hour"), F.sum("cache_write_assumed").alias("assumed")
    )


@add("u04_tool_names", duckdb(T) + f" SELECT tool, count(*) AS n FROM (SELECT unnest(string_split(tools, ',')) AS tool FROM {T} WHERE tools <> '') x GROUP BY tool")
def u04(spark, sf_dir):
    folded = tr.fold_turns(tr.classify(transcript_lines(spark, sf_dir)))
    return folded.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@add("u06_session_ids", duckdb(T) + f" SELECT DISTINCT concat(session_id, '.jsonl') AS file, session_id FROM {T}")
def u06(spark, sf_dir):
    return tr.session_ids(tr.classify(transcript_lines(spark, sf_dir)))


@add("u07_turn_numbers", duckdb(T) + f" SELECT session_id, turn, '1970-01-01T00:00:00.000Z' AS timestamp FROM {T}")
def u07(spark, sf_dir):
    classified = tr.classify(transcript_lines(spark, sf_dir))
    return tr.turn_ledger(tr.fold_turns(classified), tr.session_ids(classified)).select("session_id", "turn", "timestamp")


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in u.COUNTERS)
_TOTAL = "CAST(sum(input + output + cache_read + cache_write + thinking) AS BIGINT) AS total"


@add("u08_session_totals", duckdb(T) + f" SELECT session_id, count(*) AS turns, {_SUMS}, {_TOTAL} FROM {T} GROUP BY session_id")
def u08(spark, sf_dir):
    return u.session_totals(turns(spark, sf_dir))


_PRICED = f"""priced AS (SELECT t.*, verified, (input * p_in + (output + thinking) * p_out + cache_read * p_read
 + CASE WHEN cache_write_5m + cache_write_1h = 0 THEN cache_write * p_1h ELSE cache_write_5m * p_5m + cache_write_1h * p_1h END) / 1e6 AS cost
 FROM {T} t LEFT JOIN prices p ON p.model = t.model)"""


@add("u09_priced_turns", duckdb(T, P) + f", {_PRICED} SELECT session_id, turn, round(cost, 6) AS cost FROM priced")
def u09(spark, sf_dir):
    return rounded(u.priced_turns(turns(spark, sf_dir), dims.frame(spark, "prices")).select("session_id", "turn", "cost"))


_COST = """cost AS (SELECT session_id, coalesce(sum(cost), 0) AS cost, count(cost) AS priced_turns,
 coalesce(string_agg(DISTINCT CASE WHEN cost IS NULL THEN model END, ',' ORDER BY CASE WHEN cost IS NULL THEN model END), '') AS unpriced_models,
 coalesce(string_agg(DISTINCT CASE WHEN cost IS NOT NULL AND NOT verified THEN model END, ',' ORDER BY CASE WHEN cost IS NOT NULL AND NOT verified THEN model END), '') AS unverified_models
 FROM priced GROUP BY session_id)"""


@add(
    "u10_session_cost",
    duckdb(T, P) + f", {_PRICED}, {_COST} SELECT session_id, round(cost, 6) AS cost, priced_turns, unpriced_models, unverified_models FROM cost",
)
def u10(spark, sf_dir):
    return rounded(u.session_cost(turns(spark, sf_dir), dims.frame(spark, "prices")))


@add(
    "u11_tool_attribution",
    duckdb(T)
    + f" SELECT session_id, tool, count(*) AS calls, round(sum(share), 6) AS output_tokens FROM (SELECT session_id, unnest(string_split(tools, ',')) AS tool, output / CAST({_N} AS DOUBLE) AS share FROM {T} WHERE tools <> '') x GROUP BY session_id, tool",
)
def u11(spark, sf_dir):
    return rounded(u.tool_attribution(turns(spark, sf_dir)))


_MULT = f"""mult AS (SELECT t.*, c.multiplier FROM {T} t JOIN curve c ON t.input + t.cache_read > c.over_ AND (c.up_to IS NULL OR t.input + t.cache_read <= c.up_to))"""


def _wide(sf: str) -> str:
    return sf


@add(
    "u12_context_multiplier",
    duckdb(T, C).replace("AS over", "AS over_") + f", {_MULT.replace('t.input + t.cache_read', '400 * (t.input + t.cache_read)')} SELECT session_id, turn, multiplier FROM mult",
)
def u12(spark, sf_dir):
    """Contexts are scaled by 400 so that every step of the curve occurs."""
    t = turns(spark, sf_dir).withColumns({"input": 400 * F.col("input"), "cache_read": 400 * F.col("cache_read")})
    return u.with_multiplier(t, dims.frame(spark, "curve")).select("session_id", "turn", "multiplier")


_ENERGY = f"""wh AS (SELECT session_id, {', '.join(f"coalesce(sum((input + output + cache_read + cache_write + thinking) / 1e6 * multiplier * e.wh_{b}), 0) AS wh_{b}" for b in ('base', 'low', 'high'))},
 coalesce(string_agg(DISTINCT CASE WHEN e.class IS NULL THEN m.model END, ',' ORDER BY CASE WHEN e.class IS NULL THEN m.model END), '') AS unestimated
 FROM mult m LEFT JOIN energy e ON e.model = m.model GROUP BY session_id)"""
_BASE = duckdb(T, P, E, C, G).replace("AS over", "AS over_") + f", {_PRICED}, {_COST}, {_MULT}, {_ENERGY}"


@add("u13_session_energy", _BASE + " SELECT session_id, round(wh_base, 6) AS wh_base, round(wh_low, 6) AS wh_low, round(wh_high, 6) AS wh_high, unestimated FROM wh")
def u13(spark, sf_dir):
    return rounded(u.session_energy(turns(spark, sf_dir), dims.frame(spark, "energy"), dims.frame(spark, "curve")))


@add(
    "u14_session_carbon",
    _BASE + " SELECT session_id, region, " + ", ".join(f"round(wh_{b} / 1000 * g_per_kwh, 6) AS g_{b}" for b in ("base", "low", "high")) + " FROM wh, grid WHERE region = 'IN'",
)
def u14(spark, sf_dir):
    wh = u.session_energy(turns(spark, sf_dir), dims.frame(spark, "energy"), dims.frame(spark, "curve"))
    return rounded(u.with_carbon(wh, dims.frame(spark, "grid"), "IN").select("session_id", "region", "g_base", "g_low", "g_high"))


_VERB = f"verb AS (SELECT session_id, CAST(floor(avg(output + thinking) + 0.5) AS BIGINT) AS avg_output, count(*) FILTER (WHERE output + thinking > 1500) AS verbose_turns, avg(output + thinking) <= 1500 AS adherent FROM {T} GROUP BY session_id)"


@add("u15_verbosity", duckdb(T) + f", {_VERB} SELECT * FROM verb")
def u15(spark, sf_dir):
    return u.verbosity(turns(spark, sf_dir))


@add("u16_split_advice", duckdb(T) + f" SELECT session_id, max_by(input + cache_read, turn) AS last_context, max_by(input + cache_read, turn) > 120000 AS split FROM {T} GROUP BY session_id")
def u16(spark, sf_dir):
    return u.split_advice(turns(spark, sf_dir))


_SHAPE = f"shape AS (SELECT session_id, count(*) AS n, avg(CASE WHEN tools <> '' THEN 1.0 ELSE 0.0 END) AS density FROM {T} GROUP BY session_id)"
_KIND = "CASE WHEN density < 0.2 THEN 'chat' WHEN density < 0.6 THEN 'mixed' ELSE 'agentic' END"


@add("u17_session_shape", duckdb(T) + f", {_SHAPE} SELECT session_id, round(density, 6) AS density, {_KIND} AS shape FROM shape")
def u17(spark, sf_dir):
    return rounded(u.session_shape(turns(spark, sf_dir)))


_SERVES = f"serves AS (SELECT * FROM {A} WHERE (action IN ('distill', 'serve-raw') OR (action = 'rewrite' AND rule = 'read-mirror' AND NOT coalesce(prepared, false))) AND bytes_in IS NOT NULL AND bytes_out IS NOT NULL)"


@add("u18_measured_serves", duckdb(A) + f", {_SERVES} SELECT id, session_id, action, bytes_in, bytes_out FROM serves")
def u18(spark, sf_dir):
    return u.measured_serves(audit(spark, sf_dir)).select("id", "session_id", "action", "bytes_in", "bytes_out")


_CTX = f"""sums AS (SELECT session_id, sum(bytes_in) AS raw, sum(bytes_out) AS served, count(*) AS serves FROM serves GROUP BY session_id),
ev AS (SELECT session_id, count(*) AS events FROM {A} GROUP BY session_id),
ctx AS (SELECT s.session_id, CASE WHEN events IS NOT NULL AND coalesce(raw, 0) > 0 THEN CAST(greatest(0, least(100, floor(100.0 * (raw - served) / raw + 0.5))) AS BIGINT) END AS context_score,
 CASE WHEN events IS NULL THEN 'no audit events' WHEN coalesce(raw, 0) = 0 THEN 'no raw byte counts' END AS context_reason
 FROM (SELECT DISTINCT session_id FROM {T}) s LEFT JOIN ev USING (session_id) LEFT JOIN sums USING (session_id))"""


@add("u19_context_score", duckdb(T, A) + f", {_SERVES}, {_CTX} SELECT session_id, context_score, context_reason FROM ctx")
def u19(spark, sf_dir):
    return u.context_score(turns(spark, sf_dir), audit(spark, sf_dir))


_OUT = "outs AS (SELECT session_id, CAST(floor(100 * least(1.0, CAST(1500.0 AS DOUBLE) / greatest(avg_output, 1)) + 0.5) AS BIGINT) AS output_score FROM verb)"


@add("u20_output_score", duckdb(T) + f", {_VERB}, {_OUT} SELECT * FROM outs")
def u20(spark, sf_dir):
    return u.output_score(turns(spark, sf_dir))


_CACHE = f"""cache AS (SELECT session_id, CASE WHEN count(*) >= 2 AND coalesce(sum(cache_read + input) FILTER (WHERE turn > 1), 0) > 0
 THEN CAST(floor(CAST(100.0 AS DOUBLE) * sum(cache_read) FILTER (WHERE turn > 1) / sum(cache_read + input) FILTER (WHERE turn > 1) + 0.5) AS BIGINT) END AS cache_score FROM {T} GROUP BY session_id)"""


@add("u21_cache_score", duckdb(T) + f", {_CACHE} SELECT * FROM cache")
def u21(spark, sf_dir):
    return u.cache_score(turns(spark, sf_dir))


_EPO = f"""epo AS (SELECT s.session_id, {_KIND} AS shape, CASE WHEN NOT (unestimated <> '' AND wh_base = 0) THEN CAST(floor(100 * least(CAST(1.0 AS DOUBLE),
 CASE {_KIND} WHEN 'chat' THEN 2.5 WHEN 'mixed' THEN 8 ELSE 25 END / greatest(wh_base / n, 1e-6)) + 0.5) AS BIGINT) END AS energy_score FROM shape s JOIN wh USING (session_id))"""


@add("u22_energy_score", _BASE + f", {_SHAPE}, {_EPO} SELECT * FROM epo")
def u22(spark, sf_dir):
    t = turns(spark, sf_dir)
    return u.energy_score(t, u.session_energy(t, dims.frame(spark, "energy"), dims.frame(spark, "curve")))


_ALL = duckdb(T, P, E, C, G, A).replace("AS over", "AS over_") + f", {_PRICED}, {_COST}, {_MULT}, {_ENERGY}, {_SHAPE}, {_EPO}, {_VERB}, {_OUT}, {_CACHE}, {_SERVES}, {_CTX}"
_W = {"context": 0.35, "output": 0.25, "cache": 0.25, "energy": 0.15}
_SUMW = " + ".join(f"CASE WHEN {k}_score IS NULL THEN 0 ELSE CAST({w} AS DOUBLE) END" for k, w in _W.items())
_SUMV = " + ".join(f"CASE WHEN {k}_score IS NULL THEN 0 ELSE CAST({w} AS DOUBLE) * {k}_score END" for k, w in _W.items())
_NUM = " + ".join(f"CASE WHEN {k}_score IS NULL THEN 0 ELSE 1 END" for k in _W)
_COMP = f"""comp0 AS (SELECT session_id, context_score, context_reason, output_score, cache_score, energy_score, CAST({_NUM} AS BIGINT) AS contributing, CAST(floor(round(({_SUMV}) / ({_SUMW}), 9) + 0.5) AS BIGINT) AS value
 FROM ctx JOIN outs USING (session_id) JOIN cache USING (session_id) JOIN epo USING (session_id)),
comp AS (SELECT *, CASE WHEN contributing >= 3 THEN CASE WHEN value >= 90 THEN 'A' WHEN value >= 80 THEN 'B' WHEN value >= 70 THEN 'C' WHEN value >= 60 THEN 'D' ELSE 'F' END END AS grade FROM comp0),
labels AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN grade IS NULL THEN concat(value, ' (partial, from ', contributing, ' of 4 scores; no grade below 3)')
 WHEN contributing < 4 THEN concat(value, ' (', grade, ', from ', contributing, ' of 4 scores)') ELSE concat(value, ' (', grade, ')') END AS label,
 CASE WHEN value IS NULL THEN 'n/a' WHEN grade IS NULL THEN concat('partial ', contributing, '/4') ELSE grade END AS cell FROM comp)"""


def _composite(spark, sf_dir):
    t = turns(spark, sf_dir)
    return u.composite(t, audit(spark, sf_dir), u.session_energy(t, dims.frame(spark, "energy"), dims.frame(spark, "curve")))


@add("u23_composite", _ALL + f", {_COMP} SELECT session_id, contributing, value, grade FROM comp")
def u23(spark, sf_dir):
    return _composite(spark, sf_dir).select("session_id", "contributing", "value", "grade")


@add("u24_labels", _ALL + f", {_COMP} SELECT session_id, label, cell FROM labels")
def u24(spark, sf_dir):
    return _composite(spark, sf_dir).select("session_id", "label", "cell")


_DOM = f"dom AS (SELECT session_id, model FROM (SELECT session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(turn)) AS r FROM {T} GROUP BY session_id, model) x WHERE r = 1)"


@add("u25_dominant_model", duckdb(T) + f", {_DOM} SELECT * FROM dom")
def u25(spark, sf_dir):
    return u.dominant_model(turns(spark, sf_dir))


_TOK = "CAST(floor({} / 4.0 + 0.5) AS BIGINT)"
_SAVE = f"""{_DOM}, pass AS (SELECT session_id, sum({_TOK.format('coalesce(bytes_in, 0)')}) AS passed FROM {A} WHERE action = 'passthrough' GROUP BY session_id),
sv AS (SELECT d.session_id, d.model, coalesce(serves, 0) AS serves, coalesce({_TOK.format('raw')}, 0) AS raw_tokens, coalesce({_TOK.format('served')}, 0) AS served_tokens, coalesce(passed, 0) AS passed
 FROM dom d LEFT JOIN sums USING (session_id) LEFT JOIN pass USING (session_id)),
save AS (SELECT sv.*, greatest(0, raw_tokens - served_tokens) AS avoided_tokens, p_in, wh_base AS f_base, wh_low AS f_low, wh_high AS f_high, g_per_kwh FROM sv LEFT JOIN prices p ON p.model = sv.model LEFT JOIN energy e ON e.model = sv.model, grid WHERE is_default)"""
_BANDS = ", ".join(f"round(CASE WHEN avoided_tokens > 0 THEN avoided_tokens / 1e6 * f_{b} END, 6) AS wh_{b}" for b in ("base", "low", "high"))
_GRAMS = ", ".join(f"round(CASE WHEN avoided_tokens > 0 THEN avoided_tokens / 1e6 * f_{b} / 1000 * g_per_kwh END, 6) AS g_{b}" for b in ("base", "low", "high"))


@add(
    "u26_session_savings",
    _ALL
    + f""", {_SAVE} SELECT session_id, serves > 0 AS governed, CAST(serves AS BIGINT) AS serves, raw_tokens, served_tokens, CAST(avoided_tokens AS BIGINT) AS avoided_tokens,
 round(CASE WHEN served_tokens > 0 THEN raw_tokens / CAST(served_tokens AS DOUBLE) END, 6) AS ratio, CAST(floor(passed * (1 - CAST(0.4 AS DOUBLE)) + 0.5) AS BIGINT) AS avoidable_tokens,
 round(CASE WHEN avoided_tokens > 0 THEN avoided_tokens * p_in / 1e6 END, 6) AS cost_avoided, {_BANDS}, {_GRAMS} FROM save""",
)
def u26(spark, sf_dir):
    f = lambda n: dims.frame(spark, n)
    return rounded(u.session_savings(turns(spark, sf_dir), audit(spark, sf_dir), f("prices"), f("energy"), f("grid")))


@add(
    "u27_top_distillations",
    duckdb(A)
    + f""", {_SERVES} SELECT session_id, label, ref, avoided_tokens, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY avoided_tokens DESC, seq) AS rank FROM
 (SELECT session_id, seq, CASE WHEN action = 'rewrite' THEN 'read-mirror' ELSE coalesce(profile, module) END AS label, coalesce(CASE WHEN action = 'rewrite' THEN path END, input_ref, id) AS ref,
 greatest(0, {_TOK.format('bytes_in')} - {_TOK.format('bytes_out')}) AS avoided_tokens FROM serves WHERE action IN ('distill', 'rewrite')) x) y WHERE rank <= 3""",
)
def u27(spark, sf_dir):
    return u.top_distillations(audit(spark, sf_dir))


@add("u28_passthroughs", duckdb(A) + f" SELECT session_id, id, coalesce(path, '(unnamed)') AS path, {_TOK.format('coalesce(bytes_in, 0)')} AS raw_tokens FROM {A} WHERE action = 'passthrough'")
def u28(spark, sf_dir):
    return u.passthroughs(audit(spark, sf_dir))


_REPORT = f"""rep AS (SELECT t.session_id, t.turns, t.total, c.cost, c.priced_turns, l.value, l.label, l.context_reason, w.wh_base, w.wh_base / 1000 * 473 AS g_base, CAST(s.avoided_tokens AS BIGINT) AS avoided_tokens, s.serves > 0 AS governed,
 concat_ws('; ', CASE WHEN unpriced_models <> '' THEN concat('no price: ', unpriced_models) END, CASE WHEN unverified_models <> '' THEN concat('unverified price: ', unverified_models) END, CASE WHEN unestimated <> '' THEN concat('no energy factor: ', unestimated) END) AS notes
 FROM (SELECT session_id, count(*) AS turns, {_TOTAL} FROM {T} GROUP BY session_id) t JOIN cost c USING (session_id) JOIN wh w USING (session_id) JOIN labels l USING (session_id) JOIN save s USING (session_id))"""


def _report(spark, sf_dir):
    f = lambda n: dims.frame(spark, n)
    return u.session_report(turns(spark, sf_dir), audit(spark, sf_dir), f("prices"), f("energy"), f("curve"), f("grid"))


@add(
    "u29_session_report",
    _ALL + f", {_COMP}, {_SAVE}, {_REPORT} SELECT session_id, turns, total, round(cost, 6) AS cost, priced_turns, value, label, context_reason, round(wh_base, 6) AS wh_base, round(g_base, 6) AS g_base, avoided_tokens, governed, notes FROM rep",
)
def u29(spark, sf_dir):
    return rounded(_report(spark, sf_dir)).select(
        "session_id", "turns", "total", "cost", "priced_turns", "value", "label", "context_reason", "wh_base", "g_base", "avoided_tokens", "governed", "notes"
    )


@add(
    "u30_receipts",
    _ALL + f", {_COMP}, {_SAVE}, {_REPORT} SELECT session_id, turns, total AS billed_tokens, round(CASE WHEN priced_turns > 0 THEN cost END, 6) AS cost, label, avoided_tokens, governed FROM rep",
)
def u30(spark, sf_dir):
    return rounded(u.receipts(_report(spark, sf_dir)))


@add(
    "u32_reconciliation",
    duckdb(T, P)
    + f""", {_PRICED}, {_COST}, reported AS (SELECT session_id, count(*) * CAST(0.001 AS DOUBLE) AS reported FROM {T} WHERE turn > 1 GROUP BY session_id)
 SELECT session_id, round(cost, 6) AS cost, round(reported, 6) AS reported, round(cost - reported, 6) AS residual, round(100 * (cost - reported) / reported, 6) AS residual_pct FROM cost FULL JOIN reported USING (session_id)""",
)
def u32(spark, sf_dir):
    t = turns(spark, sf_dir)
    reported = t.where("turn > 1").groupBy("session_id").agg((F.count("*") * 0.001).alias("reported"))
    return rounded(u.reconcile(u.session_cost(t, dims.frame(spark, "prices")), reported))


_DIRS = "SELECT concat('/w/', user_id % 50, CASE WHEN event_id % 2 = 0 THEN '/sub' ELSE '' END) AS dir, concat('s', event_id) AS session_id, ts FROM events"


@add(
    "u31_latest_sessions",
    f"WITH s AS ({_DIRS}), p AS (SELECT DISTINCT concat('/w/', user_id % 60, '/sub/x') AS project FROM events), up AS (SELECT project, array_to_string(list_slice(string_split(project, '/'), 1, n), '/') AS dir FROM (SELECT project, unnest(range(1, len(string_split(project, '/')) + 1)) AS n FROM p) x) SELECT project, dir, session_id FROM (SELECT project, dir, session_id, row_number() OVER (PARTITION BY project ORDER BY length(dir) DESC, ts DESC, session_id) AS r FROM up JOIN s USING (dir)) y WHERE r = 1",
)
def u31(spark, sf_dir):
    """Sessions in project folders and their parents; some projects have none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sub = F.when(F.col("event_id") % 2 == 0, "/sub").otherwise("")
    s = e.select(F.concat(F.lit("/w/"), F.col("user_id") % 50, sub).alias("dir"), F.concat(F.lit("s"), "event_id").alias("session_id"), "ts")
    p = e.select(F.concat(F.lit("/w/"), F.col("user_id") % 60, F.lit("/sub/x")).alias("project")).distinct()
    return u.latest_sessions(s, p)


@add("s06_rate_validation", "SELECT event_id, coalesce(value - 50 >= 0 AND value - 50 <= value AND value <= value * (event_id % 3), false) AS valid FROM events")
def s06(spark, sf_dir):
    """Each event's value is a rate with a low and a high one around it, not always in order."""
    from ..functions import dims

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", "value", (F.col("value") - 50).alias("low"), (F.col("value") * (F.col("event_id") % 3)).alias("high"))
    return dims.validated(e, "value", "low", "high").select("event_id", "valid")
