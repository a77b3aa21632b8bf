"""Queries of benchmark analytics, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import bench as b
from ..operators import usage as u
from .registry import Registry, rounded
from .usage import _COST, _PRICED, turns
from .views import duckdb, view

R = Registry()
add = R.add
_M = (
    duckdb("v_usage_turns", "v_runs", "v_audit", "prices")
    + f""", {_PRICED}, {_COST}, m AS (SELECT r.*, CAST(coalesce(s.total, 0) AS BIGINT) AS tokens, CAST(coalesce(s.total - s.reads, 0) AS BIGINT) AS non_cache, coalesce(c.cost, 0) AS cost, coalesce(s.turns, 0) AS turns
 FROM v_runs r LEFT JOIN (SELECT session_id, sum(input + output + cache_read + cache_write + thinking) AS total, sum(cache_read) AS reads, max(turn) AS turns FROM v_usage_turns GROUP BY session_id) s USING (session_id) LEFT JOIN cost c USING (session_id)),
med AS (SELECT task, {', '.join(f"coalesce(median({c}) FILTER (WHERE variant = '{v}'), 0) AS {v}_{c}" for v in ('baseline', 'treated') for c in ('tokens', 'cost', 'non_cache'))},
 {', '.join(f"count(*) FILTER (WHERE variant = '{v}') AS {v}_runs, count(*) FILTER (WHERE variant = '{v}' AND success) AS {v}_passed" for v in ('baseline', 'treated'))} FROM m GROUP BY task),
red AS (SELECT task, {', '.join(f"CASE WHEN treated_{c} = 0 THEN 0 ELSE CAST(baseline_{c} AS DOUBLE) / treated_{c} END AS {c}_reduction" for c in ('tokens', 'cost', 'non_cache'))} FROM med WHERE baseline_runs > 0 AND treated_runs > 0)"""
)


def runs(spark, sf_dir):
    t = turns(spark, sf_dir)
    return b.measured(view(spark, sf_dir, "v_runs"), u.session_totals(t), u.session_cost(t, dims.frame(spark, "prices")), t)


@add("b01_run_measurements", _M + " SELECT task, variant, rep, session_id, success, tokens, non_cache, round(cost, 6) AS cost, CAST(turns AS INT) AS turns FROM m")
def b01(spark, sf_dir):
    return rounded(runs(spark, sf_dir))




@add(
    "b02_success_checks",
    duckdb("v_runs")
    + """ SELECT task, variant, rep, CASE task WHEN 'task2' THEN starts_with(CAST(rep AS VARCHAR), '1') WHEN 'task3' THEN regexp_matches(CAST(rep AS VARCHAR), '^[02]') WHEN 'task4' THEN rep <> 0 WHEN 'task5' THEN false ELSE true END AS passed,
 CAST(CASE WHEN task IN ('task1', 'task2', 'task3', 'task4', 'task5') THEN 1 ELSE 0 END AS BIGINT) AS checks FROM v_runs""",
)
def b02(spark, sf_dir):
    """A needle counts inside a longer text, so ``rep 1`` also stands in ``rep 10``."""
    r = view(spark, sf_dir, "v_runs")
    checks = spark.createDataFrame(
        [
            ("task1", 1, "file-exists", "a.ts", None, None),
            ("task2", 2, "file-contains", "a.ts", "rep 1", "both"),
            ("task3", 3, "file-matches", "a.ts", "REP [02]", None),
            ("task4", 4, "file-changed", "a.ts", None, None),
            ("task5", 5, "answer-contains", "ANSWER.md", "X", None),
        ],
        "task string, check_id int, kind string, path string, needle string, variant string",
    )
    content = F.concat(F.lit("rep "), F.col("rep"))
    files = r.select("session_id", F.lit("a.ts").alias("path"), content.alias("content"), F.lit("rep 0").alias("baseline"))
    return b.run_checks(r, checks, files)


_R = lambda c: f"round({c}, 6) AS {c}"


@add(
    "b03_task_medians",
    _M + " SELECT task, " + ", ".join(_R(f"{v}_{c}") for v in ("baseline", "treated") for c in ("tokens", "cost", "non_cache")) + ", baseline_runs, treated_runs, baseline_passed, treated_passed FROM med",
)
def b03(spark, sf_dir):
    return rounded(b.task_medians(runs(spark, sf_dir)))


@add("b04_reductions", _M + " SELECT task, " + ", ".join(_R(f"{c}_reduction") for c in ("tokens", "cost", "non_cache")) + " FROM red")
def b04(spark, sf_dir):
    return rounded(b.reductions(b.task_medians(runs(spark, sf_dir))))


@add(
    "b05_verdict",
    _M
    + """ SELECT round(tokens, 6) AS tokens, round(cost, 6) AS cost, round(non_cache, 6) AS non_cache, round(br, 6) AS baseline_rate, round(tr, 6) AS treated_rate, round(CASE WHEN br = 0 THEN 1 ELSE tr / br END, 6) AS parity,
 tokens >= 10 AS reduction_met, CASE WHEN br = 0 THEN 1 ELSE tr / br END >= 0.95 AS parity_met
 FROM (SELECT coalesce(median(tokens_reduction), 0) AS tokens, coalesce(median(cost_reduction), 0) AS cost, coalesce(median(non_cache_reduction), 0) AS non_cache FROM red) a,
 (SELECT coalesce(sum(baseline_passed) / nullif(CAST(sum(baseline_runs) AS DOUBLE), 0), 0) AS br, coalesce(sum(treated_passed) / nullif(CAST(sum(treated_runs) AS DOUBLE), 0), 0) AS tr FROM med) s""",
)
def b05(spark, sf_dir):
    return rounded(b.verdict(b.task_medians(runs(spark, sf_dir))))


@add(
    "b06_failures",
    _M + " SELECT task, rep, session_id FROM m WHERE variant = 'treated' AND NOT success AND task IN (SELECT task FROM red WHERE tokens_reduction > 1) AND EXISTS (SELECT 1 FROM m n WHERE n.variant = 'baseline' AND n.success AND n.task = m.task AND n.rep = m.rep)",
)
def b06(spark, sf_dir):
    m = runs(spark, sf_dir)
    return b.failures(m, b.task_medians(m))


@add("b07_last_turns", duckdb("v_usage_turns") + " SELECT session_id, max(turn) AS turns FROM v_usage_turns GROUP BY session_id")
def b07(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("session_id").agg(F.max("turn").alias("turns"))


@add(
    "b08_attribution",
    duckdb("v_audit")
    + " SELECT session_id, count(*) FILTER (WHERE action = 'zoom') AS zooms, count(*) FILTER (WHERE query IS NOT NULL) AS enrichment_serves, CAST(2 * count(*) FILTER (WHERE rule = 'build') AS BIGINT) AS learned, CAST(count(*) FILTER (WHERE rule = 'read-mirror') AS BIGINT) AS pitfalls FROM v_audit GROUP BY session_id",
)
def b08(spark, sf_dir):
    a = view(spark, sf_dir, "v_audit").withColumns(
        {
            "enrichment": F.col("query"),
            "learned": F.when(F.col("rule") == "build", F.array(F.lit("a"), F.lit("b"))),
            "pitfalls": F.when(F.col("rule") == "read-mirror", F.array(F.lit("c"))),
        }
    )
    return b.attribution(a)


_SEQ = "CAST(substr(task, 5) AS INT) + 1"
_SLOPE = f""", placed AS (SELECT *, {_SEQ} AS place FROM m WHERE {_SEQ} <= 5),
sl AS (SELECT variant, {', '.join(f"coalesce(median({c}) FILTER (WHERE place = {p}), 0) AS {c}_{n}" for c in ('tokens', 'turns') for n, p in (('first', 1), ('last', 5)))},
 count(*) FILTER (WHERE place = 1) AS runs_first, count(*) FILTER (WHERE place = 5) AS runs_last,
 coalesce(count(*) FILTER (WHERE place = 5 AND success) / nullif(CAST(count(*) FILTER (WHERE place = 5) AS DOUBLE), 0), 0) AS rate_last FROM placed GROUP BY variant)"""


def _slopes(spark, sf_dir):
    seq = spark.createDataFrame([(f"task{i}", i + 1) for i in range(5)], "task string, place int")
    return b.slopes(runs(spark, sf_dir), seq)


@add(
    "b09_slopes",
    _M + _SLOPE + " SELECT variant, tokens_first, tokens_last, turns_first, turns_last, runs_first, runs_last, round(rate_last, 6) AS rate_last, round(CASE WHEN tokens_first = 0 THEN 0 ELSE tokens_last / tokens_first END, 6) AS token_ratio, round(CASE WHEN turns_first = 0 THEN 0 ELSE turns_last / turns_first END, 6) AS turn_ratio FROM sl",
)
def b09(spark, sf_dir):
    return rounded(_slopes(spark, sf_dir))


@add(
    "b10_criteria",
    _M
    + _SLOPE
    + """, one AS (SELECT t.runs_first > 0 AND t.runs_last > 0 AND t.tokens_last < t.tokens_first AND t.turns_last < t.turns_first AS ex, t.runs_last > 0 AND v.runs_last > 0 AND t.rate_last >= v.rate_last AND t.tokens_last < v.tokens_last AS pays,
 (SELECT count(*) FROM v_audit WHERE query IS NOT NULL) > 0 AS eng FROM sl t, sl v WHERE t.variant = 'treated' AND v.variant = 'baseline')
 SELECT 'slope-exists' AS criterion, CASE WHEN NOT ex THEN 'NOT MET' WHEN NOT eng THEN 'MET-UNATTRIBUTED' ELSE 'MET' END AS label FROM one UNION ALL SELECT 'learning-pays', CASE WHEN NOT pays THEN 'NOT MET' WHEN NOT eng THEN 'MET-UNATTRIBUTED' ELSE 'MET' END FROM one
 UNION ALL SELECT 'mechanism-engaged', CASE WHEN eng THEN 'MET' ELSE 'NOT MET' END FROM one""",
)
def b10(spark, sf_dir):
    events = view(spark, sf_dir, "v_audit").agg(F.count("query").alias("events"))
    return b.criteria(_slopes(spark, sf_dir), events)


@add("b12_cumulative_spend", _M + " SELECT round(sum(cost), 6) AS spend, round(count(*) * CAST(0.01 AS DOUBLE), 6) AS reported FROM m")
def b12(spark, sf_dir):
    return rounded(runs(spark, sf_dir).agg(F.sum("cost").alias("spend"), (F.count("*") * 0.01).alias("reported")))


@add("b13_mined_sessions", duckdb("v_runs", "v_audit") + " SELECT task, variant, rep, session_id FROM v_runs WHERE session_id IN (SELECT session_id FROM v_audit WHERE seq % 11 = 0)")
def b13(spark, sf_dir):
    """Every eleventh audit event stands for a completed mining run."""
    a = view(spark, sf_dir, "v_audit").withColumn("module", F.when(F.col("seq") % 11 == 0, "sidecar.graduation").otherwise(F.col("module")))
    return b.mined_sessions(view(spark, sf_dir, "v_runs"), a).select("task", "variant", "rep", "session_id")


@add(
    "b14_result_table",
    _M
    + """, planned AS (SELECT DISTINCT task, variant, rep FROM v_runs UNION SELECT DISTINCT task, variant, CAST(99 AS BIGINT) FROM v_runs)
 SELECT p.task, p.variant, p.rep, CASE WHEN m.session_id IS NULL THEN 'not run' WHEN success THEN 'pass' ELSE 'fail' END AS status, tokens, round(cost, 6) AS cost FROM planned p LEFT JOIN m ON m.task = p.task AND m.variant = p.variant AND m.rep = p.rep""",
)
def b14(spark, sf_dir):
    m = runs(spark, sf_dir)
    planned = m.select("task", "variant", "rep").union(m.select("task", "variant", F.lit(99).cast("long"))).distinct()
    return rounded(b.result_table(m, planned))


_TASKS = "tasks AS (SELECT concat('t', o_custkey) AS task, concat('r', min(o_orderkey) % 2) AS repo, 'c' AS commit, CASE WHEN o_custkey % 3 = 0 THEN 'slope' ELSE 'base' END AS tier FROM orders GROUP BY o_custkey), seq AS (SELECT concat('t', c_custkey) AS task FROM customer WHERE c_nationkey < 12)"


@add(
    "b11_sequence_violations",
    f"WITH {_TASKS} SELECT task, 'unknown task' AS violation FROM seq WHERE task NOT IN (SELECT task FROM tasks) UNION ALL SELECT s.task, 'more than one repository pin' FROM seq s JOIN tasks t USING (task) WHERE (SELECT count(DISTINCT (repo, commit)) FROM seq JOIN tasks USING (task)) > 1 UNION ALL SELECT task, 'slope task not in the sequence' FROM tasks WHERE tier = 'slope' AND task NOT IN (SELECT task FROM seq)",
)
def b11(spark, sf_dir):
    """Customers with orders are tasks, those of some nations the sequence."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    tasks = read("orders").groupBy("o_custkey").agg(F.concat(F.lit("r"), F.min("o_orderkey") % 2).alias("repo"))
    tier = F.when(F.col("o_custkey") % 3 == 0, "slope").otherwise("base")
    tasks = tasks.select(F.concat(F.lit("t"), "o_custkey").alias("task"), "repo", F.lit("c").alias("commit"), tier.alias("tier"))
    sequence = read("customer").where("c_nationkey < 12").select(F.concat(F.lit("t"), "c_custkey").alias("task"))
    return b.sequence_violations(sequence, tasks)
