"""Benchmark analytics: run measurements, medians, reductions, parity, slopes and criteria.

``runs``: task, variant (baseline or treated), rep, session_id, success; with
measurements: tokens, cost, non_cache, turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MIN_REDUCTION = 10.0
MIN_PARITY = 0.95


def measured(runs: DataFrame, totals: DataFrame, costs: DataFrame, turns: DataFrame) -> DataFrame:
    """Join runs with their session's figures; a session without turns measures 0."""
    n = turns.groupBy("session_id").agg(F.max("turn").alias("last_turn"))
    m = runs.join(totals.select("session_id", "total", "cache_read"), "session_id", "left")
    m = m.join(costs.select("session_id", "cost"), "session_id", "left").join(n, "session_id", "left")
    m = m.withColumn("non_cache", F.col("total") - F.col("cache_read"))
    return m.select(
        *runs.columns,
        *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("total", "tokens"), ("non_cache", "non_cache"))],
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("last_turn", F.lit(0)).alias("turns"),
    )


def run_checks(runs: DataFrame, checks: DataFrame, files: DataFrame) -> DataFrame:
    """Evaluate success checks and AND them per run.

    ``checks``: task, check_id, kind (file-exists, file-contains, file-matches,
    file-changed, answer-contains), path, needle, variant (null or both: all).
    ``files``: session_id, path, content, baseline (content before the run).
    A run without checks passes.
    """
    all_variants = F.col("c.variant").isNull() | (F.col("c.variant") == "both") | (F.col("c.variant") == F.col("r.variant"))
    due = runs.alias("r").join(checks.alias("c"), (F.col("r.task") == F.col("c.task")) & all_variants, "left")
    due = due.select("r.*", "c.check_id", "c.kind", "c.path", "c.needle")
    f = files.select(F.col("session_id").alias("_s"), F.col("path").alias("_p"), "content", "baseline")
    due = due.join(f, (F.col("session_id") == F.col("_s")) & (F.col("path") == F.col("_p")), "left")
    there = F.col("_p").isNotNull()
    ok = (
        F.when(F.col("kind").isNull(), True)
        .when(F.col("kind") == "file-exists", there)
        .when(F.col("kind") == "file-contains", there & F.contains("content", "needle"))
        .when(F.col("kind") == "file-matches", there & F.expr("content rlike concat('(?i)', needle)"))
        .when(F.col("kind") == "file-changed", there & ~F.col("content").eqNullSafe(F.col("baseline")))
        .when(F.col("kind") == "answer-contains", there & F.contains(F.lower("content"), F.lower("needle")))
        .otherwise(False)
    )
    return due.groupBy("task", "variant", "rep").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passed"), F.count("check_id").alias("checks"))


def task_medians(m: DataFrame) -> DataFrame:
    """True medians per task and variant, 0 where an arm has no run."""
    columns = ("tokens", "cost", "non_cache")
    arms = [(v, F.col("variant") == v) for v in ("baseline", "treated")]
    aggs = [F.coalesce(F.median(F.when(test, F.col(c))), F.lit(0.0)).alias(f"{v}_{c}") for v, test in arms for c in columns]
    runs = [F.count_if(test).alias(f"{v}_runs") for v, test in arms] + [F.count_if(test & F.col("success")).alias(f"{v}_passed") for v, test in arms]
    return m.groupBy("task").agg(*aggs, *runs)


def reductions(medians: DataFrame) -> DataFrame:
    """Baseline over treated per task that has both arms; 0 where the treated median is 0."""
    both = medians.where((F.col("baseline_runs") > 0) & (F.col("treated_runs") > 0))
    ratio = lambda c: F.when(F.col(f"treated_{c}") == 0, 0.0).otherwise(F.col(f"baseline_{c}") / F.col(f"treated_{c}"))
    return both.select("task", *[ratio(c).alias(f"{c}_reduction") for c in ("tokens", "cost", "non_cache")])


def verdict(medians: DataFrame) -> DataFrame:
    """One row: median reductions, success rates, parity, and which bars are met."""
    r = reductions(medians).agg(*[F.coalesce(F.median(f"{c}_reduction"), F.lit(0.0)).alias(c) for c in ("tokens", "cost", "non_cache")])
    rate = lambda v: F.coalesce(F.sum(f"{v}_passed") / F.nullif(F.sum(f"{v}_runs"), F.lit(0)), F.lit(0.0)).alias(f"{v}_rate")
    s = medians.agg(rate("baseline"), rate("treated"))
    parity = F.when(F.col("baseline_rate") == 0, 1.0).otherwise(F.col("treated_rate") / F.col("baseline_rate"))
    out = r.crossJoin(s).withColumn("parity", parity)
    return out.withColumns({"reduction_met": F.col("tokens") >= MIN_REDUCTION, "parity_met": F.col("parity") >= MIN_PARITY})


def failures(m: DataFrame, medians: DataFrame) -> DataFrame:
    """Treated runs that failed though their task saved tokens and the same repetition passed in the baseline."""
    saved = reductions(medians).where("tokens_reduction > 1").select("task")
    passed = m.where("variant = 'baseline' AND success").select("task", "rep")
    lost = m.where("variant = 'treated' AND NOT success")
    return lost.join(saved, "task", "left_semi").join(passed, ["task", "rep"], "left_semi").select("task", "rep", "session_id")


def slopes(m: DataFrame, sequence: DataFrame) -> DataFrame:
    """Per variant: medians at the first and last place of the sequence (task, place) and their ratios."""
    last = sequence.agg(F.max("place").alias("last"))
    placed = m.join(sequence, "task").crossJoin(F.broadcast(last))
    at = lambda c, test: F.coalesce(F.median(F.when(test, F.col(c))), F.lit(0.0))
    first, end = F.col("place") == 1, F.col("place") == F.col("last")
    s = placed.groupBy("variant").agg(
        *[at(c, t).alias(f"{c}_{n}") for c in ("tokens", "turns") for n, t in (("first", first), ("last", end))],
        *[F.count_if(t).alias(f"runs_{n}") for n, t in (("first", first), ("last", end))],
        F.coalesce(F.count_if(end & F.col("success")) / F.nullif(F.count_if(end), F.lit(0)), F.lit(0.0)).alias("rate_last"),
    )
    ratio = lambda c: F.when(F.col(f"{c}_first") == 0, 0.0).otherwise(F.col(f"{c}_last") / F.col(f"{c}_first"))
    return s.withColumns({"token_ratio": ratio("tokens"), "turn_ratio": ratio("turns")})


def criteria(slope: DataFrame, engagement: DataFrame) -> DataFrame:
    """Verdicts of the three criteria; ``engagement``: one row with ``events`` of the mechanism.

    A bar without runs at both places isn't met; one met while the mechanism
    never engaged is met but unattributed.
    """
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    names = ("tokens_first", "tokens_last", "turns_first", "turns_last", "runs_first", "runs_last", "rate_last")
    row = slope.agg(*[pick(v, c).alias(f"{v[0]}_{c}") for v in ("baseline", "treated") for c in names]).crossJoin(engagement)
    exists = (F.col("t_runs_first") > 0) & (F.col("t_runs_last") > 0) & (F.col("t_tokens_last") < F.col("t_tokens_first")) & (F.col("t_turns_last") < F.col("t_turns_first"))
    pays = (F.col("t_runs_last") > 0) & (F.col("b_runs_last") > 0) & (F.col("t_rate_last") >= F.col("b_rate_last")) & (F.col("t_tokens_last") < F.col("b_tokens_last"))
    engaged = F.coalesce(F.col("events") > 0, F.lit(False))
    each = F.array(
        *[
            F.struct(F.lit(n).alias("criterion"), F.coalesce(test, F.lit(False)).alias("passed"), engaged.alias("engaged"))
            for n, test in (("slope-exists", exists), ("learning-pays", pays), ("mechanism-engaged", engaged))
        ]
    )
    label = F.when(~F.col("passed"), "NOT MET").when(~F.col("engaged") & (F.col("criterion") != "mechanism-engaged"), "MET-UNATTRIBUTED").otherwise("MET")
    return row.select(F.inline(each)).select("criterion", label.alias("label"))


def attribution(audit: DataFrame) -> DataFrame:
    """Counters per session: zooms, enrichment serves, injected learned and pitfall entries."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).cast("long")
    return audit.groupBy("session_id").agg(
        F.count_if(F.col("action") == "zoom").alias("zooms"),
        F.count_if(F.coalesce(F.col("enrichment") != "", F.lit(False))).alias("enrichment_serves"),
        n("learned").alias("learned"),
        n("pitfalls").alias("pitfalls"),
    )


def sequence_violations(sequence: DataFrame, tasks: DataFrame) -> DataFrame:
    """What a sequence breaks: unknown tasks, several repositories, slope tasks it doesn't claim."""
    unknown = sequence.join(tasks, "task", "left_anti").select("task", F.lit("unknown task").alias("violation"))
    pinned = sequence.join(tasks, "task")
    pins = pinned.agg(F.count_distinct("repo", "commit").alias("pins"))
    mixed = pinned.crossJoin(F.broadcast(pins)).where("pins > 1").select("task", F.lit("more than one repository pin").alias("violation"))
    unclaimed = tasks.where("tier = 'slope'").join(sequence, "task", "left_anti").select("task", F.lit("slope task not in the sequence").alias("violation"))
    return unknown.unionByName(mixed).unionByName(unclaimed)


def mined_sessions(runs: DataFrame, audit: DataFrame) -> DataFrame:
    """Runs whose session has a completed mining run in the audit."""
    return runs.join(audit.where("module = 'sidecar.graduation'").select("session_id"), "session_id", "left_semi")


def result_table(m: DataFrame, planned: DataFrame) -> DataFrame:
    """All planned runs (task, variant, rep), measured or not, in order."""
    out = planned.join(m, ["task", "variant", "rep"], "left")
    status = F.when(F.col("session_id").isNull(), "not run").when(F.col("success"), "pass").otherwise("fail")
    return out.select("task", "variant", "rep", status.alias("status"), "tokens", "cost").orderBy("task", "variant", "rep")


