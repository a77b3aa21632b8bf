"""Usage ledger: totals, price, energy, carbon, scores and savings of sessions.

Input ``turns``: session_id, turn, model, tools (array) and the counters input,
output, cache_read, cache_write, cache_write_5m, cache_write_1h,
cache_write_assumed, thinking. Rate tables are dimensions of a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims

COUNTERS = [
    "input", "output", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "cache_write_assumed", "thinking",
]
BILLED = ["input", "output", "cache_read", "cache_write", "thinking"]


def tokens(n_bytes):
    """Tokens of a byte count: a quarter, rounded half up."""
    return F.floor(n_bytes / 4.0 + 0.5).cast("long")


def half_up(x):
    return F.floor(x + 0.5).cast("long")


def session_totals(turns: DataFrame) -> DataFrame:
    """Sums of the eight counters; the grand total leaves out the 5 min / 1 h split."""
    grand = sum(F.sum(c) for c in BILLED)
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in COUNTERS], grand.alias("total")
    )


def priced_turns(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` (null if the model has no price). Without a split all cache writes bill at the 1-hour rate."""
    no_split = F.col("cache_write_5m") + F.col("cache_write_1h") == 0
    five = F.when(no_split, F.lit(0)).otherwise(F.col("cache_write_5m"))
    hour = F.when(no_split, F.col("cache_write")).otherwise(F.col("cache_write_1h"))
    cost = (
        F.col("input") * F.col("p_in")
        + (F.col("output") + F.col("thinking")) * F.col("p_out")
        + F.col("cache_read") * F.col("p_read")
        + five * F.col("p_5m")
        + hour * F.col("p_1h")
    ) / 1e6
    return turns.join(F.broadcast(prices), "model", "left").withColumn("cost", cost)


def session_cost(turns: DataFrame, prices: DataFrame) -> DataFrame:
    t = priced_turns(turns, prices)
    models = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("model")))), ",")
    return t.groupBy("session_id").agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count("cost").alias("priced_turns"),
        models(F.col("cost").isNull()).alias("unpriced_models"),
        models(F.col("cost").isNotNull() & ~F.col("verified")).alias("unverified_models"),
    )


def tool_attribution(turns: DataFrame) -> DataFrame:
    """Calls per tool; a turn's output is split evenly over its tools, repeats counted."""
    each = turns.where(F.size("tools") > 0).select(
        "session_id", F.explode("tools").alias("tool"), (F.col("output") / F.size("tools")).alias("share")
    )
    return each.groupBy("session_id", "tool").agg(F.count("*").alias("calls"), F.sum("share").alias("output_tokens"))


def with_multiplier(turns: DataFrame, curve: DataFrame) -> DataFrame:
    """Add ``multiplier``: the first step whose end covers input + cache read, else the last, open-ended one."""
    context = F.col("input") + F.col("cache_read")
    inside = (context > F.col("over")) & (F.col("up_to").isNull() | (context <= F.col("up_to")))
    return turns.join(F.broadcast(curve), inside, "left").drop("over", "up_to")


def session_energy(turns: DataFrame, energy: DataFrame, curve: DataFrame) -> DataFrame:
    """Watt hours of all billed tokens times the context multiplier; models without a factor are listed."""
    t = with_multiplier(turns, curve).join(F.broadcast(energy), "model", "left")
    mtok = sum(F.col(c) for c in BILLED) / 1e6 * F.col("multiplier")
    band = lambda c: F.coalesce(F.sum(mtok * F.col(c)), F.lit(0.0)).alias(c)
    return t.groupBy("session_id").agg(
        band("wh_base"),
        band("wh_low"),
        band("wh_high"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("class").isNull(), F.col("model")))), ",").alias("unestimated"),
    )


def with_carbon(energy: DataFrame, grid: DataFrame, region: str | None = None) -> DataFrame:
    """Add grams of CO2 per band at ``region`` or the default one; an unknown region raises when run."""
    pick = F.col("is_default") if region is None else F.col("region") == region
    row = grid.where(pick).select("region", "g_per_kwh")
    one = lambda c, kind: F.when(F.count("*") == 1, F.first(c)).otherwise(F.raise_error(F.lit("unknown grid region")).cast(kind)).alias(c)
    known = row.agg(one("region", "string"), one("g_per_kwh", "double"))
    found = energy.crossJoin(F.broadcast(known))  # one row
    return found.withColumns({f"g_{b}": F.col(f"wh_{b}") / 1000 * F.col("g_per_kwh") for b in ("base", "low", "high")})


def verbosity(turns: DataFrame) -> DataFrame:
    out = F.col("output") + F.col("thinking")
    return turns.groupBy("session_id").agg(
        half_up(F.avg(out)).alias("avg_output"),
        F.count_if(out > dims.VERBOSE).alias("verbose_turns"),
        (F.avg(out) <= dims.VERBOSE).alias("adherent"),
    )


def split_advice(turns: DataFrame) -> DataFrame:
    context = F.max_by(F.col("input") + F.col("cache_read"), "turn")
    return turns.groupBy("session_id").agg(context.alias("last_context"), (context > dims.SPLIT_TOKENS).alias("split"))


def session_shape(turns: DataFrame) -> DataFrame:
    density = F.avg(F.when(F.size("tools") > 0, 1.0).otherwise(0.0))
    shape = F.when(density < dims.SHAPES[0][0], "chat").when(density < dims.SHAPES[1][0], "mixed").otherwise("agentic")
    return turns.groupBy("session_id").agg(density.alias("density"), shape.alias("shape"))


def measured_serves(audit: DataFrame) -> DataFrame:
    """Events that say what was served instead of which raw bytes."""
    mirror = (F.col("action") == "rewrite") & (F.col("rule") == "read-mirror") & ~F.coalesce("prepared", F.lit(False))
    kinds = F.col("action").isin("distill", "serve-raw") | F.coalesce(mirror, F.lit(False))
    return audit.where(kinds & F.col("bytes_in").isNotNull() & F.col("bytes_out").isNotNull())


def context_score(turns: DataFrame, audit: DataFrame, own_tools: str = dims.OWN_TOOLS) -> DataFrame:
    """Share of touched bytes that never entered the context, or why there is none, per session of ``turns``.

    ``own_tools``: a pattern of the tool names by which a session shows that it was served at all.
    """
    sessions = turns.groupBy("session_id").agg(F.max(F.exists("tools", lambda t: t.rlike(own_tools))).alias("visible"))
    events = audit.groupBy("session_id").agg(F.count("*").alias("events"))
    sums = measured_serves(audit).groupBy("session_id").agg(
        F.count("*").alias("serves"), F.sum("bytes_in").alias("raw"), F.sum("bytes_out").alias("served")
    )
    s = sessions.join(events, "session_id", "left").join(sums, "session_id", "left")
    none, unmeasured = F.col("events").isNull(), F.coalesce(F.col("raw"), F.lit(0)) == 0
    score = F.greatest(F.lit(0), F.least(F.lit(100), half_up(100.0 * (F.col("raw") - F.col("served")) / F.col("raw"))))
    return s.select(
        "session_id",
        F.when(~none & ~unmeasured, score).alias("context_score"),
        F.when(none & F.col("visible"), "not attributable")
        .when(none, "no audit events")
        .when(unmeasured, "no raw byte counts")
        .alias("context_reason"),
    )


def output_score(turns: DataFrame) -> DataFrame:
    v = verbosity(turns)
    ratio = F.lit(float(dims.VERBOSE)) / F.greatest(F.col("avg_output"), F.lit(1))
    return v.select("session_id", half_up(100 * F.least(F.lit(1.0), ratio)).alias("output_score"))


def cache_score(turns: DataFrame) -> DataFrame:
    """Share of cache reads in the cacheable input after the first turn; null if there is none."""
    later = lambda c: F.coalesce(F.sum(F.when(F.col("turn") > 1, F.col(c))), F.lit(0))
    read, fresh = later("cache_read"), later("input")
    score = F.when((F.count("*") >= 2) & (read + fresh > 0), half_up(100.0 * read / (read + fresh)))
    return turns.groupBy("session_id").agg(score.alias("cache_score"))


def energy_score(turns: DataFrame, energy: DataFrame) -> DataFrame:
    """Reference watt hours per turn of the session's shape against its own; ``energy`` is session_energy's."""
    shapes = session_shape(turns).join(turns.groupBy("session_id").agg(F.count("*").alias("n")), "session_id")
    base = F.when(F.col("shape") == "chat", dims.SHAPES[0][2]).when(F.col("shape") == "mixed", dims.SHAPES[1][2]).otherwise(dims.SHAPES[2][2])
    each = F.col("wh_base") / F.col("n")
    score = half_up(100 * F.least(F.lit(1.0), base / F.greatest(each, F.lit(1e-6))))
    missing = (F.col("unestimated") != "") & (F.col("wh_base") == 0)
    return shapes.join(energy, "session_id").select("session_id", "shape", F.when(~missing, score).alias("energy_score"))


def composite(turns: DataFrame, audit: DataFrame, energy: DataFrame) -> DataFrame:
    """The four scores, their weighted mean over those that exist, grade and labels."""
    s = context_score(turns, audit).join(output_score(turns), "session_id").join(cache_score(turns), "session_id")
    s = s.join(energy_score(turns, energy), "session_id")
    names = list(dims.WEIGHTS)
    got = lambda n: F.col(f"{n}_score").isNotNull()
    weight = sum(F.when(got(n), dims.WEIGHTS[n]).otherwise(0.0) for n in names)
    total = sum(F.when(got(n), dims.WEIGHTS[n] * F.col(f"{n}_score")).otherwise(0.0) for n in names)
    s = s.withColumn("contributing", sum(F.when(got(n), 1).otherwise(0) for n in names).cast("long"))
    s = s.withColumn("value", F.when(weight > 0, half_up(F.round(total / weight, 9))))
    grade = F.lit("F")
    for bound, letter in reversed(dims.GRADES):
        grade = F.when(F.col("value") >= bound, letter).otherwise(grade)
    s = s.withColumn("grade", F.when(F.col("contributing") >= dims.MIN_SCORES, grade))
    label = (
        F.when(F.col("value").isNull(), F.lit(None).cast("string"))
        .when(
            F.col("grade").isNull(),
            F.format_string("%d (partial, from %d of 4 scores; no grade below %d)", "value", "contributing", F.lit(dims.MIN_SCORES)),
        )
        .when(F.col("contributing") < 4, F.format_string("%d (%s, from %d of 4 scores)", "value", "grade", "contributing"))
        .otherwise(F.format_string("%d (%s)", "value", "grade"))
    )
    cell = F.when(F.col("value").isNull(), "n/a").when(
        F.col("grade").isNull(), F.format_string("partial %d/4", "contributing")
    ).otherwise(F.col("grade"))
    return s.withColumns({"label": label, "cell": cell})


def dominant_model(turns: DataFrame) -> DataFrame:
    """The model with most turns; the first seen breaks ties."""
    n = turns.groupBy("session_id", "model").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    order = Window.partitionBy("session_id").orderBy(F.desc("n"), "first")
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").select("session_id", "model")


def session_savings(turns: DataFrame, audit: DataFrame, prices: DataFrame, energy: DataFrame, grid: DataFrame) -> DataFrame:
    """Raw, served and avoided tokens of a session and what the avoided ones would have cost."""
    sums = measured_serves(audit).groupBy("session_id").agg(
        F.count("*").alias("serves"),
        tokens(F.sum("bytes_in")).alias("raw_tokens"),
        tokens(F.sum("bytes_out")).alias("served_tokens"),
    )
    passed = passthroughs(audit).groupBy("session_id").agg(F.sum("raw_tokens").alias("passed"))
    s = turns.select("session_id").distinct().join(sums, "session_id", "left").join(passed, "session_id", "left")
    s = s.na.fill(0, ["serves", "raw_tokens", "served_tokens", "passed"])
    s = s.withColumn("avoided_tokens", F.greatest(F.lit(0), F.col("raw_tokens") - F.col("served_tokens")))
    s = s.join(dominant_model(turns), "session_id").join(F.broadcast(prices.select("model", "p_in")), "model", "left")
    s = s.join(F.broadcast(energy), "model", "left")
    s = s.crossJoin(F.broadcast(grid.where("is_default").select("g_per_kwh")))
    some, mtok = F.col("avoided_tokens") > 0, F.col("avoided_tokens") / 1e6
    return s.select(
        "session_id",
        (F.col("serves") > 0).alias("governed"),
        "serves",
        "raw_tokens",
        "served_tokens",
        "avoided_tokens",
        F.when(F.col("served_tokens") > 0, F.col("raw_tokens") / F.col("served_tokens")).alias("ratio"),
        half_up(F.col("passed") * (1 - dims.SIZE_RATIO)).alias("avoidable_tokens"),
        F.when(some, F.col("avoided_tokens") * F.col("p_in") / 1e6).alias("cost_avoided"),
        *[F.when(some, mtok * F.col(f"wh_{b}")).alias(f"wh_{b}") for b in ("base", "low", "high")],
        *[F.when(some, mtok * F.col(f"wh_{b}") / 1000 * F.col("g_per_kwh")).alias(f"g_{b}") for b in ("base", "low", "high")],
    )


def top_distillations(audit: DataFrame, k: int = 3) -> DataFrame:
    """The k distillations of a session that avoided most tokens, rounded row by row; earlier rows break ties."""
    rows = measured_serves(audit).where(F.col("action").isin("distill", "rewrite"))
    avoided = F.greatest(F.lit(0), tokens(F.col("bytes_in")) - tokens(F.col("bytes_out")))
    rewrite = F.col("action") == "rewrite"
    rows = rows.select(
        "session_id",
        "seq",
        F.when(rewrite, "read-mirror").otherwise(F.coalesce("profile", "module")).alias("label"),
        F.coalesce(F.when(rewrite, F.col("path")), "input_ref", "id").alias("ref"),
        avoided.alias("avoided_tokens"),
    )
    order = Window.partitionBy("session_id").orderBy(F.desc("avoided_tokens"), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seq")


def passthroughs(audit: DataFrame) -> DataFrame:
    return audit.where("action = 'passthrough'").select(
        "session_id", "id", F.coalesce("path", F.lit("(unnamed)")).alias("path"), tokens(F.coalesce("bytes_in", F.lit(0))).alias("raw_tokens")
    )


def session_report(turns, audit, prices, energy, curve, grid) -> DataFrame:
    """One row per session: totals, cost, energy, scores, savings and notes."""
    wh = session_energy(turns, energy, curve)
    r = session_totals(turns).select("session_id", "turns", "total")
    r = r.join(session_cost(turns, prices), "session_id").join(with_carbon(wh, grid).select("session_id", "wh_base", "g_base", "unestimated"), "session_id")
    r = r.join(composite(turns, audit, wh).select("session_id", "value", "label", "context_reason"), "session_id")
    r = r.join(session_savings(turns, audit, prices, energy, grid).select("session_id", "avoided_tokens", "governed"), "session_id")
    notes = F.array_compact(
        F.array(
            F.when(F.col("unpriced_models") != "", F.concat(F.lit("no price: "), "unpriced_models")),
            F.when(F.col("unverified_models") != "", F.concat(F.lit("unverified price: "), "unverified_models")),
            F.when(F.col("unestimated") != "", F.concat(F.lit("no energy factor: "), "unestimated")),
        )
    )
    return r.withColumn("notes", F.array_join(notes, "; "))


def receipts(report: DataFrame) -> DataFrame:
    """Session receipt: the cost is null if no turn had a price."""
    return report.select(
        "session_id",
        "turns",
        F.col("total").alias("billed_tokens"),
        F.when(F.col("priced_turns") > 0, F.col("cost")).alias("cost"),
        "label",
        "avoided_tokens",
        "governed",
    )


def reconcile(computed: DataFrame, reported: DataFrame) -> DataFrame:
    """Computed against reported cost per session, either side may lack a row."""
    both = computed.join(reported, "session_id", "full")
    diff = F.col("cost") - F.col("reported")
    return both.select("session_id", "cost", "reported", diff.alias("residual"), (100 * diff / F.col("reported")).alias("residual_pct"))


def latest_sessions(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """The latest session of every project: of its own directory or the nearest ancestor's that has any.

    ``sessions``: dir, session_id, ts; ``projects``: project (a path).
    """
    parts = F.split("project", "/")
    up = projects.select("project", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    found = up.join(sessions, "dir")
    order = Window.partitionBy("project").orderBy(F.desc(F.length("dir")), F.desc("ts"), "session_id")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("project", "dir", "session_id")
