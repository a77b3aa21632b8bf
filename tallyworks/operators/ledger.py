"""Corpus ledger: completed lines, rollups, statements and reconciliation.

Ask lines carry an ask's accounting and are only counted; token and cost sums
come from the serve and zoom lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .usage import tokens

SUMS = ["raw_tokens", "served_tokens", "avoided_tokens"]


def complete_lines(lines: DataFrame, rate: DataFrame) -> DataFrame:
    """Pin tokens, cost and energy bands into each line at the reference ``rate`` (one row)."""
    done = lines.withColumns({"raw_tokens": tokens(F.col("raw_bytes")), "served_tokens": tokens(F.col("served_bytes"))})
    done = done.withColumn("avoided_tokens", F.greatest(F.lit(0), F.col("raw_tokens") - F.col("served_tokens")).cast("long"))
    done = done.crossJoin(F.broadcast(rate))
    mtok = F.col("avoided_tokens") / 1e6
    done = done.withColumn("cost", mtok * F.col("p_in"))
    done = done.withColumns({b: mtok * F.col(f"f_{b}") for b in ("base", "low", "high")})
    return done.drop("p_in", "f_base", "f_low", "f_high")


def reference_rate(prices: DataFrame, energy: DataFrame, model: str) -> DataFrame:
    """One row: input price and watt hours of the reference model."""
    row = prices.where(F.col("model") == model).join(energy, "model")
    return row.select("p_in", *[F.col(f"wh_{b}").alias(f"f_{b}") for b in ("base", "low", "high")])


def lines_of_asks(events: DataFrame, asks: DataFrame) -> DataFrame:
    """Ledger lines of an ask's audit ``events`` (ask_id, id, bytes_in, bytes_out, profile, module) and one ask line each.

    ``asks``: ask_id, corpus, session_id, ts, served_bytes, confidence.
    """
    serve = events.where(F.col("bytes_in").isNotNull() & F.col("bytes_out").isNotNull()).join(asks.drop("served_bytes"), "ask_id")
    serve = serve.select(
        "ask_id", "corpus", "session_id", "ts", F.lit("serve").alias("kind"), F.col("bytes_in").alias("raw_bytes"),
        F.col("bytes_out").alias("served_bytes"), F.coalesce("profile", "module").alias("label"), "confidence",
    )
    raw = events.groupBy("ask_id").agg(F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("raw_bytes"))
    ask = asks.join(raw, "ask_id", "left").select(
        "ask_id", "corpus", "session_id", "ts", F.lit("ask").alias("kind"), F.coalesce("raw_bytes", F.lit(0)).alias("raw_bytes"),
        "served_bytes", F.lit(None).cast("string").alias("label"), "confidence",
    )
    return serve.unionByName(ask)


def attributed(lines: DataFrame, artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``document``: of the line's artifact, else of the document index by reference."""
    a = artifacts.select(F.col("artifact").alias("ref"), F.col("path").alias("_a"))
    d = documents.select(F.col("artifact_id").alias("ref"), F.col("path").alias("_d"))
    return lines.join(a, "ref", "left").join(d, "ref", "left").withColumn("document", F.coalesce("_a", "_d")).drop("_a", "_d")


def scan(lines: DataFrame, session: str | None = None, month: str | None = None, day: str | None = None) -> DataFrame:
    """Lines of a session, month (yyyy-MM) or day (yyyy-MM-dd); a range on ``ts``, so it prunes."""
    if session is not None:
        lines = lines.where(F.col("session_id") == session)
    if month is not None:
        start = F.to_timestamp_ntz(F.lit(f"{month}-01"))
        lines = lines.where((F.col("ts") >= start) & (F.col("ts") < F.add_months(F.lit(f"{month}-01").cast("date"), 1).cast("timestamp_ntz")))
    if day is not None:
        lines = lines.where((F.col("ts") >= F.lit(day).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")))
    return lines


def _touched(c: str):
    return F.sum(F.when(F.col("kind") != "ask", F.col(c)))


SCOPES = ("session", "day", "month", "document")


def rollup_totals(lines: DataFrame) -> DataFrame:
    """Totals by scope: corpus with session, day, month, document or alone, in one grouping-sets pass.

    ``sessions`` counts all lines' sessions, ask lines included. A line without
    a session or document counts in no such scope, and in the corpus once.
    """
    named = lines.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "month": F.date_format("ts", "yyyy-MM")})
    by = ["session_id", "day", "month", "document"]
    keys = [F.col(c) for c in ("corpus", *by)]
    g = named.groupingSets([[keys[0], k] for k in keys[1:]] + [[keys[0]]], *keys).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("lines"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("ask", "zoom", "serve")],
        F.count_distinct("session_id").alias("n_sessions"),
        *[F.coalesce(_touched(c), F.lit(0)).alias(c) for c in SUMS],
        F.coalesce(_touched("cost"), F.lit(0.0)).alias("cost"),
    )
    # a key's bit is 0 in the grouping sets that it belongs to, the last key's bit is the lowest
    scope, key = None, None
    for k, (name, c) in enumerate(zip(SCOPES, by)):
        own = F.col("gid").bitwiseAND(1 << (3 - k)) == 0
        scope = F.when(own, name) if scope is None else scope.when(own, name)
        key = F.when(own, F.col(c)) if key is None else key.when(own, F.col(c))
    out = g.select("corpus", scope.otherwise("corpus").alias("scope"), key.otherwise("").alias("key"), "lines", "asks", "zooms", "serves", F.col("n_sessions").alias("sessions"), *SUMS, "cost")
    return out.where("key IS NOT NULL")


def documents_rollup(lines: DataFrame) -> DataFrame:
    """Reads and sums per document of a corpus, the most read first."""
    touched = lines.where((F.col("kind") != "ask") & F.col("document").isNotNull())
    g = touched.groupBy("corpus", "document").agg(
        F.count("*").alias("reads"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("avoided_tokens").alias("avoided_tokens"), F.sum("cost").alias("cost")
    )
    return g.orderBy("corpus", F.desc("reads"), F.desc("avoided_tokens"), "document")


def sessions_rollup(lines: DataFrame) -> DataFrame:
    """Asks and sums per session of a corpus, the one that avoided most first."""
    g = lines.groupBy("corpus", "session_id").agg(
        F.count_if(F.col("kind") == "ask").alias("asks"),
        F.coalesce(_touched("avoided_tokens"), F.lit(0)).alias("avoided_tokens"),
        F.coalesce(_touched("cost"), F.lit(0.0)).alias("cost"),
    )
    return g.orderBy("corpus", F.desc("avoided_tokens"), "session_id")


def asks_by_confidence(lines: DataFrame) -> DataFrame:
    asks = lines.where("kind = 'ask'")
    return asks.groupBy("corpus").agg(
        *[F.count_if(F.col("confidence") == b).alias(b) for b in ("high", "medium", "low")],
        F.count_if(F.col("confidence").isNull()).alias("unrated"),
    )


def top_serves(lines: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("corpus").orderBy(F.desc("avoided_tokens"), "seq")
    serves = lines.where("kind = 'serve'").withColumn("rank", F.row_number().over(order))
    return serves.where(F.col("rank") <= k).select("corpus", "rank", "id", "avoided_tokens")


def statement(lines: DataFrame, month: str, resident: DataFrame, k: int = 5) -> DataFrame:
    """The month's statement per corpus as rows: totals, top documents, top sessions, and the resident size apart.

    ``resident``: corpus, resident_tokens, a figure of its own that never enters the avoided total.
    """
    mine = scan(lines, month=month)
    top = lambda df, key: (
        df.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("a"), key))).where(F.col("rank") <= k)
    )
    touched = mine.where("kind <> 'ask'")
    docs = top(touched.where("document is not null").groupBy("corpus", "document").agg(F.sum("avoided_tokens").alias("a")), "document")
    sessions = top(touched.groupBy("corpus", "session_id").agg(F.sum("avoided_tokens").alias("a")), "session_id")
    total = mine.groupBy("corpus").agg(F.coalesce(_touched("avoided_tokens"), F.lit(0)).alias("a"))
    row = lambda df, kind, key, rank: df.select("corpus", F.lit(kind).alias("kind"), rank.alias("rank"), key.alias("key"), F.col("a").alias("tokens"))
    zero = F.lit(0)
    kept = resident.join(total.select("corpus"), "corpus", "left_semi").withColumn("a", F.col("resident_tokens"))
    return (
        row(total, "total", F.lit(month), zero)
        .unionByName(row(docs, "document", F.col("document"), F.col("rank")))
        .unionByName(row(sessions, "session", F.col("session_id"), F.col("rank")))
        .unionByName(row(kept, "resident", F.lit(""), zero))
    )


def receipts(lines: DataFrame, corpora: list[str] | None = None) -> DataFrame:
    """One receipt per corpus, of the named ones or of all; corpora are never added up."""
    if corpora is not None:
        lines = lines.where(F.col("corpus").isin(corpora))
    return lines.groupBy("corpus").agg(
        F.count_if(F.col("kind") == "ask").alias("asks"),
        *[F.coalesce(_touched(c), F.lit(0)).alias(c) for c in SUMS],
        F.coalesce(_touched("cost"), F.lit(0.0)).alias("cost"),
    )


def reconcile(lines: DataFrame, audit: DataFrame) -> DataFrame:
    """Ledger and audit by audit id: rows that one side lacks or whose bytes differ."""
    a = audit.select(F.col("id").alias("audit_id"), "bytes_in", "bytes_out", F.lit(True).alias("_a"))
    l = lines.select("audit_id", "raw_bytes", "served_bytes", F.lit(True).alias("_l"))  # noqa: E741
    both = l.join(a, "audit_id", "full")
    issue = (
        F.when(F.col("_l").isNull(), "no ledger line")
        .when(F.col("_a").isNull(), "no audit event")
        .when(~(F.col("raw_bytes").eqNullSafe(F.col("bytes_in")) & F.col("served_bytes").eqNullSafe(F.col("bytes_out"))), "bytes differ")
    )
    return both.select("audit_id", issue.alias("issue")).where("issue is not null")


def resident_bytes(artifacts: DataFrame, by: str = "corpus") -> DataFrame:
    """Raw bytes at rest: the latest artifact of every path, or of the artifact itself if it has none."""
    order = Window.partitionBy(by, F.coalesce("path", "id")).orderBy(F.desc("ts"), F.desc("id"))
    latest = artifacts.withColumn("r", F.row_number().over(order)).where("r = 1")
    return latest.groupBy(by).agg(F.sum("raw_bytes").alias("resident_bytes"), F.count("*").alias("artifacts"))
