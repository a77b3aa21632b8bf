"""Transcript JSONL: tolerant reading, line classes and turn folding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Record types that a transcript may hold.
KNOWN_TYPES = ("user", "assistant", "summary", "system")
#: The counters of a tally.
COUNTERS = ("input", "output", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "cache_write_assumed", "thinking")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of JSONL files, one session per file.

    Files are read in splits; rows of a file are in order by the split's offset
    and, inside a split, by the order in which the scan gives them.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )
    order = Window.partitionBy("file").orderBy("block", "place")
    lines = read.select("file", (F.row_number().over(order) - 1).alias("line_no"), "value")
    return tidy_lines(lines)


def tidy_lines(lines: DataFrame) -> DataFrame:
    """Drop blank lines and the carriage return of CRLF ends."""
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r$", ""))
    return lines.where(F.trim(F.col("value"), F.lit(" \t\r")) != "")


def classify(lines: DataFrame) -> DataFrame:
    """Add ``record`` (variant) and ``class``: malformed, unknown or known. Bad lines stay, none raises."""
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    kind = F.try_variant_get("record", "$.type", "string")
    is_object = F.schema_of_variant("record").startswith("OBJECT")
    typed = F.schema_of_variant(F.try_variant_get("record", "$.type", "variant")) == "STRING"
    return parsed.withColumn(
        "class",
        F.when(F.col("record").isNull() | ~is_object | ~F.coalesce(typed, F.lit(False)), "malformed")
        .when(kind.isin(*KNOWN_TYPES), "known")
        .otherwise("unknown"),
    )


def line_counts(classified: DataFrame) -> DataFrame:
    """Per file: lines, known, unknown_type, malformed."""
    n = lambda c: F.count_if(F.col("class") == c)
    return classified.groupBy("file").agg(
        F.count("*").alias("lines"), n("known").alias("known"), n("unknown").alias("unknown_type"), n("malformed").alias("malformed")
    )


def skip_audit(counts: DataFrame) -> DataFrame:
    """One audit row per file with skipped lines."""
    skipped = F.col("unknown_type") + F.col("malformed")
    return counts.where(skipped > 0).select(
        "file",
        F.lit("meter.parser").alias("module"),
        F.lit("skip").alias("action"),
        F.format_string(
            "skipped %d of %d lines while parsing (%d unknown type, %d malformed)", skipped, "lines", "unknown_type", "malformed"
        ).alias("reason"),
    )


def _count(path: str):
    """A counter of a usage block: finite and not negative is floored, anything else is 0."""
    x = F.try_variant_get("usage", path, "double")
    return F.coalesce(F.when((x >= 0) & (x < float("inf")), F.floor(x)), F.lit(0)).cast("long")


def tally(usage_rows: DataFrame) -> DataFrame:
    """Add the eight counters of ``usage`` (variant).

    A split into 5-minute and 1-hour cache writes counts only if it adds up to
    the total; else the whole goes to 1 hour and counts as assumed.
    """
    five, hour, total = _count("$.cache_creation.ephemeral_5m_input_tokens"), _count("$.cache_creation.ephemeral_1h_input_tokens"), F.col("cache_write")
    rows = usage_rows.withColumns(
        {
            "input": _count("$.input_tokens"),
            "output": _count("$.output_tokens"),
            "cache_read": _count("$.cache_read_input_tokens"),
            "cache_write": _count("$.cache_creation_input_tokens"),
            "thinking": _count("$.thinking_tokens"),
        }
    )
    split = (five + hour == total) & F.try_variant_get("usage", "$.cache_creation", "variant").isNotNull()
    split = F.coalesce(split, F.lit(False))
    return rows.withColumns(
        {
            "cache_write_5m": F.when(split, five).otherwise(0).cast("long"),
            "cache_write_1h": F.when(split, hour).otherwise(total).cast("long"),
            "cache_write_assumed": F.when(split, 0).otherwise(total).cast("long"),
        }
    )


def fold_turns(classified: DataFrame) -> DataFrame:
    """One row per turn: records of one message id (else uuid, else the line itself) fold together.

    Tally, model and time come from the first record; tools of all records are
    joined in line order. One shuffle on (file, key), of counters only.
    """
    get = lambda path, kind="string": F.try_variant_get("record", path, kind)
    rows = classified.where((F.col("class") == "known") & (get("$.type") == "assistant"))
    blocks = F.coalesce(get("$.message.content", "array<struct<type:string,name:string>>"), F.array())
    tools = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), lambda b: b["name"])
    rows = rows.select(
        "file",
        "line_no",
        F.coalesce(get("$.message.id"), get("$.uuid"), F.concat(F.lit("line-"), F.col("line_no"))).alias("key"),
        tools.alias("tools"),
        F.coalesce(get("$.message.model"), F.lit("unknown-model")).alias("model"),
        get("$.timestamp").alias("timestamp"),
        F.try_variant_get("record", "$.message.usage", "variant").alias("usage"),
    )
    head = ["model", "timestamp", *COUNTERS]
    rows = tally(rows).select("file", "line_no", "key", "tools", F.struct(*head).alias("head"))
    folded = rows.groupBy("file", "key").agg(
        F.min("line_no").alias("first_line"),
        F.min_by("head", "line_no").alias("head"),
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "tools"))), lambda x: x["tools"])
        ).alias("tools"),
    )
    return folded.select("file", "key", "first_line", "head.model", "head.timestamp", "tools", *[f"head.{c}" for c in COUNTERS])


def session_ids(classified: DataFrame) -> DataFrame:
    """(file, session_id): the first session id on a known record, else the file's name."""
    sid = F.try_variant_get("record", "$.sessionId", "string")
    known = classified.withColumn("sid", F.when(F.col("class") == "known", sid))
    first = known.groupBy("file").agg(F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("line_no"))).alias("sid"))
    return first.select("file", F.coalesce("sid", F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)).alias("session_id"))


def turn_ledger(folded: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number the turns of each file 1..n in first-seen order; a missing time is 1970."""
    turn = F.row_number().over(Window.partitionBy("file").orderBy("first_line"))
    out = folded.join(sessions, "file").withColumn("turn", turn)
    return out.withColumn("timestamp", F.coalesce("timestamp", F.lit("1970-01-01T00:00:00.000Z")))
