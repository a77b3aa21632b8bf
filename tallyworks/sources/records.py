"""Audit and candidate records as JSON lines, and folders of files; tolerant reading, and the sinks.

``lines``: file, line_no, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import distill, ledger

INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z$"

#: Kinds of candidates, folders that a scan skips, suffixes of indexed sources, largest document.
CANDIDATE_TYPES = ("error-fix", "zoom-hotspot", "recurrence")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", ".claude", "coverage", "backup")
SOURCE_SUFFIXES = ("ts", "tsx", "mts", "js", "mjs", "cjs", "py")
LARGEST_DOCUMENT = 10 * 1024 * 1024


def _get(path: str, kind: str = "string"):
    return F.try_variant_get("record", path, kind)


def _is(path: str, *kinds: str):
    """The value at ``path`` has one of the JSON types; a missing one has none."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get("record", path, "variant")).isin(*kinds), F.lit(False))


def _said(path: str):
    return _is(path, "STRING") & (_get(path) != "")


def _absent_or(path: str, ok):
    return F.try_variant_get("record", path, "variant").isNull() | ok


def _size(path: str):
    return _absent_or(path, _is(path, "BIGINT") & (_get(path, "long") >= 0))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``record`` (variant, null if it is no JSON)."""
    return lines.where(F.trim("value", F.lit(" \t\r")) != "").withColumn("record", F.try_parse_json("value"))


def audit_lines(lines: DataFrame, actions: tuple[str, ...] | None = None) -> DataFrame:
    """Parsed lines with ``valid``: whether a line is an audit event; ``actions`` limits the action's names."""
    ok = _said("$.id") & _said("$.module") & _said("$.action") & _said("$.reason") & _is("$.timestamp", "STRING") & _get("$.timestamp").rlike(INSTANT)
    for path in ("$.sessionId", "$.inputRef", "$.outputRef"):
        ok = ok & _absent_or(path, _is(path, "STRING"))
    ok = ok & _size("$.bytesIn") & _size("$.bytesOut")
    if actions is not None:
        ok = ok & _get("$.action").isin(*actions)
    return parsed(lines).withColumn("valid", F.coalesce(ok, F.lit(False)))


def audit_events(lines: DataFrame, session: str | None = None, actions: tuple[str, ...] | None = None) -> DataFrame:
    """Valid audit events as columns, all or those of one session."""
    columns = {"id": "id", "ts": "timestamp", "session_id": "sessionId", "module": "module", "action": "action", "reason": "reason", "input_ref": "inputRef", "output_ref": "outputRef"}
    rows = audit_lines(lines, actions).where("valid")
    out = rows.select(
        "file", "line_no", *[_get(f"$.{p}").alias(n) for n, p in columns.items()],
        *[_get(f"$.{p}", "long").alias(n) for n, p in (("bytes_in", "bytesIn"), ("bytes_out", "bytesOut"))], _get("$.details", "variant").alias("details"),
    )
    return out if session is None else out.where(F.col("session_id") == session)


def candidate_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines with ``valid``: whether a line is a candidate record."""
    ok = _said("$.id") & _said("$.key") & _said("$.signature") & _get("$.type").isin(*CANDIDATE_TYPES)
    ok = ok & _get("$.firstSeen").rlike(INSTANT) & _get("$.lastSeen").rlike(INSTANT) & _is("$.occurrences", "BIGINT") & (_get("$.occurrences", "long") > 0)
    ok = ok & _absent_or("$.status", _get("$.status").isin("candidate", "graduated", "withdrawn"))
    return parsed(lines).withColumn("valid", F.coalesce(ok, F.lit(False)))


def candidate_records(lines: DataFrame) -> DataFrame:
    """Valid candidates as columns; no status means candidate, no contradiction 0."""
    rows = candidate_lines(lines).where("valid")
    return rows.select(
        "file", "line_no", *[_get(f"$.{p}").alias(n) for n, p in (("id", "id"), ("type", "type"), ("key", "key"), ("signature", "signature"), ("first_seen", "firstSeen"), ("last_seen", "lastSeen"))],
        _get("$.occurrences", "long").alias("occurrences"), F.coalesce(_get("$.contradiction", "long"), F.lit(0)).alias("contradictions"),
        F.coalesce(_get("$.status"), F.lit("candidate")).alias("status"), _get("$.evidence", "array<string>").alias("evidence"),
    )


def malformed(checked: DataFrame) -> DataFrame:
    """Per file: lines that are not blank, and those of them that are no valid record."""
    return checked.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("malformed"))


def catalogue(files: DataFrame, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """Add ``status`` to files (path, bytes): document, out-of-scope (a document too large), source or catalogued; skipped folders go."""
    suffix = F.lower(F.regexp_extract("path", r"[^/]\.([A-Za-z0-9]+)$", 1))
    status = F.when(suffix.isin(*dims.DOCUMENT_SUFFIXES), F.when(F.col("bytes") > LARGEST_DOCUMENT, "out-of-scope").otherwise("document"))
    status = status.when(suffix.isin(*SOURCE_SUFFIXES), "source").otherwise("catalogued")
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    kept = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in skipped])))
    return kept.withColumn("status", status)


def scan_folder(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, bytes, sha256, status) of every file below ``root``; paths are relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), r"/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.when(F.startswith(inside, F.lit(base)), F.substr(inside, F.lit(len(base) + 1))).otherwise(inside)
    files = found.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return catalogue(files, skipped)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Append artifacts (artifact_id, text, date), redacted on the way; no text gets past the redaction."""
    distill.redact(artifacts).write.mode("append").partitionBy("date").parquet(path)


#: Buckets of sessions in the folders of a pruned table.
BUCKETS = 64


def _bucket(session):
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def write_by_month(rows: DataFrame, path: str) -> None:
    """Append rows (session_id, ts, ...) to a table in folders by month and bucket of the session.

    Rows of a folder are brought together first, so that a task writes few files.
    """
    laid = rows.withColumns({"month": F.date_format("ts", "yyyy-MM"), "bucket": _bucket("session_id")})
    laid.repartition("month", "bucket").write.mode("append").partitionBy("month", "bucket").parquet(path)


def read_by_month(spark: SparkSession, path: str, session: str | None = None, month: str | None = None, day: str | None = None) -> DataFrame:
    """Rows of a session, month (yyyy-MM) or day (yyyy-MM-dd) of such a table; only the folders that can hold them are listed and read."""
    rows = spark.read.parquet(path)
    if month or day:
        rows = rows.where(F.col("month") == (month or day[:7]))
    if session is not None:
        # the bucket of a constant is a constant, which Spark folds into the partition filter
        rows = rows.where((F.col("bucket") == _bucket(F.lit(session))) & (F.col("session_id") == session))
    return ledger.scan(rows, session, month, day).drop("month", "bucket")


def write_audit(events: DataFrame, path: str) -> None:
    """Append audit events (session_id, ts, ...), by month and session."""
    write_by_month(events, path)
