"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text (its blob).
The ledger is a folder of Parquet files with the spans of every blob scanned so
far at a version of the rules. Only pairs of blob and rule version that it lacks
are scanned, each once, however many paths and versions share the blob; their
rows are appended in one write, and the findings of all versions are read from
the ledger. A row that a retried write left twice counts once.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_folder
from .spans import SPAN, count_kind, find_spans, spans_text

#: Raise this when a rule changes: the ledger then has nothing for it.
RULES = "1"
LEDGER = f"blob string, rules string, spans array<{SPAN}>"
BASE = ("assign", "access", "hex")
#: The rules' patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MORE = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    ("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("bearer", r"sk-[A-Za-z0-9]{20,}", "sk-"),
)


def find_secrets(text: Column) -> Column:
    """All spans of one text, by start and then kind.

    ``AKIA[A-Z0-9]+`` of 20 or more characters is the same as at least 16 after
    the first four, because a later AKIA in the same run is shorter; the same
    holds for hex runs. An assignment whose value is too short is consumed all
    the same, so it's matched in full and dropped.
    """
    any_word = F.lower(text)
    guard = reduce(or_, [F.contains(any_word, F.lit(w)) for w in ASSIGN_WORDS])
    always = lambda m: F.lit(True)
    lists = [
        find_spans(text, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, guard),
        find_spans(text, ACCESS, "access", 1, always, F.contains(text, F.lit("AKIA"))),
        find_spans(text, HEX, "hex", 2, always, text.rlike(HEX)),
    ]
    lists += [
        find_spans(text, pattern, kind, 3 + i, always, F.contains(text, F.lit(sign)))
        for i, (kind, pattern, sign) in enumerate(MORE)
    ]
    return F.array_sort(F.concat(*lists))


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared folder; return its path."""
    path = f"{shared_folder(spark)}/ledgers/{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def known_blobs(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, spans) of every blob in the ledger at RULES, once each."""
    rows = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == RULES)
    return rows.groupBy("blob").agg(F.first("spans").alias("spans"))


def _addressed(versions: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.withColumn("text", text).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))


def scan_unseen(versions: DataFrame, ledger: str) -> None:
    """Scan the blobs of ``versions`` (text) that the ledger lacks at RULES and append them.

    Equal texts are one blob: each task drops its own repeats before the
    shuffle, so a hot blob sends one row per task. A null text is the empty blob.
    """
    blobs = _addressed(versions.select("text")).select("blob", "text").dropDuplicates(["blob"])
    blobs = blobs.join(known_blobs(versions.sparkSession, ledger).select("blob").hint("merge"), "blob", "left_anti")
    fresh = blobs.select("blob", F.lit(RULES).alias("rules"), find_secrets(F.col("text")).alias("spans"))
    fresh.write.mode("append").parquet(ledger)


def scan(versions: DataFrame, ledger: str) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return their findings.

    ``versions`` has path and text, one row per historical version of a path;
    other columns are not read. Returns path, blob, spans, one row per row of
    ``versions``: repeated rows give repeated results, a null text has none, a
    null path stays null, an empty table gives an empty result.
    """
    scan_unseen(versions, ledger)
    known = materialize(known_blobs(versions.sparkSession, ledger), "secrets-known")
    return _addressed(versions.select("path", "text")).select("path", "blob").join(known.hint("merge"), "blob").select("path", "blob", "spans")


def digest(findings: DataFrame, key: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return findings.select(
        F.col("path").alias(key),
        *[count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
