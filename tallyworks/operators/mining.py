"""Lesson mining over audit events: pairs, hotspots, candidates, confidence, graduation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from .substrings import containing


def signature(line):
    """An error line without its coordinates: numbers in them become #, white space is collapsed, 200 characters."""
    s = F.regexp_replace(line, r"\(\d+,\d+\)", "(#)")
    s = F.regexp_replace(s, r":\d+(:\d+)?", ":#")
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, 200)


def error_signature(distilled, raw):
    """Signature of the first error-like line of an artifact: of its distillate, else of its raw text; its verdict line is none."""

    def first(text):
        lines = F.filter(F.split(text, "\r?\n", -1), lambda x: x.rlike("(?i)error|fail") & ~x.startswith("VERDICT:"))
        return F.try_element_at(lines, F.lit(1))

    return signature(F.regexp_replace(F.coalesce(first(distilled), first(raw)), r"^first error:\s*", ""))


def signed(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``events`` with ``error_signature`` of their artifact (artifact_id, distilled, raw) by input_ref; null without one."""
    told = artifacts.select(F.col("artifact_id").alias("input_ref"), error_signature(F.col("distilled"), F.col("raw")).alias("error_signature"))
    return events.join(told, "input_ref", "left")


def error_fix_pairs(audit: DataFrame) -> DataFrame:
    """A pass whose previous verdict in (session, profile) is a fail, with the files changed between and the last command.

    A change belongs, for each profile of its session, to the verdict before it:
    a running value, no range join.
    """
    order = Window.partitionBy("session_id", "profile").orderBy("ts", "seq")
    v = audit.where(F.col("verdict").isNotNull()).select(
        "session_id", "profile", "seq", "ts", "verdict", F.lag("verdict").over(order).alias("was"), F.lag("seq").over(order).alias("fail_seq")
    )
    pairs = v.where("verdict = 'pass' AND was = 'fail'").select("session_id", "profile", F.col("seq").alias("pass_seq"), "fail_seq")
    changed = audit.where("action = 'distill' AND mode = 'diff'").select("session_id", "seq", "path")
    placed = changed.join(pairs.select("session_id", "profile").distinct(), "session_id")
    marks = v.select("session_id", "profile", "seq", F.lit(None).cast("string").alias("path"), F.col("seq").alias("last_seq"))
    by_seq = Window.partitionBy("session_id", "profile").orderBy("seq", F.col("last_seq").isNull())
    placed = placed.withColumn("last_seq", F.lit(None).cast("long")).unionByName(marks).withColumn("fail_seq", F.last("last_seq", ignorenulls=True).over(by_seq))
    files = placed.where("path IS NOT NULL AND fail_seq IS NOT NULL").groupBy("session_id", "profile", "fail_seq").agg(
        F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files")
    )
    files = pairs.join(files, ["session_id", "profile", "fail_seq"], "left").withColumn("files", F.coalesce("files", F.lit("")))
    commands = audit.where("command IS NOT NULL").select("session_id", F.col("seq").alias("pass_seq"), "command", F.lit(None).cast("long").alias("fail_seq"), F.lit(None).cast("string").alias("profile"), F.lit(None).cast("string").alias("files"))
    both = files.withColumn("command", F.lit(None).cast("string")).unionByName(commands)
    so_far = Window.partitionBy("session_id").orderBy("pass_seq", F.col("fail_seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("command", F.last("command", ignorenulls=True).over(so_far))
    return out.where("fail_seq IS NOT NULL").select("session_id", "profile", "fail_seq", "pass_seq", "files", "command")


def zoom_hotspots(audit: DataFrame, artifacts: DataFrame, least: int = 1) -> DataFrame:
    """Zooms per (session, target): target_kind, zooms, distinct queries by first use, and the first twenty events.

    The target of a zoom is the file of its artifact (``artifacts``: artifact_id,
    path), else the profile of the first distillation of its artifact in the
    session, else unknown-artifact. Only ranked heads are gathered.
    """
    z = audit.where("action = 'zoom' AND input_ref IS NOT NULL").select("session_id", "input_ref", "seq", "id", "query")
    files = artifacts.where("path <> ''").select(F.col("artifact_id").alias("input_ref"), F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("file"))
    first = audit.where("module = 'distill'").groupBy("session_id", "input_ref").agg(F.min_by("profile", "seq").alias("profile"))
    z = z.join(files, "input_ref", "left").join(first, ["session_id", "input_ref"], "left")
    kind = F.when(F.col("file").isNotNull(), "file").when(F.col("profile").isNotNull(), "artifact-class").otherwise("unknown")
    z = z.withColumns({"target": F.coalesce("file", "profile", F.lit("unknown-artifact")), "target_kind": kind})
    key = ["session_id", "target"]
    z = z.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("seq", "id")))
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= EVIDENCE, F.struct("r", "id")))), lambda x: x["id"])
    g = z.groupBy(*key).agg(F.min_by("target_kind", "r").alias("target_kind"), F.count("*").alias("zooms"), head.alias("evidence"))
    asked = z.where("query <> ''").groupBy(*key, "query").agg(F.min("r").alias("r"))
    asked = asked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "query"))), lambda x: x["query"]).alias("queries"))
    out = g.where(F.col("zooms") >= least).join(asked, key, "left")
    return out.withColumn("queries", F.coalesce("queries", F.array().cast("array<string>")))


def candidate_id(kind, key):
    return F.concat(F.lit("cand-"), F.substring(F.sha2(F.concat_ws("\n", kind, key), 256), 1, 8))


def merge_candidates(observed: DataFrame) -> DataFrame:
    """Candidates by (type, key) from ``observed`` (type, key, session_id, ts): an occurrence per session, id from the key's hash."""
    g = observed.groupBy("type", "key").agg(
        F.count_distinct("session_id").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return g.withColumn("id", candidate_id("type", "key"))


MINED = "session_id string, ts timestamp_ntz, nth int, type string, key string, signature string, evidence array<string>, queries array<string>, details string"
STATE = (
    "id string, type string, key string, signature string, evidence array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz, "
    "occurrences long, sessions array<string>, queries array<string>, details string"
)


def mined_candidates(audit: DataFrame, artifacts: DataFrame, records: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """What the sessions of ``audit`` teach: error-fix pairs, zoom hotspots and recurrences, as MINED rows.

    ``artifacts``: artifact_id, path, distilled, raw. ``records``: id, text and
    session_id, made, until of record versions (see ``record_versions``);
    ``first``: the result without ``records``, if it is there already. ts is the
    session's last event; details are JSON.
    """
    mined = _fixes_and_hotspots(audit, artifacts) if first is None else first
    return mined if records is None else mined.unionByName(_recurred(audit, artifacts, records, mined))


def _placed(mined: DataFrame, ended: DataFrame, nth) -> DataFrame:
    return mined.join(ended, "session_id").withColumn("nth", nth).select(*[x.split()[0] for x in MINED.split(", ")])


def _fixes_and_hotspots(audit: DataFrame, artifacts: DataFrame) -> DataFrame:
    events = signed(audit, artifacts)
    ended = audit.groupBy("session_id").agg(F.max("ts").alias("ts"))
    none = F.array().cast("array<string>")
    pairs = error_fix_pairs(audit)
    at = lambda name: events.select("session_id", F.col("seq").alias(f"{name}_seq"), F.col("id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"), *(["error_signature"] if name == "fail" else []))
    pairs = pairs.join(at("fail"), ["session_id", "fail_seq"]).join(at("pass"), ["session_id", "pass_seq"])
    said = F.coalesce("error_signature", F.concat("profile", F.lit(" verdict fail then pass")))
    listed = F.filter(F.split("files", ","), lambda x: x != "")
    what = F.to_json(F.struct("profile", said.alias("errorSignature"), listed.alias("changedFiles"), "command", F.col("fail_ts").alias("failedAt"), F.col("pass_ts").alias("fixedAt")))
    fixes = pairs.select(
        "session_id", F.col("pass_seq").alias("at"), F.lit(0).alias("part"), F.lit("error-fix").alias("type"), F.concat_ws(":", F.lit("error-fix"), "profile", said).alias("key"),
        said.alias("signature"), F.array("fail_id", "pass_id").alias("evidence"), none.alias("queries"), what.alias("details"),
    )
    spots = zoom_hotspots(audit, artifacts)
    what = F.to_json(F.struct("target", F.col("target_kind").alias("targetKind"), F.col("zooms").alias("zoomCount"), "queries"))
    spots = spots.select(
        "session_id", F.lit(0).cast("long").alias("at"), F.lit(1).alias("part"), F.lit("zoom-hotspot").alias("type"), F.concat(F.lit("zoom-hotspot:"), "target").alias("key"),
        F.concat(F.lit("distillate of "), "target", F.lit(" required zooming back to raw")).alias("signature"), "evidence", "queries", what.alias("details"),
    )
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("part", "at", "key"))
    return _placed(fixes.unionByName(spots), ended, nth)


def _recurred(audit: DataFrame, artifacts: DataFrame, records: DataFrame, mined: DataFrame) -> DataFrame:
    """Recurrences, which come after what else is ``mined`` in their session."""
    events = signed(audit, artifacts)
    changed = F.when((F.col("action") == "distill") & (F.col("mode") == "diff"), F.col("path"))
    failed = F.when(F.col("verdict") == "fail", F.col("error_signature"))
    signals = session_signals(events.select("session_id", "id", "seq", "command", changed.alias("changed"), failed.alias("error_signature")))
    ended = audit.groupBy("session_id").agg(F.max("ts").alias("ts"), F.min("seq").alias("begun"))
    signals = signals.drop("begun").join(ended.select("session_id", "begun"), "session_id")
    again = recurrences(signals, records).join(signals, ["session_id", "kind", "value"])
    what = F.to_json(F.struct(F.col("kind").alias("signalKind"), F.col("value").alias("signal"), F.col("matched").alias("matchedRecords")))
    again = again.select(
        "session_id", F.lit("recurrence").alias("type"), F.concat_ws(":", F.lit("recurrence"), "kind", "value").alias("key"),
        F.concat(F.lit("recurring "), "kind", F.lit(": "), "value").alias("signature"), "evidence", F.array().cast("array<string>").alias("queries"), what.alias("details"),
    )
    again = again.join(mined.groupBy("session_id").agg(F.count("*").cast("int").alias("before")), "session_id", "left")
    nth = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy("key"))
    return _placed(again, ended.drop("begun"), nth)


def record_versions(mined: DataFrame, begun: DataFrame) -> DataFrame:
    """The candidates' texts as of each session: id, text, session_id, made, until.

    ``begun``: session_id, seq of the session's first event, by which sessions
    are in order. A session that mines a candidate gives it a new text, which
    holds for later sessions until the next one's.
    """
    last = mined.groupBy("type", "key", "session_id").agg(F.max_by(F.struct("signature", "details"), "nth").alias("v")).join(begun, "session_id")
    nxt = F.lead("seq").over(Window.partitionBy("type", "key").orderBy("seq", "session_id"))
    text = F.concat_ws("\n", "key", "v.signature", "v.details")
    return last.select(candidate_id("type", "key").alias("id"), text.alias("text"), "session_id", F.col("seq").alias("made"), nxt.alias("until"))


def merge_mined(prior: DataFrame, mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, counts): prior candidates (STATE rows) and newly mined ones (MINED rows) as one state per (type, key).

    An occurrence is counted once a session, also over re-runs: a session among
    the last KEPT_SESSIONS of a candidate refreshes it and counts as skipped.
    Evidence keeps its first EVIDENCE events, queries are united, signature is
    the first one's, details are the last one's. ``counts`` is one row: mined, merged
    (new sessions of known candidates) and skipped. Only ranked heads are gathered.
    """
    key = ["type", "key"]
    was = prior.select(*key, *[F.col(c).alias(f"_{c}") for c in prior.columns if c not in key])
    rows = mined.join(was.select(*key, "_sessions"), key, "left")
    known = F.coalesce(F.array_contains("_sessions", F.col("session_id")), F.lit(False))
    by = Window.partitionBy(*key)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c])
    last = rows.groupBy(*key).agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("details", F.struct("ts", "session_id", "nth")).alias("details"), F.min_by("signature", F.struct("ts", "session_id", "nth")).alias("signature"),
    )
    fresh = rows.where(~known).groupBy(*key, "session_id").agg(F.max("ts").alias("ts"))
    n_new = fresh.groupBy(*key).agg(F.count("*").alias("n_new"))
    late = fresh.withColumn("d", F.row_number().over(by.orderBy(F.desc("ts"), F.desc("session_id")))).where(F.col("d") <= KEPT_SESSIONS)
    late = late.withColumn("r", -F.col("d")).groupBy(*key).agg(listed("session_id").alias("new_sessions"))

    def heads(column: str, most: int | None):
        each = rows.select(*key, "ts", "session_id", "nth", F.posexplode(column).alias("pos", "x"))
        each = each.groupBy(*key, "x").agg(F.min(F.struct("ts", "session_id", "nth", "pos")).alias("at"))
        each = each.withColumn("r", F.row_number().over(by.orderBy("at", "x")))
        return (each if most is None else each.where(F.col("r") <= most)).groupBy(*key).agg(listed("x").alias(f"new_{column}"))

    both = was.join(last, key, "full").join(n_new, key, "left").join(late, key, "left")
    # of EVIDENCE events that the prior list may hold already, as many again can be new
    both = both.join(heads("evidence", 2 * EVIDENCE), key, "left").join(heads("queries", None), key, "left")
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_distinct(F.concat(F.coalesce(f"_{c}", none), F.coalesce(f"new_{c}", none)))
    sessions = joined("sessions")
    n = F.coalesce("n_new", F.lit(0))
    state = both.select(
        candidate_id("type", "key").alias("id"), *key, F.coalesce("_signature", "signature").alias("signature"), F.slice(joined("evidence"), 1, EVIDENCE).alias("evidence"),
        F.coalesce("_first_seen", "first_ts").alias("first_seen"), F.coalesce(F.greatest("_last_seen", "last_ts"), "_last_seen").alias("last_seen"),
        (F.coalesce("_occurrences", F.lit(0)) + n).cast("long").alias("occurrences"),
        F.when(F.size(sessions) > KEPT_SESSIONS, F.slice(sessions, -KEPT_SESSIONS, KEPT_SESSIONS)).otherwise(sessions).alias("sessions"),
        joined("queries").alias("queries"), F.coalesce("details", "_details").alias("details"),
    )
    new = F.when(F.col("_id").isNull(), 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = both.where("rows IS NOT NULL").agg(total("rows").alias("mined"), total(n - new).alias("merged"), total(F.col("rows") - n).alias("skipped"))
    return state, counts


def candidate_evidence(observed: DataFrame) -> DataFrame:
    """Evidence of candidates by (type, key): first twenty events, last fifty sessions, the last detail.

    ``observed``: type, key, session_id, ts, seq, id, detail. Only ranked heads
    are gathered, so a candidate seen everywhere costs no more than another.
    """
    key = ["type", "key"]
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c])
    events = observed.groupBy(*key, "id").agg(F.min(F.struct("ts", "seq")).alias("at"))
    events = events.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("at", "id"))).where(F.col("r") <= EVIDENCE)
    sessions = observed.groupBy(*key, "session_id").agg(F.max(F.struct("ts", "seq")).alias("at"))
    sessions = sessions.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at"), "session_id"))).where(F.col("r") <= KEPT_SESSIONS)
    last = observed.groupBy(*key).agg(F.max_by("detail", F.struct("ts", "seq")).alias("detail"))
    out = last.join(events.groupBy(*key).agg(listed("id").alias("evidence")), key)
    return out.join(sessions.groupBy(*key).agg(listed("session_id").alias("sessions")), key)


def candidate_queries(observed: DataFrame) -> DataFrame:
    """Distinct queries (type, key, query) of candidates, a row each."""
    return observed.where("query IS NOT NULL").select("type", "key", "query").distinct()


def confidence(occurrences, age_days, contradictions):
    """Saturating in occurrences, halving with age, less a flat cost per contradiction; within 0 and 1, four digits."""
    c = (1 - F.pow(F.lit(0.5), occurrences / dims.HALF_SATURATION)) * F.pow(F.lit(0.5), age_days / dims.HALF_LIFE_DAYS)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c - dims.CONTRADICTION_PENALTY * contradictions)), 4)


def decisions(candidates: DataFrame) -> DataFrame:
    """Add ``decision``: graduate, withdraw (only a contradicted one) or keep."""
    d = F.when((F.col("status") == "candidate") & (F.col("confidence") >= dims.GRADUATE_AT), "graduate").when(
        (F.col("status") == "graduated") & (F.col("contradictions") > 0) & (F.col("confidence") < dims.WITHDRAW_BELOW), "withdraw"
    )
    return candidates.withColumn("decision", d.otherwise("keep"))


def corpus_candidates(lines: DataFrame, prior: DataFrame) -> DataFrame:
    """Documents asked for in two sessions and three times graduate; new against ``prior`` (document)."""
    g = lines.where("document IS NOT NULL").groupBy("document").agg(
        F.count("*").alias("occurrences"), F.count_distinct("session_id").alias("sessions")
    )
    half = F.lit(0.5)
    c = F.round((1 - F.pow(half, F.col("occurrences") / 2)) * (1 - F.pow(half, F.col("sessions"))), 2)
    g = g.where("sessions >= 2 AND occurrences >= 3").withColumn("confidence", c)
    return g.join(prior.select("document").distinct(), "document", "left_anti")


def age_label(seconds):
    """Age in minutes, hours or days."""
    return (
        F.when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400), F.lit("d")))
    )


def _ends(paths: DataFrame) -> DataFrame:
    """(path, target): every end of a path after a slash, and the path itself."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return paths.select("path", F.explode(ends).alias("target")).distinct()


def directive_matches(paths: DataFrame, directives: DataFrame) -> DataFrame:
    """(path, target, ord): the first of ``directives`` (target, ord) that fits a path.

    One fits if its target is the path or the path ends in it after a slash; an
    equi-join on the path's ends.
    """
    fits = _ends(paths).join(directives.select("target", "ord"), "target")
    return fits.groupBy("path").agg(F.min(F.struct("ord", "target")).alias("d")).select("path", "d.target", "d.ord")


def run_summary(counts: DataFrame, decided: DataFrame, contradicted: DataFrame) -> DataFrame:
    """One row of a mining run: mined, merged and skipped (one row ``counts``), records contradicted, graduated and withdrawn."""
    count = lambda d: F.count_if(F.col("decision") == d)
    told = decided.agg(count("graduate").alias("graduated"), count("withdraw").alias("withdrawn"))
    against = contradicted.agg(F.count_distinct("id").alias("contradicted"))
    return counts.join(F.broadcast(told)).join(F.broadcast(against)).select("mined", "merged", "skipped", "contradicted", "graduated", "withdrawn")


def ranked_report(candidates: DataFrame) -> DataFrame:
    """Add ``rank`` by occurrences, last sighting and id over all candidates.

    Candidates are ranked within their occurrences and day, and those groups'
    sizes are summed up: no task sorts all of them.
    """
    group = ["occurrences", F.to_date("last_seen").alias("day")]
    sizes = candidates.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("occurrences"), F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row per pair of a count and a day
    rows = candidates.withColumn("day", F.to_date("last_seen")).join(sizes.drop("n"), ["occurrences", "day"])
    own = F.row_number().over(Window.partitionBy("occurrences", "day").orderBy(F.desc("last_seen"), "id"))
    return rows.withColumn("rank", (F.col("before") + own).cast("int")).drop("before", "day")


#: Bounds of evidence, of records that a signal recurs in, of queried symbols, of counted and of kept sessions; parts of a target's sessions; sessions and records of an array.
EVIDENCE, MATCHED, SYMBOLS, COUNTED_SESSIONS, KEPT_SESSIONS, SPREAD, BLOCK, FEW_RECORDS = 20, 5, 12, 20, 50, 32, 256, 16


def session_signals(events: DataFrame) -> DataFrame:
    """Distinct commands, changed paths and error signatures of each session, with the first events that show them.

    ``events``: session_id, id, seq, command, changed, error_signature (null
    where an event has none). Only ranked heads of evidence are gathered.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("command", "command"), ("path", "changed"), ("error-signature", "error_signature"))])
    s = events.select("session_id", "id", "seq", F.explode(kinds).alias("k")).select("session_id", "id", "seq", "k.*").where("value <> ''")
    order = Window.partitionBy("session_id", "kind", "value").orderBy("seq", "id")
    s = s.withColumn("r", F.row_number().over(order)).where(F.col("r") <= EVIDENCE)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])
    return s.groupBy("session_id", "kind", "value").agg(F.min("seq").alias("begun"), listed.alias("evidence"))


def recurrences(signals: DataFrame, records: DataFrame) -> DataFrame:
    """Signals whose value stands in the text of a record of an earlier session.

    ``records``: id, text, seq (or made), and, where texts have versions, until
    (the version holds for signals up to it) and session_id: a session's own
    records never match. Returns session_id, kind, value, matched (the first record ids).

    No signal meets all records of its value: of records that hold from some
    time on, a value keeps the heads. A version that ends stands in the blocks
    of time that it fills, a block keeps its heads, and a signal looks into the
    block of each size that it falls in.
    """
    has = set(records.columns)
    made = F.col("made" if "made" in has else "seq")
    texts = records.select(
        F.sha2("text", 256).alias("text_id"), F.col("id").alias("record"), "text", made.alias("made"),
        (F.col("until") if "until" in has else F.lit(None).cast("long")).alias("until"),
        (F.col("session_id") if "session_id" in has else F.lit(None).cast("string")).alias("of"),
    )
    # equal texts are indexed once
    distinct = texts.select("text_id", "text").distinct()
    found = containing(signals.select(F.col("value").alias("needle")), distinct).withColumnRenamed("needle", "value")
    owned = "session_id" in has
    asked = signals.select("session_id", "kind", "value", "begun")
    lasting = _heads(texts.where("until IS NULL"), ["text_id"], owned)
    hit = asked.join(_heads(found.join(lasting, "text_id"), ["value"], owned), "value")
    longest = records.agg(F.max(F.col("until") - made)).first()[0] if "until" in has else None
    if longest is not None:
        levels = range(next(n for n in range(1, 33) if n == 32 or 1 << 2 * n > longest))
        ended = found.join(texts.drop("text").where("until IS NOT NULL AND made < until"), "text_id")
        ended = ended.withColumn("block", F.explode(_filled(F.col("made") + 1, F.col("until"), levels)))
        at = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("begun", 2 * n).alias("nth")) for n in levels])
        short = asked.withColumn("block", F.explode(at)).join(_heads(ended, ["value", "block"], owned), ["value", "block"])
        hit = hit.unionByName(short.drop("block"))
    hit = hit.where(F.col("made") < F.col("begun"))
    if owned:
        hit = hit.where(F.col("of").isNull() | (F.col("of") != F.col("session_id")))
    # a row's heads are few
    listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("made", "record"))), lambda x: x["record"]))
    return hit.groupBy("session_id", "kind", "value").agg(F.slice(listed, 1, MATCHED).alias("matched"))


def _heads(rows: DataFrame, key: list[str], owned: bool) -> DataFrame:
    """Of each ``key`` (key, record, made, of) what may be among the first MATCHED records of a session, whichever it is.

    A session leaves out its own. So a record counts with two owners at most,
    an owner with MATCHED records; other records than a session's own are among
    those of the first 2 * MATCHED + 1 owners.
    """
    if not owned:
        first = rows.groupBy(*key, "record").agg(F.min("made").alias("made"))
        by = Window.partitionBy(*key).orderBy("made", "record")
        return first.withColumns({"r": F.row_number().over(by)}).where(F.col("r") <= MATCHED).drop("r").withColumn("of", F.lit(None).cast("string"))
    first = rows.groupBy(*key, "record", "of").agg(F.min("made").alias("made")).repartition(*key)
    rank = F.row_number().over(Window.partitionBy(*key, "record").orderBy("made", "of"))
    first = first.withColumn("r", rank).where("r <= 2")
    rank = F.row_number().over(Window.partitionBy(*key, "of").orderBy("made", "record"))
    first = first.withColumn("r", rank).where(F.col("r") <= MATCHED)
    begins = F.min(F.struct("made", "record")).over(Window.partitionBy(*key, "of"))
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("begins", "of"))
    return first.withColumn("begins", begins).withColumn("r", rank).where(F.col("r") <= 2 * MATCHED + 1).drop("r", "begins")


def _filled(first, last, levels: range):
    """The fewest blocks (level, nth), nth of width 4^level, that fill the whole numbers from ``first`` to ``last``."""
    low = [F.shiftright(first + ((1 << 2 * n) - 1), 2 * n) for n in levels]
    high = [F.shiftright(last + 1, 2 * n) for n in levels]
    none = F.array().cast("array<bigint>")
    parts = []
    for n in levels:
        span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
        mine = span(low[n], high[n])
        if n + 1 < len(levels):
            # what the next larger blocks leave over at both ends
            ends = F.concat(span(low[n], low[n + 1] * 4), span(high[n + 1] * 4, high[n]))
            mine = F.when(low[n + 1] < high[n + 1], ends).otherwise(mine)
        parts.append(F.transform(mine, lambda x: F.struct(F.lit(n).alias("level"), x.alias("nth"))))  # noqa: B023
    return F.flatten(F.array(*parts))


def queried_symbols(queries):
    """Distinct identifiers of an array of queries in order, at most twelve."""
    words = F.flatten(F.transform(queries, lambda q: F.split(q, "[^A-Za-z0-9_$]+")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, SYMBOLS)


def fix_summary(lesson, files, command):
    """What fixed an error: the drafted lesson, else the files edited or a rerun, with the command."""
    how = F.coalesce(F.concat(F.lit(" ("), command, F.lit(")")), F.lit(""))
    edited = F.concat(F.lit("edit "), F.array_join(files, ", "))
    return F.coalesce(lesson, F.concat(F.when(F.size(files) > 0, edited).otherwise(F.lit("re-run until green")), how))


def contradictions(records: DataFrame, failures: DataFrame, zooms: DataFrame) -> DataFrame:
    """Sessions that contradict graduated records, each counted once: (id, session_id), new ones only.

    ``records``: id, type, target (signature or file), graduated_seq, counted
    (sessions counted before). ``failures`` (session_id, seq, signature)
    contradict a fix of the same signature, ``zooms`` (session_id, seq, path)
    a hotspot whose file is the same or ends the other's path.

    There are as many pairs as a target has records and sessions. A target's
    sessions are made distinct, with their last event, and put into arrays of
    BLOCK in order of it, its records likewise, and array meets array: pairs are
    made last, none is shuffled or sorted, and a task holds two arrays. As the
    same sessions follow each of an array's records, written pairs take about
    two bits each. A target's sessions are spread over SPREAD tasks, because
    there may be few targets; its records, which are fewer, go to each.
    """
    key = ["type", "target"]
    sessions = _blocks(_contradicting(records, failures, zooms), key, "session_id", F.struct("seq", "session_id"), BLOCK, False)
    sessions = sessions.select(*key, "part", F.col("rows.session_id").alias("sessions"), F.col("rows.seq").alias("last"))
    against = _blocks(records, key, "id", F.struct("graduated_seq", "id", "counted"), FEW_RECORDS, True).select(*key, F.col("rows").alias("against"))
    # a fixed number of partitions: the inputs are small beside the pairs, and Spark would put them together
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sessions = sessions.repartition(n, *key, "part")
    against = against.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(n, *key, "part")
    both = sessions.hint("merge").join(against, [*key, "part"])
    each = both.select("sessions", "last", F.explode("against").alias("g")).select("sessions", "last", "g.*").where(F.col("last")[0] > F.col("graduated_seq"))
    pairs = each.select("id", "graduated_seq", "counted", "last", F.posexplode("sessions").alias("i", "session_id"))
    return pairs.where((F.get("last", F.col("i")) > F.col("graduated_seq")) & ~F.array_contains("counted", F.col("session_id"))).select("id", "session_id")


def _blocks(rows: DataFrame, key: list[str], spread: str, item, most: int, asc: bool) -> DataFrame:
    """(key, part, rows): ``item`` of the rows of each key and of each of SPREAD parts by the column ``spread``, sorted, in arrays of ``most`` at most."""
    each = rows.select(*key, F.pmod(F.hash(spread), F.lit(SPREAD)).alias("part"), item.alias("item"))
    nth = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.col("item").asc() if asc else F.col("item").desc()))
    each = each.withColumn("block", F.floor((nth - 1) / most))
    return each.groupBy(*key, "part", "block").agg(F.sort_array(F.collect_list("item"), asc).alias("rows")).drop("block")


def _against(records: DataFrame, met: DataFrame, key: list[str]) -> DataFrame:
    both = records.select(*key, "id", "graduated_seq", "counted").join(met, key)
    return both.where((F.col("seq") > F.col("graduated_seq")) & ~F.array_contains("counted", F.col("session_id")))


def contradicted(records: DataFrame, failures: DataFrame, zooms: DataFrame) -> DataFrame:
    """The ids that ``contradictions`` has, without its pairs.

    Of the COUNTED_SESSIONS + 1 last sessions of a target one at least wasn't
    counted before, so a record that these don't contradict none does.
    """
    last = Window.partitionBy("type", "target").orderBy(F.desc("seq"), "session_id")
    met = _contradicting(records, failures, zooms).withColumn("r", F.row_number().over(last)).where(F.col("r") <= COUNTED_SESSIONS + 1)
    return _against(records, met, ["type", "target"]).select("id").distinct()


def _contradicting(records: DataFrame, failures: DataFrame, zooms: DataFrame) -> DataFrame:
    """(type, target, session_id, seq): the sessions that meet a target of ``records``, with their last event that does."""
    fixes = failures.select(F.lit("error-fix").alias("type"), F.col("signature").alias("target"), "session_id", "seq")
    files = records.where("type = 'zoom-hotspot'")
    paths, targets = zooms.select("path").distinct(), files.select("target").distinct()
    down = _ends(paths).join(targets, "target")
    up = _ends(targets.withColumnRenamed("target", "path")).join(paths.withColumnRenamed("path", "target"), "target")
    same = down.select("path", "target").unionByName(up.select(F.col("target").alias("path"), F.col("path").alias("target"))).distinct()
    again = zooms.join(same, "path").select(F.lit("zoom-hotspot").alias("type"), "target", "session_id", "seq")
    return fixes.unionByName(again).groupBy("type", "target", "session_id").agg(F.max("seq").alias("seq"))


def count_contradictions(records: DataFrame, found: DataFrame) -> DataFrame:
    """``records`` with the sessions of ``found`` (id, session_id; see ``contradictions``) counted: contradictions and counted.

    A record remembers the last COUNTED_SESSIONS sessions that it was contradicted in.
    """
    order = Window.partitionBy("id").orderBy("session_id")
    n = F.count("*").over(Window.partitionBy("id"))
    kept = found.withColumns({"r": F.row_number().over(order), "n": n}).where(F.col("r") > F.col("n") - COUNTED_SESSIONS)
    new = kept.groupBy("id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", "session_id"))), lambda x: x["session_id"]).alias("new"))
    both = records.join(new, "id", "left")
    all_ = F.concat("counted", F.coalesce("new", F.array().cast("array<string>")))
    last = F.when(F.size(all_) > COUNTED_SESSIONS, F.slice(all_, -COUNTED_SESSIONS, COUNTED_SESSIONS)).otherwise(all_)
    return both.withColumns({"contradictions": F.col("contradictions") + F.coalesce("n", F.lit(0)), "counted": last}).drop("new", "n")


def ask_neighbourhoods(touched: DataFrame) -> DataFrame:
    """Sections that are asked for together: ``touched`` has event_id, session_id, document, section.

    The key of a question is its first document by name and that document's
    distinct sections in order; two sessions and three questions graduate.
    """
    lists = touched.groupBy("event_id", "session_id", "document").agg(F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))
    first = lists.groupBy("event_id", "session_id").agg(F.min(F.struct("document", "sections")).alias("p"))
    g = first.groupBy(F.concat_ws("#", "p.document", "p.sections").alias("key")).agg(F.count("*").alias("occurrences"), F.count_distinct("session_id").alias("sessions"))
    half = F.lit(0.5)
    c = F.round((1 - F.pow(half, F.col("occurrences") / 2)) * (1 - F.pow(half, F.col("sessions"))), 2)
    return g.where("sessions >= 2 AND occurrences >= 3").withColumn("confidence", c)


def graduation_pass(decided: DataFrame, codex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The knowledge table after a pass, and what the pass did: (id, action, section, locked_kept).

    ``decided``: id, type, decision, target_kind, target, symbols, summary,
    confidence; ``codex``: section, candidate, text, path, symbols, source,
    locked, confidence. Withdrawals come first: they take learned entries and
    graduated ones that aren't locked, never what a person wrote. A graduate
    goes to learned (a file's hotspot with symbols; other hotspots wait),
    pitfalls (fixes) or conventions, unless its entry is there: a second pass
    over the same rows changes nothing.
    """
    withdrawn = decided.where("decision = 'withdraw'").select(F.col("id").alias("candidate"))
    marked = codex.join(withdrawn.withColumn("w", F.lit(True)), "candidate", "left")
    graduated = F.col("source") == "graduated"
    gone = F.coalesce("w", F.lit(False)) & ((F.col("section") == "learned") | (graduated & ~F.col("locked")))
    kept = marked.where(~gone).select(*codex.columns)
    stays = marked.where(F.col("w") & graduated & F.col("locked") & (F.col("section") != "learned"))
    stays = stays.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("locked_kept"))
    hotspot = F.when((F.col("target_kind") == "file") & (F.size(F.coalesce("symbols", F.array().cast("array<string>"))) > 0), "learned")
    section = F.when(F.col("type") == "zoom-hotspot", hotspot).when(F.col("type") == "error-fix", "pitfalls").otherwise("conventions")
    new = decided.where("decision = 'graduate'").withColumns({"section": section, "candidate": F.col("id")}).where("section IS NOT NULL")
    new = new.join(kept.select("section", "candidate"), ["section", "candidate"], "left_anti")
    learned = F.col("section") == "learned"
    entries = new.select(
        "section", "candidate", F.when(~learned, F.col("summary")).alias("text"), F.when(learned, F.col("target")).alias("path"),
        F.when(learned, F.slice("symbols", 1, SYMBOLS)).alias("symbols"), F.lit("graduated").alias("source"), F.lit(False).alias("locked"), "confidence",
    )
    outcomes = new.select("id", F.lit("graduate").alias("action"), "section", F.lit("").alias("locked_kept"))
    left = withdrawn.join(stays, "candidate", "left").select(
        F.col("candidate").alias("id"), F.lit("withdraw").alias("action"), F.lit(None).cast("string").alias("section"), F.coalesce("locked_kept", F.lit("")).alias("locked_kept")
    )
    return kept.unionByName(entries.select(*codex.columns)), outcomes.unionByName(left)
