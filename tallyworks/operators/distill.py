"""Artifact distillation: lines, verdicts, entities, redaction, delta serves and budgets.

``lines``: artifact_id, line_no, line. ``artifacts``: artifact_id, raw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, patterns


def explode_lines(artifacts: DataFrame) -> DataFrame:
    parts = F.posexplode(F.split("raw", "\r?\n", -1)).alias("i", "line")
    return artifacts.select("artifact_id", parts).select("artifact_id", (F.col("i") + 1).alias("line_no"), "line")


def assemble(lines: DataFrame) -> DataFrame:
    """Raw text of each artifact: its lines in order, joined by newlines."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("artifact_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("raw"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("artifact_id", "line").agg(F.min("line_no").alias("line_no"))


def _any(column, names: list[str]):
    """Any of the patterns matches somewhere, in multi-line, case-blind mode: one alternation, one scan."""
    return column.rlike("(?im)" + "|".join(f"(?:{p})" for p in names))


def verdict(raw, profile: dict):
    """The gate's extractor: fail or pass if only one side matches, else unknown."""
    fail, good = _any(raw, profile["fail"]), _any(raw, profile["pass"])
    return F.when(fail & ~good, "fail").when(good & ~fail, "pass").otherwise("unknown")


def verdict_line(raw, profile: dict):
    """The distillate's extractor: fail wins."""
    return F.concat(F.lit("VERDICT: "), F.when(_any(raw, profile["fail"]), "fail").when(_any(raw, profile["pass"]), "pass").otherwise("unknown"))


def build_contract(lines: DataFrame, profile: dict = patterns.BUILD_LOG) -> DataFrame:
    """Verdict, first error, error lines and files of a build log; without errors its last line."""
    lines = lines.where(F.trim("line") != "")
    bad = F.col("line").rlike("(?i)" + profile["relevant"])
    file = F.regexp_extract(F.trim("line"), r"^([^\s(:]+)[(:]", 1)
    fails, passes = _any(F.col("line"), profile["fail"]), _any(F.col("line"), profile["pass"])
    g = lines.groupBy("artifact_id").agg(
        F.when(F.bool_or(fails), "fail").when(F.bool_or(passes), "pass").otherwise("unknown").alias("verdict"),
        F.trim(F.min_by("line", F.when(bad, F.col("line_no")))).alias("first_error"),
        F.count_if(bad).alias("errors"),
        F.count_distinct(F.when(bad & (file != ""), file)).alias("files"),
        F.max_by("line", "line_no").alias("last_line"),
    )
    return g.withColumn("last_line", F.when(F.col("errors") == 0, F.col("last_line")))


def relevant_lines(lines: DataFrame, pattern: str, most: int) -> DataFrame:
    """The first ``most`` distinct lines that match, in order."""
    hit = distinct_lines(lines.where(F.col("line").rlike(pattern)))
    order = Window.partitionBy("artifact_id").orderBy("line_no")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search_results(lines: DataFrame, files: int = 10, hits: int = 3) -> DataFrame:
    """Hit lines ``path:line:text``: the files with most hits, first-seen first at ties, and their first hits."""
    part = lambda i: F.regexp_extract("line", r"^(.+?):(\d+):(.*)$", i)
    h = lines.where(part(1) != "").select("artifact_id", "line_no", part(1).alias("path"), part(2).alias("at"), F.trim(part(3)).alias("text"))
    by_file = h.groupBy("artifact_id", "path").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    rank = Window.partitionBy("artifact_id").orderBy(F.desc("n"), "first")
    whole = Window.partitionBy("artifact_id")
    by_file = by_file.withColumns(
        {"file_rank": F.row_number().over(rank), "total": F.sum("n").over(whole), "n_files": F.count("*").over(whole)}
    ).where(F.col("file_rank") <= files)
    h = h.join(by_file.select("artifact_id", "path", "file_rank", "total", "n_files"), ["artifact_id", "path"])
    h = h.withColumn("hit", F.row_number().over(Window.partitionBy("artifact_id", "path").orderBy("line_no")))
    return h.where(F.col("hit") <= hits).select("artifact_id", "file_rank", "hit", "path", "at", "text", "total", "n_files")


def head_tail(lines: DataFrame, head: int = 15, tail: int = 10) -> DataFrame:
    """First and last lines with the count of those left out; short artifacts whole."""
    n = F.count("*").over(Window.partitionBy("artifact_id"))
    lines = lines.withColumn("n", n)
    short = F.col("n") <= head + tail
    kept = lines.where(short | (F.col("line_no") <= head) | (F.col("line_no") > F.col("n") - tail))
    return kept.select("artifact_id", "line_no", "line", F.when(short, 0).otherwise(F.col("n") - head - tail).alias("omitted"))


def entities(text, table=patterns.CODE_ENTITIES):
    """Distinct, trimmed entities of a text in pattern order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in table]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def entity_gate(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """Add found/all entities of ``region`` kept verbatim in ``distilled``, first five missing, and whether the ratio passes."""
    rows = rows.withColumn("entities", entities(F.col("region")))
    rows = rows.withColumn("missing", F.filter("entities", lambda e: ~F.contains(F.col("distilled"), e)))
    n = F.size("entities")
    ratio = F.when(n == 0, 1.0).otherwise((n - F.size("missing")) / n)
    return rows.withColumns({"ratio": ratio, "entity_ok": ratio >= least, "first_missing": F.slice("missing", 1, 5)})


def size_gate(rows: DataFrame, most: float = dims.SIZE_RATIO, least: int = 0) -> DataFrame:
    """Add whether the distillate is small enough and has ``least`` bytes; an empty raw text fails."""
    raw, out = F.octet_length("raw"), F.octet_length("distilled")
    return rows.withColumn("size_ok", F.when(raw == 0, False).otherwise((out / raw <= most) & (out >= least)))


def redact(rows: DataFrame, column: str = "text") -> DataFrame:
    """Replace secrets kind by kind, each on the text that the kinds before it left; add ``findings`` (kind, count)."""
    counts = []
    for i, (kind, pattern) in enumerate(patterns.REDACTION):
        marker = f"[REDACTED:{kind}]"
        rows = rows.withColumn(f"_n{i}", F.regexp_count(column, F.lit(pattern)))
        replacement = f"$1{marker}" if kind == "env-assignment" else marker
        rows = rows.withColumn(column, F.regexp_replace(column, pattern, replacement))
        counts.append(F.struct(F.lit(kind).alias("kind"), F.col(f"_n{i}").cast("long").alias("count")))
    found = F.filter(F.array(*counts), lambda x: x["count"] > 0)
    return rows.withColumn("findings", found).drop(*[f"_n{i}" for i in range(len(counts))])


def redaction_audit(redacted: DataFrame, key: str) -> DataFrame:
    """One row per document and kind found: kinds and counts, never values."""
    return redacted.select(key, F.inline("findings"))


def ratio_statistics(events: DataFrame) -> DataFrame:
    """Per profile: distillations, median and peak ratio, bytes in and out, raw serves and zooms."""
    d = F.col("action") == "distill"
    ratio = F.when(d & (F.col("bytes_out") > 0), F.col("bytes_in") / F.col("bytes_out"))
    return events.groupBy("profile").agg(
        F.count_if(d).alias("distillations"),
        F.median(ratio).alias("median_ratio"),
        F.max(ratio).alias("peak_ratio"),
        F.sum(F.when(d, F.col("bytes_in"))).alias("bytes_in"),
        F.sum(F.when(d, F.col("bytes_out"))).alias("bytes_out"),
        F.count_if(F.col("action") == "serve-raw").alias("raw_serves"),
        F.count_if(F.col("action") == "zoom").alias("zooms"),
    )


def delta_serves(serves: DataFrame) -> DataFrame:
    """Per (session, path) in time order: first serve full, same content unchanged, else a diff; with a file reference."""
    hashed = serves.withColumn("hash", F.sha2("content", 256))
    before = F.lag("hash").over(Window.partitionBy("session_id", "path").orderBy("ts", "seq"))
    ref = F.concat(F.lit("F"), F.substring(F.sha2("path", 256), 1, 4), F.lit("@"), F.substring("hash", 1, 16))
    hashed = hashed.withColumn("before", before)
    mode = F.when(F.col("before").isNull(), "full").when(F.col("before") == F.col("hash"), "unchanged").otherwise("diff")
    return hashed.select("session_id", "path", "seq", mode.alias("mode"), ref.alias("ref"))


def line_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines added and removed between two versions (key, line), with counts."""
    both = old.select("key", "line", F.lit(-1).alias("n")).unionByName(new.select("key", "line", F.lit(1).alias("n")))
    g = both.groupBy("key", "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return g.groupBy("key").agg(
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed")
    )


def text_zoom(lines: DataFrame, phrase: str, around: int = 2, most: int = 200) -> DataFrame:
    """Lines near a case-blind match of the phrase; only where it hits nothing, near any of its words."""
    order = Window.partitionBy("artifact_id").orderBy("line_no")
    near, whole = order.rowsBetween(-around, around), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort for all
    low = F.lower("line")
    words = [w for w in phrase.lower().split() if w]
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.contains(low, F.lit(w))
    flagged = lines.withColumn("_p", F.contains(low, F.lit(phrase.lower())))
    flagged = flagged.withColumn("_any", F.max("_p").over(whole))
    hit = F.when(F.col("_any"), F.col("_p")).otherwise(any_word)
    shown = flagged.withColumn("_near", F.max(hit).over(near)).where("_near")
    shown = shown.withColumn("_r", F.row_number().over(order))
    omitted = F.greatest(F.count("*").over(Window.partitionBy("artifact_id")) - most, F.lit(0))
    return shown.withColumn("omitted", omitted).where(F.col("_r") <= most).select("artifact_id", "line_no", "line", "omitted")


def rolling_state(entries: DataFrame, budget: int = dims.STATE_TOKENS) -> DataFrame:
    """The longest suffix of whole entries (key, seq, entry) whose joined text fits the token budget; at least one."""
    back = Window.partitionBy("key").orderBy(F.desc("seq"))
    chars = F.sum(F.length("entry") + 1).over(back) - 1
    kept = entries.withColumns({"used": F.ceil(chars / 4), "_r": F.row_number().over(back)})
    return kept.where((F.col("used") <= budget) | (F.col("_r") == 1)).select("key", "seq", "used")


def within_budget(items: DataFrame, header_chars: int, budget: int) -> DataFrame:
    """Add ``included``: the longest prefix by confidence (then id) whose text with the header fits the budget."""
    order = Window.partitionBy("key").orderBy(F.desc("confidence"), "id")
    used = F.ceil((F.sum(F.length("text") + 1).over(order) + header_chars) / 4)
    return items.withColumn("included", used <= budget)


def attributed_sessions(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Session of each event (repo, ts, provided): the repo's latest registration so far, else the provided id, else unknown."""
    r = registrations.select("repo", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), "session_id", F.lit(None).cast("string").alias("provided"))
    e = events.select("repo", "ts", F.lit(1).alias("kind"), "seq", F.lit(None).cast("string").alias("session_id"), "provided")
    order = Window.partitionBy("repo").orderBy("ts", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("session_id", ignorenulls=True).over(order)
    out = r.unionByName(e).withColumn("last", last).where("kind = 1")
    return out.select("repo", "seq", F.coalesce("last", "provided", F.lit("unknown")).alias("session_id"))


def latest_serves(serves: DataFrame) -> DataFrame:
    """Served files, one row per (session, path): the latest."""
    order = Window.partitionBy("session_id", "path").orderBy(F.desc("ts"), F.desc("seq"))
    return serves.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def live_handles(handles: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Handles whose artifact is stored, and the dead ones."""
    stored = artifacts.select("artifact_id")
    return handles.join(stored, "artifact_id", "left_semi"), handles.join(stored, "artifact_id", "left_anti")


def prior_paths(contents: DataFrame, serves: DataFrame) -> DataFrame:
    """Path under which identical content was served last, by content hash."""
    last = serves.groupBy(F.sha2("content", 256).alias("hash")).agg(F.max_by("path", F.struct("ts", "seq")).alias("prior_path"))
    return contents.withColumn("hash", F.sha2("content", 256)).join(last, "hash", "left").drop("hash")


def route(command):
    """Profile of a command; its words are fixed values."""
    return (
        F.when(command.rlike(r"\b(tsc|build)\b"), "build-log")
        .when(command.rlike(r"\b(vitest|jest|test|verify|check)\b"), "test-output")
        .otherwise("generic-stdout")
    )


def skeleton_route(path):
    """Skeleton profile of a path by its extension; null if none is built."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*dims.CODE_SUFFIXES), "file-skeleton").when(ext.isin(*dims.DOCUMENT_SUFFIXES), "doc-skeleton").when(ext.isin(*dims.PAGE_SUFFIXES), "html-skeleton")


def full_rewrite(exists, content_bytes):
    """Whether a write replaces a large existing file as a whole."""
    return exists & (content_bytes > dims.FULL_REWRITE_BYTES)


def prompt_tier(prompt):
    """hard by its words, trivial if short and of one line, else standard; null for an empty prompt."""
    short = (F.length(prompt) <= dims.TRIVIAL_PROMPT_CHARS) & ~F.contains(prompt, F.lit("\n"))
    return F.when(prompt != "", F.when(prompt.rlike(patterns.HARD_PROMPT), "hard").when(short, "trivial").otherwise("standard"))


def gate_verdict(detail):
    """Verdict that the detail of a verdict gate carries; null if it was inconclusive."""
    agreed, raw = F.regexp_extract(detail, r"verdict (pass|fail) agreed", 1), F.regexp_extract(detail, r"raw verdict (pass|fail) but", 1)
    return F.when(agreed != "", agreed).when(raw != "", raw)


def test_output(lines: DataFrame, profile: dict = patterns.TEST_OUTPUT, most: int = 60) -> DataFrame:
    """Distillate of a test run: verdict, the first distinct relevant lines, then summary lines, none twice.

    Returns artifact_id, place, line.
    """
    verdicts = lines.groupBy("artifact_id").agg(
        F.bool_or(_any(F.col("line"), profile["fail"])).alias("f"), F.bool_or(_any(F.col("line"), profile["pass"])).alias("p")
    )
    said = F.when(F.col("f"), "fail").when(F.col("p"), "pass").otherwise("unknown")
    parts = verdicts.select("artifact_id", F.lit(0).alias("part"), F.lit(0).alias("line_no"), F.concat(F.lit("VERDICT: "), said).alias("line"))
    relevant = relevant_lines(lines, "(?i)" + profile["relevant"], most).select("artifact_id", F.lit(1).alias("part"), "line_no", "line")
    summary = lines.where(F.col("line").rlike(profile["summary"])).select("artifact_id", F.lit(2).alias("part"), "line_no", "line")
    once = parts.unionByName(relevant).unionByName(summary).where("line <> ''")
    once = once.groupBy("artifact_id", "line").agg(F.min(F.struct("part", "line_no")).alias("at"))
    place = F.row_number().over(Window.partitionBy("artifact_id").orderBy("at"))
    return once.select("artifact_id", place.alias("place"), "line")


def prose_entities(text):
    """Distinct entities of prose: dates, defined terms, parties, section references, figures."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in patterns.PROSE_ENTITIES]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def read_tier(size, sliced, posture=None):
    """How a file read is served by its size in bytes and the session's ``posture`` (null: engaged).

    Up to READ_PASS it passes; up to READ_CAPPED it is capped, whatever the slice;
    above, a whole read gets a skeleton and an explicit slice passes. An idle
    session governs nothing but whole reads of GOVERN_ANY bytes or more.
    """
    idle = F.lit(False) if posture is None else F.coalesce(posture == "idle", F.lit(False))
    tier = F.when(size <= dims.READ_PASS, "pass").when(size <= dims.READ_CAPPED, "capped").when(sliced, "pass").otherwise("skeleton")
    return F.when(idle & (sliced | (size < dims.GOVERN_ANY)), "pass").otherwise(tier)


def handle_tokens(chars):
    """Token estimate of handles and budgets: a quarter of the characters, rounded up."""
    return F.ceil(chars / 4)


def rewrite_rule(command, wrapped: tuple[str, ...] = ()):
    """Name of the rule under which a command is wrapped; null if it stays as it is.

    One leading ``cd`` is set aside and merged output streams are no
    composition; any deny rule wins, then the first allow rule names the
    command. ``wrapped`` holds marks of commands that are wrapped already.
    """
    tail = F.regexp_replace(command, patterns.CD_PREFIX, "")
    denied = F.regexp_replace(tail, patterns.MERGED_OUTPUT, " ").rlike("(?i)" + "|".join(p for _, p in patterns.REWRITE_DENY))
    for mark in wrapped:
        denied = denied | F.contains(command, F.lit(mark))
    rule = F.when(denied, None)
    for name, pattern in patterns.REWRITE_ALLOW:
        rule = rule.when(tail.rlike("(?i)" + pattern), name)
    return rule


def foreign_events(events: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Events of this repository and refusals of the others: ``events`` has id, session_id and repo.

    An event that names no repository is taken; paths are compared without a
    trailing slash and with forward slashes.
    """
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", "")
    own = F.coalesce(F.col("repo"), F.lit("")).isin("") | (clean(F.col("repo")) == clean(F.lit(root)))
    reason = F.concat(F.lit("event of another repository refused: "), "repo")
    refused = events.where(~own).select(
        F.concat(F.lit("refuse-"), "id").alias("id"), "session_id", F.lit("refuse").alias("action"), reason.alias("reason")
    )
    return events.where(own), refused


def gate_config(profiles: DataFrame) -> DataFrame:
    """Gates of each profile and which of them are off.

    ``profiles``: profile, relevant_pattern, entity_set, least_ratio,
    line_limit, verdict, most_ratio, least_bytes; nulls are not configured. The
    entity gate is on if either of its patterns is; its set is then code by
    default. The size gate is always on.
    """
    entity = F.col("relevant_pattern").isNotNull() | F.col("entity_set").isNotNull()
    verdict_on = F.coalesce("verdict", F.lit(False))
    off = F.array_compact(F.array(F.when(~entity, "entity"), F.when(~verdict_on, "verdict")))
    only = lambda c: F.when(entity, F.col(c))
    return profiles.select(
        "profile", entity.alias("entity_on"), F.when(entity, F.coalesce("entity_set", F.lit("code"))).alias("entity_set"),
        only("least_ratio").alias("least_ratio"), only("line_limit").alias("line_limit"),
        verdict_on.alias("verdict_on"), "most_ratio", "least_bytes", F.array_join(off, ",").alias("off"),
    )
