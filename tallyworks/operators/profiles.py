"""The distil job: raw artifacts of any profile to gated, redacted artifacts with audit rows and handles.

``artifacts``: artifact_id (string), session_id, profile, path (may be null), raw.
``sections`` of document artifacts: artifact_id, place, section_id, title,
start_line, page (may be null), summary, and, for served questions, ``rank`` (null
if it isn't served) and ``body``; ``pages`` is the document's number of pages.

All but ranked search hits and documents is row-local: the lines of an artifact
are an array inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.rules import REWRITE, RuleBook
from . import distill as d

DOCUMENTS = ("doc-serve", "doc-skeleton", "html-skeleton")
#: A map is fitted to this share of what the size gate allows.
MARGIN = 0.95
SECTION = "struct<place:int,section_id:string,title:string,start_line:int,page:int,summary:string,rank:int,body:string>"


def _lines(raw: Column) -> Column:
    return F.split(raw, "\r?\n", -1)


def _recovery(artifact_id: str, zoom: str) -> Column:
    return F.concat(F.lit(f'zoom: {zoom}("'), F.col(artifact_id), F.lit('", query?)'))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _one(*texts: Column) -> Column:
    return F.array(*[t.cast("string") for t in texts])


def verdict_line(raw: Column, book: RuleBook, profile: str) -> Column:
    """VERDICT of a raw text as its distillate says it: a fail wins."""
    said = F.when(book.hits(raw, profile, "primary_fail"), "fail").when(book.hits(raw, profile, "primary_pass"), "pass").otherwise("unknown")
    return F.concat(F.lit("VERDICT: "), said)


def read_raw(rows: DataFrame, book: RuleBook, profile: str) -> DataFrame:
    """Add whether the sides of the two vocabularies match the raw text, each read once: columns of their own, which no expression repeats."""
    sides = [(v, side) for v in ("primary", "secondary") for side in ("fail", "pass")]
    return rows.withColumns({f"_{v}_{side}": book.hits(F.col("raw"), profile, f"{v}_{side}") for v, side in sides})


def _contract(rows: DataFrame, book: RuleBook, profile: str, zoom: Column) -> DataFrame:
    """Verdict, first error, counts; without errors the last line.

    What is used more than once is a column of its own: inside one expression it
    would be made again for each use.
    """
    rows = read_raw(rows, book, profile).withColumn("_all", _lines(F.col("raw")))
    rows = rows.withColumn("_lines", F.filter("_all", lambda x: F.trim(x, F.lit(" \t")) != ""))
    rows = rows.withColumn("_bad", F.filter("_lines", lambda x: book.hits(x, profile, "relevant", "i")))
    lines, bad = F.col("_lines"), F.col("_bad")
    said = F.concat(F.lit("VERDICT: "), F.when(F.col("_primary_fail"), "fail").when(F.col("_primary_pass"), "pass").otherwise("unknown"))
    files = F.filter(F.transform(bad, lambda x: F.regexp_extract(F.trim(x), r"^([^\s(:]+)[(:]", 1)), lambda x: x != "")
    elided = F.concat(F.lit("[full log elided, "), zoom, F.lit("]"))
    first = F.concat(F.lit("first error: "), F.trim(bad[0]))
    count = F.concat(F.lit("errors: "), F.size(bad), F.lit(" lines across "), F.size(F.array_distinct(files)), F.lit(" files"))
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    told = F.when(F.size(bad) == 0, F.array_join(F.array_distinct(_one(said, last, elided)), "\n")).otherwise(_joined(_one(said, first, count, elided)))
    return rows.withColumn("distilled", told).drop("_lines", "_bad")


def _relevant(book: RuleBook, profile: str) -> Column:
    """Verdict, the first distinct relevant lines, then summary lines, none twice."""
    lines = _lines(F.col("raw"))
    most = int(book.number(profile, "most_lines", 40))
    kept = F.slice(F.array_distinct(F.filter(lines, lambda x: book.hits(x, profile, "relevant", "i"))), 1, most)
    summary = F.filter(lines, lambda x: book.hits(x, profile, "summary", "m"))
    said = F.when(F.lit(book.setting(profile, "verdict") == "on"), verdict_line(F.col("raw"), book, profile)).otherwise("")
    return F.array_join(F.array_distinct(F.filter(F.concat(_one(said), kept, summary), lambda x: x != "")), "\n")


def _head_tail(book: RuleBook, profile: str, zoom: Column) -> Column:
    lines = _lines(F.col("raw"))
    head, tail = int(book.number(profile, "head", 15)), int(book.number(profile, "tail", 10))
    left = F.size(lines) - head - tail
    note = F.concat(F.lit("[omitted "), left, F.lit(" middle lines, "), zoom, F.lit("]"))
    return F.when(left <= 0, F.col("raw")).otherwise(_joined(F.slice(lines, 1, head), _one(note), F.slice(lines, -tail, tail)))


def _skeleton(book: RuleBook, profile: str, zoom: Column) -> Column:
    """Declarations of a source file by line patterns; a file without any has no skeleton."""
    kept = F.filter(_lines(F.col("raw")), lambda x: book.hits(x, profile, "hit", "m"))
    head = F.when(F.col("path").isNotNull(), _one(F.concat(F.lit("skeleton of "), F.col("path")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) == 0, "").otherwise(_joined(head, _one(F.concat(F.lit("[bodies elided, "), zoom, F.lit("]"))), kept))


def _first_hits(book: RuleBook, profile: str, zoom: Column) -> Column:
    """The head of a list of hits that comes ranked, under a count."""
    lines = F.filter(_lines(F.col("raw")), lambda x: F.trim(x) != "")
    most = int(book.number(profile, "hits", 24))
    docs = F.size(F.array_distinct(F.transform(lines, lambda x: F.substring_index(x, " §", 1))))
    full = F.concat(F.lit("full set: "), zoom, F.lit(")"))
    shown = F.when(F.size(lines) > most, F.concat(F.lit(f" (showing top {most}; "), full)).otherwise(F.concat(F.lit(" ("), full))
    head = F.concat(F.size(lines), F.lit(" hits across "), docs, F.lit(" documents"), shown)
    return F.when(F.size(lines) == 0, "").otherwise(_joined(_one(head), F.slice(lines, 1, most)))


def _ranked_hits(artifacts: DataFrame, book: RuleBook, profile: str, zoom: Column) -> DataFrame:
    """(artifact_id, distilled) of search results: files by hits, their first hits, under a count."""
    files, hits = int(book.number(profile, "files", 10)), int(book.number(profile, "hits", 3))
    lines = d.explode_lines(artifacts.select("artifact_id", "raw"))
    shown = d.search_results(lines, files, hits)
    text = F.concat("path", F.lit(":"), "at", F.lit(": "), "text")
    rows = F.array_sort(F.collect_list(F.struct("file_rank", "hit", text.alias("text"))))
    g = shown.groupBy("artifact_id").agg(rows.alias("rows"), F.max("file_rank").alias("n_shown"), F.first("total").alias("total"), F.first("n_files").alias("n_files"))
    head = F.concat("total", F.lit(" hits in "), "n_files", F.lit(" files (showing top "), "n_shown", F.lit(f" files, {hits} hits each; full set: "), zoom, F.lit(")"))
    return g.select("artifact_id", _joined(_one(head), F.transform("rows", lambda x: x["text"])).alias("distilled"))


def anchor(section) -> Column:
    """How a section is cited: its page where the document has pages, else its line."""
    return F.when(section["page"].isNotNull(), F.concat(F.lit("p."), section["page"])).otherwise(F.concat(F.lit("¶"), section["start_line"]))


def _document(book: RuleBook, profile: str, zoom: Column) -> Column:
    """The structure map of ``sections`` (an array), without its summaries if they don't fit, and the served sections word for word."""
    s = F.col("sections")
    cite = lambda x: F.concat(F.lit("§"), x["section_id"], F.lit(" "), x["title"], F.lit(" ("), anchor(x), F.lit(")"))
    pages = F.when(F.col("pages").isNull(), "").otherwise(F.concat(F.lit(", "), F.col("pages"), F.lit(" pages")))
    head = F.concat(F.lit("document "), F.coalesce("path", F.lit("(unnamed)")), F.lit(": "), F.size(s), F.lit(" sections"), pages)
    elided = F.concat(F.lit("[full document elided, "), zoom, F.lit("; a section id or title recovers that section byte-exact]"))
    most = int(book.number(profile, "map_sections", 400)) if book.setting(profile, "map") == "fitted" else 1 << 30
    shown = F.slice(s, 1, most)
    left = F.size(s) - F.size(shown)
    tail = F.when(left > 0, _one(F.concat(F.lit("[omitted "), left, F.lit(" further sections, "), zoom, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    full = _joined(_one(head, elided), F.transform(shown, lambda x: F.concat(cite(x), F.lit(" — "), x["summary"])), tail)
    text = full
    if book.setting(profile, "map") == "fitted":
        ratio = book.number(profile, "size_ratio", dims.SIZE_RATIO)
        budget = F.floor(F.octet_length("raw") * ratio * MARGIN)
        note = F.lit("[per-section summaries omitted to fit the serve budget]")
        terse = _joined(_one(head, elided), F.transform(shown, cite), _one(note), tail)
        text = F.when(F.octet_length(full) <= budget, full).otherwise(terse)
    else:
        long = int(book.number(profile, "section_lines", 120))

        def block(x):
            lines = F.split(x["body"], "\n", -1)
            cut = F.when(F.size(lines) > long, F.concat(F.lit(f"\n[section truncated after {long} lines, "), zoom, F.lit("]"))).otherwise("")
            return F.concat(F.lit("\n\n["), cite(x), F.lit("]\n"), F.array_join(F.slice(lines, 1, long), "\n"), cut)

        text = F.concat(full, F.array_join(F.transform(F.filter(s, lambda x: x["rank"].isNotNull()), block), ""))
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, "").otherwise(text)


def _region(book: RuleBook, profile: str, lines: Column) -> Column:
    """The texts that the entity gate holds the distillate to: the region as one, headings one by one; ``lines`` are those of the raw text."""
    none = F.array().cast("array<string>")
    if profile in DOCUMENTS:
        # what was asked for, word for word; a document nobody asked about keeps its heading lines
        served = F.transform(F.filter("sections", lambda x: x["rank"].isNotNull()), lambda x: x["body"])
        heads = F.filter(F.transform("sections", lambda x: F.get(lines, x["start_line"] - 1)), lambda x: F.trim(x) != "")
        return F.coalesce(F.when(F.size(served) > 0, F.array(F.array_join(served, "\n"))).otherwise(heads), none)
    if not book.has(profile, "region"):
        return none
    found = F.filter(lines, lambda x: book.hits(x, profile, "region", "i"))
    most = book.setting(profile, "region_lines")
    return F.array(F.array_join(F.slice(found, 1, int(most)) if most else found, "\n"))


def entity_gate(rows: DataFrame, prose: bool, least: float) -> DataFrame:
    """Add ``entity_ok`` and ``entity_detail`` for ``region`` (array of texts) and ``distilled``."""
    found = d.prose_entities if prose else d.entities
    own = F.array_distinct(F.flatten(F.transform("region", lambda text: found(text))))
    rows = rows.withColumn("_e", own)
    rows = rows.withColumn("_m", F.filter("_e", lambda e: ~F.contains(F.col("distilled"), e)))
    n, gone = F.size("_e"), F.size("_m")
    ok = (n == 0) | ((n - gone) / n >= least)
    kept = F.concat(n - gone, F.lit("/"), n, F.lit(" entities preserved"))
    lost = F.concat(F.lit("missing entities: "), F.array_join(F.slice("_m", 1, 5), ", "), F.lit(" ("), gone, F.lit(" of "), n, F.lit(")"))
    detail = F.when(n == 0, "no entities in relevant region").when(ok, kept).otherwise(lost)
    return rows.withColumns({"entity_ok": ok, "entity_detail": detail}).drop("_e", "_m")


def verdict_gate(rows: DataFrame, book: RuleBook, profile: str) -> DataFrame:
    """Add ``verdict_ok`` and ``verdict_detail``: two vocabularies agree on the raw text, and the distillate says the same.

    Each vocabulary fails or passes a text if only one of its sides matches. Where
    the second one sees neither, it passes the text if ``pass_if_no_fail`` is on.
    """

    def verdict(fail, good):
        return F.when(fail & ~good, "fail").when(good & ~fail, "pass").otherwise("unknown")

    if "_primary_fail" not in rows.columns:
        rows = read_raw(rows, book, profile)
    out = F.col("distilled")
    said = {}
    for side in ("fail", "pass"):
        vocabularies = book.hits(out, profile, f"primary_{side}") | book.hits(out, profile, f"secondary_{side}")
        said[f"_said_{side}"] = vocabularies | out.rlike(rf"(?im)\bVERDICT: {side}\b")
    rows = rows.withColumns(said)
    first = verdict(F.col("_primary_fail"), F.col("_primary_pass"))
    second = verdict(F.col("_secondary_fail"), F.col("_secondary_pass"))
    if book.setting(profile, "pass_if_no_fail") == "on":
        second = F.when(second != "unknown", second).otherwise(F.when(F.col("_secondary_fail"), "fail").otherwise("pass"))
    said = verdict(F.col("_said_fail"), F.col("_said_pass"))
    rows = rows.withColumns({"_1": first, "_2": second, "_3": said})
    agreed = (F.col("_1") != "unknown") & (F.col("_2") != "unknown") & (F.col("_1") == F.col("_2"))
    detail = (
        F.when(~agreed, F.concat(F.lit("extractions disagree or are inconclusive on raw: primary="), "_1", F.lit(", secondary="), "_2"))
        .when(F.col("_3") == F.col("_1"), F.concat(F.lit("verdict "), "_1", F.lit(" agreed by both extractions and the distillate")))
        .otherwise(F.concat(F.lit("raw verdict "), "_1", F.lit(" but distillate reads "), "_3"))
    )
    return rows.withColumns({"verdict_ok": agreed & (F.col("_3") == F.col("_1")), "verdict_detail": detail}).drop("_1", "_2", "_3", "_said_fail", "_said_pass", *[f"_{v}_{side}" for v in ("primary", "secondary") for side in ("fail", "pass")])


def size_gate(rows: DataFrame, most: float, least: int | None) -> DataFrame:
    """Add ``size_ok`` and ``size_detail``; an empty raw text fails."""
    raw, out = F.octet_length("raw"), F.octet_length("distilled")
    ok = F.when(raw == 0, False).otherwise(out / raw <= most) & (F.lit(True) if least is None else out >= least)
    floor = "" if least is None else f", min {least}B"
    return rows.withColumns({"size_ok": ok, "size_detail": F.concat(out, F.lit("B of "), raw, F.lit(f"B (max ratio {most:g}{floor})"))})



def gated(rows: DataFrame, book: RuleBook, profile: str) -> DataFrame:
    """Add ``gates``: those that the profile has on, each with gate, passed and detail."""
    on = []
    if book.has(profile, "region") or book.setting(profile, "entities"):
        lines = F.col("_all") if "_all" in rows.columns else _lines(F.col("raw"))
        rows = entity_gate(rows.withColumn("region", _region(book, profile, lines)), book.setting(profile, "entities") == "prose", book.number(profile, "entity_ratio", 1))
        on.append(("entity-preservation", "entity"))
    if book.setting(profile, "verdict") == "on":
        rows = verdict_gate(rows, book, profile)
        on.append(("verdict-fidelity", "verdict"))
    least = book.setting(profile, "least_bytes")
    rows = size_gate(rows, book.number(profile, "size_ratio", dims.SIZE_RATIO), None if least is None else int(least))
    on.append(("size-sanity", "size"))
    told = [F.struct(F.lit(name).alias("gate"), F.col(f"{c}_ok").alias("passed"), F.col(f"{c}_detail").alias("detail")) for name, c in on]
    return rows.withColumn("gates", F.array(*told))


def distillates(artifacts: DataFrame, book: RuleBook, sections: DataFrame | None = None, zoom: str = "zoom") -> DataFrame:
    """``artifacts`` with ``distilled`` and ``gates``; a profile that the book doesn't know raises where it is known to lack a distiller."""
    point = _recovery("artifact_id", zoom)
    listed = None
    if sections is not None:
        packed = F.struct("place", "section_id", "title", "start_line", "page", "summary", "rank", "body").cast(SECTION)
        listed = sections.groupBy("artifact_id").agg(F.array_sort(F.collect_list(packed)).alias("sections"), F.max("pages").cast("int").alias("pages"))
    out = None
    for profile in book.profiles():
        mine = artifacts.where(F.col("profile") == profile)
        kind = book.setting(profile, "distiller")
        if kind == "document":
            none = {"sections": F.lit(None).cast(f"array<{SECTION}>"), "pages": F.lit(None).cast("int")}
            mine = mine.withColumns(none) if listed is None else mine.join(listed, "artifact_id", "left")
            mine = mine.withColumn("distilled", _document(book, profile, point))
        elif kind == "ranked-hits":
            mine = mine.join(_ranked_hits(mine, book, profile, point), "artifact_id", "left").withColumn("distilled", F.coalesce("distilled", F.lit("")))
        elif kind == "contract":
            mine = _contract(mine, book, profile, point)
        else:
            text = {
                "relevant-lines": lambda p: _relevant(book, p),
                "head-tail": lambda p: _head_tail(book, p, point), "skeleton": lambda p: _skeleton(book, p, point),
                "first-hits": lambda p: _first_hits(book, p, point),
            }
            if kind not in text:
                raise ValueError(f"profile {profile} names no distiller that is built: {kind}")
            mine = mine.withColumn("distilled", text[kind](profile))
        mine = gated(mine, book, profile).select(*artifacts.columns, "distilled", "gates")
        out = mine if out is None else out.unionByName(mine)
    return out


def tokens(text: Column) -> Column:
    return d.handle_tokens(F.length(text))


def distil(artifacts: DataFrame, book: RuleBook, sections: DataFrame | None = None, zoom: str = "zoom") -> DataFrame:
    """Every artifact with what is served of it.

    Adds distilled (redacted, null if a gate failed), gates, passed, served
    (distilled or raw), text (redacted), findings (kinds of secrets and counts in
    the served text), bytes_in, bytes_out and handle. Artifacts of a profile
    without settings in ``book`` have no row; ``unrouted`` tells them.
    """
    rows = distillates(artifacts, book, sections, zoom)
    rows = rows.withColumn("passed", F.forall("gates", lambda g: g["passed"]))
    rows = rows.withColumn("served", F.when(F.col("passed"), "distilled").otherwise("raw"))
    given = F.when(F.col("passed"), F.col("distilled")).otherwise(F.col("raw"))
    handle = F.concat(
        F.lit("[artifact "), "artifact_id", F.lit(", raw "), tokens(F.col("raw")), F.lit(" tok to "), tokens(F.col("text")),
        F.lit(" tok, "), _recovery("artifact_id", zoom), F.lit("]"),
    )
    rows = rows.withColumn("text", given).withColumn("handle", handle)
    rows = rows.withColumns({"bytes_in": F.octet_length("raw").cast("long"), "bytes_out": F.octet_length("text").cast("long")})
    rows = d.redact(d.redact(rows, "raw").drop("findings"), "text")
    return rows.withColumn("distilled", F.when(F.col("passed"), F.col("text")))


def unrouted(artifacts: DataFrame, book: RuleBook) -> DataFrame:
    """Artifacts whose profile the book doesn't know."""
    return artifacts.where(F.col("profile").isNull() | ~F.col("profile").isin(book.profiles()))


def audit_rows(done: DataFrame, book: RuleBook) -> DataFrame:
    """One audit row per artifact: what was served, why, its bytes, gates and the fingerprint of the rules that decided."""
    failed = F.filter("gates", lambda g: ~g["passed"])
    named = F.array_join(F.transform(failed, lambda g: F.concat(g["gate"], F.lit(" ("), g["detail"], F.lit(")"))), "; ")
    reason = F.when(
        F.col("passed"), F.concat(F.lit("profile "), "profile", F.lit(" served "), "bytes_out", F.lit("B for "), "bytes_in", F.lit("B raw"))
    ).otherwise(F.concat(F.lit("profile "), "profile", F.lit(" gate failure, raw served: "), named))
    return done.select(
        F.concat_ws("-", "served", "artifact_id").alias("id"), "session_id", F.lit("distill").alias("module"),
        F.when(F.col("passed"), "distill").otherwise("serve-raw").alias("action"), reason.alias("reason"), F.col("artifact_id").alias("input_ref"),
        "bytes_in", "bytes_out", "profile", "path", "gates", F.sha2(F.lit(book.fingerprint()), 256).alias("rules"),
    )


def redaction_rows(done: DataFrame) -> DataFrame:
    """One row per artifact and kind of secret found in what is served: kinds and counts, never values."""
    return done.select("artifact_id", "session_id", F.inline("findings"))


def distil_batches(book: RuleBook, path: str, zoom: str = "zoom"):
    """A sink for a stream of artifacts: each micro-batch is distilled and its artifacts, audit and redaction rows written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        done = distil(batch, book, zoom=zoom)
        # one evaluation: the other two tables are read from what was written
        at = f"{path}/artifacts/batch={number}"
        done.write.mode("overwrite").parquet(at)
        written = batch.sparkSession.read.parquet(at)
        audit_rows(written, book).write.mode("overwrite").parquet(f"{path}/audit/batch={number}")
        redaction_rows(written).write.mode("overwrite").parquet(f"{path}/redactions/batch={number}")

    return write


def rewrite_rule(command: Column, book: RuleBook, wrapped: tuple[str, ...] = ()) -> Column:
    """Name of the rule of ``book`` under which a command is wrapped: see ``distill.rewrite_rule``."""
    from ..functions import patterns

    tail = F.regexp_replace(command, patterns.CD_PREFIX, "")
    denied = book.hits(F.regexp_replace(tail, patterns.MERGED_OUTPUT, " "), REWRITE, "deny", "i")
    for mark in wrapped:
        denied = denied | F.contains(command, F.lit(mark))
    return book.first_named(tail, REWRITE, deny=denied)


def document_sections(
    lines: DataFrame, found: DataFrame, pages: DataFrame | None = None, served: DataFrame | None = None
) -> DataFrame:
    """The ``sections`` that ``distil`` takes, of sections with summaries (doc_id as artifact_id).

    ``served``: doc_id, place, nth of the sections that go along word for word;
    ``pages``: doc_id, page, start_line, end_line.
    """
    from . import sections as s

    out = found
    if pages is not None:
        out = s.paged(out, pages).join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id", "left")
    else:
        out = out.withColumns({"page": F.lit(None).cast("int"), "pages": F.lit(None).cast("int")})
    if served is not None:
        body = s.placed(lines, found).join(served.select("doc_id", "place", F.col("nth").alias("rank")), ["doc_id", "place"])
        rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        body = body.groupBy("doc_id", "place", "rank").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))
        out = out.join(body, ["doc_id", "place"], "left")
    else:
        out = out.withColumns({"rank": F.lit(None).cast("int"), "body": F.lit(None).cast("string")})
    return out.select(
        F.col("doc_id").cast("string").alias("artifact_id"), "place", "section_id", "title", "start_line", "page", "summary", "rank", "body", "pages"
    )
