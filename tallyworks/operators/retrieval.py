"""Documents served to questions: evidence, ask-aware serves, zooms, handles, corpus tables.

``questions``: question_id, question. ``found``: sections of documents.
``lines``: doc_id, line_no, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as p
from . import sections as s

#: Bounds of evidence, of a served section, of a zoom window, of a codex entry.
BEST_SECTIONS, BEST_LINES, SNIPPET, CODE_HITS = 2, 2, 200, 3
SERVED_SECTIONS, SECTION_LINES = 4, 120
AROUND, WINDOW_LINES = 2, 200
CODEX_SECTIONS, GLOSSARY_TERMS = 6, 40


def refusal(question):
    """Why a question isn't searched at all: it asks for a change, or names nothing to look for; else null."""
    empty = (F.size(s.goal_keywords(question)) == 0) & (F.size(s.refs_in(question)) == 0)
    return F.when(question.rlike(p.MUTATION_OPENER), "goal requires a mutation").when(empty, "goal too vague to search")


def evidence(questions: DataFrame, found: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that answer a question: question_id, nth, doc_id, place, line_no, snippet.

    Of each of its best documents the two best sections by tier, each with its
    first line and its two lines densest in keywords; of a document without
    such a section its two densest lines. Keywords count inside words too.
    """
    top = s.best_documents(questions, found, lines)
    found, lines = s.of_documents(found, top), s.of_documents(lines, top)
    scores = s.section_scores(questions, found, lines)
    pair = ["question_id", "doc_id"]
    best = scores.where("tier > 0").join(top, pair).withColumn("r", F.row_number().over(s._best(*pair))).where(F.col("r") <= BEST_SECTIONS)
    best = best.join(found.select("doc_id", "place", "start_line"), ["doc_id", "place"]).select(*pair, "place", "rank", "r", "start_line")
    hits = s.line_hits(questions, found, lines).join(top, pair)
    dense = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "line_no"))
    inside = hits.join(best.drop("rank"), [*pair, "place"]).where("line_no <> start_line").withColumn("k", dense(*pair, "place"))
    outside = hits.join(best.select(*pair).distinct(), pair, "left_anti").withColumns({"k": dense(*pair), "r": F.lit(0)})
    columns = [*pair, "rank", "r", "k", "place", "line_no"]
    heads = best.withColumns({"k": F.lit(0), "line_no": F.col("start_line")})
    rows = heads.select(*columns)
    for part in (inside, outside):
        rows = rows.unionByName(part.where(F.col("k") <= BEST_LINES).select(*columns))
    rows = rows.join(lines.select("doc_id", "line_no", F.substring("line", 1, SNIPPET).alias("snippet")), ["doc_id", "line_no"])
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "r", "k"))
    return rows.select("question_id", nth.alias("nth"), "doc_id", "place", "line_no", "snippet")


def code_evidence(hits: DataFrame) -> DataFrame:
    """The first three hits (question_id, path, line_no, line) of each file, files with most hits first."""
    order = Window.partitionBy("question_id", "path").orderBy("line_no")
    counts = hits.groupBy("question_id", "path").agg(F.count("*").alias("hits"))
    first = hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= CODE_HITS).join(counts, ["question_id", "path"])
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hits"), "path", "k"))
    return first.select("question_id", nth.alias("nth"), "path", "line_no", F.substring("line", 1, SNIPPET).alias("snippet"))


def section_heads(lines: DataFrame, found: DataFrame, most: int = SECTION_LINES) -> DataFrame:
    """(doc_id, place, n, body): the first ``most`` lines of every section and its number of lines."""
    inside = s.placed(lines, found).withColumn("i", F.col("line_no") - F.col("start_line"))
    shown = F.when(F.col("i") < most, F.struct("i", "line"))
    rows = F.array_sort(F.array_compact(F.collect_list(shown)))
    g = inside.groupBy("doc_id", "place").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))
    return g


def document_serves(questions: DataFrame, found: DataFrame, lines: DataFrame, most_lines: int = SECTION_LINES) -> DataFrame:
    """(question_id, doc_id, sections, text): the map of each of a question's best documents, then its best sections word for word.

    A section is cut after ``most_lines`` lines and says so.
    """
    top = s.best_documents(questions, found, lines)
    found, lines = s.of_documents(found, top), s.of_documents(lines, top)
    scores = s.section_scores(questions, found, lines).join(top, ["question_id", "doc_id"], "left_semi")
    best = s.best_sections(scores, SERVED_SECTIONS)
    named = found.select("doc_id", "place", F.concat(F.lit("[§"), "section_id", F.lit(" "), "title", F.lit(" (¶"), "start_line", F.lit(")]")).alias("cite"))
    bodies = section_heads(lines, found, most_lines).join(named, ["doc_id", "place"])
    cut = F.when(F.col("n") > most_lines, F.lit(f"\n[section truncated after {most_lines} lines]")).otherwise("")
    block = F.concat(F.lit("\n\n"), "cite", F.lit("\n"), "body", cut)
    parts = best.join(bodies.select("doc_id", "place", block.alias("block")), ["doc_id", "place"])
    rows = F.array_sort(F.collect_list(F.struct("nth", "block")))
    parts = parts.groupBy("question_id", "doc_id").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "").alias("tail"))
    maps = s.structure_map(s.summaries(lines, found))
    return parts.join(maps, "doc_id").select("question_id", "doc_id", "sections", F.concat("text", "tail").alias("text"))


def zoom_ranges(zooms: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """Line ranges that structural queries name: zoom_id, doc_id, kind, nth, start_line, end_line, rest.

    ``zooms``: zoom_id, doc_id, query. A page number, else a section id, else
    an exact title, else all sections that a reference in the query reaches;
    ``rest`` is what a reference leaves of the query. The first kind that
    finds something decides; other queries give no row.
    """
    q = F.trim("query")
    page = F.regexp_extract(q, p.PAGE_QUERY, 1)
    z = zooms.select("zoom_id", "doc_id", q.alias("query"), page.try_cast("int").alias("page"))
    span = ["start_line", "end_line"]
    by_page = z.join(pages.select("doc_id", "page", *span), ["doc_id", "page"]).withColumns({"kind": F.lit("page"), "place": F.lit(0)})
    text = z.where("page IS NULL").drop("page")
    key = F.regexp_replace(F.lower(F.regexp_replace("query", r"^§\s*", "")), r"\s+", "-")
    ids = found.select("doc_id", F.lower("section_id").alias("key"), "place", *span)
    by_id = text.withColumn("key", key).join(ids, ["doc_id", "key"]).withColumn("kind", F.lit("section"))
    titles = found.select("doc_id", F.lower("title").alias("key"), "place", *span)
    by_title = text.withColumn("key", F.lower("query")).join(titles, ["doc_id", "key"]).withColumn("kind", F.lit("title"))
    as_questions = text.select(F.struct("zoom_id", "doc_id").alias("question_id"), F.col("query").alias("question"))
    reached = s.ref_matches(as_questions, found, F.col("r.question_id.doc_id")).select(F.col("question_id.zoom_id").alias("zoom_id"), "doc_id", "place").distinct()
    by_ref = text.join(reached, ["zoom_id", "doc_id"]).join(found.select("doc_id", "place", *span), ["doc_id", "place"]).withColumn("kind", F.lit("reference"))
    columns = ["zoom_id", "doc_id", "query", "kind", "place", *span]
    rows = by_page.select(*columns)
    for part in (by_id, by_title, by_ref):
        rows = rows.unionByName(part.select(*columns))
    level = F.when(F.col("kind") == "page", 0).when(F.col("kind") == "section", 1).when(F.col("kind") == "title", 2).otherwise(3)
    rows = rows.withColumn("level", level).withColumn("least", F.min("level").over(Window.partitionBy("zoom_id", "doc_id"))).where("level = least")
    nth = F.row_number().over(Window.partitionBy("zoom_id", "doc_id").orderBy("place", "start_line"))
    rows = rows.withColumn("nth", nth).where("level = 3 OR nth = 1")
    said = F.aggregate(s.refs_in(F.col("query")), F.lower("query"), lambda text, r: F.replace(text, r["raw"], F.lit(" ")))
    rest = F.trim(F.regexp_replace(F.regexp_replace(said, r"§\s*[\w.-]+", " "), r"\s+", " "))
    return rows.select("zoom_id", "doc_id", "kind", "nth", *span, F.when(F.col("level") == 3, rest).otherwise("").alias("rest"))


def narrowed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows within two lines of a match, by ``keys`` in order of ``pos``: a line with the whole ``phrase``, else with any of its words.

    Case doesn't matter. ``met`` says whether a match exists in the group at
    all; a group without one has no row.
    """
    low, phrase = F.lower("line"), F.lower(F.trim("phrase"))
    words = F.filter(F.split(phrase, r"\s+"), lambda w: w != "")
    whole = F.contains(low, phrase) & (phrase != "")
    group = Window.partitionBy(*keys)
    near = group.orderBy("pos").rowsBetween(-AROUND, AROUND)
    flagged = rows.withColumns({"_p": whole, "_w": F.exists(words, lambda w: F.contains(low, w))})
    flagged = flagged.withColumn("_any", F.max("_p").over(group))
    hit = F.when(F.col("_any"), F.col("_p")).otherwise(F.col("_w"))
    return flagged.withColumn("_near", F.max(hit).over(near)).where("_near").drop("_p", "_w", "_any", "_near")


def _texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def _windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the first 200 lines near a match, with a note of what is left out."""
    near = narrowed(rows, keys)
    near = near.withColumns({"_r": F.row_number().over(Window.partitionBy(*keys).orderBy("pos")), "_n": F.count("*").over(Window.partitionBy(*keys))})
    kept = near.where(F.col("_r") <= WINDOW_LINES)
    left = kept.groupBy(*keys).agg(F.max(F.col("_n") - WINDOW_LINES).alias("left"))
    note = F.when(F.col("left") > 0, F.concat(F.lit("\n[omitted "), "left", F.lit(" more matching lines]"))).otherwise("")
    return _texts(kept, keys).join(left, keys).withColumn("text", F.concat("text", note)).drop("left")


def zoom_slices(zooms: DataFrame, found: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(zoom_id, doc_id, kind, text): what a structural query recovers, line for line.

    Several sections stand apart by a blank line. Words beyond a reference
    narrow within them, unless they match nothing there. A range is met with
    its lines by an equi-join on every line number, not by a range join.
    """
    ranges = zoom_ranges(zooms, found, pages)
    gap = F.when(F.col("nth") > 1, 1).otherwise(0)
    each = ranges.withColumn("line_no", F.explode(F.sequence(F.col("start_line") - gap, "end_line")))
    rows = each.join(lines, ["doc_id", "line_no"], "left").withColumns(
        {"line": F.when(F.col("line_no") < F.col("start_line"), "").otherwise(F.col("line")), "pos": F.struct("nth", "line_no"), "phrase": F.col("rest")}
    )
    keys = ["zoom_id", "doc_id", "kind"]
    whole = _texts(rows, keys)
    narrow = _windows(rows.where("phrase <> ''"), keys).withColumnRenamed("text", "narrow")
    return whole.join(narrow, keys, "left").select(*keys, F.coalesce("narrow", "text").alias("text"))


def zoom_ladder(zooms: DataFrame, sources: DataFrame, found: DataFrame, pages: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """What a zoom serves: zoom_id, step, doc_id, matched, text.

    ``zooms``: zoom_id, doc_id, query; ``sources``: doc_id, nth, source_id
    (documents behind a document); ``symbols``: doc_id, symbol, start_line,
    end_line. The first step that finds something serves: 1 own structure,
    2 structure of a source, 3 bodies of symbols that the query names, 4 own
    lines near a match, 5 those of a source, else 6 the whole text, unmatched.
    A query narrows what is served, it never bars access.
    """
    own = zooms.select("zoom_id", F.col("doc_id").alias("asked"), "doc_id", F.lit(0).alias("nth"), "query")
    behind = zooms.withColumnRenamed("doc_id", "asked").join(sources.withColumnRenamed("doc_id", "asked"), "asked")
    behind = behind.select("zoom_id", "asked", F.col("source_id").alias("doc_id"), "nth", "query")
    tries = own.unionByName(behind)
    pair = ["zoom_id", "doc_id"]
    ways = tries.select(*pair, "nth")
    sliced = zoom_slices(tries.select(*pair, "query"), found, pages, lines).join(ways, pair)
    sliced = sliced.select(*pair, "nth", F.when(F.col("nth") == 0, 1).otherwise(2).alias("step"), "text")
    near = _windows(tries.select(*pair, F.col("query").alias("phrase")).join(lines, "doc_id").withColumn("pos", F.col("line_no")), pair).join(ways, pair)
    near = near.select(*pair, "nth", F.when(F.col("nth") == 0, 4).otherwise(5).alias("step"), "text")
    named = zooms.select("zoom_id", "doc_id", F.explode(F.array_distinct(F.split(F.trim("query"), r"\s+"))).alias("symbol")).join(symbols, ["doc_id", "symbol"])
    body = named.withColumn("line_no", F.explode(F.sequence("start_line", "end_line"))).join(lines, ["doc_id", "line_no"])
    body = _texts(body.withColumn("pos", F.col("line_no")), pair).select(*pair, F.lit(0).alias("nth"), F.lit(3).alias("step"), "text")
    rows = sliced.unionByName(body).unionByName(near)
    order = Window.partitionBy("zoom_id").orderBy("step", "nth", "doc_id")
    served = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("zoom_id", "step", "doc_id", F.lit(True).alias("matched"), "text")
    rest = zooms.join(served.select("zoom_id"), "zoom_id", "left_anti").join(lines, "doc_id").withColumn("pos", F.col("line_no"))
    raw = _texts(rest, pair).select("zoom_id", F.lit(6).alias("step"), "doc_id", F.lit(False).alias("matched"), "text")
    return served.unionByName(raw)


def resolved_handles(handles: DataFrame, artifacts: DataFrame, served: DataFrame) -> DataFrame:
    """What a handle holds: handle, asked (a corpus or null), status, corpus, kind, artifact_id.

    A handle is an artifact's id or a file reference (path and content hash);
    ``handles``: handle, asked; ``artifacts``: corpus, artifact_id, path, raw,
    seq; ``served``: corpus, path, content. In a corpus the id comes before the
    latest artifact of a served path and hash, this before the served content
    alone. Held by several corpora and none asked for, it is ambiguous. Every
    way is reduced to one row per (corpus, reference) before the join.
    """
    ref = lambda text: F.concat(F.lit("F"), F.substring(F.sha2("path", 256), 1, 4), F.lit("@"), F.substring(F.sha2(text, 256), 1, 16))
    by_id = artifacts.groupBy("corpus", F.col("artifact_id").alias("handle")).agg(F.min("artifact_id").alias("artifact_id"))
    paths = served.select("corpus", "path").distinct()
    by_file = artifacts.join(paths, ["corpus", "path"], "left_semi").groupBy("corpus", ref("raw").alias("handle"))
    by_file = by_file.agg(F.max_by("artifact_id", F.struct("seq", "artifact_id")).alias("artifact_id"))
    by_content = served.where("content <> ''").groupBy("corpus", ref("content").alias("handle")).agg(F.lit(None).cast("string").alias("artifact_id"))
    held = None
    for rank, (kind, part) in enumerate((("artifact", by_id), ("file", by_file), ("served", by_content))):
        part = part.select("corpus", "handle", F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "artifact_id").alias("way"))
        held = part if held is None else held.unionByName(part)
    held = held.groupBy("corpus", "handle").agg(F.min("way").alias("way"))
    asked = handles.select("handle", "asked").distinct()
    met = asked.join(held, "handle").where("asked IS NULL OR asked = corpus")
    met = met.groupBy("handle", "asked").agg(F.count("*").alias("holders"), F.min(F.struct("corpus", "way")).alias("h"))
    out = asked.alias("a").join(met.alias("m"), (F.col("a.handle") == F.col("m.handle")) & F.col("a.asked").eqNullSafe(F.col("m.asked")), "left")
    status = F.when(F.col("m.holders") == 1, "resolved").when(F.col("m.holders") > 1, "ambiguous").otherwise("missing")
    only = lambda c: F.when(F.col("m.holders") == 1, F.col(c))
    return out.select("a.handle", "a.asked", status.alias("status"), only("m.h.corpus").alias("corpus"), only("m.h.way.kind").alias("kind"), only("m.h.way.artifact_id").alias("artifact_id"))


def codex_documents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(corpus, path, one_liner, sections): first title, else the file's name, and the ids of the first six sections.

    ``documents``: corpus, doc_id, path.
    """
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).where(F.col("r") <= CODEX_SECTIONS)
    rows = F.array_sort(F.collect_list(F.struct("r", "section_id")))
    heads = ranked.groupBy("doc_id").agg(F.max_by("title", -F.col("r")).alias("title"), F.transform(rows, lambda x: x["section_id"]).alias("sections"))
    line = F.coalesce(F.nullif("title", F.lit("")), F.regexp_extract("path", r"([^/]*)$", 1))
    none = F.array().cast("array<string>")
    return documents.join(heads, "doc_id", "left").select("corpus", "path", line.alias("one_liner"), F.coalesce("sections", none).alias("sections"))


def glossary_heads(terms: DataFrame) -> DataFrame:
    """The first forty terms (corpus, place, term, means) of each corpus."""
    order = Window.partitionBy("corpus").orderBy("place", "term")
    return terms.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= GLOSSARY_TERMS).select("corpus", "nth", "term", "means")


def codex_versions(documents: DataFrame, found: DataFrame, prior: DataFrame) -> DataFrame:
    """(corpus, content_hash, version): the version rises when a path or a list of section ids changes.

    ``prior``: corpus, content_hash, version of the last emission.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "section_id")))
    ids = found.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["section_id"]), ",").alias("hash"))
    files = documents.join(ids, "doc_id", "left").select("corpus", "path", F.coalesce("hash", F.lit("")).alias("hash"))
    now = s.corpus_fingerprint(files).select("corpus", F.substring("fingerprint", 1, 16).alias("content_hash"))
    was = prior.select("corpus", F.col("content_hash").alias("_h"), F.col("version").alias("_v"))
    version = F.when(F.col("_h") == F.col("content_hash"), F.col("_v")).otherwise(F.coalesce("_v", F.lit(0)) + 1)
    return now.join(was, "corpus", "left").select("corpus", "content_hash", version.alias("version"))
