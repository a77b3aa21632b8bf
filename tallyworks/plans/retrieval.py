"""Queries of evidence, serves, zooms, handles and corpus tables, with SQL twins where SQL says them plainly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as p
from ..operators import retrieval as r
from ..operators import sections as s
from .registry import Registry
from .sections import _CITE, _RANKED, _HEADS, _MAP_HEAD, _PAGES, _RET, _SECT, _SUMMED, _V, _found, _pages, _q, lines
from .views import duckdb, table, view

R = Registry()
add = R.add

_GOAL = "[" + ", ".join(f"'{w}'" for w in p.GOAL_STOPWORDS) + "]"
_GKW = f"list_distinct(list_filter(list_transform(list_filter(string_split_regex(question, '[^A-Za-z0-9_]+'), lambda w: length(w) >= 4), lambda w: lower(w)), lambda w: NOT list_contains({_GOAL}, w)))"


def questions(spark, sf_dir):
    return view(spark, sf_dir, "v_questions")


@add("d14_goal_keywords", duckdb("v_questions") + f" SELECT question_id, array_to_string(list_sort({_GKW}), ',') AS keywords FROM v_questions")
def d14(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", F.array_join(F.array_sort(s.goal_keywords(F.col("question"))), ",").alias("keywords"))


_GOALS = "SELECT item_id AS question_id, CASE item_id % 4 WHEN 0 THEN concat('Fix the ', text) WHEN 1 THEN 'so is it' WHEN 2 THEN 'see §21' ELSE text END AS question FROM benchmark"


@add(
    "d24_refusals",
    f"WITH g AS ({_GOALS}) SELECT question_id, CASE WHEN regexp_matches(question, {_q(p.MUTATION_OPENER)}) THEN 'goal requires a mutation' WHEN len({_GKW}) = 0 AND NOT regexp_matches(question, {_q(p.SECTION_REF)}) AND NOT regexp_matches(question, {_q(p.SECTION_MARK)}) THEN 'goal too vague to search' END AS refusal FROM g",
)
def d24_refusals(spark, sf_dir):
    """Every fourth item asks for a change, every fourth names nothing, every fourth a section alone."""
    g = spark.sql(_GOALS.replace("FROM benchmark", "FROM {b}"), b=table(spark, sf_dir, "benchmark"))
    return g.select("question_id", r.refusal(F.col("question")).alias("refusal"))


_TOP = f"""top AS (SELECT question_id, doc_id, rank FROM ({_RANKED}) y WHERE rank <= 6),
 pl AS (SELECT s.doc_id, s.place, s.start_line, l.line_no, l.line FROM sect s JOIN v_headed_lines l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line)"""


@add(
    "d24_evidence",
    _RET
    + f""", {_TOP}, best AS (SELECT question_id, doc_id, place, rank, r, start_line FROM (SELECT s.*, rank, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY tier DESC, ref_rank DESC, volume DESC, place) AS r FROM scores s JOIN top USING (question_id, doc_id) WHERE tier > 0) x JOIN sect USING (doc_id, place) WHERE r <= 2),
 h AS (SELECT k.question_id, k.doc_id, t.rank, k.place, k.line_no, k.n FROM kl k JOIN top t USING (question_id, doc_id)),
 inner_ AS (SELECT h.question_id, h.doc_id, h.rank, b.r, row_number() OVER (PARTITION BY h.question_id, h.doc_id, h.place ORDER BY n DESC, line_no) AS k, h.place, line_no FROM h JOIN best b ON b.question_id = h.question_id AND b.doc_id = h.doc_id AND b.place = h.place WHERE line_no <> b.start_line),
 outer_ AS (SELECT question_id, doc_id, rank, 0 AS r, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY n DESC, line_no) AS k, place, line_no FROM h ANTI JOIN best USING (question_id, doc_id)),
 ev AS (SELECT question_id, doc_id, rank, r, 0 AS k, place, start_line AS line_no FROM best UNION ALL SELECT * FROM inner_ WHERE k <= 2 UNION ALL SELECT * FROM outer_ WHERE k <= 2)
 SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, r, k) AS INT) AS nth, doc_id, place, line_no, substr(line, 1, 200) AS snippet FROM ev JOIN v_headed_lines USING (doc_id, line_no)""",
)
def d24(spark, sf_dir):
    return r.evidence(questions(spark, sf_dir), _found(spark, sf_dir), lines(spark, sf_dir))


_HITS = "SELECT artifact_id AS question_id, regexp_extract(line, '^([^:]+):', 1) AS path, line_no, line FROM v_search_hits"


@add(
    "d24_code_evidence",
    duckdb("v_search_hits")
    + f""", h AS ({_HITS}), c AS (SELECT *, row_number() OVER (PARTITION BY question_id, path ORDER BY line_no) AS k, count(*) OVER (PARTITION BY question_id, path) AS hits FROM h)
 SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, path, k) AS INT) AS nth, path, line_no, substr(line, 1, 200) AS snippet FROM c WHERE k <= 3""",
)
def d24_code(spark, sf_dir):
    return r.code_evidence(spark.sql(_HITS.replace("v_search_hits", "{h}"), h=view(spark, sf_dir, "v_search_hits")))


@add(
    "d09_document_serves",
    _RET
    + f""", {_TOP}, {_SUMMED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM summed),
 maps AS (SELECT doc_id, count(*) AS sections, {_MAP_HEAD} string_agg({_CITE}, ' — ', summary), chr(10) ORDER BY r) FILTER (WHERE r <= 400), CASE WHEN count(*) > 400 THEN concat(chr(10), '[omitted ', count(*) - 400, ' further sections]') ELSE '' END) AS whole FROM ranked GROUP BY doc_id),
 b4 AS (SELECT question_id, doc_id, place FROM (SELECT question_id, doc_id, place, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY tier DESC, ref_rank DESC, volume DESC, place) AS r FROM scores WHERE tier > 0 OR volume > 0) x JOIN top USING (question_id, doc_id) WHERE r <= 4),
 bodies AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no - start_line < 3) AS body FROM pl GROUP BY doc_id, place),
 blocks AS (SELECT doc_id, place, concat(chr(10), chr(10), '[§', section_id, ' ', title, ' (¶', start_line, ')]', chr(10), body, CASE WHEN n > 3 THEN concat(chr(10), '[section truncated after 3 lines]') ELSE '' END) AS block FROM bodies JOIN sect USING (doc_id, place))
 SELECT question_id, doc_id, sections, concat(whole, string_agg(block, '' ORDER BY place)) AS text FROM b4 JOIN blocks USING (doc_id, place) JOIN maps USING (doc_id) GROUP BY question_id, doc_id, sections, whole""",
)
def d09(spark, sf_dir):
    """Sections are cut after three lines, so that both forms occur."""
    return r.document_serves(questions(spark, sf_dir), _found(spark, sf_dir), lines(spark, sf_dir), 3)


def zooms(spark, sf_dir):
    """One zoom per benchmark item into a document: structural queries, a symbol, words of the item, and words that no text has."""
    n = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n"))
    i = F.col("item_id") % 8
    title = F.concat(F.lit("topic "), F.col("doc_id") % 9, F.lit(" part 6"))
    fixed = {0: F.lit("page 2"), 1: F.lit("§ 1"), 2: title, 3: F.lit("section 2 topic"), 4: F.lit("section 1 qqq"), 5: F.lit("body of sym2"), 6: F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)}
    query = None
    for k, v in fixed.items():
        query = F.when(i == k, v) if query is None else query.when(i == k, v)
    b = table(spark, sf_dir, "benchmark").join(n).withColumn("doc_id", F.col("item_id") % F.col("n"))
    return b.select(F.col("item_id").alias("zoom_id"), "doc_id", query.otherwise("qqq zzz").alias("query"))


@add("a26_zoom_slices")
def a26(spark, sf_dir):
    return r.zoom_slices(zooms(spark, sf_dir), _found(spark, sf_dir), _pages(spark, sf_dir), lines(spark, sf_dir))


@add("a27_zoom_ladder")
def a27(spark, sf_dir):
    """Behind every document stands the next one; every section is a symbol's body."""
    found = _found(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("nth"), (F.col("doc_id") + 1).alias("source_id"))
    symbols = found.select("doc_id", F.concat(F.lit("sym"), "place").alias("symbol"), "start_line", "end_line")
    return r.zoom_ladder(zooms(spark, sf_dir), sources, found, _pages(spark, sf_dir), lines(spark, sf_dir), symbols)


_STORE = "SELECT seq, concat('corpus', seq % 3) AS corpus, path, concat(content, CASE WHEN seq % 4 = 0 THEN '' ELSE concat('-', seq % 3) END) AS raw FROM v_serves"
_REF = "concat('F', substr({h}, 1, 4), '@', substr({g}, 1, 16))"
_HANDLES = "SELECT CASE seq % 3 WHEN 0 THEN concat('a', seq) WHEN 1 THEN {ref} ELSE concat('b', seq) END AS handle, CASE WHEN seq % 2 = 0 THEN corpus END AS asked FROM store"


@add(
    "a28_handles",
    duckdb("v_serves")
    + f""", store AS ({_STORE}), refs AS (SELECT *, {_REF.format(h="sha256(path)", g="sha256(raw)")} AS ref FROM store), handles AS (SELECT DISTINCT * FROM ({_HANDLES.format(ref="ref").replace("FROM store", "FROM refs")}) x),
 ways AS (SELECT corpus, concat('a', seq) AS handle, 0 AS rank, 'artifact' AS kind, concat('a', seq) AS artifact_id FROM refs WHERE path <> 'f6' UNION ALL SELECT corpus, ref, 1, 'file', concat('a', max(seq)) FROM refs WHERE path <> 'f6' GROUP BY corpus, ref UNION ALL SELECT DISTINCT corpus, ref, 2, 'served', NULL FROM refs),
 held AS (SELECT corpus, handle, min_by(kind, rank) AS kind, min_by(struct_pack(a := artifact_id), rank).a AS artifact_id FROM ways GROUP BY corpus, handle),
 met AS (SELECT h.handle, h.asked, count(*) AS n, min(corpus) AS corpus, any_value(kind) AS kind, any_value(artifact_id) AS artifact_id FROM handles h JOIN held USING (handle) WHERE asked IS NULL OR asked = corpus GROUP BY h.handle, h.asked)
 SELECT h.handle, h.asked, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN corpus END AS corpus, CASE WHEN n = 1 THEN kind END AS kind, CASE WHEN n = 1 THEN artifact_id END AS artifact_id
 FROM handles h LEFT JOIN met ON met.handle = h.handle AND met.asked IS NOT DISTINCT FROM h.asked""",
)
def a28(spark, sf_dir):
    """Every serve is an artifact, but for one file that is only served; handles are ids, file references and dead ids."""
    store = spark.sql(_STORE.replace("v_serves", "{v}"), v=view(spark, sf_dir, "v_serves"))
    handles = spark.sql(_HANDLES.format(ref=_REF.format(h="sha2(path, 256)", g="sha2(raw, 256)")).replace("FROM store", "FROM {store}"), store=store)
    artifacts = store.where("path <> 'f6'").select("corpus", F.concat(F.lit("a"), "seq").alias("artifact_id"), "path", "raw", "seq")
    return r.resolved_handles(handles, artifacts, store.select("corpus", "path", F.col("raw").alias("content")))


def _corpora(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"))


_DOCS = "docs AS (SELECT source AS corpus, doc_id, concat('docs/', doc_id, '.txt') AS path FROM documents)"


@add(
    "d33_codex_documents",
    _V
    + f", {_HEADS}, {_SECT}, {_DOCS}, g AS (SELECT doc_id, min_by(title, place) AS title, string_agg(section_id, ',' ORDER BY place) FILTER (WHERE place <= 6) AS sections FROM sect GROUP BY doc_id) SELECT corpus, path, coalesce(nullif(title, ''), regexp_extract(path, '([^/]*)$', 1)) AS one_liner, coalesce(sections, '') AS sections FROM docs LEFT JOIN g USING (doc_id)",
)
def d33(spark, sf_dir):
    return r.codex_documents(_corpora(spark, sf_dir), _found(spark, sf_dir)).withColumn("sections", F.array_join("sections", ","))


@add("d33_glossary", "SELECT p_brand AS corpus, CAST(nth AS INT) AS nth, p_name AS term, p_type AS means FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS nth FROM part) x WHERE nth <= 40")
def d33_glossary(spark, sf_dir):
    """Brands stand for corpora, parts for their terms."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("corpus"), F.col("p_partkey").alias("place"), F.col("p_name").alias("term"), F.col("p_type").alias("means"))
    return r.glossary_heads(t)


_HASHED = """f AS (SELECT corpus, path, coalesce(string_agg(section_id, ',' ORDER BY place), '') AS hash FROM docs LEFT JOIN sect USING (doc_id) GROUP BY corpus, path),
 b AS (SELECT corpus, CAST(concat('0x', substr(sha256(path), 1, 8)) AS BIGINT) % 4096 AS bucket, concat(path, ':', hash) AS line FROM f),
 d AS (SELECT corpus, bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM b GROUP BY corpus, bucket),
 now_ AS (SELECT corpus, substr(sha256(string_agg(concat(lpad(CAST(bucket AS VARCHAR), 4, '0'), ':', digest), chr(10) ORDER BY bucket)), 1, 16) AS content_hash FROM d GROUP BY corpus)"""


@add(
    "d33_codex_versions",
    _V + f", {_HEADS}, {_SECT}, {_DOCS}, {_HASHED} SELECT corpus, content_hash, CAST(CASE WHEN length(corpus) % 2 = 0 THEN 4 ELSE 5 END AS INT) AS version FROM now_",
)
def d33_versions(spark, sf_dir):
    """Of corpora whose name has an odd length the last emission had other content; all stood at version 4."""
    docs, found = _corpora(spark, sf_dir), _found(spark, sf_dir)
    none = spark.createDataFrame([], "corpus string, content_hash string, version int")
    now = r.codex_versions(docs, found, none)
    same = F.length("corpus") % 2 == 0
    prior = now.select("corpus", F.when(same, F.col("content_hash")).otherwise("other").alias("content_hash"), F.lit(4).alias("version"))
    return r.codex_versions(docs, found, prior)
