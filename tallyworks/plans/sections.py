"""Queries of document structure and retrieval, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as p
from ..operators import sections as s
from .registry import Registry
from .views import duckdb, table, view

R = Registry()
add = R.add


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_V = duckdb("v_doc_lines", "v_headed_lines")
_NUM = f"regexp_extract(t, {_q(p.NUMBERED)}, 1)"
_HEADS = f"""trimmed AS (SELECT doc_id, line_no, line, trim(line) AS t FROM v_headed_lines),
kinds AS (SELECT doc_id, line_no, t AS heading, CASE WHEN t = '' OR length(t) > 100 THEN NULL
 WHEN {_NUM} <> '' AND NOT suffix(t, '.') AND NOT regexp_matches(regexp_extract(t, {_q(p.NUMBERED)}, 2), '^[a-z]') THEN 'numbered'
 WHEN regexp_matches(t, {_q(p.NAMED)}) THEN 'named' WHEN regexp_matches(t, {_q(p.LETTERED)}) AND NOT suffix(t, '.') THEN 'lettered'
 WHEN regexp_matches(t, {_q(p.ALL_CAPS)}) THEN 'caps' WHEN regexp_matches(t, {_q(p.TITLE_CASE)}) THEN 'title' END AS kind FROM trimmed),
heads AS (SELECT doc_id, line_no, kind, CAST(CASE kind WHEN 'numbered' THEN len(string_split(regexp_extract(heading, {_q(p.NUMBERED)}, 1), '.')) WHEN 'named' THEN 2 WHEN 'title' THEN 2 WHEN 'lettered' THEN 3 ELSE 1 END AS INT) AS level, heading FROM kinds WHERE kind IS NOT NULL)"""
_SECT = f"""marked AS (SELECT l.doc_id, l.line_no, l.line, h.kind, h.level, h.heading, count(h.kind) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS part FROM v_headed_lines l LEFT JOIN heads h ON h.doc_id = l.doc_id AND h.line_no = l.line_no),
agg AS (SELECT doc_id, part, min(line_no) AS start_line, greatest(coalesce(max(line_no) FILTER (WHERE trim(line) <> ''), 0), min(line_no)) AS end_line, max(kind) AS kind, max(level) AS level, max(heading) AS heading,
 min_by(trim(line), line_no) FILTER (WHERE trim(line) <> '') AS first_text FROM marked GROUP BY doc_id, part),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS place FROM agg WHERE part > 0 OR first_text IS NOT NULL),
named AS (SELECT *, CASE WHEN heading IS NULL THEN substr(first_text, 1, 80) WHEN kind = 'numbered' THEN regexp_extract(heading, {_q(p.NUMBERED)}, 2) WHEN kind = 'lettered' THEN regexp_extract(heading, {_q(p.LETTERED)}, 2) ELSE heading END AS title,
 CASE kind WHEN 'numbered' THEN regexp_extract(heading, {_q(p.NUMBERED)}, 1) WHEN 'named' THEN lower(concat(regexp_extract(heading, {_q(p.NAMED)}, 1), '-', regexp_extract(heading, {_q(p.NAMED)}, 2))) WHEN 'lettered' THEN lower(regexp_extract(heading, {_q(p.LETTERED)}, 1)) ELSE concat('s', place) END AS base FROM kept),
sect AS (SELECT doc_id, CAST(place AS INT) AS place, CASE WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS section_id, title, CAST(coalesce(level, 1) AS INT) AS level, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY start_line) AS n FROM named) x)"""


def lines(spark, sf_dir):
    return view(spark, sf_dir, "v_headed_lines")


def _found(spark, sf_dir):
    return s.plain_sections(lines(spark, sf_dir))


@add("d02_headings", _V + f", {_HEADS} SELECT * FROM heads")
def d02(spark, sf_dir):
    return s.headings(lines(spark, sf_dir))


@add("d03_sections", _V + f", {_HEADS}, {_SECT} SELECT * FROM sect")
def d03(spark, sf_dir):
    return _found(spark, sf_dir)


_SUMMED = f"""body AS (SELECT s.doc_id, s.place, trim(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '\\s+', ' ', 'g')) AS flat FROM sect s JOIN v_headed_lines l ON l.doc_id = s.doc_id AND l.line_no > s.start_line AND l.line_no <= s.end_line GROUP BY s.doc_id, s.place),
 sent AS (SELECT doc_id, place, CASE WHEN regexp_extract(flat, '^(.*?[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(flat, '^(.*?[.!?])(?:\\s|$)', 1) ELSE flat END AS x FROM body),
 summed AS (SELECT s.*, CASE WHEN coalesce(x, '') = '' THEN title WHEN length(x) > 240 THEN concat(substr(x, 1, 237), '...') ELSE x END AS summary FROM sect s LEFT JOIN sent t ON t.doc_id = s.doc_id AND t.place = s.place)"""


@add(
    "d05_summaries",
    _V
    + f", {_HEADS}, {_SECT}, {_SUMMED} SELECT doc_id, place, summary FROM summed",
)
def d05(spark, sf_dir):
    return s.summaries(lines(spark, sf_dir), _found(spark, sf_dir)).select("doc_id", "place", "summary")


_PAGES = "pages_ AS (SELECT doc_id, CAST(floor((line_no - 1) / 10) AS INT) + 1 AS page, min(line_no) AS start_line, max(line_no) AS end_line, CASE doc_id % 4 WHEN 3 THEN '- 1 -' ELSE concat('Header  ', doc_id % 4) END AS header FROM v_doc_lines GROUP BY doc_id, CAST(floor((line_no - 1) / 10) AS INT) + 1)"


def _pages(spark, sf_dir):
    page = (F.floor((F.col("line_no") - 1) / 10) + 1).cast("int")
    g = view(spark, sf_dir, "v_doc_lines").groupBy("doc_id", page.alias("page")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return g.withColumn("header", F.when(F.col("doc_id") % 4 == 3, "- 1 -").otherwise(F.concat(F.lit("Header  "), F.col("doc_id") % 4)))


@add("d06_section_pages", _V + f", {_HEADS}, {_SECT}, {_PAGES} SELECT s.doc_id, s.place, p.page FROM sect s LEFT JOIN pages_ p ON p.doc_id = s.doc_id AND s.start_line BETWEEN p.start_line AND p.end_line")
def d06(spark, sf_dir):
    return s.paged(_found(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "place", "page")


@add("d07_running_headers", _V + f", {_PAGES} SELECT doc_id, page, replace(header, '  ', ' ') AS header FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, header) AS n FROM pages_) x WHERE n >= 3 AND header <> '- 1 -'")
def d07(spark, sf_dir):
    return s.running_headers(_pages(spark, sf_dir).select("doc_id", "page", "header"))


_STOP = "[" + ", ".join(f"'{w}'" for w in p.STOPWORDS) + "]"
_KW = f"list_distinct(list_filter(list_transform(list_filter(string_split_regex(question, '[^A-Za-z0-9_-]+'), lambda w: length(w) >= 4), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w)))"


@add("d14_keywords", duckdb("v_questions") + f" SELECT question_id, array_to_string(list_sort({_KW}), ',') AS keywords FROM v_questions")
def d14(spark, sf_dir):
    return view(spark, sf_dir, "v_questions").select("question_id", F.array_join(F.array_sort(s.keywords(F.col("question"))), ",").alias("keywords"))


def _refs_sql(source: str, key: str, text: str, name: str) -> str:
    """Labelled and marked references of ``text`` as a CTE (key, label, number, raw)."""
    label = "CASE WHEN label NOT IN ('section', 'sec', '') THEN label END"
    half = lambda g: f"regexp_extract(id, {_q(p.ID_HALVES)}, {g})"
    each = lambda r, g: f"lower(unnest(regexp_extract_all({text}, {_q(r)}, {g})))"
    return f"""{name} AS (SELECT {key}, {label} AS label, number, raw FROM (SELECT {key}, {each(p.SECTION_REF, 1)} AS label, {each(p.SECTION_REF, 2)} AS number, {each(p.SECTION_REF, 0)} AS raw FROM {source}) x
 UNION ALL SELECT {key}, {label}, CASE WHEN number = '' THEN id ELSE number END, raw FROM (SELECT {key}, id, raw, {half(1)} AS label, {half(2)} AS number FROM (SELECT {key}, {each(p.SECTION_MARK, 1)} AS id, {each(p.SECTION_MARK, 0)} AS raw FROM {source}) x) y)"""


_REFS = _refs_sql("v_questions", "question_id", "question", "refs0") + ", refs AS (SELECT question_id, label, number, min(raw) AS raw FROM refs0 GROUP BY question_id, label, number)"


@add("d15_section_refs", duckdb("v_questions") + f", {_REFS} SELECT * FROM refs")
def d15(spark, sf_dir):
    return s.section_refs(view(spark, sf_dir, "v_questions"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in p.HEADING_STOPWORDS) + ")"
_norm = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
_sig = lambda x: f"list_filter({x}, lambda w: w NOT IN {_STOPS})"
_HID, _HNUM = (f"regexp_extract(lower(section_id), {_q(p.ID_HALVES)}, {g})" for g in (1, 2))
_MATCH = _refs_sql("sect", "doc_id, place, section_id", "title", "said") + f""",
keys AS (SELECT doc_id, place, true AS by_id, nullif({_HID}, '') AS label, {_HNUM} AS number FROM sect WHERE {_HNUM} <> '' UNION SELECT doc_id, place, false, label, number FROM said WHERE {_HNUM} = ''),
matches AS (SELECT DISTINCT question_id, doc_id, place, r.label, r.number, raw FROM refs r JOIN keys k ON r.number = k.number AND (r.label IS NOT DISTINCT FROM k.label OR (by_id AND (r.label IS NULL OR k.label IS NULL))))"""
_GRADE = f"""titles AS (SELECT doc_id, place, {_sig(_norm('title'))} AS words, array_to_string({_norm('title')}, ' ') AS phrase FROM sect),
asked AS (SELECT question_id, {_norm('question')} AS q FROM v_questions),
tword AS (SELECT doc_id, place, unnest(words) AS word FROM titles),
met AS (SELECT question_id, doc_id, place, count(*) AS matched FROM tword JOIN (SELECT question_id, unnest(list_distinct(q)) AS word FROM asked) a USING (word) GROUP BY question_id, doc_id, place),
grades AS (SELECT question_id, doc_id, place, CASE WHEN contains(concat(' ', array_to_string(q, ' '), ' '), concat(' ', phrase, ' ')) THEN 'exact' WHEN matched = len(words) AND len(words) >= 2 THEN 'strong' WHEN matched >= 2 OR len(words) = 1 THEN 'partial' ELSE 'none' END AS grade
 FROM met JOIN titles USING (doc_id, place) JOIN asked USING (question_id))"""
#: Keyword occurrences of every line, inside words too, by way of the distinct words.
_LINE_HITS = f"""kwq AS (SELECT question_id, keyword, list_position(list_transform(string_split_regex(question, '[^A-Za-z0-9_-]+'), lambda w: lower(w)), keyword) AS nth FROM (SELECT question_id, question, unnest({_KW}) AS keyword FROM v_questions) q),
wl AS (SELECT doc_id, line_no, unnest(string_split_regex(lower(line), '[^a-z0-9_-]+')) AS word FROM v_headed_lines),
mk AS (SELECT word, keyword FROM (SELECT DISTINCT word FROM wl WHERE length(word) >= 4) d JOIN (SELECT DISTINCT keyword FROM kwq) k ON contains(word, keyword)),
qw AS (SELECT question_id, word, len(regexp_extract_all(word, pat)) AS h FROM (SELECT question_id, word, string_agg(keyword, '|' ORDER BY nth) AS pat FROM kwq JOIN mk USING (keyword) GROUP BY question_id, word) x),
lh AS (SELECT question_id, doc_id, line_no, CAST(sum(h) AS BIGINT) AS n FROM wl JOIN qw USING (word) GROUP BY question_id, doc_id, line_no)"""
_SCORE = f"""{_MATCH}, {_GRADE},
ask AS (SELECT question_id, {_KW} AS kw FROM v_questions),
{_LINE_HITS},
kl AS (SELECT question_id, h.doc_id, s.place, h.line_no, h.n FROM lh h JOIN sect s ON s.doc_id = h.doc_id AND h.line_no BETWEEN s.start_line AND s.end_line),
vol AS (SELECT question_id, doc_id, place, CAST(sum(n) AS BIGINT) AS volume, count(*) AS hits FROM kl GROUP BY question_id, doc_id, place),
byref AS (SELECT DISTINCT question_id, doc_id, place FROM matches),
agree AS (SELECT m.*, len(list_intersect(list_filter({_sig("list_distinct(" + _norm('title') + ")")}, lambda w: length(w) > 1), {_norm("replace(lower(question), raw, ' ')")})) AS a FROM matches m JOIN v_questions USING (question_id) JOIN sect USING (doc_id, place)),
g AS (SELECT question_id, doc_id, label, number, list({{'a': -a, 'place': place}} ORDER BY -a, place) AS r, min(place) AS first FROM agree GROUP BY question_id, doc_id, label, number),
c AS (SELECT *, len(r) = 1 OR (r[1].a < 0 AND r[1].a < r[2].a) AS clear FROM g),
chosen AS (SELECT DISTINCT question_id, doc_id, CASE WHEN clear THEN r[1].place ELSE first END AS place FROM c),
pairs AS (SELECT question_id, doc_id, place FROM vol UNION SELECT question_id, doc_id, place FROM byref UNION SELECT question_id, doc_id, place FROM grades),
scores AS (SELECT p.question_id, p.doc_id, p.place, CAST(CASE WHEN r.doc_id IS NOT NULL THEN 4 ELSE CASE grade WHEN 'exact' THEN 3 WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END END AS INT) AS tier,
 CAST(CASE WHEN r.doc_id IS NULL THEN 0 WHEN h.doc_id IS NOT NULL THEN 2 ELSE 1 END AS INT) AS ref_rank, coalesce(volume, 0) AS volume, coalesce(hits, 0) AS hits
 FROM pairs p LEFT JOIN vol USING (question_id, doc_id, place) LEFT JOIN byref r USING (question_id, doc_id, place) LEFT JOIN grades USING (question_id, doc_id, place) LEFT JOIN chosen h USING (question_id, doc_id, place))"""
_RET = duckdb("v_doc_lines", "v_headed_lines", "v_questions") + f", {_HEADS}, {_SECT}, {_REFS}, {_SCORE}"


def _asked(spark, sf_dir):
    return view(spark, sf_dir, "v_questions"), _found(spark, sf_dir)


@add("d16_ref_matches", _RET + " SELECT * FROM matches")
def d16(spark, sf_dir):
    return s.ref_matches(*_asked(spark, sf_dir))


@add("d17_heading_grades", _RET + " SELECT * FROM grades")
def d17(spark, sf_dir):
    return s.heading_grades(*_asked(spark, sf_dir))


@add(
    "d18_ref_resolutions",
    _RET + """ SELECT question_id, doc_id, label, number, CAST(len(r) AS INT) AS candidates, CASE WHEN clear THEN r[1].place ELSE first END AS place, clear AS discriminated FROM c""",
)
def d18(spark, sf_dir):
    return s.ref_resolutions(*_asked(spark, sf_dir)).drop("places")


@add(
    "d26_ambiguities",
    _RET + " SELECT question_id, doc_id, label, number, first AS place, array_to_string(list_filter(list_sort(list_transform(r, lambda x: x.place)), lambda x: x <> first), ',') AS alternatives FROM c WHERE NOT clear",
)
def d26(spark, sf_dir):
    a = s.ambiguities(s.ref_resolutions(*_asked(spark, sf_dir)))
    return a.withColumn("alternatives", F.array_join("alternatives", ","))


@add("d19_section_scores", _RET + " SELECT * FROM scores")
def d19(spark, sf_dir):
    return s.section_scores(*_asked(spark, sf_dir), lines(spark, sf_dir))


_BEST = "ORDER BY tier DESC, ref_rank DESC, volume DESC, place"
_RANKED = "SELECT question_id, doc_id, max(tier) AS tier, count(*) FILTER (WHERE ref_rank = 2) AS chosen, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(volume) AS BIGINT) AS volume FROM scores GROUP BY question_id, doc_id"
_RANKED = f"SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY tier DESC, chosen DESC, hits DESC, volume DESC, doc_id) AS INT) AS rank FROM ({_RANKED}) x WHERE tier > 0 OR hits > 0"


@add("d20_best_sections", _RET + f" SELECT question_id, doc_id, place, tier, ref_rank, volume, hits, CAST(row_number() OVER (PARTITION BY question_id, doc_id ORDER BY place) AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id {_BEST}) AS r FROM scores WHERE tier > 0 OR volume > 0) x WHERE r <= 4")
def d20(spark, sf_dir):
    return s.sections_of_each(*_asked(spark, sf_dir), lines(spark, sf_dir))


@add("d22_ranked_documents", _RET + f" SELECT * FROM ({_RANKED}) y WHERE rank <= 6")
def d22(spark, sf_dir):
    return s.documents_of_each(*_asked(spark, sf_dir), lines(spark, sf_dir))


@add(
    "d29_corpus_fingerprints",
    """WITH f AS (SELECT source AS corpus, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents),
 b AS (SELECT corpus, CAST(concat('0x', substr(sha256(path), 1, 8)) AS BIGINT) % 4096 AS bucket, concat(path, ':', hash) AS line FROM f),
 p AS (SELECT corpus, bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM b GROUP BY corpus, bucket)
 SELECT corpus, sha256(string_agg(concat(lpad(CAST(bucket AS VARCHAR), 4, '0'), ':', digest), chr(10) ORDER BY bucket)) AS fingerprint FROM p GROUP BY corpus""",
)
def d29(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return s.corpus_fingerprint(files)


@add(
    "d30_ingest_status",
    "SELECT coalesce(n.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.path % 5 > 0 THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT doc_id AS path FROM documents WHERE doc_id % 7 > 0) n FULL JOIN (SELECT doc_id AS path FROM documents WHERE doc_id % 6 > 0) p ON p.path = n.path",
)
def d30(spark, sf_dir):
    """Every seventh document is gone, every sixth is new, and every fifth has another text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.lit(7).alias("detector"))
    new = d.where("path % 7 > 0")
    prior = d.where("path % 6 > 0").withColumn("hash", F.when(F.col("path") % 5 == 0, F.lit("other")).otherwise(F.col("hash")))
    return s.ingest_status(new, prior)


_MD = "md AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 1 THEN concat('## ', line) WHEN 2 THEN concat('**', substr(line, 1, 40), '**') ELSE line END AS line FROM v_doc_lines)"
_MARKS = r"'^(#{1,6})\s+(.+?)\s*#*\s*$'"
_BOLD = r"'^\*\*\s*(\S[^*]*?)\s*\*\*[:.]?$'"


@add(
    "d01_markdown_headings",
    duckdb("v_doc_lines")
    + f""", {_MD}, x AS (SELECT doc_id, line_no, regexp_extract(trim(line), {_MARKS}, 1) AS m, regexp_extract(trim(line), {_MARKS}, 2) AS t, trim(regexp_extract(trim(line), {_BOLD}, 1)) AS b FROM md)
 SELECT doc_id, line_no, CAST(CASE WHEN m <> '' THEN length(m) ELSE 2 END AS INT) AS level, CASE WHEN m <> '' THEN t ELSE b END AS heading FROM x WHERE m <> '' OR (b <> '' AND length(b) <= 100)""",
)
def d01(spark, sf_dir):
    """Every fourth line is marked as a heading, the next one is bold."""
    line = F.when(F.col("line_no") % 4 == 1, F.concat(F.lit("## "), "line")).when(
        F.col("line_no") % 4 == 2, F.concat(F.lit("**"), F.substring("line", 1, 40), F.lit("**"))
    )
    return s.markdown_headings(view(spark, sf_dir, "v_doc_lines").withColumn("line", line.otherwise(F.col("line"))))


@add(
    "d31_posture",
    "WITH r AS (SELECT source AS repo, count(*) AS files, sum(strlen(text)) AS size, count(*) FILTER (WHERE doc_id % 50 = 0) AS knowledge FROM documents GROUP BY source) SELECT repo, CASE WHEN files > 120 OR size > 2097152 THEN 'full' WHEN knowledge = 0 AND files <= 25 AND size <= 262144 THEN 'idle' ELSE 'light' END AS posture FROM r",
)
def d31(spark, sf_dir):
    """Each source is a repository; every fiftieth document is a learned entry."""
    from ..functions import dims

    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo"))
    r = d.agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("size"), F.count_if(F.col("doc_id") % 50 == 0).alias("knowledge"))
    return r.select("repo", dims.posture(F.col("files"), F.col("size"), F.col("knowledge")).alias("posture"))


_BAND = """band AS (SELECT *, CASE WHEN evidence = 0 OR (section_refs > 0 AND resolved_refs = 0) THEN 'low' WHEN anchored AND half THEN CASE WHEN ambiguous > 0 THEN 'medium' ELSE 'high' END WHEN NOT anchored AND heading_match = 'none' AND NOT half THEN 'low' ELSE 'medium' END AS b
 FROM (SELECT *, resolved_refs > 0 OR heading_match IN ('exact', 'strong') AS anchored, 2 * terms_matched >= terms_total AS half FROM figures) x)"""


@add(
    "d25_confidence",
    _RET
    + f""", top1 AS (SELECT question_id, doc_id FROM ({_RANKED}) y WHERE rank <= 6), picked AS (SELECT question_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id {_BEST}) AS r FROM scores WHERE tier > 0 OR volume > 0) x JOIN top1 USING (question_id, doc_id) WHERE r <= 1),
 ev AS (SELECT question_id, lower(line) AS text FROM picked JOIN sect USING (doc_id, place) JOIN v_headed_lines l ON l.doc_id = picked.doc_id AND l.line_no = sect.start_line),
 terms AS (SELECT question_id, unnest(kw) AS term FROM ask UNION SELECT question_id, number FROM refs), seen AS (SELECT DISTINCT question_id, term FROM terms JOIN ev USING (question_id) WHERE contains(text, term)),
 figures AS (SELECT question_id, coalesce(evidence, 0) AS evidence, coalesce(section_refs, 0) AS section_refs, coalesce(resolved_refs, 0) AS resolved_refs, coalesce(ambiguous, 0) AS ambiguous, coalesce(terms_total, 0) AS terms_total, coalesce(terms_matched, 0) AS terms_matched, coalesce(heading_match, 'none') AS heading_match
 FROM v_questions LEFT JOIN (SELECT question_id, count(*) AS evidence FROM ev GROUP BY question_id) USING (question_id)
 LEFT JOIN (SELECT question_id, count(*) AS section_refs FROM refs GROUP BY question_id) USING (question_id)
 LEFT JOIN (SELECT question_id, count(DISTINCT concat(label, '|', number)) AS resolved_refs, count(*) FILTER (WHERE NOT clear) AS ambiguous FROM c GROUP BY question_id) USING (question_id)
 LEFT JOIN (SELECT question_id, max_by(grade, CASE grade WHEN 'exact' THEN 3 WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS heading_match FROM grades GROUP BY question_id) USING (question_id)
 LEFT JOIN (SELECT question_id, count(*) AS terms_total, count(s.term) AS terms_matched FROM terms k LEFT JOIN seen s USING (question_id, term) GROUP BY question_id) USING (question_id)), {_BAND}
 SELECT question_id, evidence, section_refs, resolved_refs, ambiguous, terms_total, terms_matched, heading_match, CASE WHEN question_id % 7 > 0 THEN b WHEN b = 'high' THEN 'medium' ELSE 'low' END AS band FROM band""",
)
def d25(spark, sf_dir):
    """The heading of the best section of each of a question's documents is its evidence; the search for every seventh question ended incomplete."""
    asked, found = _asked(spark, sf_dir)
    top = s.best_documents(asked, found, lines(spark, sf_dir))
    own, text = s.of_documents(found, top), s.of_documents(lines(spark, sf_dir), top)
    best = s.best_sections(s.section_scores(asked, own, text).join(top, ["question_id", "doc_id"], "left_semi"), 1)
    at = best.join(own.select("doc_id", "place", F.col("start_line").alias("line_no")), ["doc_id", "place"])
    evidence = at.join(text, ["doc_id", "line_no"]).select("question_id", F.col("line").alias("text"))
    summed = s.ask_summary(asked, found, evidence).withColumn("incomplete", F.col("question_id") % 7 == 0)
    return s.ask_confidence(summed).drop("reasons", "incomplete")


@add(
    "d32_touched_sections",
    "SELECT answer_id, document, section, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY position, document, section) AS INT) AS nth FROM (SELECT l_orderkey AS answer_id, concat('d', l_partkey % 3) AS document, concat('s', l_suppkey % 3, '.', l_linenumber % 2) AS section, min(l_linenumber) AS position FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) x",
)
def d32(spark, sf_dir):
    """Every order is an answer, each line a piece of evidence; some name no section."""
    t = table(spark, sf_dir, "lineitem")
    why = F.when(F.col("l_returnflag") == "R", "no anchor").otherwise(F.concat(F.lit("hit in §s"), F.col("l_suppkey") % 3, F.lit("."), F.col("l_linenumber") % 2, F.lit(" (2 terms)")))
    rows = t.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("d"), F.col("l_partkey") % 3).alias("document"), why.alias("why"))
    return s.touched_sections(rows)


_CITE = "concat('§', section_id, ' ', title, ' (¶', start_line, ')'"
_MAP_HEAD = "concat('document ', doc_id, ': ', count(*), ' sections', chr(10), '[full document elided; a section id or title recovers that section]', chr(10), "
_MAP_TAIL = "CASE WHEN count(*) > 6 THEN concat(chr(10), '[omitted ', count(*) - 6, ' further sections]') ELSE '' END)"


@add(
    "d08_structure_maps",
    _V
    + f""", {_HEADS}, {_SECT}, {_SUMMED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM summed),
 maps AS (SELECT doc_id, count(*) AS sections, {_MAP_HEAD} string_agg({_CITE}, ' — ', summary), chr(10) ORDER BY r) FILTER (WHERE r <= 6), {_MAP_TAIL} AS whole, {_MAP_HEAD} string_agg({_CITE}), chr(10) ORDER BY r) FILTER (WHERE r <= 6), chr(10), '[summaries omitted to fit the budget]', {_MAP_TAIL} AS terse FROM ranked GROUP BY doc_id)
 SELECT doc_id, sections, CASE WHEN strlen(whole) <= 500 THEN whole ELSE terse END AS text FROM maps""",
)
def d08(spark, sf_dir):
    """Maps of at most six sections and, with summaries, 500 bytes, so that both forms occur."""
    return s.structure_map(s.summaries(lines(spark, sf_dir), _found(spark, sf_dir)), 6, 500)
