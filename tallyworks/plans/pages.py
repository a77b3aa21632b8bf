"""Queries of web pages and line search, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as g
from ..operators import sections as s
from .registry import Registry
from .sections import _HEADS, _LINE_HITS, _SECT, _V, _found, _q, lines
from .views import duckdb, table, view

R = Registry()
add = R.add
_P = "WITH v_pages AS (SELECT page_id, url, replace(html, '><', concat('>', chr(10), '<')) AS html FROM pages), pl AS (SELECT page_id, CAST(i AS INT) AS line_no, parts[i] AS line FROM (SELECT page_id, string_split(html, chr(10)) AS parts, unnest(generate_series(1, len(string_split(html, chr(10))))) AS i FROM v_pages) x)"
_RANK = "CASE lower(t) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in g.RANKS.items()) + " END"
_MARKS = f"""tags AS (SELECT page_id, line_no, lower(t) AS tag, CAST({_RANK} AS INT) AS rank FROM (SELECT page_id, line_no, unnest(regexp_extract_all(line, {_q(g.TAG)}, 1)) AS t FROM pl) x),
marks AS (SELECT page_id, line_no, tag, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY rank, tag) AS r FROM tags) x WHERE r = 1)"""


def page_lines(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("><"), F.lit(">\n<")))
    return g.page_lines(p)


@add("d11_landmarks", f"{_P}, {_MARKS} SELECT * FROM marks")
def d11(spark, sf_dir):
    return g.landmarks(page_lines(spark, sf_dir))


@add(
    "d11_page_sections",
    f"""{_P}, {_MARKS}, last AS (SELECT page_id, max(line_no) AS last FROM pl GROUP BY page_id),
 m2 AS (SELECT page_id, line_no, tag FROM marks UNION ALL SELECT page_id, 1, 'start' FROM last WHERE page_id NOT IN (SELECT page_id FROM marks WHERE line_no = 1))
 SELECT m2.page_id, tag, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY m2.page_id ORDER BY line_no) - 1, last) AS end_line FROM m2 JOIN last ON last.page_id = m2.page_id""",
)
def d11b(spark, sf_dir):
    pl = page_lines(spark, sf_dir)
    return g.page_sections(pl, g.landmarks(pl))


@add("d13_visible_text", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 160) AS text, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)))), ',') AS outline FROM pages")
def d13(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", g.visible_text(F.col("html")).alias("text"), F.array_join(F.array_sort(g.outline(F.col("html"))), ",").alias("outline"))


_HITS = f"{_LINE_HITS}, hits AS (SELECT question_id, doc_id, line_no, n AS words FROM lh)"
_VQ = duckdb("v_doc_lines", "v_headed_lines", "v_questions")


def _asked(spark, sf_dir):
    return s.asked_keywords(view(spark, sf_dir, "v_questions"))


@add("d21_line_search", _VQ + f", {_HEADS}, {_SECT}, {_HITS} SELECT h.*, s.place FROM hits h LEFT JOIN sect s ON s.doc_id = h.doc_id AND h.line_no BETWEEN s.start_line AND s.end_line")
def d21(spark, sf_dir):
    return g.line_search(_asked(spark, sf_dir), lines(spark, sf_dir), _found(spark, sf_dir))


@add(
    "d10_search_summary",
    _VQ + f", {_HITS} SELECT question_id, count(*) AS hits, count(DISTINCT doc_id) AS documents, string_agg(concat(doc_id, ':', line_no), ',' ORDER BY r) FILTER (WHERE r <= 24) AS first FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_id, line_no) AS r FROM hits) x GROUP BY question_id",
)
def d10(spark, sf_dir):
    return g.search_summary(_asked(spark, sf_dir), lines(spark, sf_dir))


@add("d23_grep", _V + " SELECT doc_id, line_no, line, CAST(hit AS INT) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit FROM v_headed_lines WHERE regexp_matches(line, 'Part [0-9]+$')) x WHERE hit <= 5")
def d23(spark, sf_dir):
    return g.grep(lines(spark, sf_dir), "Part [0-9]+$", "doc_id", 5)


@add(
    "d23_scoped_grep",
    _V
    + " SELECT doc_id, line_no, line, CAST(hit AS INT) AS hit FROM (SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit FROM v_headed_lines l JOIN documents d USING (doc_id) WHERE strlen(text) < 3000 AND d.source = (SELECT min(source) FROM documents) AND regexp_matches(line, 'Part [0-9]+$')) x WHERE hit <= 500",
)
def d23_scoped(spark, sf_dir):
    """Sources are folders; the search goes to the first by name and to files under 3,000 bytes."""
    d = table(spark, sf_dir, "documents")
    folder = d.agg(F.min("source")).first()[0] or ""
    files = d.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length("text").alias("size"))
    return g.grep(lines(spark, sf_dir).join(g.in_scope(files, folder, 3000), "doc_id", "left_semi"), "Part [0-9]+$", "doc_id")


def _blocks(tag: str) -> str:
    all_ = lambda g: f"regexp_extract_all(html, {_q(g_block(tag))}, {g})"
    return f"SELECT page_id, '{tag}' AS tag, unnest(generate_series(1, len({all_(1)}))) AS nth, unnest({all_(1)}) AS head, unnest({all_(2)}) AS body FROM pages"


def g_block(tag: str) -> str:
    return g.BLOCK.format(tag)


_CSS_TEXTS = f"list_transform(regexp_extract_all(regexp_replace(body, {_q(g.COMMENT)}, ' ', 'g'), '([^{{}}]*)[{{}}]', 1), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g')))"
_CSS_BRACES = f"regexp_extract_all(regexp_replace(body, {_q(g.COMMENT)}, ' ', 'g'), '[{{}}]', 0)"


@add(
    "d12_inline_blocks",
    f"""WITH b AS ({_blocks("script")} UNION ALL {_blocks("style")}), tok AS (SELECT page_id, tag, nth, unnest(generate_series(1, len({_CSS_BRACES}))) AS i, unnest({_CSS_TEXTS}) AS t, unnest({_CSS_BRACES}) AS brace FROM b WHERE tag = 'style'),
 deep AS (SELECT *, coalesce(sum(CASE brace WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag, nth ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM tok WHERE true),
 css AS (SELECT page_id, tag, nth, count(*) FILTER (WHERE brace = '{{' AND t <> '' AND NOT starts_with(t, '@')) AS rules, coalesce(string_agg(t, ',' ORDER BY i) FILTER (WHERE brace = '{{' AND depth = 0 AND t <> ''), '') AS names FROM deep GROUP BY page_id, tag, nth)
 SELECT page_id, tag, CAST(nth AS INT) AS nth, CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS INT) AS lines, nullif(regexp_extract(head, {_q(g.SOURCE)}, 1), '') AS src, lower(regexp_extract(head, {_q(g.KIND)}, 1)) AS type,
 CAST(CASE WHEN tag = 'style' THEN coalesce(css.rules, 0) END AS INT) AS rules, CASE WHEN tag = 'style' THEN coalesce(css.names, '') ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(body, {_q(g.DECLARED)}, 1))), ',') END AS names FROM b LEFT JOIN css USING (page_id, tag, nth)""",
)
def d12(spark, sf_dir):
    b = g.inline_blocks(table(spark, sf_dir, "pages"))
    names = F.when(F.col("tag") == "script", F.array_sort("names")).otherwise(F.col("names"))
    return b.withColumn("names", F.array_join(names, ","))


@add("d11_element_landmarks")
def d11_elements(spark, sf_dir):
    """One landmark a line of every page, by element depth; no twin, tests hold it against pages read by hand."""
    from ..operators import landmarks

    return landmarks.best_per_line(landmarks.element_landmarks(table(spark, sf_dir, "pages")))
