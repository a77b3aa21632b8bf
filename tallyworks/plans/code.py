"""Queries of the source-file index, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as p
from ..operators import code as c
from .registry import Registry
from .views import duckdb, spread, table, view

R = Registry()
add = R.add

#: Source files of which each order is one.
_CODE = """SELECT concat(CASE artifact_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'pkg/tests/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'lib/scripts/' WHEN 4 THEN 'lib/' ELSE '' END, 'f', artifact_id, '.ts') AS path, line_no,
 CASE (artifact_id + line_no) % 6 WHEN 0 THEN concat('import a from "./x', artifact_id % 9, '"') WHEN 1 THEN concat('export async function fn', artifact_id % 50, '_', line_no, '(): void') WHEN 2 THEN concat('class C', line_no, ':')
 WHEN 3 THEN concat('from .m', line_no, ' import a') WHEN 4 THEN concat('  export const k', line_no, ' = 1;') ELSE concat('import os', line) END AS line FROM v_log_lines"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_get = lambda pattern, g: f"regexp_extract(line, {_q(pattern)}, {g})"
_DECL = (
    duckdb("v_log_lines")
    + f""", code AS ({_CODE}), named AS (SELECT path, line_no, CASE WHEN {_get(p.DECLARATION, 2)} <> '' THEN {_get(p.DECLARATION, 2)} ELSE {_get(p.PLAIN_DECLARATION, 2)} END AS name, trim(line) AS signature FROM code),
decl AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) AS INT) AS nth, name, signature FROM named WHERE name <> '' AND length(signature) < 160)"""
)


def lines(spark, sf_dir):
    return spark.sql(_CODE.replace("v_log_lines", "{v}"), v=view(spark, sf_dir, "v_log_lines"))


@add("d27_interfaces", _DECL + " SELECT * FROM decl WHERE nth <= 4")
def d27(spark, sf_dir):
    return c.interfaces(lines(spark, sf_dir))


@add("d27_imports", _DECL + f", i AS (SELECT path, line_no, CASE WHEN {_get(p.RELATIVE_IMPORT, 1)} <> '' THEN {_get(p.RELATIVE_IMPORT, 1)} ELSE {_get(p.RELATIVE_FROM, 1)} END AS target FROM code) SELECT * FROM i WHERE target <> ''")
def d27i(spark, sf_dir):
    return c.relative_imports(lines(spark, sf_dir))


_FOLDER = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(string_split(folder, '/')[-1], {_q(pattern)}) THEN '{said}'" for pattern, said in p.FOLDER_ROLES) + " ELSE 'unclassified' END"


@add(
    "d28_folder_map",
    _DECL
    + f""", once AS (SELECT {_FOLDER} AS folder, name, min({{'path': path, 'nth': nth}}) AS spot FROM decl WHERE nth <= 3 GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY spot) AS r FROM once)
 SELECT folder, {_ROLE} AS role, coalesce(symbols, '') AS symbols FROM (SELECT DISTINCT {_FOLDER} AS folder FROM code) f LEFT JOIN (SELECT folder, string_agg(name, ',' ORDER BY r) AS symbols FROM top WHERE r <= 8 GROUP BY folder) USING (folder)""",
)
def d28(spark, sf_dir):
    t = lines(spark, sf_dir)
    return c.folder_map(t.select("path"), t).select(F.col("folder"), "role", "symbols")


@add(
    "d27_extents",
    duckdb("v_log_lines")
    + f""", code AS ({_CODE}), txt AS (SELECT path, line_no, line, trim(line, ' ' || chr(9)) AS t, length(regexp_extract(line, '^[ \\t]*', 0)) AS depth FROM code WHERE trim(line, ' ' || chr(9)) <> ''),
 named AS (SELECT *, CASE WHEN {_get(p.DECLARATION, 2)} <> '' THEN {_get(p.DECLARATION, 2)} ELSE regexp_extract(t, {_q(p.PLAIN_DECLARATION)}, 2) END AS name FROM txt),
 nxt AS (SELECT a.path, a.name, a.line_no, a.depth, min(b.line_no) AS n FROM named a LEFT JOIN txt b ON b.path = a.path AND b.line_no > a.line_no AND b.depth <= a.depth WHERE a.name <> '' GROUP BY ALL)
 SELECT nxt.path, name, nxt.line_no AS start_line, CAST(CASE WHEN n IS NULL THEN (SELECT max(line_no) FROM txt z WHERE z.path = nxt.path) WHEN regexp_matches(t.t, {_q(c.CLOSERS)}) AND t.depth = nxt.depth THEN n ELSE n - 1 END AS INT) AS end_line
 FROM nxt LEFT JOIN txt t ON t.path = nxt.path AND t.line_no = n""",
)
def d27_extents(spark, sf_dir):
    return c.extents(spread(lines(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "path"))
