"""Landmarks of pages worked out by hand."""

from __future__ import annotations

from tallyworks.operators import landmarks as lm
from tallyworks.operators import pages as pg

PAGE = """<!DOCTYPE html>
<html><head><title>A
 <b>page</b></title><meta charset=x>
<script src="a.js"></script><style>
h1 { } /* <div id="no"> */ </style></head>
<body id=top><header
   class="wide > narrow" aria-label="Banner"><h1 id="t">One <i>two</i></h1></header>
<!-- <nav id="none"> -->
<div id="app"><p>text<div id="deep"><span id="deeper"><b id="too">x</b></span></div>
<ul><li id="i1">a<li id="i2">b</ul></div>
<script type="application/ld+json">{"a": "</div>"}</script>
<img id="pic"/><br><h2>Open
<p>end</body></html>
"""


def test_depths_tags_over_lines_and_unclosed_elements():
    got = [(line, depth, kind, tag, name, title) for line, depth, kind, _, tag, name, title in lm.found_in(PAGE)]
    assert got == [
        (2, 1, "sectioning", "head", None, "<head>"),
        (2, 2, "heading", "title", None, "A page"),
        (4, 2, "script", "script", None, '<script src="a.js">'),
        (4, 2, "style", "style", None, "<style>"),
        (6, 1, "sectioning", "body", "top", '<body id="top">'),
        (6, 2, "sectioning", "header", None, "<header> Banner"),
        (7, 3, "heading", "h1", "t", "One two"),
        (9, 2, "identified", "div", "app", '<div id="app">'),
        (9, 3, "identified", "div", "deep", '<div id="deep">'),
        (11, 2, "script", "script", None, '<script type="application/ld+json">'),
        (12, 2, "identified", "img", "pic", '<img id="pic">'),
        (12, 2, "heading", "h2", None, "Open end"),
    ]


def test_pages_of_a_table(spark, sf):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p id=a>x" * 3 + "<h1>never closed")], "page_id long, html string")
    marks = lm.element_landmarks(df)
    assert {r.page_id: r.n for r in marks.groupBy("page_id").count().withColumnRenamed("count", "n").collect()} == {1: 12, 4: 4}
    best = {(r.page_id, r.line_no): (r.kind, r.element_id) for r in lm.best_per_line(marks).collect()}
    assert best[1, 2] == ("heading", None) and best[1, 6] == ("sectioning", "top") and best[1, 7] == ("heading", "t") and best[1, 12] == ("heading", "pic")
    assert best[4, 1] == ("heading", "a")
    # on pages whose tags each stand on one line, the landmark tags are those that the line scan finds
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    mine = {(r.page_id, r.line_no) for r in lm.element_landmarks(pages).where("kind <> 'identified'").collect()}
    theirs = {(r.page_id, r.line_no) for r in pg.landmarks(pg.page_lines(pages)).collect()}
    assert len(theirs & mine) >= 0.95 * len(theirs)
