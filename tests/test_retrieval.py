"""Zooms against hand-written documents and a plain re-reading of the rules."""

from __future__ import annotations

import pytest
from tallyworks.operators import retrieval as r

TEXTS = {
    1: "1. Costs\nalpha fee\nbeta\ngamma\ndelta\n2. Terms\nthe fee is due\nnothing\nmore\nlast\nfinal",
    2: "1. Other Matters\nzeta clause\nend",
    3: "",
}
SECTIONS = [(1, 1, "1", "Costs", 1, 1, 5), (1, 2, "2", "Terms", 1, 6, 11), (2, 1, "1", "Other Matters", 1, 1, 3)]
PAGES = [(1, 1, 1, 4), (1, 2, 5, 11)]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(d, i + 1, line) for d, t in TEXTS.items() for i, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    found = spark.createDataFrame(SECTIONS, "doc_id long, place int, section_id string, title string, level int, start_line int, end_line int")
    pages = spark.createDataFrame(PAGES, "doc_id long, page int, start_line int, end_line int")
    return lines, found, pages


def span(doc, a, b):
    return "\n".join(TEXTS[doc].split("\n")[a - 1 : b])


SLICES = [
    (1, 1, "page 2", "page", span(1, 5, 11)),
    (2, 1, "P. 1", "page", span(1, 1, 4)),
    (3, 1, "page 9", None, None),
    (4, 1, "§ 2", "section", span(1, 6, 11)),
    (5, 1, "terms", "title", span(1, 6, 11)),
    (6, 1, "section 1 and section 2", "reference", span(1, 1, 5) + "\n\n" + span(1, 6, 11)),
    (7, 1, "section 2 due", "reference", span(1, 6, 9)),
    (8, 1, "section 2 absent", "reference", span(1, 6, 11)),
    (9, 1, "beta", None, None),
    (10, 3, "§1", None, None),
    (11, 1, "", None, None),
    (12, 1, None, None, None),
]


def test_slices(spark, parts):
    lines, found, pages = parts
    zooms = spark.createDataFrame([x[:3] for x in SLICES], "zoom_id long, doc_id long, query string")
    got = {x.zoom_id: (x.kind, x.text) for x in r.zoom_slices(zooms, found, pages, lines).collect()}
    # "and" is what two references leave; no line of theirs holds it, so the whole sections serve
    assert got == {z: (kind, text) for z, _, _, kind, text in SLICES if kind}


LADDER = [
    (1, 1, "§2", 1, 1, True, span(1, 6, 11)),
    (2, 1, "other matters", 2, 2, True, TEXTS[2]),
    (3, 1, "show Fee now", 3, 1, True, span(1, 2, 3)),
    (4, 1, "gamma", 4, 1, True, span(1, 2, 6)),
    (5, 1, "gamma never", 4, 1, True, span(1, 2, 6)),
    (6, 1, "zeta", 5, 2, True, TEXTS[2]),
    (7, 1, "qqq", 6, 1, False, TEXTS[1]),
    (8, 3, "qqq", 6, 3, False, ""),
    (9, 1, None, 6, 1, False, TEXTS[1]),
]


def test_ladder(spark, parts):
    lines, found, pages = parts
    zooms = spark.createDataFrame([x[:3] for x in LADDER], "zoom_id long, doc_id long, query string")
    sources = spark.createDataFrame([(1, 1, 2)], "doc_id long, nth int, source_id long")
    symbols = spark.createDataFrame([(1, "Fee", 2, 3)], "doc_id long, symbol string, start_line int, end_line int")
    got = {x.zoom_id: (x.step, x.doc_id, x.matched, x.text) for x in r.zoom_ladder(zooms, sources, found, pages, lines, symbols).collect()}
    assert got == {x[0]: tuple(x[3:]) for x in LADDER}


def test_windows_are_cut_with_a_note(spark):
    rows = spark.createDataFrame([(1, i, "hit", "hit") for i in range(205)], "zoom_id long, pos int, line string, phrase string")
    text = r._windows(rows, ["zoom_id"]).first().text
    assert text.split("\n")[:200] == ["hit"] * 200 and text.endswith("\n[omitted 5 more matching lines]")


def test_handles(spark):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ref = lambda path, text: f"F{h(path)[:4]}@{h(text)[:16]}"
    artifacts = spark.createDataFrame([("a", "x1", "p", "one", 1), ("a", "x2", "p", "one", 2), ("b", "y1", "p", "two", 1)], "corpus string, artifact_id string, path string, raw string, seq long")
    served = spark.createDataFrame([("a", "p", "one"), ("a", "p", "three"), ("b", "p", "three"), ("a", "q", "")], "corpus string, path string, content string")
    asked = [("x1", None), (ref("p", "one"), None), (ref("p", "two"), "b"), (ref("p", "three"), None), (ref("p", "three"), "b"), (ref("q", ""), None), ("zz", None)]
    handles = spark.createDataFrame(asked, "handle string, asked string")
    got = {(x.handle, x.asked): (x.status, x.corpus, x.kind, x.artifact_id) for x in r.resolved_handles(handles, artifacts, served).collect()}
    assert [got[k] for k in asked] == [
        ("resolved", "a", "artifact", "x1"),
        ("resolved", "a", "file", "x2"),
        ("resolved", "b", "file", "y1"),
        ("ambiguous", None, None, None),
        ("resolved", "b", "served", None),
        ("missing", None, None, None),
        ("missing", None, None, None),
    ]


def test_zoom_serves_bodies_that_the_library_finds(spark):
    """Extents by indentation and closing braces, nested ones too; the ladder's third step serves them."""
    from tallyworks.operators import code

    text = ["import x", "", "export class Box {", "  size = 1", "", "  export function grow() {", "    return 2", "  }", "}", "export const one = 1", "def last():", "    go()", "    stop()", ""]
    lines = spark.createDataFrame([(7, i + 1, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    got = {x.symbol: (x.start_line, x.end_line) for x in code.symbol_table(lines).collect()}
    assert got == {"Box": (3, 9), "grow": (6, 8), "one": (10, 10), "last": (11, 13)}
    zooms = spark.createDataFrame([(1, 7, "grow"), (2, 7, "last")], "zoom_id long, doc_id long, query string")
    none = spark.createDataFrame([], "doc_id long, nth int, source_id long")
    found = spark.createDataFrame([], "doc_id long, place int, section_id string, title string, start_line int, end_line int")
    pages = spark.createDataFrame([], "doc_id long, page int, start_line int, end_line int")
    served = {x.zoom_id: (x.step, x.text) for x in r.zoom_ladder(zooms, none, found, pages, lines, code.symbol_table(lines)).collect()}
    assert served == {1: (3, "\n".join(text[5:8])), 2: (3, "\n".join(text[10:13]))}
