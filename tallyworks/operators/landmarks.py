"""Landmarks of web pages by element depth: headings, sectioning elements, scripts, styles, and elements with an id near the top.

A page is read as one string of tag tokens by an automaton with a stack of open
elements, so tags may span lines and elements stay open. Pages are independent
of each other; a task works through its Arrow batches page by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: An element with an id is a landmark down to this depth.
DEEPEST_ID = 3
#: Elements without an end, elements that open a section, what an opening tag closes, ranks of kinds.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
SECTIONING = "head body header nav main section article aside footer form table dialog figure template".split()
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSED_BY = {"p": BLOCKS, "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"]}
RANK = {"heading": 4, "script": 3, "style": 3, "sectioning": 2, "identified": 1}

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SCHEMA = "line_no int, depth int, kind string, level int, tag string, element_id string, title string"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return out


def _visible(markup: str) -> str:
    return " ".join(re.sub("<[^>]*>", " ", markup).split())


def found_in(page: str) -> list[tuple]:
    """Landmarks (line_no, depth, kind, level, tag, element_id, title) of one page in order."""
    out: list[tuple] = []
    stack: list[str] = []
    headings: list[tuple[int, int, int]] = []  # (place in out, place in the stack, where its content begins)
    line, counted, at = 1, 0, 0

    def closed(depth: int, end: int) -> None:
        while headings and headings[-1][1] >= depth:
            k, _, begin = headings.pop()
            out[k] = (*out[k][:-1], _visible(page[begin:end]))

    while m := _TAG.search(page, at):
        at = m.end()
        line += page.count("\n", counted, m.start())
        counted = m.start()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in stack:
                depth = len(stack) - 1 - stack[::-1].index(tag)
                closed(depth, m.start())
                del stack[depth:]
            continue
        while stack and tag in CLOSED_BY.get(stack[-1], ()):
            closed(len(stack) - 1, m.start())
            stack.pop()
        has = _attributes(m[3])
        name, label = has.get("id") or None, has.get("aria-label")
        depth = len(stack)
        if tag in ("script", "style"):
            src, kind = has.get("src"), has.get("type")
            title = "<style>" if tag == "style" else f'<script src="{src}">' if src else f'<script type="{kind}">' if kind else "<script>"
            out.append((line, depth, tag, 2, tag, None, title))
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        opened = f'<{tag} id="{name}">' if name else f"<{tag}>"
        title = f"{opened} {label}" if label else opened
        empty = tag in VOID or m[3].rstrip().endswith("/")
        if tag == "title" or re.match("h[1-6]$", tag):
            out.append((line, depth, "heading", 1 if tag == "title" else int(tag[1]), tag, None if tag == "title" else name, ""))
            if not empty:
                headings.append((len(out) - 1, depth, at))
        elif tag in SECTIONING:
            out.append((line, depth, "sectioning", 2, tag, name, title))
        elif name and depth <= DEEPEST_ID:
            out.append((line, depth, "identified", 2, tag, name, title))
        if not empty:
            stack.append(tag)
    closed(0, len(page))
    return out


def element_landmarks(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, depth, kind, level, tag, element_id, title): every landmark of ``pages`` (page_id, html).

    A null page has none. Of an unclosed heading the title runs to the end of what encloses it.
    """
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = found_in(batch.column("html")[k].as_py() or "")
                if rows:
                    own = batch.column("page_id").take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["page_id", *names])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {SCHEMA}")


def best_per_line(marks: DataFrame) -> DataFrame:
    """One landmark a line: the best kind, the first of equals; an id of another one on the line goes to one that has none."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in RANK.items()])
    # landmarks of a line are told apart by depth and tag, which follow document order within a line but for siblings
    order = Window.partitionBy("page_id", "line_no").orderBy(F.desc(rank), "depth", "tag", "title")
    known = F.first("element_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = marks.withColumns({"r": F.row_number().over(order), "known": known}).where("r = 1")
    return best.withColumn("element_id", F.coalesce("element_id", "known")).drop("r", "known")
