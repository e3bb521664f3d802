"""HTML: elements by tag in a fixed order of tags, tables with their cells, formulas.

Browsers' error recovery can't be said in SQL, so a small tree builder on the standard parser runs
over Arrow batches; everything after it is DataFrame work. No shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags in the order in which their elements come.
ORDER = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "code", "ul", "ol", "li")
TYPES = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "blockquote": "blockquote", "pre": "code", "code": "code", "ul": "list", "ol": "list", "li": "list_item"}
#: Tags whose start ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def _every(self):
        """Nodes and strings below, in order; by a stack of its own, as pages may nest without end."""
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            yield c
            if not isinstance(c, str):
                todo.extend(reversed(c.children))

    def text(self) -> str:
        return "".join(c for c in self._every() if isinstance(c, str))

    def walk(self):
        return (c for c in self._every() if not isinstance(c, str))


class Tree(HTMLParser):
    """Builds the tree; ``<p>``, ``<li>``, cells and rows end where they are implied to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS:
            self._close(ENDS[tag], {"ul", "ol", "table"} if tag in ("li", "tr", "td", "th", "tbody") else {"dl"})
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _span(node: Node, name: str) -> int:
    value = (node.attrs.get(name) or "1").strip()
    return int(value) if re.fullmatch("[0-9]{1,6}", value) else 1


def table_cells(table: Node) -> list[dict]:
    """Cells row by row; spans are noted and don't shift the columns."""
    cells = []
    rows = [n for n in table.walk() if n.tag == "tr"]
    for r, row in enumerate(rows):
        for c, cell in enumerate(n for n in row.walk() if n.tag in ("th", "td")):
            cells.append({"row": r, "column": c, "rowspan": _span(cell, "rowspan"), "colspan": _span(cell, "colspan"), "text": " ".join(cell.text().split()), "is_header": cell.tag == "th"})
    return cells


def page_elements(html: str | None) -> list[dict]:
    root = parse(html)
    nodes = list(root.walk())
    out = []
    for tag in ORDER:
        for n in nodes:
            if n.tag == tag:
                text = n.text().strip() if tag in ("pre", "code") else " ".join(n.text().split())
                if text:
                    mark = {"p": text, "blockquote": f"> {text}", "li": f"- {text}"}.get(tag)
                    mark = mark or (f"{'#' * int(tag[1])} {text}" if tag[0] == "h" and tag[1:].isdigit() else f"```\n{text}\n```" if tag in ("pre", "code") else text)
                    out.append({"type": TYPES[tag], "tag": tag, "text": text, "markdown": mark, "cells": [], "warning": None})
    for n in nodes:
        if n.tag == "table":
            cells = table_cells(n)
            if cells:
                merged = any(c["rowspan"] > 1 or c["colspan"] > 1 for c in cells)
                text = " | ".join(c["text"] for c in cells)
                out.append({"type": "table", "tag": "table", "text": text, "markdown": text, "cells": cells, "warning": "COMPLEX_TABLE_MARKDOWN_APPROXIMATION" if merged else None})
    for n in nodes:
        if n.tag == "math" and n.text().strip():
            text = " ".join(n.text().split())
            out.append({"type": "formula", "tag": "math", "text": text, "markdown": f"$$\n{text}\n$$", "cells": [], "warning": None})
    return out


#: Characters of pages whose elements are held at once.
AT_ONCE = 1 << 20
CELL = "struct<row:int,column:int,rowspan:int,colspan:int,text:string,is_header:boolean>"


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, order (from 1), type, tag, text, markdown, cells, warning."""
    kind = pages.schema[key].dataType.simpleString()
    cell = pa.struct([("row", pa.int32()), ("column", pa.int32()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("text", pa.string()), ("is_header", pa.bool_())])

    fields = {"order": pa.int32(), "type": pa.string(), "tag": pa.string(), "text": pa.string(), "markdown": pa.string(), "cells": pa.list_(cell), "warning": pa.string()}

    def run(batches):
        for b in batches:
            keys, rows, taken = [], [], 0
            for i in range(b.num_rows):
                h = b.column("_html")[i].as_py()
                try:
                    found = page_elements(h)
                except Exception as e:  # one broken page must not end the job
                    found = [{"type": "error", "tag": None, "text": None, "markdown": None, "cells": [], "warning": f"HTML_READ_FAILED: {type(e).__name__}: {e}"}]
                keys += [b.column("_key")[i].as_py()] * len(found)
                rows += [{"order": n, **e} for n, e in enumerate(found, 1)]
                taken += len(h or "") + 1
                # elements leave after some pages' worth, so that memory grows with neither the batch nor the table
                if taken >= AT_ONCE or i == b.num_rows - 1:
                    cols = [pa.array(keys, b.schema.field("_key").type), *(pa.array([r[f] for r in rows], t) for f, t in fields.items())]
                    yield pa.RecordBatch.from_arrays(cols, names=[key, *fields])
                    keys, rows, taken = [], [], 0

    source = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    return source.mapInArrow(run, f"{key} {kind}, order int, type string, tag string, text string, markdown string, cells array<{CELL}>, warning string")


def cells(element_rows: DataFrame, key: str = "page_id") -> DataFrame:
    return element_rows.where("type = 'table'").select(key, "order", F.inline("cells"))
