"""Pages as a relation of HTML nodes: the only step that leaves the JVM.

One Arrow function turns a batch of pages into, per page, its visible text and an array of nodes. Nodes are
numbered in document order over the nodes kept, so the descendants of a node are the array slice that
follows it: ``id + 1 .. last``. Text is held once per page; a node only has its offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = (
    "struct<id:int,last:int,parent:int,tag:string,classes:array<string>,"
    "attrs:map<string,string>,t0:int,t1:int>"
)
PARSED = f"struct<visible_text:string,nodes:array<{NODE}>,parse_error:string>"

# Elements that never hold content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN_TAGS = frozenset(("script", "style", "template", "rt", "rp"))
PRESERVED_TAGS = frozenset(("pre", "textarea"))

# What the section rules look at; other nodes and attributes need not leave the Python worker.
SECTION_TAGS = "title img nav footer a main h1 h2 h3 h4 h5 p div dt dd".split()
SECTION_ATTRS = ("href", "src", "data-src", "alt")

# HTML parsed at once, in bytes (a longer page goes alone): nodes are Python objects until then.
PARSE_BYTES = 1 << 20


class _Outline(HTMLParser):
    """Collects nodes of one page into flat lists shared by the whole batch."""

    def __init__(self, out: "_Batch"):
        super().__init__(convert_charrefs=True)
        self.out = out
        self.first = len(out.tag)
        self.text: list[str] = []
        self.length = 0
        self.pending: list[str] = []
        self.stack: list[tuple[str, int, int]] = []
        self.open: dict[str, int] = {}
        self.hidden = self.preserved = self.serial = 0

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def flush(self):
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if self.hidden:
            return
        if not self.preserved and not data.strip(" \n\t\f\r"):
            data = "\n" if "\n" in data else " "
        self.text.append(data)
        self.length += len(data)

    def enter(self, tag, attrs, closed):
        self.flush()
        serial = self.serial
        self.serial += 1
        row = self.out.add(self, tag, attrs, self.stack[-1][1] if self.stack else -1)
        if closed:
            return
        self.stack.append((tag, serial, row))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += tag in HIDDEN_TAGS
        self.preserved += tag in PRESERVED_TAGS

    def leave(self):
        tag, _, row = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN_TAGS
        self.preserved -= tag in PRESERVED_TAGS
        if row >= 0:
            self.out.last[row] = len(self.out.tag) - 1 - self.first
            self.out.t1[row] = self.length

    def handle_starttag(self, tag, attrs):
        self.enter(tag, attrs, tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self.enter(tag, attrs, True)

    def handle_endtag(self, tag):
        self.flush()
        while self.open.get(tag):
            done = self.stack[-1][0] == tag
            self.leave()
            if done:
                break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self.flush()

    def finish(self) -> str:
        self.close()
        self.flush()
        while self.stack:
            self.leave()
        return "".join(self.text)


class _Batch:
    """Arrow-shaped buffers of one batch."""

    def __init__(self, tags, classes, attrs):
        self.keep_tags, self.keep_classes, self.keep_attrs = tags, classes, attrs
        self.id, self.last, self.parent, self.tag, self.t0, self.t1 = [], [], [], [], [], []
        self.class_at, self.cls, self.attr_at, self.key, self.val = [0], [], [0], [], []

    def add(self, page, tag, attrs, parent) -> int:
        """Append a node and return its row, or -1 when nobody asked for it."""
        attrs = {k: v or "" for k, v in attrs}
        names = attrs.pop("class", "").split()
        keep = self.keep_tags
        if keep is not None and tag not in keep and not any(n in self.keep_classes for n in names):
            return -1
        row, wanted = len(self.tag), self.keep_attrs
        self.id.append(row - page.first)
        self.last.append(row - page.first)
        self.parent.append(parent)
        self.tag.append(tag)
        self.t0.append(page.length)
        self.t1.append(page.length)
        self.cls += names
        self.class_at.append(len(self.cls))
        for k, v in attrs.items():
            if wanted is None or k in wanted:
                self.key.append(k)
                self.val.append(v)
        self.attr_at.append(len(self.key))
        return row

    def rewind(self, first):
        """Forget the nodes of a page that could not be parsed."""
        for column in (self.id, self.last, self.parent, self.tag, self.t0, self.t1):
            del column[first:]
        del self.class_at[first + 1 :], self.attr_at[first + 1 :]
        del self.cls[self.class_at[-1] :], self.key[self.attr_at[-1] :], self.val[self.attr_at[-1] :]

    def arrow(self) -> pa.Array:
        i32, text = pa.int32(), pa.string()
        return pa.StructArray.from_arrays(
            [
                pa.array(self.id, i32),
                pa.array(self.last, i32),
                pa.array(self.parent, i32),
                pa.array(self.tag, text),
                pa.ListArray.from_arrays(pa.array(self.class_at, i32), pa.array(self.cls, text)),
                pa.MapArray.from_arrays(
                    pa.array(self.attr_at, i32), pa.array(self.key, text), pa.array(self.val, text)
                ),
                pa.array(self.t0, i32),
                pa.array(self.t1, i32),
            ],
            names=["id", "last", "parent", "tag", "classes", "attrs", "t0", "t1"],
        )


def page_slices(pages: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """A batch in parts of about ``size`` bytes, in order, so that memory does not follow the size of a batch."""
    size = size or PARSE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(pages):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield pages.slice(first, last - first)
        first = last


def outlines(pages: pa.Array, tags, classes, attrs) -> pa.Array:
    """Visible text, nodes and parse error of every page of an array."""
    batch = _Batch(tags, classes, attrs)
    texts, errors, ends = [], [], [0]
    for page in pages.to_pylist():
        text = error = None
        if page is not None:
            parser = _Outline(batch)
            try:
                parser.feed(page)
                text = parser.finish()
            except Exception as exc:  # one bad page must not fail its task
                batch.rewind(parser.first)
                error = f"{type(exc).__name__}: {exc}"
        texts.append(text)
        errors.append(error)
        ends.append(len(batch.tag))
    return pa.StructArray.from_arrays(
        [
            pa.array(texts, pa.string()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.arrow()),
            pa.array(errors, pa.string()),
        ],
        names=["visible_text", "nodes", "parse_error"],
    )


def parse_html(
    html: Column,
    tags: Sequence[str] | None = None,
    classes: Sequence[str] = (),
    attrs: Sequence[str] | None = None,
) -> Column:
    """Struct ``(visible_text, nodes, parse_error)`` of an HTML column; NULL html gives NULL fields.

    ``tags``/``classes`` name the nodes to return (all when ``tags`` is None) and ``attrs`` the attributes, so
    that a plan ships only what its selectors read. ``parent`` counts all elements and only serves to tell
    siblings. Unclosed elements stay open until an ancestor closes; an unmatched end tag is ignored. A page the
    parser rejects gets a ``parse_error`` instead of failing the job.
    """
    keep_tags = None if tags is None else frozenset(tags)
    keep_classes, keep_attrs = frozenset(classes), None if attrs is None else frozenset(attrs)

    @F.arrow_udf(PARSED)
    def outline(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for part in page_slices(pages):
                yield outlines(part, keep_tags, keep_classes, keep_attrs)

    # Non-deterministic keeps the optimiser from copying the call into filters or several projections.
    return outline.asNondeterministic()(html)


def with_dom(pages: DataFrame, html: str = "html", keep_html: bool = False, **wanted) -> DataFrame:
    """Add ``visible_text``, ``nodes`` and ``parse_error`` to a page table and drop the raw HTML."""
    rest = [c for c in pages.columns if keep_html or c != html]
    parsed = pages.select(*rest, parse_html(F.col(html), **wanted).alias("dom"))
    return parsed.select(*rest, "dom.visible_text", "dom.nodes", "dom.parse_error")


def to_nodes(parsed: DataFrame, *keys: str) -> DataFrame:
    """Node table: one row per node with the given page columns in front."""
    return parsed.select(*keys, F.inline_outer("nodes")).where("id is not null")
