"""HTML pages as arrays of numbered nodes, and column helpers to search them.

The only Python here turns a page into its nodes in document order. Each node
knows the number of its last descendant, so "inside of" is a range test and
every selection is an expression over arrays that Spark evaluates.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listsieve.functions.text import once

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),  # position in the array, from 1
        T.StructField("last", T.IntegerType()),  # id of the last node inside
        T.StructField("up", T.IntegerType()),  # id of the parent, 0 at the top
        T.StructField("tag", T.StringType()),  # '' for text
        T.StructField("css", T.ArrayType(T.StringType())),  # classes
        T.StructField("href", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("leaf", T.BooleanType()),  # no elements inside
    ]
)
_ARROW = pa.list_(
    pa.struct(
        [("id", pa.int32()), ("last", pa.int32()), ("up", pa.int32())]
        + [("tag", pa.string()), ("css", pa.list_(pa.string()))]
        + [(name, pa.string()) for name in ("href", "title", "text")]
        + [("leaf", pa.bool_())]
    )
)

# ---- Fixed values: elements without content, and those that end one another ----
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {
    "p": set(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
        "main nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
}
#: Bytes of pages whose nodes lie in a worker at a time.
SLICE_BYTES = 1_000_000
# --------------------------------------------------------------------------------


class _Nodes(HTMLParser):
    """Collects nodes; html and body always exist as the two outermost ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []
        self._add("html")
        self._add("body")

    def _add(self, tag, attrs=None, text=None):
        attrs = attrs or {}
        self.nodes.append(
            {
                "id": len(self.nodes) + 1,
                "last": len(self.nodes) + 1,
                "up": self.open[-1]["id"] if self.open else 0,
                "tag": tag,
                "css": attrs["class"].split() if "class" in attrs else None,
                "href": attrs.get("href"),
                "title": attrs.get("title"),
                "text": text,
                "leaf": True,
            }
        )
        if tag:
            if self.open:
                self.open[-1]["leaf"] = False
            self.open.append(self.nodes[-1])

    def _close(self, depth):
        while len(self.open) > depth:
            self.open.pop()["last"] = len(self.nodes)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        while tag in CLOSED_BY.get(self.open[-1]["tag"], ()):
            self._close(len(self.open) - 1)
        self._add(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 1, -1):
            if self.open[depth]["tag"] == tag:
                return self._close(depth)

    def handle_data(self, data):
        self._add("", text=data)


def nodes_of(page: str | None) -> list[dict]:
    parser = _Nodes()
    parser.feed(page or "")
    parser.close()
    parser._close(0)
    return parser.nodes


def slices(pages: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The pages in order, in runs of at most ``size`` bytes, or a single page of more."""
    start = held = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if at > start and held + n > size:
            yield pages.slice(start, at - start)
            start, held = at, 0
        held += n
    yield pages.slice(start)


@F.arrow_udf(T.ArrayType(NODE))
def html_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The nodes of each page. A page's nodes take far more than its text, so a batch comes back
    in slices by bytes, however many rows it has."""
    for pages in batches:
        for some in slices(pages):
            yield pa.array([nodes_of(page) for page in some.to_pylist()], _ARROW)


# ---- Selection ----------------------------------------------------------------


def subtree(nodes: Column, node: Column) -> Column:
    """The node and all nodes inside it, out of the page's whole array."""
    return F.slice(nodes, node["id"], node["last"] - node["id"] + 1)


def is_a(node: Column, tag: str = "", css: str = "") -> Column:
    """Does the node have this tag and this class?"""
    test = node["tag"] != ""
    if tag:
        test = node["tag"] == tag
    if css:
        test = test & F.coalesce(F.array_contains(node["css"], css), F.lit(False))
    return test


def inside(node: Column, outer: Column) -> Column:
    return (node["id"] > outer["id"]) & (node["id"] <= outer["last"])


def find(scope: Column, tag: str = "", css: str = "", within: tuple[str, str] | None = None) -> Column:
    """Nodes of a card other than the card itself, in document order. ``within``
    asks for an ancestor with that tag and class, which may be the card."""

    def test(node: Column, i: Column) -> Column:
        ok = (i > 0) & is_a(node, tag, css)
        if within is not None:
            ok = ok & F.exists(scope, lambda outer: is_a(outer, *within) & inside(node, outer))
        return ok

    return F.filter(scope, test)


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def text_of(scope: Column, node: Column) -> Column:
    """All text inside the node, '' when there is no such node."""

    def joined(outer: Column) -> Column:
        texts = F.filter(scope, lambda n: (n["tag"] == "") & inside(n, outer))
        return F.array_join(texts["text"], "")

    return F.coalesce(once(node, joined), F.lit(""))


def attr(node: Column, name: str) -> Column:
    return F.coalesce(node[name], F.lit(""))
