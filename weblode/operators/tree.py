"""Where elements close: the one sequential rule of HTML.

Whether ``<p>`` ends at a later ``<div>`` depends on everything still open,
so closing is a stack walk; windows over exploded tokens give it only for
well-formed pages, or with a join that is quadratic per page.  The walk below
sees nothing but tag marks (``+div``, ``-div``, ``.br``), comes in Arrow
batches, and keeps the page in its row: no shuffle.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The walk travels with the plan, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values from the HTML standard: elements without an end tag, elements
# whose content is not markup, and start tags that end an open paragraph.
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
RAW = ("script", "style", "noscript", "svg", "template", "iframe")
ENDS_P = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
)

# Start tag -> (elements it ends, elements the search does not leave).
_P_RULE = ({"p"}, {"table", "td", "th", "caption", "button", "object"})
_ROW_PARTS = {"thead", "tbody", "tfoot"}
ENDS = {tag: [_P_RULE] for tag in ENDS_P}
ENDS["li"] = [({"li"}, {"ul", "ol", "menu", "dir"})]
ENDS["dt"] = ENDS["dd"] = [({"dt", "dd"}, {"dl"})]
ENDS["td"] = ENDS["th"] = [({"td", "th"}, {"tr", "table"})]
ENDS["tr"] = [({"td", "th", "tr"}, {"table"} | _ROW_PARTS)]
for _part in _ROW_PARTS:
    ENDS[_part] = [({"td", "th", "tr"} | _ROW_PARTS, {"table"})]
ENDS["option"] = [({"option"}, {"select", "optgroup", "datalist"})]
ENDS["optgroup"] = [({"option", "optgroup"}, {"select"})]

# A stray end tag reaches through open elements of its own strength or less.
STRENGTH = {
    "div": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "table": 6, "head": 7, "body": 7, "html": 8,
}


def close_elements(marks: list[str]):
    """(end, parent, depth, nth, hidden) per token of one page.

    ``end`` is the position of the first token past the element's content,
    ``nth`` its place among element siblings.  An end tag has the element it
    closes as parent, or -1 when it closes nothing.
    """
    n = len(marks)
    end, parent, depth, nth, hidden = [0] * n, [-1] * n, [0] * n, [0] * n, [False] * n
    names, starts, counts, dark = [], [], [0], [False]

    def shut(down_to: int, at: int) -> None:
        while len(names) > down_to:
            names.pop()
            end[starts.pop()] = at
            counts.pop()
            dark.pop()

    for i, mark in enumerate(marks):
        kind, tag = mark[:1], mark[1:]
        if kind == "-":
            limit = STRENGTH.get(tag, 1)
            for k in range(len(names) - 1, -1, -1):
                if names[k] == tag:
                    parent[i] = starts[k]
                    shut(k, i)
                    break
                if STRENGTH.get(names[k], 1) > limit:
                    break
            end[i], depth[i], hidden[i] = i + 1, len(names), dark[-1]
            continue
        if kind:
            for targets, bounds in ENDS.get(tag, ()):
                cut = -1
                for k in range(len(names) - 1, -1, -1):
                    if names[k] in bounds:
                        break
                    if names[k] in targets:
                        cut = k
                if cut >= 0:
                    shut(cut, i)
            counts[-1] += 1
            nth[i] = counts[-1]
        end[i] = i + 1
        depth[i] = len(names)
        parent[i] = starts[-1] if starts else -1
        hidden[i] = dark[-1] or kind in ("!", ":")
        if kind in ("+", "!"):
            names.append(tag)
            starts.append(i)
            counts.append(0)
            dark.append(hidden[i])
    shut(0, n)
    return end, parent, depth, nth, hidden


TREE_TYPE = T.StructType(
    [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("end", "parent", "depth", "nth")]
    + [T.StructField("hidden", T.ArrayType(T.BooleanType()))]
)


@arrow_udf(TREE_TYPE)
def tree_of(marks: pa.Array) -> pa.Array:
    offsets, flat = [0], ([], [], [], [], [])
    for page in marks.to_pylist():
        for column, values in zip(flat, close_elements(page or [])):
            column.extend(values)
        offsets.append(len(flat[0]))
    where = pa.array(offsets, pa.int32())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    lists = [pa.ListArray.from_arrays(where, pa.array(c, k)) for c, k in zip(flat, kinds)]
    return pa.StructArray.from_arrays(lists, names=["end", "parent", "depth", "nth", "hidden"])
