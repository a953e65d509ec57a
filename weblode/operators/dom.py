"""A page as an array of nodes in its own row.

``with_nodes`` turns an HTML column into ``nodes``: one struct per token, in
page order, where ``pos`` is the token's place and ``[pos, end)`` its span.
Containment is then a slice of the array, so every per-page operator is a
narrow projection: no shuffle, no join, work in proportion to the answer.
``node_rows`` explodes the same array for set-at-a-time work across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions.text import clean, let, strip, unescape
from weblode.operators.rows import settle
from weblode.operators.tree import RAW, VOID, tree_of

_RAW_ELEMENTS = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in RAW)
# Comment, whole raw-text element, tag (quotes respected), tag with broken
# quotes, declaration, text run, lone bracket.  Joined in order, the tokens
# give the page back.  The loops are possessive: a repeated group that may
# backtrack costs the matcher a stack frame per turn, and a tag with thousands
# of attributes would end the executor.
TOKEN = (
    r"(?is)<!--.*?-->|" + _RAW_ELEMENTS + r"""|</?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
    r"|</?[a-z][^>]*+>|<[!?][^>]*+>|[^<]++|<"
)
HIDDEN = (
    r"(?is)^<[a-z][^>]*\s(?:hidden(?:[\s=/>])|aria-hidden\s*=\s*\S?true"
    r"|style\s*=\s*[^>]*(?:display\s*:\s*none|visibility\s*:\s*hidden))"
)
ATTRIBUTE = r"""(?s)[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""


def _names(tags) -> str:
    return ", ".join(f"'{t}'" for t in tags)


# A token with its tag name, then with what kind of token it is.
_DESCRIBE = """t -> struct(case when startswith(t, '<') then lower(regexp_extract(t, r'^</?([a-zA-Z][^\\s/>]*)', 1)) else '' end as tag, t as raw)"""
_CLASSIFY = f"""t -> struct(
    case when t.tag = '' and (not startswith(t.raw, '<') or t.raw = '<') then 'text'
         when t.tag = '' then 'other'
         when startswith(t.raw, '</') then 'close'
         when t.tag in ({_names(VOID)}) then 'leaf'
         when t.tag in ({_names(RAW)}) and t.raw rlike r'(?is)</[a-z]+\\s*>$' then 'raw'
         else 'open' end as kind, t.tag, t.raw)"""


def tokens(html) -> Column:
    """Array of (kind, tag, raw) in page order."""
    raw = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(TOKEN), F.lit(0))
    return F.call_function("transform", F.call_function("transform", raw, F.expr(_DESCRIBE)), F.expr(_CLASSIFY))


# What the closing walk gets to see: ``+div``, ``!div`` (hidden), ``-div``, ``.br``, ``:br`` (hidden).
_MARK = f"""t -> case when t.kind in ('text', 'other') then ''
    when t.kind = 'close' then concat('-', t.tag)
    else concat(case when instr(t.raw, ' ') > 0 and t.raw rlike r'{HIDDEN}'
                     then case when t.kind = 'open' then '!' else ':' end
                     else case when t.kind = 'open' then '+' else '.' end end, t.tag) end"""


def with_nodes(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace the HTML column by ``nodes``; ``keep`` names columns to retain, all others by default."""
    others = [F.col(c) for c in (keep or pages.columns) if c != html]
    lexed = pages.select(*others, tokens(html).alias("_tokens"))
    closed = lexed.withColumn("_tree", tree_of(F.call_function("transform", F.col("_tokens"), F.expr(_MARK))))
    tree = F.col("_tree")

    def node(t: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"),
            F.get(tree["end"], i).alias("end"),
            F.get(tree["parent"], i).alias("parent"),
            F.get(tree["depth"], i).alias("depth"),
            F.get(tree["nth"], i).alias("nth"),
            F.get(tree["hidden"], i).alias("hidden"),
            t["kind"].alias("kind"),
            t["tag"].alias("tag"),
            t["raw"].alias("raw"),
            F.when(t["kind"] == "text", unescape(t["raw"])).alias("text"),
            F.when(t["kind"].isin("open", "leaf", "raw"), _attributes(t)).alias("attrs"),
        )

    return settle(closed, others, nodes=F.transform("_tokens", node))


def is_element(n: Column) -> Column:
    return n["kind"].isin("open", "leaf", "raw")


def inside(nodes, n: Column) -> Column:
    """The tokens between a node's start tag and its end."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.slice(nodes, n["pos"] + 2, n["end"] - n["pos"] - 1)


def _attributes(n: Column) -> Column:
    """Attributes of a start tag as an array of (name, value), in order."""
    head = F.when(n["kind"] == "raw", F.regexp_extract(n["raw"], r"(?s)^(<[^>]*>)", 1)).otherwise(n["raw"])
    body = F.regexp_replace(head, r"^<[a-zA-Z][^\s/>]*|/?>$", "")

    def pair(text: Column) -> Column:
        value = F.regexp_replace(text, r"""(?s)^[^=]*=\s*["']?|["']$|^[^=]*$""", "")
        return F.struct(F.lower(F.regexp_extract(text, r"^[^\s=]+", 0)).alias("name"), unescape(value).alias("value"))

    found = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(0)), pair)
    return F.when(F.length(head) > F.length(n["tag"]) + 2, found)


def attribute(n: Column, name: str) -> Column:
    """First value of an attribute; empty text when it has none, null when it is absent."""
    return F.get(F.filter(n["attrs"], lambda a: a["name"] == name.lower()), F.lit(0))["value"]


def script_body(n: Column) -> Column:
    """Content of a raw-text element."""
    return F.regexp_replace(n["raw"], r"(?s)^<[^>]*>|</[a-zA-Z]+\s*>$", "")


def _joined(texts: Column) -> Column:
    runs = F.transform(F.filter(texts, lambda t: t["kind"] == "text"), lambda t: strip(t["text"]))
    return F.array_join(F.filter(runs, lambda r: r != ""), "\n")


def subtree_text(nodes, n: Column) -> Column:
    """Text of an element: trimmed runs, empty ones dropped, one per line."""
    return _joined(inside(nodes, n))


def page_text(nodes="nodes") -> Column:
    """Text of the whole page, by the same rule."""
    return _joined(F.col(nodes) if isinstance(nodes, str) else nodes)


def own_texts(nodes, n: Column) -> Column:
    """Direct text nodes of an element (of a raw-text element: its body)."""
    direct = F.transform(
        F.filter(inside(nodes, n), lambda t: (t["kind"] == "text") & (t["parent"] == n["pos"])),
        lambda t: t["text"],
    )
    return F.when(n["kind"] == "raw", F.array(script_body(n))).otherwise(direct)


def outer_html(nodes, n: Column) -> Column:
    """The element's own markup, with its end tag when it has one."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    after = F.get(nodes, n["end"])
    tail = F.when((after["kind"] == "close") & (after["parent"] == n["pos"]), after["raw"]).otherwise(F.lit(""))
    body = F.array_join(F.transform(inside(nodes, n), lambda t: t["raw"]), "")
    return F.concat(n["raw"], body, F.when(n["kind"] == "open", tail).otherwise(F.lit("")))


def page_title(nodes="nodes") -> Column:
    """Cleaned text of the first title element; empty when there is none."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    titles = F.filter(nodes, lambda n: (n["kind"] == "open") & (n["tag"] == "title"))
    text = let(F.get(titles, F.lit(0)), lambda n: F.get(own_texts(nodes, n), F.lit(0)))
    return clean(F.coalesce(text, F.lit("")))


def node_rows(dom: DataFrame, *keys: str) -> DataFrame:
    """One row per element: the node table, for work across pages."""
    rows = dom.select(*keys, F.explode(F.filter("nodes", is_element)).alias("n"))
    return rows.select(*keys, "n.pos", "n.end", "n.parent", "n.depth", "n.nth", "n.hidden", "n.kind", "n.tag", "n.attrs")
