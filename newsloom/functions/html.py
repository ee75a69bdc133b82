"""Native expressions over raw HTML text: cleaning, elements, links, entities.

They cover what article extraction needs (first element by name and class,
paragraphs, meta tags, anchors) without a tree per row, so extraction stays a
projection inside the scan stage.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as tx

_TAG = r"""<[a-zA-Z/!?](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_HIDDEN = _UNREAD + r"|<template\b.*?</template\s*>"
_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_NODE_BREAK = "\u0001"


def visible(html: Column) -> Column:
    """Markup without comments, scripts, styles and templates."""
    return F.regexp_replace(html, _HIDDEN, "")


def markup(html: Column) -> Column:
    """Markup without comments, scripts and styles: templates hold anchors, too."""
    return F.regexp_replace(html, _UNREAD, "")


def _entity_map() -> Column:
    """Entity name to character, as one constant (names are case-sensitive)."""
    pairs = (f"{name}\u0002{chr(cp)}" for name, cp in sorted(name2codepoint.items()))
    return F.str_to_map(F.lit("\u0001".join(pairs)), F.lit("\u0001"), F.lit("\u0002"))


def _code_point(n: Column) -> Column:
    """One character from its code point; NULL for an invalid one."""
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);?"


def unescape(c: Column) -> Column:
    """Decode character references; unknown ones are kept as written.

    The text is cut at ``&``: each piece but the first may start with one
    reference, so a decoded ``&`` is never decoded twice.
    """
    names = _entity_map()

    def decoded(ref: Column) -> Column:
        return (
            F.when(ref.rlike("^#[xX]"), _code_point(F.conv(F.substring(ref, 3, 6), 16, 10).cast("long")))
            .when(ref.startswith("#"), _code_point(F.substring(ref, 2, 7).cast("long")))
            .otherwise(names[ref])
        )

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, _REFERENCE, 1)
        return F.coalesce(
            F.concat(tx.bind(ref, decoded), F.regexp_replace(p, _REFERENCE, "")),
            F.concat(F.lit("&"), p),
        )

    whole = tx.bind(F.split(c, "&", -1), lambda pieces: F.concat(
        pieces[0], F.array_join(F.transform(F.slice(pieces, 2, tx.REST), piece), "")
    ))
    return F.when(c.contains("&"), whole).otherwise(c)


def node_text(fragment: Column, sep: str) -> Column:
    """Text of a fragment: each text node decoded and stripped, joined by ``sep``."""
    nodes = F.split(F.regexp_replace(fragment, _TAG, _NODE_BREAK), _NODE_BREAK, -1)
    return tx.join_non_empty(F.transform(nodes, lambda n: tx.strip(unescape(n))), sep)


def _class_test(name: str) -> str:
    return (
        rf"""(?=[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}[\s>]))"""
    )


def element_inner(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Inner markup of the first ``tag`` element (with a class), NULL if absent.

    Same-named elements inside are matched by depth; an element that is never
    closed runs to the end of the page.
    """
    test = _class_test(css_class) if css_class else ""
    opening = rf"(?is)<{tag}\b{test}{_ATTRS}>"
    mark = rf"(?i)(</?{tag}\b){_ATTRS}>"

    def step(acc, m):
        return tx.bind(acc["depth"] + F.when(m.startswith("</"), -1).otherwise(1), lambda d: F.struct(
            d.alias("depth"),
            (acc["at"] + 1).alias("at"),
            F.when((acc["close"] < 0) & (d == 0), acc["at"]).otherwise(acc["close"]).alias("close"),
        ))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("close"))

    def inner(rest: Column) -> Column:
        marks = F.regexp_extract_all(rest, F.lit(mark), F.lit(1))
        close = F.aggregate(marks, start, step)["close"]
        kept = tx.bind(close, lambda at: F.when(at < 0, F.lit(tx.REST)).otherwise(at + 1))
        return F.array_join(F.slice(F.split(rest, mark, -1), F.lit(1), kept), f"<{tag}>")

    return F.when(
        html.rlike(opening),
        tx.bind(F.regexp_extract(html, rf"{opening}(.*)$", 1), inner),
    )


def paragraphs(fragment: Column) -> Column:
    """Text of each paragraph; one ends at the next ``<p``, ``</p>`` or the end."""
    starts = F.slice(F.split(fragment, rf"(?i)<p(?=[\s>/]){_ATTRS}>", -1), 2, tx.REST)
    bodies = F.transform(starts, lambda s: F.split(s, r"(?i)</p\s*>", 2)[0])
    return F.transform(bodies, lambda b: node_text(b, " "))


def _attr(tag: Column, name: str) -> Column:
    """Attribute value of one tag; NULL if the tag does not carry it."""
    other = r"""(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*?"""
    value = F.regexp_extract(
        tag, rf"""(?is)^<[^\s>]+{other}\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1
    )
    return tx.bind(value, lambda v: F.when(
        v.rlike("""^["']"""), F.substring(v, F.lit(2), F.length(v) - 2)
    ).when(v != "", v))


def meta_content(html: Column, prop: str) -> Column:
    """Content of the first ``<meta property=prop>``; '' if empty, NULL if absent."""
    metas = F.regexp_extract_all(html, F.lit(rf"(?is)(<meta\b{_ATTRS}>)"), F.lit(1))
    wanted = F.filter(metas, lambda m: _attr(m, "property") == prop)
    return tx.bind(F.get(wanted, F.lit(0)), lambda m: F.when(
        m.isNotNull(), F.coalesce(unescape(_attr(m, "content")), F.lit(""))
    ))


def hrefs(html: Column) -> Column:
    """Decoded ``href`` values of all anchors, in page order."""
    anchors = F.regexp_extract_all(html, F.lit(rf"(?is)(<a\s{_ATTRS}>)"), F.lit(1))
    values = F.transform(anchors, lambda a: unescape(_attr(a, "href")))
    return F.filter(values, lambda v: v.isNotNull())
