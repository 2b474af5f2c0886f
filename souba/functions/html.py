"""Reading HTML pages with built-in expressions, over an index of their tags.

A page is read once, into the array of its tags (``tag_index``). An element is the part of that array from its opening
tag to the closing tag of the same depth, a running sum over the tags of its name; cards are such parts, and fields look
up elements inside them. No text is searched again for a field. All of it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from souba.functions.text import blank_to_null, let, strip

_DOT_ALL = "(?is)"
_CLASS = r"(?is)\bclass\s*=\s*[\"']([^\"']*)[\"']"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INERT = "\ue000"       # stands for a < inside a comment

# --- fixed values: named character references met on the pages ---------------
NAMED_ENTITIES = {
    "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&yen;": "¥", "&reg;": "®", "&trade;": "™", "&copy;": "©", "&times;": "×",
}


def _comments_closed(html: Column) -> Column:
    """Comments without a ``<`` in them, so that none of what they hold counts as a tag."""
    def closed(part: Column, i: Column) -> Column:
        body = F.substring_index(part, "-->", 1)
        return F.when(i == 0, part).when(part.contains("-->"), F.concat(
            F.lit("<!--"), F.replace(body, F.lit("<"), F.lit(_INERT)), F.substring(part, F.char_length(body) + 1, F.char_length(part)))).otherwise(F.concat(F.lit("<!--"), part))
    return F.when(html.contains("<!--"), F.array_join(F.transform(F.split(html, "<!--"), closed), "")).otherwise(html)


def _without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def tag_index(html: Column, scripts: bool = False) -> Column:
    """The tags of a page in order, under one for the page itself: the index all lookups work on.

    Each has its number ``at``, ``open`` (false for closing tags), its ``name`` in lower case, its class ``tokens``
    between spaces, its ``attrs`` as written, after the name, and the decoded ``text`` up to the next tag. A comment is a
    tag of the name ``!--``; what is no tag, such as a ``<`` in the text, has no name. Scripts and styles are left out
    unless asked for.
    """
    page = _comments_closed(html) if scripts else _without_scripts(_comments_closed(html))

    # Three passes over the pieces, so that a name and what stands before the closing > are found once each.
    def named(t: Column) -> Column:
        return F.struct(F.when(t.startswith("!--"), F.when(t.contains("-->"), F.lit("!--"))).when(t.contains(">"), F.nullif(
            F.regexp_extract(t, r"^/?([a-zA-Z]\w*)", 1), F.lit(""))).alias("name"), t.alias("t"))

    def parted(x: Column) -> Column:
        inside = F.when(x["name"].isNull(), "").when(x["name"] == "!--", F.substring_index(x["t"], "-->", 1)).otherwise(F.substring_index(x["t"], ">", 1))
        return F.struct(x["name"].alias("name"), inside.alias("attrs"), x["t"].alias("t"))

    def read(t: Column, i: Column) -> Column:
        attrs, skip = t["attrs"], F.when(t["name"] == "!--", 3).otherwise(1)
        text = F.when(t["name"].isNull(), F.concat(F.lit("<"), t["t"])).otherwise(
            F.substring(t["t"], F.char_length(attrs) + skip + 1, F.char_length(t["t"])))
        tokens = F.concat(F.lit(" "), F.translate(F.regexp_extract(attrs, _CLASS, 1), "\t\n\f\r", "    "), F.lit(" "))
        name = F.coalesce(F.translate(t["name"], _UPPER, _UPPER.lower()), F.lit(""))
        return F.struct(
            i.alias("at"), (~attrs.startswith("/")).alias("open"), name.alias("name"),
            F.when(attrs.contains("class") | attrs.contains("CLASS"), tokens).alias("tokens"), attrs.alias("attrs"),
            unescape(text).alias("text"))
    pieces = F.split(F.concat(F.lit("page>"), page), "<")
    return F.transform(F.transform(F.transform(pieces, named), parted), read)


def _opens(tag: str | None = None, css_class: str | None = None, attribute: str | None = None, value: str | None = None) -> Callable[[Column], Column]:
    """Whether a tag opens an element of a name, a class token, an attribute or an attribute's value."""
    def matches(t: Column) -> Column:
        found = t["open"] & ((t["name"] == tag) if tag else ~t["name"].isin("", "!--"))
        if css_class:
            found = found & t["tokens"].contains(f" {css_class} ")
        if attribute:
            quoted = "" if value is None else rf"\s*[\"']\Q{value}\E[\"']"
            found = found & t["attrs"].rlike(rf"(?is)\s\Q{attribute}\E\s*={quoted}")
        return found
    return matches


def _inside(index: Column) -> Column:
    """What follows the first tag of a bound index."""
    return F.slice(index, F.lit(2), F.greatest(F.size(index) - 1, F.lit(0)))


def element(index: Column) -> Column:
    """The part of an index that belongs to its first tag: up to the closing tag of the same depth, all where none is."""
    def depth(acc: Column, t: Column) -> Column:
        now = acc["depth"] + F.when(t["open"], 1).otherwise(-1)
        return F.struct(now.alias("depth"), F.coalesce(acc["end"], F.when(now == 0, t["at"])).alias("end"))

    def cut(x: Column) -> Column:
        first = F.get(x, 0)
        start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
        same = let(first["name"], lambda name: F.filter(x, lambda t: t["name"] == name))
        end = let(same, lambda some: F.when(~F.get(some, 1)["open"], F.get(some, 1)["at"]).otherwise(F.aggregate(some, start, depth)["end"]))
        return F.slice(x, F.lit(1), F.coalesce(end - first["at"], F.size(x)))
    return let(index, cut)


def first(index: Column, tag: str | None = None, css_class: str | None = None, attribute: str | None = None) -> Column:
    """The first such element inside an element or page; null when there is none."""
    def of(x: Column) -> Column:
        found = F.get(F.filter(_inside(x), _opens(tag, css_class, attribute)), 0)["at"]
        return element(let(found - F.get(x, 0)["at"], lambda at: F.when(at.isNotNull(), F.slice(x, at + 1, F.size(x)))))
    return let(index, of)


def every(index: Column, tag: str, css_class: str | None = None, attribute: str | None = None, value: str | None = None) -> Column:
    """All such elements, in page order; one inside another counts too."""
    return let(index, lambda x: F.transform(
        F.filter(_inside(x), _opens(tag, css_class, attribute, value)), lambda o: element(F.slice(x, o["at"] - F.get(x, 0)["at"] + 1, F.size(x)))))


def cards_by_tag(index: Column, tag: str, css_class: str | None = None) -> Column:
    """One element per card, cut short by the next opening tag of its kind."""
    def of(x: Column) -> Column:
        opens = F.filter(_inside(x), _opens(tag, css_class))
        ends = lambda some, i: F.coalesce(F.get(some, i + 1)["at"], F.get(x, -1 + F.size(x))["at"] + 1)
        return let(opens, lambda some: F.transform(some, lambda o, i: element(
            F.slice(x, o["at"] - F.get(x, 0)["at"] + 1, ends(some, i) - o["at"]))))
    return let(index, of)


def cards_in_list(index: Column, list_class: str | None = None, container: str = "ul") -> Column:
    """``li`` cards of the lists that carry a class; lists inside a card do not end it."""
    return F.flatten(F.transform(cards_by_tag(index, container, list_class), lambda one: cards_by_tag(one, "li")))


def attrs_of(index: Column) -> Column:
    """Attributes of an element's own tag; null where there is no element."""
    return F.get(index, 0)["attrs"]


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute; null when absent or empty."""
    pattern = rf"{_DOT_ALL}\s\Q{name}\E\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return unescape(let(attrs, lambda t: F.coalesce(
        *[blank_to_null(F.regexp_extract(t, pattern, i)) for i in (1, 2, 3)])))


def has_class(index: Column, css_class: str) -> Column:
    """Whether an element's own tag has a class token."""
    return F.coalesce(F.get(index, 0)["tokens"].contains(f" {css_class} "), F.lit(False))


def unescape(text: Column) -> Column:
    """Character references to characters; ``&amp;`` last, so nothing is decoded twice."""
    def decoded(t: Column) -> Column:
        for name, char in NAMED_ENTITIES.items():
            t = F.replace(t, F.lit(name), F.lit(char))
        return F.replace(_numeric_references(t), F.lit("&amp;"), F.lit("&"))
    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def _numeric_references(text: Column) -> Column:
    """``&#N;`` and ``&#xN;``; a number that is no character gives U+FFFD."""
    def decoded(acc: Column, ref: Column) -> Column:
        is_hex = F.lower(ref).startswith("x")
        digits = F.when(is_hex, F.substring(ref, 2, 8)).otherwise(F.conv(ref, 10, 16))
        number = F.conv(digits, 16, 10).cast("int")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(known, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.replace(acc, F.concat(F.lit("&#"), ref, F.lit(";")), char)
    pattern = r"&#([xX][0-9a-fA-F]{1,6}|\d{1,7});"
    return let(text, lambda t: F.aggregate(
        F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))), t, decoded))


def text_of(index: Column) -> Column:
    """Text of an element, each piece of text stripped before joining."""
    return F.array_join(F.transform(index["text"], strip), "")


def raw_text_of(index: Column) -> Column:
    """Text of an element with its white space."""
    return F.array_join(index["text"], "")


def bare_text(markup: Column) -> Column:
    """Text of a piece of markup, such as a comment's body."""
    return unescape(F.regexp_replace(markup, r"<[^>]*>", ""))


def comments(index: Column) -> Column:
    """Texts of the comments inside an element or page, in page order."""
    return F.transform(F.filter(index, lambda t: t["name"] == "!--"), lambda t: F.replace(
        F.substring(t["attrs"], F.lit(4), F.char_length(t["attrs"])), F.lit(_INERT), F.lit("<")))


def json_ld(html: Column) -> Column:
    """Bodies of the JSON-LD script blocks."""
    pattern = r"(?is)<script\b(?=[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'])[^>]*>(.*?)</script\s*>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
