"""Text helpers: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from souba import fixed_values as fv

ANY_CASE = "(?iU)"   # case-insensitive, Unicode \w \b \s \d
UNICODE = "(?U)"     # case-sensitive, Unicode classes
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that the body uses more than once, so it is computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1, flags: str = UNICODE) -> Column:
    """First match of a pattern; null, not '', where nothing matches."""
    return blank_to_null(F.regexp_extract(text, flags + pattern, group))


def literal_pattern(words: list[str]) -> str:
    """Alternation of literal words for a Java regex."""
    return "|".join("\\Q" + word + "\\E" for word in words)


def has_any(text: Column, words: list[str]) -> Column:
    """Does the text contain one of the words, case-sensitively?"""
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def starts_with_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(word) for word in words])


def first_non_blank(*columns: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


# --- H1 --------------------------------------------------------------------
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def to_half_width(text: Column) -> Column:
    """H1 full-width ASCII and the ideographic space to half width; katakana stays."""
    return F.translate(text, _FULL_WIDTH, _HALF_WIDTH)


def to_full_width(text: Column) -> Column:
    """Inverse of H1, used to derive full-width test text."""
    return F.translate(text, _HALF_WIDTH, _FULL_WIDTH)


# --- H12 -------------------------------------------------------------------
def clean_brand(raw: Column) -> Column:
    """H12 shop brand label to brand: exact label, then any label inside, then as is."""
    name = strip(F.split_part(F.split_part(raw, F.lit("("), F.lit(1)), F.lit("（"), F.lit(1)))
    labels = F.create_map(*[F.lit(x) for pair in fv.BRAND_LABELS.items() for x in pair])
    inside = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, brand in fv.BRAND_LABELS.items():
        inside = inside.when(raw.contains(label), F.lit(brand))
    inside = inside.when(raw.contains(fv.OTHER_BRAND), F.lit(""))
    return F.coalesce(F.try_element_at(labels, name), inside, name)


# --- H14 -------------------------------------------------------------------
def parse_price(text: Column, marks: str = "¥￥,円～", strict: bool = False) -> Column:
    """H14 price text to yen, null when there is none.

    ``marks`` are dropped first. ``strict`` then accepts nothing but digits;
    otherwise the first run of digits counts.
    """
    bare = strip(F.translate(text, marks, ""))
    digits = r"(?U)^(\d+)$" if strict else r"(?U)(\d+)"
    return blank_to_null(F.regexp_extract(bare, digits, 1)).try_cast("bigint")


# --- H15 / H16 -------------------------------------------------------------
def url_tail(url: Column) -> Column:
    """Last path segment of a URL, trailing slashes ignored."""
    return blank_to_null(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1))


def url_parameter(url: Column, name: str) -> Column:
    """Query parameter of an absolute or relative URL."""
    return blank_to_null(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def url_number(url: Column, before: str, after: str = "") -> Column:
    """Number between two literal parts of a URL."""
    return first_match(url, rf"\Q{before}\E(\d+)" + (rf"\Q{after}\E" if after else ""))


def absolute_url(href: Column, base: str) -> Column:
    """H16 put the site in front of links that start at its root."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


# --- H17 -------------------------------------------------------------------
def shop_name(raw: Column) -> Column:
    """H17 cut the remark in full-width parentheses."""
    return strip(F.split_part(raw, F.lit("（"), F.lit(1)))


# --- H22 / H23 -------------------------------------------------------------
def condition_grade(text: Column) -> Column:
    """H22 condition phrase to grade; other text stays, blank becomes null."""
    phrase = strip(text)
    grades = F.create_map(*[F.lit(x) for pair in fv.CONDITION_GRADES.items() for x in pair])
    return F.coalesce(F.try_element_at(grades, phrase), blank_to_null(phrase))


def condition_from_title(title: Column) -> Column:
    """H23 condition mark inside a title."""
    return (
        F.when(title.rlike(r"\[[ABC]:[^\]]+\]"), F.regexp_extract(title, r"\[([ABC]):[^\]]+\]", 1))
        .when(title.contains("訳あり"), "Junk")
        .when(title.contains("バリュー"), "Value")
    )


# --- H24 -------------------------------------------------------------------
def inches_between(text: Column, low: float = 10, high: float = 20) -> Column:
    """Text to inches when it is a plausible screen size."""
    size = F.regexp_extract(text, r"^(\d+\.?\d*)$", 1).try_cast("double")
    return let(size, lambda s: F.when(s.between(low, high), s))


def screen_size(title: Column) -> Column:
    """H24 screen size: a number with its unit, else a bare NN.N."""
    return F.coalesce(
        inches_between(first_match(title, r"(\d{2}(?:\.\d+)?)\s*(?:インチ|inch)", flags=ANY_CASE)),
        inches_between(first_match(title, r"\b(\d{2}\.\d)\b")),
    )


# --- H25 -------------------------------------------------------------------
def json_ld_sku(blocks: Column) -> Column:
    """H25 sku of the first JSON-LD block that describes a product; '' when it has none."""
    is_product = lambda block: F.coalesce(F.get_json_object(block, "$.@type") == "Product", F.lit(False))
    first = F.get(F.filter(blocks, is_product), 0)
    return let(first, lambda product: F.when(
        product.isNotNull(), F.coalesce(F.get_json_object(product, "$.sku"), F.lit(""))))


# --- H26 -------------------------------------------------------------------
def first_with_word(texts: Column, words: list[str]) -> Column:
    """H26 first text of a list that mentions one of the words."""
    return F.get(F.filter(texts, lambda t: has_any(t, words)), 0)


# --- H30 / H31 / H32 / H33 --------------------------------------------------
def yen(amount: Column) -> Column:
    """H30 ``¥12,345``, decimals cut."""
    return F.concat(F.lit("¥"), F.format_number(amount.cast("bigint"), 0))


def yen_or_dash(amount: Column) -> Column:
    """H30 for tables: nothing or zero shows as a dash."""
    return F.when(amount.isNull() | (amount == 0), F.lit("—")).otherwise(yen(amount))


def change_class(pct: Column) -> Column:
    """H31 flat / up / down."""
    return (
        F.when(pct.isNull() | (F.abs(pct) < fv.FLAT_CHANGE_PCT), "flat")
        .when(pct > 0, "up").otherwise("down")
    )


def change_label(pct: Column) -> Column:
    """H31 change as shown to readers."""
    return (
        F.when(pct.isNull(), F.lit("—"))
        .when(F.abs(pct) < fv.FLAT_CHANGE_PCT, F.lit("→ flat"))
        .otherwise(F.concat(F.when(pct > 0, "↑").otherwise("↓"), F.format_string(" %+.1f%%  /7d", pct)))
    )


def date_label(ts: Column) -> Column:
    """H32 ``yyyy-MM-dd``."""
    return F.date_format(ts, "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """H33 ISO-8601 text (any offset) to an instant; bad text to null."""
    return F.try_to_timestamp(text)
