"""Landed HTML pages to listings.

``extract_cards(pages, LAYOUTS[...])`` turns a table of pages into a table of
listings: cards are cut out of each page, exploded to rows, read field by field
and checked for their mandatory parts. A page is independent of all others, so
the job has no shuffle. A bad card is dropped; it never fails its page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from souba import fixed_values as fv
from souba.functions import html as H
from souba.functions.text import (
    absolute_url, blank_to_null, clean_brand, condition_from_title, condition_grade, first_match,
    first_non_blank, first_with_word, has_any, json_ld_sku, let, parse_price, screen_size, shop_name,
    strip, url_number, url_parameter, url_tail,
)
from souba.functions.titles import block_specs, bracket_specs, label_specs, slash_specs


@dataclass(frozen=True)
class Layout:
    """How one shop's listing page is read.

    ``cards`` finds the cards in a page's tag index, ``raw`` reads the pieces of a card
    into named columns, ``specs`` parses some of those, ``fields`` builds the listing from those columns and
    ``keep`` says which listings have their mandatory parts.
    """

    source: str
    default_query: str
    cards: Callable[[Column], Column]
    raw: Callable[[Column], dict[str, Column]]
    specs: Callable[[], dict[str, Column]]
    fields: Callable[[], dict[str, Column]]
    keep: Callable[[], Column]


def extract_cards(pages: DataFrame, layout: Layout, scraped_at: Column | None = None) -> DataFrame:
    """Listings of a table of pages (``html``; other columns are carried along)."""
    carried = [c for c in pages.columns if c != "html"]
    index = pages.select(*carried, H.tag_index(F.col("html")).alias("_page"))
    cards = index.select(*carried, F.posexplode(layout.cards(F.col("_page"))).alias("card_no", "_card"))
    raw = cards.select(*carried, "card_no", *[c.alias(n) for n, c in layout.raw(F.col("_card")).items()])
    raw = raw.where(layout.keep()).select("*", *[c.alias(n) for n, c in layout.specs().items()])
    query = F.col("search_query") if "search_query" in carried else F.lit(None).cast("string")
    fields = layout.fields()
    stamped = {
        "source": F.lit(layout.source),
        "search_query": F.coalesce(query, F.lit(layout.default_query)),
        "scraped_at": scraped_at if scraped_at is not None else F.current_timestamp(),
    }
    fields.setdefault("is_active", F.lit(True))
    fields.update(stamped)
    carried = [c for c in carried if c not in fields]
    return raw.select(*carried, "card_no", *[c.alias(n) for n, c in fields.items()])


def _no_specs() -> dict[str, Column]:
    return {}


# --- P1 price-comparison table ------------------------------------------------
def _comparison_raw(card: Column) -> dict[str, Column]:
    name_cell = H.first(card, "td", "itemName")
    return {
        "_has_name": name_cell.isNotNull(),
        "_name": H.text_of(H.first(name_cell, "strong")),
        "_href": H.attribute(H.attrs_of(H.first(name_cell, "a")), "href"),
        "_price": H.text_of(H.first(card, "td", "priceData")),
        "_cells": H.every(card, "td", "colC"),
        "_shop": H.text_of(H.first(card, "td", "colShop")),
    }


def _comparison_specs() -> dict[str, Column]:
    spans_two = lambda cell: H.attrs_of(cell).rlike(r"(?is)\browspan\s*=\s*[\"']2[\"']")
    return {
        "_wide": F.transform(F.filter("_cells", spans_two), H.text_of),
        "_plain": F.transform(F.filter("_cells", lambda c: ~spans_two(c)), H.text_of),
    }


def _comparison_fields() -> dict[str, Column]:
    base = "https://kakaku.com"
    plain = lambda i: F.coalesce(F.get(F.col("_plain"), i), F.lit(""))
    return {
        "itemCode": F.coalesce(url_tail(F.col("_href")), F.col("_name")),
        "itemName": F.col("_name"),
        "itemUrl": F.coalesce(absolute_url(F.col("_href"), base), F.lit("")),
        "itemPrice": parse_price(F.col("_price"), marks="¥,", strict=True),
        "rank": F.coalesce(F.get(F.col("_wide"), 1), F.lit("")),
        "os": plain(0), "cpu": plain(1), "storage": plain(2), "ram": plain(3), "screen": plain(4),
        "shopName": F.coalesce(shop_name(F.col("_shop")), F.lit("")),
        "listedDate": plain(5),
    }


# --- P2 card list with single and aggregated links ----------------------------
def _recycle_raw(card: Column) -> dict[str, Column]:
    link = H.first(card, "a")
    return {
        "_href": H.attribute(H.attrs_of(link), "href"),
        "_grouped": H.has_class(link, "sys-aggregation-item"),
        "_brand": H.text_of(H.first(link, "p", "sys-maker")),
        "_name": F.coalesce(H.text_of(H.first(link, "p", "sys-name")),
                            H.text_of(H.first(link, "p", "sys-short-name")), F.lit("")),
        "_price": H.text_of(H.first(link, "span", "sys-price")),
        "_rank": H.text_of(H.first(link, "strong", "sys-rank")),
        "_shop": H.text_of(H.first(link, "dd", "sys-handled-shop-name")),
    }


def _recycle_code() -> Column:
    single = F.col("_href").contains("/r/item/") & ~F.col("_grouped")
    return F.when(single, url_tail(F.col("_href"))).otherwise(url_parameter(F.col("_href"), "jan"))


def _recycle_fields() -> dict[str, Column]:
    specs = F.col("_specs")
    return {
        "itemCode": _recycle_code(),
        "itemName": F.col("_name"),
        "itemPrice": parse_price(F.col("_price"), marks=",～", strict=True),
        "itemUrl": absolute_url(F.col("_href"), "https://used.sofmap.com"),
        "shopName": F.coalesce(F.col("_shop"), F.lit("リコレ")),
        "brand": blank_to_null(clean_brand(F.col("_brand"))),
        "condition": F.col("_rank"),
        **{n: specs[n] for n in ("cpu", "memory", "ssd", "hdd", "display_size", "os")},
    }


# --- P3 card list with span texts ----------------------------------------------
def _span_raw(card: Column) -> dict[str, Column]:
    link = H.first(card, "a")
    spans = H.every(link, "span", "subspec")
    strong = let(spans, lambda some: F.flatten(F.transform(some, lambda span: H.every(span, "strong"))))
    priced = F.filter(F.transform(H.every(link, "p"), H.raw_text_of), lambda p: p.contains("￥"))
    sold_out = F.exists(link, lambda t: (t["name"] == "img") & t["attrs"].rlike(rf"(?is)\balt\s*=\s*[\"']{fv.SOLD_OUT}[\"']"))
    return {
        "_href": H.attribute(H.attrs_of(link), "href"),
        "_brand": H.text_of(F.get(strong, 0)),
        "_model": H.text_of(F.get(strong, 1)),
        "_texts": F.transform(spans, H.text_of),
        "_price": F.get(priced, 0),
        "_active": ~sold_out,
    }


def _span_fields() -> dict[str, Column]:
    specs = F.col("_specs")
    href = F.col("_href")
    code = F.coalesce(url_number(href, "item/detail/"), href)
    named = first_non_blank(F.col("_brand"), F.col("_model")).isNotNull()
    words = F.concat(F.coalesce(F.col("_brand"), F.lit("None")), F.lit(" "), F.coalesce(F.col("_model"), F.lit("None")))
    return {
        "itemCode": code,
        "itemName": F.when(named, strip(words)).otherwise(code),
        "itemPrice": parse_price(F.col("_price"), marks="￥,"),
        "itemUrl": F.concat(F.lit("https://www.pcwrap.com/"), F.ltrim(href, F.lit("/"))),
        "shopName": F.lit("PCwrap"),
        "is_active": F.col("_active"),
        "brand": F.col("_brand"),
        "model": F.col("_model"),
        "os": first_with_word(F.col("_texts"), fv.SPAN_OS_WORDS),
        "cpu": first_with_word(F.col("_texts"), fv.SPAN_CPU_WORDS),
        **{n: specs[n] for n in ("memory", "ssd", "hdd", "display_size", "condition")},
    }


# --- P4 card list with specs inside comments ------------------------------------
def _comment_raw(card: Column) -> dict[str, Column]:
    name = H.first(card, "p", "name")
    link = H.first(name, "a")
    blocks = F.filter(H.comments(card), lambda c: c.contains("商品番号") | c.contains("メーカ"))
    return {
        "_title": H.text_of(link),
        "_href": H.attribute(H.attrs_of(link), "href"),
        "_price": H.raw_text_of(H.first(card, "em", "price")),
        "_block": block_specs(H.bare_text(F.get(blocks, 0))),
    }


def _comment_fields() -> dict[str, Column]:
    block, title = F.col("_block"), F.col("_specs")
    href = F.coalesce(F.col("_href"), F.lit(""))
    merged = {n: first_non_blank(block[n], title[n]) for n in ("cpu", "memory", "ssd", "hdd", "os")}
    words = F.concat(F.coalesce(block["series"], F.lit("")), F.lit(" "), F.coalesce(block["model_number"], F.lit("")))
    return {
        "itemCode": F.coalesce(block["product_id"], url_number(href, "/shopdetail/", "/"), href),
        "itemName": F.col("_title"),
        "itemPrice": parse_price(F.col("_price"), marks=","),
        "itemUrl": F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://www.yrl-qualit.com"), href)),
        "shopName": F.lit("Qualit"),
        "brand": block["brand"],
        "model": blank_to_null(strip(words)),
        "cpu_gen": block["cpu_gen"],
        **merged,
        "display_size": title["display_size"],
        "condition": condition_from_title(F.col("_title")),
    }


# --- P5 box list with "label : value" lines --------------------------------------
def _line_raw(card: Column) -> dict[str, Column]:
    shop, link = H.first(card, "div", "zaiko_shop"), H.first(card, "a", attribute="href")
    return {
        "_href": H.attribute(H.attrs_of(link), "href"),
        "_brand": H.text_of(H.first(link, "span", "mfr_tx")),
        "_name": F.coalesce(H.text_of(H.first(link, "div", "item_ti")), F.lit("")),
        "_lines": F.transform(H.every(link, "div", "item_spec1"), H.text_of),
        "_condition": F.coalesce(H.text_of(H.first(card, "li", "evaluation_rating")), F.lit("")),
        "_price": H.raw_text_of(H.first(H.first(card, "div", "price_tx"), "strong")),
        "_shop": H.text_of(H.first(shop, "a")),
    }


def _line_fields() -> dict[str, Column]:
    lines, href = F.col("_lines"), F.col("_href")
    labelled = F.filter(lines, lambda t: t.contains(" : "))
    cut = lambda t: F.instr(t, " : ")
    of = lambda label: F.transform(
        F.filter(labelled, lambda t: strip(F.substring(t, F.lit(1), cut(t) - 1)) == label),
        lambda t: strip(F.substring(t, cut(t) + 3, F.length(t))))
    last = lambda texts: F.try_element_at(texts, F.lit(-1))
    free = F.filter(lines, lambda t: ~t.contains(" : ") & has_any(t, fv.LINE_OS_WORDS))
    return {
        "itemCode": url_number(href, "detail.php?id="),
        "itemName": F.col("_name"),
        "itemPrice": parse_price(F.col("_price"), marks=",円"),
        "itemUrl": F.when(href.startswith("http"), href)
        .otherwise(F.concat(F.lit("https://www.smaphodock24.jp/used/"), href)),
        "shopName": F.coalesce(F.concat(F.lit("PCバル "), F.col("_shop")), F.lit("PCバル")),
        "brand": F.col("_brand"),
        "os": last(free),
        "cpu": last(of("CPU")),
        "memory": last(of("メモリ")),
        "display_size": screen_size(F.col("_name")),
        "condition": condition_grade(F.col("_condition")),
    }


# --- P7 box list of the new/used shop ---------------------------------------------
def _box_raw(card: Column) -> dict[str, Column]:
    link = H.first(card, "a", "product_name")
    return {
        "_name": H.text_of(link),
        "_brand": H.text_of(H.first(card, "span", "brand")),
        "_price": H.text_of(H.first(H.first(card, "span", "price"), "strong")),
        "_href": H.attribute(H.attrs_of(link), "href"),
    }


def _box_price() -> Column:
    before_remark = F.split_part(F.replace(F.col("_price"), F.lit("(税込)"), F.lit("")), F.lit("("), F.lit(1))
    return parse_price(before_remark, marks="¥￥,～", strict=True)


def _box_fields() -> dict[str, Column]:
    href = F.col("_href")
    after = lambda mark: F.split_part(href, F.lit(mark), F.lit(-1))
    return {
        "itemCode": F.when(href.contains("sku="), after("sku="))
        .when(href.contains("new_jan="), F.split_part(after("new_jan="), F.lit("&"), F.lit(1)))
        .otherwise(href),
        "itemName": strip(F.concat_ws(" ", F.col("_name"), F.col("_brand"))),
        "itemPrice": _box_price(),
        "itemUrl": F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://www.sofmap.com"), href)),
        "shopName": F.lit(None).cast("string"),
    }


# --- P8 list with the id in a data attribute ----------------------------------------
def _clip_raw(card: Column) -> dict[str, Column]:
    return {
        "_name": H.text_of(H.first(card, "p", "name")),
        "_price": H.text_of(H.first(card, css_class="price--num")),
        "_clip": H.attribute(H.attrs_of(H.first(card, "span", "link--add--clip")), "data-clip"),
    }


def _clip_fields() -> dict[str, Column]:
    return {
        "itemCode": F.col("_clip"),
        "itemName": F.col("_name"),
        "itemPrice": parse_price(F.col("_price"), marks=",", strict=True),
        "shopName": F.lit(None).cast("string"),
    }


# --- navigation links: the plainest card list -----------------------------------------
def _link_raw(card: Column) -> dict[str, Column]:
    link = H.first(card, "a")
    return {
        "_href": H.attribute(H.attrs_of(link), "href"),
        "_name": H.text_of(link),
    }


def _link_fields() -> dict[str, Column]:
    return {"itemCode": url_tail(F.col("_href")), "itemName": F.col("_name"), "itemUrl": F.col("_href")}


LAYOUTS = {
    "comparison_table": Layout(
        "kakaku", "", lambda page: H.cards_by_tag(page, "tr"), _comparison_raw, _comparison_specs, _comparison_fields,
        lambda: F.col("_has_name") & (F.col("_name") != "")),
    "recycle_list": Layout(
        "sofmap_used", "sofmap_used_notebooks", lambda page: H.cards_in_list(page, "sys-display-item"),
        _recycle_raw, lambda: {"_specs": bracket_specs(F.col("_name"))}, _recycle_fields, lambda: F.col("_href").isNotNull() & _recycle_code().isNotNull()),
    "span_list": Layout(
        "pcwrap", "pcwrap_notebooks", lambda page: H.cards_in_list(page, "list-item"),
        _span_raw, lambda: {"_specs": label_specs(F.col("_texts"))}, _span_fields, lambda: F.col("_href").isNotNull()),
    "comment_list": Layout(
        "qualit", "qualit_notebooks", lambda page: H.cards_in_list(page, "innerList"),
        _comment_raw, lambda: {"_specs": slash_specs(F.col("_title"))}, _comment_fields, lambda: F.col("_title").isNotNull()),
    "line_boxes": Layout(
        "pcbaru", "pcbaru_notebooks", lambda page: H.cards_by_tag(page, "div", "item_box"),
        _line_raw, _no_specs, _line_fields, lambda: url_number(F.col("_href"), "detail.php?id=").isNotNull()),
    "shop_boxes": Layout(
        "sofmap", "sofmap_notebooks", lambda page: H.cards_by_tag(page, "div", "mainbox"),
        _box_raw, _no_specs, _box_fields,
        lambda: F.col("_name").isNotNull() & F.col("_brand").isNotNull()
        & F.col("_href").isNotNull() & _box_price().isNotNull()),
    "clip_list": Layout(
        "pckoubou", "", lambda page: H.cards_by_tag(page, "div", "info-area"), _clip_raw, _no_specs, _clip_fields,
        lambda: F.col("_name").isNotNull() & F.col("_clip").isNotNull()
        & parse_price(F.col("_price"), marks=",", strict=True).isNotNull()),
    "link_list": Layout(
        "links", "", lambda page: H.cards_in_list(page), _link_raw, _no_specs, _link_fields,
        lambda: F.col("_href").isNotNull()),
}


# --- P6 detail page ---------------------------------------------------------------------
def extract_details(pages: DataFrame) -> DataFrame:
    """P6 one row of specs per detail page: JSON-LD sku and the th/td table."""
    carried = [c for c in pages.columns if c != "html"]
    index = pages.select(*carried, json_ld_sku(H.json_ld(F.col("html"))).alias("sku"),
                         H.tag_index(F.col("html")).alias("_page"))
    tables = H.every(F.col("_page"), "table", attribute="id", value="item_tbl_lay")
    rows = F.flatten(F.transform(tables, lambda t: H.cards_by_tag(t, "tr")))
    pairs = F.transform(rows, lambda r: F.struct(
        H.text_of(H.first(r, "th")).alias("label"), H.text_of(H.first(r, "td")).alias("value")))
    useful = F.filter(pairs, lambda p: p["label"].isNotNull() & p["value"].isNotNull()
                      & ~p["value"].isin("－", "-", ""))
    read = index.select(
        *carried, "sku", useful.alias("_pairs"),
        H.text_of(H.first(F.col("_page"), "div", "evaluation_rating")).alias("_condition"))
    value = lambda label: F.try_element_at(F.transform(
        F.filter(F.col("_pairs"), lambda p: p["label"] == label), lambda p: p["value"]), F.lit(-1))
    storage = value("ストレージ")
    size = F.regexp_replace(first_match(storage, r"\d+\s*(?:GB|TB)", 0), r"(?U)\s+", "")
    inches = strip(F.replace(value("ディスプレイ"), F.lit("インチ"), F.lit("")))
    return read.select(
        *carried, "sku",
        value("メーカー").alias("brand"),
        value("型番").alias("model_number"),
        value("CPU").alias("cpu"),
        value("メモリ").alias("memory"),
        storage.alias("storage_raw"),
        F.when(~storage.contains("HDD"), size).alias("ssd"),
        F.when(storage.contains("HDD"), size).alias("hdd"),
        value("OS").alias("os"),
        F.when(inches.rlike(r"^\d+\.?\d*$"), inches).try_cast("double").alias("display_size"),
        value("ディスプレイ解像度").alias("display_resolution"),
        condition_grade(F.col("_condition")).alias("condition"))


# --- P9 hit counts -------------------------------------------------------------------------
# fixed values: cards on a full page of each layout that shows its total
CARDS_PER_PAGE = {"recycle_list": 30, "shop_boxes": 100, "span_list": 16}


def total_hits(html: Column, layout: str) -> Column:
    """P9 number of hits a listing page announces; null when it shows none."""
    shown = {
        "recycle_list": lambda page: H.first(page, "span", "sys-total"),
        "shop_boxes": lambda page: H.first(H.first(page, "p", "pg_number_set"), "span"),
        "span_list": lambda page: H.first(H.first(page, "div", "sort-left"), "b"),
    }[layout]
    return F.replace(H.text_of(let(H.tag_index(html), shown)), F.lit(","), F.lit("")).try_cast("bigint")


def crawl_coverage(pages: DataFrame, layout: str, by: str = "search_query") -> DataFrame:
    """P9 landed pages against the pages the shop announced, per query."""
    per_page = CARDS_PER_PAGE[layout]
    return (
        pages.select(by, total_hits(F.col("html"), layout).alias("_total"))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("pages_landed"), F.max("_total").alias("hits_announced"))
        .withColumn("pages_expected", F.ceil(F.col("hits_announced") / per_page).cast("bigint"))
        .withColumn("pages_missing", F.greatest(F.col("pages_expected") - F.col("pages_landed"), F.lit(0).cast("bigint")))
    )
