"""Registered page queries: landed JSON and HTML to listings.

The driver's ``pages`` are read as they are. Shop pages are written from ``part``,
thirty cards to a page, so that every field of every card has a known answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from souba.functions import html as H
from souba.plans.registry import query
from souba.plans.text_queries import _DISK, _INCH, _RAM, _words
from souba.plans.views import table
from souba.operators import catalog
from souba.sources import html_pages, json_pages

CARDS = 30
_KEY = "CAST(p_partkey AS STRING)"
_NAME = "replace(p_name, ' ', '-') || '-' || " + _KEY
_PRICE = "CAST(floor(p_retailprice * 10) AS BIGINT)"
STAMP = "2026-02-21T10:00:00+09:00"


def _pages(spark, sf_dir, card: str, before: str, after: str):
    """Landed pages of one shop; at most ``CARDS`` cards are gathered per page."""
    rows = table(spark, sf_dir, "part").selectExpr(
        f"CAST(floor(p_partkey / {CARDS}) AS BIGINT) AS page_id", "p_partkey",
        f"format_number({_PRICE}, 0) AS shown", "*").selectExpr("page_id", "p_partkey", f"{card} AS card")
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda c: c["card"]), "\n")
    return rows.groupBy("page_id").agg(F.concat(F.lit(before), page, F.lit(after)).alias("html"))


def _out(df, *columns):
    """Comparable columns; absent sizes and prices as -1."""
    out = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        out.append(F.coalesce(F.col(c), F.lit(-1.0)).alias(c) if kind == "double"
                   else F.coalesce(F.col(c), F.lit(-1)).alias(c) if kind == "bigint" else F.col(c))
    return df.select(*out)


# --- A1 JSON pages -----------------------------------------------------------------
def _json_pages(spark, sf_dir):
    """API answers of 30 hits; the hits lack genre or price now and then, some pages are errors."""
    rows = table(spark, sf_dir, "part").selectExpr(
        f"CAST(floor(p_partkey / {CARDS}) AS BIGINT) AS page_id", "p_partkey",
        f"""named_struct('Item', named_struct('itemName', p_name, 'itemPrice', CASE WHEN p_size = 1 THEN NULL ELSE {_PRICE} END,
              'itemUrl', 'https://shop.example.com/' || {_KEY}, 'itemCaption', p_type, 'shopName', p_brand,
              'genreId', {_words('p_size', '100040', '100026', None)}, 'itemCode', 'P' || {_KEY}, 'unused', 1)) AS hit""")
    hits = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "hit"))), lambda h: h["hit"])
    pages = rows.groupBy("page_id").agg(hits.alias("Items"))
    body = F.when(F.col("page_id") % 7 == 3, F.lit('{"error": "wrong_parameter", "error_description": "page"}')).otherwise(
        F.to_json(F.struct("Items")))
    return pages.select("page_id", body.alias("body"))


@query("json_pages_explode", f"""
SELECT CAST(p_partkey // {CARDS} AS BIGINT) AS page_id, 'P' || CAST(p_partkey AS VARCHAR) AS "itemCode", p_name AS "itemName",
       CASE WHEN p_size = 1 THEN -1 ELSE {_PRICE} END AS "itemPrice", {_words('p_size', '100040', '100026', None)} AS "genreId",
       p_type AS "itemCaption", p_brand AS "shopName"
FROM part WHERE (p_partkey // {CARDS}) % 7 <> 3""")
def json_pages_explode(spark, sf_dir):
    """A1"""
    items = json_pages.explode_items(json_pages.parse_pages(_json_pages(spark, sf_dir)))
    return _out(items, "page_id", "itemCode", "itemName", "itemPrice", "genreId", "itemCaption", "shopName")


@query("genre_filter", f"""
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS "itemCode", p_name || p_type AS combined
FROM part WHERE (p_partkey // {CARDS}) % 7 <> 3 AND p_size % 3 = 0""")
def genre_filter(spark, sf_dir):
    """B1 B6"""
    items = json_pages.computers_only(json_pages.explode_items(json_pages.parse_pages(_json_pages(spark, sf_dir))))
    return items.select("itemCode", json_pages.combined_text(F.col("itemName"), F.col("itemCaption")).alias("combined"))


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    """A1 nested JSON with a fixed schema"""
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


# --- the driver's own pages ------------------------------------------------------------
@query("html_links", r"""
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', '', 'gis') AS html FROM pages),
c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li><a href="[^"]*">[^<]*</a></li>')) AS card FROM n)
SELECT page_id, regexp_extract(card, 'href="([^"]*)"', 1) AS "itemUrl", trim(regexp_extract(card, '>([^<]*)</a>', 1)) AS "itemName"
FROM c""")
def html_links(spark, sf_dir):
    """A2 B17 H16 navigation cards of every page"""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_pages.extract_cards(pages, html_pages.LAYOUTS["link_list"], F.lit(STAMP)).select("page_id", "itemUrl", "itemName")


@query("html_titles", r"""
SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
         '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title,
       CAST(len(regexp_extract_all(html, '(?s)<!--(.*?)-->')) AS BIGINT) AS comments
FROM pages""")
def html_titles(spark, sf_dir):
    """A2 title text and comments of every page"""
    return table(spark, sf_dir, "pages").select(
        "page_id", H.tag_index(F.col("html"), scripts=True).alias("index")).select(
        "page_id", H.text_of(H.first(F.col("index"), "title")).alias("title"),
        F.size(H.comments(F.col("index"))).cast("bigint").alias("comments"))


# --- P1 ------------------------------------------------------------------------------------
_P1 = f"""'<tr data-row="' || {_KEY} || '"><td>no. &#x110000;</td>'
 || '<td class="itemName wide" rowspan="2"><div><div>NEW</div><a href="/used/t/' || {_KEY} || '/p' || {_KEY} || '/"><strong> ' || p_name || ' </strong></a></div></td>'
 || '<td class="priceData" rowspan="2"><b>' || CASE WHEN p_size % 9 = 0 THEN 'ASK' ELSE '¥' || shown END || '</b></td>'
 || '<td class="colC" rowspan="2">first</td><td class="colC" rowspan="2"><i>' || {_words('p_size', 'A', 'B', 'C')} || 'ランク</i></td>'
 || '<td class="colC">Windows 10 Home</td><td class="colC"><span><span>Ryzen</span> 7</span></td><td class="colC">' || {_DISK} || 'GB</td>'
 || '<td class="colC">' || {_RAM} || 'GB</td><td class="colC">12.5インチ</td>'
 || '<td class="colShop"><u>' || p_brand || '</u>' || CASE WHEN p_size % 2 = 0 THEN '（店頭販売有）' ELSE '' END || '</td>'
 || '<td class="colC">25/11/03</td></tr><tr><td>second line</td></tr>'"""


@query("html_table", f"""
SELECT 'p' || {_KEY} AS "itemCode", p_name AS "itemName", 'https://kakaku.com/used/t/' || {_KEY} || '/p' || {_KEY} || '/' AS "itemUrl",
       CASE WHEN p_size % 9 = 0 THEN -1 ELSE {_PRICE} END AS "itemPrice", {_words('p_size', 'A', 'B', 'C')} || 'ランク' AS rank,
       'Windows 10 Home' AS os, 'Ryzen7' AS cpu, {_DISK} || 'GB' AS storage, {_RAM} || 'GB' AS ram, '12.5インチ' AS screen,
       p_brand AS "shopName", '25/11/03' AS "listedDate", 'kakaku' AS source
FROM part""")
def html_table(spark, sf_dir):
    """P1 H17"""
    pages = _pages(spark, sf_dir, _P1, '<table class="tblUsed"><tbody><tr><th>名</th></tr>', "</tbody></table><div><p class=itemName><strong>side</strong></p></div>")
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["comparison_table"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemName", "itemUrl", "itemPrice", "rank", "os", "cpu", "storage", "ram", "screen",
                "shopName", "listedDate", "source")


# --- P2 ------------------------------------------------------------------------------------
_P2_BRAND = "Acer"
_P2 = f"""'<li><a href="' || CASE WHEN p_size % 4 = 0 THEN '/r/item?shown=list&amp;jan=J' || {_KEY} || '&amp;z=1" class="sys-aggregation-item">'
   WHEN p_size % 4 = 1 THEN '/r/item?nothing=1">' ELSE '/r/item/' || {_KEY} || '" target="_blank">' END
 || '<span><strong class="sys-rank">B</strong></span><p class="sys-maker">{_P2_BRAND}(エイサー)</p><p class="sys-name">'
 || p_name || ' &amp; more ［Celeron-N4020 (1.1GHz)／' || {_RAM} || 'GB／SSD' || {_DISK} || 'GB／' || {_INCH} || 'インチワイド／Windows10 Pro］</p>'
 || '<span class="sys-price"><span>' || shown || '</span>～</span>'
 || CASE WHEN p_size % 3 = 0 THEN '' ELSE '<dd class="sys-handled-shop-name">' || p_brand || '</dd>' END || '</a><strong class="sys-rank">Z</strong></li>'"""
_HEAD = '<html><body><ul class="menu"><li><a href="/a">a</a></li></ul><script>var x="<li>";</script>'


@query("html_cards", f"""
SELECT CASE WHEN p_size % 4 = 0 THEN 'J' || {_KEY} ELSE {_KEY} END AS "itemCode",
       p_name || ' & more ［Celeron-N4020 (1.1GHz)／' || {_RAM} || 'GB／SSD' || {_DISK} || 'GB／' || {_INCH} || 'インチワイド／Windows10 Pro］' AS "itemName",
       {_PRICE} AS "itemPrice",
       'https://used.sofmap.com' || CASE WHEN p_size % 4 = 0 THEN '/r/item?shown=list&jan=J' || {_KEY} || '&z=1' ELSE '/r/item/' || {_KEY} END AS "itemUrl",
       CASE WHEN p_size % 3 = 0 THEN 'リコレ' ELSE p_brand END AS "shopName", '{_P2_BRAND}' AS brand, 'B' AS condition,
       'Celeron-N4020' AS cpu, {_RAM} || 'GB' AS memory, {_DISK} || 'GB' AS ssd, CAST({_INCH} AS DOUBLE) AS display_size, 'Windows10 Pro' AS os,
       'sofmap_used_notebooks' AS search_query
FROM part WHERE p_size % 4 <> 1""")
def html_cards(spark, sf_dir):
    """P2 H12 H15 H18; a card whose link names no item is dropped"""
    pages = _pages(spark, sf_dir, _P2, _HEAD + '<div><span class="sys-total">1,448</span></div><ul class="sys-display-item list-block">', "</ul></body></html>")
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["recycle_list"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemName", "itemPrice", "itemUrl", "shopName", "brand", "condition", "cpu", "memory",
                "ssd", "display_size", "os", "search_query")


# --- P3 ------------------------------------------------------------------------------------
_P3 = f"""'<li><a href="/item/detail/' || {_KEY} || '"><span class="subspec"><strong>' || p_brand || '</strong></span>'
 || '<span class="subspec"><strong>' || p_type || '</strong></span><span class="subspec">Linux 6</span>'
 || '<span class="subspec"><span>Xeon</span> E3-1505M</span><span class="subspec">メモリ ' || {_RAM} || 'GB</span>'
 || '<span class="subspec">' || {_words('p_size', 'SSD', 'HDD', 'nvme')} || ' ' || {_DISK} || 'GB</span>'
 || '<span class="subspec">11.6インチ</span><span class="subspec">状態ランク：B</span><p>text</p><p><b>￥' || shown || '</b></p>'
 || CASE WHEN p_size % 5 = 0 THEN '<img src="x" alt="完売しました">' ELSE '' END || '</a><p>￥9</p><img alt="完売しました"></li>'"""


@query("html_span_cards", f"""
SELECT {_KEY} AS "itemCode", p_brand || ' ' || p_type AS "itemName", {_PRICE} AS "itemPrice",
       'https://www.pcwrap.com/item/detail/' || {_KEY} AS "itemUrl", p_size % 5 <> 0 AS is_active, p_brand AS brand, p_type AS model,
       'Linux 6' AS os, 'XeonE3-1505M' AS cpu, {_RAM} || 'GB' AS memory,
       CASE WHEN p_size % 3 <> 1 THEN {_DISK} || 'GB' END AS ssd, CASE WHEN p_size % 3 = 1 THEN {_DISK} || 'GB' END AS hdd,
       11.6::DOUBLE AS display_size, 'B' AS condition
FROM part""")
def html_span_cards(spark, sf_dir):
    """P3 H21 H26"""
    pages = _pages(spark, sf_dir, _P3, _HEAD + '<div class="sort-left"><b>1,248</b>件</div><ul class="list-item">', "</ul></body></html>")
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["span_list"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemName", "itemPrice", "itemUrl", "is_active", "brand", "model", "os", "cpu", "memory",
                "ssd", "hdd", "display_size", "condition")


# --- P4 ------------------------------------------------------------------------------------
_P4 = f"""'<li><p class="name"><a href="https://www.yrl-qualit.com/shopdetail/' || lpad({_KEY}, 12, '0') || '/ct01/">HP '
 || p_type || '(Win10x64) 中古 Core i3-2.4GHz(7100U)/メモリ' || {_RAM} || 'GB/SSD' || {_DISK} || 'GB/フルHD' || {_INCH} || '/LAN [C:並品]</a></p>'
 || '<p><em class="price">' || shown || '</em></p>'
 || CASE WHEN p_size % 3 = 0 THEN '<!-- nothing -->' ELSE '<!-- x --><!--\n商品番号N' || {_KEY} || '\nメーカHP\nシリーズ名'
 || p_type || '\n型名7K' || {_KEY} || '\nOSWindows10 Pro 64bit\nCPUCore i7-1.8GHz (8550U)\nCPU世代第8世代\nメモリ32GB\nストレージ512GB '
 || {_words('p_size', 'SSD', 'HDD')} || '\n-->' END || '</li>'"""


@query("html_comment_specs", f"""
WITH t AS (SELECT *, p_size % 3 <> 0 AS has_block FROM part)
SELECT CASE WHEN has_block THEN 'N' || {_KEY} ELSE lpad({_KEY}, 12, '0') END AS "itemCode", {_PRICE} AS "itemPrice",
       'https://www.yrl-qualit.com/shopdetail/' || lpad({_KEY}, 12, '0') || '/ct01/' AS "itemUrl",
       CASE WHEN has_block THEN 'HP' END AS brand, CASE WHEN has_block THEN p_type || ' 7K' || {_KEY} END AS model,
       CASE WHEN has_block THEN 'Windows10 Pro' ELSE 'Win10x64' END AS os,
       CASE WHEN has_block THEN 'Core i7-1.8GHz (8550U)' ELSE 'Core i3-2.4GHz(7100U)' END AS cpu, CASE WHEN has_block THEN '第8世代' END AS cpu_gen,
       CASE WHEN has_block THEN '32GB' ELSE {_RAM} || 'GB' END AS memory,
       CASE WHEN has_block AND p_size % 2 = 0 THEN '512GB' ELSE {_DISK} || 'GB' END AS ssd,
       CASE WHEN has_block AND p_size % 2 = 1 THEN '512GB' END AS hdd,
       CASE WHEN {_INCH} = '9.7' THEN -1.0::DOUBLE ELSE CAST({_INCH} AS DOUBLE) END AS display_size, 'C' AS condition
FROM t""")
def html_comment_specs(spark, sf_dir):
    """P4 H19 H20 C8 comment block first, title fills the gaps"""
    pages = _pages(spark, sf_dir, _P4, _HEAD + '<div id="r_categoryList"><ul class="innerList">', "</ul></div></body></html>")
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["comment_list"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemPrice", "itemUrl", "brand", "model", "os", "cpu", "cpu_gen", "memory", "ssd", "hdd",
                "display_size", "condition")


# --- P5 ------------------------------------------------------------------------------------
_P5 = f"""'<div class="item_box"><a href="detail.php?id=' || {_KEY} || '&x=2"><span class="mfr_tx">' || p_brand || '</span>'
 || '<div class="item_ti"><div>NEW</div>' || p_name || ' ' || {_INCH} || CASE WHEN p_size % 3 = 0 THEN ' inch' ELSE '' END || ' Core</div>'
 || '<div class="item_spec1">' || p_type || ' laptop</div><div class="item_spec1">Windows 10 Home</div>'
 || '<div class="item_spec1">CPU : AMD Athlon 300U</div>'
 || CASE WHEN p_size % 2 = 0 THEN '' ELSE '<div class="item_spec1">メモリ : ' || {_RAM} || 'GB</div>' END
 || '<ul><li class="evaluation_rating">' || {_words('p_size', '使用感あるが良い状態', '汚れ・劣化あり', '未分類')} || '</li></ul>'
 || '<div class="price_tx"><strong>' || shown || '円</strong></div></a>'
 || CASE WHEN p_size % 7 = 0 THEN '' ELSE '<div class="zaiko_shop"><a href="shop.php">' || p_brand || '店</a></div>' END || '</div>'"""
_BARE_INCH = f"CASE WHEN {_INCH} = '9.7' THEN -1.0::DOUBLE WHEN {_INCH} = '14' AND p_size % 3 <> 0 THEN -1.0::DOUBLE ELSE CAST({_INCH} AS DOUBLE) END"


@query("html_line_boxes", f"""
SELECT {_KEY} AS "itemCode", {_PRICE} AS "itemPrice", 'https://www.smaphodock24.jp/used/detail.php?id=' || {_KEY} || '&x=2' AS "itemUrl",
       CASE WHEN p_size % 7 = 0 THEN 'PCバル' ELSE 'PCバル ' || p_brand || '店' END AS "shopName", p_brand AS brand,
       'Windows 10 Home' AS os, 'AMD Athlon 300U' AS cpu, CASE WHEN p_size % 2 = 0 THEN NULL ELSE {_RAM} || 'GB' END AS memory,
       {_BARE_INCH} AS display_size, {_words('p_size', 'B', 'D', '未分類')} AS condition
FROM part""")
def html_line_boxes(spark, sf_dir):
    """P5 H22 H24"""
    pages = _pages(spark, sf_dir, _P5, "<html><body>", '<div><span class="mfr_tx">side</span><li class="evaluation_rating">未分類</li><div class="price_tx"><strong>1円</strong></div></div></body></html>')
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["line_boxes"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemPrice", "itemUrl", "shopName", "brand", "os", "cpu", "memory", "display_size", "condition")


# --- P6 ------------------------------------------------------------------------------------
_P6 = f"""'<html><head><script type="application/ld+json">{{"@type": "Product", "sku": "S' || {_KEY} || '", "brand": {{"@type": "Brand"}}}}</script></head><body>'
 || '<div class="evaluation_rating">使用感少なくきれいな状態</div><table id="item_tbl_lay"><tbody>'
 || '<tr><th>メーカー</th><td class="lay1"><span>' || p_brand || '</span></td></tr><tr><th>型番</th><td>' || {_words('p_size', 'TP1', '－', '')} || '</td></tr>'
 || '<tr><th>CPU</th><td>Intel Core i5</td></tr><tr><th>メモリ</th><td> ' || {_RAM} || 'GB </td></tr></tbody></table>'
 || '<table id="item_tbl_lay"><tbody><tr><th>ストレージ</th><td>' || {_words('p_size', 'SSD 256GB', 'HDD 1TB')} || '</td></tr>'
 || '<tr><th>OS</th><td>Windows11</td></tr><tr><th>ディスプレイ</th><td>' || {_words('p_size', '13.3', '15.6インチ', '不明')} || '</td></tr>'
 || '<tr><th>ディスプレイ解像度</th><td>1920×1080</td></tr></tbody></table></body></html>'"""


@query("html_detail_kv", f"""
SELECT p_partkey AS page_id, 'S' || {_KEY} AS sku, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN 'TP1' END AS model_number,
       'Intel Core i5' AS cpu, {_RAM} || 'GB' AS memory, {_words('p_size', 'SSD 256GB', 'HDD 1TB')} AS storage_raw,
       CASE WHEN p_size % 2 = 0 THEN '256GB' END AS ssd, CASE WHEN p_size % 2 = 1 THEN '1TB' END AS hdd, 'Windows11' AS os,
       CAST({_words('p_size', '13.3', '15.6', '-1')} AS DOUBLE) AS display_size, '1920×1080' AS display_resolution, 'A' AS condition
FROM part""")
def html_detail_kv(spark, sf_dir):
    """P6 H25"""
    # A part is small and its page is not: without dealing them out anew, few splits of the file make few, long tasks.
    parts = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    pages = parts.selectExpr("p_partkey AS page_id", f"{_P6} AS html")
    return _out(html_pages.extract_details(pages), "page_id", "sku", "brand", "model_number", "cpu", "memory", "storage_raw",
                "ssd", "hdd", "os", "display_size", "display_resolution", "condition")


# --- P7 P8 -----------------------------------------------------------------------------------
_LINK = f"""CASE WHEN p_size % 3 = 0 THEN 'https://www.sofmap.com/product_detail.aspx?sku=' || {_KEY}
  ELSE '/search_result.aspx?type=USED&amp;new_jan=J' || {_KEY} || '&amp;gid=1' END"""
_P7 = f"""'<div class="mainbox"><i>x</i><span class="brand">Sony(ソニー)</span><span class="brand x">no</span>'
 || '<a class="product_name" href="' || {_LINK} || '">' || p_name || '</a><a class="product_name x" href="no">no</a>'
 || '<span class="price"><span>税込</span><strong>' || CASE WHEN p_size % 10 = 0 THEN '価格未定' ELSE '¥' || shown || '<i>(税込)</i>' END || '</strong></span></div>'"""


@query("html_shop_boxes", f"""
SELECT CASE WHEN p_size % 3 = 0 THEN {_KEY} ELSE 'J' || {_KEY} END AS "itemCode", p_name || ' Sony(ソニー)' AS "itemName", {_PRICE} AS "itemPrice",
       CASE WHEN p_size % 3 = 0 THEN 'https://www.sofmap.com/product_detail.aspx?sku=' || {_KEY}
            ELSE 'https://www.sofmap.com/search_result.aspx?type=USED&new_jan=J' || {_KEY} || '&gid=1' END AS "itemUrl"
FROM part WHERE p_size % 10 <> 0""")
def html_shop_boxes(spark, sf_dir):
    """P7 a card without a price is dropped"""
    pages = _pages(spark, sf_dir, _P7, '<p class="pg_number_set">全<span>1,020</span>件</p>', "")
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS["shop_boxes"], F.lit(STAMP))
    return _out(cards, "itemCode", "itemName", "itemPrice", "itemUrl")


_P8 = f"""'<li><div class="info-area"><p class="name">' || p_name || '&nbsp;B級</p><span class="link--add--clip" data-clip="'
 || {_KEY} || '">x</span><em class="price--num"><em><b></b></em><b>' || shown || '</b></em></div></li>'"""


@query("html_clip_list", f"""
SELECT {_KEY} AS "itemCode", p_name || chr(160) || 'B級' AS "itemName", {_PRICE} AS "itemPrice", 'pckoubou' AS source FROM part""")
def html_clip_list(spark, sf_dir):
    """P8"""
    pages = _pages(spark, sf_dir, _P8, "<ul>", "</ul>")
    return _out(html_pages.extract_cards(pages, html_pages.LAYOUTS["clip_list"], F.lit(STAMP)), "itemCode", "itemName", "itemPrice", "source")


# --- P9 F7 -----------------------------------------------------------------------------------
@query("crawl_coverage", f"""
WITH p AS (SELECT DISTINCT p_partkey // {CARDS} AS page_id FROM part),
s AS (SELECT 'q' || CAST(page_id % 3 AS VARCHAR) AS search_query, count(*) AS landed, max(page_id * 40) AS hits FROM p GROUP BY 1)
SELECT search_query, landed AS pages_landed, CAST(hits AS BIGINT) AS hits_announced, CAST(ceil(hits / 30.0) AS BIGINT) AS pages_expected,
       CAST(greatest(ceil(hits / 30.0) - landed, 0) AS BIGINT) AS pages_missing
FROM s""")
def crawl_coverage(spark, sf_dir):
    """P9"""
    rows = _pages(spark, sf_dir, _P2, '<ul class="sys-display-item">', "</ul>")
    total = F.concat(F.lit('<span class="sys-total">'), F.format_number(F.col("page_id") * 40, 0), F.lit("</span>"))
    pages = rows.select(F.concat(F.lit("q"), (F.col("page_id") % 3).cast("string")).alias("search_query"),
                        F.concat(total, F.col("html")).alias("html"))
    return html_pages.crawl_coverage(pages, "recycle_list")


# --- whole way: pages of two shops to one catalogue shape ----------------------------------------
@query("html_to_catalogue", f"""
SELECT 'pcwrap' AS source, {_KEY} AS item_code, p_brand AS brand, {_RAM} || 'GB' AS memory, {_PRICE} AS item_price FROM part
UNION ALL SELECT 'sofmap_used', CASE WHEN p_size % 4 = 0 THEN 'J' || {_KEY} ELSE {_KEY} END, '{_P2_BRAND}', {_RAM} || 'GB', {_PRICE}
FROM part WHERE p_size % 4 <> 1""")
def html_to_catalogue(spark, sf_dir):
    """A2 G1 B3 B4 E1"""
    span = _pages(spark, sf_dir, _P3, '<ul class="list-item">', "</ul>")
    recycle = _pages(spark, sf_dir, _P2, '<ul class="sys-display-item">', "</ul>")
    frames = []
    for pages, layout in ((span, "span_list"), (recycle, "recycle_list")):
        cards = html_pages.extract_cards(pages, html_pages.LAYOUTS[layout], F.lit(STAMP))
        ordered = catalog.keep_first(cards, ["source", "itemCode"], ["search_query", "page_id", "card_no"])
        frames.append(catalog.standardise(ordered, seen_at=F.to_timestamp("scraped_at")))
    return catalog.union_sources(*frames).select("source", "item_code", "brand", "memory", F.col("itemPrice").alias("item_price"))
