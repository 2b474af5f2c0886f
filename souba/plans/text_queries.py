"""Registered text queries: half-width, specs, brands, prices, URLs, titles, accessory filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from souba import fixed_values as fv
from souba.functions import specs, text, titles
from souba.operators import extraction, noise
from souba.plans.registry import query
from souba.plans.views import table

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_quoted = lambda s: s.replace("'", "''")


# --- H1 ----------------------------------------------------------------------------
@query("fw2hw", f"""
SELECT doc_id, md5(translate(text, '{_quoted(_HALF)}', '{_quoted(_FULL)}')) AS full_md5,
       md5(translate(text, '{_quoted(_FULL)}', '{_quoted(_HALF)}')) AS half_md5, CAST(length(text) AS BIGINT) AS n
FROM documents""")
def fw2hw(spark, sf_dir):
    """H1 whole documents to full width and back."""
    full = text.to_full_width(F.col("text"))
    return (
        table(spark, sf_dir, "documents").select("doc_id", full.alias("full"))
        .select("doc_id", F.md5("full").alias("full_md5"),
                F.md5(text.to_half_width(F.col("full"))).alias("half_md5"),
                F.length(text.to_half_width(F.col("full"))).cast("bigint").alias("n"))
    )


# --- T1: listing text written from part columns, so the right answer is known ---------
# n picks one of the values by a part column; every part gets a listing.
def _pick(column: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {cases} END"


def _words(column: str, *values: str | None) -> str:
    return _pick(column, *["NULL" if v is None else f"'{v}'" for v in values])


_JAPANESE = "p_size % 2 = 0"
_BRAND_TEXT = _words("p_partkey", "Lenovo", "DELL", "hp", "Fujitsu", "panasonic")
_BRAND_TRUE = _words("p_partkey", "Lenovo", "Dell", "HP", "Fujitsu", "Panasonic")
_NUMBER = "CAST(300 + p_size AS STRING)"
_RAM = _words("p_size", "4", "8", "16", "32", "64", "7")
_DISK = _words("p_partkey", "128", "256", "512")
_INCH = _words("p_size", "15.6", "14", "13.3", "9.7")
LISTING_TEXT = f"""CASE WHEN {_JAPANESE} THEN
  'メーカー名：' || {_BRAND_TEXT} || ' 型番：ThinkPad L' || {_NUMBER} || ' CPU インテル® Core™ i7-8550U プロセッサー (1.80GHz〜4.00GHz) '
  || '液晶 ' || {_INCH} || '型 フルHD IPS 液晶 メモリ ' || {_RAM} || 'GB M.2 SSD ' || {_DISK} || 'gb OS Windows 11 Pro 64bit '
  || 'Webカメラ HD 720p Bluetooth 4.1 USB3.0 ×2 USB Type-C x2 重さ：2.0kg 保証期間1年間 光学ドライブ非搭載 テンキー'
ELSE '【中古】 ' || {_BRAND_TEXT} || ' Latitude ' || CAST(5000 + p_size AS STRING) || ' Core i5 8265U RAM: ' || {_RAM}
  || 'GB NVMe SSD' || {_DISK} || 'GB HDD 1TB ' || {_INCH} || '-inch 10th Gen Windows10 Home Bluetooth搭載 Webカメラ搭載 無線LAN '
  || 'WPS Office 2 保証1年間' END"""
_RAM_TRUE = f"CASE WHEN {_RAM} = '7' THEN NULL ELSE {_RAM} || 'GB' END"
_INCH_TRUE = f"CASE {_INCH} WHEN '9.7' THEN NULL WHEN '14' THEN '14.0インチ' ELSE {_INCH} || 'インチ' END"
LISTING_TRUTH = {
    "brand": _BRAND_TRUE,
    "model": f"CASE WHEN {_JAPANESE} THEN 'ThinkPad L' || {_NUMBER} ELSE 'Latitude ' || CAST(5000 + p_size AS STRING) END",
    "os": f"CASE WHEN {_JAPANESE} THEN 'Windows 11 Pro 64bit' ELSE 'Windows10 Home' END",
    "cpu": f"CASE WHEN {_JAPANESE} THEN 'インテル® Core™ i7-8550U プロセッサー (1.80GHz〜4.00GHz)' ELSE 'Core i5 8265U' END",
    "cpu_gen": f"CASE WHEN {_JAPANESE} THEN '8' ELSE '10' END",
    "memory": _RAM_TRUE,
    "ssd": f"{_DISK} || 'GB'",
    "hdd": f"CASE WHEN {_JAPANESE} THEN NULL ELSE '1TB' END",
    "display_size": _INCH_TRUE,
    "weight": f"CASE WHEN {_JAPANESE} THEN '2.0kg' END",
    "bluetooth": f"CASE WHEN {_JAPANESE} THEN 'Bluetooth 4.1' ELSE '搭載' END",
    "webcam": f"CASE WHEN {_JAPANESE} THEN 'HD 720p' ELSE '搭載' END",
    "usb_ports": f"CASE WHEN {_JAPANESE} THEN 'USB3.0×2, USB Type-C搭載' END",
}
OPTIONAL_TRUTH = {
    "resolution": f"CASE WHEN {_JAPANESE} THEN '1920x1080' END",
    "panel_type": f"CASE WHEN {_JAPANESE} THEN 'IPS' END",
    "wireless": f"CASE WHEN {_JAPANESE} THEN NULL ELSE '搭載' END",
    "tenkey": _JAPANESE,
    "optical_drive": f"CASE WHEN {_JAPANESE} THEN 'なし' END",
    "office": f"CASE WHEN {_JAPANESE} THEN NULL ELSE 'WPS Office 2' END",
    "warranty": f"CASE WHEN {_JAPANESE} THEN '1年間' END",
}


def listing_texts(spark, sf_dir):
    """One listing per part; every third text is written in full width."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", "p_name", f"{LISTING_TEXT} AS combined",
        "'P' || CAST(p_partkey AS STRING) AS itemCode", "p_name AS itemName",
        "CAST(floor(p_retailprice) AS BIGINT) AS itemPrice", "'100040' AS genreId", "p_brand AS shopName",
        "true AS is_active", "'2026-02-21T10:00:00+09:00' AS scraped_at", "p_type AS search_query")
    wide = F.when(F.col("p_partkey") % 3 == 0, text.to_full_width(F.col("combined"))).otherwise(F.col("combined"))
    return part.withColumn("combined", wide)


def _truth_sql(fields: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in fields.items())


@query("extract_specs", f"""
SELECT 'P' || CAST(p_partkey AS STRING) AS "itemCode", p_name AS "itemName",
       CAST(floor(p_retailprice) AS BIGINT) AS "itemPrice", '100040' AS "genreId", p_brand AS "shopName",
       true AS is_active, '2026-02-21T10:00:00+09:00' AS scraped_at, p_type AS search_query, {_truth_sql(LISTING_TRUTH)}
FROM part""")
def extract_specs(spark, sf_dir):
    """T1 B1 C9 H2-H11"""
    return extraction.extract_specs(listing_texts(spark, sf_dir))


@query("extract_optional_specs", f"""
SELECT 'P' || CAST(p_partkey AS STRING) AS "itemCode", {_truth_sql(OPTIONAL_TRUTH)} FROM part""")
def extract_optional_specs(spark, sf_dir):
    """H34"""
    found = extraction.extract_specs(listing_texts(spark, sf_dir), optional=True)
    return found.select("itemCode", *OPTIONAL_TRUTH)


@query("fill_rates", " UNION ALL ".join(
    f"SELECT '{name}' AS field, count({expr}) AS filled, count(*) AS total, "
    f"round(count({expr}) / CAST(count(*) AS DOUBLE), 6) AS fill_rate FROM part"
    for name, expr in LISTING_TRUTH.items()))
def fill_rates(spark, sf_dir):
    """D16"""
    rates = extraction.fill_rates(extraction.extract_specs(listing_texts(spark, sf_dir)))
    return rates.withColumn("fill_rate", F.round("fill_rate", 6))


_WITH_SPECS = ("coalesce(text, '') || CASE WHEN doc_id % 4 = 1 THEN ' 8th gen' ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN ' 13.3-inch' ELSE '' END"
               " || CASE WHEN doc_id % 3 = 0 THEN ' bluetooth' ELSE '' END")


@query("extract_specs_documents", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)Bluetooth') THEN '搭載' END AS bluetooth,
       nullif(regexp_extract(text, '(?i)(\d+)(?:st|nd|rd|th)\s*gen', 1), '') AS gen_english,
       nullif(regexp_extract(text, '(?i)(\d+(?:\.\d+)?)-inch', 1), '') AS inches
FROM (SELECT doc_id, """ + _WITH_SPECS + r""" AS text FROM documents)""")
def extract_specs_documents(spark, sf_dir):
    """H6 H9 H10 single extractors over whole free-text documents, to which spec words are added now and then."""
    body = text.to_half_width(F.col("text"))
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_WITH_SPECS} AS text").select(
        "doc_id", specs.bluetooth(body).alias("bluetooth"),
        text.first_match(body, fv.GENERATION_ENGLISH, flags=text.ANY_CASE).alias("gen_english"),
        text.first_match(body, fv.DISPLAY[2], flags=text.ANY_CASE).alias("inches"))


# --- H11 H12 ---------------------------------------------------------------------------
_RAW_BRANDS = ["LENOVO", "dell", "Hp", "fujitsu", "Panasonic", "lenvo", "Panasonik", "Toshba", "Brand#1", "Acer"]
_KNOWN_BRANDS = ["Lenovo", "Dell", "HP", "Fujitsu", "Panasonic", "Lenovo", "Panasonic", "Toshiba", "Brand#1", "Acer"]


@query("normalize_brand", f"""
SELECT p_partkey, {_words('p_size', *_RAW_BRANDS)} AS raw, {_words('p_size', *_KNOWN_BRANDS)} AS brand FROM part""")
def normalize_brand(spark, sf_dir):
    """H11 exact and fuzzy"""
    raw = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_words('p_size', *_RAW_BRANDS)} AS raw")
    return specs.with_brand(raw, "raw")


_SHOP_LABELS = ["Lenovo(レノボジャパン)", "FUJITSU(富士通)", "DELL(デル)", "hp(エイチピー)", "VAIO（バイオ）",
                "その他メーカー", "MSI(エムエスアイ)", "日本電気(NEC)"]
_SHOP_BRANDS = ["Lenovo", "Fujitsu", "Dell", "HP", "VAIO", "", "MSI", "NEC"]


@query("clean_brand", f"""
SELECT p_partkey, {_words('p_size', *_SHOP_LABELS)} AS label, {_words('p_size', *_SHOP_BRANDS)} AS brand FROM part""")
def clean_brand(spark, sf_dir):
    """H12"""
    labels = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_words('p_size', *_SHOP_LABELS)} AS label")
    return labels.withColumn("brand", text.clean_brand(F.col("label")))


# --- H14-H16 --------------------------------------------------------------------------------
_YEN = "CAST(floor(l_extendedprice) AS BIGINT)"


@query("parse_price", f"""
SELECT l_orderkey, l_linenumber, {_YEN} AS loose, CASE WHEN l_linenumber % 4 = 2 THEN -1 ELSE {_YEN} END AS strict
FROM lineitem""")
def parse_price(spark, sf_dir):
    """H14 four ways of writing a price"""
    amount = F.format_number(F.floor("l_extendedprice"), 0)
    kind = F.col("l_linenumber") % 4
    written = (
        F.when(kind == 0, F.concat(F.lit("¥"), amount, F.lit("(税込)")))
        .when(kind == 1, F.concat(F.lit("￥"), amount))
        .when(kind == 2, F.concat(F.lit("販売価格 "), amount, F.lit("円（税込）")))
        .otherwise(F.concat(F.lit(" "), amount, F.lit("円～ "))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("w"))
    bare = F.replace("w", F.lit("(税込)"), F.lit(""))
    return rows.select(
        "l_orderkey", "l_linenumber", text.parse_price(F.col("w")).alias("loose"),
        F.coalesce(text.parse_price(bare, strict=True), F.lit(-1)).alias("strict"))


@query("url_ids", r"""
SELECT page_id, nullif(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '') AS tail,
       nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
       nullif(regexp_extract(url, '/en/(\d+)', 1), '') AS english_number,
       'https://site.example.com' || regexp_replace(url, '^https?://[^/]*', '') AS absolute
FROM pages""")
def url_ids(spark, sf_dir):
    """H15 H16"""
    relative = F.regexp_replace("url", "^https?://[^/]*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.url_tail(F.col("url")).alias("tail"), text.url_parameter(F.col("url"), "page").alias("page"),
        text.url_number(F.col("url"), "/en/").alias("english_number"),
        text.absolute_url(relative, "https://site.example.com").alias("absolute"))


# --- H18 H19 H22-H25 ----------------------------------------------------------------------------
_BRACKET_TITLE = f"""'Note ' || p_name || ' ［Core-i5-10210U (1.6GHz)／' || {_RAM} || 'GB／'
  || CASE WHEN p_size % 3 = 0 THEN 'HDD1TB' ELSE 'SSD' || {_DISK} || 'GB' END
  || CASE WHEN p_size % 5 = 0 THEN '' ELSE '／' || {_INCH} || 'インチワイド' END || '／Windows11 Home(64ビット)］'"""


@query("bracket_specs", f"""
SELECT p_partkey, 'Core-i5-10210U' AS cpu, {_RAM} || 'GB' AS memory,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE {_DISK} || 'GB' END AS ssd, CASE WHEN p_size % 3 = 0 THEN '1TB' END AS hdd,
       CASE WHEN p_size % 5 = 0 THEN -1.0::DOUBLE ELSE CAST({_INCH} AS DOUBLE) END AS display_size, 'Windows11 Home(64ビット)' AS os
FROM part""")
def bracket_specs(spark, sf_dir):
    """H18"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_BRACKET_TITLE} AS title")
    read = rows.select("p_partkey", titles.bracket_specs(F.col("title")).alias("s")).select("p_partkey", "s.*")
    return read.withColumn("display_size", F.coalesce("display_size", F.lit(-1.0)))


_SLASH_TITLE = f"""'HP ProBook ' || {_NUMBER} || '(Win11x64)  中古 Core i7-2.8GHz(1165G7)/'
  || CASE WHEN p_size % 2 = 0 THEN 'メモリ' ELSE '' END || {_RAM} || 'GB/'
  || CASE WHEN p_size % 3 = 0 THEN 'HDD1TB' ELSE 'SSD' || {_DISK} || 'GB' END || '/フルHD' || {_INCH}
  || CASE WHEN p_size % 2 = 0 THEN 'インチ' ELSE '' END || '/Webカメラ '
  || {_words('p_size', '[A:美品]', '[C:並品]', '[訳あり品]', '[バリュー品]', '[new]')}"""


@query("slash_specs", f"""
SELECT p_partkey, 'Win11x64' AS os, 'Core i7-2.8GHz(1165G7)' AS cpu, {_RAM} || 'GB' AS memory,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE {_DISK} || 'GB' END AS ssd, CASE WHEN p_size % 3 = 0 THEN '1TB' END AS hdd,
       CASE WHEN {_INCH} = '9.7' THEN -1.0::DOUBLE ELSE CAST({_INCH} AS DOUBLE) END AS display_size
FROM part""")
def slash_specs(spark, sf_dir):
    """H19"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SLASH_TITLE} AS title")
    read = rows.select("p_partkey", titles.slash_specs(F.col("title")).alias("s")).select("p_partkey", "s.*")
    return read.withColumn("display_size", F.coalesce("display_size", F.lit(-1.0)))


_PHRASES = list(fv.CONDITION_GRADES) + ["  使用感あるが良い状態 ", "その他の状態", "   "]
_GRADES = list(fv.CONDITION_GRADES.values()) + ["B", "その他の状態", None]


@query("condition_grade", f"""
SELECT p_partkey, {_words('p_partkey', *_GRADES)} AS grade,
       {_words('p_size', 'A', 'C', 'Junk', 'Value', None)} AS title_grade FROM part""")
def condition_grade(spark, sf_dir):
    """H22 H23"""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_words('p_partkey', *_PHRASES)} AS phrase", f"{_SLASH_TITLE} AS title")
    return rows.select("p_partkey", text.condition_grade(F.col("phrase")).alias("grade"),
                       text.condition_from_title(F.col("title")).alias("title_grade"))


@query("screen_size", f"""
SELECT p_partkey, CAST({_words('p_size', '15.6', '13', '12.1', '-1', '-1')} AS DOUBLE) AS inches FROM part""")
def screen_size(spark, sf_dir):
    """H24"""
    title = _words("p_size", "ノート 15.6インチ 8GB", "Lets note 13 Inch", "ThinkPad 12.1 Core", "monitor 27.0インチ", "no size")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{title} AS title")
    return rows.select("p_partkey", F.coalesce(text.screen_size(F.col("title")), F.lit(-1.0)).alias("inches"))


@query("json_ld_sku", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'S' || CAST(p_partkey AS STRING) WHEN 1 THEN '' WHEN 2 THEN NULL
       ELSE 'S' || CAST(p_partkey AS STRING) END AS sku
FROM part""")
def json_ld_sku(spark, sf_dir):
    """H25 first product block wins; bad JSON and other types are passed over"""
    product = """'{"@type": "Product", "sku": "S' || CAST(p_partkey AS STRING) || '"}'"""
    blocks = _pick("p_size", f"array({product})", """array('{"@type": "Product"}')""",
                   """array('{"@type": "Organization", "sku": "X"}', '{bad')""",
                   f"""array('{{bad', '{{"@type": "Offer"}}', {product}, '{{"@type": "Product", "sku": "later"}}')""")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{blocks} AS blocks")
    return rows.select("p_partkey", text.json_ld_sku(F.col("blocks")).alias("sku"))


# --- H13 T2 D22 -----------------------------------------------------------------------------------
_TITLE = _pick("p_size", "'【中古】 Lenovo thinkpad L' || CAST(300 + p_size AS STRING) || ' Core i5'",
               "'DELL LATITUDE e5' || CAST(400 + p_size AS STRING) || ' Windows10'", "'Lenovo ideapad Slim3 14IRH10'",
               "'DELL Inspiron 15 3000 Series'", "'Lenovo ThinkPad X1 carbon Gen 8'", "'HP EliteBook 840 ' || p_name", "NULL")
_TITLE_MODEL = _pick("p_size", "'ThinkPad L' || CAST(300 + p_size AS STRING)",
                     "'Latitude E5' || CAST(400 + p_size AS STRING)", "'IdeaPad Slim3'", "'Inspiron 15'",
                     "'ThinkPad X1 Carbon'", "NULL", "NULL")


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_TITLE} AS item_name", "p_type AS model")


@query("backfill_model", f"SELECT p_partkey AS id, {_TITLE} AS item_name, coalesce({_TITLE_MODEL}, p_type) AS model FROM part")
def backfill_model(spark, sf_dir):
    """H13 T2"""
    return extraction.backfill_models(_titled(spark, sf_dir))


@query("backfill_report", f"""
SELECT count(*) AS products, count({_TITLE_MODEL}) AS matched,
       round(count({_TITLE_MODEL}) * 100.0 / CAST(count(*) AS DOUBLE), 4) AS match_pct FROM part""")
def backfill_report(spark, sf_dir):
    """D22"""
    return extraction.backfill_report(_titled(spark, sf_dir)).withColumn("match_pct", F.round("match_pct", 4))


# --- B6-B8 D15 --------------------------------------------------------------------------------------
_GENRE = _words("p_size", "100040", "552420", "0", None, " 100026 ", "999")
_NAME = _pick("p_partkey", "p_name || ' thinkpad 8GB'", "p_name || ' ACアダプター'", "p_name || ' Let''s Note 充電器'",
              "p_name || ' バッテリー良好'", "p_name || ' ケース'", "p_name", "NULL")
_HAS_NOISE = _words("p_partkey", "f", "t", "t", "f", "t", "f", None)
_HAS_COMPUTER = _words("p_partkey", "t", "f", "t", "f", "f", "f", None)
_SIGNALS_SQL = f"""(SELECT p_partkey, trim(coalesce({_GENRE}, '0')) AS genre, {_HAS_NOISE} = 't' AS noise,
                           {_HAS_COMPUTER} = 't' AS computer FROM part)"""


def _noisy(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_GENRE} AS genreId", f"{_NAME} AS itemName")


@query("noise_filter", f"""
SELECT p_partkey, genre NOT IN ('100040', '100026') AND noise AND computer AS is_uncertain
FROM {_SIGNALS_SQL}
WHERE genre <> '552420' AND (NOT noise OR (genre NOT IN ('100040', '100026') AND noise AND computer))""")
def noise_filter(spark, sf_dir):
    """B7 B8 with the built-in word lists"""
    return noise.filter_computers(_noisy(spark, sf_dir)).select("p_partkey", "is_uncertain")


@query("noise_filter_stats", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE genre = '552420') AS noise_genre_rejected,
       count(*) FILTER (WHERE genre IN ('100040', '100026') AND noise) AS keyword_rejected,
       count(*) FILTER (WHERE genre NOT IN ('100040', '100026', '552420') AND noise AND computer) AS uncertain_kept,
       count(*) FILTER (WHERE genre <> '552420' AND NOT noise) AS clean_kept
FROM {_SIGNALS_SQL}""")
def noise_filter_stats(spark, sf_dir):
    """D15"""
    return noise.filter_report(_noisy(spark, sf_dir))


_DOC_RULES = noise.NoiseRules(noise_keywords=["license", "copyright", "leaux", "und der"], computer_keywords=["the ", "que ", "@"],
                              noise_genres=["src1"], computer_genres=["src0"])
_DOC_NOISE = "regexp_matches(text, '(?i)license|copyright|leaux|und der')"
_DOC_COMPUTER = "regexp_matches(text, '(?i)the |que |@')"


@query("noise_filter_documents", f"""
SELECT doc_id, source, source <> 'src0' AND {_DOC_NOISE} AND {_DOC_COMPUTER} AS is_uncertain FROM documents
WHERE source <> 'src1' AND (NOT {_DOC_NOISE} OR (source <> 'src0' AND {_DOC_NOISE} AND {_DOC_COMPUTER}))""")
def noise_filter_documents(spark, sf_dir):
    """B7 with caller's word lists over whole documents"""
    kept = noise.filter_computers(table(spark, sf_dir, "documents"), _DOC_RULES, name="text", genre="source")
    return kept.select("doc_id", "source", "is_uncertain")


@query("noise_filter_documents_stats", f"""
SELECT lang, count(*) AS total, count(*) FILTER (WHERE source = 'src1') AS noise_genre_rejected,
       count(*) FILTER (WHERE source = 'src0' AND {_DOC_NOISE}) AS keyword_rejected,
       count(*) FILTER (WHERE source NOT IN ('src0', 'src1') AND {_DOC_NOISE} AND {_DOC_COMPUTER}) AS uncertain_kept,
       count(*) FILTER (WHERE source <> 'src1' AND NOT {_DOC_NOISE}) AS clean_kept
FROM documents GROUP BY lang""")
def noise_filter_documents_stats(spark, sf_dir):
    """D15 per language"""
    return noise.filter_report(table(spark, sf_dir, "documents"), _DOC_RULES, name="text", genre="source", by=["lang"])
