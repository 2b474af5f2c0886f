"""Registered catalogue queries: standard shape, dedupe, upsert, retirement, history, sinks.

A run is a stretch of ship dates: line items before ``RUN`` were seen by earlier
runs and make up the catalogue, those from ``RUN`` on are the current batch.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from souba.operators import catalog, facts as facts_op
from souba.plans import jobs
from souba.plans.registry import query
from souba.plans.views import table
from souba.session import shared_dir
from souba.sources import sinks

RUN = "1999-01-01"
_SOURCE = "CASE l_returnflag WHEN 'A' THEN 'sofmap' WHEN 'N' THEN 'kakaku' ELSE 'rakuten' END"
_CODE = "'P' || CAST(l_partkey AS STRING)"
LISTING = {
    "itemCode": _CODE,
    "itemName": "'item ' || CAST(l_partkey AS STRING) || ' of ' || CAST(l_suppkey AS STRING)",
    "itemUrl": f"'https://shop.example.com/' || {_SOURCE} || '/' || CAST(l_partkey AS STRING)",
    "itemPrice": "CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END",
    "shopName": "'shop ' || CAST(l_suppkey AS STRING)",
    "source": _SOURCE,
    "search_query": "l_linestatus",
    "is_active": "true",
    "scraped_at": "CAST(l_shipdate AS TIMESTAMP)",
    "ram": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber * 4 AS STRING) || 'GB' END",
    "storage": "CAST(l_linenumber * 128 AS STRING) || 'GB'",
    "screen": "CASE l_linenumber % 3 WHEN 0 THEN '13インチ' WHEN 1 THEN '15.6インチ' ELSE '不明' END",
    "brand": "CASE WHEN l_tax < 0.02 THEN NULL ELSE 'Brand ' || l_returnflag END",
    "model": "'M' || CAST(l_linenumber AS STRING)",
    "order_key": "l_orderkey",
    "line_number": "l_linenumber",
}
LISTING_SQL = "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in LISTING.items()) + " FROM lineitem)"
ORDER = ["scraped_at", "order_key", "line_number"]
_ORDER_SQL = ", ".join(ORDER)


def listings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in LISTING.items()])


# --- standard shape -------------------------------------------------------------------
def _standard(spark, sf_dir):
    """Each source through its own column changes, then together."""
    rows = listings(spark, sf_dir)
    parts = [catalog.standardise(rows.where(F.col("source") == s), s, F.col("scraped_at"))
             for s in ("rakuten", "kakaku", "sofmap")]
    return catalog.union_sources(*parts)


_STANDARD_SQL = f"""(
SELECT "itemCode" AS item_code, source, "itemName" AS item_name, "itemUrl" AS item_url, "shopName" AS shop_name, search_query,
       CASE source WHEN 'rakuten' THEN NULL ELSE brand END AS brand,
       CASE source WHEN 'sofmap' THEN model ELSE search_query END AS model,
       CASE source WHEN 'kakaku' THEN ram END AS memory, CASE source WHEN 'kakaku' THEN storage END AS ssd,
       CASE WHEN source = 'kakaku' THEN TRY_CAST(replace(screen, 'インチ', '') AS DOUBLE) END AS display_size,
       is_active, strftime(scraped_at, '%Y-%m-%d') AS last_seen_at, "itemPrice" AS item_price,
       CASE source WHEN 'rakuten' THEN brand END AS brand_extracted,
       CASE source WHEN 'rakuten' THEN model END AS model_extracted
FROM {LISTING_SQL})"""


@query("ingest_standardise", f"""
SELECT * REPLACE (coalesce(display_size, -1.0::DOUBLE) AS display_size, coalesce(item_price, -1) AS item_price) FROM {_STANDARD_SQL}""")
def ingest_standardise(spark, sf_dir):
    """B2 B3 B4 B5"""
    rows = _standard(spark, sf_dir).drop("scraped_at").withColumnRenamed("itemPrice", "item_price")
    return rows.withColumns({
        "display_size": F.coalesce("display_size", F.lit(-1.0)), "item_price": F.coalesce("item_price", F.lit(-1)),
        "last_seen_at": F.date_format("last_seen_at", "yyyy-MM-dd")})


@query("union_sources", f"""
SELECT source, count(*) AS listings, count(brand) AS with_brand, count(memory) AS with_memory,
       count(display_size) AS with_size, count(brand_extracted) AS with_extracted FROM {_STANDARD_SQL} GROUP BY source""")
def union_sources(spark, sf_dir):
    """G1"""
    return _standard(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.count("brand").alias("with_brand"), F.count("memory").alias("with_memory"),
        F.count("display_size").alias("with_size"), F.count("brand_extracted").alias("with_extracted"))


@query("dedupe_first", f"""
SELECT source, "itemCode" AS item_code, order_key, line_number, "itemName" AS item_name FROM (
  SELECT *, row_number() OVER (PARTITION BY source, "itemCode" ORDER BY {_ORDER_SQL}) AS rn FROM {LISTING_SQL})
WHERE rn = 1""")
def dedupe_first(spark, sf_dir):
    """E1"""
    rows = listings(spark, sf_dir).select("source", F.col("itemCode").alias("item_code"), *ORDER,
                                          F.col("itemName").alias("item_name"))
    return catalog.keep_first(rows, ["source", "item_code"], ORDER).drop("scraped_at")


# --- catalogue writes --------------------------------------------------------------------
def _snapshot(rows, order):
    """Catalogue rows of a stretch of listings, one per key."""
    rows = rows.selectExpr("source", "itemCode AS item_code", "itemName AS item_name", "itemUrl AS item_url", "brand",
                           "ram AS memory", "is_active", *ORDER)
    return catalog.keep_first(rows, ["source", "item_code"], order)


def _current(spark, sf_dir):
    before = listings(spark, sf_dir).where(F.col("scraped_at") < F.lit(RUN).cast("timestamp"))
    rows = _snapshot(before, [F.desc(c) for c in ORDER])
    return rows.withColumn("weight", F.lit("2.0kg")).withColumnRenamed("scraped_at", "last_seen_at").drop("order_key", "line_number")


def _batch(spark, sf_dir):
    since = listings(spark, sf_dir).where(F.col("scraped_at") >= F.lit(RUN).cast("timestamp"))
    return _snapshot(since, ORDER).withColumnRenamed("scraped_at", "last_seen_at").drop("order_key", "line_number")


def _pick_sql(condition: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ORDER)
    return f"""(SELECT source, "itemCode" AS item_code, "itemName" AS item_name, "itemUrl" AS item_url, brand, ram AS memory,
                       is_active, scraped_at AS last_seen_at FROM (
      SELECT *, row_number() OVER (PARTITION BY source, "itemCode" ORDER BY {order}) AS rn
      FROM {LISTING_SQL} WHERE {condition}) WHERE rn = 1)"""


_CURRENT_SQL = _pick_sql(f"scraped_at < TIMESTAMP '{RUN}'", "DESC")
_BATCH_SQL = _pick_sql(f"scraped_at >= TIMESTAMP '{RUN}'", "ASC")


@query("upsert_products", f"""
SELECT source, item_code, CASE WHEN b.is_active THEN b.item_name ELSE c.item_name END AS item_name,
       CASE WHEN b.is_active THEN b.brand ELSE c.brand END AS brand,
       CASE WHEN b.is_active THEN b.memory ELSE c.memory END AS memory,
       CASE WHEN c.is_active THEN '2.0kg' END AS weight,
       strftime(coalesce(b.last_seen_at, c.last_seen_at), '%Y-%m-%d') AS last_seen_at
FROM {_CURRENT_SQL} c FULL JOIN {_BATCH_SQL} b USING (source, item_code)""")
def upsert_products(spark, sf_dir):
    """A6 nulls of the batch overwrite, columns it lacks stay"""
    merged = catalog.upsert_products(_current(spark, sf_dir), _batch(spark, sf_dir))
    return merged.select("source", "item_code", "item_name", "brand", "memory", "weight",
                         F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen_at"))


@query("deactivate_unseen", f"""
SELECT source, item_code, NOT (source IN ('kakaku', 'sofmap') AND b.is_active IS NULL) AS is_active
FROM {_CURRENT_SQL} c LEFT JOIN {_BATCH_SQL} b USING (source, item_code)""")
def deactivate_unseen(spark, sf_dir):
    """C5 G3 a run over two of the three sources"""
    ran = ["kakaku", "sofmap"]
    seen = _batch(spark, sf_dir).where(F.col("source").isin(ran))
    return catalog.deactivate_unseen(_current(spark, sf_dir), seen, ran).select("source", "item_code", "is_active")


@query("append_new_by_url", f"""
SELECT item_url, item_name FROM {_BATCH_SQL} b WHERE NOT EXISTS (SELECT 1 FROM {_CURRENT_SQL} c WHERE c.item_url = b.item_url)""")
def append_new_by_url(spark, sf_dir):
    """C6"""
    batch = listings(spark, sf_dir).where(F.col("scraped_at") >= F.lit(RUN).cast("timestamp"))
    batch = batch.select(F.col("itemUrl").alias("item_url"), F.col("itemName").alias("item_name"), *ORDER)
    return catalog.new_by_url(_current(spark, sf_dir), batch, ORDER).select("item_url", "item_name")


@query("run_counters", f"""
WITH b AS (SELECT source, "itemUrl" AS item_url FROM {LISTING_SQL} WHERE scraped_at >= TIMESTAMP '{RUN}')
SELECT source, count(*) AS items_scraped,
       count(DISTINCT item_url) FILTER (WHERE item_url NOT IN (SELECT item_url FROM {_CURRENT_SQL})) AS items_new
FROM b GROUP BY source""")
def run_counters(spark, sf_dir):
    """D23"""
    batch = listings(spark, sf_dir).where(F.col("scraped_at") >= F.lit(RUN).cast("timestamp"))
    return catalog.run_counters(_current(spark, sf_dir), batch.select("source", F.col("itemUrl").alias("item_url")))


_KNOWN = "CASE WHEN p_size <= 15 THEN 'kakaku' WHEN p_size <= 30 THEN 'sofmap' ELSE 'rakuten' END"


@query("price_observations", f"""
SELECT p.p_partkey AS product_id, l."itemCode" AS item_code, l.source, l."itemPrice" AS price,
       strftime(l.scraped_at, '%Y-%m-%d') AS scraped_at, l.search_query
FROM {LISTING_SQL} l JOIN (SELECT *, {_KNOWN} AS source FROM part) p
  ON p.source = l.source AND 'P' || CAST(p.p_partkey AS STRING) = l."itemCode"
WHERE l."itemPrice" IS NOT NULL""")
def price_observations(spark, sf_dir):
    """A7 C3 the same code at another source is another product"""
    products = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", f"{_KNOWN} AS source", "'P' || CAST(p_partkey AS STRING) AS item_code")
    batch = listings(spark, sf_dir).withColumnRenamed("itemCode", "item_code")
    rows = catalog.price_observations(batch, products)
    return rows.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd"))


@query("enrich_detail", """
SELECT p_partkey AS page_id, CASE p_size % 3 WHEN 0 THEN 'P' || CAST(p_partkey AS STRING) WHEN 1 THEN 'SKU' || CAST(p_partkey AS STRING)
         ELSE 'P' || CAST(p_partkey AS STRING) END AS "itemCode",
       CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'detail cpu' ELSE 'list cpu' END AS cpu,
       CASE WHEN p_size % 5 = 0 AND p_size % 3 <> 0 THEN '32GB' ELSE '8GB' END AS memory,
       CASE WHEN p_size % 3 <> 0 THEN p_type END AS model,
       CASE WHEN p_size % 3 <> 0 AND p_size % 4 = 1 THEN 13.3::DOUBLE ELSE 15.6::DOUBLE END AS display_size
FROM part""")
def enrich_detail(spark, sf_dir):
    """C7 a third of the listings has no detail page; blank details do not win"""
    part = table(spark, sf_dir, "part")
    rows = part.selectExpr("p_partkey AS page_id", "'P' || CAST(p_partkey AS STRING) AS itemCode", "'list cpu' AS cpu",
                           "'8GB' AS memory", "CAST(NULL AS STRING) AS model", "15.6D AS display_size")
    details = part.where("p_size % 3 <> 0").selectExpr(
        "p_partkey AS page_id", "CASE p_size % 3 WHEN 1 THEN 'SKU' || CAST(p_partkey AS STRING) ELSE '' END AS sku",
        "CASE WHEN p_size % 2 = 0 THEN 'detail cpu' ELSE '' END AS cpu",
        "CASE WHEN p_size % 5 = 0 THEN '32GB' END AS memory", "p_type AS model_number",
        "CASE p_size % 4 WHEN 1 THEN 13.3D WHEN 2 THEN 0D END AS display_size")
    return catalog.enrich_details(rows, details, "page_id")


_BROKEN = {
    "itemCode": "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE 'P' || CAST(l_partkey AS STRING) END",
    "itemName": "CASE WHEN l_quantity = 3 THEN NULL ELSE 'item' END",
    "itemUrl": "CASE WHEN l_quantity < 5 THEN 'http://x' ELSE 'https://x' END",
    "itemPrice": "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END",
    "shopName": "'shop'", "source": _SOURCE, "search_query": "CASE WHEN l_quantity = 7 THEN NULL ELSE 'q' END",
    "is_active": "true",
    "scraped_at": "CASE WHEN l_linenumber = 4 THEN '2026-02-21T10:00:00Z' ELSE '2026-02-21T10:00:00+09:00' END",
}
_BROKEN_SQL = "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _BROKEN.items()) + " FROM lineitem)"


@query("contract_report", f"""
SELECT source, count(*) AS listings, count(*) FILTER (WHERE "itemCode" IS NULL) AS "null_itemCode",
       count(*) FILTER (WHERE "itemName" IS NULL) AS "null_itemName", count(*) FILTER (WHERE "itemUrl" IS NULL) AS "null_itemUrl",
       count(*) FILTER (WHERE "shopName" IS NULL) AS "null_shopName",
       count(*) FILTER (WHERE search_query IS NULL) AS null_search_query,
       count(*) FILTER (WHERE is_active IS NULL) AS null_is_active, count(*) FILTER (WHERE scraped_at IS NULL) AS null_scraped_at,
       count(*) FILTER (WHERE trim("itemCode") = '') AS blank_code, count(*) FILTER (WHERE "itemUrl" NOT LIKE 'https://%') AS url_not_https,
       count(*) FILTER (WHERE scraped_at NOT LIKE '%+09:00%') AS not_jst,
       count(*) FILTER (WHERE "itemPrice" IS NOT NULL AND coalesce(trim("itemCode"), '') = '') AS priced_without_code
FROM {_BROKEN_SQL} GROUP BY source""")
def contract_report(spark, sf_dir):
    """B18"""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _BROKEN.items()])
    return catalog.contract_report(rows)


# --- sinks ------------------------------------------------------------------------------------
_SINK_SQL = f"""
SELECT source, "itemCode" AS item_code, "itemName" AS item_name, coalesce("itemPrice", -1) AS price, brand,
       order_key, line_number FROM {LISTING_SQL}"""


def _sink_rows(spark, sf_dir):
    return listings(spark, sf_dir).select("source", F.col("itemCode").alias("item_code"), F.col("itemName").alias("item_name"),
                                          F.col("itemPrice").alias("price"), "brand", "order_key", "line_number")


def _roundtrip(spark, sf_dir, write, read):
    rows = _sink_rows(spark, sf_dir)
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    write(rows, path)
    back = read(spark.read.schema(rows.schema), path)
    return back.withColumn("price", F.coalesce("price", F.lit(-1)))


@query("sink_parquet_roundtrip", _SINK_SQL)
def sink_parquet_roundtrip(spark, sf_dir):
    """A10"""
    return _roundtrip(spark, sf_dir, sinks.write_parquet, lambda r, p: r.parquet(p))


@query("sink_csv_roundtrip", _SINK_SQL)
def sink_csv_roundtrip(spark, sf_dir):
    """A9"""
    return _roundtrip(spark, sf_dir, sinks.write_csv, lambda r, p: r.option("header", True).csv(p))


@query("sink_json_roundtrip", _SINK_SQL)
def sink_json_roundtrip(spark, sf_dir):
    """A11"""
    return _roundtrip(spark, sf_dir, sinks.write_json, lambda r, p: r.json(p))


@query("history_partitions", f"""
SELECT strftime(scraped_at, '%Y-%m-%d') AS obs_date, count(*) AS n, CAST(sum("itemPrice") AS BIGINT) AS total
FROM {LISTING_SQL} WHERE "itemPrice" IS NOT NULL
  AND scraped_at >= TIMESTAMP '1998-01-01' AND scraped_at < TIMESTAMP '1998-03-01' GROUP BY 1""")
def history_partitions(spark, sf_dir):
    """A7 B9 append the history in month folders; reading two months opens only theirs"""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    rows = listings(spark, sf_dir).where("itemPrice IS NOT NULL").select(
        F.col("itemCode").alias("product_id"), F.col("itemCode").alias("item_code"), "source",
        F.col("itemPrice").alias("price"), "scraped_at", "search_query")
    sinks.append_history(rows, path, unit="month")
    back = sinks.read_history(spark, path).where("obs_date >= DATE '1998-01-01' AND obs_date < DATE '1998-03-01'")
    return back.groupBy(F.date_format("scraped_at", "yyyy-MM-dd").alias("obs_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


# --- two nightly runs ----------------------------------------------------------------------------
_SHOP = "CASE WHEN p_size <= 20 THEN 'sofmap' WHEN p_size <= 45 THEN 'qualit' ELSE 'pcwrap' END"


@query("catalogue_two_runs", f"""
WITH p AS (SELECT *, {_SHOP} AS source, p_size <= 10 OR p_size > 45 AS again FROM part)
SELECT source, 'P' || CAST(p_partkey AS VARCHAR) AS item_code, CASE WHEN again AND p_size % 3 = 0 THEN NULL ELSE p_brand END AS shop_name,
       source = 'qualit' OR again AS is_active, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS observations,
       CASE WHEN again THEN '2026-02-02' ELSE '2026-02-01' END AS last_seen
FROM p""")
def catalogue_two_runs(spark, sf_dir):
    """A6 A7 C5 two runs written and read back: nulls overwrite, unseen products retire, other sources stay, a repeat counts once"""
    folder = f"{shared_dir(spark)}/two-runs-{uuid.uuid4().hex}"
    base = table(spark, sf_dir, "part").selectExpr(
        "'P' || p_partkey AS itemCode", "p_name AS itemName", "'https://s/' || p_partkey AS itemUrl", "CAST(p_retailprice AS BIGINT) AS itemPrice",
        "p_brand AS shopName", "'q' AS search_query", "true AS is_active", "p_size", f"{_SHOP} AS shop")

    def of(source, rows):
        return rows.where(F.col("shop") == source).drop("shop", "p_size")
    shops = ("sofmap", "qualit", "pcwrap")
    jobs.nightly_run(spark, {s: of(s, base) for s in shops}, f"{folder}/products", f"{folder}/history", dt.datetime(2026, 2, 1))
    second = base.where("p_size <= 10 OR p_size > 45").withColumn("shopName", F.when(F.col("p_size") % 3 != 0, F.col("shopName")))
    for _ in range(2):
        jobs.nightly_run(spark, {s: of(s, second) for s in ("sofmap", "pcwrap")}, f"{folder}/products", f"{folder}/history", dt.datetime(2026, 2, 2), run_id="second")
    seen = sinks.read_history(spark, f"{folder}/history").groupBy("source", "item_code").agg(F.count(F.lit(1)).alias("observations"))
    products = sinks.Snapshots(spark, f"{folder}/products").read(jobs.CATALOGUE)
    return products.join(seen, ["source", "item_code"]).select(
        "source", "item_code", "shop_name", "is_active", "observations", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


# --- typing and contract of what was fetched ---------------------------------------------------------
@query("coerce_fetched", """
SELECT l_orderkey AS order_key, l_linenumber AS line_number, CASE WHEN l_linenumber % 3 <> 1 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price,
       CASE WHEN l_linenumber % 4 <> 2 THEN strftime(date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') END AS seen,
       CASE WHEN l_linenumber % 2 = 0 THEN true END AS active
FROM lineitem""")
def coerce_fetched(spark, sf_dir):
    """B16 strings to types; bad ones become null, stamps with an offset become instants"""
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_key", "l_linenumber AS line_number",
        "CASE WHEN l_linenumber % 3 = 1 THEN '12 yen' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS price",
        "CASE WHEN l_linenumber % 4 = 2 THEN 'soon' ELSE date_format(l_shipdate, 'yyyy-MM-dd') || 'T12:00:00+09:00' END AS scraped_at",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'perhaps' END AS is_active")
    typed = facts_op.coerce(raw, active="is_active")
    return typed.select("order_key", "line_number", "price", F.date_format("scraped_at", "yyyy-MM-dd HH:mm").alias("seen"), F.col("is_active").alias("active"))


@query("contract_without_url", """
SELECT p_brand AS source, count(*) AS listings, count(*) AS null_url, 0::BIGINT AS url_not_https, count(*) FILTER (WHERE p_size = 1) AS null_code
FROM part GROUP BY p_brand""")
def contract_without_url(spark, sf_dir):
    """B18 listings of a shop without links break the rule for it in every row"""
    rows = table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_size <> 1 THEN p_name END AS itemCode", "p_name AS itemName", "1L AS itemPrice", "p_brand AS source", "'q' AS search_query",
        "true AS is_active", "'2026-02-21T10:00:00+09:00' AS scraped_at", "p_type AS shopName")
    return catalog.contract_report(rows).select("source", "listings", F.col("null_itemUrl").alias("null_url"), "url_not_https", F.col("null_itemCode").alias("null_code"))
