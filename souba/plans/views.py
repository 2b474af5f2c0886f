"""The catalogue, history and listings as seen in the driver's tables.

Parts are the products, line items the price observations, suppliers the shops.
Attributes the tables lack (memory, screen size, ...) are computed from part
columns. Each view exists twice: as a DataFrame and as SQL text for the oracle;
the attribute expressions are plain SQL that both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souba.operators.facts import price_fact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRODUCT_ATTRIBUTES = {
    "id": "p_partkey",
    "item_code": "'P' || CAST(p_partkey AS STRING)",
    "item_name": "p_name",
    "item_url": "'https://shop.example.com/item/' || CAST(p_partkey AS STRING)",
    "brand": "CASE p_size % 10 WHEN 0 THEN NULL WHEN 5 THEN '' ELSE p_brand END",
    "model": "p_type",
    "cpu": "'Core i' || CAST(3 + 2 * (p_size % 3) AS STRING) || ' ' || CAST(8000 + 10 * p_size AS STRING) || 'U'",
    "cpu_gen": "CAST(6 + p_size % 7 AS STRING)",
    "memory": "CASE p_size % 5 WHEN 1 THEN '4GB' WHEN 2 THEN '8GB' WHEN 3 THEN '16GB' WHEN 4 THEN '32GB' END",
    "ssd": "CASE p_size % 4 WHEN 1 THEN '128GB' WHEN 2 THEN '256GB' WHEN 3 THEN '1TB' END",
    "hdd": "CASE p_size % 3 WHEN 0 THEN '500GB' WHEN 1 THEN '1TB' END",
    "os": "CASE p_size % 4 WHEN 1 THEN 'Windows 10 Pro' WHEN 2 THEN 'Windows 11 Home 64bit' WHEN 3 THEN 'Windows 7' END",
    "display_size": "CASE p_size % 3 WHEN 1 THEN '13.3インチ' WHEN 2 THEN '15.6インチ' END",
    "is_active": "p_size <= 40",
    "source": "CASE WHEN p_size <= 20 THEN 'kakaku' WHEN p_size <= 45 THEN 'sofmap' END",
}
HISTORY_ATTRIBUTES = {
    "product_id": "l_partkey",
    "item_code": "'P' || CAST(l_partkey AS STRING)",
    "source": "CASE l_returnflag WHEN 'A' THEN 'sofmap' WHEN 'N' THEN 'kakaku' END",
    "price": "CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END",
    "scraped_at": "CAST(l_shipdate AS TIMESTAMP)",
    "order_key": "l_orderkey",
    "line_number": "l_linenumber",
    "shop_key": "l_suppkey",
}


def _select(attributes: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in attributes.items())


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in PRODUCT_ATTRIBUTES.items()])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in HISTORY_ATTRIBUTES.items()])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 observations with their product."""
    return price_fact(history(spark, sf_dir), catalogue(spark, sf_dir))


def with_shop(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS shop_key", "s_name AS shop_name")
    return df.join(shops, "shop_key", "left")


CATALOGUE_SQL = f"(SELECT {_select(PRODUCT_ATTRIBUTES)} FROM part)"
HISTORY_SQL = f"(SELECT {_select(HISTORY_ATTRIBUTES)} FROM lineitem)"
FACT_SQL = f"""(
  SELECT h.product_id, h.item_code, h.price, h.scraped_at, h.order_key, h.line_number, h.shop_key,
         coalesce(h.source, 'rakuten') AS source,
         CASE WHEN c.brand IS NULL OR c.brand = '' THEN 'Unknown' ELSE c.brand END AS brand,
         CASE WHEN c.model IS NULL OR c.model = '' THEN 'Unknown' ELSE c.model END AS model,
         (CASE WHEN c.brand IS NULL OR c.brand = '' THEN 'Unknown' ELSE c.brand END) || ' ' ||
         (CASE WHEN c.model IS NULL OR c.model = '' THEN 'Unknown' ELSE c.model END) AS display_name,
         c.cpu, c.cpu_gen, c.memory, c.ssd, c.hdd, c.os, c.display_size, c.is_active, c.item_name, c.item_url
  FROM {HISTORY_SQL} h LEFT JOIN {CATALOGUE_SQL} c ON c.id = h.product_id)"""
FACT_SHOP_SQL = f"(SELECT f.*, s.s_name AS shop_name FROM {FACT_SQL} f LEFT JOIN supplier s ON s.s_suppkey = f.shop_key)"
