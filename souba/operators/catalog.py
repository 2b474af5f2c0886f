"""Product catalogue and price history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from souba.schemas import LISTING_REQUIRED, ORDER_COLUMNS, PRODUCT_COLUMNS, PRODUCT_KEY, PRODUCTS

_CATALOGUE_NAMES = {"itemCode": "item_code", "itemName": "item_name", "itemUrl": "item_url", "shopName": "shop_name"}


# --- standard shape -----------------------------------------------------------
def _comparison_columns(df: DataFrame) -> DataFrame:
    """B5 the price-comparison shop has its own names for three specs."""
    return df.withColumns({
        "model": F.col("search_query"),
        "memory": F.col("ram"),
        "ssd": F.col("storage"),
        "display_size": F.replace(F.col("screen"), F.lit("インチ"), F.lit("")).try_cast("double"),
    })


# Per-source changes before the common renaming. The API shop overwrites brand
# with null and model with the query, one other shop both with null; what was
# read from the text is kept beside them.
def _api_columns(df: DataFrame) -> DataFrame:
    return _keep_extracted(df).withColumns({"brand": F.lit(None).cast("string"), "model": F.col("search_query")})


def _unnamed_columns(df: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return _keep_extracted(df).withColumns({"brand": nothing, "model": nothing})


def _keep_extracted(df: DataFrame) -> DataFrame:
    return df.withColumns({"brand_extracted": F.col("brand"), "model_extracted": F.col("model")})


SOURCE_COLUMNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rakuten": _api_columns,
    "pckoubou": _unnamed_columns,
    "kakaku": _comparison_columns,
}


def standardise(listings: DataFrame, source: str | None = None, seen_at: Column | None = None) -> DataFrame:
    """B2-B5 listings to catalogue columns.

    Adds the source and the time seen, renames, keeps the catalogue columns that
    exist (in their order) plus itemPrice, and drops the rest.
    """
    df = SOURCE_COLUMNS.get(source, lambda d: d)(listings)
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    df = df.withColumnsRenamed(_CATALOGUE_NAMES)
    stamp = seen_at if seen_at is not None else F.current_timestamp()
    df = df.withColumn("last_seen_at", stamp.cast("timestamp"))
    if "display_size" in df.columns and dict(df.dtypes)["display_size"] == "string":
        df = df.withColumn("display_size", F.nullif(
            F.regexp_extract("display_size", r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"))
    extra = [c for c in ("itemPrice", "scraped_at", "brand_extracted", "model_extracted", *ORDER_COLUMNS) if c in df.columns]
    return df.select(*[c for c in PRODUCT_COLUMNS if c in df.columns], *extra)


def union_sources(*frames: DataFrame) -> DataFrame:
    """G1 all rows of all sources; a column a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """E1 first row per key in an explicit order.

    The rank filter is pushed below the shuffle, so each task sends at most one
    row per key and a hot key costs no more than any other.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn <= 1").drop("_rn")


# --- writes as pure snapshots -----------------------------------------------------
def upsert_products(current: DataFrame, batch: DataFrame) -> DataFrame:
    """A6 new snapshot: batch values replace current ones, nulls included.

    Columns the batch does not carry keep their value; products the batch does
    not mention stay. The batch must hold one row per key (``keep_first``).
    """
    cur, new = current.alias("cur"), batch.withColumn("_new", F.lit(True)).alias("new")
    both = cur.join(new, PRODUCT_KEY, "full_outer")
    out = []
    for column in current.columns:
        if column in PRODUCT_KEY:
            out.append(F.col(column))
        elif column in batch.columns:
            out.append(F.when(F.col("new._new"), F.col(f"new.{column}"))
                       .otherwise(F.col(f"cur.{column}")).alias(column))
        else:
            out.append(F.col(f"cur.{column}").alias(column))
    return both.select(*out)


def price_observations(batch: DataFrame, products: DataFrame, price: str = "itemPrice") -> DataFrame:
    """A7 / C3 history rows of a batch: priced and known by (source, item_code)."""
    known = products.select(*PRODUCT_KEY, F.col("id").alias("product_id"))
    return (
        batch.where(F.col(price).isNotNull())
        .join(known, PRODUCT_KEY, "inner")
        .select("product_id", "item_code", "source", F.col(price).cast("bigint").alias("price"),
                "scraped_at", "search_query")
    )


def deactivate_unseen(current: DataFrame, seen: DataFrame, sources: list[str]) -> DataFrame:
    """C5 / G3 products of the run's sources that the run did not see become inactive.

    ``seen`` is the union of all queries of the run; its keys shrink on the map
    side before anything moves. Products of other sources are left alone.
    """
    keys = seen.select(*PRODUCT_KEY).distinct().withColumn("_seen", F.lit(True))
    unseen = F.col("source").isin(sources) & F.col("_seen").isNull()
    return (
        current.join(keys, PRODUCT_KEY, "left")
        .withColumn("is_active", F.when(unseen, F.lit(False)).otherwise(F.col("is_active")))
        .select(*current.columns)
    )


def deactivate_stale(current: DataFrame, sources: list[str], run_start: Column) -> DataFrame:
    """C5 for catalogues that runs stamp: last seen before the run means not seen by it. No join."""
    stale = F.col("source").isin(sources) & (F.col("last_seen_at") < run_start)
    return current.withColumn("is_active", F.when(stale, F.lit(False)).otherwise(F.col("is_active")))


def new_by_url(catalogue: DataFrame, batch: DataFrame, order: list[str | Column], url: str = "item_url") -> DataFrame:
    """C6 rows of a batch whose URL is not in the catalogue; a repeated URL counts once."""
    return keep_first(batch, [url], order).join(catalogue.select(url), url, "left_anti")


def run_counters(catalogue: DataFrame, batch: DataFrame, url: str = "item_url") -> DataFrame:
    """D23 items scraped and items new, in total and per source."""
    per_url = batch.groupBy("source", url).agg(F.count(F.lit(1)).alias("_n"))
    known = catalogue.select(url).distinct().withColumn("_known", F.lit(True))
    per_source = (
        per_url.join(known, url, "left").groupBy("source")
        .agg(F.sum("_n").alias("items_scraped"), F.count_if(F.col("_known").isNull()).alias("items_new"))
    )
    return per_source


def enrich_details(listings: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """C7 detail-page values win over list values unless blank; the SKU replaces the item code."""
    pairs = {"itemCode": "sku", "cpu": "cpu", "memory": "memory", "ssd": "ssd", "hdd": "hdd", "os": "os",
             "display_size": "display_size", "model": "model_number", "condition": "condition"}
    joined = listings.alias("l").join(details.alias("d"), F.col(f"l.{key}") == F.col(f"d.{key}"), "left")
    types = dict(listings.dtypes)

    def merged(column: str) -> Column:
        if column not in pairs or pairs[column] not in details.columns:
            return F.col(f"l.{column}")
        detail = F.col(f"d.{pairs[column]}")
        blank = F.lit("") if types[column] == "string" else F.lit(0.0)
        return F.coalesce(F.nullif(detail, blank), F.col(f"l.{column}")).alias(column)

    out = [merged(c) for c in listings.columns]
    if "model" not in listings.columns and "model_number" in details.columns:
        out.append(F.nullif(F.col("d.model_number"), F.lit("")).alias("model"))
    for spec in ("ssd", "hdd"):
        if spec not in listings.columns and spec in details.columns:
            out.append(F.nullif(F.col(f"d.{spec}"), F.lit("")).alias(spec))
    return joined.select(*out)


def contract_report(listings: DataFrame) -> DataFrame:
    """B18 how many rows of each source break each rule of the listing contract.

    A required column that the listings lack is broken in every row.
    """
    absent = {c: F.lit(None).cast("bigint" if c == "itemPrice" else "string") for c in LISTING_REQUIRED if c not in listings.columns}
    listings = listings.withColumns(absent)
    rules = {
        **{f"null_{c}": F.col(c).isNull() for c in LISTING_REQUIRED if c not in ("itemPrice", "source")},
        "blank_code": F.trim("itemCode") == "",
        "url_not_https": ~F.col("itemUrl").startswith("https://"),
        "not_jst": ~F.col("scraped_at").cast("string").contains("+09:00"),
        "priced_without_code": F.col("itemPrice").isNotNull()
        & F.coalesce(F.trim("itemCode") == "", F.lit(True)),
    }
    return listings.groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def empty_catalogue(spark) -> DataFrame:
    return spark.createDataFrame([], PRODUCTS)
