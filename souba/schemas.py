"""Table shapes. Explicit everywhere: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

SPEC_FIELDS = [
    "brand", "model", "os", "cpu", "cpu_gen", "memory", "ssd", "hdd",
    "display_size", "weight", "bluetooth", "webcam", "usb_ports",
]

API_ITEM = T.StructType([
    T.StructField("itemName", T.StringType()),
    T.StructField("itemPrice", T.LongType()),
    T.StructField("itemUrl", T.StringType()),
    T.StructField("itemCaption", T.StringType()),
    T.StructField("genreId", T.StringType()),
    T.StructField("shopName", T.StringType()),
    T.StructField("itemCode", T.StringType()),
])

API_PAGE = T.StructType([
    T.StructField("Items", T.ArrayType(T.StructType([T.StructField("Item", API_ITEM)]))),
    T.StructField("error", T.StringType()),
    T.StructField("error_description", T.StringType()),
])

# Where a listing stood: order of the queries, page, place on it. Carried along where known.
ORDER_COLUMNS = ["query_no", "page_no", "position", "card_no"]

LISTING_REQUIRED = [
    "itemCode", "itemName", "itemUrl", "itemPrice", "shopName",
    "source", "search_query", "is_active", "scraped_at",
]

LISTING = T.StructType([
    T.StructField("itemCode", T.StringType()),
    T.StructField("itemName", T.StringType()),
    T.StructField("itemUrl", T.StringType()),
    T.StructField("itemPrice", T.LongType()),
    T.StructField("shopName", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("search_query", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("cpu", T.StringType()),
    T.StructField("cpu_gen", T.StringType()),
    T.StructField("memory", T.StringType()),
    T.StructField("ssd", T.StringType()),
    T.StructField("hdd", T.StringType()),
    T.StructField("display_size", T.DoubleType()),
    T.StructField("condition", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("item_code", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_url", T.StringType()),
    T.StructField("shop_name", T.StringType()),
    T.StructField("search_query", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("cpu", T.StringType()),
    T.StructField("cpu_gen", T.StringType()),
    T.StructField("memory", T.StringType()),
    T.StructField("ssd", T.StringType()),
    T.StructField("hdd", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("display_size", T.DoubleType()),
    T.StructField("weight", T.StringType()),
    T.StructField("bluetooth", T.StringType()),
    T.StructField("webcam", T.StringType()),
    T.StructField("usb_ports", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("last_seen_at", T.TimestampType()),
])
PRODUCT_COLUMNS = PRODUCTS.fieldNames()
PRODUCT_KEY = ["source", "item_code"]

PRICE_HISTORY = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("item_code", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("search_query", T.StringType()),
])

FEATURE_INPUTS = ["brand", "cpu_gen", "memory", "ssd", "hdd", "display_size", "os", "source"]
FEATURES = ["brand", "cpu_gen", "ram_gb", "ssd_gb", "hdd_gb", "display_size", "os_clean", "source"]
CATEGORICAL = ["brand", "os_clean", "source"]
