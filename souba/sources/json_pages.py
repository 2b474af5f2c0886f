"""Landed API pages to listings (A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souba import fixed_values as fv
from souba.schemas import API_ITEM, API_PAGE

ITEM_COLUMNS = ["itemName", "itemPrice", "itemUrl", "itemCaption", "genreId", "shopName", "itemCode"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files, one page per line, with the schema fixed up front."""
    return spark.read.schema(API_PAGE).json(path)


def parse_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """Pages that landed as text in a table column."""
    carried = [c for c in pages.columns if c != column]
    return pages.select(*carried, F.from_json(column, API_PAGE).alias("_page")).select(*carried, "_page.*")


def explode_items(pages: DataFrame) -> DataFrame:
    """A1 one row per hit. A page with an error, or without hits, adds nothing."""
    carried = [c for c in pages.columns if c not in API_PAGE.fieldNames()]
    good = pages.where(F.col("error").isNull())
    items = good.select(*carried, F.posexplode("Items").alias("position", "_wrapper"))
    return items.select(*carried, "position", *[F.col(f"_wrapper.Item.{c}").alias(c) for c in ITEM_COLUMNS])


def computers_only(items: DataFrame, genre: str = fv.API_COMPUTER_GENRE) -> DataFrame:
    """B6 hits of the computer genre; a hit without genre is dropped."""
    return items.where(F.col("genreId").cast("string") == genre)


def empty_items(spark: SparkSession) -> DataFrame:
    """What a query without hits returns: no rows, full schema."""
    return spark.createDataFrame([], API_ITEM)


def combined_text(name: Column, caption: Column) -> Column:
    """B1 title and description in one text; null in either gives null."""
    return F.concat(name, caption)
