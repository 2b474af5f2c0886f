"""Typed price facts and their scope."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from souba import fixed_values as fv


def coerce(df: DataFrame, price: str = "price", timestamp: str = "scraped_at", active: str | None = None) -> DataFrame:
    """B16 fetched strings to types; what cannot be read becomes null."""
    casts = {price: F.col(price).try_cast("bigint"), timestamp: F.try_to_timestamp(F.col(timestamp).cast("string"))}
    if active:
        casts[active] = F.col(active).try_cast("boolean")
    return df.withColumns(casts)


def _known(column: Column) -> Column:
    """B15 null or '' to the unknown label."""
    return F.when(column.isNull() | (column == ""), fv.UNKNOWN).otherwise(column)


def price_fact(history: DataFrame, products: DataFrame) -> DataFrame:
    """C2 / B15 every observation with its product; an unknown product keeps the observation.

    A left join: a product that fills a third of the history is split by the
    adaptive skew join, and only the needed columns are read on both sides.
    """
    dimension = products.withColumnsRenamed({"id": "product_id", "source": "product_source"})
    clash = [c for c in dimension.columns if c in history.columns and c != "product_id"]
    joined = history.join(dimension.drop(*clash), "product_id", "left")
    return (
        joined.withColumns({
            "source": F.coalesce(F.col("source"), F.lit(fv.DEFAULT_SOURCE)),
            "brand": _known(F.col("brand")),
            "model": _known(F.col("model")),
        })
        .withColumn("display_name", F.concat("brand", F.lit(" "), "model"))
    )


def listings_view(history: DataFrame, products: DataFrame) -> DataFrame:
    """A5 the denormalised view with listing-style names."""
    dimension = products.withColumnsRenamed({"id": "product_id", "source": "product_source"})
    clash = [c for c in dimension.columns if c in history.columns and c != "product_id"]
    joined = history.join(dimension.drop(*clash), "product_id", "inner")
    return joined.select(
        F.col("item_code").alias("itemCode"), F.col("item_name").alias("itemName"),
        F.col("price").alias("itemPrice"), F.col("item_url").alias("itemUrl"),
        F.col("shop_name").alias("shopName"), "brand", "cpu", "memory", "ssd", "os",
        "scraped_at", "model", "search_query", "is_active", "source")


def scoped(df: DataFrame, date_from: dt.date | None = None, date_to: dt.date | None = None,
           sources: list[str] | None = None, brands: list[str] | None = None, active_only: bool = False,
           price: str = "price") -> DataFrame:
    """B9-B12 the reader's choices; an empty list or None does not restrict.

    Dates are inclusive and written as a half-open timestamp range, so they reach
    the scan and prune ``obs_date`` partitions.
    """
    if date_from is not None:
        df = df.where(F.col("scraped_at") >= F.lit(dt.datetime.combine(date_from, dt.time())).cast("timestamp"))
    if date_to is not None:
        end = dt.datetime.combine(date_to + dt.timedelta(days=1), dt.time())
        df = df.where(F.col("scraped_at") < F.lit(end).cast("timestamp"))
    if sources:
        df = df.where(F.col("source").isin(sources))
    if brands:
        df = df.where(F.col("brand").isin(brands))
    if active_only:
        df = df.where(F.col("is_active"))
    return df.where(F.col(price).isNotNull())


def matching_specs(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """B13 rows whose columns match their patterns (case matters); null never matches, '' does not restrict."""
    for column, pattern in (patterns if patterns is not None else fv.DEFAULT_SPEC_PATTERNS).items():
        if pattern:
            df = df.where(F.coalesce(F.col(column).rlike(pattern), F.lit(False)))
    return df
