"""Spec extraction over tables of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souba.functions import specs
from souba.functions.text import to_half_width
from souba.functions.titles import canonical_model
from souba.schemas import ORDER_COLUMNS, SPEC_FIELDS

_ID_COLUMNS = ["itemCode", "genreId", "shopName", "is_active", "scraped_at", "search_query"]


def extract_specs(df: DataFrame, text_col: str = "combined", price_col: str | None = "itemPrice",
                  name_col: str | None = "itemName", optional: bool = False) -> DataFrame:
    """T1 identity columns followed by the spec columns read from ``text_col``.

    A narrow projection: the text is normalised once, then read by built-in
    regex expressions. ``optional`` adds the seven optional fields.
    """
    ids = [c for c in (name_col, price_col) if c and c in df.columns] + _ID_COLUMNS
    ids += [c for c in ("itemUrl", *ORDER_COLUMNS) if c in df.columns]
    fields = {name: specs.FIELDS[name] for name in SPEC_FIELDS}
    if optional:
        fields = {**fields, **specs.OPTIONAL_FIELDS}
    text = F.col("_text")
    return (
        df.select(*ids, to_half_width(F.col(text_col)).alias("_text"))
        .select(*ids, *[read(text).alias(name) for name, read in fields.items()])
    )


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D16 filled rows per field, long form, from one pass over the table."""
    columns = columns or SPEC_FIELDS
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns]))
    return wide.select(pairs.alias("_f"), "_n").select(
        "_f.field", "_f.filled", F.col("_n").alias("total"),
        F.try_divide("_f.filled", "_n").alias("fill_rate"))


def backfill_models(products: DataFrame) -> DataFrame:
    """T2 model from the title where the title names one; other models stay."""
    found = canonical_model(F.coalesce(F.col("item_name"), F.lit("")))
    return products.withColumn("model", F.coalesce(found, F.col("model")))


def backfill_report(products: DataFrame) -> DataFrame:
    """D22 products read, matched and the rate in percent (0 for an empty table)."""
    found = canonical_model(F.coalesce(F.col("item_name"), F.lit("")))
    return (
        products.agg(F.count(F.lit(1)).alias("products"), F.count(found).alias("matched"))
        .withColumn("match_pct", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("products")), F.lit(0.0)))
    )
