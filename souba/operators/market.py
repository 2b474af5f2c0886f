"""The market questions.

Every function answers for all groups at once. Medians and quartiles are exact
and computed by ``grouped_summary``, so a model, shop or day that holds a third
of all observations is spread over the cluster like everything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from souba import fixed_values as fv
from souba.functions.text import change_class, change_label
from souba.operators.summary import MOMENTS, grouped_summary

MEDIAN = {"median": (0.5, "linear")}
QUARTILES_LINEAR = {**MEDIAN, "p25": (0.25, "linear"), "p75": (0.75, "linear")}
QUARTILES_NEAREST = {**MEDIAN, "p25": (0.25, "nearest"), "p75": (0.75, "nearest")}


def _with_group(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join rows with one row per group; a null key is a group like any other."""
    renamed = groups.withColumnsRenamed({k: f"_k_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    return df.join(renamed, same, how).drop(*[f"_k_{k}" for k in by])


def with_day(df: DataFrame, timestamp: str = "scraped_at", day: str = "day") -> DataFrame:
    """H33 UTC day of an observation."""
    return df.withColumn(day, F.to_date(timestamp))


def price_stats(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """D1 count, mean, population std, range, median and linear quartiles per group."""
    return grouped_summary(df, by, price, QUARTILES_LINEAR, MOMENTS)


def price_change(df: DataFrame, by: list[str], price: str = "price", timestamp: str = "scraped_at",
                 days: int = fv.CHANGE_WINDOW_DAYS) -> DataFrame:
    """D2 / E3 / H31 median of the last days against the median before, per group.

    The window ends at the group's own newest observation. Without a price on
    either side the change is null and the current median is that of all prices.
    """
    newest = df.groupBy(*by).agg((F.max(timestamp) - F.expr(f"INTERVAL {days} DAYS")).alias("_cutoff"))
    marked = _with_group(df, newest, by).select(
        *by, price, F.when(F.col(timestamp) >= F.col("_cutoff"), "recent").otherwise("prior").alias("_period"))
    halves = grouped_summary(marked, [*by, "_period"], price, MEDIAN, ("count",))
    of = lambda period, column: F.max(F.when(F.col("_period") == period, F.col(column)))
    both = halves.groupBy(*by).agg(
        F.sum("count").alias("count"),
        of("recent", "median").alias("_recent"), of("prior", "median").alias("_prior"))
    pct = (F.col("_recent") - F.col("_prior")) / F.nullif(F.col("_prior"), F.lit(0.0)) * 100
    return both.select(
        *by, "count",
        F.coalesce("_recent", "_prior").alias("current_median"),
        F.col("_prior").alias("prior_median"),
        pct.alias("change_7d"), change_class(pct).alias("change_class"), change_label(pct).alias("change_label"))


def daily_trend(df: DataFrame, by: list[str], price: str = "price", timestamp: str = "scraped_at",
                quartiles: bool = False, mean: bool = False) -> DataFrame:
    """D3-D5, D7 median price per day and group, with the number of prices.

    ``quartiles`` adds p25 and p75 by nearest rank, ``mean`` the mean. Days
    without a price give no row.
    """
    moments = ("count", "mean") if mean else ("count",)
    quantiles = QUARTILES_NEAREST if quartiles else MEDIAN
    return grouped_summary(with_day(df, timestamp), [*by, "day"], price, quantiles, moments)


def count_by_date(df: DataFrame, price: str = "price", timestamp: str = "scraped_at") -> DataFrame:
    """D6 prices per day over all sources, and how many sources had one."""
    per_source = with_day(df, timestamp).groupBy("day", "source").agg(F.count(price).alias("_n"))
    return (
        per_source.where("_n > 0").groupBy("day")
        .agg(F.sum("_n").alias("listings"), F.count(F.lit(1)).alias("sources"))
    )


_NO_PRICE = 0   # stands for a missing price beside the mark that it is missing


def spec_breakdown(df: DataFrame, by: list[str], specs: list[str] | None = None, price: str = "price") -> DataFrame:
    """D10 median and count per value of each spec, from one scan.

    A spec is shown for a group only when the group has at least two values of it.
    """
    specs = specs or fv.SPEC_COLUMNS
    long = df.select(*by, price, F.explode(F.array(*[
        F.struct(F.lit(s).alias("spec"), F.col(s).cast("string").alias("value")) for s in specs])).alias("_s"))
    long = long.select(*by, price, "_s.spec", "_s.value").where("value IS NOT NULL")
    # Values that only come without a price count as values, so they are folded too and left out afterwards.
    marked = long.select(*by, "spec", "value", F.coalesce(F.col(price), F.lit(_NO_PRICE)).alias(price), F.col(price).isNotNull().cast("int").alias("_priced"))
    per_value = grouped_summary(marked, [*by, "spec", "value", "_priced"], price, MEDIAN, ("count",))
    group = Window.partitionBy(*by, "spec")
    several = F.min("value").over(group) != F.max("value").over(group)
    return per_value.withColumn("_several", several).where("_several AND _priced = 1").drop("_several", "_priced")


def _histogram_groups(df: DataFrame, by: list[str], price: str, most: int, least: int, per_bin: int) -> DataFrame:
    n = F.col("_n")
    sums = df.where(F.col(price).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(price).cast("double").alias("_min"), F.max(price).cast("double").alias("_max"))
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n / per_bin))).cast("int")
    return (
        sums.where(n >= fv.MIN_PRICES_FOR_HISTOGRAM).withColumn("bins", bins)
        .withColumn("_width", (F.col("_max") - F.col("_min")) / F.col("bins"))
    )


def price_histogram(df: DataFrame, by: list[str], price: str = "price",
                    most: int = 40, least: int = 10, per_bin: int = 4) -> DataFrame:
    """D11 equal-width histogram per group; more prices give more bins, within limits."""
    groups = _histogram_groups(df, by, price, most, least, per_bin)
    step = F.floor(F.try_divide(F.col(price).cast("double") - F.col("_min"), F.col("_width")))
    number = F.least(F.coalesce(step, F.lit(0)), F.col("bins") - 1).cast("int")
    # Integer counts per (group, price) first: the join then sees each price once.
    counts = df.where(F.col(price).isNotNull()).groupBy(*by, price).agg(F.count(F.lit(1)).alias("_c"))
    return (
        _with_group(counts, groups, by)
        .groupBy(*by, number.alias("bin"), "_min", "_width")
        .agg(F.sum("_c").alias("n"))
        .select(*by, "bin", (F.col("_min") + F.col("bin") * F.col("_width")).alias("low"),
                (F.col("_min") + (F.col("bin") + 1) * F.col("_width")).alias("high"), "n")
    )


def normal_curve(df: DataFrame, by: list[str], price: str = "price",
                 most: int = 30, least: int = 10, per_bin: int = 5) -> DataFrame:
    """D12 normal curve fitted to each group and scaled to its histogram counts."""
    stats = df.where(F.col(price).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(price).alias("_mu"), F.stddev_pop(price).alias("_sigma"),
        F.min(price).cast("double").alias("_min"), F.max(price).cast("double").alias("_max"))
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("_n") / per_bin)))
    stats = stats.where(F.col("_n") >= fv.MIN_PRICES_FOR_HISTOGRAM).withColumn(
        "_width", (F.col("_max") - F.col("_min")) / bins)
    points = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(fv.CURVE_POINTS - 1))).alias("point"))
    z = fv.CURVE_SIGMAS * (2.0 * F.col("point") / (fv.CURVE_POINTS - 1) - 1.0)
    density = F.try_divide(F.exp(-z * z / 2.0), F.col("_sigma") * F.sqrt(F.lit(2.0) * F.pi()))
    return points.select(
        *by, "point", (F.col("_mu") + z * F.col("_sigma")).alias("price"),
        (density * F.col("_n") * F.col("_width")).alias("expected"))


def top_models(df: DataFrame, k: int = fv.TOP_MODELS, name: str = "display_name") -> DataFrame:
    """D13 / F4 the k names with most observations."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("observations"))
    return counts.orderBy(F.desc("observations"), name).limit(k)


def model_meta(df: DataFrame, by: list[str], product: str = "product_id", approximate: bool = False) -> DataFrame:
    """D14 observations and distinct listings per group."""
    listings = F.approx_count_distinct(product) if approximate else F.count_distinct(product)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), listings.alias("listings"))


def facet_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """F5 / G2 the distinct values of several columns, from one scan."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_f"))
    return pairs.select("_f.*").where("value IS NOT NULL").distinct()


def source_comparison(df: DataFrame, price: str = "price") -> DataFrame:
    """D8 daily median per source; scope and spec patterns are applied before."""
    return daily_trend(df.where(F.col("source").isNotNull()), ["source"], price)


def shop_comparison(df: DataFrame, price: str = "price", shop: str = "shop_name") -> DataFrame:
    """D9 daily median per shop; listings without a shop are left out."""
    return daily_trend(df.where(F.col(shop).isNotNull()), [shop], price)


def against_median(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """E2 / C10 each listing against the median of its group, in percent, half to even.

    The medians are one row per group; a hot group is split on the listing side.
    """
    medians = grouped_summary(df, by, price, MEDIAN)
    pct = (F.col(price) - F.col("median")) / F.nullif(F.col("median"), F.lit(0.0)) * 100
    return _with_group(df, medians, by).withColumn("vs_median_pct", F.bround(pct, 1))


def latest_price(df: DataFrame, keys: list[str], order: list[Column], price: str = "price") -> DataFrame:
    """E5 newest price per product and the one before it.

    Only the two newest rows per product leave each task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    newest = df.withColumn("_rn", F.row_number().over(window)).where("_rn <= 2")
    at = lambda i: F.max(F.when(F.col("_rn") == i, F.col(price)))
    return newest.groupBy(*keys).agg(at(1).alias("latest_price"), at(2).alias("previous_price"))
