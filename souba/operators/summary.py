"""Exact grouped summaries that survive hot groups.

The built-in exact percentile keeps every distinct value of a group in one
task. Here a group is first folded to (group, value) counts, which combines on
the map side and spreads even one giant group over all tasks.

Whole numbers (yen) have a bounded number of values per group, so their pairs are
ranked by a window over the pairs. Real numbers are ranked by their bits: a double
becomes a 64-bit whole number of the same order, and a wanted rank is found by
counts per leading bits, then, among the values of that cell only, per the bits
that follow. Three rounds settle all 64. The first ranks the cells of a group, 2^12
of them per doubling of the value; the others at most 2^20 within one cell, so that
no distribution fills one task.
The column's type chooses, never its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

CELL_BITS = (40, 20, 0)          # bits below a cell in each round: 24 + 20 + 20 bits are looked at
MOMENTS = ("count", "mean", "std", "min", "max")


def order_key(value: Column) -> Column:
    """A double as a whole number of the same order, by arithmetic that loses nothing: equal for equal values only.

    Exponent and mantissa side by side, as they stand in its bits, negated for negative values. Both zeros are 0;
    infinity and, as in sorting, NaN come last.
    """
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022))
    scaled = lambda exponent: size / F.pow(F.lit(2.0), exponent)
    exponent = guess + F.when(scaled(guess) < 1.0, -1).when(scaled(guess) >= 2.0, 1).otherwise(0)
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + ((scaled(exponent) - 1.0) * 2.0**52).cast("bigint")
    bits = F.when(size < 2.0**-1022, (size / 2.0**-1074).cast("bigint")).otherwise(normal)
    finite = F.when(value < 0, -bits).otherwise(bits)
    last = F.lit((1 << 63) - 1).cast("bigint")
    return F.when(F.isnan(value), last).when(size == float("inf"), F.when(value < 0, -last).otherwise(last - 1)).otherwise(finite)


def value_of_key(key: Column) -> Column:
    """The double of an ``order_key``."""
    size = F.abs(key)
    field, mantissa = F.shiftright(size, 52), size.bitwiseAND((1 << 52) - 1).cast("double")
    normal = (1.0 + mantissa / 2.0**52) * F.pow(F.lit(2.0), field - 1023)
    return F.when(key < 0, -1.0).otherwise(1.0) * F.when(field == 0, mantissa * 2.0**-1074).otherwise(normal)


def _rank(q: float, how: str) -> tuple[Column, Column, Column]:
    """Zero-based ranks below and above a quantile and the weight of the upper one."""
    place = F.lit(q) * (F.col("_total") - 1)
    if how == "nearest":
        nearest = F.floor(place + 0.5)
        return nearest, nearest, F.lit(0.0)
    if how == "linear":
        return F.floor(place), F.ceil(place), place - F.floor(place)
    raise ValueError(f"unknown interpolation {how!r}")


def grouped_summary(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, tuple[float, str]] | None = None,
    moments: tuple[str, ...] = (),
) -> DataFrame:
    """Exact quantiles and moments of a numeric column per group.

    ``quantiles`` maps an output name to ``(q, "linear" | "nearest")``;
    ``moments`` picks from count, mean, std (population), min, max. Null values
    are left out; a group without values gives no row. Null keys are a group.
    """
    quantiles = quantiles or {"median": (0.5, "linear")}
    if isinstance(df.schema[value].dataType, IntegralType):
        return _whole_summary(df, keys, value, quantiles, moments)
    v = F.col("_v")
    counts = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(v.isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_key", order_key(v))
    )
    cell_of = lambda below: F.shiftright("_key", below)

    # First round: counts per leading bits, and what the moments need. Deviations are taken from the least value the
    # cell can hold, so squares of large prices never cancel.
    cell_sums = [F.sum("_n").alias("_cn")]
    if moments:
        cell_sums += [
            F.sum(F.col("_n") * v).alias("_cs"), F.min("_v").alias("_cmin"), F.max("_v").alias("_cmax"),
            F.sum(F.col("_n") * (v - F.col("_edge"))).alias("_d1"), F.max("_edge").alias("_edge"),
            F.sum(F.col("_n") * (v - F.col("_edge")) * (v - F.col("_edge"))).alias("_d2"),
        ]
    edge = value_of_key(F.shiftleft(cell_of(CELL_BITS[0]), CELL_BITS[0]))
    edged = counts.withColumn("_edge", edge) if moments else counts
    cells = edged.groupBy(*keys, cell_of(CELL_BITS[0]).alias("_cell")).agg(*cell_sums)
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("_before", F.coalesce(F.sum("_cn").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_cn").over(group))
    )
    if moments:
        n = F.col("_cn")
        cell_mean = F.col("_edge") + F.col("_d1") / n
        cell_m2 = F.col("_d2") - F.col("_d1") * F.col("_d1") / n
        cells = (
            cells.withColumn("_mean", F.sum("_cs").over(group) / F.col("_total"))
            .withColumn("_m2", F.sum(cell_m2 + n * F.pow(cell_mean - F.col("_mean"), 2)).over(group))
            .withColumn("_min", F.min("_cmin").over(group))
            .withColumn("_max", F.max("_cmax").over(group))
        )

    # A row per wanted rank and the cell that holds it.
    carried = ["_total"] + (["_mean", "_m2", "_min", "_max"] if moments else [])
    ranks = {name: _rank(q, how) for name, (q, how) in quantiles.items()}
    wanted = F.array_distinct(F.array(*[r.cast("bigint") for low, high, _ in ranks.values() for r in (low, high)]))
    holds = lambda d: d.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cn")))
    found = holds(cells.select(*keys, "_cell", "_before", "_cn", *carried, F.explode(wanted).alias("_rank")))

    # Then the bits that follow, of the values in wanted cells only; the last round's cells are single values.
    for above, below in zip(CELL_BITS, CELL_BITS[1:]):
        targets = found.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_cell").alias("_t_cell"), "_rank", "_before", *carried)
        same = cell_of(above) == F.col("_t_cell")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        inside = counts.join(targets, same).groupBy(*keys, "_rank", cell_of(below).alias("_cell")).agg(
            F.sum("_n").alias("_cn"), F.max("_before").alias("_base"), F.max("_v").alias("_v"), *[F.max(c).alias(c) for c in carried])
        upto = Window.partitionBy(*keys, "_rank").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        found = holds(inside.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_cn").over(upto), F.lit(0))))

    value_at = lambda rank: F.max(F.when(F.col("_rank") == rank.cast("bigint"), v))
    sums = [F.max("_total").alias("_total")]
    for name, (low, high, weight) in ranks.items():
        sums += [value_at(low).alias(f"_lo_{name}"), value_at(high).alias(f"_hi_{name}"), F.max(weight).alias(f"_w_{name}")]
    if moments:
        sums += [F.max(c).alias(c) for c in ("_mean", "_m2", "_min", "_max")]
    found = found.groupBy(*keys).agg(*sums)

    made = {
        "count": F.col("_total"), "mean": F.col("_mean"), "min": F.col("_min"), "max": F.col("_max"),
        "std": F.sqrt(F.greatest(F.col("_m2"), F.lit(0.0)) / F.col("_total")),
    }
    return found.select(
        *keys,
        *[made[m].alias(m) for m in moments],
        *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name) for name in ranks])


def _whole_summary(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, tuple[float, str]], moments: tuple[str, ...]) -> DataFrame:
    """``grouped_summary`` of whole numbers: raw rows move once, as counts; then (group, value) pairs move once."""
    v, n = F.col("_v"), F.col("_n")
    counts = df.select(*keys, F.col(value).cast("bigint").alias("_v")).where(v.isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({
        "_total": F.sum("_n").over(group),
        "_upto": F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))})
    if moments:
        mean = F.sum(n * v).over(group) / F.col("_total")
        ranked = ranked.withColumn("_mean", mean).withColumn("_off", v - F.col("_mean"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - n), v)).cast("double")

    sums = [F.max("_total").alias("_total")]
    ranks = {name: _rank(q, how) for name, (q, how) in quantiles.items()}
    for name, (low, high, weight) in ranks.items():
        sums += [value_at(low).alias(f"_lo_{name}"), value_at(high).alias(f"_hi_{name}"), F.max(weight).alias(f"_w_{name}")]
    if moments:
        sums += [F.max("_mean").alias("mean"), F.min("_v").cast("double").alias("min"), F.max("_v").cast("double").alias("max"),
                 F.sqrt(F.sum(n * F.col("_off") * F.col("_off")) / F.max("_total")).alias("std")]
    found = ranked.groupBy(*keys).agg(*sums).withColumn("count", F.col("_total"))
    between = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
    return found.select(*keys, *moments, *[between(name).alias(name) for name in ranks])
