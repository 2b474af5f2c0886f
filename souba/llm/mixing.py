"""Mixing sources to target weights: certain whole copies, then a Pareto order sample of the rest.

A source whose target is r times its size gives each document floor(r) certain copies. What is left, f = r - floor(r),
is an unequal-probability sample of fixed size: each document has inclusion odds f / (1 - f) times its importance, a
uniform number from its id, and the rank (random odds) / (inclusion odds); documents are taken in this order until
their words come nearest to what is left of the target. The cut is found from word sums in 4,096 rank cells, then
4,096 finer ones, so no task orders a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souba.llm.common import hash60, written

CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``target`` per source: the budget shared by weight, no source above ``cap`` times its size.

    ``sources`` has one row per source (``source``, ``source_size``). Weights repeat along the sources by code point,
    null last. Sources are filled in the order of cap / weight: the first that stays below its cap sets the level
    for all after it. The windows run over sources, not over documents.
    """
    named = sources.withColumn("_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_no", F.lit(len(weights))).cast("int") + 1)
    limits = named.select("source", "source_size", "docs", share.alias("_w"),
                          (F.col("source_size") * float(cap)).alias("_cap"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(budget) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        / F.sum("_w").over(after)
    filled = limits.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_w") * F.col("_level"))
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_open"), F.col("_w") * first["level"]).otherwise(F.col("_cap"))
    return filled.select("source", "source_size", "docs", target.alias("target"))


def _plan(light: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Per source: copies all its documents get, the odds of one more, and the words still wanted."""
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = source_targets(sources, weights, budget, cap).withColumn("_ratio", ratio)
    planned = planned.withColumn("_whole", F.floor("_ratio")).withColumn("_part", F.col("_ratio") - F.col("_whole"))
    return planned.select("source", "source_size", "docs", "target", "_whole", "_part",
                          (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_wanted"))


def _ranked(df: DataFrame, plan: DataFrame, key: str, seed: str) -> DataFrame:
    """``df`` (with source and size) beside its source's plan, its rank and its rank cell."""
    drawn = hash60(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    uniform = (F.shiftright(drawn, 8).cast("double") + 0.5) / F.lit(float(1 << 52))
    mean = F.col("source_size") / F.col("docs")
    importance = F.when(F.col("source_size") > 0, F.least(F.greatest(F.col("size") / mean, F.lit(0.5)), F.lit(2.0))).otherwise(1.0)
    odds = F.col("_part") / (1 - F.col("_part"))
    joined = df.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rank = joined.withColumn("_u", uniform).withColumn(
        "_rank", F.when(F.col("_part") > 0, F.col("_u") / (1 - F.col("_u")) / (odds * importance)))
    even = F.col("_rank") * odds   # without the source's odds ranks spread evenly over the cells
    fine = F.least(F.floor(even / (1 + even) * float(CELLS * CELLS)), F.lit(CELLS * CELLS - 1)).cast("bigint")
    return rank.drop("_u").withColumn("_fine", fine)


def _last(cells: DataFrame, cell: str, start: str) -> DataFrame:
    """The first cell of each source in which the words pass what is wanted, and the words before it."""
    upto = Window.partitionBy("source").orderBy(cell)
    summed = cells.withColumn("_upto", F.sum("_words").over(upto) + F.col(start))
    cut = F.min(F.when(F.col("_upto") > F.col("_wanted"), F.struct(cell, (F.col("_upto") - F.col("_words")).alias("_before"))))
    return summed.groupBy("source").agg(cut.alias("_cut")).filter("_cut is not null").select("source", f"_cut.{cell}", "_cut._before")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0,
        key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0, 1 or more; at most ``cap`` rounded up).

    Every document keeps its row. Importance is the document's size over its source's mean size, held between 0.5 and
    2. A null text has size 0; a null source is a source of its own, the last. A source of no words gets no copies.
    Rows that agree in id and size have one rank and are taken or left together. An empty table stays empty. Columns
    named like a result give way. The same rows give the same mix on every run.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{source}`").alias("source"),
                        F.col(f"`{key}`").alias("_key"), word_count(F.col(f"`{text}`")).alias("size"))
    light = written(named.drop("_row"), "sizes")
    plan = written(_plan(light, weights, budget, cap), "plan")
    ranked = _ranked(light, plan, "_key", seed).filter("_part > 0")
    coarse = F.expr(f"_fine div {CELLS}")
    rough = ranked.groupBy("source", coarse.alias("_coarse")).agg(F.sum("size").alias("_words"), F.first("_wanted").alias("_wanted"))
    rough = _last(rough.withColumn("_from", F.lit(0)), "_coarse", "_from")
    inside = ranked.withColumn("_coarse", coarse).alias("r").join(
        rough.withColumnRenamed("source", "_s").withColumnRenamed("_coarse", "_c"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_coarse") == F.col("_c"))).drop("_s", "_c")
    inside = written(inside, "rankcell")
    fine = inside.groupBy("source", "_fine").agg(F.sum("size").alias("_words"), F.first("_wanted").alias("_wanted"),
                                                 F.first("_before").alias("_from"))
    fine = _last(fine, "_fine", "_from")
    last = inside.drop("_before").join(fine.select(F.col("source").alias("_s"), F.col("_fine").alias("_f"), "_before"),
                                       F.col("source").eqNullSafe(F.col("_s")) & (F.col("_fine") == F.col("_f")))
    place = F.struct(F.col("_rank"), F.coalesce(F.col("_key").cast("string"), F.lit("")).alias("_id"), F.col("size"))
    order = Window.partitionBy("source").orderBy(place)
    upto = F.sum("size").over(order) + F.col("_before")
    cuts = last.withColumn("_upto", upto).groupBy("source").agg(
        F.first("_f").alias("_last_cell"),
        F.max(F.when(F.col("_upto") - F.col("size") / 2 <= F.col("_wanted"), place)).alias("_last_place"))
    cuts = plan.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cuts = written(cuts, "cuts")
    placed = _ranked(named, cuts, "_key", seed)
    extra = F.when(F.col("_part") <= 0, 0).when(F.col("_last_cell").isNull() | (F.col("_fine") < F.col("_last_cell")), 1) \
        .when((F.col("_fine") == F.col("_last_cell")) & (place <= F.col("_last_place")), 1).otherwise(0)
    results = ["size", "source_size", "target", "copies"]
    copies = (F.col("_whole") + F.coalesce(extra, F.lit(0))).cast("int")
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in results]
    return placed.withColumn("copies", copies).select(*own, *results)


def mixed(docs: DataFrame, **settings: object) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    names = {k: settings.get(k, k if k != "key" else "doc_id") for k in ("key", "text", "source")}
    stored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"),
                         *[F.col(f"`{c}`").alias(f"_{k}") for k, c in names.items()])
    taken = mix(stored, **{**settings, **{k: f"_{k}" for k in names}})
    return taken.filter("copies > 0").select("_all", F.explode(F.expr("sequence(1, copies)"))).select("_all.*")
