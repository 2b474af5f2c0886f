"""Registered streaming jobs: landed files worked off to their end, then read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from souba.plans.registry import query
from souba.plans.views import table
from souba.session import shared_dir


# The streams import the jobs, which import the plans' package: they are imported when a query runs.
def _streams():
    from souba.plans import jobs
    from souba.sources import sinks
    from souba.streaming import jobs as streams
    return streams, jobs, sinks


def _landed(df, folder: str, by: str) -> None:
    """A file per value of a column, so that each may become a micro-batch of its own."""
    for value in sorted(r[0] for r in df.select(by).distinct().collect()):       # two values
        df.where(F.col(by) == value).drop(by).coalesce(1).write.mode("append").parquet(folder)


@query("stream_restart", """
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS item_code, CASE WHEN p_size % 2 = 0 THEN 'sofmap' ELSE 'qualit' END AS source,
       p_size % 3 <> 0 AS is_active, CASE WHEN p_size % 3 <> 0 THEN 2 ELSE 1 END::BIGINT AS observations
FROM part""")
def stream_restart(spark, sf_dir):
    """S1 C5 a run that stops after its first batch and starts again retires what no batch of it saw, and counts each once"""
    streams, jobs, sinks = _streams()
    folder, name = f"{shared_dir(spark)}/restart-{uuid.uuid4().hex}", f"restart-{uuid.uuid4().hex}"
    parts = table(spark, sf_dir, "part").selectExpr(
        "'P' || p_partkey AS itemCode", "p_name AS itemName", "'https://s/' || p_partkey AS itemUrl", "CAST(p_retailprice AS BIGINT) AS itemPrice",
        "p_brand AS shopName", "'q' AS search_query", "true AS is_active", "CASE WHEN p_size % 2 = 0 THEN 'sofmap' ELSE 'qualit' END AS shop", "p_size")
    stop = {"at": None}

    def listings(batch):
        if stop["at"] == 0:
            raise RuntimeError("stopped on purpose")
        stop["at"] = None if stop["at"] is None else stop["at"] - 1
        return {shop: batch.where(F.col("shop") == shop).drop("shop", "p_size") for shop in ("sofmap", "qualit")}

    def work_off(day):
        stream = streams.landed_table(spark, f"{folder}/landed", parts.schema, files_per_batch=1)
        streams.ingest(stream, listings, f"{folder}/products", f"{folder}/history", dt.datetime(2026, 2, day), name)
    parts.coalesce(1).write.parquet(f"{folder}/landed")
    work_off(1)
    _landed(parts.where("p_size % 3 <> 0").withColumn("half", F.col("p_size") % 2), f"{folder}/landed", "half")
    stop["at"] = 1                              # one more batch, then the stream dies
    try:
        work_off(2)
    except PySparkException:
        stop["at"] = None
    work_off(3)
    seen = sinks.read_history(spark, f"{folder}/history").groupBy("source", "item_code").agg(F.count(F.lit(1)).alias("observations"))
    products = sinks.Snapshots(spark, f"{folder}/products").read(jobs.CATALOGUE)
    return products.join(seen, ["source", "item_code"]).select("item_code", "source", "is_active", "observations")


@query("stream_dedupe", """
SELECT event_type AS source, user_id AS item_code, 1::BIGINT AS kept FROM events GROUP BY ALL""")
def stream_dedupe(spark, sf_dir):
    """S2 one observation per source and code within the watermark, across micro-batches, written and read back"""
    streams, _, _ = _streams()
    folder = f"{shared_dir(spark)}/dedupe-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("item_code"), F.col("ts").alias("scraped_at"),
                                                  (F.col("event_id") % 2).alias("half"))
    _landed(events, f"{folder}/landed", "half")
    stream = streams.landed_table(spark, f"{folder}/landed", events.drop("half").schema, files_per_batch=1)
    first = streams.first_observations(stream, delay="60 days")
    streams.run_batches(first, streams.append_once(f"{folder}/out"), f"dedupe-{uuid.uuid4().hex}").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("source", "item_code").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_trend", """
WITH e AS (SELECT event_type AS source, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS price FROM events WHERE value IS NOT NULL)
SELECT source, strftime(day, '%Y-%m-%d') AS day, count(*) AS count, round(avg(price), 4) AS mean, quantile_disc(price, 0.5) AS median_low, 0::BIGINT AS late
FROM e GROUP BY ALL""")
def stream_trend(spark, sf_dir):
    """S3 D3 exact daily trend from value counts kept as state over several micro-batches; late rows are counted"""
    streams, _, _ = _streams()
    folder = f"{shared_dir(spark)}/trend-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.round(F.col("value") * 100).cast("bigint").alias("price"), F.col("ts").alias("scraped_at"), (F.col("event_id") % 2).alias("half"))
    _landed(events, f"{folder}/landed", "half")
    stream = streams.landed_table(spark, f"{folder}/landed", events.drop("half").schema, files_per_batch=1)
    late = streams.exact_trend(stream, f"{folder}/counts", f"trend-{uuid.uuid4().hex}", delay="60 days")
    trend = streams.read_trend(spark, f"{folder}/counts")
    return trend.select("source", F.date_format("day_start", "yyyy-MM-dd").alias("day"), "count", F.round("mean", 4).alias("mean"), "median_low",
                        F.lit(late).cast("bigint").alias("late"))
