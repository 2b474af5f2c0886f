"""Structured Streaming jobs.

The source of truth is a folder of landed pages. Each run works off what is new
and stops (``availableNow``), so the nightly batch and a running stream are the
same job with another trigger.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from souba.plans import jobs
from souba.schemas import API_PAGE, PRODUCT_KEY
from souba.session import shared_dir
from souba.streaming.ledger import RunLedger


def landed_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """S1 API pages as they land, one JSON page per line."""
    return spark.readStream.schema(API_PAGE).option("maxFilesPerTrigger", files_per_batch).json(path)


def landed_table(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """S1 pages or observations that land as Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """S1 hand every micro-batch to ``write`` until the folder is worked off."""
    checkpoint = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .queryName(name).trigger(availableNow=True).start()
    )


def ingest(stream: DataFrame, listings: Callable[[DataFrame], dict[str, DataFrame]], catalogue_path: str, history_path: str,
           run_start: dt.datetime, name: str) -> list[jobs.RunReport]:
    """S1 work off landed pages into catalogue and history, however many micro-batches that takes.

    Each batch only upserts and appends, under a name and a time of its own that a second try keeps, so it counts once.
    What it has seen stands in the run ledger beside the catalogue. When the folder is worked off, products of the sources
    seen by any batch of the run, and failed in none, that no batch saw become inactive - also where the stream was
    stopped on the way and started again.
    """
    spark, reports = stream.sparkSession, []
    ledger = RunLedger(spark, f"{catalogue_path.rstrip('/')}-runs", name)

    def write(batch: DataFrame, number: int) -> None:
        at = ledger.begin(number, run_start)
        report = jobs.nightly_run(spark, listings(batch), catalogue_path, history_path, at, run_id=f"{name}-{number}", retire=False)
        ledger.finish(number, report)
        reports.append(report)
    run_batches(stream, write, name).awaitTermination()
    sources, began = ledger.to_retire()
    if sources:
        jobs.retire_unseen(spark, catalogue_path, sources, began)
    ledger.close()
    return reports


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """S2 a writer of micro-batches, each a folder that a second try replaces."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def first_observations(stream: DataFrame, timestamp: str = "scraped_at", delay: str = "1 day") -> DataFrame:
    """S2 one observation per (source, item_code) within the watermark."""
    typed = stream.withColumn(timestamp, F.col(timestamp).cast("timestamp"))
    return typed.withWatermark(timestamp, delay).dropDuplicatesWithinWatermark(PRODUCT_KEY)


def daily_windows(df: DataFrame, timestamp: str = "scraped_at", price: str = "price") -> DataFrame:
    """S3 count and mean price per source and UTC day; works on streams and tables."""
    return (
        df.groupBy("source", F.window(timestamp, "1 day").alias("_w"))
        .agg(F.count(price).alias("count"), F.avg(price).alias("mean"),
             F.percentile_approx(price, 0.5, 10000).alias("median_approx"))
        .select("source", F.col("_w.start").alias("day_start"), "count", "mean", "median_approx")
    )


def streaming_trend(stream: DataFrame, timestamp: str = "scraped_at", delay: str = "1 day") -> DataFrame:
    """S3 daily trend of a stream; rows later than the watermark are dropped."""
    typed = stream.withColumn(timestamp, F.col(timestamp).cast("timestamp"))
    return daily_windows(typed.withWatermark(timestamp, delay), timestamp)


def value_counts(stream: DataFrame, timestamp: str = "scraped_at", price: str = "price", delay: str = "1 day") -> DataFrame:
    """S3 the state of an exact daily trend: how often each price was seen per source and UTC day.

    Counts merge, medians don't; a day of one source is spread over as many keys as it has prices, and rows of one price
    are combined before they move. Days that the watermark has passed leave the state.
    """
    typed = stream.withColumn(timestamp, F.col(timestamp).cast("timestamp")).where(F.col(price).isNotNull())
    return typed.withWatermark(timestamp, delay).groupBy("source", F.window(timestamp, "1 day").alias("_w"), F.col(price).alias("price")).agg(
        F.count(F.lit(1)).alias("n")).select("source", F.col("_w.start").alias("day_start"), "price", "n")


def exact_trend(stream: DataFrame, path: str, name: str, timestamp: str = "scraped_at", price: str = "price", delay: str = "1 day") -> int:
    """S3 work off a stream into the value counts of its days, one folder per micro-batch with the counts that changed.

    Returns how many groups of rows came too late for the watermark, so that they don't get lost unseen.
    """
    checkpoint = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    counts = value_counts(stream, timestamp, price, delay)
    query = counts.writeStream.outputMode("update").foreachBatch(append_once(path)).option("checkpointLocation", checkpoint).queryName(
        name).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in json.loads(progress.json)["stateOperators"])


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """S3 count, mean and exact lower median per source and day from the newest count of each price."""
    counts = spark.read.option("recursiveFileLookup", False).parquet(path)
    newest = counts.groupBy("source", "day_start", "price").agg(F.max("n").alias("n"))            # counts only grow
    day = Window.partitionBy("source", "day_start")
    ranked = newest.withColumns({"_upto": F.sum("n").over(day.orderBy("price").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(day)})
    half = F.floor((F.col("_all") + 1) / 2)
    covers = (F.col("_upto") >= half) & (F.col("_upto") - F.col("n") < half)
    return ranked.groupBy("source", "day_start").agg(
        F.sum("n").alias("count"), (F.sum(F.col("price") * F.col("n")) / F.sum("n")).alias("mean"), F.max(F.when(covers, F.col("price"))).alias("median_low"))
