"""File sinks and catalogue tables."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from souba.schemas import PRICE_HISTORY


def write_csv(df: DataFrame, path: str) -> None:
    """A9"""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """A10"""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A11 one record per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_records(df: DataFrame, column: str = "record") -> DataFrame:
    """A11 each row as one JSON string, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def append_history(observations: DataFrame, path: str, unit: str = "day", run: str | None = None) -> None:
    """A7 append-only history, one folder per observation day (or month, for long backfills) and run.

    A run (or micro-batch) that is tried again under its name replaces what it
    wrote before and nothing else. Rows of a folder go to few writers, but a big
    one is still split by the adaptive rebalance instead of landing in one task.
    """
    (
        observations.withColumns({"obs_date": F.to_date(F.date_trunc(unit, "scraped_at")), "run": F.lit(run or uuid.uuid4().hex)})
        .hint("rebalance", "obs_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_date", "run").parquet(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*PRICE_HISTORY.fields, T.StructField("obs_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def append_predictions(scored: DataFrame, path: str, run: str | None = None) -> None:
    """A8 one folder per run; a run that is tried again replaces its own."""
    named = scored.withColumn("run", F.lit(run or uuid.uuid4().hex))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


class Snapshots:
    """A6 a catalogue kept as immutable snapshots, each covering the sources of one run.

    A snapshot is written beside those that are read and becomes visible only
    when complete, so a lost job leaves the table as it was and no plan reads and
    overwrites the same files. A source is read from its newest snapshot; a run
    rewrites the sources it covers and leaves the others' files alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        if not self._fs.exists(self._hadoop(path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(path)) if s.isDirectory())

    def _complete(self) -> list[str]:
        return [n for n in self._children(self.path) if self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]

    def newest(self) -> dict[str, str]:
        """Partition folder of the newest snapshot of each source."""
        folders: dict[str, str] = {}
        for snapshot in self._complete():
            for partition in self._children(f"{self.path}/{snapshot}"):
                if partition.startswith("source="):
                    folders[partition] = f"{self.path}/{snapshot}/{partition}"
        return folders

    def read(self, schema, sources: list[str] | None = None) -> DataFrame:
        """The whole table, or some of its sources."""
        folders = self.newest()
        if sources is not None:
            folders = {k: v for k, v in folders.items() if unquote(k[len("source="):]) in sources}
        if not folders:
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(schema).option("basePath", self.path).parquet(*sorted(folders.values()))
        return table.select(schema.fieldNames())

    def write(self, df: DataFrame) -> None:
        """A new snapshot of the sources ``df`` holds; it must hold each of them whole."""
        last = self._complete()[-1:]
        number = int(last[0].split("=")[1].split("-")[0]) + 1 if last else 1
        target = f"{self.path}/snapshot={number:08d}-{uuid.uuid4().hex[:8]}"
        (
            df.hint("rebalance", "source").write.mode("errorifexists")
            .option("compression", "snappy").partitionBy("source").parquet(target)
        )

    def retire(self, keep: int = 7) -> list[str]:
        """Delete complete snapshots that no source is read from, the ``keep`` newest excepted; their names."""
        used = {folder.split("/")[-2] for folder in self.newest().values()}
        old = [name for name in self._complete()[:-keep] if name not in used]
        for name in old:
            self._fs.delete(self._hadoop(f"{self.path}/{name}"), True)
        return old
