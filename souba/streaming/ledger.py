"""What the batches of a streaming run have done, kept as rows beside the catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from souba.plans.jobs import RunReport

ROWS = T.StructType([T.StructField("source", T.StringType()), T.StructField("at", T.TimestampType()),
                     T.StructField("scraped", T.LongType()), T.StructField("new", T.LongType()), T.StructField("error", T.StringType())])
FOLDERS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("event", T.StringType())])


class RunLedger:
    """Rows per batch and event: ``begun``, ``seen`` and ``failed`` sources, ``closed``.

    A batch's rows of an event are a folder that a second try replaces. A run is open from its first batch until it is
    closed; a stream that stops on the way and starts again goes on with the same run.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str):
        self.spark = spark
        self.path = f"{path.rstrip('/')}/{stream}"

    def rows(self) -> DataFrame:
        """All rows of the stream."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = T.StructType([*ROWS.fields, *FOLDERS.fields])
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, batch: int, event: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}/event={event}")

    def open_rows(self) -> DataFrame:
        """Rows of batches after the last closed one."""
        rows = self.rows()
        closed = rows.where("event = 'closed'").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]      # one number
        return rows.where(F.col("batch") > closed)

    def begin(self, batch: int, at: dt.datetime) -> dt.datetime:
        """The time a batch counts as seen: that of its first try."""
        before = self.rows().where((F.col("batch") == batch) & (F.col("event") == "begun")).select("at").first()
        if before is not None:
            return before["at"]
        self._write(batch, "begun", [(None, at, None, None, None)])
        return at

    def finish(self, batch: int, report: RunReport) -> None:
        """The sources a batch has brought, and those that failed in it."""
        self._write(batch, "seen", [(s, None, report.scraped.get(s, 0), report.new.get(s, 0), None) for s in report.sources])
        self._write(batch, "failed", [(s, None, None, None, error) for s, error in report.failed.items()])

    def to_retire(self) -> tuple[list[str], dt.datetime | None]:
        """Sources that batches of the open run have seen and none has failed on, and the time of its first batch."""
        rows = self.open_rows()
        told = rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.max((F.col("event") == "failed").cast("int")).alias("failed"))
        sources = sorted(r["source"] for r in told.where("failed = 0").collect())                          # one row per source
        return sources, rows.agg(F.min("at")).first()[0]

    def close(self) -> None:
        """End the open run; nothing where none is open."""
        last = self.open_rows().agg(F.max("batch")).first()[0]
        if last is not None:
            self._write(last, "closed", [(None, None, None, None, None)])
