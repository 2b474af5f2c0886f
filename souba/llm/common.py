"""Small helpers the operators share."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souba.session import shared_dir

if TYPE_CHECKING:
    import pyarrow as pa

HASH_BITS = 60


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative bigint; null counts as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added; a column of the same name (in any case) gives way."""
    names = {n.lower() for n in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """An Arrow batch with columns replaced, or added at the end."""
    import pyarrow as pa
    named = dict(zip(batch.schema.names, batch.columns)) | columns
    return pa.RecordBatch.from_arrays(list(named.values()), names=list(named))
