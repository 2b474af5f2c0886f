"""Bitmaps of fixed size over hashes: membership that may err towards yes, so only ever used to leave work out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26                # of a bitmap's size in bits: 8 MiB, however large the input


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at ``places`` are set in a packed bitmap."""
    return (bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def packed(places: np.ndarray, bits: int) -> bytes:
    """2^bits bits, those at ``places`` set."""
    flags = np.zeros(1 << bits, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags).tobytes()


def assembled(rows, names: list[str], bits: int) -> list[np.ndarray]:
    """Whole bitmaps from rows with a ``bucket`` (the first ``bits`` bits of the place) and packed slices by name."""
    out, step = [np.zeros(1 << BITS - 3, dtype=np.uint8) for _ in names], 1 << BITS - bits - 3
    for row in rows:
        for bitmap, name in zip(out, names):
            bitmap[row["bucket"] * step:(row["bucket"] + 1) * step] = np.frombuffer(row[name], dtype=np.uint8)
    return out


def place(*columns: str | Column) -> Column:
    """A key's place in a bitmap of 2^BITS."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def of_keys(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the keys' places."""
    return of_places(keys.select(place(column).alias("bit")), "bit")


def of_places(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap of given places, packed on the executors in slices of 8 KiB."""
    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[table.column("at").to_numpy()] = 1
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})
    places = keys.select(F.col(column).cast("bigint").alias("bit")).distinct().select(F.shiftright("bit", 16).alias("part"), F.col("bit").bitwiseAND(0xFFFF).alias("at"))
    out = np.zeros(1 << BITS >> 3, dtype=np.uint8)
    for row in places.groupBy("part").applyInArrow(pack, "part bigint, bits binary").collect():
        out[row["part"] << 13:row["part"] + 1 << 13] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def only(df: DataFrame, bitmap: np.ndarray, *columns: str | Column) -> DataFrame:
    """The rows whose key is in a bitmap, and now and then another; nothing moves."""
    shared, schema = df.sparkSession.sparkContext.broadcast(bitmap), df.schema

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(shared.value, batch.column("_place").to_numpy()))).drop_columns(["_place"])
    return df.withColumn("_place", place(*columns)).mapInArrow(keep, schema)
