"""Extendible hashing: shards named by hash prefixes, split bit by bit until each fits a byte limit.

The directory maps every hash prefix of the current depth to the shallowest bucket that fits. It is built from byte
sums per prefix, 12 bits at a time: only buckets still too large after one round are counted on 12 more bits in the
next, so a directory round never holds more than 4,096 entries per oversized bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souba.llm.common import HASH_BITS, hash60, replaced, written

ROUND_BITS = 12


def _cell(bits: int) -> Column:
    return F.shiftright(F.col("_h"), HASH_BITS - bits)


def _directory(cells: DataFrame, low: int, bits: int, max_bytes: int) -> DataFrame:
    """The shallowest bucket of depth ``low`` to ``bits`` that fits, for each cell; depth null where none does."""
    paths = cells.select("_cell", "_bytes", "_docs", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("_depth"))
    paths = paths.withColumn("_node", F.expr(f"shiftright(_cell, {bits} - _depth)"))
    nodes = paths.groupBy("_depth", "_node").agg(F.sum("_bytes").alias("_b"), F.sum("_docs").alias("_n"))
    fits = paths.select("_cell", "_depth", "_node").join(nodes, ["_depth", "_node"])
    best = F.min(F.when((F.col("_b") <= max_bytes) | (F.lit(bits) == HASH_BITS) & (F.col("_depth") == HASH_BITS),
                        F.struct("_depth", "_node", "_b", "_n")))
    return fits.groupBy("_cell").agg(best.alias("_bucket")).select("_cell", "_bucket.*")


def assign_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (``s`` and the bits of its bucket), ``shard_depth``, ``shard_bytes``, ``shard_docs``.

    Bytes are those of the text in UTF-8; a null or empty text has none. Rows of one key (null is a key) share all
    hash bits, so they stay together; where they alone exceed the limit, their bucket ends at depth 60 with
    ``shard_bytes`` above it. No other shard exceeds ``max_bytes``. An empty table has no shards. Columns named like
    a result give way to it. The result depends on the rows only, not on how they are partitioned.
    """
    sized = docs.select(hash60(F.col(key).cast("string")).alias("_h"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_size"))
    rounds: list[DataFrame] = []
    bits = 0
    while bits < HASH_BITS:
        low, bits = (0 if bits == 0 else bits + 1), bits + ROUND_BITS
        cells = sized.groupBy(_cell(bits).alias("_cell")).agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_docs"))
        directory = written(_directory(cells, low, bits, max_bytes), f"directory{bits}")
        rounds.append(directory)
        over = directory.filter("_depth is null").select("_cell")
        if over.isEmpty():
            break
        if bits < HASH_BITS:
            sized = sized.withColumn("_cell", _cell(bits)).join(over, "_cell", "left_semi").drop("_cell")
            if len(rounds) == 1:
                sized = written(sized, "oversized")
    rest, done = docs.withColumn("_h", hash60(F.col(key).cast("string"))), []
    for k, directory in enumerate(rounds):
        bound = (k + 1) * ROUND_BITS
        entries = F.broadcast(directory) if k == 0 else directory  # the first round has at most 4,096 rows
        rest = rest.withColumn("_cell", _cell(bound)).join(entries, "_cell").drop("_cell")
        if k + 1 < len(rounds):
            done.append(rest.filter("_depth is not null"))
            rest = rest.filter("_depth is null").drop("_depth", "_node", "_b", "_n")
    for part in done:
        rest = rest.unionByName(part)
    bits_text = F.when(F.col("_depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(conv(cast(_node as string), 10, 2), _depth, '0')"))
    out = replaced(rest, shard=F.concat(F.lit("s"), bits_text), shard_depth=F.col("_depth").cast("int"),
                   shard_bytes=F.col("_b"), shard_docs=F.col("_n"))
    return out.drop("_h", "_depth", "_node", "_b", "_n")
