"""The corpus pipeline: grade, fold near copies, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's documents. All stages but the last return the columns of
``documents``; the last adds the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souba.llm import decontaminate, jaccard, mixing, quality, sharding
from souba.llm.common import table, written

KEEP_ABOVE = 0.5             # probability that a document is above the lowest grade
SHARD_BYTES = 1 << 20

# The classifier's training cannot be said in SQL; tests hold the other stages against brute force.
ORACLE_SQL: str | None = None


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal classifier puts above the lowest grade; fitted on labelled documents of this input."""
    model = quality.train(docs, quality.graded_labels(table(spark, sf_dir, "labels")), 3)
    return quality.grade(docs, model).filter(F.col("tail_probability") >= KEEP_ABOVE).select(*docs.columns)


def fold_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that names it, with the smallest doc_id.

    A row without an id stays; of rows that share the id all stay, being one node of the links.
    """
    classes = jaccard.near_duplicates(docs.select("doc_id", "text"))
    kept = classes.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.filter("doc_id is null")).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up less than 5 % of the words, the hit spans cut out of the others' texts."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), clean=True).filter(~F.col("contaminated"))
    text = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_hit") > 0, F.char_length("clean_text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.select(*[text.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the shard of at most one MiB that its hash puts it in."""
    return sharding.assign_shards(docs, SHARD_BYTES)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", grade_quality), ("near copies", fold_near_copies), ("decontamination", drop_benchmark), ("mix", mix_sources), ("shards", cut_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
