"""The stages of the corpus pipeline that SQL can't follow, against brute force on small documents."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = "one two three four five six seven eight nine ten red green blue black white north south east west up down".split()


def told(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd, folder = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    item = told(rnd, 20)
    plain = [told(rnd, 60) for _ in range(20)]
    near = plain[3].split()
    near[5] = "changed"
    rows = [(i, t) for i, t in enumerate(plain)] + [(30, plain[3]), (31, " ".join(near)), (32, told(rnd, 10) + " " + item), (33, told(rnd, 900) + " " + item + " " + told(rnd, 900)),
                                                    (34, None), (35, ""), (36, "short"), (37, "short")]
    docs = spark.createDataFrame([(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder, item


def test_near_copies_leave_the_smallest_id(spark, corpus):
    docs, folder, _ = corpus
    kept = corpus_pipeline.fold_near_copies(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(20), 32, 33, 34, 35, 36])


def test_benchmark_passages_go(spark, corpus):
    docs, folder, item = corpus
    kept = {r["doc_id"]: r for r in corpus_pipeline.drop_benchmark(spark, docs, folder).collect()}
    assert set(kept) == {r["doc_id"] for r in docs.collect()} - {32}
    assert item not in kept[33]["text"] and kept[33]["n_chars"] == len(kept[33]["text"])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == before[i] for i, r in kept.items() if i != 33)


def test_mix_takes_whole_copies_near_the_targets(spark, corpus):
    docs, folder, _ = corpus
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= {r["doc_id"] for r in docs.collect()} and max(times.values()) <= 2


def test_shards_keep_every_row_within_the_limit(spark, corpus, monkeypatch):
    docs, folder, _ = corpus
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 15_000)
    cut = corpus_pipeline.cut_shards(spark, docs, folder)
    assert sorted(r["doc_id"] for r in cut.collect()) == sorted(r["doc_id"] for r in docs.collect())
    sizes = cut.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.max("shard_bytes").alias("said")).collect()
    assert len(sizes) > 1 and all(r["n"] == r["said"] <= 15_000 for r in sizes)


def test_empty_table(spark, corpus):
    docs, folder, _ = corpus
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), folder).count() == 0
