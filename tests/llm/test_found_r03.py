"""What the third round found in the operators for training data."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from souba.llm import decontaminate, jaccard


def test_index_keys_grow_with_the_set_and_not_with_its_square():
    """op9_jaccard, pipeline: all shingles frequent, as in a large group of near copies."""
    for n in (100, 1000, 20_000):
        tokens = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert len(jaccard.index_keys(tokens, np.full(n, 2, dtype=np.int8), 75)) <= 6 * n


@pytest.mark.parametrize("percent", [20, 50, 75, 90])
def test_similar_sets_have_a_key_in_common(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        size = int(rng.choice([1, 2, 3, 5, 8, 13, 40, 150, 600]))
        pool = rng.integers(0, 1 << 63, 2 * size + 2).astype(np.uint64)
        shared = int(rng.integers(1, size + 1))
        one, two = pool[:size], pool[size - shared:size - shared + int(rng.integers(shared, size + 1))]
        if 100 * shared < percent * (len(one) + len(two) - shared):
            continue
        rank = {int(t): r for t, r in zip(pool, rng.choice([1, 2], len(pool), p=[0.1, 0.9]) if rng.random() < 0.5 else np.full(len(pool), 2))}
        keys = [jaccard.index_keys(s, np.array([rank[int(t)] for t in s], dtype=np.int8), percent) for s in (np.sort(one), np.sort(two))]
        assert np.intersect1d(*keys).size


def test_a_context_shown_twice_is_merged_once():
    """op8_suffixes: contexts move once, and those that come from two tasks meet where they are merged."""
    from souba.llm import suffixes
    one, other = bytes(range(256)), bytes(range(255, -1, -1))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 8]), pa.array([1, 1, 2]), pa.array([one, one, other + other])], names=["anchor", "content", "bytes"])
    found = [r for b in suffixes._merge(iter([batch])) for r in b.to_pylist()]
    assert [(r["anchor"], r["spans"]) for r in found] == [(7, []), (8, [0, 512])]


def test_a_text_moves_once_to_its_spans(spark):
    from souba.llm import suffixes
    docs = spark.createDataFrame([(1, "a" * 300), (2, None)], "doc_id bigint, text string")
    found = suffixes.remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()) == [(1, "a" * 300, 300), (2, None, 0)]
    scanned = found.select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _text" in scanned and not re.search(r"text#\d+, text#\d+ AS _text", scanned)


def test_decontamination_keeps_one_python_process_a_core(spark, documents):
    """pipeline, op7_decontaminate: the pass and the results are one step in Python; the rows are those of two."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("1", " ".join(words[:13])), ("2", "only five words in it")], "item_id string, text string")
    texts = [" ".join(words), "other text", None, "", *["x " + " ".join(words[:13])] * decontaminate.ROWS]
    found = decontaminate.find_hits(documents(list(enumerate(texts))).coalesce(1), items, clean=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["clean_text"]) for r in found.collect()}
    assert len(got) == len(texts)
    assert got[0] == (40, 13, ["1"], " " + " ".join(words[13:]))
    assert [got[i] for i in (1, 2, 3)] == [(2, 0, [], "other text"), (0, 0, [], None), (0, 0, [], "")]
    assert all(got[i] == (14, 13, ["1"], "x ") for i in range(4, len(texts)))
