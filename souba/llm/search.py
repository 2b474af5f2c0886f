"""Ranked lexical search of many items at once, over the term sets that the items share.

A score is a sum over an item's terms, so what several items have in common is added up once for all of them:

* Items are dealt to blocks of bounded size by a hash of their id. Terms with the same items of a block are one node.
* Adjacent nodes of items (each in the order of how many items share a node) that follow each other in several items
  become a node of their own, round by round, until no pair comes twice. The nodes form a DAG: a node adds up two
  earlier ones, an item the few nodes left of it.
* Documents become postings once per block (written as a table): their length and, for the block's terms, the
  frequencies. Counts over the postings give the document frequencies.
* A task scores its documents in slices: postings add up to the nodes of terms, one slice-wide addition per node fills
  the DAG from below, and an item's scores are the sums of its nodes. It hands on its best documents per item only, and
  a window picks the best of those.

Scores are whole numbers, so that no order of addition changes them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souba.llm.common import written

BLOCK_BYTES = 4 << 20       # of a block's terms, each with 16 bytes beside it
SLICE_BYTES = 64 << 20      # of the accumulators a task holds
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: Column) -> Column:
    """All terms of a text, in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Plan:
    """How a block's items are added up: nodes 0 to ``n_terms`` - 1 are sets of terms, later ones the sum of two nodes."""

    items: pa.Array                                  # ids
    vocabulary: list[str]
    node_of: np.ndarray                              # of each term
    levels: list[tuple[np.ndarray, np.ndarray]]      # pairs of nodes that new nodes, numbered on, add up
    parts: np.ndarray                                # nodes of the items, one item after the other
    starts: np.ndarray
    nodes: int


def shared_plan(items: pa.Array, item: np.ndarray, term: np.ndarray, vocabulary: list[str]) -> Plan:
    """The DAG of a block; ``item`` and ``term`` number the items and terms of each distinct pair."""
    order = np.lexsort((item, term))
    item, term = item[order], term[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    holders = np.split(item, cuts)
    sets: dict[bytes, int] = {}
    node_of = np.array([sets.setdefault(h.tobytes(), len(sets)) for h in holders], dtype=np.int64)
    first = np.unique(node_of, return_index=True)[1]
    members = [holders[i] for i in first]
    node = np.repeat(np.arange(len(members)), [len(m) for m in members])
    holder = np.concatenate(members)
    popular = -np.repeat([len(m) for m in members], [len(m) for m in members])
    order = np.lexsort((node, popular, holder))
    node, holder = node[order], holder[order]
    levels, nodes = [], len(members)
    while len(node) > 1:
        key = node[:-1] * nodes + node[1:]
        inside = holder[:-1] == holder[1:]
        name, count = np.unique(key, return_inverse=True, return_counts=True)[1:]
        weight = np.where(inside, count[name] * (len(count) + 1) + name, -1)       # a pair gives way to a more frequent neighbour
        wins = inside & (count[name] > 1)
        wins[1:] &= weight[1:] > weight[:-1]
        wins[:-1] &= weight[:-1] >= weight[1:]
        used = np.bincount(name[wins], minlength=len(count))
        wins &= used[name] > 1
        at = np.flatnonzero(wins)
        if not len(at):
            break
        pairs, made = np.unique(key[at], return_inverse=True)
        levels.append((pairs // nodes, pairs % nodes))
        node[at] = nodes + made
        keep = np.ones(len(node), dtype=bool)
        keep[at + 1] = False
        node, holder, nodes = node[keep], holder[keep], nodes + len(pairs)
    starts = np.searchsorted(holder, np.arange(len(items)))
    return Plan(items, vocabulary, node_of, levels, node, starts, nodes)


def plans(items: DataFrame, item_id: str, text: str, block_bytes: int) -> DataFrame:
    """Rows (block, plan) of the items that have terms; rows of one id are one item, a term counts once."""
    pairs = written(items.select(F.col(f"`{item_id}`").alias("item"), F.explode(F.array_distinct(terms(F.col(f"`{text}`")))).alias("term")).distinct(), "terms")
    total = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-total // block_bytes))))

    def build(table: pa.Table) -> pa.Table:
        item, term = table.column("item").combine_chunks(), table.column("term").combine_chunks()
        ids, words = item.unique().sort(), term.unique().sort()
        number = lambda values, of: np.asarray(pc.index_in(values, of, skip_nulls=False), dtype=np.int64)
        plan = shared_plan(ids, number(item, ids), number(term, words), words.to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "plan": pa.array([pickle.dumps(plan)], pa.large_binary()).cast(pa.binary())})
    return pairs.withColumn("block", block).groupBy("block").applyInArrow(build, "block bigint, plan binary")


def _postings(broadcast):
    """Rows of documents with terms: the number of their terms, and number and frequency of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i + 1 for i, w in enumerate(broadcast.value.vocabulary)}
        width = len(number) + 1
        for batch in batches:
            split = [(t or b"").translate(FOLD).split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(words) for words in split], dtype=np.int64)
            own = [np.fromiter(filter(None, map(number.get, words)), dtype=np.int64) for words in split]
            key, tf = np.unique(np.concatenate([i * width + terms for i, terms in enumerate(own)]) if own else np.zeros(0, np.int64), return_counts=True)
            at = np.searchsorted(key // width, np.arange(len(split) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(values)) for values in ((key % width - 1).astype(np.int32), tf.astype(np.int64))]
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "term", "tf"])
            yield made.filter(pa.array(n > 0))
    return run


def _best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, item: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's first ``top`` rows by falling score, then doc_id, null last."""
    order = np.lexsort((doc, null, -score, item))
    of = item[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < top]


def _scored(broadcast, top: int):
    """A task's best documents of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight, n_docs, n_terms = broadcast.value
        wide = max(1, SLICE_BYTES // (8 * (plan.nodes + len(plan.parts) + len(plan.starts))))
        enough = np.ones(len(plan.starts), dtype=np.int64)          # least score that may still be among the best
        kept = [np.zeros(0, np.int64)] * 4                          # score, doc, null, item
        for batch in batches:
            for low in range(0, batch.num_rows, wide):
                part = batch.slice(low, wide)
                lists = part.column("term")
                size = np.diff(np.asarray(lists.offsets))
                term, tf = np.asarray(lists.flatten()), np.asarray(part.column("tf").flatten())
                length = np.array([50 + 50 * x * n_docs // n_terms for x in part.column("n").to_pylist()], dtype=np.int64)
                col = np.repeat(np.arange(len(size)), size)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[col]))
                acc = np.zeros((plan.nodes, len(size)), dtype=np.int64)
                np.add.at(acc.reshape(-1), plan.node_of[term] * len(size) + col, gain)
                at = plan.nodes - sum(len(a) for a, _ in plan.levels)
                for a, b in plan.levels:
                    np.add(acc[a], acc[b], out=acc[at:at + len(a)])
                    at += len(a)
                score = np.add.reduceat(acc[plan.parts], plan.starts, axis=0)
                item, doc = np.nonzero(score >= enough[:, None])
                ids = part.column("doc_id")
                null = np.asarray(ids.is_null())
                ids = np.asarray(ids.fill_null(0))
                kept = [np.concatenate(x) for x in zip(kept, (score[item, doc], ids[doc], null[doc].astype(np.int64), item))]
                if len(kept[0]) > 4 * top * len(plan.starts):
                    kept = [x[_best(*kept, top)] for x in kept]
                    full = np.bincount(kept[3], minlength=len(enough)) == top
                    last = np.searchsorted(kept[3], np.flatnonzero(full), side="right") - 1
                    enough[full] = kept[0][last]
        kept = [x[_best(*kept, top)] for x in kept]
        yield pa.RecordBatch.from_arrays([plan.items.take(pa.array(kept[3])), pa.array(kept[1], mask=kept[2] > 0), pa.array(kept[0])], names=["item_id", "doc_id", "score"])
    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``top`` best documents with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, of whole texts, A to Z lower-cased. A document's
    score is the sum over the item's distinct terms of w * ((10^9 * tf) div (1000 * tf + 20 * m)), with
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 * n * N) div L: N documents with terms, L terms in all,
    n terms of the document, tf of them the term, df documents with the term. Equal scores rank by ``doc_id``, null last;
    rows that share an id rank each for itself. Null and empty texts have no terms: such documents count for nothing,
    such items find nothing. Item rows of one id (null is one, too) are one item. Where either table is empty, so is the
    result. No other column is looked at. The driver and each task hold one block's plan of at most about ``block_bytes``.
    """
    spark, tasks = docs.sparkSession, []
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    built = written(plans(items, item_id, item_text, block_bytes), "plans")
    for block in [r["block"] for r in built.select("block").collect()]:
        plan: Plan = pickle.loads(built.filter(F.col("block") == block).first()["plan"])
        shipped = spark.sparkContext.broadcast(plan)
        posted = written(rows.mapInArrow(_postings(shipped), "doc_id bigint, n bigint, term array<int>, tf array<bigint>"), "postings")
        shipped.unpersist()
        n_docs, n_terms = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(plan.vocabulary), dtype=np.int64)
        for term, df in posted.select(F.explode("term").alias("term")).groupBy("term").count().collect():      # at most the block's terms
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        plan.vocabulary = []
        shipped = spark.sparkContext.broadcast((plan, weight, n_docs, n_terms))
        kind = items.schema[item_id].dataType.simpleString()
        tasks.append(written(posted.mapInArrow(_scored(shipped, top), f"item_id {kind}, doc_id bigint, score bigint"), "found"))
        shipped.unpersist()
    if not tasks:
        return items.select(F.col(f"`{item_id}`").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    found = tasks[0]
    for more in tasks[1:]:
        found = found.union(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
