"""Near-duplicate embeddings by Euclidean p-stable hashing, and exact cosine checks.

A normalised vector is projected on random Gaussian directions; the projections, shifted and cut into cells of one
width, name its bucket in a table. Near vectors share a cell more often than unrelated ones, which lie at distance
sqrt(2): directions per table and the number of tables follow from the number of vectors, so that a bucket holds about
``LOAD`` unrelated ones and a pair just at the threshold is missed with chance ``MISS``.

Groups of many near copies fold first. A bucket's mean direction is a sum, made before any shuffle; members within half
the threshold's angle of it are all linked to each other (the angle is a metric) and become one unit: a centre, a radius
and a size. Other vectors are units of radius 0. Units, not vectors, meet in the buckets, where their half-precision
centres leave out pairs that can't be linked; a large bucket is compared piece by piece. Of the pairs left, the exact
centres decide: linked as a whole, not at all, or open - then their members are compared in blocks. So links are counted
without being listed inside a group, and nothing but one count of vectors reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souba.llm.common import replaced, written
from souba.llm.components import components

WIDTH = 2.0              # of a cell; vectors have length 1
LOAD = 512
MISS = 0.005
FOLDS = 2                # tables by which near copies fold
PIECE = 2048             # units of a bucket, or members of a unit, compared at once with as many others
BLOCK = 512              # rows of a similarity matrix at a time
SLACK = 0.002            # a cosine of half-precision vectors is less than that away
SURE = 1e-6              # radians left between what is bounded and what is checked


def meeting(distance: float) -> float:
    """Chance that two vectors at this distance fall into one cell of a direction."""
    r = WIDTH / max(distance, 1e-9)
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Directions of a table and number of tables for n vectors."""
    near, far = meeting(math.sqrt(max(2 - 2 * threshold, 0))), meeting(math.sqrt(2))
    directions = max(1, math.ceil(math.log(max(n, 1) / LOAD) / -math.log(far)))
    return directions, max(1, math.ceil(math.log(MISS) / math.log1p(-min(near**directions, 1 - 1e-9))))


def buckets(unit: np.ndarray, table: int, directions: int) -> np.ndarray:
    """Each row's bucket in a table."""
    rng = np.random.default_rng([20_011, unit.shape[1], table])
    lines, shift = rng.standard_normal((unit.shape[1], directions)), rng.uniform(0, WIDTH, directions)
    odd = rng.integers(1 << 62, size=directions, dtype=np.int64) * 2 + 1
    return (np.floor((unit @ lines + shift) / WIDTH).astype(np.int64) * odd).sum(axis=1)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length from a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose vectors (column ``vec``) have one length each."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("vec")))
        for n in np.unique(sizes):
            yield batch.filter(pa.array(sizes == n))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = []
        for v in batch.column("vec").to_pylist():
            v = np.array(v, dtype=np.float64)
            v /= np.abs(v).max()
            vectors.append((v / np.sqrt(v @ v)).tobytes())
        yield batch.set_column(batch.schema.get_field_index("vec"), "vec", pa.array(vectors, pa.binary()))


def nodes_of(vectors: DataFrame, id_column: str, embedding: str) -> DataFrame:
    """Distinct vectors: ``node``, ``least`` id, number of ``copies`` and the normalised ``vec`` as bytes of doubles."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), _doubles(embedding).alias("vec")).withColumn("node", _node(F.col("vec")))
    distinct = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    kind = vectors.schema[id_column].dataType.simpleString()
    return distinct.mapInArrow(_normalised, f"node binary, least {kind}, copies bigint, vec binary")


def _doubles(embedding: str) -> Column:
    return F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double") + 0.0)


def _node(doubles: Column) -> Column:
    """Key of a vector's value; null for one that is null, zero or empty, or holds null, NaN or infinity."""
    finite = F.forall(doubles, lambda x: F.coalesce(F.abs(x) <= 1.7976931348623157e308, F.lit(False)))     # NaN counts as larger
    return F.when(finite & F.exists(doubles, lambda x: x != 0), F.unhex(F.md5(doubles.cast("string"))))


def _partial_means(table: int, directions: int):
    """A task's sums of vectors per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}

        def flushed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k for _, k in sums], pa.int64()), pa.array([d for d, _ in sums], pa.int32()),
                                               pa.array([n for n, _ in sums.values()], pa.int64()), _bytes([v for _, v in sums.values()])],
                                              names=["key", "dim", "n", "vec"])
            sums.clear()
            return rows
        for batch in _by_length(batches):
            unit = _matrix(batch.column("vec"))
            keys, of, counts = np.unique(buckets(unit, table, directions), return_inverse=True, return_counts=True)
            order = np.argsort(of, kind="stable")
            totals = np.add.reduceat(unit[order], np.searchsorted(of[order], np.arange(len(keys))), axis=0)
            for key, n, total in zip(keys.tolist(), counts.tolist(), totals):
                old = sums.get((unit.shape[1], key))
                sums[unit.shape[1], key] = [old[0] + n, old[1] + total] if old else [n, total]
            if len(sums) * unit.shape[1] > 4_000_000:
                yield flushed()
        yield flushed()
    return run


def _mean(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, dtype=np.float64) for v in rows.column("vec").to_pylist())
    length = np.sqrt(total @ total)
    centre = total / length if length > 0 else total
    first = rows.slice(0, 1).select(["key", "dim"])
    return first.append_column("n", pa.array([sum(rows.column("n").to_pylist())])).append_column("centre", pa.array([centre.tobytes()], pa.binary()))


def _keyed(table: int, directions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            unit = _matrix(batch.column("vec"))
            yield batch.append_column("key", pa.array(buckets(unit, table, directions))).append_column("dim", pa.array([unit.shape[1]] * len(unit), pa.int32()))
    return run


def _folded(table: int, half: float):
    """The unit of vectors that are near enough to their bucket's centre, and the angle to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            unit = _matrix(batch.column("vec"))
            angle = np.arccos(np.clip((unit * _matrix(batch.column("centre"))).sum(axis=1), -1, 1))
            name = [hashlib.md5(f"{table} {d} {k}".encode()).digest() if a < half else None
                    for d, k, a in zip(batch.column("dim").to_pylist(), batch.column("key").to_pylist(), angle)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "least", "copies", "vec", "centre")), pa.array(name, pa.binary()), pa.array(angle)],
                                             names=["node", "least", "copies", "vec", "centre", "unit", "angle"])
    return run


def fold(nodes: DataFrame, directions: int, half: float) -> DataFrame:
    """``nodes`` with their ``unit`` (a lone vector is its own), its ``centre`` and the ``angle`` to it."""
    kind = nodes.schema["least"].dataType.simpleString()
    done, rest = [], nodes
    for table in range(-FOLDS, 0):
        number = table + 1000                                    # tables apart from those of the search
        sums = rest.mapInArrow(_partial_means(number, directions), "key bigint, dim int, n bigint, vec binary")
        centres = sums.groupBy("key", "dim").applyInArrow(_mean, "key bigint, dim int, n bigint, centre binary").filter("n > 1").drop("n")
        keyed = rest.mapInArrow(_keyed(number, directions), f"node binary, least {kind}, copies bigint, vec binary, key bigint, dim int")
        near = keyed.join(centres, ["key", "dim"], "left").withColumn("centre", F.coalesce("centre", "vec")).withColumn("alone", F.col("centre") == F.col("vec"))
        told = written(near.filter("not alone").mapInArrow(_folded(number, half), f"node binary, least {kind}, copies bigint, vec binary, centre binary, unit binary, angle double").union(
            near.filter("alone").select("node", "least", "copies", "vec", "centre", F.lit(None).cast("binary"), F.lit(0.0))), "folded")
        done.append(told.filter("unit is not null"))
        rest = told.filter("unit is null").select("node", "least", "copies", "vec")
    done.append(rest.select("node", "least", "copies", "vec", F.col("vec").alias("centre"), F.col("node").alias("unit"), F.lit(0.0).alias("angle")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _entries(tables: int, directions: int):
    """(table, key, dim, unit) of every vector, each once in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            unit, names = _matrix(batch.column("vec")), batch.column("unit").dictionary_encode()
            number, found = np.asarray(names.indices), []
            for table in range(tables):
                found.append(np.unique(np.stack([np.full(len(unit), table), buckets(unit, table, directions), number], axis=1), axis=0))
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(np.full(len(rows), unit.shape[1], dtype=np.int32)),
                                              names.dictionary.take(pa.array(rows[:, 2]))], names=["table", "key", "dim", "unit"])
    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves = [np.frombuffer(v, dtype=np.float64).astype(np.float16).tobytes() for v in batch.column("centre").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("centre"), "centre", pa.array(halves, pa.binary()))


def _compared(limit: float):
    """Pairs of units of a piece of a bucket, or of two pieces, that may hold a link."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit")
        names, radius = rows.column("unit").combine_chunks(), np.asarray(rows.column("radius"))
        low, high, piece = rows.column("low")[0].as_py(), rows.column("high")[0].as_py(), np.asarray(rows.column("piece"))
        left, right = (np.flatnonzero(piece == p) for p in (low, high))
        if min(len(left), len(right)) == 0 or len(rows) < 2:
            return pa.table({"a": names.slice(0, 0), "b": names.slice(0, 0)})
        centre = _matrix(rows.column("centre"), np.float16).astype(np.float32)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for at in range(0, len(left), BLOCK):
            some = left[at:at + BLOCK]
            cosine = centre[some] @ centre[right].T
            i, j = np.nonzero(cosine >= math.cos(min(math.pi, limit + radius[some].max() + radius[right].max())) - SLACK)
            value, i, j = cosine[i, j], some[i], right[j]
            keep = (value >= np.cos(np.minimum(math.pi, limit + radius[i] + radius[j])) - SLACK) & (i < j if low == high else i != j)
            found.append(np.stack([np.minimum(i, j)[keep], np.maximum(i, j)[keep]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b))})
    return run


def _decided(limit: float, threshold: float):
    """How the units of a pair are linked: as a whole, or open; pairs without a link go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(batch.column("centre_a").to_pylist(), batch.column("centre_b").to_pylist())], dtype=np.float64)
            angle, spread = np.arccos(np.clip(dots, -1, 1)), np.asarray(batch.column("radius_a")) + np.asarray(batch.column("radius_b"))
            whole = np.where(spread == 0, dots >= threshold, angle + spread < limit - SURE)
            some = whole | (spread > 0) & (angle - spread < limit + SURE)
            out = batch.select(["a", "b", "size_a", "size_b"]).append_column("whole", pa.array(whole))
            yield out.filter(pa.array(some))
    return run


def _blocks(threshold: float):
    """Members of two open units: how many copies on the other side each one is linked with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, two = row["members_a"], row["members_b"]
                x, y = (np.stack([np.frombuffer(m["vec"]) for m in side]) for side in (one, two))
                linked = x @ y.T >= threshold
                for side, counts in ((one, linked @ np.array([m["copies"] for m in two])), (two, linked.T @ np.array([m["copies"] for m in one]))):
                    hit = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([side[k]["node"] for k in hit], pa.binary()), pa.array([row["a"]] * len(hit), pa.binary()),
                                                      pa.array([row["b"]] * len(hit), pa.binary()), pa.array(counts[hit], pa.int64())], names=["node", "a", "b", "links"])
    return run


def candidate_pairs(members: DataFrame, units: DataFrame, tables: int, directions: int, limit: float) -> DataFrame:
    """Pairs (a, b) of units that share a bucket and may hold a link, each once."""
    places = members.mapInArrow(_entries(tables, directions), "table int, key bigint, dim int, unit binary").distinct()
    kind = "unit binary, centre binary, radius double, size bigint"
    sketches = units.select("unit", "centre", "radius", "size").mapInArrow(_sketched, kind).drop("size")
    places = written(places, "places")
    where = ["table", "key", "dim"]
    counts = places.groupBy(*where).agg(F.count("*").alias("n")).filter("n > 1")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    cut = places.join(counts.select(*where, pieces.alias("pieces")), where).withColumn("piece", F.pmod(F.xxhash64("unit"), F.col("pieces")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        *where, F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "unit")
    met = dealt.join(sketches, "unit").groupBy(*where, "low", "high").applyInArrow(_compared(limit), "a binary, b binary")
    return met.distinct()


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``n_links`` (other rows at a cosine of ``threshold`` or more), ``component_id`` (least id reachable
    by links, the own one included) and ``kept`` (whether that is the own id).

    Cosines are those of double precision. Vectors that are null, empty or zero, or hold null, NaN or infinity, link
    with nothing; vectors of different lengths don't link. Repeated rows and rows that share an id are vectors of their
    own, equal ones linked with each other. A null id is never the least one, nor kept. An empty table stays empty.
    Columns named like a result give way. ``threshold`` lies between 0 and 1.
    """
    limit = math.acos(threshold)
    nodes = written(nodes_of(vectors, id_column, embedding), "vectors")
    directions, tables = shape(nodes.count(), threshold)
    members = written(fold(nodes, directions, limit / 2 - SURE), "members")
    units = written(members.groupBy("unit").agg(
        F.any_value("centre").alias("centre"), F.max("angle").alias("radius"), F.sum("copies").alias("size"), F.count("*").alias("nodes"), F.min("least").alias("least")), "units")
    pairs = candidate_pairs(members.select("unit", "vec"), units, tables, directions, limit)
    for side in ("a", "b"):
        pairs = pairs.join(units.select(F.col("unit").alias(side), F.col("centre").alias(f"centre_{side}"), F.col("radius").alias(f"radius_{side}"), F.col("size").alias(f"size_{side}")), side)
    pairs = written(pairs.mapInArrow(_decided(limit, threshold), "a binary, b binary, size_a bigint, size_b bigint, whole boolean"), "pairs")

    opened = pairs.filter("not whole").select("a", "b")
    asked = opened.select(F.col("a").alias("unit")).union(opened.select("b")).distinct()
    large = units.select("unit", F.ceil(F.col("nodes") / PIECE).alias("pieces")).join(asked, "unit", "left_semi")
    lists = members.join(large, "unit").groupBy("unit", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece")).agg(
        F.collect_list(F.struct("node", "copies", "vec")).alias("members")).drop("piece")
    for side in ("a", "b"):
        opened = opened.join(lists.select(F.col("unit").alias(side), F.col("members").alias(f"members_{side}")), side)
    checked = written(opened.select("a", "b", "members_a", "members_b").mapInArrow(_blocks(threshold), "node binary, a binary, b binary, links bigint"), "checked")

    whole = pairs.filter("whole")
    links = whole.select(F.col("a").alias("unit"), F.col("size_b").alias("n")).union(whole.select("b", "size_a")).groupBy("unit").agg(F.sum("n").alias("n"))
    classes = components(whole.select("a", "b").union(checked.select("a", "b").distinct()))
    told = units.join(classes.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit")).join(links, "unit", "left")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select("unit", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component_id")
    own = checked.groupBy("node").agg(F.sum("links").alias("own"))
    result = members.select("node", "unit").join(told, "unit").join(own, "node", "left").select(
        F.col("node").alias("_link_node"), (F.col("n") + F.coalesce("own", F.lit(0))).alias("_link_n"), F.col("component_id").alias("_link_component"))
    rows = vectors.withColumn("_link_key", _node(_doubles(embedding)))
    rows = rows.join(result, F.col("_link_key") == F.col("_link_node"), "left")
    component = F.when(F.col("_link_key").isNull(), F.col(f"`{id_column}`")).otherwise(F.col("_link_component"))
    return replaced(rows, n_links=F.coalesce("_link_n", F.lit(0)), component_id=component,
                    kept=F.coalesce(F.col(f"`{id_column}`") == component, F.lit(False))).drop("_link_key", "_link_node", "_link_n", "_link_component")
