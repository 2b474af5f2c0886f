"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Documents of equal sets form one class with
one representative. First, near copies are collapsed: representatives that agree in a pair of minimum hashes are
compared with the most central of them, the one whose minimum hashes most others share, and verified links make
groups. Then the join proper finds every link between different groups:

* all shingles have one global order by class: private ones (of one group only), rare ones, frequent ones (of many
  groups), each by hash;
* a set's prefix is long enough that two similar sets must share in it a shingle that is not frequent, or c + 1 frequent
  ones: it is extended by c when it reaches frequent shingles;
* rare shingles of a prefix are index keys one by one; frequent ones have one of c colours, and pairs of one colour are
  keys: of c + 1 shared shingles two have the same. Private shingles need no key;
* c grows with the set, so that keys are some two for a shingle and not the square of the prefix, and a pair of sets meets
  in few of them. Two sets use the c of the larger one, so a set has the keys of each size that a similar set may have;
* documents of different groups with a key in common, and of fitting sizes, are verified on their whole sets.

Two documents compared with the same centre need no keys: what each shares with the centre, and how many of its other
shingles are not private, bounds what they can share with each other; only pairs within that bound are verified. This
keeps the members of a large group of loose copies, too far apart to link, from meeting in every shingle they share.

Any classing of shingles gives the same result, so classes come from bitmaps of fixed size: hash collisions, and a
table that outgrows them, cost time but no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm import bitmaps
from souba.llm.common import written
from souba.llm.components import components

WORDS = 5                # in a shingle
SPARED = 4               # colours, at most, for so many shingles shared by similar sets
FREQUENT = 16            # groups a shingle is in, to be frequent
BANDS = 8                # pairs of minimum hashes near copies are collapsed by
CODE_BITS = 24           # that tell shingles of one bucket apart, to class them
FLUSH = 500_000          # shingles a task holds before it passes them on
_MULTIPLIERS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 2 * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words met so far; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: A-Z lower-cased, words split at ASCII white space.

    Fewer than five words make one shingle; null, empty and blank texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = h * _BASE + w[i:len(w) - size + 1 + i]
    return np.unique(_mixed(h))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any similar one."""
    return -(-n * percent // 100)


def _mapped(df: DataFrame, function: Callable[..., Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    return df.mapInArrow(function, schema)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHashes()
    for batch in batches:
        sizes, high, low, bands = [], [], [], []
        for text in batch.column("_text"):
            s = shingles(text.as_py(), cache)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            sizes.append(len(s))
            high.append(int.from_bytes(digest[:8], "little", signed=True))
            low.append(int.from_bytes(digest[8:], "little", signed=True))
            least = (s * _MULTIPLIERS[:, None]).min(axis=1) if len(s) else np.zeros(2 * BANDS, dtype=np.uint64)     # shingles are mixed already
            bands.append((_mixed(least[::2] * _BASE + least[1::2]) + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                                          pa.array(bands, pa.list_(pa.int64()))], names=["key", "n", "high", "low", "bands"])


def _sets(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bitmap = _WordHashes(), shared.value
        for batch in batches:
            wanted = np.flatnonzero(bitmaps.has(bitmap, batch.column("_place").to_numpy()))
            for at in range(0, len(wanted), 256):
                part = batch.take(pa.array(wanted[at:at + 256]))
                packed = [shingles(t.as_py(), cache).tobytes() for t in part.column("_text")]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(packed, pa.binary())], names=["key", "set"])
    return build


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, ones, others = [], [], []
        for one, other in zip(batch.column("one"), batch.column("other")):
            a, b = np.frombuffer(one.as_buffer(), dtype=np.uint64), np.frombuffer(other.as_buffer(), dtype=np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            counts.append(int(np.count_nonzero(both[1:] == both[:-1])))
            ones.append(len(a))
            others.append(len(b))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (counts, ones, others))],
                                         names=["a", "b", "shared", "n_a", "n_b"])


def overlaps(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) with what their whole sets share and their sizes (``shared``, ``n_a``, ``n_b``); sets are
    built only for documents that may be in a pair."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    shared = spark.sparkContext.broadcast(bitmaps.of_keys(ids, "key"))     # a fixed size
    kind = docs.schema["_key"].dataType
    sets = _mapped(docs.withColumn("_place", bitmaps.place("_key")), _sets(shared), StructType([StructField("key", kind), *StructType.fromDDL("set binary").fields]))
    sets = sets.dropDuplicates(["key"])
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("one")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("set").alias("other")), "b")
    schema = StructType([StructField("a", kind), StructField("b", kind), *StructType.fromDDL("shared bigint, n_a bigint, n_b bigint").fields])
    return _mapped(joined.select("a", "b", "one", "other"), _share, schema)


def similar(compared: DataFrame, percent: int) -> DataFrame:
    """The links among compared pairs."""
    return compared.filter(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).select("a", "b")


def _count(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, shingles in three bytes each, place of each one's group, groups)."""
    def emit(held: list[np.ndarray], groups: list[int]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(held)
        whose = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        code = (tokens >> np.uint64(64 - bits - CODE_BITS)).astype(np.uint32)[order]
        starts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        whose, named = whose[order], np.array(groups, dtype=np.int64)
        for b in np.flatnonzero(np.diff(starts)):
            part = slice(starts[b], starts[b + 1])
            used, place = np.unique(whose[part], return_inverse=True)
            three = code[part].view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([three], pa.binary()),
                                              pa.array([place.astype(np.uint16).tobytes()], pa.binary()), pa.array([named[used].tobytes()], pa.binary())],
                                             names=["bucket", "codes", "whose", "groups"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, groups, size = _WordHashes(), [], [], 0
        for batch in batches:
            for text, group in zip(batch.column("_text"), batch.column("_group").to_pylist()):
                s = shingles(text.as_py(), cache)
                if len(s):
                    held.append(s)
                    groups.append(group)
                    size += len(s)
                if size >= FLUSH or len(held) == 1 << 16:
                    yield from emit(held, groups)
                    held, groups, size = [], [], 0
        if held:
            yield from emit(held, groups)
    return count


def _classes(bits: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket's slices of the bitmaps of shared and of frequent shingles."""
    def classify(table: pa.Table) -> pa.Table:
        codes, groups = [], []
        for code, whose, named in zip(*(table.column(c) for c in ("codes", "whose", "groups"))):
            three = np.frombuffer(code.as_buffer(), dtype=np.uint8).reshape(-1, 3)
            codes.append(np.pad(three, ((0, 0), (0, 1))).view(np.uint32).ravel())
            groups.append(np.frombuffer(named.as_buffer(), dtype=np.int64)[np.frombuffer(whose.as_buffer(), dtype=np.uint16)])
        code, group = np.concatenate(codes), np.concatenate(groups)
        order = np.lexsort((group, code))
        code, group = code[order], group[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])
        fresh = first | np.concatenate([[True], group[1:] != group[:-1]])
        starts = np.flatnonzero(first)
        n_groups = np.add.reduceat(fresh.astype(np.int64), starts)
        place = (code[starts] >> np.uint32(CODE_BITS + bits - bitmaps.BITS)).astype(np.int64)
        slices = []
        for least in (2, FREQUENT):
            slices.append(pa.array([bitmaps.packed(place[n_groups >= least], bitmaps.BITS - bits)], pa.binary()))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "shared": slices[0], "frequent": slices[1]})
    return classify


def shingle_classes(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the shingles that several groups have, and of those that many have (``docs``: _text, _group)."""
    bits = max(6, min(bitmaps.BITS - 3, (total >> 21).bit_length()))     # one or two million shingles a bucket
    rows = _mapped(docs.select("_text", "_group"), _count(bits), "bucket bigint, codes binary, whose binary, groups binary")
    found = rows.groupBy("bucket").applyInArrow(_classes(bits), "bucket bigint, shared binary, frequent binary")
    shared, frequent = bitmaps.assembled(found.collect(), ["shared", "frequent"], bits)
    return shared, frequent


def classed(tokens: np.ndarray, shared: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The class of each shingle: 0 private, 1 rare, 2 frequent."""
    place = (tokens >> np.uint64(64 - bitmaps.BITS)).astype(np.int64)
    return bitmaps.has(shared, place).astype(np.int8) + bitmaps.has(frequent, place)


def colours(n: int, percent: int) -> int:
    """Colours of frequent shingles where the larger of two sets has n: fewer than similar sets share, a power of four."""
    shared = least_overlap(n, percent)
    return 0 if shared < 2 else 1 << 2 * ((max(shared // SPARED, 1).bit_length() - 1) // 2)


def coloured_pairs(tokens: np.ndarray, c: int) -> np.ndarray:
    """A key for each pair of sorted shingles of the same of c colours; without colours, for each shingle."""
    if c == 0:
        return tokens
    colour = tokens & np.uint64(c - 1)
    order = np.argsort(colour, kind="stable")
    tokens, colour = tokens[order], colour[order]
    later = np.searchsorted(colour, colour, side="right") - np.arange(len(tokens)) - 1
    one = np.repeat(np.arange(len(tokens)), later)
    other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
    return _mixed(tokens[one] * _BASE + tokens[other] + np.uint64(c))


def index_keys(tokens: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of one set (see the module's text) from its sorted shingles and their classes."""
    order = np.argsort(rank, kind="stable")
    rank, tokens = rank[order], tokens[order]
    needed = len(tokens) - least_overlap(len(tokens), percent) + 1
    plain = int(np.searchsorted(rank, 2))
    if plain >= needed:
        return tokens[:needed][rank[:needed] > 0]
    keys, c, most = [tokens[:plain][rank[:plain] > 0]], colours(len(tokens), percent), colours(len(tokens) * 100 // percent, percent)
    while c <= most:
        keys.append(coloured_pairs(tokens[plain:needed + c], c))
        c = max(1, c * 4)
    return np.concatenate(keys)


def _postings(shared, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each index key of a document, and one without a key; ``open`` is the number of its shared shingles."""
    def rows(batch: pa.RecordBatch, whose: list[int], keys: list[np.ndarray], sizes: list[int], shared_: list[int]) -> pa.RecordBatch:
        times = [1 + len(k) for k in keys]
        ends = np.cumsum(times)
        none = np.zeros(ends[-1], dtype=bool)
        none[ends - times] = True
        values = np.zeros(ends[-1], dtype=np.int64)
        values[~none] = np.concatenate(keys).view(np.int64)
        again = pa.array(np.repeat(whose, times))
        return pa.RecordBatch.from_arrays([pa.array(values, mask=none), *(batch.column(c).take(again) for c in ("_key", "_group", "_ref")),
                                           pa.array(np.repeat(sizes, times), pa.int64()), pa.array(np.repeat(shared_, times), pa.int64())],
                                          names=["token", "key", "group", "ref", "n", "open"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (several, many) = _WordHashes(), shared.value
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column("_text")):
                s = shingles(text.as_py(), cache)
                rank = classed(s, several, many)
                held.append((i, index_keys(s, rank, percent) if len(s) else s, len(s), int(np.count_nonzero(rank))))
                size += 1 + len(held[-1][1])
                if size >= 50_000:
                    yield rows(batch, *map(list, zip(*held)))
                    held, size = [], 0
            if held:
                yield rows(batch, *map(list, zip(*held)))
    return post


def _fits(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def star_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Each representative ``b`` beside the most central one ``a`` of each band it is in; ``weight`` says how central.

    A representative is as central as its bands are large. The centre of a band stands beside itself as well.
    """
    banded = reps.select("key", "n", F.explode("bands").alias("band"))
    large = banded.groupBy("band").agg(F.count("*").alias("many")).filter("many > 1")
    banded = written(banded.join(large, "band"), "bands")
    weighed = banded.groupBy("key").agg(F.sum("many").alias("weight"))
    banded = banded.join(weighed, "key")
    heads = banded.groupBy("band").agg(F.min(F.struct(-F.col("weight"), F.col("key"), F.col("n"))).alias("head"))
    heads = heads.select("band", F.col("head.key").alias("a"), F.col("head.n").alias("m"), (-F.col("head.col1")).alias("top"))
    near = banded.join(heads, "band").filter(_fits("n", "m", percent))
    return near.groupBy("a", F.col("key").alias("b")).agg(F.max("top").alias("weight"))


def cross_pairs(keyed: DataFrame, centred: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different groups that may be similar: with an index key in common, or near one centre.

    ``keyed`` has a row per index key; ``centred`` a row per document with a centre, what it shares with it
    (``overlap``) and the most it may share with other groups beside (``other``).
    """
    mixed = keyed.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("token")
    useful = keyed.join(mixed, "token", "left_semi")

    def sides(df: DataFrame, by: str, *names: str) -> tuple[DataFrame, DataFrame]:
        one, two = (df.select(by, *[F.col(c).alias(f"{c}{s}") for c in names]) for s in "12")
        return one, two
    one, two = sides(useful, "token", "key", "group", "n", "ref")
    apart = (F.col("group1") < F.col("group2")) & _fits("n1", "n2", percent)
    far = one.join(two, "token").filter(apart & ~F.coalesce(F.col("ref1") == F.col("ref2"), F.lit(False)))
    several = centred.groupBy("ref").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("ref")
    one, two = sides(centred.join(several, "ref", "left_semi"), "ref", "key", "group", "n", "overlap", "other")
    most = F.least("overlap1", "overlap2") + F.least("other1", "other2")
    near = one.join(two, "ref").filter(apart & (most * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent))
    return far.select("key1", "key2").union(near.select("key1", "key2")).select(
        F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) per row of ``docs``.

    Two sets link when 100 * intersection >= percent * union. Documents without words link with nothing. Rows that
    share a key are one node of the links. A row without a key is no node: its component is null. An empty table gives
    an empty result. Whole texts are used, whatever their length.
    """
    kind = docs.schema[key].dataType
    named = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = StructType([StructField("key", kind), *StructType.fromDDL("n bigint, high bigint, low bigint, bands array<bigint>").fields])
    signed = written(_mapped(named, _sign, schema), "signatures")
    full = signed.filter("key is not null and n > 0")
    classes = full.groupBy("high", "low").agg(F.min(F.struct("key", "n", "bands")).alias("rep"))
    reps = written(classes.select("rep.*").groupBy("key").agg(F.max("n").alias("n"), F.flatten(F.collect_list("bands")).alias("bands")), "representatives")
    known = named.filter("_key is not null")
    copies = full.join(classes.select("high", "low", F.col("rep.key").alias("a")), ["high", "low"]).select("a", F.col("key").alias("b")).filter("a <> b")
    stars = written(star_pairs(reps, percent), "starpairs")
    compared = written(overlaps(stars.filter("a <> b").select("a", "b"), known), "compared")
    near = similar(compared, percent)
    groups = written(components(near), "groups")
    # the most central one a document was compared with, and what it shares with it
    centres = compared.select("a", "b", "shared").join(stars, ["a", "b"]).union(
        stars.filter("a = b").join(reps.select(F.col("key").alias("a"), F.col("n").alias("shared")), "a").select("a", "b", "shared", "weight"))
    centres = centres.groupBy("b").agg(F.max(F.struct("weight", "a", "shared")).alias("c")).select(
        F.col("b").alias("key"), F.col("c.a").alias("ref"), F.col("c.shared").alias("overlap"))
    member = groups.select(F.col("node").alias("key"), "component")
    placed = reps.select("key", "n").join(member, "key", "left").join(centres, "key", "left").join(
        groups.select(F.col("node").alias("ref"), F.col("component").alias("ref_component")), "ref", "left")
    placed = written(placed.select("key", "n", "overlap", F.when(F.col("ref").isNotNull(), F.xxhash64("ref")).alias("ref"),
                                   F.xxhash64(F.coalesce("component", "key")).alias("group"),
                                   F.when(F.col("ref").isNotNull(), F.xxhash64(F.coalesce("ref_component", "ref"))).alias("ref_group")), "placed")
    grouped = known.join(placed.select(F.col("key").alias("_key"), F.col("group").alias("_group"), F.col("ref").alias("_ref")), "_key")
    grouped = written(grouped, "grouped")
    spark: SparkSession = docs.sparkSession
    classes_ = spark.sparkContext.broadcast(shingle_classes(grouped, placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))   # a fixed size
    posted = _mapped(grouped, _postings(classes_, percent), StructType([
        *StructType.fromDDL("token bigint").fields, StructField("key", kind), *StructType.fromDDL("group bigint, ref bigint, n bigint, open bigint").fields]))
    posted = written(posted, "postings")
    own = posted.filter("token is null").drop("token")
    # Shingles a document has beside the centre's and may share with other groups. If the centre is of another group,
    # none it shares with the centre is private: all others that are not. If it is of the same group, some it shares
    # with the centre may be private, but no more than the centre has.
    centres = own.select(F.xxhash64("key").alias("ref"), (F.col("n") - F.col("open")).alias("private"))
    centred = own.filter("ref is not null").join(placed.select("key", "overlap", (F.col("group") != F.col("ref_group")).alias("outside")), "key").join(centres, "ref")
    free = F.col("open") - F.col("overlap")
    centred = centred.withColumn("other", F.when(F.col("outside"), free).otherwise(F.least(F.col("n") - F.col("overlap"), free + F.col("private"))))
    pairs = written(cross_pairs(posted.filter("token is not null"), centred, percent), "crosspairs")
    far = similar(overlaps(pairs, known), percent)
    linked = components(near.union(far).union(copies))
    out = signed.join(linked.withColumnRenamed("node", "key"), "key", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
