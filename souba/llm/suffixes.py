"""Suffix-array dedup: remove every byte inside a 200-byte string that starts anywhere else, on the input as it was.

Equal strings are brought together first. The anchor of a 200-byte string is its 16-byte piece with the smallest hash,
pieces known to be very frequent coming after all others; equal strings have equal anchors. Starts in a row with one
anchor make a context, the bytes of all their strings. Contexts that occur twice are repeated throughout. Where
several different contexts have one anchor, the order of their suffixes is found by refining blocks of equal prefixes,
each round but the first comparing up to twice the length of the one before: an interleave of the contexts, but one whose rounds sort the
blocks' rows by ranks instead of reading a Burrows-Wheeler transform of each shard. Only rows of blocks with two rows or
more move; a block that is left at 200 bytes is a repeated interval.

An anchor with more than MAX_CONTEXTS different contexts would make one large task; its strings are compared by their
128-bit hashes instead, each string a key of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm import bitmaps
from souba.llm.common import with_columns, written

LENGTH = 200
PIECE = 16
FREQUENT = 1024          # places at which a piece is an anchor, to be passed over
MAX_CONTEXTS = 4096      # of one anchor, merged in one task
MAX_STARTS = 256         # of one context
MERGE_BYTES = 1 << 20    # merged at once, at least one anchor
FIRST = 7                # symbols that the first round of a merge compares
FLUSH = 1_000_000        # anchors a task holds before it passes them on
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(1 << 63)


def piece_hashes(raw: np.ndarray) -> np.ndarray:
    """63-bit hashes of the 16-byte pieces that start at each byte."""
    x = raw.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    h = x[:-8] * _A ^ x[8:] * _B
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    return h * _B >> np.uint64(1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, from block-wise running minima in both directions."""
    n = len(v) - width + 1
    blocks = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, dtype=v.dtype)
    blocks[:len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(pieces: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The anchor's hash of each ``length``-byte string, by start."""
    return sliding_min(pieces, length - PIECE + 1)


def anchor_places(pieces: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where pieces are the anchor of some string: those equal to the largest of the minima they take part in."""
    width = length - PIECE + 1
    around = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
    return np.flatnonzero(~sliding_min(~around, width) == pieces)


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _anchor_codes(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, anchors, how often) of every place at which a piece is an anchor."""
    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        starts = np.searchsorted(found >> np.uint64(63 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        codes, counts = (found >> np.uint64(63 - bits - 32)).astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
        for b in np.flatnonzero(np.diff(starts)):
            part = slice(starts[b], starts[b + 1])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([codes[part].tobytes()], pa.binary()),
                                              pa.array([counts[part].tobytes()], pa.binary())], names=["bucket", "codes", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("_text"):
                raw = _raw(text.as_py())
                if len(raw) >= LENGTH:
                    pieces = piece_hashes(raw)
                    held.append(pieces[anchor_places(pieces, anchors(pieces))])
                    size += len(held[-1])
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)
    return scan


def _anchor_classes(bits: int) -> Callable[[pa.Table], pa.Table]:
    def classify(table: pa.Table) -> pa.Table:
        code = np.concatenate([np.frombuffer(c.as_buffer(), dtype=np.uint32) for c in table.column("codes")])
        count = np.concatenate([np.frombuffer(c.as_buffer(), dtype=np.uint16) for c in table.column("counts")]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.add.reduceat(count[order], starts)
        place = (code[starts] >> np.uint32(32 + bits - bitmaps.BITS)).astype(np.int64)
        slices = [pa.array([bitmaps.packed(place[total >= least], bitmaps.BITS - bits)], pa.binary()) for least in (2, FREQUENT)]
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "repeated": slices[0], "frequent": slices[1]})
    return classify


def anchor_classes(docs: DataFrame, total_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the pieces that are anchors twice or more, and of those that are very often."""
    bits = max(6, min(bitmaps.BITS - 3, (total_bytes >> 26).bit_length()))
    rows = docs.select("_text").mapInArrow(_anchor_codes(bits), "bucket bigint, codes binary, counts binary")
    found = rows.groupBy("bucket").applyInArrow(_anchor_classes(bits), "bucket bigint, repeated binary, frequent binary")
    repeated, frequent = bitmaps.assembled(found.collect(), ["repeated", "frequent"], bits)
    return repeated, frequent


def contexts(raw: np.ndarray, repeated: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, first start, number of starts, whether the anchor occurs in it twice) of each context worth comparing."""
    pieces = piece_hashes(raw)
    place = (pieces >> np.uint64(63 - bitmaps.BITS)).astype(np.int64)
    late = bitmaps.has(frequent, place)
    plain = anchors(pieces)
    ranked = np.where(late, pieces | _TOP, pieces)
    least = anchors(ranked)
    # a piece chosen in place of a frequent one was not counted as an anchor, so it may be repeated
    wanted = bitmaps.has(repeated, ((least & ~_TOP) >> np.uint64(63 - bitmaps.BITS)).astype(np.int64)) | ((least & ~_TOP) != plain)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(first[1:], len(least))
    wanted = np.logical_or.reduceat(wanted, first)      # the plain anchor changes inside a run, so any of its starts may be wanted
    for s, e in zip(first[wanted].tolist(), ends[wanted].tolist()):
        for a in range(s, e, MAX_STARTS):
            b = min(e, a + MAX_STARTS)
            many = np.count_nonzero(ranked[a:b + LENGTH - PIECE] == least[a]) > 1
            yield int(least[a] & ~_TOP), a, b - a, many or e - s > MAX_STARTS


def _known(t1: int, start: int) -> bytes:
    """What a context is asked for by: one number of its text's digest and start, as Spark's xxhash64 hashes it."""
    return ((t1 ^ start << 36) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")


def _context_rows(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "content", "t1", "t2")] + [("start", pa.int32()), ("starts", pa.int32()), ("many", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = shared.value
        for batch in batches:
            rows = []
            for text, t1, t2 in zip(*(batch.column(c) for c in ("_text", "_t1", "_t2"))):
                raw = _raw(text.as_py())
                t1, t2, whole = t1.as_py(), t2.as_py(), raw.tobytes()
                for anchor, start, starts, many in contexts(raw, repeated, frequent):
                    rows.append((anchor, _content(whole, start, starts), t1, t2, start, starts, many))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return scan


def _content(whole: bytes, start: int, starts: int) -> int:
    """64-bit hash of a context's bytes; beside its anchor's 63 bits it tells contexts apart."""
    value = xxhash.xxh3_64_intdigest(whole[start:start + starts - 1 + LENGTH])
    return value - (1 << 64) if value >> 63 else value


def _context_bytes(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the contexts that are asked for, and now and then of another; a task seldom shows a context twice."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent, asked, crowded = shared.value
        told: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            if len(told) > 200_000:
                told.clear()
            for text, t1 in zip(batch.column("_text"), batch.column("_t1").to_pylist()):
                raw = _raw(text.as_py())
                whole, found = raw.tobytes(), list(contexts(raw, repeated, frequent))
                places = np.array([xxhash.xxh64_intdigest(_known(t1, c[1]), seed=42) >> 64 - bitmaps.BITS for c in found], dtype=np.int64)
                for k in np.flatnonzero(bitmaps.has(asked, places)):
                    anchor, start, starts, _ = found[k]
                    name = anchor, _content(whole, start, starts)
                    if name not in told:
                        told.add(name)
                        at = xxhash.xxh64_intdigest(anchor.to_bytes(8, "little"), seed=42) >> 64 - bitmaps.BITS
                        rows.append((*name, whole[start:start + starts - 1 + LENGTH], bool(bitmaps.has(crowded, np.array([at]))[0])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.bool_()))],
                                                 names=["anchor", "content", "bytes", "crowd"])
    return scan


def interleave(shards: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards: (text, order, block).

    ``text`` is the shards one after the other, a zero after each (symbols count from 1); ``order`` are all suffixes,
    ``block`` at each suffix the first place in the order of those that agree with it in ``length`` symbols. The
    merged Burrows-Wheeler transform is ``text[order - 1]``. Strings that end earlier than ``length`` symbols go on
    into the next shard and are meaningless beyond their zero.
    """
    text = np.frombuffer(b"\x00".join(shards) + b"\x00", dtype=np.uint8).astype(np.int64) + 1
    text[np.cumsum([len(s) + 1 for s in shards]) - 1] = 0
    n = len(text)
    done, key = min(FIRST, length), np.zeros(n, dtype=np.int64)
    for i in range(done):
        key <<= 9
        key[:max(n - i, 0)] += text[i:] + 1
    order = np.argsort(key)                                       # the interleave by the first symbols, nine bits each
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    block = np.empty(n, dtype=np.int64)
    block[order] = np.repeat(start, np.diff(np.append(start, n)))
    sizes = np.diff(np.append(start, n))
    moving = np.flatnonzero(np.repeat(sizes, sizes) > 1)          # places in the order whose blocks have several rows
    while done < length and len(moving):
        step = min(done, length - done)
        rows = order[moving]
        after = rows + step
        symbol = np.where(after < n, block[np.minimum(after, n - 1)] + 1, 0)
        key = block[rows] * (n + 1) + symbol
        placed = np.argsort(key)
        rows, key = rows[placed], key[placed]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(first)
        sizes = np.diff(np.append(head, len(rows)))
        order[moving] = rows
        block[rows] = np.repeat(moving[head], sizes)
        moving = moving[np.repeat(sizes, sizes) > 1]
        done += step
    return text, order, block


def repeated_starts(shards: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard, at which starts its ``length``-byte string occurs at another start in any shard."""
    _, _, block = interleave(shards, length)
    sizes = np.bincount(block, minlength=len(block))
    several, at, out = sizes[block] > 1, 0, []
    for s in shards:
        out.append(several[at:at + max(0, len(s) - length + 1)])
        at += len(s) + 1
    return out


def covered(starts: np.ndarray, length: int = LENGTH) -> list[int]:
    """The bytes that strings at the marked starts cover, as begin and end in turn."""
    marked = np.flatnonzero(starts)
    if not len(marked):
        return []
    split = np.flatnonzero(np.diff(marked) > length) + 1
    begins, ends = marked[np.concatenate([[0], split])], marked[np.concatenate([split - 1, [len(marked) - 1]])] + length
    return np.stack([begins, ends], axis=1).ravel().tolist()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered bytes of contexts; rows come sorted by anchor and content, whole anchors are merged at once, and a context
    that comes again is passed over."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        spans = [covered(s) for s in repeated_starts([r[2] for r in rows])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)] + [pa.array(spans, pa.list_(pa.int32()))],
                                          names=["anchor", "content", "spans"])
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "bytes"))):
            if size >= MERGE_BYTES and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            if held and row[:2] == held[-1][:2]:
                continue
            held.append(row)
            size += len(row[2])
    if held:
        yield flush(held)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a context by its hash."""
    for batch in batches:
        for anchor, content, whole in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "bytes"))):
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[i:i + LENGTH]) for i in range(len(whole) - LENGTH + 1)), dtype=np.int64).reshape(-1, 2)
            n = len(digests)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x), pa.int64()) for x in (anchor, content)] + [
                pa.array(np.arange(n, dtype=np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())],
                names=["anchor", "content", "at", "h1", "h2"])


def _crowded(crowd: DataFrame) -> DataFrame:
    """Covered bytes of the contexts of crowded anchors, string by string."""
    strings = crowd.mapInArrow(_string_hashes, "anchor bigint, content bigint, at int, h1 bigint, h2 bigint")
    twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = strings.join(twice, ["h1", "h2"], "left_semi")
    span = F.array(F.col("at"), F.col("at") + LENGTH)
    return marked.groupBy("anchor", "content").agg(F.flatten(F.collect_list(span)).alias("spans"))


def joined_spans(spans: list[int]) -> list[tuple[int, int]]:
    """Spans (begin and end in turn, any order) joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(kept_columns: list[str], keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests, kept = [], [], [], [], []
            for text, spans in zip(batch.column("_text"), batch.column("_spans")):
                raw, at, parts = _raw(text.as_py()).tobytes(), 0, []
                runs = joined_spans(spans.as_py() or [])
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                rest = b"".join([*parts, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                counts.append(len(runs))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            more = {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string())}
            yield with_columns(batch.select(kept_columns), **more, **({"kept": pa.array(kept, pa.binary())} if keep else {}))
    return cut


def remove_repeats(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if ``keep``, ``kept`` (bytes: a cut
    may fall inside a character).

    Texts are whole and in UTF-8; null counts as empty; texts shorter than 200 bytes keep everything. Strings count
    wherever they start, in equal rows and in the same text too. Repeated rows are each other's copies. An empty table
    stays empty. Columns named like a result give way.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep]
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]
    others = [c for c in docs.columns if c.lower() not in results and c != text]
    own = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"), halves[0].alias("_t1"), halves[1].alias("_t2"))      # a text moves once
    long = own.select("_text", "_t1", "_t2").filter(F.octet_length("_text") >= LENGTH)
    size = long.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    context = docs.sparkSession.sparkContext
    classes = anchor_classes(long, size)
    schema = "anchor bigint, content bigint, t1 bigint, t2 bigint, start int, starts int, many boolean"
    found = written(long.mapInArrow(_context_rows(context.broadcast(classes)), schema), "contexts")      # classes have a fixed size
    name = ["anchor", "content"]
    number = F.col("t1").bitwiseXOR(F.shiftleft(F.col("start").cast("bigint"), 36))
    kinds = written(found.groupBy(*name).agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(bitmaps.place(number).cast("int")).alias("place")), "kinds")
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("d"), F.max("many").alias("many"), F.min("n").alias("n")).filter("n = 1 and (d > 1 or many)")
    open_ = written(open_.select("anchor", (F.col("d") > MAX_CONTEXTS).alias("crowd")), "open")
    near = bitmaps.only(kinds, bitmaps.of_keys(open_, "anchor"), "anchor")
    asked = bitmaps.of_places(near, "place")
    likely = bitmaps.of_places(kinds.filter("n > 1").unionByName(near).select(bitmaps.place(*name).alias("place")), "place")
    crowded = bitmaps.of_keys(open_.filter("crowd"), "anchor")
    shown = long.mapInArrow(_context_bytes(context.broadcast((*classes, asked, crowded))), "anchor bigint, content bigint, bytes binary, crowd boolean")
    if crowded.any():
        shown = written(shown, "shown")
    calm = shown.filter("not crowd").drop("crowd").repartition("anchor").sortWithinPartitions(*name)
    judged = calm.mapInArrow(_merge, "anchor bigint, content bigint, spans array<int>").filter("size(spans) > 0")
    if crowded.any():
        judged = judged.union(_crowded(shown.filter("crowd").dropDuplicates(name)).select(*name, "spans"))
    judged = judged.union(kinds.filter("n > 1").select(*name, F.lit(None).cast("array<int>")))       # without spans: repeated throughout
    whole = F.array(F.lit(0), F.col("starts") - 1 + LENGTH)
    shifted = F.transform(F.coalesce("spans", whole), lambda x: x + F.col("start"))
    hits = bitmaps.only(found, likely, *name).join(judged, name).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), shifted.alias("s"))
    hits = hits.groupBy("_t1", "_t2").agg(F.flatten(F.collect_set("s")).alias("_spans"))
    ready = own.join(hits, ["_t1", "_t2"], "left").drop("_t1", "_t2")
    kept_columns = ["_text" if c == text else c for c in docs.columns if c.lower() not in results]
    fields = {f.name: f.dataType for f in ready.schema}
    more = StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep)
    cut = ready.mapInArrow(_cut(kept_columns, keep), StructType([*(StructField(c, fields[c]) for c in kept_columns), *more.fields]))
    return cut.withColumnRenamed("_text", text)
