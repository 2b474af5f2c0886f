"""Periodic runs of words, found by a dictionary of basic factors.

For every power of two L the dictionary names the factors of L words, so that two places have one name exactly where
their factors are equal. Names of 2 L words come from the pair of names of the two halves; a factor that occurs once in
its document has no name, and no longer factor over it needs one, so a level holds only what repeats. A factor's next
occurrence within 2 L words proposes its distance as a period where the one after it stands as far on: three terms of an
arithmetic progression. A run of period q, four periods long, shows such a progression at the level L of q (the least
power of two that is q or more): a factor of L words holds a whole period there, so that its occurrences inside the run
are exactly q apart. A proposal is extended in both directions; proposals of one run fall together.

A document is independent of all others, so the job has no shuffle. A task works on as many whole documents at once as
have ``CHUNK`` words together, or on one that is longer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm.common import with_columns

CHUNK = 400_000            # words a task looks at together
LEAST_WORDS, LEAST_PERIODS = 6, 4
RESULTS = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def proposals(codes: np.ndarray, doc: np.ndarray, longest: int) -> np.ndarray:
    """Rows (period, place) that the dictionary's levels propose; ``doc`` numbers the document of each word."""
    places = np.arange(len(codes))
    keys = doc * (int(codes.max(initial=0)) + 1) + codes
    found, width = [], 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        at, key = places[order], keys[order]
        same = key[1:] == key[:-1]
        name, gap = np.full(len(codes), -1), np.zeros(len(codes), dtype=np.int64)
        repeats = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        names = np.concatenate([[0], np.cumsum(~same)])
        name[at[repeats]] = names[repeats]
        gap[at[:-1][same]] = (at[1:] - at[:-1])[same]
        near = np.flatnonzero((gap > width // 2) & (gap <= 2 * width))
        near = near[gap[near + gap[near]] == gap[near]]          # the successor's successor stands as far on
        first = np.ones(len(near), dtype=bool)
        first[1:] = (near[1:] - near[:-1] != 1) | (gap[near[1:]] != gap[near[:-1]])
        found.append(np.stack([gap[near[first]], near[first]], axis=1))
        if 2 * width * LEAST_PERIODS // 2 > longest:             # periods above 2 x width / 2 have no room for four of them
            break
        places = np.flatnonzero(name >= 0)
        places = places[places + width < len(codes)]
        places = places[(name[places + width] >= 0) & (doc[places] == doc[places + width])]
        keys = name[places] * len(codes) + name[places + width]
        width *= 2
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def _agree(codes: np.ndarray, at: int, period: int, end: int, step: int) -> int:
    """The first place from ``at`` on, in direction ``step``, whose word differs from that a period on; ``end`` at last."""
    size = 16
    while (end - at) * step > 0:
        stop = at + step * min(size, (end - at) * step)
        low, high = (at, stop) if step > 0 else (stop + 1, at + 1)
        differ = np.flatnonzero(codes[low:high] != codes[low + period:high + period])
        if len(differ):
            return int(low + (differ[0] if step > 0 else differ[-1]))
        at, size = stop, size * 4
    return at


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period; document i has words ``bounds[i]`` to ``bounds[i + 1]``."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    runs: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    past, until = 0, 0
    for period, at in proposals(codes, doc, int(sizes.max(initial=0))).tolist():      # by period, then place
        if period == past and at + period < until:
            continue                                             # inside the stretch just extended
        d = int(doc[at])
        low, high = int(bounds[d]), int(bounds[d + 1])
        start = _agree(codes, at, period, low - 1, -1) + 1
        past, until = period, _agree(codes, at, period, high - period, 1) + period
        if until - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            runs[d].setdefault((start - low, until - start), period)     # one stretch has one least period, which comes first
    return [sorted((s, n, q) for (s, n), q in found.items()) for found in runs]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def worked(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        codes = np.array([c for words in texts for c in map(code.__getitem__, words)], dtype=np.int64)
        found = find_runs(codes, np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64))
        runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in one] for one in found], kind)
        collapsed = pa.array([collapse(w, r) for w, r in zip(texts, found)], pa.binary())
        return with_columns(part.drop_columns(["_periodic_text"]), runs=runs, collapsed=collapsed.cast(pa.string()))

    for batch in batches:
        column, first, words, n = batch.column("_periodic_text").cast(pa.binary()), 0, [], 0
        for i in range(batch.num_rows):
            words.append((column[i].as_py() or b"").split())
            n += len(words[-1])
            if n >= CHUNK or i == batch.num_rows - 1:
                yield worked(batch.slice(first, i + 1 - first), words)
                first, words, n = i + 1, [], 0


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words, by start and period) and ``collapsed``, the text with one period of each.

    Words are what stands between spaces and the controls U+0009 to U+000D, numbered from 0. A run is a stretch with
    least period q, at least six words and four periods long, that can't be extended. Null and empty texts have no runs
    and collapse to the empty text; long texts are taken whole; every row counts by itself, so ties and repeated rows
    don't meet; an empty table stays empty. Columns named like a result give way.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    wanted = docs.select(*own, F.col(f"`{text}`").cast("string").alias("_periodic_text"))
    schema = StructType([StructField(f.name, f.dataType) for f in wanted.schema.fields[:-1]] + StructType.fromDDL(
        ", ".join(f"{n} {kind}" for n, kind in RESULTS.items())).fields)
    return wanted.mapInArrow(_search, schema)
