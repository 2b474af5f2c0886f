"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Training texts stream past the automaton, which gives at each word the length of the longest run of words that ends
there and occurs in an item. A run of at least 13 words, or a whole item of fewer, is a hit. Items are taken in
slices of bounded size, one automaton each; a text passes all slices in turn, so the test set may grow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm.common import with_columns

WINDOW = 13
SLICE_WORDS = 2_000_000        # of items in one automaton; about 400 bytes a word in each task
ROWS = 512                     # whose texts a task holds as Python strings
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a to z and everything beyond ASCII. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items each long state and each short item belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [item_id for item_id, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)] for _, text in items]
        ends = [self._add(c) for c in coded]
        self.short: dict[int, set[int]] = {}
        for k, (c, end) in enumerate(zip(coded, ends)):
            if 0 < len(c) < window:
                self.short.setdefault(end, set()).add(k)
        self.items: list[set[int]] = [set() for _ in self.next]
        for k, c in enumerate(coded):
            state = 0
            for w in c:
                state = up = self.next[state][w]
                while up > 0 and self.length[up] >= window and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
        self._answers: dict[tuple[int, bool], tuple[int, frozenset[int]]] = {}
        n = max(1, len(self.vocab))
        self.pairs = np.unique(np.array([a * n + b for c in coded for a, b in zip(c, c[1:])], dtype=np.int64))
        self.shortest = min([min(len(c), window) for c in coded if c], default=0)

    def _add(self, codes: list[int]) -> int:
        last = 0
        for c in codes:
            last = self._extend(last, c)
        return last

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:      # the sequence so far is known already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _answer(self, state: int, length: int) -> tuple[int, frozenset[int]]:
        """Of a match: the longest hit that ends with it, and the items that have it."""
        key = (state, length)
        if key not in self._answers:
            longest, found, up = 0, set(), state
            while up > 0:
                known = min(length, self.length[up])
                if known >= self.window:
                    longest = max(longest, known)
                    if self.length[self.link[up]] < self.window:      # this state holds the window that ends here
                        found |= self.items[up]
                if up in self.short and self.length[up] <= length:
                    longest = max(longest, self.length[up])
                    found |= self.short[up]
                up = self.link[up]
            self._answers[key] = (longest, frozenset(found))
        return self._answers[key]

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Stretches of words all of whose neighbours are neighbours in an item too, long enough for a hit."""
        codes = np.fromiter((self.vocab.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if not self.shortest or not len(codes):
            return
        known = codes >= 0
        joined = np.zeros(len(codes) + 1, dtype=bool)        # is this word joined to the one before
        if len(codes) > 1 and len(self.pairs):
            pair = codes[:-1] * max(1, len(self.vocab)) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:-1] = (self.pairs[at] == pair) & known[:-1] & known[1:]
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        for i in np.flatnonzero(ends - starts >= self.shortest):
            yield int(starts[i]), int(ends[i])

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (merged where they overlap or touch) and the items with a hit."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, end in self.runs(words):
            state = length = 0
            for i in range(start, end):
                c = self.vocab[words[i]]
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state, length = self.next[state][c], length + 1
                longest, items = self._answer(state, length)
                if longest:
                    found |= items
                    spans.append((i + 1 - longest, i + 1))
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words, from a span's first letter to its last."""
    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    where = [m.span() for m in _WORD.finditer(raw.lower())] if spans else []
    for a, b in spans:
        kept.append(raw[at:where[a][0]])
        at = where[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def item_slices(items: DataFrame, item_id: str, text: str, slice_words: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in slices of about ``slice_words`` words, read by the driver one partition at a time."""
    held, size = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null").distinct().coalesce(16).toLocalIterator():
        n = len(words_of(row["t"]))
        if n:
            held.append((row["i"], row["t"]))
            size += n
        if size >= slice_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pass(shared, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, spans, items = [], [], []
            for text, old_spans, old_items in zip(*(batch.column(c).to_pylist() for c in ("_text", "_spans", "_items"))):
                words = words_of(text)
                hit, found = automaton.match(words)
                counts.append(len(words))
                spans.append([*old_spans, *(x for pair in hit for x in pair)])
                items.append([*old_items, *(automaton.ids[k] or "null" for k in found)])
            yield with_columns(batch, _words=pa.array(counts, pa.int64()), _spans=pa.array(spans, pa.list_(pa.int64())),
                               _items=pa.array(items, pa.list_(pa.string())))
    return look


def _close(clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(list(zip(s[::2], s[1::2]))) for s in batch.column("_spans").to_pylist()]
            words = batch.column("_words").to_pylist()
            hits = [sum(b - a for a, b in s) for s in spans]
            more = {"n_words": pa.array(words, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                    "items": pa.array([sorted(set(i)) for i in batch.column("_items").to_pylist()], pa.list_(pa.string())),
                    "hit_spans": pa.array([[x for pair in s for x in pair] for s in spans], pa.list_(pa.int64())),
                    "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, words)], pa.bool_())}
            if clean:
                more["clean_text"] = pa.array([cut(t, s) if t and s else t for t, s in zip(batch.column("_text").to_pylist(), spans)], pa.string())
            yield with_columns(batch.drop_columns(["_text", "_words", "_spans", "_items"]), **more)
    return close


def _last_pass(shared, window: int, clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass of the last slice and the results, in one function: two chained ones keep two Python processes a core."""
    look, close = _pass(shared, window), _close(clean)
    return lambda batches: close(look(batches))


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              window: int = WINDOW, clean: bool = False, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``hit_spans`` (word numbers, start and
    end in turn), ``contaminated`` (hit, and at least 5 % of the words are) and, if ``clean``, ``clean_text``.

    Null and empty texts have no words and no hits; items without words match nothing; repeated items count once, a
    null item id is named null. Texts are read whole; an empty table, or one without items, works the same way.
    Columns named like a result give way.
    """
    results = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "hit_spans": "array<bigint>", "contaminated": "boolean"}
    results |= {"clean_text": "string"} if clean else {}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    wanted = docs.select(*own, F.col(f"`{text}`").alias("_text"), F.lit(0).cast("bigint").alias("_words"),
                         F.expr("array()").cast("array<bigint>").alias("_spans"), F.expr("array()").cast("array<string>").alias("_items"))
    schema = StructType([StructField(f.name, f.dataType) for f in wanted.schema])
    *parts, last = [docs.sparkSession.sparkContext.broadcast(part) for part in item_slices(items, item_id, item_text, slice_words)] or [
        docs.sparkSession.sparkContext.broadcast([])]
    for part in parts:
        wanted = wanted.mapInArrow(_pass(part, window), schema)
    closed = StructType(schema.fields[:-4] + StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in results.items())).fields)
    return wanted.mapInArrow(_last_pass(last, window, clean), closed)


def items_digest(items) -> str:
    """Lowercase hex SHA-256 of the ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
