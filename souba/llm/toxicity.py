"""Toxicity: a support vector machine on a gappy subsequence string kernel, made finite by Nyström landmarks.

The kernel of two words counts the letter triples they share as subsequences, each weighed by DECAY to the power of
the span it takes in either word; so letters put into an insult, or left out of it, cost a little and not the match.
The SVM works in the span of a few landmark words. As every landmark is a sum of triples, the trained machine is one
weight per triple, which each task looks up. A text is as toxic as its worst word; a logistic curve turns margins to
probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm.common import hash60, with_columns, written

DECAY = 0.7
WINDOW = 24               # letters a word is compared by; longer ones go through overlapping windows
LETTERS = 127             # letters told apart: the most frequent of the landmarks
LANDMARKS = 512     # half of them toxic words, half the clean words hardest to tell from those
MAX_LABELLED = 20000      # labelled documents the machine is fitted on, the lowest by a hash of their id
MAX_WORDS = 4000          # words of each class it is fitted on, per round
ROUNDS = 3                # of adding the clean words that look most toxic
CACHE = 200_000           # scored words a task keeps
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S)+(?!\S)")
_SIGNS = re.compile(r"[\W_]+")


def units(text: str) -> set[str]:
    """What a text is judged by: its words in lower case, and runs of single characters joined to words."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(m.split()) for m in _SPELLED.findall(low))
    return found


def windows(unit: str) -> list[str]:
    """The letters and digits of a unit between marks of its ends, in windows of WINDOW that overlap by half."""
    bare = f"<{_SIGNS.sub('', unit)}>"
    if len(bare) <= WINDOW:
        return [bare]
    return [bare[i:i + WINDOW] for i in range(0, len(bare) - WINDOW // 2, WINDOW // 2)]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of a length: the positions of all triples (n, 3) and their weights."""
    if length not in _TRIPLES:
        at = np.array(list(combinations(range(length), 3)), dtype=np.int64).reshape(-1, 3)
        _TRIPLES[length] = at, (DECAY ** (at[:, 2] - at[:, 0])).astype(np.float32)
    return _TRIPLES[length]


def norms(letters: np.ndarray) -> np.ndarray:
    """The square root of each word's kernel with itself; ``letters`` has a word of the same length in each row."""
    n, length = letters.shape
    back = np.tril(DECAY ** (np.arange(length)[:, None] - np.arange(length)[None, :]).astype(np.float32), -1).T.astype(np.float32)
    same = (letters[:, :, None] == letters[:, None, :]).astype(np.float32)

    def reach(m: np.ndarray) -> np.ndarray:      # sums over earlier pairs of positions, each step back costing DECAY
        half = (m.reshape(-1, length) @ back).reshape(n, length, length).transpose(0, 2, 1)
        return (np.ascontiguousarray(half).reshape(-1, length) @ back).reshape(n, length, length).transpose(0, 2, 1)
    whole = same * reach(same * reach(same))
    return np.sqrt(np.maximum(whole.sum(axis=(1, 2)), 1e-12))


def _ordinals(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


@dataclass(frozen=True)
class KernelMachine:
    """Letters, the weight of each triple of them, the bias, and the logistic curve over margins."""

    letters: str
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distances of what ``windows`` gives."""
        out = np.full(len(words), self.bias)
        size = len(self.letters) + 1
        known = _ordinals([self.letters])[0] if self.letters else np.zeros(0, dtype=np.uint32)
        rank = np.argsort(known).astype(np.int32)
        for length, rows in _by_length(words).items():
            at, weight = triples(length)
            step = max(1, 500_000 // max(1, len(at)))
            for start in range(0, len(rows) if len(at) and size > 1 else 0, step):
                part = rows[start:start + step]
                letters = _ordinals([words[r] for r in part])
                place = np.minimum(np.searchsorted(known[rank], letters), size - 2)
                codes = np.where(known[rank][place] == letters, rank[place] + 1, 0).astype(np.int32)
                index = (codes[:, at[:, 0]] * size + codes[:, at[:, 1]]) * size + codes[:, at[:, 2]]
                out[part] += self.weights[index] @ weight / norms(letters)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel matrix, every word's kernel with itself being 1 (0 for words without triples)."""
    table: dict[tuple[str, ...], int] = {}

    def counted(word: str) -> tuple[list[int], np.ndarray, float]:
        at, weight = triples(len(word))
        found = [table.setdefault((word[a], word[b], word[c]), len(table)) for a, b, c in at.tolist()]
        return found, weight, float(norms(_ordinals([word]))[0]) if len(at) else 1.0
    marks = [counted(w) for w in landmarks]
    dense = np.zeros((len(table) + 1, len(landmarks)), dtype=np.float32)
    for j, (found, weight, norm) in enumerate(marks):
        np.add.at(dense[:, j], found, weight / norm)
    out, last = np.zeros((len(words), len(landmarks)), dtype=np.float32), len(table)
    for i, word in enumerate(words):
        found, weight, norm = counted(word)
        out[i] = weight @ dense[np.minimum(found, last)] / norm if found else 0
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 500) -> tuple[np.ndarray, float]:
    """Linear machine on squared hinge loss by Adam; both classes (labels -1 and 1) weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        pull = -2 * share * y * slack
        g = np.concatenate([x.T @ pull + penalty * w, [pull.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def spaced(word: str, extra: str = "xaioer1z") -> list[str]:
    """A word with one character put in, at a few places."""
    inner = range(2, len(word) - 1)
    return [word[:i] + extra[(i * 5 + k) % len(extra)] + word[i:] for k, i in enumerate(list(inner)[::max(1, len(inner) // 3)])]


def fit_machine(toxic: list[str], clean: list[str]) -> KernelMachine:
    """The machine for toxic against clean windows of words: landmarks from both, Nyström features, SVM, one weight per triple.
    Toxic words also count with a character put in, unless that is a clean word.

    Without toxic words every margin is -1.
    """
    if not toxic:
        return KernelMachine("", np.zeros(1, dtype=np.float32), -1.0)
    landmarks = [*toxic[:LANDMARKS // 2], *clean[:LANDMARKS // 2]]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
    kept = values > 1e-4
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    known = set(clean)
    gapped = [v for t in toxic for v in spaced(t) if v not in known]
    x = kernel([*toxic, *gapped, *clean], landmarks).astype(float) @ whiten
    w, bias = fit_svm(x, np.array([1.0] * len(toxic + gapped) + [-1.0] * len(clean)))
    beta = whiten @ w
    seen: dict[str, int] = {}
    for word in landmarks:
        for c in word:
            seen[c] = seen.get(c, 0) + 1
    letters = "".join(sorted(sorted(seen), key=lambda c: -seen[c])[:LETTERS])
    number, size = {c: i + 1 for i, c in enumerate(letters)}, len(letters) + 1
    weights = np.zeros(size ** 3)
    for word, coefficient in zip(landmarks, beta):
        at, weight = triples(len(word))
        codes = np.array([number.get(c, 0) for c in word], dtype=np.int64)
        if len(at):
            norm = norms(_ordinals([word]))[0]
            picked = codes[at]
            np.add.at(weights, (picked[:, 0] * size + picked[:, 1]) * size + picked[:, 2],
                      np.where((picked > 0).all(axis=1), coefficient * weight / norm, 0.0))
    return KernelMachine(letters, weights.astype(np.float32), bias)


def worst_margins(machine: KernelMachine, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
    """The largest margin among the units of each text; the bias where a text is null or empty."""
    if len(cache) > CACHE:
        cache.clear()
    found = [units(t) if t else set() for t in texts]
    fresh = list(set().union(*found).difference(cache))
    for at in range(0, len(fresh), 20_000):
        part = fresh[at:at + 20_000]
        cut = [windows(u) for u in part]
        scores = machine.margins([w for c in cut for w in c])
        ends = np.cumsum([len(c) for c in cut])
        cache.update(zip(part, np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]])).tolist()))
    return np.array([max([machine.bias, *map(cache.__getitem__, u)]) for u in found])


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = shared.value, {}
        for batch in batches:
            texts = batch.column("_text")
            margins = [worst_margins(machine, texts.slice(at, 64).to_pylist(), cache) for at in range(0, batch.num_rows, 64)]
            margin = np.concatenate(margins) if margins else np.zeros(0)
            yield with_columns(batch.drop_columns(["_text"]), margin=pa.array(margin, pa.float64()),
                               toxicity=pa.array(machine.probability(margin), pa.float64()))
    return score


def score_toxicity(docs: DataFrame, machine: KernelMachine, text: str = "text") -> DataFrame:
    """``docs`` with ``margin`` (of the worst word) and ``toxicity`` (0 to 1); whole texts, nothing but the text is used.

    Null and empty texts get the margin of a word without triples. Columns named like a result give way.
    """
    results = ("margin", "toxicity")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results], F.col(f"`{text}`").alias("_text"))
    schema = StructType([StructField(f.name, f.dataType) for f in own.schema.fields[:-1]] + StructType.fromDDL("margin double, toxicity double").fields)
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine)), schema)


def _word_table(labelled: DataFrame) -> DataFrame:
    """Words of labelled texts with the number of toxic texts and of texts they stand in."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}\s]+", "")), r"\s+"))).alias("word")
    counted = labelled.select("toxic", word).filter(F.char_length("word").between(2, WINDOW - 2))
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("docs"))


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small prior that keeps it finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = p - label, p * (1 - p) + 1e-9
        g = np.array([d @ margin + 0.1 * (a - 1), d.sum() + 0.01 * b])
        hess = np.array([[h @ margin ** 2 + 0.1, h @ margin], [h @ margin, h.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> KernelMachine:
    """Fit on at most ``max_labelled`` labelled documents (``labels``: the key and ``toxic`` 0 or 1).

    Four fifths of them, by hash, give the words: toxic ones stand almost only in toxic texts, and in more of them
    than chance would let any word of this vocabulary; clean ones are drawn from the rest, then those the machine
    takes for toxic are added, round by round. The last fifth sets the logistic curve. What the driver holds is
    bounded by the parameters of this module.
    """
    given = labels.select(F.col(key).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)")
    sample = given.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(hash60(F.col("_id").cast("string")), "_id").limit(max_labelled)
    labelled = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(
        F.broadcast(sample), "_id").withColumn("curve", F.pmod(hash60(F.concat(F.lit("curve"), F.col("_id").cast("string"))), F.lit(5)) == 0)
    labelled = written(labelled, "labelled")
    words = written(_word_table(labelled.filter("not curve")), "words")
    n, toxic_n = labelled.filter("not curve").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = min(max(toxic_n / n if n else 0.5, 0.01), 0.9)
    least = max(2, int(np.ceil(np.log(max(2, words.count())) / -np.log(base))))
    suspect = F.col("toxic") >= 0.85 * F.col("docs")
    toxic = [windows(r["word"])[0] for r in words.filter(suspect & (F.col("toxic") >= least)).orderBy(F.desc("toxic"), "word").limit(MAX_WORDS).collect()]
    others = words.filter(F.col("toxic") <= 0.5 * F.col("docs"))
    clean = [windows(r["word"])[0] for r in others.orderBy(hash60(F.col("word"))).limit(MAX_WORDS).collect()]
    machine = fit_machine(toxic, clean)
    for _ in range(ROUNDS if toxic else 0):
        looks = score_toxicity(others.select("docs", F.col("word").alias("text")), machine).filter("margin > -0.5")
        hard = [windows(r["text"])[0] for r in looks.orderBy(F.desc(F.col("margin") + F.log("docs") / 4), "text").limit(MAX_WORDS).collect()]
        clean = [*hard, *(w for w in clean if w not in set(hard))]
        machine = fit_machine(toxic, clean)
    held = score_toxicity(labelled.filter("curve").select("toxic", "text"), machine).select("margin", "toxic").toPandas()
    slope, offset = _curve(held["margin"].to_numpy(), held["toxic"].to_numpy().astype(float)) if len(held) else (1.0, 0.0)
    return KernelMachine(machine.letters, machine.weights, machine.bias, slope, offset)
