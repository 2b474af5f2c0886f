"""Periodic runs, ranked search and near vectors against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from souba.llm import periodic, search, vectors


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q) and i > start:
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


class TestPeriodicRuns:
    def test_against_brute_force(self):
        rnd = random.Random(7)
        for _ in range(400):
            docs = []
            for _ in range(rnd.randint(1, 5)):
                n, letters = rnd.randint(0, 70), rnd.choice([1, 2, 3, 5, 30])
                words = [rnd.randrange(letters) for _ in range(n)]
                if n and rnd.random() < 0.5:
                    a, p = rnd.randrange(n), rnd.randint(1, 14)
                    for i in range(a + p, n):
                        words[i] = words[i - p]
                docs.append(words)
            codes = np.array([w for d in docs for w in d], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
            assert periodic.find_runs(codes, bounds) == [brute_runs(d) for d in docs]

    def test_long_runs_and_runs_of_runs(self):
        line = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 9]
        for words in ([5] * 30_000, line * 8, [1, 1, 1, 1, 1, 1, 2] * 5, list(range(400)) * 5):
            assert periodic.find_runs(np.array(words), np.array([0, len(words)]))[0] == (
                brute_runs(words) if len(words) < 5000 else [(0, len(words), 1)])

    def test_texts(self, spark, documents, monkeypatch):
        monkeypatch.setattr(periodic, "CHUNK", 50)
        long = "lead " + "α b " * 40_000 + "end"
        rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x\ty\nx y  x y x y z"), (6, long), (7, "a a a a a a a"), (8, "A a A a A a")]
        got = {(r["doc_id"], r["text"]): r for r in periodic.periodic_runs(documents(rows).withColumnRenamed("lang", "RUNS").withColumn("_text", F.lit(1))).collect()}
        told = lambda key: ([tuple(r) for r in got[key]["runs"]], got[key]["collapsed"])
        assert len(got) == 8 and got[rows[0]]["source"] == "s" and "RUNS" not in got[rows[0]].asDict()
        assert told(rows[0]) == told(rows[1]) == ([], "") and told(rows[2]) == ([], "")
        assert told(rows[3]) == ([(0, 6, 1)], "a") and told(rows[5]) == ([(0, 8, 2)], "x y z")
        assert told(rows[6]) == ([(1, 80_000, 2)], "lead α b end")
        assert told(rows[7]) == ([], "a a a a a a a") and told(rows[8]) == ([], "A a A a A a")

    def test_empty_table(self, documents):
        assert periodic.periodic_runs(documents([])).count() == 0


def brute_search(docs, items, top):
    def split(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)
    texts = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split(t))
    out = set()
    for item, words in wanted.items():
        scores = []
        for place, (i, c) in enumerate(texts):
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        out |= {(item, k + 1, None if null else i, -s) for k, (s, null, i, _) in enumerate(sorted(scores)[:top])}
    return out


class TestRankedSearch:
    WORDS = "de la the of x1 Über straße and que les und der abc zz 7 ñandú quick brown fox jumps".split()

    def texts(self, rnd, n, longest):
        return [" ,".join(rnd.choice(self.WORDS).upper() if rnd.random() < 0.2 else rnd.choice(self.WORDS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]

    def test_against_brute_force(self, spark, documents, monkeypatch):
        rnd = random.Random(3)
        docs = list(enumerate(self.texts(rnd, 150, 30))) + [(9, None), (None, "fox fox"), (None, "fox"), (10**12, "the " * 5000), (200, "de la"), (200, "de la"), (201, "de la"), (202, "?!")]
        items = list(enumerate(self.texts(rnd, 40, 12))) + [(5, "fox quick"), (None, "brown"), (50, None), (51, ""), (52, "the of x1"), (53, "THE of X1 and"), (54, "unseen")]
        asked = spark.createDataFrame(items, "item_id bigint, text string")
        monkeypatch.setattr(search, "SLICE_BYTES", 20_000)
        for block_bytes in (10**6, 400):
            got = search.rank_documents(documents(docs), asked, top=7, block_bytes=block_bytes).collect()
            assert {tuple(r) for r in got} == brute_search(docs, items, 7) and len(got) == len({(r["item_id"], r["rank"]) for r in got})

    def test_empty_tables(self, spark, documents):
        none, some = spark.createDataFrame([], "item_id string, text string"), spark.createDataFrame([("a", "x")], "item_id string, text string")
        assert search.rank_documents(documents([(1, "x")]), none).count() == 0
        assert search.rank_documents(documents([]), some).count() == 0
        assert [tuple(r) for r in search.rank_documents(documents([(1, "x"), (2, "y")]), some).select("item_id", "rank", "doc_id").collect()] == [("a", 1, 1)]

    def test_shared_sets_are_added_up_once(self):
        rnd = random.Random(5)
        common = [rnd.sample(range(60), 8) for _ in range(5)]
        sets = [set(rnd.choice(common)) | set(rnd.choice(common)) | {60 + i} for i in range(40)]
        pairs = [(i, t) for i, s in enumerate(sets) for t in s]
        used = sorted({t for _, t in pairs})
        plan = search.shared_plan(pa.array(range(40)), np.array([i for i, _ in pairs]), np.array([used.index(t) for _, t in pairs]), [str(t) for t in used])
        content = [set() for _ in range(plan.nodes)]
        for t, node in enumerate(plan.node_of):
            content[node].add(used[t])
        at = max(plan.node_of) + 1
        for left, right in plan.levels:
            for a, b in zip(left, right):
                assert not content[a] & content[b]
                content[at] = content[a] | content[b]
                at += 1
        ends = [*plan.starts[1:], len(plan.parts)]
        assert [set().union(*(content[p] for p in plan.parts[a:b])) for a, b in zip(plan.starts, ends)] == sets and at == plan.nodes
        assert plan.levels and len(plan.parts) + sum(len(a) for a, _ in plan.levels) < len(pairs) / 3


def brute_links(rows, threshold=0.9):
    """n_links and least reachable id of each row."""
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if fit(v) else None for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
              and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((key, len(links[i]), least, key is not None and key == least))
    return out


class TestNearVectors:
    def groups(self, sizes, dim=24, seed=2):
        """(size, spread) -> unit vectors about one centre each."""
        rng, out = np.random.default_rng(seed), []
        for size, spread in sizes:
            centre = rng.standard_normal(dim)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                off = rng.standard_normal(dim)
                out.append((centre + spread * rng.uniform(0.5, 1) * off / np.linalg.norm(off)) * rng.uniform(0.1, 9))
        return out

    def told(self, spark, rows):
        frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, N_LINKS string, node string")
        got = vectors.link_vectors(frame)
        assert sorted(got.columns) == ["component_id", "embedding", "kept", "n_links", "node", "vec_id"]
        key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
        return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=key), sorted(brute_links(rows), key=key)

    def test_tight_loose_and_bridged_groups_in_folds_pieces_and_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(vectors, "MISS", 1e-6)
        for name, value in (("PIECE", 16), ("BLOCK", 8), ("LOAD", 64)):
            monkeypatch.setattr(vectors, name, value)
        a, b = np.eye(24)[0], np.eye(24)[1]
        arc = [math.cos(t) * a + math.sin(t) * b for t in np.linspace(0, 1.2, 40)]          # a chain: only near ones link
        found = self.groups([(60, 0.15), (50, 0.45), (40, 0.6), (1, 0)] + [(2, 0.2)] * 10 + [(1, 0)] * 40) + arc
        rows = [(1000 - i, v) for i, v in enumerate(found)]
        got, expected = self.told(spark, rows)
        assert got == expected and max(r[1] for r in got) >= 59

    def test_odd_rows(self, spark):
        rows = [(1, None), (2, [0, 0]), (3, [1, None]), (4, [1, math.nan]), (5, [math.inf, 1]), (6, []), (7, [1, 0]), (8, [1, 0]), (8, [2, 0.1]), (8, [0, 1]),
                (None, [1, 0.2]), (None, [-1, 0.2]), (None, None), (9, [1, 0, 0]), (10, [1e200, 0]), (11, [1e-300, 0]), (12, [-0.0, 1]), (13, [0.0, 1])]
        got, expected = self.told(spark, rows)
        assert got == expected

    def test_empty_table(self, spark):
        assert vectors.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0

    def test_shape_follows_the_number_of_vectors(self):
        for n in (10, 10**4, 10**7, 10**10):
            directions, tables = vectors.shape(n, 0.9)
            near, far = vectors.meeting(math.sqrt(0.2)), vectors.meeting(math.sqrt(2))
            assert (1 - near**directions) ** tables <= vectors.MISS and n * far**directions <= vectors.LOAD
