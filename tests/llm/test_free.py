"""Archives, decontamination, repeats, near duplicates and the two classifiers against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from souba.llm import components, decontaminate, jaccard, quality, suffixes, toxicity, warc


class TestWarc:
    PAGES = [(1, "http://a/b c\r\nX: y", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "ü", "ü" * 30_000), (-6, "u", "<p>x</p>"),
             (None, "u", "lone"), (None, "u", "<p>x</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]

    def frame(self, spark, rows):
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    def test_round_trip(self, spark):
        got = warc.read_archives(warc.write_archives(warc.plan_records(self.frame(spark, self.PAGES)))).collect()
        assert all(r["error"] is None for r in got) and len(got) == len(self.PAGES)
        least: dict[str, int | None] = {}
        for i, _, h in self.PAGES:
            h = h or ""
            least[h] = i if least.get(h) is None else least[h] if i is None else min(least[h], i)
        for i, url, h in self.PAGES:
            h = h or ""
            kind, to = ("response", None) if i == least[h] else ("revisit", least[h])
            assert any(r["page_id"] == i and r["record_type"] == kind and r["refers_to"] == to and r["payload_bytes"] == len(h.encode())
                       and (r["payload"] is None if to else bytes(r["payload"]) == h.encode()) for r in got)

    def test_least_bytes_keeps_small_pages_whole(self, spark):
        got = warc.read_archives(warc.write_archives(warc.plan_records(self.frame(spark, self.PAGES), 10**6))).collect()
        assert {r["record_type"] for r in got} == {"response"}

    def test_empty_table(self, spark):
        assert warc.read_archives(warc.write_archives(warc.plan_records(self.frame(spark, [])))).count() == 0

    def test_dictionary_and_one_frame_per_record(self):
        records = [warc.record_bytes(i, "u", b"<html>%d common words in every page</html>" % (i * i), warc.payload_digest(b"<html>%d common words in every page</html>" % (i * i)), None, False) for i in range(400)]
        whole = warc.pack(records)
        assert int.from_bytes(whole[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(whole[4:8], "little") > 0
        assert list(warc.unpack(whole)) == records and [warc.parse_record(r)["page_id"] for r in records] == list(range(400))
        packed = zstandard.ZstdCompressor().compress(whole[8:8 + int.from_bytes(whole[4:8], "little")])     # a compressed dictionary
        again = whole[:4] + len(packed).to_bytes(4, "little") + packed + whole[8 + int.from_bytes(whole[4:8], "little"):]
        assert list(warc.unpack(again)) == records

    def test_damage_is_reported(self, spark):
        good = warc.record_bytes(1, "u", b"abc", warc.payload_digest(b"abc"), None, False)
        bad = [good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"X-Date"), b"junk", good.replace(b"WARC/1.1", b"HTTP/1.1")]
        for record in bad:
            with pytest.raises(ValueError):
                warc.parse_record(record)
        cut = warc.pack([good, good])[:-3]
        rows = warc.read_archives(spark.createDataFrame([(bytearray(warc.pack([good, *bad])),), (bytearray(cut),)], "content binary")).collect()
        assert sum(r["error"] is None for r in rows) == 2 and sum(r["error"] is not None for r in rows) == len(bad) + 1


class TestDecontaminate:
    def brute(self, text, items):
        words, hit, found = decontaminate.words_of(text), set(), set()
        for item, t in items:
            w = decontaminate.words_of(t)
            n = min(13, len(w))
            windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        return len(words), len(hit), sorted(found)

    def test_random_texts_match_brute_force(self, spark, documents):
        rng = random.Random(8)
        items = [(k, " ".join(rng.choices("a b c d".split(), k=n))) for k, n in enumerate([0, 1, 2, 5, 12, 13, 14, 30, 30, 60] * 2)]
        items[1] = (1, "zz")
        items[11] = (11, "yy")
        items += [(90, items[9][1][:80]), (91, items[9][1]), (None, items[5][1])]
        rows = []
        for i in range(80):
            words = rng.choices("a b c d e , yy".split(), k=rng.randrange(60))
            if i % 3 == 0:
                words[5:5] = rng.choice(items)[1].upper().split()
            rows.append((i, rng.choice([" ", "\n", "-"]).join(words)))
        rows += [(100, None), (101, ""), (102, " ".join(t for _, t in items) * 3), (103, "é à " * 20)]
        frame = spark.createDataFrame(items, "item_id bigint, text string")
        items = [("null" if k is None else k, t) for k, t in items]
        for slice_words in (10**6, 40):
            got = {r["doc_id"]: r for r in decontaminate.find_hits(documents(rows), frame, clean=True, slice_words=slice_words).collect()}
            for i, t in rows:
                n, hit, found = self.brute(t, items)
                r = got[i]
                assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found), (i, slice_words)
                assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
                assert len(decontaminate.words_of(r["clean_text"])) == n - hit and (hit > 0 or r["clean_text"] == t)

    def test_empty_tables_and_clashes(self, spark, documents):
        none = spark.createDataFrame([], "item_id bigint, text string")
        out = decontaminate.find_hits(documents([(2**60 + 1, "a b")]).withColumn("items", F.lit(1)).withColumn("N_HIT", F.lit(1)), none)
        r = out.first()
        assert (r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["text"]) == (2**60 + 1, 2, 0, [], "a b")
        assert decontaminate.find_hits(documents([]), none).count() == 0


class TestRepeats:
    def brute(self, rows):
        raws = [(i, (t or "").encode()) for i, t in rows]
        counts = Counter(b[k:k + 200] for _, b in raws for k in range(len(b) - 199))
        for i, b in raws:
            gone = bytearray(len(b))
            for k in range(len(b) - 199):
                if counts[b[k:k + 200]] > 1:
                    gone[k:k + 200] = b"\1" * 200
            kept = bytes(x for x, g in zip(b, gone) if not g)
            runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
            yield i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()

    def rows(self):
        rng = random.Random(3)

        def noise(n):
            return "".join(rng.choices("abcdefgh \n", k=n))
        passage, line = noise(700), noise(150)
        rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (6, "ab" * 900), (7, "z" * 5000)]
        rows += [(10 + i, noise(rng.randrange(400)) + passage[rng.randrange(300):][:rng.randrange(150, 450)] + noise(100) + line) for i in range(40)]
        rows += [(60 + i, line.join(noise(180) for _ in range(4))) for i in range(100)]
        base = noise(1500)
        rows += [(200 + i, base[:k] + "Q" + base[k:]) for i, k in enumerate(range(0, 1500, 40))]
        rows += [(300, base), (301, base), (302, "ü" * 400), (303, "aü" + "ü" * 300), (304, passage + passage), (305, noise(30_000))]
        return rows

    def test_matches_brute_force(self, documents):
        rows = self.rows()
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(documents(rows)).collect()}
        assert got == set(self.brute(rows))

    def test_crowded_anchors_string_by_string(self, documents, monkeypatch):
        monkeypatch.setattr(suffixes, "MAX_CONTEXTS", 3)
        rows = self.rows()
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(documents(rows)).collect()}
        assert got == set(self.brute(rows))

    def test_a_frequent_piece_after_the_anchor(self, documents, monkeypatch):
        monkeypatch.setattr(suffixes, "FREQUENT", 3)
        rng = random.Random(9)

        def noise(n):
            return "".join(rng.choices("abcdefgh \n", k=n))
        q, p = sorted((noise(16) for _ in range(100_000)), key=lambda t: int(suffixes.piece_hashes(np.frombuffer(t.encode(), dtype=np.uint8))[0]))[:2]
        passage = noise(20) + p + noise(90) + q + noise(90)         # every string of the passage with p holds q too
        rows = [(i, noise(250) + q + noise(250)) for i in range(4)] + [(10, noise(300) + passage), (11, passage + noise(300))]
        rows += [(i + 30, t) for i, t in self.rows()[:60]]
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(documents(rows)).collect()}
        assert got == set(self.brute(rows))

    def test_rows_repeated_and_kept_bytes(self, documents):
        rows = [(1, "k" * 10 + "abc" * 100), (1, "k" * 10 + "abc" * 100), (None, "lone text " + "0123456789" * 3)]
        got = suffixes.remove_repeats(documents(rows).withColumn("n_bytes", F.lit(None).cast("string")), keep=True).collect()
        assert sorted((r["n_removed"], bytes(r["kept"])) for r in got) == [(0, rows[2][1].encode()), (310, b""), (310, b"")]
        assert suffixes.remove_repeats(documents([])).count() == 0

    def test_merged_order_is_the_suffix_order(self):
        rng = random.Random(1)
        shards = [bytes(rng.choices(b"ab", k=rng.randrange(1, 60))) for _ in range(20)]
        text, order, block = suffixes.interleave(shards, 16)
        whole = [tuple(text[i:i + 16]) for i in range(len(text))]
        assert [whole[i] for i in order] == sorted(whole)
        assert all((block[a] == block[b]) == (whole[a] == whole[b]) for a in range(0, len(text), 7) for b in range(len(text)))

    def test_sliding_minimum(self):
        v = np.random.default_rng(0).integers(0, 50, 100).astype(np.uint64)
        for width in (1, 7, 100):
            assert suffixes.sliding_min(v, width).tolist() == [int(v[i:i + width].min()) for i in range(100 - width + 1)]


class TestJaccard:
    def brute(self, rows, percent=75):
        sets = {}
        for i, t in rows:
            w = (t or "").encode().lower().split()
            sets.setdefault(i, []).append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
        parent = {i: i for i in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        flat = [(i, s) for i, several in sets.items() for s in several]
        for i, s in flat:
            for j, t in flat:
                if i < j and s and t and 100 * len(s & t) >= percent * len(s | t) and find(i) != find(j):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        return {(i, len(s), find(i)) for i, s in flat}

    def rows(self):
        rng = random.Random(6)
        vocabulary = [f"w{k}" for k in range(3000)]
        passage, rows = rng.choices(vocabulary, k=60), []
        for g in range(30):
            base = rng.choices(vocabulary, k=rng.randrange(5, 120)) + (passage if g % 3 else [])
            for _ in range(rng.choice([1, 2, 8])):
                words = list(base)
                for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                rows.append((len(rows), " ".join(words)))
        rows += [(900 + k, " ".join(passage[:k])) for k in range(40, 61)]           # chains of prefixes: frequent shingles only
        rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one two three four five"), (1006, rows[0][1].upper()),
                 (1007, "long " * 40_000), (1008, "long " * 9), (1009, "É È"), (1010, "é è")]
        return rows

    @pytest.mark.parametrize("often", [16, 2])
    def test_matches_brute_force(self, documents, monkeypatch, often):
        monkeypatch.setattr(jaccard, "FREQUENT", often)
        rows = self.rows()
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(rows)).collect()}
        assert got == self.brute(rows)

    def test_without_bands_the_prefixes_find_every_link(self, documents, monkeypatch):
        monkeypatch.setattr(jaccard, "star_pairs", lambda reps, percent: reps.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1).cast("bigint").alias("weight")).limit(0))
        rows = self.rows()
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(rows)).collect()}
        assert got == self.brute(rows)

    def test_null_and_repeated_keys(self, documents):
        rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "other words stand here now ok")]
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(rows)).collect()}
        assert got == {(None, None), (1, 1), (2, 1), (3, 3)}
        assert jaccard.near_duplicates(documents([])).count() == 0

    def test_components_of_a_chain_and_a_star(self, spark):
        links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(random.Random(0).sample(links, len(links)), "a bigint, b bigint")).collect()}
        assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


class TestQuality:
    def test_held_out_accuracy(self, spark):
        folder = "/root/testdata/sf0.01"
        docs, ratings = spark.read.parquet(f"{folder}/documents.parquet"), quality.graded_labels(spark.read.parquet(f"{folder}/labels.parquet"))
        held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
        model = quality.train(docs, ratings.filter(~held), 3)
        assert (np.diff(model.thresholds) > 0).all()
        got = quality.grade(docs, model).join(ratings.filter(held), "doc_id").select("grade", "tail_probability").collect()
        assert np.mean([(r["tail_probability"] >= 0.5) == (r["grade"] > 0) for r in got]) > 0.95

    def test_thresholds_recover_grades(self):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(3000, 4)).astype(np.float32)
        grades = np.digitize(x @ [2, -1, 0, 0.5] + rng.logistic(size=3000), [-2, 0, 2])
        model = quality.fit_ordinal(x, grades, 4, penalty=0)
        assert np.allclose(model.weights, [2, -1, 0, 0.5], atol=0.3) and np.allclose(model.thresholds, [-2, 0, 2], atol=0.3)
        tails = model.tails(x)
        assert (np.diff(tails, axis=1) <= 0).all()

    def test_odd_rows(self, spark, documents):
        docs = documents([(1, "good words stand here"), (2, None), (3, ""), (4, "x" * 100_000), (None, "a"), (1, "good words stand here")])
        ratings = spark.createDataFrame([(1, 1), (2, 0), (77, 1), (None, 0), (3, 9)], "doc_id bigint, grade int")
        out = quality.grade(docs.withColumn("expected_grade", F.lit("z")), quality.train(docs, ratings, 2)).collect()
        assert len(out) == 6 and all(0 <= r["tail_probability"] <= 1 for r in out)
        assert len({r["tail_probability"] for r in out if r["doc_id"] in (2, 3)}) == 1
        empty = quality.grade(documents([]), quality.train(documents([]), ratings, 2))
        assert empty.count() == 0


class TestToxicity:
    def test_kernel_is_the_gapped_subsequence_kernel(self):
        def brute(s, t):
            total = 0.0
            for a in range(len(s)):
                for b in range(a + 1, len(s)):
                    for c in range(b + 1, len(s)):
                        for d in range(len(t)):
                            for e in range(d + 1, len(t)):
                                for f in range(e + 1, len(t)):
                                    if (s[a], s[b], s[c]) == (t[d], t[e], t[f]):
                                        total += toxicity.DECAY ** (c - a + f - d)
            return total
        words = ["<idiot>", "<idxiot>", "<aaaa>", "<clown>", "<cloewn>"]
        got = toxicity.kernel(words, words)
        for i, s in enumerate(words):
            for j, t in enumerate(words):
                assert got[i, j] == pytest.approx(brute(s, t) / (brute(s, s) * brute(t, t)) ** 0.5, rel=1e-4)

    def test_machine_tolerates_gaps(self):
        rng = random.Random(5)
        toxic = ["<idiot>", "<moron>", "<stupid>", "<worthless>"]
        clean = list({"<" + "".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(4, 10))) + ">" for _ in range(800)})
        machine = toxicity.fit_machine(toxic, clean)
        scores = dict(zip(["idiot", "idioot", "i.d.i.o.t", "stu-pid", "worthlxess"], toxicity.worst_margins(machine, ["idiot", "idioot", "i.d.i.o.t", "so stu-pid you", "a worthlxess b"], {})))
        assert all(v > 0 for v in scores.values()), scores
        assert toxicity.worst_margins(machine, ["you i d i o t you"], {})[0] > 0
        assert np.mean(machine.margins(clean) < 0) > 0.98
        assert toxicity.worst_margins(machine, ["some " * 30_000 + "idiot"], {})[0] > 0

    def test_held_out_accuracy(self, spark):
        folder = "/root/testdata/sf0.1"
        docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
        held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
        machine = toxicity.train(docs, labels.filter(~held))
        got = toxicity.score_toxicity(docs, machine).join(labels.filter(held), "doc_id").select("toxic", "toxicity").collect()
        hit = [r["toxicity"] >= 0.5 for r in got if r["toxic"] == 1]
        assert np.mean(hit) > 0.8 and np.mean([r["toxicity"] < 0.5 for r in got if r["toxic"] == 0]) > 0.95

    def test_odd_rows(self, spark, documents):
        labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
        docs = documents([(1, "bad bad"), (2, "fine"), (3, None), (4, ""), (5, "z" * 50_000), (None, "...")])
        out = toxicity.score_toxicity(docs.withColumn("margin", F.lit("x")), toxicity.train(docs, labels)).collect()
        assert len(out) == 6 and all(0 <= r["toxicity"] <= 1 for r in out)
        assert toxicity.score_toxicity(documents([]), toxicity.fit_machine([], [])).count() == 0
