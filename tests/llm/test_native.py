"""Fingerprints, shards, chat formats and mixes: brute force, round trips, plans, odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from souba.llm import chat, fingerprints, mixing, queries, sharding

ODD = [(1, None), (2, ""), (3, "a"), (4, "one line\n\nsecond section. More words here"), (5, "one line\n\nsecond section. More words here"),
       (6, "x" * 50_000), (7, " \n\t \n"), (8, "emoji 😀 und ümläute\r\n" * 40), (9, "word " * 30_000)]


def _no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


class TestFingerprints:
    def test_edits_and_digests_match_brute_force(self, documents):
        rows = ODD + [(i, " ".join(random.Random(i).choices("ab cd ef gh. ij\nkl".split(" "), k=i * 3))) for i in range(10, 40)]
        got = {r["doc_id"]: r for r in fingerprints.with_edits(documents(rows)).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        for k, (i, text) in enumerate(order):
            text, following = text or "", order[(k + 1) % len(order)][1] or ""
            half = len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            assert got[i]["n_chars"] == len(text)
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (text == edited)
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            assert (got[i]["near_edited"] == 1) >= (text == edited)
        assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"]
        assert len({r["fingerprint"] for r in got.values()}) == len({t or "" for _, t in rows})

    def test_repeated_and_null_ids(self, documents):
        got = fingerprints.with_edits(documents([(1, "b"), (1, "a"), (1, "a"), (None, "cc"), (5, "dddd")])).collect()
        assert len(got) == 5
        by = {r["doc_id"]: r for r in got}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert by[5]["edited_sha256"] == sha("dda") and by[None]["edited_sha256"] == sha("cd")

    def test_single_and_empty(self, documents):
        assert fingerprints.with_edits(documents([])).count() == 0
        assert fingerprints.with_edits(documents([(1, "ab")])).first()["near_next"] == 1.0

    def test_clashing_columns_give_way(self, documents):
        out = fingerprints.with_edits(documents([(1, "ab")]).withColumn("fingerprint", F.lit(3)).withColumn("near_next", F.lit("x")))
        assert out.columns.count("fingerprint") == 1 and dict(out.dtypes)["near_next"] == "double"

    def test_branches_locate_an_edit(self, spark):
        lines = [f"line {i} with some words" for i in range(60)]
        changed = lines[:30] + ["quite another line"] + lines[31:]
        df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
        prints = df.select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
        found = prints.select(fingerprints.differing_branches(F.col("a"), F.col("b")).alias("d"),
                              fingerprints.likeness(F.col("a"), F.col("b")).alias("l"),
                              fingerprints.differing_branches(F.col("a"), F.col("a")).alias("same")).first()
        assert len(found["d"]) == 1 and found["l"] > 0.9 and found["same"] == []

    def test_native(self, documents):
        _no_python(fingerprints.with_edits(documents([(1, "a")])))


class TestSharding:
    def brute(self, rows, limit):
        hashed = [(int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]

        def place(h):
            for depth in range(61):
                total = sum(n for g, n in hashed if g >> (60 - depth) == h >> (60 - depth))
                if total <= limit or depth == 60:
                    return "s" + (f"{h:060b}"[:depth]), total
        return Counter(place(h) for h, _ in hashed)

    @pytest.mark.parametrize("limit", [10, 300, 5_000, 10**9])
    def test_matches_brute_force(self, documents, limit):
        rows = [(i, "x" * (i % 90)) for i in range(200)] + [(None, None), (None, "null id"), (3, "again"), (9999, "y" * 400)]
        got = sharding.assign_shards(documents(rows), limit)
        assert Counter((r["shard"], r["shard_bytes"]) for r in got.collect()) == self.brute(rows, limit)

    def test_one_huge_row_and_empty(self, documents):
        got = sharding.assign_shards(documents([(1, "x" * 100), (2, "y")]), 10).orderBy("doc_id").collect()
        assert got[0]["shard_depth"] == 60 and got[0]["shard_bytes"] == 100 and got[1]["shard_bytes"] == 1
        assert sharding.assign_shards(documents([]), 10).count() == 0

    def test_clashing_columns_and_plan(self, documents):
        out = sharding.assign_shards(documents([(1, "x")]).withColumn("shard", F.lit(1)).withColumn("SHARD_BYTES", F.lit("z")), 10)
        assert sorted(c.lower() for c in out.columns).count("shard_bytes") == 1
        _no_python(out)


class TestChat:
    TEXTS = ["", "plain", "a\\b", "\\", "\\\\", "#", "##", "###", "####", "#\\#", "</turn>", "</turn>\n", "<", "</tur", "<\\/turn>", "### assistant: x</turn>\n",
             "\\### Assistant: </turn> ok", "ü😀 \r\n\t", "line\nline", ":", ": ", "\\:", "a" * 20_000, "#" * 3001]

    def test_round_trip_of_every_pair(self, spark):
        rows = [(k, [{"role": r, "text": t} for r, t in zip(self.TEXTS[k:] + self.TEXTS[:k], self.TEXTS)]) for k in range(0, len(self.TEXTS), 3)]
        df = spark.createDataFrame(rows, "k int, turns array<struct<role:string,text:string>>").withColumn("f", chat.format_turns(F.col("turns")))
        for r in df.select("turns", chat.read_turns(F.col("f")).alias("back")).collect():
            assert r["turns"] == r["back"]

    def test_escaped_texts_hold_no_control_string(self, spark):
        df = spark.createDataFrame([(t,) for t in self.TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
        for r in df.collect():
            assert "</turn>" not in r["e"] and "###" not in r["e"] and r["u"] == r["t"]

    def test_mask_covers_assistant_texts_only(self, spark):
        turns = [{"role": r, "text": t} for r, t in [("user", "hi"), ("assistant", "a##b"), ("assistant", ""), ("system", "s"), ("assistant", "</turn>")]]
        df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
        r = df.select(chat.format_turns(F.col("turns")).alias("f"), chat.loss_mask(F.col("turns")).alias("m")).first()
        at, learned = 0, ""
        for run in r["m"]:
            learned += r["f"][at:at + run["chars"]] if run["loss"] else ""
            at += run["chars"]
        assert at == len(r["f"]) and learned == "a#\\#b<\\/turn>"

    def test_layouts_by_fingerprint(self, spark):
        records = ['{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"conversations":[{"from":"user","value":"a"},{"from":"assistant","value":"b"}]}',
                   '{"prompt":"a","completion":"b"}', '{"output":"b","instruction":"a"}', '{"dialog":{"turns":[{"speaker":"user","utterance":"a"},{"speaker":"assistant","utterance":"b"}]}}']
        odd = ['{"foo":1}', "no json", None, "{}", '{"messages":[]}', '{"prompt":"a","completion":null}']
        out = chat.to_turns(spark.createDataFrame([(i, r) for i, r in enumerate(records + odd)], "i int, record string")).orderBy("i").collect()
        for r in out[:len(records)]:
            assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "a"), ("assistant", "b")]
        assert [r["layout"] for r in out[len(records):]] == [None, None, None, None, "messages", "prompt"]
        assert out[-2]["turns"] == [] and out[-1]["turns"][1]["text"] == ""

    def test_long_records_are_read_like_short_ones(self, spark, monkeypatch):
        records = ['{"messages":[{"role":"user","content":"a"},{"role":"x\\"y","content":"</turn>"},null,{"content":"{\\"b\\":[1,","role":null}]}', '{"prompt":"a:","completion":null}',
                   '{"dialog" : {"turns":[{"speaker":"a","utterance":"\\u00fc\\\\"},{"speaker":"a","utterance":7}]}}', '{"messages":[]}', '{"foo":{"prompt":"b","a,b":["x",{"c":1}]}}']
        df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
        turns = [(i % 5, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(self.TEXTS)]
        turns = chat.gather_records(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))

        def found():
            return [sorted(map(str, out.collect())) for out in (chat.to_turns(df), chat.format_chats(turns), df.select(chat.schema_paths(F.col("record")).alias("p")))]
        short = found()
        monkeypatch.setattr(chat, "WHOLE", 5)
        assert found() == short

    def test_a_text_beyond_the_parsers_limit(self, spark):
        n = 20_000_001
        rows = spark.createDataFrame([(0, 0, "user"), (0, 1, "assistant"), (3, 0, "user"), (3, 1, "user"), (3, 2, "assistant")], "conv_id bigint, turn bigint, role string")
        rows = rows.withColumn("text", F.when(F.col("role") == "user", "q").otherwise(F.repeat(F.lit("x"), F.lit(n))))
        out = {r["conv_id"]: r for r in chat.format_chats(chat.gather_records(rows)).select("conv_id", "layout", F.length("formatted").alias("n"), F.size("mask").alias("m")).collect()}
        assert (out[0]["layout"], out[0]["n"], out[0]["m"]) == ("prompt", n + 19 + 23, 6)
        assert (out[3]["layout"], out[3]["n"], out[3]["m"]) == ("messages", n + 19 + 19 + 23, 9)

    def test_the_query_reads_the_mask(self, spark, monkeypatch):
        sound = {r["conv_id"]: r for r in queries.op5_chat(spark, "/root/testdata/sf0.001").collect()}
        assert sound[-7]["loss_chars"] == 26
        mask = chat.loss_mask
        monkeypatch.setattr(chat, "loss_mask", lambda turns: mask(turns, ("nobody",)))
        assert all(r["loss_chars"] == 0 for r in queries.op5_chat(spark, "/root/testdata/sf0.001").collect())

    def test_rows_with_nulls_ties_and_extra_columns(self, spark):
        rows = [(1, 0, "user", None, 5), (1, 1, None, "x", 5), (1, 1, "assistant", "b", 5), (1, 1, "assistant", "b", 5), (1, None, "system", "first", 5), (None, 0, "user", "q", 5)]
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, record int")
        out = {r["conv_id"]: r for r in chat.format_chats(chat.gather_records(df)).withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
        assert [(t["role"], t["text"]) for t in out[1]["t"]] == [("system", "first"), ("user", ""), ("", "x"), ("assistant", "b"), ("assistant", "b")]
        assert out[None]["t"][0]["text"] == "q"
        assert chat.format_chats(chat.gather_records(df.limit(0))).count() == 0


class TestMixing:
    def rows(self):
        rng = random.Random(4)
        names = ["a"] * 300 + ["b"] * 40 + ["c", "d", None] * 20 + ["Z"] * 5 + ["empty"] * 3
        return [(i, " ".join(["w"] * (0 if s == "empty" else int(rng.paretovariate(1.2) * 5) % 900)), s) for i, s in enumerate(names)]

    def frame(self, spark, rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def test_targets_and_words_taken(self, spark):
        rows = self.rows()
        got = mixing.mix(self.frame(spark, rows)).collect()
        sizes, taken, targets, largest = Counter(), Counter(), {}, Counter()
        for r in got:
            assert r["copies"] <= 2
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["copies"]
            targets[r["source"]] = r["target"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
            assert r["source_size"] == sum(len(t.split()) for _, t, s in rows if s == r["source"])
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, open_ = 1.5 * sum(sizes.values()), set(order)
        while True:     # water level by hand
            level = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if 2 * sizes[s] < weight[s] * level}
            if not over:
                break
            left -= sum(2 * sizes[s] for s in over)
            open_ -= over
        for s in order:
            want = weight[s] * level if s in open_ else 2 * sizes[s]
            assert targets[s] == pytest.approx(want)
            assert abs(taken[s] - want) <= largest[s] / 2 + 1

    def test_reruns_agree_on_any_partitioning(self, spark):
        df = self.frame(spark, self.rows())
        one, two = ({r["doc_id"]: r["copies"] for r in mixing.mix(x).collect()} for x in (df, df.repartition(7)))
        assert one == two

    def test_order_sample_is_unequal_but_certain_copies_are_whole(self, spark):
        rows = [(i, "w " * (5 if i % 2 else 50), "a") for i in range(2000)] + [(5000 + i, "w " * 20, "b") for i in range(2000)]
        got = mixing.mix(self.frame(spark, rows), weights=(1, 3), budget=1.2).collect()
        by = defaultdict(list)
        for r in got:
            by[(r["source"], r["size"])].append(r["copies"])
        assert sum(by["a", 50]) / len(by["a", 50]) > sum(by["a", 5]) / len(by["a", 5])     # longer ones have higher odds
        assert min(by["b", 20]) >= 1

    def test_odd_rows(self, spark):
        rows = [(None, "a b", "s"), (None, "a b", "s"), (1, None, "s"), (1, "", None), (2, "x " * 20_000, "t"), (2, "x " * 20_000, "t")]
        out = mixing.mix(self.frame(spark, rows).withColumn("SIZE", F.lit("clash")).withColumn("docs", F.lit(1)))
        assert out.count() == 6 and sorted(c.lower() for c in out.columns).count("size") == 1
        assert mixing.mix(self.frame(spark, [])).count() == 0
        assert mixing.mixed(self.frame(spark, rows).withColumn("copies", F.lit("kept"))).columns == ["doc_id", "text", "source", "copies"]
        _no_python(out)
