"""The registered queries of this subpackage, each beside its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from souba.functions.text import let
from souba.llm import chat, decontaminate, fingerprints, jaccard, mixing, periodic, quality, search, sharding, suffixes, toxicity, vectors, warc
from souba.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]
SHARD_BYTES = 1 << 20


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's Merkle fingerprint beside that of its edited text and of the next document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fingerprints.with_edits(docs)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records into Zstandard archives, then read back, headers and lengths checked."""
    archives = written(warc.write_archives(warc.plan_records(table(spark, folder, "pages"))), "archives")
    return warc.read_archives(archives, payloads=False).drop("payload")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of at most one MiB of text, by extendible hashing."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARD_BYTES).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).drop("text")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity by a subsequence-kernel machine that never saw the held-out fifth of the labels."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = toxicity.train(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
                         F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as records of several layouts, mapped to turns, formatted, and read back from the training text."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id bigint, turn bigint, role string, text string")
    chats = chat.format_chats(chat.gather_records(rows.unionByName(extra)))
    back = chats.withColumn("t", chat.read_turns(F.col("formatted")))
    told = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    def under_loss(turn: Column, i: Column) -> Column:
        """What of a turn is under the loss, by its three runs."""
        at, parts = F.lit(1), []
        for k in range(3):
            run = F.get("mask", i * 3 + k)
            parts.append(F.when(run["loss"], F.substring(F.concat(turn, F.lit(chat.END)), at, run["chars"])).otherwise(""))
            at = at + run["chars"]
        return F.concat(*parts)
    turns = F.filter(F.split("formatted", chat.END), lambda p: p != "")
    whole = F.aggregate("mask", F.lit(0), lambda n, run: n + run["chars"]) == F.char_length("formatted")     # else null
    learned = F.when(whole, F.array_join(F.transform(turns, lambda p, i: chat.unescape(under_loss(p, i))), ""))
    back = back.withColumn("told", told).withColumn("learned", learned)
    return back.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
                       F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of 150 % of all words, sources weighing 3, 1, 2 in turn, takes of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mix = mixing.mix(docs)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside benchmark windows, the items hit, and whether 5 % of it is."""
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    found = decontaminate.find_hits(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without the bytes of 200-byte strings that start elsewhere too."""
    return suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of 5-word shingles and the class it is linked to at a Jaccard similarity of 0.75."""
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's expected grade, the probability that it is above the lowest grade, and whether it is kept."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = quality.train(docs, quality.graded_labels(labels), 3)
    return quality.grade(docs, model).drop("text").withColumn("keep", F.col("tail_probability") >= 0.5)


def op11_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's number of links at a cosine of 0.9, its class, and whether it stands for it."""
    return vectors.link_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding")).drop("embedding")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents whose hash ends in 0 with their words from a on repeating the p words there; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            x["w"], lambda w, i: F.when(i >= x["a"], F.get(x["w"], x["a"] + (i - x["a"]) % x["p"])).otherwise(w)), " "))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    edited = let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))
    return docs.withColumn("text", F.when(h % 10 == 0, edited).otherwise(F.col("text")))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's periodic runs of words, the longest of them, and a digest of the text without their repeats."""
    docs = with_planted_period(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"), F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each benchmark item, all items scored together over the term sets they share."""
    return search.rank_documents(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_fingerprints, op2_warc, op3_sharding, op4_toxicity, op5_chat, op6_mixing, op7_decontaminate,
                                                     op8_suffixes, op9_jaccard, op10_quality, op11_vectors, op12_periods, op13_search)}
QUERIES["pipeline"] = corpus_pipeline.run

_HASH = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"

ORACLES: dict[str, str] = {
    "op9_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * m >= 75 * (p.n + q.n - m)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
k AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents JOIN k ON v = doc_id LEFT JOIN n USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
bits AS (SELECT page_id, url, html, first, list_transform(range(0, 32), lambda i:
    ('0x' || substr(hex, CAST(i * 5 // 4 + 1 AS INT), 1))::INT * 16 + ('0x' || substr(hex || '0', CAST(i * 5 // 4 + 2 AS INT), 1))::INT) AS v
  FROM p JOIN f USING (hex))
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((v[i + 1] // (CASE i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url AS target_uri, CAST(NULL AS VARCHAR) AS error
FROM bits""",
    "op3_sharding": f"""
WITH h AS (SELECT doc_id, {_HASH} AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents),
nodes AS (SELECT d, h >> (60 - d) AS node, sum(n_bytes) AS b, count(*) AS n FROM h, range(0, 37) AS r(d) GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES}),
best AS (SELECT doc_id, n_bytes, h, min(d) AS d FROM h JOIN nodes ON h >> (60 - d) = node GROUP BY ALL)
SELECT doc_id, n_bytes, 's' || substr(lpad(bin(h), 60, '0'), 1, CAST(best.d AS INT)) AS shard, CAST(best.d AS INT) AS shard_depth,
  CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs
FROM best JOIN nodes ON best.d = nodes.d AND h >> (60 - nodes.d) = node""",
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS e FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(e) + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    (((('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT >> 8)::DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, cap > w * level AS open, first_value(CASE WHEN cap > w * level THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS stop FROM l),
t AS (SELECT source, source_size, docs, CASE WHEN open THEN w * stop ELSE cap END AS target FROM o),
p AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS part FROM t),
r AS (SELECT d.doc_id, d.size, p.*, CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part) *
    least(greatest(d.size / (source_size::DOUBLE / docs), 0.5), 2.0)) END AS rank
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM r)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN part > 0 AND upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op7_decontaminate": r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM it WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, pos.n, item FROM pos JOIN win ON pos.key = win.key AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0
      AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
k AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN k ON v = vec_id""",
    "op13_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN t USING (term) JOIN i USING (term), a GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op12_periods": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(range(0, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1))::BIGINT END),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w FROM g),
p AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM e),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq) GROUP BY doc_id, q, island
      HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
      arg_max(struct_pack(s := start, n := length, q := period), (length, -start, -period)) AS best FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND p.i >= r.start + r.period AND p.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
