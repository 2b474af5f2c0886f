"""Document fingerprints: Merkle trees over sections and paragraphs.

A paragraph is a line with its line break. A section ends after an empty line and, in text without such, after any
paragraph whose digest ends in 0, so that an insertion moves only the section it falls in. A paragraph's digest is the
SHA-256 of its bytes, a section's that of its paragraphs' digests, the root that of the sections' digests: equal roots
mean equal texts. Below the paragraphs the fingerprint keeps short digests of blocks of up to eight words, which locate
an edit inside a long paragraph and give the likeness of two fingerprints.

Layout of the string: ``root|section;section...`` with a section as ``digest(paragraphs)`` and a paragraph
as ``digest:block.block...,``; all digests in lowercase hex (64 characters the root, 16 sections and paragraphs, 8
blocks). A null or empty text has the root of no sections and nothing after the bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souba.functions.text import let
from souba.llm.common import replaced, written

PARAGRAPH_END = r"(?<=\n)"
# up to seven words that end no sentence, then one that may
BLOCK = r"(\s*+(?:\S*+(?<![.!?])\s++){0,7}+\S++)"


def _tree(text: Column) -> Column:
    """The fingerprint of a text that is not null, in the layout above."""
    def leaf(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(1)),
                             lambda b: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.trim(b)))), 16, "0"), 1, 8))
        return let(F.sha2(p, 256), lambda digest: F.struct(
            digest.alias("digest"), F.array_join(blocks, ".").alias("blocks"),
            F.when((p == "\n") | digest.endswith("0"), F.lit(";")).otherwise(F.lit("")).alias("end")))

    def finish(leaves: Column) -> Column:
        # strings with a mark after each section's last paragraph: splitting them is linear, nesting arrays is not
        digests = F.split(F.array_join(F.transform(leaves, lambda x: F.concat(x["digest"], F.lit(","), x["end"])), ""), ";")
        insides = F.split(F.array_join(F.transform(leaves, lambda x: F.concat(
            F.substring(x["digest"], 1, 16), F.lit(":"), x["blocks"], F.lit(","), x["end"])), ""), ";")
        sections = F.zip_with(F.transform(digests, lambda d: F.sha2(d, 256)), insides,
                              lambda d, i: F.struct(d.alias("digest"), i.alias("inside")))
        return let(F.filter(sections, lambda x: x["inside"] != ""), lambda p: F.concat(
            F.sha2(F.array_join(p["digest"], ","), 256), F.lit("|"),
            F.array_join(F.transform(p, lambda x: F.concat(F.substring(x["digest"], 1, 16), F.lit("("), x["inside"], F.lit(")"))), ";")))
    return let(F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: p != ""), leaf), finish)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string; equal for equal texts only. Null counts as empty."""
    return _tree(F.coalesce(text, F.lit("")))


def root(print_: Column) -> Column:
    """The digest of the whole text."""
    return F.substring(print_, 1, 64)


def _blocks(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(r"(?<=[:.])([0-9a-f]{8})(?=[.,])"), F.lit(1)))


def likeness(one: Column, other: Column) -> Column:
    """1 for equal roots, else the share of word blocks that two fingerprints have in common (0 where neither has any)."""
    pair = F.struct(_blocks(one).alias("a"), _blocks(other).alias("b"))
    counts = let(pair, lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("both"),
                                          (F.size(p["a"]) + F.size(p["b"])).alias("sum")))
    share = let(counts, lambda c: c["both"] / F.greatest(c["sum"] - c["both"], F.lit(1)))
    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(share)


def differing_branches(one: Column, other: Column) -> Column:
    """Where ``one`` differs: array of struct(section, paragraph), counted from 0, of the paragraphs that ``other``
    lacks. Sections with a digest that ``other`` also has are passed over whole; equal roots give an empty array."""
    section = r"([0-9a-f]{16}\([^)]*\))"
    mine = F.regexp_extract_all(one, F.lit(section), F.lit(1))
    theirs = F.transform(F.regexp_extract_all(other, F.lit(section), F.lit(1)), lambda s: F.substring(s, 1, 16))
    known = F.regexp_extract_all(other, F.lit(r"(?<=[(,])([0-9a-f]{16})(?=:)"), F.lit(1))
    found = F.flatten(F.transform(mine, lambda s, i: F.when(
        F.array_contains(theirs, F.substring(s, 1, 16)), F.expr("array()").cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"(?<=[(,])([0-9a-f]{16})(?=:)"), F.lit(1)), lambda p, j: F.when(
            ~F.array_contains(known, p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull()))))
    return F.when(root(one) == root(other), F.expr("array()").cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def ids_before(ids: DataFrame, key: str, size: str) -> DataFrame:
    """Each distinct id (``key``) with the next higher one and its size (``before``, ``before_size``; the largest
    where an id repeats); before the highest stands the lowest. Null is the lowest of all.

    Ids and sizes alone are range-partitioned and written; windows run over each range, then over one row per range.
    """
    sized = ids.groupBy(F.col(key).alias("key")).agg(F.max(size).alias("size"))
    ranged = sized.repartitionByRange(F.col("key").desc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "idranges")
    pair = F.struct("key", "size")
    tails = ranged.groupBy("part").agg(F.min_by(pair, F.struct(F.col("key").isNotNull(), "key")).alias("tail"))
    order = Window.orderBy("part")
    last = F.last("tail").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tails = tails.select("part", F.coalesce(F.lag("tail").over(order), last).alias("tail"))
    inside = Window.partitionBy("part").orderBy(F.col("key").desc_nulls_last())
    chained = ranged.withColumn("higher", F.lag(pair).over(inside)).join(tails, "part")
    higher = F.coalesce("higher", "tail")
    return chained.select("key", higher["key"].alias("before"), higher["size"].alias("before_size"))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text but with ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the document's with its last floor(n/2) code points replaced by the first as many of the next
    document, in descending order of id; the lowest id (null below all) is followed by the highest. Null texts are
    empty. Rows that share an id each get a row; as a next document that id stands for its smallest text. A single
    id follows itself; an empty table stays empty. Columns named like a result give way.
    """
    same = ["_k", "_z"]

    def matched(name: str) -> list[Column]:      # an id as two columns that are never null
        return [F.coalesce(F.col(name).cast("string"), F.lit("")), F.col(name).isNull()]
    own = docs.withColumns(dict(zip(same, matched(f"`{key}`")))).withColumn(text, F.coalesce(f"`{text}`", F.lit(""))).withColumnRenamed(text, "_text")
    chain = ids_before(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.char_length(f"`{text}`"), F.lit(0)).alias("size")), "key", "size")
    chain = chain.select(*[c.alias(n) for c, n in zip(matched("key") + matched("before"), [*same, "_bk", "_bz"])], "before_size")
    # what a document gives to the one before it: the code points that may be wanted, and its fingerprint
    order = Window.partitionBy(*same).orderBy("_text", f"`{key}`")
    given = own.withColumn("_first", F.lag(F.lit(1)).over(order).isNull()).filter("_first").join(chain, same)
    given = given.select(F.col("_bk").alias("_k"), F.col("_bz").alias("_z"), F.expr("left(_text, before_size div 2)").alias("_next_text"),
                         fingerprint(F.col("_text")).alias("_next_print"))
    both = own.join(given, same).drop(*same).withColumn("_print", fingerprint(F.col("_text")))
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(F.expr("left(_text, char_length(_text) - cast(floor(char_length(_text) / 2) as int))"),
                      F.expr("left(_next_text, cast(floor(char_length(_text) / 2) as int))"))
    both = both.withColumn("_edited", F.when(half > 0, edited).otherwise(F.col("_text")))
    both = both.withColumn("_edited_print", fingerprint(F.col("_edited")))
    out = replaced(both, n_chars=F.char_length("_text").cast("bigint"), edited_sha256=F.sha2("_edited", 256),
                   fingerprint=F.col("_print"), edited_fingerprint=F.col("_edited_print"),
                   near_edited=likeness(F.col("_print"), F.col("_edited_print")),
                   near_next=likeness(F.col("_print"), F.col("_next_print")))
    return out.drop("_text", "_print", "_next_text", "_next_print", "_edited", "_edited_print")
