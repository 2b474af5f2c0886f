"""Accessory filter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from souba import fixed_values as fv
from souba.functions.text import literal_pattern, strip


@dataclass(frozen=True)
class NoiseRules:
    """B8 word lists and genres; pass longer ones to extend the filter."""

    noise_keywords: list[str] = field(default_factory=lambda: list(fv.NOISE_KEYWORDS))
    computer_keywords: list[str] = field(default_factory=lambda: list(fv.COMPUTER_KEYWORDS))
    noise_genres: list[str] = field(default_factory=lambda: list(fv.NOISE_GENRES))
    computer_genres: list[str] = field(default_factory=lambda: list(fv.COMPUTER_GENRES))


def _rules_as_columns(rules: NoiseRules, name: Column, genre: Column) -> tuple[Column, Column]:
    """Does the title name an accessory, and the verdict on the listing.

    Each word list is searched at most once per title; the computer words only
    where an accessory word was found. A listing without title gets no verdict.
    """
    genre = strip(F.coalesce(genre.cast("string"), F.lit("0")))
    accessory = name.rlike("(?iu)(?:" + literal_pattern(rules.noise_keywords) + ")")
    computer = name.rlike("(?iu)(?:" + literal_pattern(rules.computer_keywords) + ")")
    verdict = (
        F.when(genre.isin(rules.noise_genres), "noise_genre")
        .when(name.isNull(), F.lit(None).cast("string"))
        .when(~accessory, "clean")
        .when(genre.isin(rules.computer_genres), "mislabelled")
        .when(computer, "uncertain")
        .otherwise("accessory")
    )
    return accessory, verdict


def filter_computers(df: DataFrame, rules: NoiseRules | None = None,
                     name: str = "itemName", genre: str = "genreId") -> DataFrame:
    """B7 drop accessories; listings with mixed signals stay, marked ``is_uncertain``.

    One narrow filter, no shuffle. Only the title is searched. What is kept
    and names an accessory is exactly what is uncertain.
    """
    accessory, verdict = _rules_as_columns(rules or NoiseRules(), F.col(name), F.col(genre))
    return df.where(verdict.isin("clean", "uncertain")).withColumn("is_uncertain", accessory)


def filter_report(df: DataFrame, rules: NoiseRules | None = None,
                  name: str = "itemName", genre: str = "genreId", by: list[str] | None = None) -> DataFrame:
    """D15 what the filter does to a table, in one aggregation."""
    _, verdict = _rules_as_columns(rules or NoiseRules(), F.col(name), F.col(genre))
    judged = df.select(*(by or []), verdict.alias("_verdict"))
    times = lambda kind: F.count_if(F.col("_verdict") == kind)
    return judged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        times("noise_genre").alias("noise_genre_rejected"),
        times("mislabelled").alias("keyword_rejected"),
        times("uncertain").alias("uncertain_kept"),
        times("clean").alias("clean_kept"))
