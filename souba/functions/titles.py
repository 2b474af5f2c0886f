"""Structured titles and spec blocks of single shops."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from souba import fixed_values as fv
from souba.functions.text import (
    UNICODE, blank_to_null, first_match, has_any, inches_between, let, starts_with_any, strip,
)


def _last(items: Column) -> Column:
    """Last element or null."""
    return F.try_element_at(items, F.lit(-1))


def _first_rule_wins(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds."""
    kind = F.when(F.lit(False), "")
    for name, rule in rules:
        kind = kind.when(rule, name)
    return kind


def _of_kind(parts: Column, name: str) -> Column:
    """Texts of one kind out of an array of structs (kind, text)."""
    return F.transform(F.filter(parts, lambda p: p["kind"] == name), lambda p: p["text"])


def _classify(texts: Column, rules) -> Column:
    return F.transform(texts, lambda t: F.struct(_first_rule_wins(rules(t)).alias("kind"), t.alias("text")))


# --- H13 -------------------------------------------------------------------
def canonical_model(title: Column) -> Column:
    """H13 canonical model name of the ThinkPad, IdeaPad, Latitude and Inspiron lines.

    Family names get their usual spelling, e-series Latitude numbers a capital E.
    """
    series = lambda family, token: blank_to_null(
        F.regexp_extract(title, rf"(?i){family}\s*({token})", 1))
    named = lambda family, value: F.concat(F.lit(family + " "), value)
    capital = lambda value: F.concat(F.upper(F.left(value, F.lit(1))), F.substring(value, 2, 40))
    x1 = series("ThinkPad", r"X1\s+(?:Carbon|Yoga|Nano|Extreme|Tablet|Fold|Titanium)")
    x1 = F.concat(F.lit("X1 "), F.initcap(F.regexp_extract(x1, r"(?i)X1\s+(\w+)", 1)))
    return F.coalesce(
        named("ThinkPad", x1),
        named("ThinkPad", capital(series("ThinkPad", r"[A-Za-z]{1,2}\d{1,4}[A-Za-z]{0,2}"))),
        named("IdeaPad", capital(series("IdeaPad", r"[A-Za-z]+\d+[A-Za-z]*"))),
        named("Latitude", F.upper(series("Latitude", r"[A-Za-z]?\d{4}"))),
        named("Inspiron", series("Inspiron", r"\d{2,4}")),
    )


# --- H18 -------------------------------------------------------------------
def bracket_specs(title: Column) -> Column:
    """H18 specs of a ``［CPU／RAM／Storage／Screen／OS］`` title; later parts win."""
    def inside(t: Column) -> Column:
        start, end = F.instr(t, "［"), F.instr(t, "］")
        return F.when((start > 0) & (end > 0), F.substring(t, start + 1, F.greatest(end - start - 1, F.lit(0))))

    def fields(parts: Column) -> Column:
        of = lambda name: _of_kind(parts, name)
        inch = F.transform(of("screen"), lambda p: strip(
            F.replace(F.replace(p, F.lit("インチワイド"), F.lit("")), F.lit("インチ"), F.lit(""))).try_cast("double"))
        cpu = F.split_part(F.split_part(_last(of("cpu")), F.lit("("), F.lit(1)), F.lit("（"), F.lit(1))
        return F.struct(
            strip(cpu).alias("cpu"),
            _last(of("memory")).alias("memory"),
            strip(F.replace(_last(of("ssd")), F.lit("SSD"), F.lit(""))).alias("ssd"),
            strip(F.replace(_last(of("hdd")), F.lit("HDD"), F.lit(""))).alias("hdd"),
            _last(F.filter(inch, lambda x: x.isNotNull())).alias("display_size"),
            _last(of("os")).alias("os"))

    parts = F.filter(F.transform(F.split(let(title, inside), "／"), strip), lambda p: p != "")
    return let(_classify(parts, lambda p: [
        ("cpu", starts_with_any(p, fv.BRACKET_CPU_WORDS)),
        ("memory", p.rlike(r"(?U)^\d+GB$")),
        ("ssd", p.startswith("SSD")),
        ("hdd", p.startswith("HDD")),
        ("screen", p.contains("インチ")),
        ("os", has_any(p, fv.BRACKET_OS_WORDS)),
    ]), fields)


# --- H19 -------------------------------------------------------------------
def slash_specs(title: Column) -> Column:
    """H19 specs of a ``Brand Series(OS) 中古 CPU/RAM/Storage/Size [condition]`` title."""
    def os_of(t: Column) -> Column:
        open_at, close_at = F.instr(t, "("), F.instr(t, ")")
        paren = F.when((open_at > 0) & (close_at > 0),
                       F.substring(t, open_at + 1, F.greatest(close_at - open_at - 1, F.lit(0))))
        return let(paren, lambda p: F.when(p.contains("Win") | F.lower(p).contains("mac"), p))

    def tail(t: Column) -> Column:
        after = F.substring(t, F.instr(t, "中古") + 2, F.length(t))
        return F.when(t.contains("中古"), F.split_part(after, F.lit("["), F.lit(1)))

    def fields(parts: Column) -> Column:
        of = lambda name: _of_kind(parts, name)
        storage = lambda name: strip(F.regexp_replace(_last(of(name)), "SSD|NVMe|HDD", ""))
        sizes = F.transform(of("size"), lambda p: inches_between(strip(F.regexp_replace(
            F.regexp_replace(F.regexp_replace(p, "フルHD", ""), "WUXGA", ""), "HD|インチ", ""))))
        return F.struct(
            os_of(title).alias("os"),
            _last(of("cpu")).alias("cpu"),
            strip(F.replace(_last(of("memory")), F.lit("メモリ"), F.lit(""))).alias("memory"),
            storage("ssd").alias("ssd"),
            storage("hdd").alias("hdd"),
            _last(F.filter(sizes, lambda s: s.isNotNull())).alias("display_size"))

    parts = F.filter(F.transform(F.split(let(title, tail), "/"), strip), lambda p: p != "")
    return let(_classify(parts, lambda p: [
        ("cpu", has_any(p, fv.SLASH_CPU_WORDS)),
        ("memory", p.contains("GB") & (p.contains("メモリ") | F.replace(p, F.lit("GB"), F.lit("")).rlike(r"(?U)^\d+$"))),
        ("hdd", p.contains("HDD")),
        ("ssd", p.contains("SSD") | p.contains("NVMe")),
        ("size", F.lit(True)),
    ]), fields)


# --- H20 -------------------------------------------------------------------
def block_specs(block: Column) -> Column:
    """H20 specs of a block whose lines start with their label."""
    def fields(block: Column) -> Column:
        line = lambda label: strip(first_match(block, rf"{label}\s*(.+?)(?:\n|$)"))
        generation = first_match(block, r"CPU世代\s*第(\d+)世代")
        memory = first_match(block, r"メモリ\s*(\d+)\s*GB")
        storage = let(F.regexp_extract(block, UNICODE + fv.BLOCK_STORAGE, 0), lambda s: F.struct(
            blank_to_null(F.regexp_replace(s, r"(?sU)^\D*(\d+)\s*(GB|TB).*$", "$1$2")).alias("size"),
            (s.contains("HDD") & ~s.contains("SSD")).alias("hdd")))
        return F.struct(
            line("メーカ").alias("brand"),
            line("シリーズ名").alias("series"),
            line("型名").alias("model_number"),
            strip(first_match(block, fv.BLOCK_OS)).alias("os"),
            strip(first_match(block, fv.BLOCK_CPU)).alias("cpu"),
            F.concat(F.lit("第"), generation, F.lit("世代")).alias("cpu_gen"),
            F.concat(memory, F.lit("GB")).alias("memory"),
            let(storage, lambda s: F.when(~s["hdd"], s["size"])).alias("ssd"),
            let(storage, lambda s: F.when(s["hdd"], s["size"])).alias("hdd"),
            first_match(block, r"商品番号\s*(\S+)").alias("product_id"))

    return let(block, fields)


# --- H21 -------------------------------------------------------------------
def label_specs(texts: Column) -> Column:
    """H21 specs of a list of short texts; the first rule that fits a text takes it, later texts win."""
    storage = r"(?iU)(SSD|HDD|NVMe)\s*(\d+)\s*GB"

    def fields(parts: Column) -> Column:
        of = lambda name: _last(_of_kind(parts, name))
        ram = F.regexp_extract(of("memory"), r"(?U)メモリ\s*(\d+)\s*GB", 1).try_cast("int")
        kind = F.upper(F.regexp_extract(of("storage"), storage, 1))
        size = F.nullif(F.regexp_extract(of("storage"), storage, 2).try_cast("int"), F.lit(0))
        capacity = F.concat(size.cast("string"), F.lit("GB"))
        return F.struct(
            F.concat(F.nullif(ram, F.lit(0)).cast("string"), F.lit("GB")).alias("memory"),
            F.when(kind != "HDD", capacity).alias("ssd"),
            F.when(kind == "HDD", capacity).alias("hdd"),
            F.regexp_extract(of("screen"), r"(?U)([\d.]+)\s*インチ", 1).try_cast("double").alias("display_size"),
            F.regexp_extract(of("condition"), r"(?U)状態ランク[：:]\s*(\S+)", 1).alias("condition"))

    return let(_classify(F.transform(texts, strip), lambda t: [
        ("memory", t.rlike(r"(?U)メモリ\s*\d+\s*GB")),
        ("storage", t.rlike(storage)),
        ("screen", t.rlike(r"(?U)[\d.]+\s*インチ")),
        ("condition", t.rlike(r"(?U)状態ランク[：:]\s*\S+")),
    ]), fields)
