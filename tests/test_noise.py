"""B6-B8, D15."""

from __future__ import annotations

import pytest

from souba.operators import noise

KEEP = [
    ("ThinkPad X270 中古 ノートPC", "100040", False), ("dynabook B55 8GB", "100026", False), ("中古ノート 8GB", "0", False),
    ("Surface Go", None, False), ("LIFEBOOK バッテリー良好", "100040", False), ("VAIO ACアダプター付き", "0", True),
    ("let's NOTE 充電器セット", None, True), ("THINKPAD ケース", "777", True), ("PC 本体", " 100040 ", False),
]
REJECT = [
    ("PCバッグ 13インチ", "100040"), ("ThinkPad 本体", "552420"), ("ACアダプタ 汎用", "0"), ("冷却クーラー", None),
    ("ThinkPad ケース", "100040"), (None, "0"), (None, "100040"),
]


@pytest.fixture(scope="module")
def frame(spark):
    def make(cases):
        return spark.createDataFrame([(c[0], c[1]) for c in cases], "itemName string, genreId string")
    return make


def test_kept_and_rejected(frame, rows):
    got = {(r["itemName"], r["genreId"]): r["is_uncertain"] for r in rows(noise.filter_computers(frame(KEEP + REJECT)))}
    assert got == {(n, g): u for n, g, u in KEEP}


def test_integer_genre_and_other_columns(spark, rows):
    df = spark.createDataFrame([("Let's note i5", 100040, "x"), ("電源ケーブル", 0, "y")], "itemName string, genreId bigint, extra string")
    assert [(r["extra"], r["is_uncertain"], r["genreId"]) for r in rows(noise.filter_computers(df))] == [("x", False, 100040)]


def test_empty(frame):
    out = noise.filter_computers(frame([("a", "0")]).where("false"))
    assert out.columns == ["itemName", "genreId", "is_uncertain"] and out.count() == 0


def test_report_adds_up(frame, rows):
    cases = KEEP + [r for r in REJECT if r[0] is not None]
    df = frame(cases)
    report = rows(noise.filter_report(df))[0]
    kept = rows(noise.filter_computers(df))
    assert report["total"] == len(cases)
    assert report["uncertain_kept"] == sum(r["is_uncertain"] for r in kept)
    assert report["uncertain_kept"] + report["clean_kept"] == len(kept)
    assert (report["noise_genre_rejected"], report["keyword_rejected"]) == (1, 2)


def test_longer_lists(frame, rows):
    rules = noise.NoiseRules()
    rules = noise.NoiseRules(noise_keywords=[*rules.noise_keywords, "フィルター", "a.c"], noise_genres=[*rules.noise_genres, "9"])
    got = [r["itemName"] for r in rows(noise.filter_computers(frame([("液晶フィルター", "0"), ("abc", "0"), ("a.c", "0"), ("PC", "9")]), rules))]
    assert got == ["abc"]
