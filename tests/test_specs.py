"""H2-H11, H13, H18-H21, H34, T1, T2, D16, D22."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from souba.functions import specs, titles
from souba.operators import extraction
from souba.schemas import SPEC_FIELDS

LISTINGS = [
    ("メーカー： Fujitsu 型番： LIFEBOOK U939 CPU 第8世代 Core i5-8365U 1.60GHz メモリ(8GB) SSD：256GB 画面13.3インチ 重量 0.9kg",
     dict(brand="Fujitsu", model="LIFEBOOK U939", cpu="Core i5-8365U 1.60GHz", cpu_gen="8", memory="8GB", ssd="256GB",
          hdd=None, display_size="13.3インチ", weight="0.9kg", os=None, usb_ports=None)),
    ("【中古】 NEC VersaPro VK23 HDD500GB 新品SSD 1TB RAM: 12GB Windows 10 Pro 64bit USB 3.0 × 3 USB 3.1 Type-C x 2",
     dict(brand="NEC", model="VersaPro VK23", memory="12GB", ssd="1TB", hdd="500GB", os="Windows 10 Pro 64bit",
          usb_ports="USB3.0×3, USB3.1 Type-C×2", cpu=None, display_size=None)),
    ("Ｄｅｌｌ　ＸＰＳ　１３　インテル　Ｃｏｒｅ　ｉ７　プロセッサー　１０５１０Ｕ　（最大４．９ＧＨｚ）　ＤＤＲ４　１６ＧＢ",
     dict(brand="Dell", model="XPS 13", cpu="インテル Core i7 プロセッサー 10510U (最大4.9GHz)", cpu_gen="10", memory="16GB")),
    ("pc /16GB DDR5/ 512gb NVMe SSD Bluetooth 5.0 Webカメラ: HD 12th Gen 14-inch メモリ 7GB",
     dict(brand=None, memory="16GB", ssd="512GB", bluetooth="Bluetooth 5.0", webcam="Webカメラ: HD 12th Gen 14",
          cpu_gen="12", display_size="14.0インチ")),
    ("", {f: None for f in SPEC_FIELDS}),
]


def _listing_frame(spark, texts):
    rows = [(f"c{i}", "n", 1000 + i, "100040", "s", True, "2026-02-21T10:00:00+09:00", "q", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "itemCode string, itemName string, itemPrice bigint, genreId string, shopName string, "
                                       "is_active boolean, scraped_at string, search_query string, combined string")


def test_extract_specs_gold(spark, rows):
    found = {r["itemCode"]: r for r in rows(extraction.extract_specs(_listing_frame(spark, [t for t, _ in LISTINGS])))}
    for i, (_, expected) in enumerate(LISTINGS):
        assert {k: found[f"c{i}"][k] for k in expected} == expected


def test_extract_specs_shape_and_null_text(spark, rows):
    out = extraction.extract_specs(_listing_frame(spark, [None]))
    assert out.columns == ["itemName", "itemPrice", "itemCode", "genreId", "shopName", "is_active", "scraped_at",
                           "search_query", *SPEC_FIELDS]
    assert all(rows(out)[0][f] is None for f in SPEC_FIELDS)


def test_cpu_gen_out_of_range_and_case(evaluate):
    assert evaluate(["99250U x", "8265U", "8265u", "第 11 世代"], specs.cpu_generation) == [None, "8", None, "11"]


def test_memory_falls_through(evaluate):
    assert evaluate(["メモリ 7GB DDR4 8GB", "メモリ容量16GB", "メモリ 08GB"], specs.memory) == ["8GB", None, "8GB"]


def test_display_and_weight_limits(evaluate):
    assert evaluate(["液晶 21.5型", "液晶 9型 14-inch", "画面 14インチ"], specs.display_size) == [None, "14.0インチ", "14.0インチ"]
    assert evaluate(["重さ:9kg", "重さ1.25kg"], specs.weight) == [None, "1.25kg"]


def test_capacity_across_line_break(evaluate):
    assert evaluate(["SSD\n256 gb", "1TB HDD"], specs.ssd) == ["256GB", None]
    assert evaluate(["SSD\n256 gb", "1TB HDD"], specs.hdd) == [None, "1TB"]


@pytest.mark.parametrize("raw, brand", [
    ("LENOVO", "Lenovo"), ("lenvo", "Lenovo"), ("Panasonik", "Panasonic"), ("Toshba", "Toshiba"), ("hp", "HP"),
    ("Zzz", "Zzz"), ("", ""), (None, None), ("hewlett-packard", "Hewlett-Packard"), ("Fujitu", "Fujitsu")])
def test_normalize_brand(evaluate, raw, brand):
    assert evaluate([raw], specs.normalize_brand) == [brand]


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence_against_brute_force(spark):
    import random
    from souba import fixed_values as fv
    rnd = random.Random(4)
    words = ["".join(rnd.choice("LenovaTshibAcrHPw-k ") for _ in range(rnd.randint(1, 20))) for _ in range(60)] + ["Hewlett-Packard", "aaaaaaa"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = df.select("w", F.transform(specs._compared_brands(), lambda s: specs._shared_in_order(F.split("w", ""), s)).alias("n")).collect()
    for r in out:
        assert r["n"] == [_lcs(r["w"], b) for b in fv.BRANDS]


def test_with_brand_compares_distinct_texts(spark):
    rows = [(i, w) for i, w in enumerate(["lenvo", "Zzz", None, "", "HP", "lenvo", "ZZZ"] * 20)]
    out = specs.with_brand(spark.createDataFrame(rows, "i int, w string"), "w")
    assert out.columns == ["i", "w", "brand"]
    named = {"lenvo": "Lenovo", "HP": "HP"}
    assert sorted((r["i"], r["brand"]) for r in out.collect()) == [(i, named.get(w, w)) for i, w in rows]


def test_closest_brand_prefilter_loses_nothing(spark):
    """The cheap bounds drop no brand the full comparison would pick."""
    from souba import fixed_values as fv
    words = ["lenvo", "Lenovoo", "Dll", "HPE", "asus", "Acr", "toshibaa", "NECC", "Soni", "Microsft", "Aple", "MSi", "Samsng",
             "dynabook", "Sharpe", "Panasnic", "HewlettPackard", "Fuji", "abc def", "ovonel"]
    best = {}
    for w in words:
        scores = [(200 * _lcs(w, b) / (len(w) + len(b)), -i, b) for i, b in enumerate(fv.BRANDS)]
        score, _, brand = max(scores)
        best[w] = brand if score >= fv.BRAND_FUZZY_CUTOFF else None
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", specs.closest_brand(F.col("w"))).collect() if " " not in r[0]} == \
        {w: b for w, b in best.items() if " " not in w}


@pytest.mark.parametrize("title, model", [
    ("【整備品】Lenovo thinkpad l480 Core i3", "ThinkPad L480"),
    ("ThinkPad X1 Yoga 3rd", "ThinkPad X1 Yoga"),
    ("Lenovo ThinkPad T14s Gen 2", "ThinkPad T14s"),
    ("lenovo IDEAPAD S340 14", "IdeaPad S340"),
    ("Dell LATITUDE 7490", "Latitude 7490"),
    ("Dell latitude e6440", "Latitude E6440"),
    ("DELL inspiron 3593", "Inspiron 3593"),
    ("HP ProBook 450 G8", None), ("MacBook Air", None), ("", None)])
def test_canonical_model(evaluate, title, model):
    assert evaluate([title], titles.canonical_model) == [model]


def test_bracket_specs(evaluate):
    full, hdd, none, odd = evaluate([
        "X ［Ryzen5-3500U (2.1GHz)／16GB／SSD512GB／13.3インチワイド／Windows10 Pro］", "Y ［Celeron／4GB／HDD500GB／SSD128GB］",
        "no brackets", "Z ［／／8GB／16GB／大画面インチ］"], titles.bracket_specs)
    assert full == dict(cpu="Ryzen5-3500U", memory="16GB", ssd="512GB", hdd=None, display_size=13.3, os="Windows10 Pro")
    assert hdd["hdd"] == "500GB" and hdd["ssd"] == "128GB" and hdd["cpu"] == "Celeron"
    assert all(v is None for v in none.values())
    assert odd["memory"] == "16GB" and odd["display_size"] is None


def test_slash_specs(evaluate):
    one, two, none = evaluate([
        "HP X(Win10x64)  中古 Ryzen 5/メモリ16GB/NVMe512GB/フルHD13.3インチ/Wi-Fi [A:美品]", "NEC(macOS) 中古 Core i3/8GB/HDD1TB/14/x",
        "新品 Core i5/8GB"], titles.slash_specs)
    assert one == dict(os="Win10x64", cpu="Ryzen 5", memory="16GB", ssd="512GB", hdd=None, display_size=13.3)
    assert two == dict(os="macOS", cpu="Core i3", memory="8GB", ssd=None, hdd="1TB", display_size=14.0)
    assert all(v is None for v in none.values())


def test_block_specs(evaluate):
    block = "\n商品番号77a\n種別中古\nメーカDell\nシリーズ名Latitude 7300\n型名P99G\nOSWindows11 Pro 64bit\nCPUCore i7-1.9GHz (8665U)\nCPU世代第8世代\nメモリ16GB DDR4\nストレージ1TB HDD\n"
    got = evaluate([block], titles.block_specs)[0]
    assert got == dict(brand="Dell", series="Latitude 7300", model_number="P99G", os="Windows11 Pro", cpu="Core i7-1.9GHz (8665U)",
                       cpu_gen="第8世代", memory="16GB", ssd=None, hdd="1TB", product_id="77a")


def test_optional_fields(spark, rows):
    text = "1920×1080 TN 802.11 ac 光学ドライブ：DVD 保証期間：30ヶ月間 Office 2019 テンキー"
    got = rows(extraction.extract_specs(_listing_frame(spark, [text, "FHD IPS 無線LAN Officeなし 光学ドライブ非搭載"]), optional=True))
    first, second = sorted(got, key=lambda r: r["itemCode"])
    assert (first["resolution"], first["panel_type"], first["wireless"], first["optical_drive"], first["warranty"],
            first["office"], first["tenkey"]) == ("1920x1080", "TN", "802.11 ac", "DVD", "30ヶ月間", "Office 2019", True)
    assert (second["resolution"], second["panel_type"], second["wireless"], second["optical_drive"], second["office"],
            second["tenkey"]) == ("1920x1080", "IPS", "搭載", "なし", "なし", False)


def test_fill_rates_and_backfill(spark, rows):
    found = extraction.extract_specs(_listing_frame(spark, [t for t, _ in LISTINGS]))
    rates = {r["field"]: r for r in rows(extraction.fill_rates(found))}
    assert rates["memory"]["filled"] == 4 and rates["memory"]["total"] == 5 and rates["memory"]["fill_rate"] == 0.8
    products = spark.createDataFrame([("a", "ThinkPad L580", "old"), ("b", "no", "kept"), ("c", None, None)], "id string, item_name string, model string")
    assert {r["id"]: r["model"] for r in rows(extraction.backfill_models(products))} == {"a": "ThinkPad L580", "b": "kept", "c": None}
    assert rows(extraction.backfill_report(products))[0]["matched"] == 1
    empty = rows(extraction.backfill_report(products.where("false")))[0]
    assert (empty["products"], empty["matched"], empty["match_pct"]) == (0, 0, 0.0)
