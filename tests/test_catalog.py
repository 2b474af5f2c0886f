"""B2-B5, B18, E1, G1-G4, A6, A7, A9-A11, C3, C5-C7, D23 and the end-to-end jobs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from souba.operators import catalog
from souba.plans import jobs
from souba.schemas import PRODUCT_KEY
from souba.sources import sinks


def test_standardise_per_source(spark, rows):
    df = spark.createDataFrame(
        [("c", "n", "https://u", 5, "shop", "L390", True, "Lenovo", "X", "8GB", "256GB", "13インチ", "junk")],
        "itemCode string, itemName string, itemUrl string, itemPrice bigint, shopName string, search_query string, is_active boolean, "
        "brand string, model string, ram string, storage string, screen string, listedDate string")
    kakaku = rows(catalog.standardise(df, "kakaku", F.lit("2026-01-01")))[0]
    assert (kakaku["item_code"], kakaku["model"], kakaku["memory"], kakaku["ssd"], kakaku["display_size"]) == ("c", "L390", "8GB", "256GB", 13.0)
    assert "listedDate" not in kakaku and "ram" not in kakaku
    api = rows(catalog.standardise(df, "rakuten", F.lit("2026-01-01")))[0]
    assert (api["brand"], api["model"], api["brand_extracted"], api["model_extracted"]) == (None, "L390", "Lenovo", "X")
    unnamed = rows(catalog.standardise(df, "pckoubou", F.lit("2026-01-01")))[0]
    assert (unnamed["brand"], unnamed["model"]) == (None, None)
    plain = catalog.standardise(df.drop("itemUrl"), "sofmap", F.lit("2026-01-01"))
    assert "item_url" not in plain.columns and rows(plain)[0]["brand"] == "Lenovo"


def test_display_text_becomes_inches(spark, rows):
    df = spark.createDataFrame([("c", "15.6インチ"), ("d", None)], "itemCode string, display_size string")
    assert [r["display_size"] for r in rows(catalog.standardise(df, "x").orderBy("item_code"))] == [15.6, None]


CURRENT = [("a", "1", "n1", "B1", "2kg", True), ("a", "2", "n2", "B2", "1kg", True), ("b", "1", "n3", "B3", None, True)]
SCHEMA = "source string, item_code string, item_name string, brand string, weight string, is_active boolean"


def test_upsert(spark, rows):
    current = spark.createDataFrame(CURRENT, SCHEMA)
    batch = spark.createDataFrame([("a", "1", "new", None, True), ("b", "9", "add", "B9", True)],
                                  "source string, item_code string, item_name string, brand string, is_active boolean")
    out = catalog.upsert_products(current, batch)
    got = {(r["source"], r["item_code"]): (r["item_name"], r["brand"], r["weight"]) for r in rows(out)}
    assert got == {("a", "1"): ("new", None, "2kg"), ("a", "2"): ("n2", "B2", "1kg"), ("b", "1"): ("n3", "B3", None), ("b", "9"): ("add", "B9", None)}
    again = catalog.upsert_products(out, batch)
    assert sorted(map(str, rows(again))) == sorted(map(str, rows(out)))
    assert out.columns == current.columns


def test_deactivate_only_touches_the_sources_of_the_run(spark, rows):
    current = spark.createDataFrame(CURRENT, SCHEMA)
    seen = spark.createDataFrame([("a", "2"), ("a", "2")], "source string, item_code string")
    got = {(r["source"], r["item_code"]): r["is_active"] for r in rows(catalog.deactivate_unseen(current, seen, ["a"]))}
    assert got == {("a", "1"): False, ("a", "2"): True, ("b", "1"): True}
    nothing = seen.where("false")
    assert [r["is_active"] for r in rows(catalog.deactivate_unseen(current, nothing, ["b"]).orderBy("source", "item_code"))] == [True, True, False]


def test_seen_in_both_runs_by_intersect(spark):
    keys = spark.createDataFrame(CURRENT, SCHEMA).select(*PRODUCT_KEY)
    seen = spark.createDataFrame([("a", "2"), ("z", "1")], "source string, item_code string")
    assert keys.intersect(seen).count() == 1 and keys.subtract(seen).count() == 2


def test_keep_first_and_new_urls(spark, rows):
    df = spark.createDataFrame([("u1", "b", 2), ("u1", "a", 1), ("u2", "c", 3), ("u3", "d", 4)], "item_url string, n string, pos int")
    assert sorted(r["n"] for r in rows(catalog.keep_first(df, ["item_url"], ["pos"]))) == ["a", "c", "d"]
    known = spark.createDataFrame([("u2",)], "item_url string")
    assert sorted(r["n"] for r in rows(catalog.new_by_url(known, df, ["pos"]))) == ["a", "d"]
    counters = rows(catalog.run_counters(known, df.withColumn("source", F.lit("s"))))[0]
    assert (counters["items_scraped"], counters["items_new"]) == (4, 2)


def test_observations_use_the_full_key(spark, rows):
    products = spark.createDataFrame([("id1", "a", "1"), ("id2", "b", "1")], "id string, source string, item_code string")
    batch = spark.createDataFrame([("a", "1", 10), ("b", "1", 20), ("a", "1", None), ("c", "1", 5)], "source string, item_code string, itemPrice bigint")
    batch = batch.withColumns({"scraped_at": F.lit("x"), "search_query": F.lit("q")})
    assert sorted((r["product_id"], r["price"]) for r in rows(catalog.price_observations(batch, products))) == [("id1", 10), ("id2", 20)]


def test_enrich_details(spark, rows):
    lists = spark.createDataFrame([("1", "old", "cpu", 13.3), ("2", "old2", None, None)], "page string, itemCode string, cpu string, display_size double")
    details = spark.createDataFrame([("1", "SKU", "", 0.0, "M1", "256GB")], "page string, sku string, cpu string, display_size double, model_number string, ssd string")
    one, two = rows(catalog.enrich_details(lists, details, "page").orderBy("page"))
    assert one == {"page": "1", "itemCode": "SKU", "cpu": "cpu", "display_size": 13.3, "model": "M1", "ssd": "256GB"}
    assert two["itemCode"] == "old2" and two["model"] is None


def test_contract_report(spark, rows):
    good = ("c", "n", "https://u", 5, "s", "x", "q", True, "2026-02-21T10:00:00+09:00")
    bad = (" ", "n", "http://u", 5, "s", "x", None, True, "2026-02-21T10:00:00Z")
    df = spark.createDataFrame([good, bad], "itemCode string, itemName string, itemUrl string, itemPrice bigint, shopName string, source string, "
                                            "search_query string, is_active boolean, scraped_at string")
    r = rows(catalog.contract_report(df))[0]
    assert (r["listings"], r["blank_code"], r["url_not_https"], r["null_search_query"], r["not_jst"], r["priced_without_code"], r["null_itemCode"]) == (2, 1, 1, 1, 1, 1, 0)


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_sinks(spark, rows, tmp_path, kind):
    df = spark.createDataFrame([("レッツ, \"note\"", 1, None), ("b", 2, "x")], "name string, price bigint, memo string")
    path = str(tmp_path / kind)
    getattr(sinks, f"write_{kind}")(df, path)
    reader = spark.read.schema(df.schema)
    back = {"csv": lambda: reader.option("header", True).csv(path), "parquet": lambda: reader.parquet(path), "json": lambda: reader.json(path)}[kind]()
    key = lambda r: r["price"]
    assert sorted(rows(back), key=key) == sorted(rows(df), key=key)
    assert rows(sinks.json_records(df.limit(1)))[0]["record"].endswith('"memo":null}')


def test_snapshots_show_only_finished_writes(spark, rows, tmp_path):
    table = sinks.Snapshots(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("1", "a"), ("2", "b c")], "item_code string, source string")
    assert table.read(df.schema).count() == 0
    table.write(df)
    (tmp_path / "t" / "snapshot=00000099-broken" / "source=a").mkdir(parents=True)
    assert table.read(df.schema).count() == 2
    one = table.read(df.schema, ["a"])
    table.write(one.union(spark.createDataFrame([("3", "a")], df.schema)))
    assert sorted((r["source"], r["item_code"]) for r in rows(table.read(df.schema))) == [("a", "1"), ("a", "3"), ("b c", "2")]
    assert [r["item_code"] for r in rows(table.read(df.schema, ["b c"]))] == ["2"]
    assert len(table.newest()) == 2


def _listings(spark, codes, source_price=1000, brand="Lenovo"):
    data = [(c, f"ThinkPad L{300 + i}", f"https://s/{c}", source_price + 100 * i, "shop", "L390", True, brand, "8GB", "256GB", "Windows 11 Pro", "8")
            for i, c in enumerate(codes)]
    return spark.createDataFrame(data, "itemCode string, itemName string, itemUrl string, itemPrice bigint, shopName string, search_query string, "
                                       "is_active boolean, brand string, memory string, ssd string, os string, cpu_gen string")


def test_nightly_run_training_and_scoring(spark, rows, tmp_path):
    catalogue, history, model = (str(tmp_path / n) for n in ("products", "history", "model"))
    codes = [f"c{i}" for i in range(40)]
    first = jobs.nightly_run(spark, {"sofmap": _listings(spark, codes), "qualit": _listings(spark, ["q1"])}, catalogue, history, dt.datetime(2026, 2, 1))
    assert first.sources == ["sofmap", "qualit"] and not first.failed
    broken = spark.createDataFrame([("x",)], "itemCode string").select(F.raise_error(F.lit("bad page")).alias("itemCode"))
    second = jobs.nightly_run(spark, {"sofmap": _listings(spark, codes[:30] + ["c1", "n1"], 2000), "qualit": broken}, catalogue, history, dt.datetime(2026, 2, 2))
    assert second.sources == ["sofmap"] and "bad page" in second.failed["qualit"]

    products = sinks.Snapshots(spark, catalogue).read(jobs.CATALOGUE)
    active = {(r["source"], r["item_code"]): r["is_active"] for r in rows(products)}
    assert len(active) == 42 and sum(active.values()) == 32 and active["qualit", "q1"] and not active["sofmap", "c35"]
    ids = [r["id"] for r in rows(products)]
    assert len(set(ids)) == 42
    seen = sinks.read_history(spark, history)
    assert seen.count() == 41 + 32 and seen.select("obs_date").distinct().count() == 2

    metrics = rows(jobs.train_job(spark, catalogue, history, model, max_iter=3, maxDepth=2))[0]
    assert metrics["n"] == 73 - int(73 * 0.8) and metrics["mae"] >= 0
    scored = rows(jobs.score_job(spark, catalogue, model, str(tmp_path / "pred")))
    assert len(scored) == 32 and spark.read.parquet(str(tmp_path / "pred")).count() == 32
    assert {r["model_version"] for r in scored} == {"1.0.0"} and all(r["predicted_price"] > 0 for r in scored)
    report = rows(jobs.backfill_job(spark, catalogue))[0]
    assert report["products"] == 42 and report["matched"] == 42
