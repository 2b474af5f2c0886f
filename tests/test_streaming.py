"""Files drive each stream to its end."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from souba.operators import catalog
from souba.plans import jobs
from souba.schemas import PRODUCT_KEY, PRODUCTS
from souba.sources import sinks
from souba.streaming import jobs as streams
from souba.streaming.ledger import RunLedger


RUN = uuid.uuid4().hex   # checkpoints outlive a test run; each run is a stream of its own


def _page(codes, price):
    items = [{"Item": {"itemName": "Lenovo ThinkPad L580", "itemCaption": " メモリ 8GB SSD 256GB", "itemPrice": price, "itemCode": c, "genreId": "100040",
                       "itemUrl": f"https://s/{c}", "shopName": "s"}} for c in codes]
    return json.dumps({"Items": items}, ensure_ascii=False)


def test_landed_pages_into_catalogue(spark, rows, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    catalogue, history = str(tmp_path / "products"), str(tmp_path / "history")

    def work_off(day):
        def listings(batch):
            return {"rakuten": jobs.api_listings(batch.withColumn("search_query", F.lit("L580")), "2026-02-21T10:00:00+09:00")}
        stream = streams.landed_pages(spark, str(landing), files_per_batch=1)
        reports = streams.ingest(stream, listings, catalogue, history, dt.datetime(2026, 2, day), f"ingest-{RUN}")
        assert not any(r.failed for r in reports)
        return reports, {r["item_code"]: r["is_active"] for r in rows(sinks.Snapshots(spark, catalogue).read(jobs.CATALOGUE))}

    for k, code in enumerate("abz"):
        (landing / f"{k}.json").write_text(_page([code], 100) + "\n" + '{"error": "x"}\n', encoding="utf-8")
    reports, active = work_off(21)
    assert len(reports) == 3 and active == {"a": True, "b": True, "z": True}     # three batches, one run
    assert sum(r.new["rakuten"] for r in reports) == 3
    (landing / "8.json").write_text(_page(["b"], 200), encoding="utf-8")
    (landing / "9.json").write_text(_page(["c"], 200), encoding="utf-8")
    reports, active = work_off(22)
    assert len(reports) == 2 and active == {"a": False, "b": True, "c": True, "z": False}
    assert work_off(23)[1] == active                                             # nothing landed, nothing retired

    products = {r["item_code"]: r for r in rows(sinks.Snapshots(spark, catalogue).read(jobs.CATALOGUE))}
    assert products["b"]["memory"] == "8GB" and products["b"]["model"] == "L580" and products["b"]["brand"] is None
    seen = sorted((r["item_code"], r["price"]) for r in rows(sinks.read_history(spark, history)))
    assert seen == [("a", 100), ("b", 100), ("b", 200), ("c", 200), ("z", 100)]


def test_duplicates_within_watermark(spark, rows, tmp_path):
    at = dt.datetime
    data = [("s", "1", at(2026, 1, 1, 1)), ("s", "1", at(2026, 1, 1, 2)), ("s", "2", at(2026, 1, 1, 3)), ("t", "1", at(2026, 1, 1, 4))]
    df = spark.createDataFrame(data, "source string, item_code string, scraped_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = streams.first_observations(streams.landed_table(spark, str(tmp_path / "in"), df.schema))
    streams.run_batches(stream, lambda batch, _: batch.write.mode("append").parquet(out), f"dedupe-{RUN}").awaitTermination()
    assert sorted((r["source"], r["item_code"]) for r in rows(spark.read.parquet(out))) == [("s", "1"), ("s", "2"), ("t", "1")]


def test_streaming_trend_equals_batch(spark, rows, tmp_path):
    at = dt.datetime
    data = [("a", float(p), at(2026, 1, d, h)) for p, d, h in [(10, 1, 1), (20, 1, 23), (30, 2, 0), (40, 4, 5), (50, 9, 9)]]
    df = spark.createDataFrame(data, "source string, price double, scraped_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    trend = streams.streaming_trend(streams.landed_table(spark, str(tmp_path / "in"), df.schema))
    query = (trend.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    # Windows the watermark has closed; the last day is still open.
    streamed = {r["day_start"]: (r["count"], r["mean"]) for r in rows(spark.read.parquet(out))}
    batch = {r["day_start"]: (r["count"], r["mean"]) for r in rows(streams.daily_windows(df))}
    assert streamed and all(batch[d] == v for d, v in streamed.items()) and at(2026, 1, 9) not in streamed


def test_stale_products_without_join(spark, rows):
    at = dt.datetime
    data = [("1", "a", at(2026, 1, 1), True), ("2", "a", at(2026, 1, 3), True), ("3", "b", at(2026, 1, 1), True)]
    df = spark.createDataFrame(data, "item_code string, source string, last_seen_at timestamp, is_active boolean")
    out = catalog.deactivate_stale(df, ["a"], F.lit(at(2026, 1, 2)))
    assert [r["is_active"] for r in rows(out.orderBy("item_code"))] == [False, True, True]
    assert PRODUCT_KEY == ["source", "item_code"] and "last_seen_at" in PRODUCTS.fieldNames()


def test_report_is_observed_by_the_writing_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "run_counters", None)
    schema = "itemCode string, itemName string, itemUrl string, itemPrice bigint, shopName string, search_query string, is_active boolean, cpu string"
    make = lambda rows: spark.createDataFrame([(c, "n", u, p, "s", "q", True, cpu) for c, u, p, cpu in rows], schema)
    rows = [("1", "https://a", 5, "i5"), ("1", "https://a", 6, "i5"), ("2", "http://b", None, None), (None, None, 7, "")]
    broken = make(rows).withColumn("itemPrice", F.raise_error("down").cast("bigint"))
    run = lambda listings, day: jobs.nightly_run(spark, listings, str(tmp_path / "p"), str(tmp_path / "h"), dt.datetime(2026, 3, day))
    first = run({"qualit": make(rows), "pcwrap": make([]), "sofmap": broken}, 1)
    assert first.scraped == {"qualit": 4, "pcwrap": 0} and first.new == {"qualit": 2, "pcwrap": 0} and set(first.failed) == {"sofmap"}
    assert first.filled["qualit"] == {"cpu": 0.5} and first.observations == 2
    assert first.broken["qualit"] == {"no_item_code": 1, "no_item_name": 0, "no_item_url": 1, "no_price": 1, "url_not_https": 1}
    second = run({"qualit": make([("2", "https://b", 9, "i5"), ("3", "https://c", 9, "i5")])}, 2)
    assert second.new == {"qualit": 1} and second.observations == 2
    assert run({"pcwrap": make([])}, 3).new == {"pcwrap": 0}


def test_ledger_keeps_a_run_open_until_it_is_closed(spark, tmp_path):
    at, ledger = dt.datetime, RunLedger(spark, str(tmp_path / "runs"), "s")
    assert ledger.to_retire() == ([], None)
    assert ledger.begin(0, at(2026, 1, 1)) == at(2026, 1, 1)
    ledger.finish(0, jobs.RunReport("s-0", ["a", "b"], {}, {"a": 2, "b": 1}, {"a": 1}))
    again = RunLedger(spark, str(tmp_path / "runs"), "s")                       # another process
    assert again.begin(0, at(2026, 1, 9)) == at(2026, 1, 1)                     # a second try keeps its time
    assert again.begin(1, at(2026, 1, 2)) == at(2026, 1, 2)
    again.finish(1, jobs.RunReport("s-1", ["c"], {"b": "broken"}))
    assert again.to_retire() == (["a", "c"], at(2026, 1, 1))
    again.close()
    assert again.to_retire() == ([], None)
    assert RunLedger(spark, str(tmp_path / "runs"), "other").to_retire() == ([], None)


def test_exact_trend_counts_late_rows(spark, rows, tmp_path):
    at = dt.datetime
    landed = str(tmp_path / "in")
    data = [[("a", p, at(2026, 1, 10, h)) for h, p in enumerate([5, 5, 9, 30])], [("a", 7, at(2026, 1, 10, 9)), ("a", 40, at(2026, 1, 12)), ("a", None, at(2026, 1, 12))],
            [("a", 1, at(2026, 1, 1)), ("a", 2, at(2026, 1, 1)), ("a", 50, at(2026, 1, 12))]]
    schema, late = "source string, price bigint, scraped_at timestamp", 0
    for k, some in enumerate(data):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = streams.landed_table(spark, landed, spark.createDataFrame([], schema).schema)
        late += streams.exact_trend(stream, str(tmp_path / "counts"), f"exact-{RUN}", delay="1 day")
    got = {r["day_start"]: (r["count"], r["mean"], r["median_low"]) for r in rows(streams.read_trend(spark, str(tmp_path / "counts")))}
    assert got == {at(2026, 1, 10): (5, 56 / 5, 7), at(2026, 1, 12): (2, 45.0, 40)} and late == 2
