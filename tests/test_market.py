"""D1-D14, D17-D21, E2, E3, E5, F4, B9-B16, C2 against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from souba.operators import evaluation, facts, market
from souba.operators.summary import CELL_BITS, MOMENTS, grouped_summary, order_key, value_of_key


@pytest.fixture(scope="module")
def prices(spark):
    """One group holds most rows, one is constant, one has a single row, one only nulls; keys may be null."""
    rng = random.Random(3)
    rows = [("hot", None, float(rng.choice([rng.randint(1, 90), rng.randint(10_000, 90_000), 30_000]))) for _ in range(4000)]
    rows += [("const", "s", 50_000.13)] * 77 + [("one", "s", 5.0), ("nul", "s", None), (None, "s", -3.5), (None, "s", 0.0), (None, "s", 12.25)]
    rows += [(f"g{i % 40}", "t", float(rng.randint(-500, 500)) / 4) for i in range(800)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, s string, price double").repartition(6)


def _groups(rows):
    groups = {}
    for g, s, p in rows:
        if p is not None:
            groups.setdefault((g, s), []).append(p)
    return groups


def test_grouped_summary_is_exact(prices, rows):
    data, df = prices
    wanted = {"median": (0.5, "linear"), "p25": (0.25, "linear"), "p75": (0.75, "linear"), "n25": (0.25, "nearest"),
              "n75": (0.75, "nearest"), "p0": (0.0, "linear"), "p100": (1.0, "nearest"), "p90": (0.9, "linear")}
    got = {(r["g"], r["s"]): r for r in rows(grouped_summary(df, ["g", "s"], "price", wanted, MOMENTS))}
    expected = _groups(data)
    assert set(got) == set(expected)
    for key, values in expected.items():
        a, r = np.sort(np.array(values)), got[key]
        assert r["count"] == len(a) and r["min"] == a[0] and r["max"] == a[-1]
        assert r["mean"] == pytest.approx(a.mean(), abs=1e-9) and r["std"] == pytest.approx(a.std(), abs=1e-6)
        for name, (q, how) in wanted.items():
            place = q * (len(a) - 1)
            exact = np.percentile(a, q * 100) if how == "linear" else a[math.floor(place + 0.5)]
            assert r[name] == pytest.approx(exact, abs=1e-9), (key, name)


def test_summary_without_keys_or_rows(prices, rows):
    data, df = prices
    everything = [p for _, _, p in data if p is not None]
    assert rows(grouped_summary(df, [], "price"))[0]["median"] == pytest.approx(np.median(everything))
    assert grouped_summary(df.where("g = 'nul'"), ["g"], "price").count() == 0


def test_order_keys_sort_as_doubles_do(spark):
    rng = random.Random(1)
    values = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    values = [v for v in values if v == v] + [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf, 1e22]
    values += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1073, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", order_key(F.col("v")))
    got = sorted((r["v"], r["k"], r["back"]) for r in df.withColumn("back", value_of_key(F.col("k"))).collect())
    assert all((a[0] < b[0]) == (a[1] < b[1]) for a, b in zip(got, got[1:]))
    assert all(v == back for v, _, back in got if math.isfinite(v))


def test_a_million_values_within_one_percent_spread(spark):
    """No round ranks a large part of the values: the first has few cells, the next those of one cell."""
    df = spark.range(1_000_000).select((F.lit(1000.0) + F.col("id") * 1e-5).alias("price"), F.lit("g").alias("g"))
    summary = grouped_summary(df, ["g"], "price", {"median": (0.5, "linear"), "p99": (0.99, "nearest")})
    row = summary.first()
    assert row["median"] == pytest.approx((1000 + 499_999e-5 + 1000 + 500_000e-5) / 2, abs=1e-12) and row["p99"] == 1000.0 + 989_999 * 1e-5
    key = order_key(F.col("price"))
    for above, below in zip((64, *CELL_BITS), CELL_BITS):
        cells = df.groupBy(F.shiftright(key, min(above, 63)).alias("a")).agg(F.count_distinct(F.shiftright(key, below)).alias("n"))
        assert cells.agg(F.max("n")).first()[0] < 50_000


def _history(spark, rows):
    return spark.createDataFrame(rows, "display_name string, source string, price bigint, scraped_at timestamp")


def test_price_change(spark, rows):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    data = [("up", "a", 100, day(0)), ("up", "a", 300, day(1)), ("up", "a", 250, day(20)), ("up", "a", 350, day(13)),
            ("new", "a", 10, day(5)), ("new", "a", 20, day(6)),
            ("zero", "a", 0, day(0)), ("zero", "a", 5, day(9)), ("flat", "a", 1000, day(0)), ("flat", "a", 1004, day(8))]
    got = {r["display_name"]: r for r in rows(market.price_change(_history(spark, data), ["display_name"]))}
    assert got["up"]["current_median"] == 300 and got["up"]["prior_median"] == 200 and got["up"]["change_7d"] == 50
    assert got["up"]["change_label"] == "↑ +50.0%  /7d"
    assert got["new"]["change_7d"] is None and got["new"]["current_median"] == 15 and got["new"]["change_class"] == "flat"
    assert got["zero"]["change_7d"] is None and got["flat"]["change_class"] == "flat" and got["flat"]["change_label"] == "→ flat"


def test_daily_trend_and_counts(spark, rows):
    at = dt.datetime
    data = [("m", "a", 10, at(2026, 1, 1, 0)), ("m", "a", 20, at(2026, 1, 1, 23)), ("m", "b", 40, at(2026, 1, 1, 5)),
            ("m", "a", None, at(2026, 1, 2)), ("m", "b", 7, at(2026, 1, 3))]
    df = _history(spark, data)
    trend = {(r["source"], r["day"].day): r for r in rows(market.daily_trend(df, ["source"], quartiles=True, mean=True))}
    assert set(trend) == {("a", 1), ("b", 1), ("b", 3)}
    assert (trend["a", 1]["median"], trend["a", 1]["mean"], trend["a", 1]["p25"], trend["a", 1]["p75"], trend["a", 1]["count"]) == (15, 15, 10, 20, 2)
    counts = {r["day"].day: (r["listings"], r["sources"]) for r in rows(market.count_by_date(df))}
    assert counts == {1: (3, 2), 3: (1, 1)}


def test_spec_breakdown_needs_two_values(spark, rows):
    data = [("m", "8GB", "8", "1TB", 10), ("m", "16GB", "8", None, 20), ("m", "8GB", "8", "2TB", None), ("n", "8GB", None, None, 5)]
    df = spark.createDataFrame(data, "display_name string, memory string, cpu_gen string, ssd string, price bigint")
    got = {(r["display_name"], r["spec"], r["value"]): (r["median"], r["count"]) for r in rows(market.spec_breakdown(df, ["display_name"]))}
    assert got == {("m", "memory", "8GB"): (10, 1), ("m", "memory", "16GB"): (20, 1), ("m", "ssd", "1TB"): (10, 1)}


def test_histogram_keeps_every_price(spark, rows):
    rng = random.Random(5)
    data = [("a", rng.randint(1, 10_000)) for _ in range(203)] + [("same", 7)] * 9 + [("few", 1)] * 4
    df = spark.createDataFrame(data, "m string, price bigint")
    bins = rows(market.price_histogram(df, ["m"]))
    assert sum(r["n"] for r in bins if r["m"] == "a") == 203 and max(r["bin"] for r in bins if r["m"] == "a") == 39
    assert [(r["bin"], r["n"]) for r in bins if r["m"] == "same"] == [(0, 9)]
    assert not [r for r in bins if r["m"] == "few"]
    top = max(p for m, p in data if m == "a")
    assert max(r["high"] for r in bins if r["m"] == "a") == pytest.approx(top)


def test_normal_curve(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in range(100)], "m string, price double")
    curve = sorted(rows(market.normal_curve(df, ["m"])), key=lambda r: r["point"])
    mu, sd, width = 49.5, np.std(np.arange(100)), 99 / 20
    xs = np.linspace(mu - 3.5 * sd, mu + 3.5 * sd, 300)
    assert [r["price"] for r in curve] == pytest.approx(list(xs))
    expected = np.exp(-((xs - mu) / sd) ** 2 / 2) / (sd * math.sqrt(2 * math.pi)) * 100 * width
    assert [r["expected"] for r in curve] == pytest.approx(list(expected))


def test_against_median_rounds_half_to_even(spark, rows):
    df = spark.createDataFrame([("m", 2000), ("m", 2001), ("m", 1999), ("m", 2003), ("m", 1997)], "display_name string, price bigint")
    got = {r["price"]: r["vs_median_pct"] for r in rows(market.against_median(df, ["display_name"]))}
    assert got == {2000: 0.0, 2001: 0.0, 1999: 0.0, 2003: 0.2, 1997: -0.2}


def test_latest_price_and_top(spark, rows):
    data = [("p", 1, 10), ("p", 2, 20), ("p", 3, 30), ("q", 1, 5)]
    df = spark.createDataFrame(data, "product_id string, t int, price bigint")
    got = {r["product_id"]: (r["latest_price"], r["previous_price"]) for r in rows(market.latest_price(df, ["product_id"], [F.desc("t")]))}
    assert got == {"p": (30, 20), "q": (5, None)}
    names = spark.createDataFrame([(n,) for n in "aabbbccd"] + [(None,)] * 9, "display_name string")
    assert [r["display_name"] for r in rows(market.top_models(names, 3))] == ["b", "a", "c"]
    meta = rows(market.model_meta(df.withColumn("m", F.lit(1)), ["m"]))[0]
    assert (meta["observations"], meta["listings"]) == (4, 2)


def test_price_fact_keeps_unknown_products(spark, rows):
    history = spark.createDataFrame([("1", 10, None), ("9", 20, "kakaku")], "product_id string, price bigint, source string")
    products = spark.createDataFrame([("1", "", "L580", "x", True)], "id string, brand string, model string, source string, is_active boolean")
    got = {r["product_id"]: r for r in rows(facts.price_fact(history, products))}
    assert (got["1"]["source"], got["1"]["display_name"], got["1"]["product_source"]) == ("rakuten", "Unknown L580", "x")
    assert (got["9"]["display_name"], got["9"]["is_active"]) == ("Unknown Unknown", None)


def test_scope_and_coercion(spark, rows):
    raw = spark.createDataFrame([("10", "2026-02-21T08:00:00+09:00", "a", "B", True), ("x", "2026-02-21T10:00:00+09:00", "a", "B", True),
                                 ("30", "2026-02-21T10:00:00+09:00", "b", "B", None), ("40", "bad", "a", "C", True)],
                                "price string, scraped_at string, source string, brand string, is_active boolean")
    df = facts.coerce(raw)
    assert dict(df.dtypes)["price"] == "bigint" and dict(df.dtypes)["scraped_at"] == "timestamp"
    prices = lambda d: sorted(r["price"] for r in rows(d))
    day = dt.date(2026, 2, 21)
    assert prices(facts.scoped(df)) == [10, 30, 40]
    assert prices(facts.scoped(df, day, day)) == [30]          # 08:00 in Tokyo is the day before in UTC
    assert prices(facts.scoped(df, sources=["a"], brands=[])) == [10, 40]
    assert prices(facts.scoped(df, active_only=True, brands=["B"])) == [10]


def test_spec_patterns(spark, rows):
    df = spark.createDataFrame([("L390", "i5 8265U"), ("l390", "i5 8265U"), (None, "i5"), ("L390", None)], "model string, cpu string")
    assert len(rows(facts.matching_specs(df, {"model": "L390", "cpu": ""}))) == 2
    assert len(rows(facts.matching_specs(df, {"model": "L390", "cpu": r"i5.?8\d{3}"}))) == 1


def test_metrics(spark, rows):
    def metrics(pairs):
        return rows(evaluation.regression_metrics(spark.createDataFrame(pairs, "y bigint, p bigint"), "y", "p"))[0]
    m = metrics([(10_000, 11_000), (20_000, 18_000), (30_000, 31_000), (40_000, 42_000)])
    assert m["mae"] == 1500 and m["rmse"] == pytest.approx(1581.139, abs=1e-3) and m["mape"] == pytest.approx(7.0833, abs=1e-3)
    assert m["r2"] == pytest.approx(1 - 1e7 / 5e8)
    assert metrics([(5, 5), (5, 5)])["r2"] == 1.0 and metrics([(5, 5), (5, 6)])["r2"] == 0.0
    assert math.isnan(metrics([(0, 1)])["mape"])
