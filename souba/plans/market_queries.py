"""Registered market queries: facts, scope, statistics, trends, listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from souba import fixed_values as fv
from souba.functions import text
from souba.operators import facts as facts_op, market
from souba.plans.registry import query
from souba.plans.views import (
    CATALOGUE_SQL, FACT_SHOP_SQL, FACT_SQL, HISTORY_SQL, catalogue, facts, history, table, with_shop,
)

DAY_SQL = "strftime(scraped_at, '%Y-%m-%d')"


def _nearest(q: float, column: str = "price") -> str:
    return (f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))"
            f"[CAST(floor({q} * (count({column}) - 1) + 0.5) AS BIGINT) + 1]")


def _rounded(df, columns: list[str], digits: int = 4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _day_text(df):
    return df.withColumn("day", text.date_label(F.col("day")))


# --- facts -----------------------------------------------------------------------
@query("price_fact", f"""
SELECT product_id, order_key, line_number, source, brand, model, display_name,
       coalesce(price, -1) AS price, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM {FACT_SQL}""")
def price_fact(spark, sf_dir):
    """A3 A4 C2 B15 B16"""
    return facts(spark, sf_dir).select(
        "product_id", "order_key", "line_number", "source", "brand", "model", "display_name",
        F.coalesce("price", F.lit(-1)).alias("price"),
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("listings_view", f"""
SELECT h.item_code AS "itemCode", c.item_name AS "itemName", coalesce(h.price, -1) AS "itemPrice",
       c.item_url AS "itemUrl", s.s_name AS "shopName", c.brand, c.cpu, c.memory, c.ssd, c.os,
       strftime(h.scraped_at, '%Y-%m-%d') AS scraped_at, c.model, o.o_orderpriority AS search_query,
       c.is_active, h.source
FROM {HISTORY_SQL} h JOIN {CATALOGUE_SQL} c ON c.id = h.product_id
LEFT JOIN supplier s ON s.s_suppkey = h.shop_key LEFT JOIN orders o ON o.o_orderkey = h.order_key""")
def listings_view(spark, sf_dir):
    """A5"""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_key", "o_orderpriority AS search_query")
    # What observations carry is moved with each join: the code comes with the product, names of shops after the orders.
    rows = with_shop(history(spark, sf_dir).drop("item_code").join(orders, "order_key", "left"), spark, sf_dir)
    view = facts_op.listings_view(rows, catalogue(spark, sf_dir))
    return view.withColumns({"itemPrice": F.coalesce("itemPrice", F.lit(-1)),
                             "scraped_at": text.date_label(F.col("scraped_at"))})


FROM, TO = dt.date(1996, 3, 1), dt.date(1999, 6, 30)


@query("filtered_scope", f"""
SELECT order_key, line_number, source, brand, price, {DAY_SQL} AS day FROM {FACT_SQL}
WHERE CAST(scraped_at AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'
  AND source IN ('rakuten', 'kakaku') AND brand IN ('Brand#1', 'Brand#7', 'Unknown')
  AND is_active AND price IS NOT NULL""")
def filtered_scope(spark, sf_dir):
    """B9 B10 B11 B12"""
    scope = facts_op.scoped(facts(spark, sf_dir), FROM, TO, ["rakuten", "kakaku"],
                            ["Brand#1", "Brand#7", "Unknown"], active_only=True)
    return scope.select("order_key", "line_number", "source", "brand", "price",
                        text.date_label(F.col("scraped_at")).alias("day"))


PATTERNS = {"model": r"^(ECONOMY|SMALL|PROMO)$", "cpu": r"i5.?8\d{3}", "memory": r"8\s*GB|16\s*GB", "ssd": r"256\s*GB|1TB"}
PATTERN_SQL = " AND ".join(f"regexp_matches({c}, '{p}')" for c, p in PATTERNS.items())


@query("spec_regex_filter", f"""
SELECT order_key, line_number, model, cpu, memory, ssd FROM {FACT_SQL} WHERE {PATTERN_SQL}""")
def spec_regex_filter(spark, sf_dir):
    """B13"""
    return facts_op.matching_specs(facts(spark, sf_dir), PATTERNS).select(
        "order_key", "line_number", "model", "cpu", "memory", "ssd")


# --- statistics -------------------------------------------------------------------
@query("price_stats", f"""
SELECT display_name, count(price) AS count, round(avg(price), 4) AS mean,
       round(stddev_pop(price), 4) AS std, CAST(min(price) AS DOUBLE) AS min, CAST(max(price) AS DOUBLE) AS max,
       round(median(price), 4) AS median, round(quantile_cont(price, 0.25), 4) AS p25,
       round(quantile_cont(price, 0.75), 4) AS p75
FROM {FACT_SQL} WHERE price IS NOT NULL GROUP BY display_name""")
def price_stats(spark, sf_dir):
    """D1"""
    stats = market.price_stats(facts(spark, sf_dir), ["display_name"])
    return _rounded(stats, ["mean", "std", "median", "p25", "p75"])


@query("price_change_7d", f"""
WITH f AS (SELECT * FROM {FACT_SQL} WHERE price IS NOT NULL),
m AS (SELECT display_name, max(scraped_at) - INTERVAL 7 DAY AS cutoff FROM f GROUP BY display_name),
s AS (SELECT f.display_name, count(*) AS count, median(price) FILTER (WHERE scraped_at >= cutoff) AS r,
             median(price) FILTER (WHERE scraped_at < cutoff) AS p
      FROM f JOIN m USING (display_name) GROUP BY f.display_name),
c AS (SELECT *, (r - p) / nullif(p, 0) * 100 AS pct FROM s)
SELECT display_name, count, round(coalesce(r, p), 4) AS current_median, round(p, 4) AS prior_median,
       round(pct, 4) AS change_7d,
       CASE WHEN pct IS NULL OR abs(pct) < 0.5 THEN 'flat' WHEN pct > 0 THEN 'up' ELSE 'down' END AS change_class,
       CASE WHEN pct IS NULL THEN '—' WHEN abs(pct) < 0.5 THEN '→ flat'
            ELSE (CASE WHEN pct > 0 THEN '↑' ELSE '↓' END) || printf(' %+.1f%%  /7d', pct) END AS change_label
FROM c""")
def price_change_7d(spark, sf_dir):
    """D2 E3 H31"""
    priced = facts_op.scoped(facts(spark, sf_dir))
    change = market.price_change(priced, ["display_name"])
    return _rounded(change, ["current_median", "prior_median", "change_7d"])


@query("spec_breakdown", f"""
WITH l AS (
  SELECT display_name, price, 'memory' AS spec, memory AS value FROM {FACT_SQL}
  UNION ALL SELECT display_name, price, 'cpu_gen', cpu_gen FROM {FACT_SQL}
  UNION ALL SELECT display_name, price, 'ssd', ssd FROM {FACT_SQL}),
k AS (SELECT display_name, spec FROM l WHERE value IS NOT NULL GROUP BY display_name, spec
      HAVING count(DISTINCT value) >= 2)
SELECT l.display_name, l.spec, l.value, count(price) AS count, round(median(price), 4) AS median
FROM l JOIN k USING (display_name, spec) WHERE value IS NOT NULL
GROUP BY l.display_name, l.spec, l.value HAVING count(price) > 0
ORDER BY display_name, spec, median""")
def spec_breakdown(spark, sf_dir):
    """D10 F2"""
    shown = market.spec_breakdown(facts(spark, sf_dir), ["display_name"])
    return _rounded(shown, ["median"]).orderBy("display_name", "spec", "median", "value")


@query("price_histogram", f"""
WITH f AS (SELECT display_name, CAST(price AS DOUBLE) AS price FROM {FACT_SQL} WHERE price IS NOT NULL),
g AS (SELECT display_name, min(price) AS lo, least(40, greatest(10, count(*) // 4)) AS bins,
             (max(price) - min(price)) / least(40, greatest(10, count(*) // 4)) AS width
      FROM f GROUP BY display_name HAVING count(*) >= 5),
b AS (SELECT display_name, lo, width,
             CAST(least(coalesce(floor((price - lo) / nullif(width, 0)), 0), bins - 1) AS BIGINT) AS bin
      FROM f JOIN g USING (display_name))
SELECT display_name, bin, round(lo + bin * width, 4) AS low, round(lo + (bin + 1) * width, 4) AS high, count(*) AS n
FROM b GROUP BY display_name, bin, lo, width""")
def price_histogram(spark, sf_dir):
    """D11"""
    bins = market.price_histogram(facts(spark, sf_dir), ["display_name"])
    return _rounded(bins, ["low", "high"]).withColumn("bin", F.col("bin").cast("bigint"))


@query("normal_fit", f"""
WITH s AS (SELECT display_name, count(*) AS n, avg(price) AS mu, stddev_pop(price) AS sd,
                  (max(price) - min(price)) / CAST(least(30, greatest(10, count(*) // 5)) AS DOUBLE) AS width
           FROM {FACT_SQL} WHERE price IS NOT NULL GROUP BY display_name HAVING count(*) >= 5),
p AS (SELECT *, CAST(point AS BIGINT) AS i, 3.5 * (2.0 * point / 299 - 1.0) AS z
      FROM s, unnest(range(0, 300)) AS t(point))
SELECT display_name, i AS point, round(mu + z * sd, 3) AS price,
       round(exp(-z * z / 2.0) / (sd * sqrt(2.0 * pi())) * n * width, 4) AS expected
FROM p""")
def normal_fit(spark, sf_dir):
    """D12"""
    curve = market.normal_curve(facts(spark, sf_dir), ["display_name"])
    return curve.select("display_name", F.col("point").cast("bigint").alias("point"),
                        F.round("price", 3).alias("price"), F.round("expected", 4).alias("expected"))


@query("top_models", f"""
SELECT display_name, count(*) AS observations FROM {FACT_SQL} WHERE display_name IS NOT NULL
GROUP BY display_name ORDER BY observations DESC, display_name LIMIT 5""")
def top_models(spark, sf_dir):
    """D13 F4"""
    return market.top_models(facts(spark, sf_dir))


@query("model_meta", f"""
SELECT display_name, count(*) AS observations, count(DISTINCT product_id) AS listings
FROM {FACT_SQL} GROUP BY display_name""")
def model_meta(spark, sf_dir):
    """D14"""
    return market.model_meta(facts(spark, sf_dir), ["display_name"])


@query("facet_values", f"""
SELECT DISTINCT facet, value FROM (
  SELECT unnest(['brand', 'display_name', 'source', 'shop_name']) AS facet,
         unnest([brand, display_name, source, shop_name]) AS value FROM {FACT_SHOP_SQL})
WHERE value IS NOT NULL ORDER BY facet, value""")
def facet_values(spark, sf_dir):
    """F5 G2"""
    rows = with_shop(facts(spark, sf_dir), spark, sf_dir)
    return market.facet_values(rows, ["brand", "display_name", "source", "shop_name"]).orderBy("facet", "value")


# --- trends ------------------------------------------------------------------------
@query("trend_daily", f"""
SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(value) AS count, round(avg(value), 6) AS mean,
       round(median(value), 6) AS median, round({_nearest(0.25, 'value')}, 6) AS p25,
       round({_nearest(0.75, 'value')}, 6) AS p75
FROM events GROUP BY event_type, day HAVING count(value) > 0""")
def trend_daily(spark, sf_dir):
    """D3 D4 F1 on the small fact table"""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_type AS source", "value AS price", "CAST(ts AS TIMESTAMP) AS scraped_at")
    trend = market.daily_trend(events, ["source"], quartiles=True, mean=True)
    return _rounded(_day_text(trend), ["mean", "median", "p25", "p75"], 6)


@query("trend_by_model", f"""
SELECT display_name, {DAY_SQL} AS day, count(price) AS count, round(median(price), 4) AS median,
       CAST({_nearest(0.25)} AS DOUBLE) AS p25, CAST({_nearest(0.75)} AS DOUBLE) AS p75
FROM {FACT_SQL} GROUP BY display_name, day HAVING count(price) > 0""")
def trend_by_model(spark, sf_dir):
    """D3 D7 B14 all models at once"""
    trend = market.daily_trend(facts(spark, sf_dir), ["display_name"], quartiles=True)
    return _rounded(_day_text(trend), ["median"])


@query("trend_by_query", f"""
SELECT o_orderpriority AS search_query, {DAY_SQL} AS day, count(price) AS count, round(median(price), 4) AS median
FROM {HISTORY_SQL} h JOIN orders o ON o.o_orderkey = h.order_key
GROUP BY search_query, day HAVING count(price) > 0""")
def trend_by_query(spark, sf_dir):
    """D7 one line per search query"""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_key", "o_orderpriority AS search_query")
    trend = market.daily_trend(history(spark, sf_dir).join(orders, "order_key"), ["search_query"])
    return _rounded(_day_text(trend), ["median"])


@query("trend_by_source", f"""
SELECT coalesce(source, 'rakuten') AS source, {DAY_SQL} AS day, count(price) AS count, round(median(price), 4) AS median
FROM {HISTORY_SQL} GROUP BY 1, 2 HAVING count(price) > 0""")
def trend_by_source(spark, sf_dir):
    """D5"""
    rows = history(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(fv.DEFAULT_SOURCE)))
    return _rounded(_day_text(market.daily_trend(rows, ["source"])), ["median"])


@query("count_by_date", f"""
SELECT day, CAST(sum(n) AS BIGINT) AS listings, count(*) AS sources FROM (
  SELECT {DAY_SQL} AS day, coalesce(source, 'rakuten') AS s, count(price) AS n FROM {HISTORY_SQL} GROUP BY 1, 2)
WHERE n > 0 GROUP BY day""")
def count_by_date(spark, sf_dir):
    """D6"""
    rows = history(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(fv.DEFAULT_SOURCE)))
    return _day_text(market.count_by_date(rows))


@query("source_comparison", f"""
SELECT source, {DAY_SQL} AS day, count(price) AS count, round(median(price), 4) AS median
FROM {FACT_SQL} WHERE {PATTERN_SQL} GROUP BY source, day HAVING count(price) > 0""")
def source_comparison(spark, sf_dir):
    """D8"""
    rows = facts_op.matching_specs(facts(spark, sf_dir), PATTERNS)
    return _rounded(_day_text(market.source_comparison(rows)), ["median"])


@query("shop_comparison", f"""
SELECT shop_name, {DAY_SQL} AS day, count(price) AS count, round(median(price), 4) AS median
FROM {FACT_SHOP_SQL} WHERE {PATTERN_SQL} AND shop_name IS NOT NULL GROUP BY shop_name, day HAVING count(price) > 0""")
def shop_comparison(spark, sf_dir):
    """D9"""
    rows = facts_op.matching_specs(facts(spark, sf_dir), PATTERNS)
    return _rounded(_day_text(market.shop_comparison(with_shop(rows, spark, sf_dir))), ["median"])


@query("trend_window_batch", """
SELECT event_type AS source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS count,
       round(avg(value), 6) AS mean
FROM events GROUP BY 1, 2""")
def trend_window_batch(spark, sf_dir):
    """S3 the streaming trend's aggregation, run as a batch"""
    from souba.streaming.jobs import daily_windows
    events = table(spark, sf_dir, "events").selectExpr(
        "event_type AS source", "value AS price", "CAST(ts AS TIMESTAMP) AS scraped_at")
    return daily_windows(events).select(
        "source", text.date_label(F.col("day_start")).alias("day"), "count", F.round("mean", 6).alias("mean"))


# --- listings ------------------------------------------------------------------------
@query("listings_vs_median", f"""
WITH f AS (SELECT * FROM {FACT_SQL} WHERE price IS NOT NULL),
m AS (SELECT display_name, median(price) AS med FROM f GROUP BY display_name)
SELECT f.display_name, f.item_name, f.item_url, f.order_key, f.line_number, f.price, f.memory, f.cpu, f.ssd,
       round_even((f.price - med) / nullif(med, 0) * 100, 1) AS vs_median_pct
FROM f JOIN m USING (display_name)""")
def listings_vs_median(spark, sf_dir):
    """E2 C10 F3; each model's listings by price where they are shown, the table itself in no order"""
    rows = facts_op.scoped(facts(spark, sf_dir)).select(
        "display_name", "item_name", "item_url", "order_key", "line_number", "price", "memory", "cpu", "ssd")
    return market.against_median(rows, ["display_name"]).drop("median").sortWithinPartitions("display_name", "price", "order_key", "line_number")


@query("listing_labels", f"""
SELECT order_key, line_number,
       CASE WHEN price IS NULL OR price = 0 THEN '—' ELSE '¥' || format('{{:,}}', price) END AS price_label,
       strftime(scraped_at, '%Y-%m-%d') AS date_label
FROM {HISTORY_SQL}""")
def listing_labels(spark, sf_dir):
    """H30 H32"""
    return history(spark, sf_dir).select(
        "order_key", "line_number", text.yen_or_dash(F.col("price")).alias("price_label"),
        text.date_label(F.col("scraped_at")).alias("date_label"))


@query("latest_price", f"""
WITH r AS (SELECT product_id, coalesce(source, 'rakuten') AS source, price,
                  row_number() OVER (PARTITION BY product_id, source
                                     ORDER BY scraped_at DESC, order_key DESC, line_number DESC) AS rn
           FROM {HISTORY_SQL} WHERE price IS NOT NULL)
SELECT product_id, source, max(price) FILTER (WHERE rn = 1) AS latest_price,
       coalesce(max(price) FILTER (WHERE rn = 2), -1) AS previous_price
FROM r WHERE rn <= 2 GROUP BY product_id, source""")
def latest_price(spark, sf_dir):
    """E5"""
    rows = history(spark, sf_dir).where("price IS NOT NULL").withColumn(
        "source", F.coalesce("source", F.lit(fv.DEFAULT_SOURCE)))
    latest = market.latest_price(rows, ["product_id", "source"],
                                 [F.desc("scraped_at"), F.desc("order_key"), F.desc("line_number")])
    return latest.withColumn("previous_price", F.coalesce("previous_price", F.lit(-1)))
