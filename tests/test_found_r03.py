"""What the third round found, on rows written for these tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from souba.functions import html as H
from souba.plans import all_queries, model_queries


def test_an_element_is_looked_up_once(spark):
    """F13 one search for the opening tag, one for tags of its name."""
    page = spark.createDataFrame([("<p>x</p><div class='a'>b &amp; c</div>",)], "html string").select(H.tag_index(F.col("html")).alias("page"))
    found = page.select(H.first(F.col("page"), "div"), H.text_of(H.first(F.col("page"), "div")).alias("text"))
    assert page.select(H.first(F.col("page"), "div"))._jdf.queryExecution().logical().toString().count("filter(") == 2
    assert found.first()["text"] == "b & c"
    assert page.select(H.text_of(H.first(F.col("page"), "ul")).alias("text")).first()["text"] is None


def test_codes_of_listings_are_not_moved_with_observations(spark):
    """F14"""
    view = all_queries()["listings_view"](spark, "/root/testdata/sf0.001")
    assert "cast(l_partkey" not in view._jdf.queryExecution().optimizedPlan().toString()


def test_training_rows_that_agree_in_their_keys_count_once_each(spark, tmp_path):
    """Two equal observations, one that differs from a third in its amount only, and one without an order."""
    day = dt.date(2026, 1, 1)
    lines = [(1, 1, 7, 3, 2.0, 900.0), (1, 1, 7, 3, 2.0, 900.0), (2, 1, 8, 3, 4.0, 500.0), (2, 1, 8, 3, 5.0, 500.0), (None, 1, 8, 3, 1.0, 100.0)]
    spark.createDataFrame([(*line, "A", day) for line in lines], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, "
                          "l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(7, "a", "Brand#11", "T", 1, 10.0), (8, "b", "Brand#12", "T", 2, 10.0), (8, "b", "Brand#12", "T", 2, 10.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = model_queries._training_rows(spark, str(tmp_path)).groupBy("product_id", "line_number").count().collect()
    assert sorted((r["product_id"], r["count"]) for r in rows) == [(7, 2), (8, 6)]
