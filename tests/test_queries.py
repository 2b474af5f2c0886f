"""Every registered query against its oracle at the smallest scale, and the shape of key plans."""

from __future__ import annotations

import inspect
import re

import pytest

from souba.plans import all_oracles, all_queries
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], ORACLES[name], SF) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def _scans(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet", final))


def test_readings_of_the_history(spark):
    """Each aggregate reads its table once; the split reads it to count and to mark."""
    assert _scans(spark, "train_test_split") == 1            # the mark; the counting rounds are jobs before it
    assert _scans(spark, "trend_by_model") <= 2              # history and catalogue
    assert _scans(spark, "spec_breakdown") <= 2


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_any_plan(spark):
    for name in set(QUERIES) - {"ml_train_eval", "ml_score", "ml_save_load", "ml_cross_validate", "ml_encode", "history_partitions"}:
        if not name.startswith(("sink_", "stream_")):
            assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|MapPartitions", _plan(spark, name)), name


def test_no_cross_joins(spark):
    for name in ("price_stats", "price_change_7d", "spec_breakdown", "listings_vs_median", "train_test_split", "normal_fit", "normalize_brand"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "trend_by_source")
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>", plan)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,40)" in _plan(spark, "filtered_scope")


def test_first_per_key_is_limited_before_the_shuffle(spark):
    for name in ("dedupe_first", "latest_price", "upsert_products"):
        plan = _plan(spark, name)
        assert plan.count("WindowGroupLimit") >= 2, name


def test_counts_of_a_summary_share_one_shuffle(spark):
    df = QUERIES["trend_daily"](spark, "/root/testdata/sf0.01")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "top_models")


def _called(function) -> set[str]:
    """Names a query's function uses, those of its module's own helpers included."""
    found, todo = set(), [function]
    while todo:
        f = todo.pop()
        codes = [f.__code__]
        while codes:
            code = codes.pop()
            for name in code.co_names:
                if name not in found:
                    found.add(name)
                    helper = f.__globals__.get(name)
                    if inspect.isfunction(helper) and helper.__module__ == f.__module__:
                        todo.append(helper)
            codes += [c for c in code.co_consts if inspect.iscode(c)]
    return found


# What a registered query must call to stand for an inventory row.
INVENTORY = {
    "A1": ("json_pages_explode", "explode_items"), "A2": ("html_links", "extract_cards"), "A6": ("catalogue_two_runs", "nightly_run"),
    "A7": ("history_partitions", "append_history"), "A8": ("ml_score", "append_predictions"), "A9": ("sink_csv_roundtrip", "write_csv"),
    "A10": ("sink_parquet_roundtrip", "write_parquet"), "A11": ("sink_json_roundtrip", "write_json"), "A12": ("ml_save_load", "load_model"),
    "B1": ("genre_filter", "computers_only"), "B16": ("coerce_fetched", "coerce"), "B18": ("contract_report", "contract_report"), "C7": ("enrich_detail", "enrich_details"),
    "D15": ("noise_filter", "filter_computers"), "D17": ("eval_metrics", "regression_metrics"), "D23": ("run_counters", "run_counters"), "E1": ("dedupe_first", "keep_first"),
    "E4": ("train_test_split", "exact_split"), "F6": ("train_test_split_by_product", "split_by_product"), "H1": ("fw2hw", "to_half_width"),
    "H11": ("normalize_brand", "with_brand"), "H12": ("clean_brand", "clean_brand"), "M1": ("ml_features", "model_features"), "M2": ("ml_encode", "encode"),
    "M5": ("ml_score", "score_active"), "M6": ("training_set", "training_set"), "M7": ("ml_train_eval", "fit_price_model"), "M9": ("ml_cross_validate", "cross_validate"),
    **{f"P{i}": (name, "extract_cards") for i, name in zip((1, 2, 3, 4, 5, 7, 8), (
        "html_table", "html_cards", "html_span_cards", "html_comment_specs", "html_line_boxes", "html_shop_boxes", "html_clip_list"))},
    "P6": ("html_detail_kv", "extract_details"), "P9": ("crawl_coverage", "crawl_coverage"),
    "S1": ("stream_restart", "ingest"), "S2": ("stream_dedupe", "first_observations"), "S3": ("stream_trend", "exact_trend"),
}


@pytest.mark.parametrize("row", sorted(INVENTORY))
def test_inventory_rows_are_called(row):
    name, function = INVENTORY[row]
    assert function in _called(QUERIES[name]), (name, function)


def test_every_inventory_group_has_a_query():
    docs = " ".join(q.__doc__ or "" for q in QUERIES.values())
    for op in [*(f"D{i}" for i in range(1, 24)), *(f"M{i}" for i in range(1, 9)), *(f"P{i}" for i in range(1, 10)),
               *(f"B{i}" for i in range(1, 19)), *(f"E{i}" for i in range(1, 6)), "T1", "T2", "A1", "A5", "A6", "A7", "A9", "A10", "A11", "A12"]:
        if op not in ("D8x",):
            assert re.search(rf"\b{op}\b", docs), op
