"""The three end-to-end jobs: nightly run, training, scoring (and the model backfill).

Intermediate results are written tables in the shared folder, so a lost executor
costs a retry of its tasks and no page is parsed twice.
"""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from souba.operators import catalog, extraction, features, noise
from souba.schemas import ORDER_COLUMNS, PRODUCT_KEY, PRODUCTS
from souba.session import shared_dir
from souba.sources import html_pages, json_pages, sinks

log = logging.getLogger(__name__)
SPEC_COLUMNS = ("brand", "model", "cpu", "memory", "ssd", "hdd", "os", "display_size")
CATALOGUE = T.StructType([T.StructField("id", T.StringType()), *PRODUCTS.fields])


def with_product_id(products: DataFrame) -> DataFrame:
    """Surrogate id of a product, the same in every run."""
    made = F.sha2(F.concat_ws("|", *PRODUCT_KEY), 256)
    return products.withColumn("id", F.coalesce(F.col("id"), made) if "id" in products.columns else made)


def api_listings(pages: DataFrame, scraped_at: str) -> DataFrame:
    """B1 B2 B6 B7 T1 API pages (with their search_query, and query_no and page_no where known) to listings with specs.

    Accessories are dropped by title and genre before anything is read out of the text.
    """
    items = noise.filter_computers(json_pages.computers_only(json_pages.explode_items(pages))).drop("is_uncertain")
    raw = items.withColumns({
        "combined": json_pages.combined_text(F.col("itemName"), F.col("itemCaption")),
        "scraped_at": F.lit(scraped_at), "is_active": F.lit(True)})
    found = extraction.extract_specs(raw)
    return found


def page_listings(pages: DataFrame, layout: str, scraped_at: str, details: DataFrame | None = None) -> DataFrame:
    """P1-P8 HTML pages to listings; shops without spec fields get them from the title.

    ``details`` are landed detail pages (``itemUrl``, ``html``), P6: what they say wins over the list, C7.
    """
    cards = html_pages.extract_cards(pages, html_pages.LAYOUTS[layout], F.lit(scraped_at))
    if details is not None:
        cards = catalog.enrich_details(cards, catalog.keep_first(html_pages.extract_details(details), ["itemUrl"], ["sku"]), "itemUrl")
    if layout not in ("shop_boxes", "clip_list"):
        return cards
    named = cards.withColumns({"combined": F.col("itemName"), "genreId": F.lit(None).cast("string")})
    return extraction.extract_specs(named)


def _observed(counts: Observation) -> dict[str, int]:
    """What a finished job has counted; nothing where its rows were known to be none, so that no task ran."""
    try:
        return counts.get
    except Py4JError:
        return {}


@dataclass
class RunReport:
    """What a nightly run did."""

    run_id: str
    sources: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    scraped: dict[str, int] = field(default_factory=dict)   # items per source
    new: dict[str, int] = field(default_factory=dict)       # products per source that the catalogue did not have
    filled: dict[str, dict[str, float]] = field(default_factory=dict)    # D16 share of items with a value, per source and column
    broken: dict[str, dict[str, int]] = field(default_factory=dict)      # B18 items per source that break a rule of the catalogue
    observations: int = 0                                   # prices appended to the history


def _landing_counts(columns: list[str]) -> list[Column]:
    """What is counted while a source's items are written: items, values per column, broken rules."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rules = {"no_item_code": ["item_code"], "no_item_name": ["item_name"], "no_item_url": ["item_url"], "no_price": ["itemPrice"]}
    return [
        F.count(F.lit(1)).alias("scraped"),
        *[F.count_if(~blank(c)).alias(f"filled_{c}") for c in columns if c in SPEC_COLUMNS],
        *[F.count_if(blank(c)).alias(f"broken_{rule}") for rule, (c,) in rules.items() if c in columns],
        *([F.count_if(~F.col("item_url").startswith("https://")).alias("broken_url_not_https")] if "item_url" in columns else [])]


def nightly_run(spark: SparkSession, listings: dict[str, DataFrame], catalogue_path: str, history_path: str,
                seen_at: dt.datetime, run_id: str | None = None, retire: bool = True) -> RunReport:
    """Listings of each source into catalogue and history.

    A source that fails is reported and left as it was; the others go on. All
    queries of a source are one set, so no query retires what another saw. Only
    the catalogue partitions of the run's sources are read and rewritten. A run
    that is tried again under its ``run_id`` replaces its own observations.
    ``retire=False`` leaves unseen products alone: for parts of a run, after the
    last of which ``retire_unseen`` looks at the whole. The report's counts are
    observed by the jobs that write; nothing is read again for them.
    """
    report = RunReport(run_id or uuid.uuid4().hex)
    run = f"{shared_dir(spark)}/runs/{report.run_id}-{uuid.uuid4().hex}"
    stamp = F.lit(seen_at).cast("timestamp")
    for source, rows in listings.items():
        try:
            items, counts = catalog.standardise(rows, source, stamp), Observation()
            items.observe(counts, *_landing_counts(items.columns)).write.parquet(f"{run}/{source}")
            report.sources.append(source)
            told = _observed(counts)
            report.scraped[source] = told.get("scraped", 0)
            report.filled[source] = {k[7:]: v / max(told["scraped"], 1) for k, v in told.items() if k.startswith("filled_")}
            report.broken[source] = {k[7:]: v for k, v in told.items() if k.startswith("broken_")}
        except Exception as error:  # noqa: BLE001 - one shop's trouble must not stop the others
            log.warning("source %s failed: %s", source, error)
            report.failed[source] = str(error)
    if not report.sources:
        return report
    landed = catalog.union_sources(*[spark.read.parquet(f"{run}/{s}") for s in report.sources])

    known = sinks.Snapshots(spark, catalogue_path)
    current = known.read(CATALOGUE, report.sources)
    order = [*ORDER_COLUMNS, "item_url", "item_name", "itemPrice", "search_query"]
    one_each = catalog.keep_first(landed.where(F.col("item_code").isNotNull()), PRODUCT_KEY,
                                  [F.col(c).asc_nulls_last() for c in order if c in landed.columns])
    batch = one_each.select(*[c for c in PRODUCTS.fieldNames() if c in one_each.columns])
    merged, counts = catalog.upsert_products(current, batch), Observation()
    merged = merged.observe(counts, *[F.count_if(F.col("id").isNull() & (F.col("source") == s)).alias(s) for s in report.sources])      # ids are given next
    merged = with_product_id(merged)
    if retire:
        merged = catalog.deactivate_unseen(merged, batch, report.sources)
    known.write(merged.select(CATALOGUE.fieldNames()))
    told = _observed(counts)
    report.new = {s: told.get(s, 0) for s in report.sources}
    known.retire()

    products = known.read(CATALOGUE, report.sources)
    observed = catalog.price_observations(landed.withColumn("scraped_at", stamp), products)
    counts = Observation()
    sinks.append_history(observed.observe(counts, F.count(F.lit(1)).alias("n")), history_path, run=report.run_id)
    report.observations = _observed(counts).get("n", 0)
    return report


def retire_unseen(spark: SparkSession, catalogue_path: str, sources: list[str], run_start: dt.datetime) -> None:
    """C5 after the last part of a run: products of its sources last seen before it become inactive."""
    known = sinks.Snapshots(spark, catalogue_path)
    current = known.read(CATALOGUE, sources)
    known.write(catalog.deactivate_stale(current, sources, F.lit(run_start).cast("timestamp")))


def train_job(spark: SparkSession, catalogue_path: str, history_path: str, model_path: str,
              max_iter: int = 300, **params) -> DataFrame:
    """M6 M7 A12 fit on 80 % of the observations, save, report on the rest."""
    products = sinks.Snapshots(spark, catalogue_path).read(CATALOGUE)
    history = sinks.read_history(spark, history_path)
    # A row number is not stable across retries; the split hashes what tells observations apart.
    apart = ["scraped_at", "item_code", "search_query"]
    rows = features.training_set(products, history, keep=apart)
    if rows.isEmpty():
        raise RuntimeError("no priced observation of a product with a brand")
    sides = features.exact_split(rows, ["id", "price", *apart])
    path = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    sides.write.parquet(path)
    sides = spark.read.parquet(path)
    model = features.fit_price_model(sides.where("is_train"), max_iter=max_iter, **params)
    features.save_model(model, model_path)
    return features.evaluate(model, sides.where("NOT is_train"))


def score_job(spark: SparkSession, catalogue_path: str, model_path: str, predictions_path: str, run: str | None = None) -> DataFrame:
    """M8 A8 predict all active products and append the predictions."""
    model: PipelineModel = features.load_model(model_path)
    products = sinks.Snapshots(spark, catalogue_path).read(CATALOGUE)
    scored = features.score_active(model, products)
    sinks.append_predictions(scored, predictions_path, run)
    return scored


def backfill_job(spark: SparkSession, catalogue_path: str) -> DataFrame:
    """T2 D22 rewrite the catalogue with models read from titles; report the matches."""
    known = sinks.Snapshots(spark, catalogue_path)
    products = known.read(CATALOGUE)
    report = extraction.backfill_report(products)
    known.write(extraction.backfill_models(products))
    return report
