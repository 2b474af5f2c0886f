"""Registered model queries: training set, features, codes, split, metrics, training, scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from souba.operators import evaluation, features
from souba.plans.registry import query
from souba.plans.views import CATALOGUE_SQL, HISTORY_ATTRIBUTES, HISTORY_SQL, PRODUCT_ATTRIBUTES, catalogue, history, table
from souba.schemas import CATEGORICAL
from souba.session import shared_dir
from souba.sources import sinks


@query("training_set", f"""
SELECT c.id, c.brand, c.cpu_gen, c.memory, c.ssd, c.hdd, c.display_size, c.os, c.source, h.price
FROM {HISTORY_SQL} h JOIN {CATALOGUE_SQL} c ON c.id = h.product_id WHERE c.brand IS NOT NULL AND h.price > 0""")
def training_set(spark, sf_dir):
    """M6 B12 C1 C4"""
    return features.training_set(catalogue(spark, sf_dir), history(spark, sf_dir))


@query("training_rows", f"""
SELECT c.id, c.brand, c.source, h.price, h.order_key, h.line_number, strftime(h.scraped_at, '%Y-%m-%d') AS day
FROM {HISTORY_SQL} h JOIN {CATALOGUE_SQL} c ON c.id = h.product_id WHERE c.brand IS NOT NULL AND h.price > 0""")
def training_rows(spark, sf_dir):
    """M6 M7 one row per observation, with what tells observations apart"""
    rows = features.training_set(catalogue(spark, sf_dir), history(spark, sf_dir), keep=["scraped_at", "order_key", "line_number"])
    return rows.select("id", "brand", "source", "price", "order_key", "line_number", F.date_format("scraped_at", "yyyy-MM-dd").alias("day"))


_DIGITS = lambda c, kind: f"TRY_CAST(nullif(regexp_extract({c}, '(\\d+)', 1), '') AS {kind})"
_GB = lambda c: f"coalesce(CASE WHEN {c} LIKE '%TB%' THEN {_DIGITS(c, 'BIGINT')} * 1024 ELSE {_DIGITS(c, 'BIGINT')} END, 0)"
FEATURE_SQL = f"""(
SELECT id, coalesce(brand, 'unknown') AS brand, coalesce({_DIGITS('cpu_gen', 'DOUBLE')}, -1.0) AS cpu_gen,
       coalesce({_DIGITS('memory', 'BIGINT')}, 0) AS ram_gb, {_GB('ssd')} AS ssd_gb, {_GB('hdd')} AS hdd_gb,
       coalesce(round(TRY_CAST(nullif(regexp_extract(display_size, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 3), -1.0) AS display_size,
       CASE WHEN os LIKE '%11%' THEN 'win11' WHEN os LIKE '%10%' THEN 'win10' WHEN os LIKE '%8%' THEN 'win8'
            WHEN os LIKE '%7%' THEN 'win7' ELSE 'other' END AS os_clean, coalesce(source, 'unknown') AS source
FROM {CATALOGUE_SQL})"""


def _wide(df):
    """32-bit features as 64-bit columns, so that both engines print them alike."""
    return df.withColumns({
        **{c: F.col(c).cast("bigint") for c in ("ram_gb", "ssd_gb", "hdd_gb")},
        **{c: F.round(F.col(c).cast("double"), 3) for c in ("cpu_gen", "display_size")}})


@query("ml_features", f"SELECT * FROM {FEATURE_SQL}")
def ml_features(spark, sf_dir):
    """M1 H27 H28 H29"""
    return _wide(features.model_features(catalogue(spark, sf_dir), keep=["id"]))


# The codes are learnt from the active products; brands, buckets and sources only
# inactive products have all share the code after the last.
def _code_sql(column: str) -> str:
    known = f"SELECT DISTINCT {column} FROM {FEATURE_SQL} WHERE id IN (SELECT id FROM {CATALOGUE_SQL} WHERE is_active AND source = 'kakaku')"
    return f"""CASE WHEN {column} IN ({known}) THEN (SELECT count(*) FROM ({known}) k WHERE encode(k.{column}) < encode(f.{column}))
               ELSE (SELECT count(*) FROM ({known})) END"""


@query("ml_encode", f"""
SELECT id, {', '.join(f'CAST({_code_sql(c)} AS BIGINT) AS {c}_code' for c in CATEGORICAL)},
       CAST(8 AS BIGINT) AS width, CAST(ram_gb + ssd_gb + hdd_gb AS DOUBLE) AS capacity
FROM {FEATURE_SQL} f""")
def ml_encode(spark, sf_dir):
    """M2 M3"""
    products = catalogue(spark, sf_dir)
    learnt = features.model_features(products.where("is_active AND source = 'kakaku'"))
    encoded = features.encode(learnt, features.model_features(products, keep=["id"]))
    from pyspark.ml.functions import vector_to_array
    vector = vector_to_array("features")
    return encoded.select(
        "id", *[F.col(f"{c}_code").cast("bigint").alias(f"{c}_code") for c in CATEGORICAL],
        F.size(vector).cast("bigint").alias("width"), (vector[2] + vector[3] + vector[4]).alias("capacity"))


@query("train_test_split", """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  row_number() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity_text, '42')),
                                     l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER () AS n
           FROM (SELECT *, CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS l_quantity_text FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rn <= floor(n * 0.8) AS is_train FROM k""")
def train_test_split(spark, sf_dir):
    """E4 F6 exactly 80 % of all rows"""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
    return features.exact_split(rows, ids).drop("cents")


@query("train_test_split_by_product", """
WITH p AS (SELECT DISTINCT l_partkey FROM lineitem),
k AS (SELECT l_partkey, row_number() OVER (ORDER BY md5(concat_ws('|', l_partkey, '42')), l_partkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM p)
SELECT is_train, count(*) AS n, count(DISTINCT l_partkey) AS products FROM lineitem JOIN k USING (l_partkey) GROUP BY is_train""")
def train_test_split_by_product(spark, sf_dir):
    """E4 all rows of a product on one side"""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey")
    sides = features.split_by_product(rows, "l_partkey")
    return sides.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("products"))


_METRICS = """
SELECT {key} count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(avg(abs((y - p) / y)) FILTER (WHERE abs(y) > 1e-8) * 100, 4) AS mape,
       round(CASE WHEN min(y) = max(y) THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1.0 - avg((y - p) * (y - p)) / var_pop(y) END, 6) AS r2
FROM (SELECT l_returnflag AS source, l_extendedprice AS y, p_retailprice * l_quantity AS p
      FROM lineitem JOIN part ON p_partkey = l_partkey) {group}"""


def _rounded(df):
    return df.withColumns({**{c: F.round(c, 4) for c in ("mae", "rmse", "mape")}, "r2": F.round("r2", 6)})


def _predicted(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return lines.select(F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("y"),
                        (F.col("p_retailprice") * F.col("l_quantity")).alias("p"))


@query("eval_metrics", _METRICS.format(key="", group=""))
def eval_metrics(spark, sf_dir):
    """D17 D18 D19 D20 D21"""
    return _rounded(evaluation.regression_metrics(_predicted(spark, sf_dir), "y", "p"))


@query("eval_metrics_by_source", _METRICS.format(key="source,", group="GROUP BY source"))
def eval_metrics_by_source(spark, sf_dir):
    """D21 per group"""
    return _rounded(evaluation.regression_metrics(_predicted(spark, sf_dir), "y", "p", ["source"]))


# Prices that the features explain but for 20 yen a piece: a model must have learnt them to come near.
_LEARNABLE = """40000 + 9000 * (p_size % 4) * (p_size % 5) + 5000 * (p_size % 7) + 900 * CAST(substr(p_brand, 7) AS BIGINT) * (1 + p_size % 3)
  + CAST(20 * l_quantity AS BIGINT)"""
_NEAR = 0.1         # of the error of the middle price; the first tree alone does not get there


def _training_rows(spark, sf_dir):
    """All priced observations at prices that depend on the features, split exactly; rows that agree in their keys count each."""
    of = lambda attributes, *more: [*[f"{e} AS {n}" for n, e in attributes.items()], *more]
    rows = table(spark, sf_dir, "lineitem").selectExpr(*of(HISTORY_ATTRIBUTES, "l_quantity")).select(
        "product_id", "price", "order_key", "line_number", "item_code", "shop_key", "l_quantity")
    keys = ["order_key", "line_number", "product_id", "shop_key", "price"]
    sides = features.exact_split(rows.where("price > 0"), keys).drop("price")
    products = table(spark, sf_dir, "part").selectExpr(*of(PRODUCT_ATTRIBUTES, "p_brand", "p_size"))
    known = products.where("brand IS NOT NULL").withColumnRenamed("id", "product_id").drop("item_code")
    return sides.join(known, "product_id").withColumn("price", F.expr(_LEARNABLE)).drop("p_brand", "p_size", "l_quantity")


def _fitted(spark, sf_dir):
    """A model and the rows it was fitted on and held back, written once so that the split is made once."""
    path = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    _training_rows(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    return features.fit_price_model(rows.where("is_train")), rows


_SIDES_SQL = f"""(SELECT h.*, row_number() OVER (ORDER BY md5(concat_ws('|', order_key, line_number, product_id, shop_key, price, '42'))) <= floor(count(*) OVER () * 0.8) AS is_train
  FROM {HISTORY_SQL} h WHERE price > 0)"""


@query("ml_train_eval", f"""
SELECT count(*) AS n, true AS learnt FROM {_SIDES_SQL} h JOIN {CATALOGUE_SQL} c ON c.id = h.product_id WHERE c.brand IS NOT NULL AND NOT is_train""")
def ml_train_eval(spark, sf_dir):
    """M4 M7 D21 rows held out, and whether the error there is at most a tenth of that of the training median"""
    model, rows = _fitted(spark, sf_dir)
    held = rows.where("NOT is_train")
    median = rows.where("is_train").agg(F.percentile("price", 0.5).alias("m"))
    constant = held.agg(F.avg(F.abs(F.col("price") - median.scalar())).alias("mae_of_median"))
    return features.evaluate(model, held).join(constant).select("n", (F.col("mae") <= F.col("mae_of_median") * _NEAR).alias("learnt"))


@query("ml_score", f"SELECT id AS product_id, '1.0.0' AS model_version, true AS learnt FROM {CATALOGUE_SQL} WHERE is_active")
def ml_score(spark, sf_dir):
    """M5 M8 A8 predictions of all active products, appended and read back; is their error on known brands at most a tenth of that of the middle price"""
    model, rows = _fitted(spark, sf_dir)
    path = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    for _ in range(2):      # a run that is tried again counts once
        sinks.append_predictions(features.score_active(model, catalogue(spark, sf_dir)), path, run="first")
    truth = table(spark, sf_dir, "part").selectExpr("p_partkey AS product_id", "p_brand", "p_size", "25.0D AS l_quantity").selectExpr(
        "product_id", f"{_LEARNABLE} AS price", "p_size % 10 <> 0 AS known")
    median = rows.where("is_train").agg(F.percentile("price", 0.5).alias("m"))
    scored = spark.read.parquet(path).join(truth, "product_id")
    errors = scored.where("known").agg(F.avg(F.abs(F.col("predicted_price") - F.col("price"))).alias("own"), F.avg(F.abs(F.col("price") - median.scalar())).alias("plain"))
    learnt = errors.select((F.col("own") <= F.col("plain") * _NEAR).alias("learnt"))         # one row
    return scored.select("product_id", "model_version").join(F.broadcast(learnt))


@query("ml_save_load", f"SELECT id, true AS same FROM {CATALOGUE_SQL}")
def ml_save_load(spark, sf_dir):
    """A12 whether predictions before and after a save agree"""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model, _ = _fitted(spark, sf_dir)
    features.save_model(model, path)
    products = catalogue(spark, sf_dir)
    before = features.predict(model, products, keep=["id"]).select("id", F.col("predicted_price").alias("before"))
    after = features.predict(features.load_model(path), products, keep=["id"]).select("id", F.col("predicted_price").alias("after"))
    return before.join(after, "id").select("id", (F.col("before") == F.col("after")).alias("same"))


_FOLD_IDS = ["order_key", "line_number", "product_id", "shop_key"]


@query("ml_cross_validate", f"""
SELECT CAST((('0x' || substr(md5(concat_ws('|', {', '.join(_FOLD_IDS)}, '42')), 1, 15))::BIGINT) % 5 AS INT) AS fold, count(*) AS n, true AS learnt
FROM {HISTORY_SQL} h JOIN {CATALOGUE_SQL} c ON c.id = h.product_id WHERE c.brand IS NOT NULL AND h.price > 0 GROUP BY 1""")
def ml_cross_validate(spark, sf_dir):
    """M9 rows of each fold, and whether its error by the other folds' trees is less than half of that of the middle price"""
    told = features.cross_validate(_training_rows(spark, sf_dir), _FOLD_IDS)
    return told.select("fold", "n", (F.col("mae") < F.col("mae_of_median") * 0.5).alias("learnt"))
