"""Price model: features, split, training, scoring."""

from __future__ import annotations

import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from souba import fixed_values as fv
from souba.operators.evaluation import regression_metrics
from souba.schemas import CATEGORICAL, FEATURE_INPUTS, FEATURES
from souba.session import shared_dir


SPLIT_BITS = 15
PARTITION_ROWS = 250_000     # of the table that trees are grown on


# --- features ----------------------------------------------------------------
def _number(text: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text.cast("string"), pattern, 1), F.lit("")).try_cast(kind)


def storage_gb(text: Column) -> Column:
    """H27 capacity text to GB, 0 when absent."""
    size = _number(text, r"(\d+)", "int")
    return F.coalesce(F.when(F.upper(text).contains("TB"), size * 1024).otherwise(size), F.lit(0))


def os_bucket(text: Column) -> Column:
    """H28 first digit group that fits decides the bucket."""
    return (
        F.when(text.contains("11"), "win11").when(text.contains("10"), "win10")
        .when(text.contains("8"), "win8").when(text.contains("7"), "win7").otherwise("other")
    )


def model_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M1 / H27-H29 raw product text to the eight typed features."""
    col = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in FEATURE_INPUTS}
    return df.select(
        *(keep or []),
        F.coalesce(col["brand"], F.lit("unknown")).alias("brand"),
        F.coalesce(_number(col["cpu_gen"], r"(\d+)", "float"), F.lit(-1.0).cast("float")).alias("cpu_gen"),
        F.coalesce(_number(col["memory"], r"(\d+)", "int"), F.lit(0)).alias("ram_gb"),
        storage_gb(col["ssd"]).alias("ssd_gb"),
        storage_gb(col["hdd"]).alias("hdd_gb"),
        F.coalesce(_number(col["display_size"], r"(\d+(?:\.\d+)?)", "float"),
                   F.lit(-1.0).cast("float")).alias("display_size"),
        os_bucket(col["os"]).alias("os_clean"),
        F.coalesce(col["source"], F.lit("unknown")).alias("source"))


# --- encoding -----------------------------------------------------------------
def encoder_stages() -> list:
    """M2 / M3 labels to codes in code-point order, unseen labels to one extra code; then the vector.

    The codes enter the vector as plain numbers: adding zero drops the mark of a
    categorical feature, which would tie the number of labels to the trees' bins.
    """
    index = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_code" for c in CATEGORICAL],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    numbers = ", ".join(f"{c}_code + 0.0D AS {c}_number" for c in CATEGORICAL)
    plain = SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")
    columns = [f"{c}_number" if c in CATEGORICAL else c for c in FEATURES]
    return [index, plain, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]


def encode(train: DataFrame, df: DataFrame) -> DataFrame:
    """M2 / M3 fit the codes on one table of features and apply them to another."""
    return Pipeline(stages=encoder_stages()).fit(train).transform(df)


# --- training set ----------------------------------------------------------------
def training_set(products: DataFrame, history: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M6 / B12 / C1 / C4 one row per positive price of a product with a brand.

    The semi-join of the id batches is the inner join itself: products are unique.
    ``keep`` names history columns that tell observations apart; they come along.
    """
    keep = keep or []
    known = products.where(F.col("brand").isNotNull()).select("id", *FEATURE_INPUTS)
    prices = history.where(F.col("price") > 0).select(F.col("product_id").alias("id"), "price", *keep)
    return prices.join(known, "id", "inner").select("id", *FEATURE_INPUTS, "price", *keep)


def exact_split(df: DataFrame, ids: list[str], ratio: float = fv.TRAIN_RATIO,
                seed: int = fv.RANDOM_SEED) -> DataFrame:
    """E4 / F6 mark exactly ``int(ratio * n)`` shuffled rows with ``is_train``.

    The shuffled order is that of a hash of the ids (60 bits), so the split is a
    threshold on the hash. It is found bit by bit: rows are counted by their
    next ``SPLIT_BITS`` leading bits, then those of the cell that holds the cut by
    the bits that follow, until the cut lies between two cells. A round brings
    at most 2^15 counts to the driver; the rows and their keys don't move.
    ``ids`` must tell rows apart: rows of one hash fall on one side.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")
    keys, taken, cell, room = df.select(key.alias("_key")), 0, 0, None
    while taken < 60:
        inside = keys.where(F.shiftright("_key", 60 - taken) == cell) if taken else keys
        taken += SPLIT_BITS
        counts = sorted(inside.groupBy(F.shiftright("_key", 60 - taken).alias("cell")).count().collect())
        room = int(sum(n for _, n in counts) * ratio) if room is None else room
        if room == 0:                                            # the cut lies before the first row
            return df.withColumn("is_train", F.lit(False))
        for cell, n in counts:
            if room <= n:
                break
            room -= n
        if room == n:                                            # the whole cell is before the cut
            break
    return df.withColumn("is_train", F.shiftright(key, 60 - taken) <= cell)


def split_by_product(df: DataFrame, product: str = "id", ratio: float = fv.TRAIN_RATIO,
                     seed: int = fv.RANDOM_SEED) -> DataFrame:
    """E4 variant: all rows of a product fall on one side."""
    sides = exact_split(df.select(product).distinct(), [product], ratio, seed)
    return df.join(sides, product)


# --- model -------------------------------------------------------------------------
def price_regressor(max_iter: int = 300, seed: int = fv.RANDOM_SEED, **params) -> GBTRegressor:
    """M4 boosted trees on absolute error, for prices in units of their spread.

    A round's tree fits the signs of the errors, so that it moves a prediction by ``stepSize`` at most: prices in yen
    would not get away from the first tree.
    """
    settings = {
        "lossType": "absolute", "maxDepth": 6, "stepSize": 0.05, "maxIter": max_iter,
        "featureSubsetStrategy": "0.8", "subsamplingRate": 0.8, "maxBins": 64, "checkpointInterval": 10, "seed": seed, **params,
    }
    return GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="scaled", **settings)


def training_table(train: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, float, float]:
    """M7 raw product columns plus ``price`` as a written table of weighted rows, with the prices' median and spread.

    Rows of equal features and price become one row with a ``weight``, combined before they move; ``label`` is the price
    from the median, in units of the mean distance to it. Trees take many passes over the rows, each a job, so they lie
    in as few partitions as ``PARTITION_ROWS`` allows. ``by`` names columns that keep rows apart.
    """
    spark, by = train.sparkSession, by or []
    features = model_features(train, keep=[*by, F.col("price").cast("double").alias("price")])
    path = f"{shared_dir(spark)}/weighted-{uuid.uuid4().hex}"
    features.groupBy(*by, *FEATURES, "price").agg(F.count(F.lit(1)).cast("double").alias("weight")).write.parquet(path)
    rows = spark.read.parquet(path)
    prices = rows.groupBy("price").agg(F.sum("weight").alias("n"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # The median to one part in a thousand is near enough: few cells, whatever the number of prices.
    cells = prices.groupBy(F.round(F.log("price") * 1000).alias("cell")).agg(F.sum("n").alias("n"), F.min("price").alias("least"))
    half = cells.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy())}).where("upto * 2 >= all")
    middle = half.agg(F.min("least")).first()[0] or 0.0
    n, spread = prices.agg(F.count(F.lit(1)), F.sum(F.abs(F.col("price") - middle) * F.col("n")) / F.sum("n")).first()
    spread = spread or 1.0
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    return rows.coalesce(parts).withColumn("label", (F.col("price") - middle) / spread), middle, spread


def _yen(middle: float, spread: float) -> SQLTransformer:
    """The last stage: predictions back in yen."""
    return SQLTransformer(statement=f"SELECT *, scaled * {spread!r}D + {middle!r}D AS prediction FROM __THIS__")


def _boosted(rows: DataFrame, encoder: PipelineModel, middle: float, spread: float, max_iter: int, **params) -> PipelineModel:
    """Trees on encoded rows; a leaf holds the weight of five observations at least, as far as the table has them."""
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    settings = {"minWeightFractionPerNode": min(0.4, 5.0 / total), **params}
    trees = price_regressor(max_iter, **settings).fit(encoder.transform(rows))
    return PipelineModel([*encoder.stages, trees, _yen(middle, spread)])


def fit_price_model(train: DataFrame, max_iter: int = 300, **params) -> PipelineModel:
    """M4 / M7 fit encoder and trees on raw product columns plus ``price``."""
    rows, middle, spread = training_table(train)
    encoder = Pipeline(stages=encoder_stages()).fit(rows)
    return _boosted(rows, encoder, middle, spread, max_iter, **params)


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M5 whole-yen predictions, half to even, in ``predicted_price``."""
    scored = model.transform(model_features(df, keep=keep))
    return scored.withColumn("predicted_price", F.rint("prediction").cast("bigint"))


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """D21 one row of metrics on held-out rows."""
    return regression_metrics(predict(model, test, keep=["price"]), "price", "predicted_price")


def score_active(model: PipelineModel, products: DataFrame, version: str = fv.MODEL_VERSION) -> DataFrame:
    """M8 / A8 prediction records of all active products."""
    scored = predict(model, products.where("is_active"), keep=["id"])
    return scored.select(F.col("id").alias("product_id"), "predicted_price", F.lit(version).alias("model_version"))


def save_model(model: PipelineModel, path: str) -> None:
    """A12"""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A12 anything but a fitted pipeline with a price regressor is refused."""
    model = PipelineModel.load(path)
    if not any(stage.hasParam("lossType") for stage in model.stages):
        raise TypeError(f"{path} holds a pipeline without a price regressor")
    return model


def fold_of(ids: list[str], folds: int, seed: int = fv.RANDOM_SEED) -> Column:
    """M9 the fold of a row, by a hash of what tells rows apart."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")
    return (key % folds).cast("int")


def cross_validate(train: DataFrame, ids: list[str], folds: int = 5, max_iter: int = 50, at_once: int = 2, **params) -> DataFrame:
    """M9 k-fold cross-validation: ``fold``, ``n`` held out, ``mae`` there, and ``mae_of_median``, that of the middle price.

    The weighted table with its fold column is written once and encoded once; each fold's trees are fitted on the other
    folds' rows, ``at_once`` of them side by side, and scored on its own.
    """
    rows, middle, spread = training_table(train.withColumn("fold", fold_of(ids, folds)), ["fold"])
    encoder = Pipeline(stages=encoder_stages()).fit(rows)

    def scored(fold: int) -> DataFrame:
        model = _boosted(rows.where(F.col("fold") != fold), encoder, middle, spread, max_iter, **params)
        error = lambda guess: F.sum(F.abs(F.col("price") - guess) * F.col("weight")) / F.sum("weight")
        return model.transform(rows.where(F.col("fold") == fold)).groupBy("fold").agg(
            F.sum("weight").cast("bigint").alias("n"), error(F.rint("prediction")).alias("mae"), error(F.lit(middle)).alias("mae_of_median"))
    with ThreadPool(at_once) as pool:
        return reduce(DataFrame.union, pool.map(inheritable_thread_target(train.sparkSession)(scored), range(folds)))
