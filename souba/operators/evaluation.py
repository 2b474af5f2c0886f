"""Regression metrics (D17-D21) as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """D17-D21 MAE, RMSE, MAPE (%) and R2 per group, or over the table.

    MAPE leaves out actual values of zero and is NaN when none is left. R2 is 1
    for a perfect fit of constant values and 0 for any other fit of them. Both
    sums of squares come from one pass: the spread is the population variance.
    """
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.where(y.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("_mse"),
        F.avg(F.when(F.abs(y) > 1e-8, F.abs((y - p) / y))).alias("_ape"),
        F.var_pop(y).alias("_var"), F.min(y).alias("_min"), F.max(y).alias("_max"))
    constant = F.col("_min") == F.col("_max")
    r2 = (
        F.when(constant, F.when(F.col("_mse") == 0.0, 1.0).otherwise(0.0))
        .otherwise(1.0 - F.try_divide(F.col("_mse"), F.col("_var")))
    )
    return sums.select(
        *(by or []), "n", "mae", F.sqrt("_mse").alias("rmse"),
        F.coalesce(F.col("_ape") * 100, F.lit(float("nan"))).alias("mape"), r2.alias("r2"))
