"""Statistics of fitted models and of predictions, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import norm_ppf


def loocv_statistics(rows: DataFrame) -> DataFrame:
    """One row of statistics from (y, pred, se) of left-out rows. std_bias divides by the square root of se, as published."""
    r, se = F.col("y") - F.col("pred"), F.col("se")
    cover = {p: norm_ppf(0.5 + p / 200) for p in (80, 90, 95)}
    return rows.agg(
        F.avg(r).alias("bias"), F.avg(r / F.sqrt(se)).alias("std_bias"), F.avg(r * r).alias("mspe"), F.sqrt(F.avg(r * r)).alias("rmspe"),
        F.avg(r * r / (se * se)).alias("std_mspe"), F.sqrt(F.avg(se * se)).alias("rav"), F.pow(F.corr("y", "pred"), F.lit(2.0)).alias("cor2"),
        *[F.avg((F.abs(r / se) < z).cast("int")).alias(f"cover_{p}") for p, z in cover.items()],
    )


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve of (yes, score) by ranks; scores that run the other way are turned. Ties share their mean rank.

    Ranks are counted over the distinct scores, each with its numbers of rows, not over the rows themselves.
    """
    each = rows.groupBy("score").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))
    below = F.coalesce(F.sum("no").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = each.select("yes", "no", (F.col("yes") * (below + F.col("no") / 2)).alias("wins"))
    auc = F.sum("wins") / (F.sum("yes") * F.sum("no"))
    return wins.agg(auc.alias("auc")).select(F.greatest("auc", 1 - F.col("auc")).alias("auroc"))


def information_criteria(rows: DataFrame) -> DataFrame:
    """rows (npar, loglik, n) with aic, aicc and bic."""
    k, n, dev = F.col("npar"), F.col("n"), -2 * F.col("loglik")
    return rows.select("*", (dev + 2 * k).alias("aic"), (dev + 2 * n * k / (n - k - 1)).alias("aicc"), (dev + k * F.log("n")).alias("bic"))


def variance_components(spark: SparkSession, pseudo_r2: float, parts: dict[str, float]) -> DataFrame:
    total = sum(parts.values())
    rows = [("Covariates (PR-sq)", float(pseudo_r2)), *[(k, (1 - pseudo_r2) * v / total) for k, v in parts.items()]]
    return spark.createDataFrame(rows, "varcomp string, proportion double")
