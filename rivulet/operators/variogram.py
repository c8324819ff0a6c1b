"""Empirical semivariograms split by flow relationship: classic, robust, cloud, within levels of a partition factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("flowcon", "flowuncon", "euclid")


def ols_residuals(sites: DataFrame, y: str, x: str) -> DataFrame:
    """Residuals of y on an intercept and x, over rows where y is known; the two coefficients come from one aggregate row."""
    seen = sites.where(F.col(y).isNotNull())
    fit = seen.agg(F.expr(f"regr_slope({y}, {x})").alias("slope"), F.expr(f"regr_intercept({y}, {x})").alias("icept"))
    return seen.crossJoin(F.broadcast(fit)).withColumn("resid", F.col(y) - F.col("icept") - F.col("slope") * F.col(x)).drop("slope", "icept")


def residual_pairs(pairs: DataFrame, resid: DataFrame, kind: str, partition: str | None = None) -> DataFrame:
    """(dist, d2, d1) of the pairs of a kind: distance, squared and absolute difference of residuals."""
    more = [partition] if partition else []
    i, j = (resid.select(F.col("pid").alias(f"pid_{s}"), F.col("resid").alias(f"r_{s}"), *[F.col(c).alias(f"part_{s}") for c in more]) for s in "ij")
    met = pairs.where("pid_i < pid_j").join(i, "pid_i").join(j, "pid_j")
    if partition:
        met = met.where("part_i = part_j")
    if kind == "flowcon":
        met = met.where("b = 0")
    elif kind == "flowuncon":
        met = met.where("b <> 0")
    elif kind != "euclid":
        raise ValueError(f"a semivariogram is one of {', '.join(KINDS)}")
    gap = F.col("r_i") - F.col("r_j")
    return met.select(F.col("e" if kind == "euclid" else "h").alias("dist"), (gap * gap).alias("d2"), F.abs(gap).alias("d1")).where("dist > 0")


def cloud(rows: DataFrame) -> DataFrame:
    return rows.select("dist", (F.col("d2") / 2).alias("gamma"))


def binned(rows: DataFrame, bins: int = 15, cutoff: float | None = None, robust: bool = False) -> DataFrame:
    """(bin, dist, gamma, np): equal right-closed bins up to the cutoff (half the largest distance), empty ones with np 0.

    The robust form has no half, as published practice with this estimator has it here.
    """
    if cutoff is None:
        rows = rows.crossJoin(F.broadcast(rows.agg((F.max("dist") / 2).alias("cutoff"))))
    else:
        rows = rows.withColumn("cutoff", F.lit(float(cutoff)))
    inside = rows.where("dist <= cutoff").withColumn("bin", F.least(F.ceil(F.col("dist") / (F.col("cutoff") / bins)), F.lit(bins)).cast("int"))
    n = F.count("*")
    root = F.avg(F.sqrt("d1"))
    gamma = root * root * root * root / (F.lit(0.914) + F.lit(0.988) / n) if robust else F.avg("d2") / 2
    sums = inside.groupBy("bin").agg(F.avg("dist").alias("dist"), gamma.alias("gamma"), n.alias("np"))
    spine = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(sums, "bin", "left").select("bin", "dist", "gamma", F.coalesce("np", F.lit(0)).cast("bigint").alias("np"))
