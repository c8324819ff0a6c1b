"""Streams: predictions for new sites from a frozen model, and semivariogram bins that grow with their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, predict


def score(m: models.Model, stream: DataFrame, **how) -> DataFrame:
    """Predictions for a streaming DataFrame of sites. There is no state: each row is predicted by itself from the fitted rows.

    The neighbourhood is that of the whole set elsewhere; a stream has no whole, so all fitted rows are used.
    """
    return predict.predict(m, stream, neighbours=m.n, **how)


def running_bins(pairs: DataFrame, cutoff: float, bins: int = 15) -> DataFrame:
    """Sums of a semivariogram over a stream of (dist, d2) pairs, in complete output mode; gamma is half of d2 / n."""
    near = pairs.where((F.col("dist") > 0) & (F.col("dist") <= cutoff)).withColumn("bin", F.least(F.ceil(F.col("dist") / (cutoff / bins)), F.lit(bins)).cast("int"))
    return near.groupBy("bin").agg(F.sum("dist").alias("dist"), F.sum("d2").alias("d2"), F.count("*").alias("np"))
