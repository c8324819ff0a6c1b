"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import pairs, variogram
from .network import network


def flow_semivariogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned semivariances of residuals over flow-connected pairs of customers' sites."""
    n = network(spark, sf_dir, obs="customer", preds="supplier")
    resid = variogram.ols_residuals(n.obs, "y_resp", "elev")
    return variogram.binned(variogram.residual_pairs(pairs.self_pairs(n.obs, n.edges), resid, "flowcon"))
