"""Queries of fitted models. SQL can't express them; tests hold them against closed forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, predict
from ..operators.infer import loocv_statistics
from ..operators.simulate import simulate
from .network import Network, network

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TYPES = {"tailup": "exponential", "taildown": "exponential", "euclid": "none", "nugget": "nugget"}
THETA = {"tailup_de": 4e6, "tailup_range": 1500.0, "taildown_de": 2e6, "taildown_range": 900.0, "nugget": 4e6}
LINK_THETA = {"tailup_de": 0.2, "tailup_range": 1500.0, "taildown_de": 0.1, "taildown_range": 900.0, "nugget": 0.05}


def add(name: str):
    def put(f: Callable[[Network], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(network(spark, sf_dir))
        return f

    return put


def known(n: Network, index: str | None = None, formula: str = "y_resp ~ elev", obs: DataFrame | None = None, var_adjust: str | None = None, **more) -> models.Model:
    return models.fit(models.Spec(formula, TYPES, **more), n.obs if obs is None else obs, n.edges, known=THETA, index=index, var_adjust=var_adjust)


@add("fit_lm_known")
def _(n):
    return models.glance(known(n))


@add("fit_lm")
def _(n):
    spec = models.Spec("y_resp ~ elev", {"tailup": "exponential", "taildown": "none", "euclid": "none", "nugget": "nugget"})
    return models.tidy(models.fit(spec, n.obs, n.edges), "covariance")


@add("fit_lm_ml_random_partition")
def _(n):
    spec = models.Spec("y_resp ~ elev + grp", TYPES, estmethod="ml", random="~ (1 | grp)", partition="grp")
    return models.tidy(models.fit(spec, n.obs, n.edges, known=THETA | {"random:1 | grp": 1e5}))


@add("fit_lm_local")
def _(n):
    obs = n.obs.withColumn("local_index", (F.col("pid") % 3).cast("int"))
    return models.tidy(known(n, "local_index", obs=obs))


@add("fit_lm_local_pooled")
def _(n):
    obs = n.obs.withColumn("local_index", (F.col("pid") % 3).cast("int"))
    return models.tidy(known(n, "local_index", obs=obs, var_adjust="pooled"))


@add("fit_lm_kmeans")
def _(n):
    obs = models.local_index(n.obs.where("y_resp is not null"), rows=40)
    return models.glance(known(n, "local_index", obs=obs))


@add("model_augment")
def _(n):
    return models.augment(known(n)).select("pid", "`.fitted`", "`.resid`", "`.hat`", "`.cooksd`", "`.std.resid`")


@add("model_anova")
def _(n):
    return models.anova(known(n, formula="y_resp ~ elev + grp"))


@add("model_lrt")
def _(n):
    return models.anova(known(n, formula="y_resp ~ elev", estmethod="ml"), known(n, formula="y_resp ~ elev + grp", estmethod="ml"))


@add("model_glances")
def _(n):
    return models.glances({"elev": known(n), "factor": known(n, formula="y_resp ~ elev + grp")})


@add("model_varcomp")
def _(n):
    return models.varcomp(known(n))


@add("marginal_means")
def _(n):
    return models.marginal_means(known(n, formula="y_resp ~ elev + grp"), "grp")


@add("predict_point")
def _(n):
    return predict.predict(known(n), n.preds, interval="prediction")


@add("predict_neighbourhood")
def _(n):
    return predict.predict(known(n), n.preds, neighbours=40)


@add("predict_missing")
def _(n):
    return predict.predict(known(n), n.obs.where("y_resp is null"), interval="confidence")


@add("predict_terms")
def _(n):
    return predict.predict_terms(known(n), n.preds)


@add("predict_block")
def _(n):
    return predict.predict_block(known(n), n.preds)


@add("loocv")
def _(n):
    return loocv_statistics(predict.loocv(known(n)))


@add("covmatrix_pred_obs")
def _(n):
    return predict.covmatrix(known(n), n.preds, "pred.obs")


RESPONSES = {"poisson": "cast(pid % 7 as double)", "nbinomial": "cast(pid % 7 as double)", "binomial": "cast(pid % 2 as double)", "Gamma": "1 + pid % 9", "inverse.gaussian": "1 + pid % 9", "beta": "(1 + pid % 9) / 10.0"}


def glm(n: Network, family: str) -> models.Model:
    obs = n.obs.withColumn("y_resp", F.expr(RESPONSES[family]).cast("double")).withColumn("elev", F.col("elev") / 1000)
    return models.fit(models.Spec("y_resp ~ elev", TYPES, family=family), obs, n.edges, known=LINK_THETA | {"dispersion": 1.0 if family in ("poisson", "binomial") else 2.0})


def _glm(family: str):
    tag = family.replace(".", "_").lower()
    add(f"fit_glm_{tag}")(lambda n: models.tidy(glm(n, family)))
    add(f"predict_glm_{tag}")(lambda n: predict.predict(glm(n, family), n.preds.withColumn("elev", F.col("elev") / 1000), interval="prediction", type="response"))
    spec = models.Spec("y ~ 1", TYPES, family=family)
    add(f"simulate_{tag}")(lambda n: simulate(spec, LINK_THETA | {"dispersion": 2.0}, n.obs, n.edges, samples=2))


for _family in RESPONSES:
    _glm(_family)


@add("simulate_gaussian")
def _(n):
    return simulate(models.Spec("y ~ 1", TYPES), LINK_THETA, n.obs, n.edges, samples=3)


@add("loocv_glm")
def _(n):
    return loocv_statistics(predict.loocv(glm(n, "poisson"))).select("bias", "mspe", "rmspe", "rav")
