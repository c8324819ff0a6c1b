"""Queries of fitted models that have a closed form in SQL: a covariance of a nugget and a random intercept for each grp, known.

With V = s I + t Z Z', V^-1 is I / s less t / (s + t n_g) / s over the rows of a group, so all sums of a fit follow from the moments of
each group. The models take the same path as any other; a nugget alone (t = 0) gives the statistics of rows and predictions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, predict
from ..operators.infer import loocv_statistics
from .network import Network
from .queries import CROSS_PAIRS, OBS_PAIRS, query

NUGGET, INTERCEPT = 4e6, 1e6
TYPES = {"tailup": "none", "taildown": "none", "euclid": "none", "nugget": "nugget"}
Z95 = "1.959963984540054e0"


def fitted(n: Network, formula: str = "y_resp ~ elev", random: bool = False, index: str | None = None, var_adjust: str | None = None, **more) -> models.Model:
    known = {"nugget": NUGGET} | ({"random:1 | grp": INTERCEPT} if random else {})
    spec = models.Spec(formula, TYPES, random="~ (1 | grp)" if random else None, **more)
    return models.fit(spec, n.obs, n.edges, known=known, index=index, var_adjust=var_adjust)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def moments(t: float) -> str:
    """v_b: n, the sums a, b, c, u, v, w of X'V^-1X, X'V^-1y and y'V^-1y, and the coefficients b0 and b1."""
    s, t = f"{NUGGET:.0f}e0", f"{t:.0f}e0"
    return f"""
v_s AS (SELECT grp, count(*) AS n, sum(elev) AS x, sum(y_resp) AS y, sum(elev * elev) AS xx, sum(elev * y_resp) AS xy, sum(y_resp * y_resp) AS yy FROM v_obs WHERE y_resp IS NOT NULL GROUP BY grp),
v_k AS (SELECT *, {t} / ({s} + {t} * n) AS k FROM v_s),
v_q AS (SELECT CAST(sum(n) AS INT) AS n, (sum(n) - sum(k * n * n)) / {s} AS a, (sum(x) - sum(k * n * x)) / {s} AS b, (sum(xx) - sum(k * x * x)) / {s} AS c, (sum(y) - sum(k * n * y)) / {s} AS u,
 (sum(xy) - sum(k * x * y)) / {s} AS v, (sum(yy) - sum(k * y * y)) / {s} AS w, sum((n - 1) * ln({s}) + ln({s} + {t} * n)) AS logdet FROM v_k),
v_b AS (SELECT *, a * c - b * b AS det, (c * u - b * v) / (a * c - b * b) AS b0, (a * v - b * u) / (a * c - b * b) AS b1 FROM v_q)"""


RANDOM, PLAIN = moments(INTERCEPT), moments(0.0)
_TIDY = f"""SELECT term, round(e, 6) AS estimate, round(s, 6) AS std_error, round(e / s, 6) AS statistic, round(e - {Z95} * s, 6) AS conf_low, round(e + {Z95} * s, 6) AS conf_high
 FROM (SELECT '(Intercept)' AS term, b0 AS e, sqrt(c / det) AS s FROM v_b UNION ALL SELECT 'elev', b1, sqrt(a / det) FROM v_b)"""


def _tidy(m: models.Model) -> DataFrame:
    return rounded(models.tidy(m, conf_level=0.95).drop("p_value"), 6, "estimate", "std_error", "statistic", "conf_low", "conf_high")


@query("closed_tidy", _TIDY, RANDOM)
def _(n):
    return _tidy(fitted(n, random=True))


@query("closed_tidy_local", _TIDY, RANDOM)
def _(n):
    return _tidy(fitted(n, random=True, index="grp", var_adjust="none"))


@query("closed_tidy_local_adjusted", _TIDY, RANDOM)
def _(n):
    return _tidy(fitted(n, random=True, index="grp", var_adjust="theoretical"))


@query("closed_tidy_partition", _TIDY, RANDOM)
def _(n):
    return _tidy(fitted(n, random=True, partition="grp"))


_VALUE = "logdet + w - b0 * u - b1 * v + (n - 2) * ln(2 * pi()) + ln(det)"


@query("closed_glance", f"SELECT 'model' AS model, n, 2 AS p, 0 AS npar, round(z, 6) AS value, round(z, 6) AS aic, round(z, 6) AS aicc, round(z, 6) AS bic, round(-z / 2, 6) AS loglik, round(dev, 6) AS deviance, round(greatest(0, 1 - dev / (w - u * u / a)), 9) AS pseudo_r_squared FROM (SELECT *, {_VALUE} AS z, w - b0 * u - b1 * v AS dev FROM v_b)", RANDOM)
def _(n):
    return rounded(rounded(models.glance(fitted(n, random=True)), 6, "value", "aic", "aicc", "bic", "loglik", "deviance"), 9, "pseudo_r_squared")


@query("closed_glances_ranked", """SELECT model, k AS p, round(z, 6) AS value, round(z + 2e0 * n * k / (n - k - 1), 6) AS aicc, round(z + ln(n) * k, 6) AS bic, CAST(rank() OVER (ORDER BY z + 2e0 * n * k / (n - k - 1)) AS INT) AS place
 FROM (SELECT 'elev' AS model, 2 AS k, n, logdet + w - b0 * u - b1 * v + n * ln(2 * pi()) AS z FROM v_b UNION ALL SELECT 'mean', 1, n, logdet + w - u * u / a + n * ln(2 * pi()) FROM v_b)""", RANDOM)
def _(n):
    from pyspark.sql.window import Window

    out = models.glances({"elev": fitted(n, random=True, estmethod="ml"), "mean": fitted(n, "y_resp ~ 1", random=True, estmethod="ml")})
    return rounded(out.select("model", "p", "value", "aicc", "bic", F.rank().over(Window.orderBy("aicc")).alias("place")), 6, "value", "aicc", "bic")  # a row for each model


@query("closed_lrt", "SELECT 'likelihood ratio' AS effect, 1 AS df, round(b0 * u + b1 * v - u * u / a, 6) AS chi2 FROM v_b", RANDOM)
def _(n):
    out = models.anova(fitted(n, random=True, estmethod="ml"), fitted(n, "y_resp ~ 1", random=True, estmethod="ml"))
    return rounded(out.drop("p_value"), 6, "chi2")


@query("closed_anova", "SELECT '(Intercept)' AS effect, 1 AS df, round(b0 * b0 / (c / det), 6) AS chi2 FROM v_b UNION ALL SELECT 'elev', 1, round(b1 * b1 / (a / det), 6) FROM v_b", RANDOM)
def _(n):
    return rounded(models.anova(fitted(n, random=True)).drop("p_value"), 6, "chi2")


@query("closed_contrast", "SELECT 'both' AS effect, 2 AS df, round(b0 * u + b1 * v, 6) AS chi2, round(exp(-(b0 * u + b1 * v) / 2), 9) AS p_value FROM v_b", RANDOM)
def _(n):
    return rounded(rounded(models.anova(fitted(n, random=True), contrasts={"both": np.eye(2)}), 6, "chi2"), 9, "p_value")


@query("closed_varcomp", f"""SELECT varcomp, round(x, 9) AS proportion FROM (SELECT greatest(0, 1 - (w - b0 * u - b1 * v) / (w - u * u / a)) AS r FROM v_b) b,
 LATERAL (SELECT 'Covariates (PR-sq)' AS varcomp, r AS x UNION ALL SELECT 'nugget', (1 - r) * {NUGGET:.0f}e0 / {NUGGET + INTERCEPT:.0f}e0 UNION ALL SELECT 'random:1 | grp', (1 - r) * {INTERCEPT:.0f}e0 / {NUGGET + INTERCEPT:.0f}e0)""", RANDOM)
def _(n):
    return rounded(models.varcomp(fitted(n, random=True)), 9, "proportion")


_BLUPS = f"SELECT '1 | grp' AS term, grp AS level, round({INTERCEPT:.0f}e0 * (g.y - g.n * b0 - b1 * g.x) / ({NUGGET:.0f}e0 + {INTERCEPT:.0f}e0 * g.n), 6) AS blup FROM v_s g, v_b"


@query("blup_by_level", _BLUPS, RANDOM)
def _(n):
    return rounded(models.random_effects(fitted(n, random=True)), 6, "blup")


@query("blup_by_level_local", _BLUPS, RANDOM)
def _(n):
    return rounded(models.random_effects(fitted(n, random=True, index="grp", var_adjust="none")), 6, "blup")


@query("closed_covmatrix", f"SELECT i.pid AS pid_i, j.pid AS pid_j, CASE WHEN i.grp = j.grp THEN {INTERCEPT:.0f}e0 ELSE 0e0 END + CASE WHEN i.pid = j.pid THEN {NUGGET:.0f}e0 ELSE 0e0 END AS cov FROM v_obs i, v_obs j WHERE i.y_resp IS NOT NULL AND j.y_resp IS NOT NULL")
def _(n):
    return predict.covmatrix(fitted(n, random=True))


@query("closed_marginal_means", f"SELECT grp AS level, round(avg(y_resp), 6) AS emmean, round(sqrt({NUGGET:.0f}e0 / count(*)), 6) AS se FROM v_obs WHERE y_resp IS NOT NULL GROUP BY grp")
def _(n):
    return rounded(models.marginal_means(fitted(n, "y_resp ~ grp"), "grp"), 6, "emmean", "se")


#: Statistics of rows with a nugget alone: residual r, hat value h, whitened residual z.
_ROWS = f"""{PLAIN},
v_r AS (SELECT pid, y_resp AS y, b0 + b1 * elev AS f, y_resp - b0 - b1 * elev AS r, (c - 2 * b * elev + a * elev * elev) / det / {NUGGET:.0f}e0 AS h, (y_resp - b0 - b1 * elev) / sqrt({NUGGET:.0f}e0) AS z FROM v_obs, v_b WHERE y_resp IS NOT NULL)"""


@query("closed_augment", 'SELECT pid, round(f, 6) AS fitted, round(r, 6) AS resid, round(h, 9) AS hat, round(z * z * h / (2 * (1 - h)), 9) AS cooksd, round(z / sqrt(1 - h), 9) AS std_resid FROM v_r', _ROWS)
def _(n):
    out = models.augment(fitted(n)).select("pid", *[F.col(f"`.{c}`").alias(c.replace(".", "_")) for c in ("fitted", "resid", "hat", "cooksd", "std.resid")])
    return rounded(rounded(out, 6, "fitted", "resid"), 9, "hat", "cooksd", "std_resid")


@query("closed_plot_leverage", "SELECT pid, round(h, 9) AS x, round(z / sqrt(1 - h), 9) AS y FROM v_r", _ROWS)
def _(n):
    return rounded(models.plot_data(fitted(n), 5), 9, "x", "y")


@query("closed_loocv", f"SELECT pid, round(y, 6) AS y, round(y - r / (1 - h), 6) AS pred, round(sqrt({NUGGET:.0f}e0 / (1 - h)), 6) AS se FROM v_r", _ROWS)
def _(n):
    return rounded(predict.loocv(fitted(n)), 6, "y", "pred", "se")


@query("closed_loocv_statistics", f"SELECT round(avg(d), 6) AS bias, round(avg(d * d), 3) AS mspe, round(sqrt(avg(d * d)), 6) AS rmspe, round(avg(d * d / (se * se)), 6) AS std_mspe, round(sqrt(avg(se * se)), 6) AS rav FROM (SELECT r / (1 - h) AS d, sqrt({NUGGET:.0f}e0 / (1 - h)) AS se FROM v_r)", _ROWS)
def _(n):
    out = loocv_statistics(predict.loocv(fitted(n))).select("bias", "mspe", "rmspe", "std_mspe", "rav")
    return rounded(rounded(out, 3, "mspe"), 6, "bias", "rmspe", "std_mspe", "rav")


def _predicted(rows: str, own: str) -> str:
    return f"""SELECT pid, round(f, 6) AS fit, round(s, 6) AS se, round(f - {Z95} * s, 6) AS lower, round(f + {Z95} * s, 6) AS upper
 FROM (SELECT pid, b0 + b1 * elev AS f, sqrt({own} + (c - 2 * b * elev + a * elev * elev) / det) AS s FROM {rows}, v_b)"""


@query("closed_predict", _predicted("v_preds", f"{NUGGET:.0f}e0"), PLAIN)
def _(n):
    return rounded(predict.predict(fitted(n), n.preds, interval="prediction"), 6, "fit", "se", "lower", "upper")


@query("closed_predict_missing", _predicted("(SELECT * FROM v_obs WHERE y_resp IS NULL) o", "0e0"), PLAIN)
def _(n):
    return rounded(predict.predict(fitted(n), n.obs.where("y_resp is null"), interval="confidence"), 6, "fit", "se", "lower", "upper")


@query("closed_predict_block", f"""SELECT round(f, 6) AS fit, round(s, 6) AS se, round(f - {Z95} * s, 6) AS lower, round(f + {Z95} * s, 6) AS upper
 FROM (SELECT b0 + b1 * e AS f, sqrt({NUGGET:.0f}e0 / m + (c - 2 * b * e + a * e * e) / det) AS s FROM (SELECT avg(elev) AS e, count(*) AS m FROM v_preds) p, v_b)""", PLAIN)
def _(n):
    return rounded(predict.predict_block(fitted(n), n.preds), 6, "fit", "se", "lower", "upper")


@query("closed_predict_terms", "SELECT pid, round((elev - e) * b1, 6) AS elev, round(b0 + b1 * e, 6) AS constant FROM v_preds, v_b, (SELECT avg(elev) AS e FROM v_obs WHERE y_resp IS NOT NULL) m", PLAIN)
def _(n):
    return rounded(predict.predict_terms(fitted(n), n.preds), 6, "elev", "constant")


def _spatial(n: Network) -> models.Model:
    known = {"tailup_de": 2.5, "tailup_range": 700.0, "taildown_de": 1.5, "taildown_range": 900.0, "nugget": 0.3}
    return models.fit(models.Spec("y_resp ~ elev", TYPES | {"tailup": "exponential", "taildown": "exponential"}), n.obs, n.edges, known=known)


_FLOW = "coalesce(exp(-h / 7e2) * w * 2.5e0 + exp(-h / 9e2) * 1.5e0, 0)"


@query("closed_covmatrix_spatial", f"SELECT i.pid AS pid_i, j.pid AS pid_j, round({_FLOW} + CASE WHEN i.pid = j.pid THEN 0.3e0 ELSE 0 END, 9) AS cov FROM v_obs i JOIN v_obs j ON i.y_resp IS NOT NULL AND j.y_resp IS NOT NULL LEFT JOIN v_pairs p ON p.pid_i = i.pid AND p.pid_j = j.pid", OBS_PAIRS)
def _(n):
    return rounded(predict.covmatrix(_spatial(n)), 9, "cov")


@query("closed_covmatrix_pred_obs", f"SELECT i.pid AS pid_i, j.pid AS pid_j, round({_FLOW}, 9) AS cov FROM v_preds i JOIN v_obs j ON j.y_resp IS NOT NULL LEFT JOIN v_cross p ON p.pid_i = i.pid AND p.pid_j = j.pid", CROSS_PAIRS)
def _(n):
    return rounded(predict.covmatrix(_spatial(n), n.preds, "pred.obs"), 9, "cov")


@query("closed_covmatrix_obs_pred", f"SELECT j.pid AS pid_i, i.pid AS pid_j, round({_FLOW}, 9) AS cov FROM v_preds i JOIN v_obs j ON j.y_resp IS NOT NULL LEFT JOIN v_cross p ON p.pid_i = i.pid AND p.pid_j = j.pid", CROSS_PAIRS)
def _(n):
    return rounded(predict.covmatrix(_spatial(n), n.preds, "obs.pred"), 9, "cov")
