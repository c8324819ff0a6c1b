"""Kriging at points and over blocks, with neighbourhoods, terms and intervals; leave-one-out cross validation.

The observed side is factorised once and broadcast with the task; prediction rows are read in batches and never collected.
"""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import families as fam
from ..functions.special import norm_ppf, t_ppf
from . import formula as fm
from . import models

#: The neighbourhood of a prediction set: observed rows of the highest mean covariance, used by default from these sizes on.
NEIGHBOURS, LARGE_N, LARGE_PAIRS = 4000, 10_000, 1e8


def _joined(groups: list[models.Group]) -> models.Group:
    if len(groups) == 1:
        return groups[0]
    table: dict = {}
    for g in groups:
        table |= g.junctions
    cat = lambda k: np.concatenate([getattr(g, k) for g in groups])
    return models.Group(cat("pid"), cat("net"), cat("X"), cat("y"), cat("offset"), cat("size"), cat("xy"), cat("up"), cat("afv"), [k for g in groups for k in g.keys], pd.concat([g.frame for g in groups], ignore_index=True), table)


_pick = models.pick


def _state(m: models.Model, g: models.Group) -> dict[str, Any]:
    """The observed side: inverse covariance, weights of the residuals, and what corrects the variance."""
    s = models.sigma(m.spec, m.theta, g)
    low = np.linalg.cholesky(s)
    inverse = np.linalg.solve(low.T, np.linalg.solve(low, np.eye(len(s))))
    target = g.y
    if m.spec.family != "gaussian":
        st = m.extra["state"]
        where = {int(p): i for i, p in enumerate(np.concatenate([x.pid for x in models.groups_of(m.data)]))}
        w = np.concatenate(st["w"])
        target = w[[where[int(p)] for p in g.pid]]
    resid = target - g.offset - g.X @ m.beta
    total = float(s[0, 0])
    return {"inverse": inverse, "weights": inverse @ resid, "sx": inverse @ g.X, "resid": resid, "target": target, "total": total}


def _new_rows(m: models.Model, new: DataFrame) -> DataFrame:
    f = fm.Formula.parse(m.spec.formula)
    bound = f.bind(new, m.data.bound.levels)
    more = [c for c in m.data.columns if c in new.columns]
    spec = m.spec if m.spec.size in new.columns else replace(m.spec, size=None)
    return models._frame(new, spec, f, bound, more)


#: Cells of a block of covariances between new and observed rows that a task holds at once.
CELLS = 1 << 21


def _cut(batches, width: int):
    """Batches in slices of at most CELLS / width rows."""
    rows = max(1, CELLS // max(width, 1))
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def _quadratic(rows: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """r' inner r for each row r, by one matrix product."""
    return ((rows @ inner) * rows).sum(axis=1)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly: a row of a prediction costs as much as the square of the observed rows, whatever its few bytes say."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pid")


def _junctions(m: models.Model) -> dict:
    if not models.flows(m.spec):
        return {}
    return {(r[0], r[1]): r[2] for r in m.edges.select("netID", "binaryID", "upDist").collect()}


def neighbourhood(m: models.Model, new: DataFrame, k: int = NEIGHBOURS) -> np.ndarray:
    """Positions of the k observed rows with the highest mean covariance to all of new; one set for all."""
    g = _joined(models.groups_of(m.data))
    g.junctions = _junctions(m) if not m.data.junctions else g.junctions
    spec, theta, table = m.spec, m.theta, g.junctions

    def sums(batches):
        total, n = np.zeros(len(g.pid)), 0
        for pdf in _cut(batches, len(g.pid)):
            if len(pdf):
                total += models.sigma_between(spec, theta, models.to_group(pdf, table), g).sum(axis=0)
                n += len(pdf)
        yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    rows = _new_rows(m, new).mapInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy(F.desc("s"), "i").limit(k).select("i").toPandas()
    return np.sort(rows["i"].to_numpy())


SCHEMA = "pid bigint, fit double, se double, lower double, upper double"


def predict(m: models.Model, new: DataFrame, *, interval: str = "none", level: float = 0.95, type: str = "link", neighbours: int | None = None, scale: float | None = None, df: float = math.inf, var_correct: bool = True) -> DataFrame:
    """(pid, fit, se, lower, upper) for each row of new. interval: none, confidence or prediction; type: link or response.

    The offset isn't added to predictions of a linear model. Standard errors stay on the link scale; with scale they are
    multiplied by it and intervals use Student's t with df.
    """
    if interval not in ("none", "confidence", "prediction"):
        raise ValueError("interval is none, confidence or prediction")
    g = _joined(models.groups_of(m.data))
    g.junctions = g.junctions if m.data.junctions else _junctions(m)
    if neighbours is None and (m.n > LARGE_N or m.n * new.count() > LARGE_PAIRS):
        neighbours = NEIGHBOURS
    if neighbours is not None and neighbours < len(g.pid):
        g = models.pick(g, neighbourhood(m, new, neighbours))
    # parts of the observed side without covariance between them are factorised one by one, and their shares add up
    sides = [(x, _state(m, x)) for x in (models.independent(m.spec, g) if m.spec.family == "gaussian" else [g])]
    total = sides[0][1]["total"]
    spec, theta, beta, vcov, table = m.spec, m.theta, m.beta, m.vcov_uncorrected if m.spec.family != "gaussian" else m.vcov, g.junctions
    fix = _latent_covariance(m, g) if m.spec.family != "gaussian" and var_correct else None
    width = len(g.pid)
    z = (t_ppf(0.5 + level / 2, df) if math.isfinite(df) else norm_ppf(0.5 + level / 2)) if scale else norm_ppf(0.5 + level / 2)

    def run(batches):
        for pdf in _cut(batches, width):
            new_g = models.to_group(pdf, table)
            mean = new_g.X @ beta
            h, fit, var = new_g.X.copy(), mean + (new_g.offset if spec.family != "gaussian" else 0.0), np.full(len(mean), total)
            for side, st in sides:
                c0 = models.sigma_between(spec, theta, new_g, side)
                h -= c0 @ st["sx"]
                fit = fit + c0 @ st["weights"]
                var -= _quadratic(c0, st["inverse"])
            var += _quadratic(h, vcov)
            if fix is not None:  # other families have one side
                wts = c0 @ st["inverse"] + h @ vcov @ st["sx"].T
                var = var + _quadratic(wts, fix)
            if interval == "confidence":
                fit, var = mean + (new_g.offset if spec.family != "gaussian" else 0.0), _quadratic(new_g.X, vcov)
            se = np.sqrt(np.maximum(var, 0.0)) * (scale or 1.0)
            low, high = (fit - z * se, fit + z * se) if interval != "none" else (np.full(len(fit), np.nan), np.full(len(fit), np.nan))
            if spec.family != "gaussian" and type == "response":
                fit, low, high = (fam.inverse_link(spec.family, v, new_g.size) for v in (fit, low, high))
            yield pd.DataFrame({"pid": new_g.pid, "fit": fit, "se": se, "lower": low, "upper": high})

    return _spread(_new_rows(m, new)).mapInPandas(run, SCHEMA).select("pid", "fit", "se", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("lower", "upper")])


def _latent_covariance(m: models.Model, g: models.Group) -> np.ndarray:
    """(-H)^-1 of the rows of g."""
    full = models._minus_h_inverse(m.extra["state"])
    where = {int(p): i for i, p in enumerate(np.concatenate([x.pid for x in models.groups_of(m.data)]))}
    at = [where[int(p)] for p in g.pid]
    return full[np.ix_(at, at)]


def predict_block(m: models.Model, new: DataFrame, *, level: float = 0.95) -> DataFrame:
    """(fit, se, lower, upper) of the mean over all rows of new. Sums over rows and over pairs of batches are taken where the rows are."""
    g = _joined(models.groups_of(m.data))
    g.junctions = g.junctions if m.data.junctions else _junctions(m)
    st = _state(m, g)
    spec, theta, table = m.spec, m.theta, _junctions(m)  # new rows meet each other too
    rows = _new_rows(m, new)
    n = rows.count()
    blocks = max(1, -(-n // 1000))

    def sums(batches):
        for pdf in _cut(batches, len(g.pid)):
            if len(pdf):
                a = models.to_group(pdf, table)
                yield pd.DataFrame({"x": [a.X.sum(axis=0).tolist()], "c": [models.sigma_between(spec, theta, a, g).sum(axis=0).tolist()]})

    found = rows.mapInPandas(sums, "x array<double>, c array<double>").toPandas()
    x0, c0 = np.sum(np.stack(found["x"]), axis=0) / n, np.sum(np.stack(found["c"]), axis=0) / n
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = models.to_group(pdf[pdf["own"] == i], table), models.to_group(pdf[pdf["own"] == j], table) if i != j else None
        cov = models.sigma(spec, theta, a).sum() if b is None else 2 * models.sigma_between(spec, theta, a, b).sum()
        return pd.DataFrame({"s": [float(cov)]})

    total = pairs.drop("other").groupBy("i", "j").applyInPandas(between, "s double").agg(F.sum("s")).first()[0] / n**2
    h = x0 - c0 @ st["sx"]
    fit = float(x0 @ m.beta + c0 @ st["weights"])
    se = math.sqrt(max(total - c0 @ st["inverse"] @ c0 + h @ m.vcov @ h, 0.0))
    z = norm_ppf(0.5 + level / 2)
    return new.sparkSession.createDataFrame([(fit, se, fit - z * se, fit + z * se)], "fit double, se double, lower double, upper double")


def predict_terms(m: models.Model, new: DataFrame) -> DataFrame:
    """pid and what each term adds to the prediction, centred at the means of the fitted rows; `constant` is the rest."""
    X = np.vstack([g.X for g in models.groups_of(m.data)])
    mean = X.mean(axis=0) if -1 in m.data.bound.term_of else np.zeros(X.shape[1])
    f = fm.Formula.parse(m.spec.formula)
    x = f.bind(new, m.data.bound.levels).column
    cols = []
    for k, term in enumerate(m.data.bound.terms):
        own = [i for i, t in enumerate(m.data.bound.term_of) if t == k]
        cols.append(sum(((F.get(x, i) - float(mean[i])) * float(m.beta[i]) for i in own), F.lit(0.0)).alias(term))
    return new.select("pid", *cols, F.lit(float(mean @ m.beta)).alias("constant"))


def loocv(m: models.Model) -> DataFrame:
    """(pid, y, pred, se): each row predicted from the others with the covariance as fitted and new coefficients.

    The inverse without a row is a rank-one downdate of the whole inverse. Rows are dealt out; the inverse goes along.
    """
    g = _joined(models.groups_of(m.data))
    g.junctions = g.junctions if m.data.junctions else _junctions(m)
    st = _state(m, g)
    s, cov, X, target = st["inverse"], models.sigma(m.spec, m.theta, g), g.X, st["target"] - g.offset
    family = m.spec.family
    h = _latent_covariance(m, g) if family != "gaussian" else None

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["i"]:
                o = np.delete(np.arange(len(target)), i)
                inv = s[np.ix_(o, o)] - np.outer(s[o, i], s[i, o]) / s[i, i]
                c = cov[i, o]
                sx = inv @ X[o]
                v = np.linalg.inv(X[o].T @ sx)
                beta = v @ sx.T @ target[o]
                w = c @ inv
                q = X[i] - c @ sx
                var = cov[i, i] - w @ c + q @ v @ q
                if h is not None:
                    ho = h[np.ix_(o, o)] - np.outer(h[o, i], h[i, o]) / h[i, i]
                    k = w + q @ v @ sx.T
                    var += k @ ho @ k
                pred = X[i] @ beta + w @ (target[o] - X[o] @ beta) + g.offset[i]
                out.append((int(g.pid[i]), float(g.y[i]), float(pred), math.sqrt(max(var, 0.0))))
            yield pd.DataFrame(out, columns=["pid", "y", "pred", "se"])

    parts = max(1, min(64, len(target) // 16))
    rows = m.obs.sparkSession.range(0, len(target), 1, parts).select(F.col("id").cast("int").alias("i"))
    return rows.mapInPandas(run, "pid bigint, y double, pred double, se double")


def covmatrix(m: models.Model, new: DataFrame | None = None, kind: str = "obs.obs") -> DataFrame:
    """(pid_i, pid_j, cov) of the fitted covariance: obs.obs, pred.obs, obs.pred or pred.pred."""
    g = _joined(models.groups_of(m.data))
    g.junctions = g.junctions if m.data.junctions else _junctions(m)
    spec, theta, table = m.spec, m.theta, g.junctions

    def long(i, j, cov):
        return pd.DataFrame({"pid_i": np.repeat(i.pid, len(j.pid)), "pid_j": np.tile(j.pid, len(i.pid)), "cov": cov.reshape(-1)})

    schema = "pid_i bigint, pid_j bigint, cov double"
    if kind == "obs.obs":
        return m.obs.sparkSession.createDataFrame(long(g, g, models.sigma(spec, theta, g)), schema)
    rows = _new_rows(m, new)
    if kind == "pred.pred":
        own = models.to_group(rows.toPandas(), _junctions(m))  # one prediction set, as its block covariance needs it
        return m.obs.sparkSession.createDataFrame(long(own, own, models.sigma(spec, theta, own)), schema)

    def run(batches):
        for pdf in _cut(batches, len(g.pid)):
            if len(pdf):
                own = models.to_group(pdf, table)
                cov = models.sigma_between(spec, theta, own, g)
                yield long(own, g, cov) if kind == "pred.obs" else long(g, own, cov.T)

    return rows.mapInPandas(run, schema)
