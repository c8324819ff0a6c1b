"""Linear and generalized linear models with stream network covariance, fitted by (restricted) maximum likelihood.

Rows are grouped by a local index (one group if the fit is exact). A group's design, response and pair features are gathered once
into one Arrow batch per group and cached; an evaluation of the objective broadcasts the parameters, factorises each group's
covariance where the group is, and sums small partial products. Exact fits, of one group, are evaluated on the driver, since a
job per evaluation would cost more than the factorisation. Only parameters, coefficients and p x p matrices reach the driver
otherwise.
"""

from __future__ import annotations

import math
import pickle
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import families as fam
from ..functions import kernels
from ..functions.special import chi2_sf, norm_cdf, norm_ppf
from . import formula as fm
from . import search

#: Rows up to which an exact fit is advised, and the rows of a local group.
EXACT_LM, EXACT_GLM, GROUP_ROWS = 5000, 3000, 200


@dataclass(frozen=True)
class Spec:
    """What is to be fitted."""

    formula: str
    types: dict[str, str]  # of tailup, taildown, euclid, nugget
    family: str = "gaussian"
    estmethod: str = "reml"
    anisotropy: bool = False
    random: str | None = None
    partition: str | None = None
    size: str | None = None  # column of binomial trials


@dataclass
class Group:
    """Rows of one group as arrays. The pair features of a pair stand at [i, j]."""

    pid: np.ndarray
    net: np.ndarray
    X: np.ndarray
    y: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    xy: np.ndarray
    up: np.ndarray
    afv: np.ndarray
    keys: list[str]
    frame: pd.DataFrame  # random effect, slope and partition columns
    junctions: dict


def dump(g: Group) -> bytes:
    return pickle.dumps(vars(g))


def load(blob: bytes) -> Group:
    return Group(**pickle.loads(bytes(blob)))


def gather(sites: pd.DataFrame, design: np.ndarray, y: np.ndarray, offset: np.ndarray, size: np.ndarray, junctions: dict) -> Group:
    return Group(sites["pid"].to_numpy(), sites["netID"].to_numpy(), design, y, offset, size, sites[["x", "y"]].to_numpy(float), sites["upDist"].to_numpy(float), sites["afv"].astype(float).to_numpy(), sites["binaryID"].tolist(), sites, junctions)


def _digits(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The digits of keys as a matrix, 0 beyond their ends, and their lengths."""
    size = np.array([len(k) for k in keys])
    wide = np.array(keys, dtype=f"S{max(int(size.max()), 1)}")
    return wide.view(np.uint8).reshape(len(keys), -1), size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of all rows of a and all rows of b; ends don't match."""
    out = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones(out.shape, bool)
    for k in range(min(a.shape[1], b.shape[1])):
        alive &= (a[:, k, None] == b[None, :, k]) & (a[:, k, None] > 0)
        if not alive.any():
            break
        out += alive
    return out


def pair_features(i: Group, j: Group) -> kernels.Pair:
    """Features of all pairs of rows of i and rows of j; junctions maps (network, key) to the distance of the edge's upper node.

    Prefixes are compared once for each pair of distinct keys of a network, digit by digit over all of them.
    """
    same = i.net[:, None] == j.net[None, :]
    d_ij, d_ji = np.zeros(same.shape), np.zeros(same.shape)
    own, other = np.array(i.keys, dtype=object), np.array(j.keys, dtype=object)
    for net in np.intersect1d(i.net, j.net).tolist():
        rows, cols = np.flatnonzero(i.net == net), np.flatnonzero(j.net == net)
        keys, row_key = np.unique(own[rows], return_inverse=True)
        ends, col_key = np.unique(other[cols], return_inverse=True)
        (a, a_size), (b, b_size) = _digits(keys.tolist()), _digits(ends.tolist())
        n = _common(a, b)
        apart = n < np.minimum(a_size[:, None], b_size[None, :])
        at = np.full(n.shape, -np.inf)  # upper node of the junction, where neither key is a prefix of the other
        k, _ = np.nonzero(apart)
        needed, place = np.unique(k * (a.shape[1] + 1) + n[apart], return_inverse=True)
        found = [i.junctions[net, keys[x // (a.shape[1] + 1)][: x % (a.shape[1] + 1)]] for x in needed.tolist()]
        at[apart] = np.array(found, float)[place]
        at = at[np.ix_(row_key, col_key)]
        up, down = i.up[rows][:, None], j.up[cols][None, :]
        d_ij[np.ix_(rows, cols)] = np.maximum(up - np.where(at == -np.inf, down, at), 0)
        d_ji[np.ix_(rows, cols)] = np.maximum(down - np.where(at == -np.inf, up, at), 0)
    a, b = np.maximum(d_ij, d_ji), np.minimum(d_ij, d_ji)
    high = np.maximum(i.afv[:, None], j.afv[None, :])
    w = np.sqrt(np.minimum(i.afv[:, None], j.afv[None, :]) / np.where(high > 0, high, 1)) * ((b == 0) & same)
    return kernels.Pair(h=d_ij + d_ji, a=a, b=b, w=w, mask=same.astype(float), e=None)


def euclid(i: Group, j: Group, theta: dict[str, float]) -> np.ndarray:
    def turned(xy):
        c, s = math.cos(theta.get("rotate", 0.0)), math.sin(theta.get("rotate", 0.0))
        return np.stack([c * xy[:, 0] + s * xy[:, 1], (c * xy[:, 1] - s * xy[:, 0]) / theta.get("scale", 1.0)], axis=1)

    p, q = turned(i.xy), turned(j.xy)
    return np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))


def parts(spec: Spec, theta: dict[str, float], i: Group, j: Group, pair: kernels.Pair) -> dict[str, np.ndarray]:
    """The covariance of each component between rows of i and of j, without the nugget."""
    out = {}
    for c in search.COMPONENTS:
        kind = spec.types.get(c, "none")
        if kind != "none":
            p = replace(pair, e=euclid(i, j, theta)) if c == "euclid" else pair
            out[c] = np.asarray(kernels.covariance(c, kind, p, theta[f"{c}_de"], theta[f"{c}_range"], kernels.InArrays))
    for t in fm.random_terms(spec.random):
        out[f"random:{t.name}"] = theta[f"random:{t.name}"] * t.matrix(i.frame, j.frame)
    return out


def _partitioned(spec: Spec, cov: np.ndarray, i: Group, j: Group) -> np.ndarray:
    if not spec.partition:
        return cov
    return cov * (i.frame[spec.partition].to_numpy()[:, None] == j.frame[spec.partition].to_numpy()[None, :])


def sigma(spec: Spec, theta: dict[str, float], g: Group, pair: kernels.Pair | None = None) -> np.ndarray:
    """The covariance of a group's rows, nugget included."""
    found = parts(spec, theta, g, g, pair or needed_features(spec, g, g))
    cov = sum(found.values(), np.zeros((len(g.y), len(g.y))))
    de = sum(theta.get(f"{c}_de", 0.0) for c in search.COMPONENTS)
    diagonal = kernels.nugget_diagonal(spec.types.get("nugget", "nugget"), theta.get("nugget", 0.0), de, 1e-4 if spec.family != "gaussian" else 0.0)
    return _partitioned(spec, cov + diagonal * np.eye(len(g.y)), g, g)


def sigma_between(spec: Spec, theta: dict[str, float], i: Group, j: Group) -> np.ndarray:
    if not any(spec.types.get(c, "none") != "none" for c in search.COMPONENTS):
        return np.zeros((len(i.pid), len(j.pid)))
    found = parts(spec, theta, i, j, needed_features(spec, i, j))
    return _partitioned(spec, sum(found.values(), np.zeros((len(i.pid), len(j.pid)))), i, j)


def pick(g: Group, at: np.ndarray) -> Group:
    """The rows of a group at some positions."""
    return Group(g.pid[at], g.net[at], g.X[at], g.y[at], g.offset[at], g.size[at], g.xy[at], g.up[at], g.afv[at], [g.keys[i] for i in at], g.frame.iloc[at].reset_index(drop=True), g.junctions)


def flows(spec: Spec) -> bool:
    return any(spec.types.get(c, "none") != "none" for c in ("tailup", "taildown"))


def needed_features(spec: Spec, i: Group, j: Group) -> kernels.Pair:
    """The features of pairs, none without a component of water distance."""
    return pair_features(i, j) if flows(spec) else kernels.Pair(h=np.zeros(1))


def independent(spec: Spec, g: Group) -> list[Group]:
    """The rows of a group in parts without covariance between them: the networks, unless Euclidean distance or levels of random
    effects join these. Sums over the parts are those of the whole."""
    if spec.types.get("euclid", "none") != "none" or spec.random or not flows(spec):
        return [g]
    return [pick(g, np.flatnonzero(g.net == net)) for net in np.unique(g.net).tolist()]


# --- partial products -----------------------------------------------------------------------------------------------


def gaussian_partial(spec: Spec, theta: dict[str, float], g: Group, pair: kernels.Pair | None = None) -> dict[str, Any]:
    """What a group adds to the sums of a Gaussian evaluation."""
    if not any(spec.types.get(c, "none") != "none" for c in search.COMPONENTS) and (made := _levels_partial(spec, theta, g)):
        return made
    low = np.linalg.cholesky(sigma(spec, theta, g, pair))
    a = np.linalg.solve(low, np.column_stack([g.X, g.y - g.offset]))
    x, v = a[:, :-1], a[:, -1]
    return {"xx": x.T @ x, "xy": x.T @ v, "yy": float(v @ v), "logdet": 2 * float(np.log(np.diag(low)).sum()), "n": len(v)}


def _levels_partial(spec: Spec, theta: dict[str, float], g: Group) -> dict[str, Any] | None:
    """The same without spatial components: V = s I + Z Z', with a column of Z, times its root variance, for each level of a random
    effect, so V^-1 = (I - Z (s I + Z'Z)^-1 Z') / s. No matrix of rows by rows is made, and Z itself only as sums by level.
    None where this doesn't hold or doesn't pay: without a nugget, or with as many levels as rows."""
    de = sum(theta.get(f"{c}_de", 0.0) for c in search.COMPONENTS)
    s = kernels.nugget_diagonal(spec.types.get("nugget", "nugget"), theta.get("nugget", 0.0), de, 1e-4 if spec.family != "gaussian" else 0.0)
    a = np.column_stack([g.X, g.y - g.offset])
    places, roots, q = [], [], 0
    for t in fm.random_terms(spec.random):
        level = pd.MultiIndex.from_frame(g.frame[[*t.group, *([spec.partition] if spec.partition else [])]].astype(str))
        code = pd.factorize(level)[0]
        places.append(code + q)
        roots.append(math.sqrt(theta[f"random:{t.name}"]) * (g.frame[t.slope].to_numpy(float) if t.slope else np.ones(len(a))))
        q += int(code.max()) + 1
    if s <= 0 or q >= len(a):
        return None
    za, zz = np.zeros((q, a.shape[1])), np.zeros((q, q))
    for i, x in zip(places, roots, strict=True):
        np.add.at(za, i, x[:, None] * a)
        for j, y in zip(places, roots, strict=True):
            np.add.at(zz, (i, j), x * y)
    low = np.linalg.cholesky(s * np.eye(q) + zz)
    part = np.linalg.solve(low, za)
    inner = (a.T @ a - part.T @ part) / s
    logdet = (len(a) - q) * math.log(s) + 2 * float(np.log(np.diag(low)).sum())
    return {"xx": inner[:-1, :-1], "xy": inner[:-1, -1], "yy": float(inner[-1, -1]), "logdet": logdet, "n": len(a)}


def add(partials: list[dict[str, Any]]) -> dict[str, Any]:
    return {k: sum((p[k] for p in partials[1:]), partials[0][k]) for k in partials[0]}


def gaussian_value(total: dict[str, Any], reml: bool) -> float:
    """-2 log likelihood from the sums."""
    beta = np.linalg.solve(total["xx"], total["xy"])
    n, p = total["n"], len(beta)
    value = total["logdet"] + total["yy"] - float(beta @ total["xy"]) + (n - (p if reml else 0)) * math.log(2 * math.pi)
    return value + (np.linalg.slogdet(total["xx"])[1] if reml else 0.0)


def laplace(spec: Spec, theta: dict[str, float], groups: list[Group], pairs: list[kernels.Pair] | None = None) -> dict[str, Any]:
    """The Laplace approximation: Newton steps for the latent values of all groups together, then its value.

    P = S^-1 - S^-1 X C X' S^-1 couples the groups only through the p x p matrix C, so a step solves each group by itself and
    then corrects by a p x p system (Woodbury).
    """
    phi = theta.get("dispersion", 1.0)
    inverse, logdet = [], 0.0
    for k, g in enumerate(groups):
        s = sigma(spec, theta, g, pairs[k] if pairs else None)
        low = np.linalg.cholesky(s)
        logdet += 2 * float(np.log(np.diag(low)).sum())
        inverse.append(np.linalg.solve(low.T, np.linalg.solve(low, np.eye(len(s)))))
    sx = [i @ g.X for i, g in zip(inverse, groups, strict=True)]
    xx = sum(g.X.T @ s for g, s in zip(groups, sx, strict=True))
    c = np.linalg.inv(xx)
    w = [fam.start(spec.family, g.y) for g in groups]

    def gradient(w):
        xw = sum(s.T @ (wi - g.offset) for s, wi, g in zip(sx, w, groups, strict=True))
        return [fam.score(spec.family, wi, g.y, g.size, phi) - i @ (wi - g.offset) + s @ (c @ xw) for g, i, s, wi in zip(groups, inverse, sx, w, strict=True)]

    def largest(parts):
        top = max(float(np.abs(x).max()) for x in parts)
        return top if math.isfinite(top) else math.inf

    grad, converged = gradient(w), False
    for _ in range(50):
        if largest(grad) == math.inf:
            raise np.linalg.LinAlgError("the scores are not finite")
        hess = [i - np.diag(fam.curvature(spec.family, wi, g.y, g.size, phi)) for i, wi, g in zip(inverse, w, groups, strict=True)]  # S^-1 - D
        hx = [np.linalg.solve(h, np.column_stack([s, gr])) for h, s, gr in zip(hess, sx, grad, strict=True)]
        inner = xx - sum(s.T @ h[:, :-1] for s, h in zip(sx, hx, strict=True))  # of -H = S^-1 - D - SX C XS
        right = sum(s.T @ h[:, -1] for s, h in zip(sx, hx, strict=True))
        fix = np.linalg.solve(inner, right)
        step = [h[:, -1] + h[:, :-1] @ fix for h in hx]
        converged = largest(step) < 1e-4
        for pace in (1.0, 0.1, 0.01, 0.001):  # a step that overshoots is shortened
            trial = [wi + pace * s for wi, s in zip(w, step, strict=True)]
            after = gradient(trial)
            if largest(after) <= largest(grad) or converged:
                break
        w, grad = trial, after
        if converged:
            break
    hess = [i - np.diag(fam.curvature(spec.family, wi, g.y, g.size, phi)) for i, wi, g in zip(inverse, w, groups, strict=True)]
    hx = [np.linalg.solve(h, s) for h, s in zip(hess, sx, strict=True)]
    inner = xx - sum(s.T @ h for s, h in zip(sx, hx, strict=True))
    hdet = sum(np.linalg.slogdet(h)[1] for h in hess) + np.linalg.slogdet(inner)[1] - np.linalg.slogdet(xx)[1]
    beta = c @ sum(s.T @ (wi - g.offset) for s, wi, g in zip(sx, w, groups, strict=True))
    resid = [wi - g.offset - g.X @ beta for wi, g in zip(w, groups, strict=True)]
    quad = sum(float(r @ i @ r) for r, i in zip(resid, inverse, strict=True))
    density = sum(float(fam.log_density(spec.family, wi, g.y, g.size, phi).sum()) for wi, g in zip(w, groups, strict=True))
    n, p = sum(len(g.y) for g in groups), len(beta)
    reml = spec.estmethod == "reml"
    value = -2 * density + hdet + logdet + quad + (np.linalg.slogdet(xx)[1] if reml else 0.0) + (n - (p if reml else 0)) * math.log(2 * math.pi)
    return {"value": value, "beta": beta, "C": c, "w": w, "inverse": inverse, "hess": hess, "hx": hx, "inner": inner, "sx": sx, "xx": xx, "resid": resid, "converged": converged}


# --- fits -------------------------------------------------------------------------------------------------------------


@dataclass
class Data:
    spec: Spec
    bound: fm.Bound
    columns: list[str]
    junctions: dict
    groups: list[Group] | None = None  # of exact and driver-side fits
    grouped: DataFrame | None = None  # (index, blob) of local fits
    n: int = 0
    index: str | None = None  # the column of local groups


def _frame(rows: DataFrame, spec: Spec, f: fm.Formula, bound: fm.Bound, more: list[str]) -> DataFrame:
    size = F.col(spec.size).cast("double") if spec.size else F.lit(1.0)
    offset = fm._expression(f.offset).cast("double") if f.offset else F.lit(0.0)
    response = F.col(f.response).cast("double") if f.response in rows.columns else F.lit(None).cast("double")
    return rows.select("pid", "netID", "locID", "binaryID", "upDist", "afv", "x", "y", *[F.col(c) for c in more], bound.column.alias("__x"), response.alias("__y"), offset.alias("__offset"), size.alias("__size"))


def to_group(pdf: pd.DataFrame, junctions: dict) -> Group:
    pdf = pdf.sort_values(["netID", "pid"], ignore_index=True)
    return gather(pdf, np.stack(pdf["__x"].to_numpy()).astype(float), pdf["__y"].to_numpy(float), pdf["__offset"].to_numpy(float), pdf["__size"].to_numpy(float), junctions)


def _prefixes(frame: DataFrame, *by: str) -> DataFrame:
    """The keys of all edges on the paths of the rows: their junctions with any other site are among them."""
    keys = frame.select(*by, "netID", "binaryID").distinct()
    return keys.select(*by, "netID", F.explode(F.transform(F.sequence(F.lit(1), F.length("binaryID")), lambda k: F.substr(F.col("binaryID"), F.lit(1), k))).alias("binaryID")).distinct()


def _own_junctions(frame: DataFrame, edges: DataFrame, needed: bool) -> dict:
    if not needed:
        return {}
    rows = _prefixes(frame).join(edges.select("netID", "binaryID", "upDist"), ["netID", "binaryID"]).toPandas()
    return dict(zip(zip(rows["netID"].tolist(), rows["binaryID"].tolist(), strict=True), rows["upDist"].tolist(), strict=True))


def prepare(spec: Spec, obs: DataFrame, edges: DataFrame, index: str | None = None) -> Data:
    """Checks the rows and gathers them. Rows without a response are for prediction and take no part here."""
    f = fm.Formula.parse(spec.formula)
    seen = obs.where(F.col(f.response).isNotNull())
    terms = fm.random_terms(spec.random)
    more = sorted({c for t in terms for c in (*t.group, *([t.slope] if t.slope else []))} | ({spec.partition} if spec.partition else set()) | ({index} if index else set()))
    bound = f.bind(seen)
    frame = _frame(seen, spec, f, bound, more)
    bad = frame.agg(F.count("*").alias("n"), F.count_if(F.exists("__x", lambda x: x.isNull())).alias("holes"), F.var_samp("__y").alias("v")).first()
    if bad["holes"]:
        raise ValueError(f"{bad['holes']} rows have no value of a predictor")
    if bad["n"] <= len(bound.names):
        raise ValueError("there are no more rows than columns of the design")
    if not bad["v"]:
        raise ValueError("the response does not vary")
    if spec.types.get("tailup", "none") != "none" and "afv" not in obs.columns:
        raise ValueError("a tail-up model needs an additive column")
    junctions = _own_junctions(frame, edges, flows(spec)) if index is None else {}
    data = Data(spec, bound, more, junctions, n=bad["n"], index=index)
    if index is None:
        data.groups = [to_group(frame.toPandas(), junctions)]
        if spec.family != "gaussian":
            fam.check_response(spec.family, data.groups[0].y, data.groups[0].size)
        return data
    # the junctions of a group are those of its own keys: prefixes of them, looked up by a join
    prefixes = _prefixes(frame, index)
    met = prefixes.join(edges.select("netID", "binaryID", "upDist"), ["netID", "binaryID"]).groupBy(index).agg(F.collect_list(F.struct("netID", "binaryID", "upDist")).alias("junctions"))
    rows = frame.groupBy(index).agg(F.collect_list(F.struct(*[F.col(c) for c in frame.columns])).alias("rows"))

    def pack(batches):
        for pdf in batches:
            blobs = []
            for own, at in zip(pdf["rows"], pdf["junctions"], strict=True):
                table = {(r["netID"], r["binaryID"]): r["upDist"] for r in at}
                blobs.append(dump(to_group(pd.DataFrame(list(own)), table)))
            yield pd.DataFrame({"index": pdf[index].astype(str), "blob": blobs})

    data.grouped = rows.join(met, index).mapInPandas(pack, "index string, blob binary").cache()
    return data


def evaluate(data: Data, theta: dict[str, float]) -> float:
    """The objective at theta."""
    spec = data.spec
    reml = spec.estmethod == "reml"
    if spec.family != "gaussian":
        return laplace(spec, theta, groups_of(data), list(_pairs(data)))["value"]
    return gaussian_value(gaussian_total(data, theta), reml)


def groups_of(data: Data) -> list[Group]:
    if data.groups is None:
        data.groups = [load(r[0]) for r in data.grouped.orderBy("index").select("blob").collect()]
    return data.groups


def parts_of(data: Data) -> list[Group]:
    """The groups of a fit on the driver, those of a Gaussian one cut into independent parts."""
    if not hasattr(data, "_parts"):
        groups = groups_of(data)
        data._parts = [x for g in groups for x in independent(data.spec, g)] if data.spec.family == "gaussian" else groups
    return data._parts


#: Pairs of rows up to which their features are kept on the driver between evaluations; beyond, they are made anew for each.
KEPT_PAIRS = 4_000_000


def _pairs(data: Data):
    """The pair features of each part, one after the other; none are needed without a component of water distance."""
    if not flows(data.spec):
        return (kernels.Pair(h=np.zeros(1)) for _ in parts_of(data))
    if sum(len(g.pid) ** 2 for g in parts_of(data)) > KEPT_PAIRS:
        return (pair_features(g, g) for g in parts_of(data))
    if not hasattr(data, "_kept"):
        data._kept = [pair_features(g, g) for g in parts_of(data)]
    return data._kept


def gaussian_total(data: Data, theta: dict[str, float]) -> dict[str, Any]:
    if data.grouped is None:
        return add([gaussian_partial(data.spec, theta, g, p) for g, p in zip(parts_of(data), _pairs(data), strict=True)])
    spec = data.spec

    def run(batches):
        for pdf in batches:
            made = add([gaussian_partial(spec, theta, load(b)) for b in pdf["blob"]]) if len(pdf) else None
            if made:
                yield pd.DataFrame({"p": [pickle.dumps(made)]})

    return add([pickle.loads(bytes(r[0])) for r in data.grouped.mapInPandas(run, "p binary").collect()])


def local_index(sites: DataFrame, method: str = "kmeans", rows: int = GROUP_ROWS, seed: int = 1, out: str = "local_index") -> DataFrame:
    """sites with a group for each row: clusters of coordinates, or a random deal into groups of about `rows`."""
    n = sites.count()
    k = max(1, math.ceil(n / rows))
    if method == "random":
        return sites.withColumn(out, F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(k)).cast("int"))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x", "y"], outputCol="__v").transform(sites)
    return KMeans(k=k, maxIter=30, seed=seed, featuresCol="__v", predictionCol=out).fit(v).transform(v).drop("__v")


def _start(data: Data, known: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """The best candidate of the start grid, and the parameters that are free."""
    spec = data.spec
    groups = groups_of(data) if data.groups is not None or data.grouped is None else None
    if groups is not None:
        X, y = np.vstack([g.X for g in groups]), np.concatenate([g.y - g.offset for g in groups])
        xy = np.vstack([g.xy for g in groups])
        y = np.log(y + 1) if spec.family != "gaussian" else y
        r = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
        s2 = float(r @ r) / max(len(y) - X.shape[1], 1)
        far_h = max((float(p.h.max()) for p in _pairs(data)), default=1.0) or 1.0
    else:
        def stats(batches):
            for pdf in batches:
                for b in pdf["blob"]:
                    g = load(b)
                    yy = g.y - g.offset
                    yield pd.DataFrame({"p": [pickle.dumps((g.X.T @ g.X, g.X.T @ yy, yy @ yy, len(yy), g.xy.min(axis=0), g.xy.max(axis=0)))]})
        rows = [pickle.loads(bytes(r[0])) for r in data.grouped.mapInPandas(stats, "p binary").collect()]
        xx, xv, yy, n = (sum(r[k] for r in rows) for k in range(4))
        s2 = float(yy - xv @ np.linalg.solve(xx, xv)) / max(n - len(xv), 1)
        xy = np.stack([np.min([r[4] for r in rows], axis=0), np.max([r[5] for r in rows], axis=0)])
        far_h = float(np.linalg.norm(xy[1] - xy[0])) or 1.0
    far_e = float(np.linalg.norm(xy.max(axis=0) - xy.min(axis=0))) or 1.0
    if spec.family != "gaussian":
        s2 = max(s2, 0.05)
    random = tuple(t.name for t in fm.random_terms(spec.random))
    grid = search.start_grid(spec.types, s2, far_h, far_e, spec.anisotropy, random)
    if spec.family not in ("gaussian", *fam.FIXED):
        grid = [g | {"dispersion": d} for g in grid for d in (1.0, 100.0)]
    elif spec.family in fam.FIXED:
        grid = [g | {"dispersion": 1.0} for g in grid]
    if spec.types.get("nugget", "nugget") == "none":
        grid = [g | {"nugget": 0.0} for g in grid]
    seen, out = set(), []
    for g in grid:
        g = g | {k: v for k, v in known.items() if k in g}
        if tuple(sorted(g.items())) not in seen:
            seen.add(tuple(sorted(g.items())))
            out.append(g)
    fixed = set(known) | ({"rotate", "scale"} if not spec.anisotropy else set()) | ({"dispersion"} if spec.family in fam.FIXED else set()) | ({"nugget"} if spec.types.get("nugget", "nugget") == "none" else set())
    free = [k for k in out[0] if k not in fixed]
    if not free:
        return out[0], free

    def value(g):
        try:
            v = evaluate(data, g)
        except np.linalg.LinAlgError:
            return math.inf
        return v if np.isfinite(v) else math.inf

    return min(out, key=value), free


@dataclass
class Model:
    spec: Spec
    data: Data
    theta: dict[str, float]
    free: list[str]
    value: float
    beta: np.ndarray
    vcov: np.ndarray
    obs: DataFrame
    edges: DataFrame
    vcov_uncorrected: np.ndarray | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    # small facts
    @property
    def names(self) -> list[str]:
        return self.data.bound.names

    @property
    def n(self) -> int:
        return self.data.n

    @property
    def npar(self) -> int:
        return len(self.free)

    def loglik(self) -> float:
        return -self.value / 2

    def aic_parameters(self) -> int:
        return self.npar + (len(self.beta) if self.spec.estmethod == "ml" else 0)

    def aic(self) -> float:
        return self.value + 2 * self.aic_parameters()

    def aicc(self) -> float:
        k = self.aic_parameters()
        return self.value + 2 * self.n * k / (self.n - k - 1)

    def bic(self) -> float:
        return self.value + math.log(self.n) * self.aic_parameters()

    def coef(self, kind: str = "fixed") -> dict[str, float]:
        if kind == "fixed":
            return dict(zip(self.names, self.beta.tolist(), strict=True))
        if kind == "all":
            return dict(self.theta)
        if kind not in (*search.COMPONENTS, "nugget", "dispersion", "randcov"):
            raise ValueError(f"no such kind of coefficients: {kind}")
        mark = "random:" if kind == "randcov" else kind
        return {k: v for k, v in self.theta.items() if k.startswith(mark) or kind == "euclid" and k in ("rotate", "scale")}

    def confint(self, level: float = 0.95) -> dict[str, tuple[float, float]]:
        z = norm_ppf(0.5 + level / 2)
        se = np.sqrt(np.diag(self.vcov))
        return {k: (b - z * s, b + z * s) for k, b, s in zip(self.names, self.beta.tolist(), se.tolist(), strict=True)}


def turns(spec: Spec, known: dict[str, float]) -> bool:
    """Whether Euclidean distance is turned and scaled: never without a Euclidean component; if asked for, unless rotation 0 and
    scale 1 are both given; if not asked for, when another rotation or scale is given."""
    if spec.types.get("euclid", "none") == "none":
        return False
    plain = {"rotate": 0.0, "scale": 1.0}
    given = {k: known[k] for k in plain if k in known}
    return given != plain if spec.anisotropy else any(v != plain[k] for k, v in given.items())


def fit(spec: Spec, obs: DataFrame, edges: DataFrame, *, known: dict[str, float] | None = None, index: str | None = None, var_adjust: str | None = None) -> Model:
    """Fits a model. known: parameters that are given; if all are, this is one evaluation. index: a column of local groups."""
    if spec.estmethod not in ("reml", "ml"):
        raise ValueError("estmethod is reml or ml")
    for c, kind in spec.types.items():
        if kind not in kernels.TYPES[c]:
            raise ValueError(f"{c} has no type {kind}; it has {', '.join(kernels.TYPES[c])}")
    if spec.family == "gaussian" and all(spec.types.get(c, "none") == "none" for c in (*search.COMPONENTS, "nugget")) and "nugget" in spec.types:
        raise ValueError("a model needs at least one component")
    spec = replace(spec, anisotropy=turns(spec, known or {}))
    data = prepare(spec, obs, edges, index)
    if spec.family != "gaussian" and index is not None:
        fam.check_response(spec.family, *(np.concatenate(x) for x in zip(*((g.y, g.size) for g in groups_of(data)), strict=True)))
    start, free = _start(data, known or {})
    theta, value, calls = search.minimise(lambda t: evaluate(data, t), start, free)
    if spec.anisotropy and "rotate" in free:
        other = theta | {"rotate": math.pi - theta["rotate"]}
        v = evaluate(data, other)
        theta, value = (other, v) if v < value else (theta, value)
    if spec.family == "gaussian":
        total = gaussian_total(data, theta)
        c = np.linalg.inv(total["xx"])
        model = Model(spec, data, theta, free, value, c @ total["xy"], c, obs, edges, extra={"calls": calls})
        if index is not None:
            mode = var_adjust or ("theoretical" if data.n <= 100_000 else "none")
            model.vcov_uncorrected, model.vcov = c, adjusted_vcov(model, c, mode)
        return model
    state = laplace(spec, theta, groups_of(data), list(_pairs(data)))
    if not state["converged"]:
        warnings.warn("the latent values did not settle within 50 steps", stacklevel=2)
    c, b = state["C"], np.hstack([state["C"] @ s.T for s in state["sx"]])
    model = Model(spec, data, theta, free, value, state["beta"], c, obs, edges, c, {"calls": calls, "state": state})
    model.vcov = c + b @ _minus_h_inverse(state) @ b.T
    return model


def _minus_h_inverse(state: dict[str, Any]) -> np.ndarray:
    """(-H)^-1 of all rows, -H = S^-1 - D - SX C XS."""
    blocks = [np.linalg.inv(h) for h in state["hess"]]
    n = sum(len(b) for b in blocks)
    out = np.zeros((n, n))
    at = 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    hx = np.vstack(state["hx"])
    return out + hx @ np.linalg.solve(state["inner"], hx.T)


def adjusted_vcov(m: Model, c: np.ndarray, mode: str) -> np.ndarray:
    """Covariance of the coefficients of a fit in groups, which takes rows of different groups as independent.

    none; empirical: spread of the groups' contributions C X'S^-1 y, with the common C; pooled: mean of the groups' own; theoretical:
    adds the covariance between groups that the fit left out, pair by pair of groups.
    """
    spec, theta = m.spec, m.theta
    if mode == "none":
        return c
    if mode == "theoretical":
        own = m.data.grouped.select("index", "blob")
        met = own.select(F.col("index").alias("i"), F.col("blob").alias("a")).join(own.select(F.col("index").alias("j"), F.col("blob").alias("b")), F.col("i") < F.col("j"))

        def between(batches):
            for pdf in batches:
                total = None
                for x, y in zip(pdf["a"], pdf["b"], strict=True):
                    g, h = load(x), load(y)
                    sg, sh = np.linalg.solve(sigma(spec, theta, g), g.X), np.linalg.solve(sigma(spec, theta, h), h.X)
                    g.junctions.update(h.junctions)
                    k = sg.T @ sigma_between(spec, theta, g, h) @ sh
                    total = k + k.T + (0 if total is None else total)
                if total is not None:
                    yield pd.DataFrame({"w": [pickle.dumps(total)]})

        found = [pickle.loads(bytes(r[0])) for r in met.mapInPandas(between, "w binary").collect()]
        return c + c @ sum(found, np.zeros_like(c)) @ c

    def each(batches):
        for pdf in batches:
            for b in pdf["blob"]:
                p = gaussian_partial(spec, theta, load(b))
                yield pd.DataFrame({"w": [pickle.dumps((p["xx"], p["xy"]))]})

    found = [pickle.loads(bytes(r[0])) for r in m.data.grouped.mapInPandas(each, "w binary").collect()]
    k = len(found)
    if mode == "empirical":
        d = [c @ xy - m.beta for _, xy in found]
        return sum(np.outer(x, x) for x in d) / (k * (k - 1))
    if mode == "pooled":
        try:
            return sum(np.linalg.inv(xx) for xx, _ in found) / k**2
        except np.linalg.LinAlgError:
            return c
    raise ValueError(f"no such adjustment: {mode}")


# --- statistics of rows -------------------------------------------------------------------------------------------------

ROW_SCHEMA = "pid bigint, y double, fitted double, response double, deviance double, pearson double, standardized double, hat double, cooksd double, tailup double, taildown double, euclid double, nugget double"


def _rows_of(spec: Spec, theta: dict[str, float], beta: np.ndarray, vcov: np.ndarray, g: Group, pair: kernels.Pair | None = None) -> pd.DataFrame:
    """Residuals whitened by the symmetric root of the covariance, hat values, distances and the parts of each fitted value."""
    pair = pair or needed_features(spec, g, g)
    s = sigma(spec, theta, g, pair)
    values, vectors = np.linalg.eigh(s)
    root = vectors @ ((vectors / np.sqrt(values)).T)
    r = g.y - g.offset - g.X @ beta
    pearson, wx = root @ r, root @ g.X
    hat = ((wx @ vcov) * wx).sum(axis=1)
    std = pearson / np.sqrt(np.maximum(1 - hat, 1e-12))
    cook = pearson**2 * hat / (len(beta) * np.maximum(1 - hat, 1e-12))
    found = parts(spec, theta, g, g, pair)
    sr = np.linalg.solve(s, r)
    comp = {c: found[c] @ sr if c in found else np.zeros(len(r)) for c in search.COMPONENTS}
    return pd.DataFrame({"pid": g.pid, "y": g.y, "fitted": g.X @ beta + g.offset, "response": r, "deviance": pearson, "pearson": pearson, "standardized": std, "hat": hat, "cooksd": cook, **comp, "nugget": theta.get("nugget", 0.0) * sr})


def _glm_rows(m: Model) -> pd.DataFrame:
    st, spec, out = m.extra["state"], m.spec, []
    phi = m.theta.get("dispersion", 1.0)
    for g, w, i, s, r in zip(groups_of(m.data), st["w"], st["inverse"], st["sx"], st["resid"], strict=True):
        mu = fam.inverse_link(spec.family, w, g.size)
        dev = fam.deviance(spec.family, mu, g.y, g.size, phi)
        var = np.maximum(fam.unit_variance(spec.family, mu, g.size, phi), 1e-12)
        root = np.linalg.cholesky(i).T
        wx = root @ g.X
        hat = ((wx @ st["C"]) * wx).sum(axis=1)
        if hat.max(initial=0.0) > 0.999:
            hat = hat * 0.999 / hat.max()
        pearson = (g.y - mu) / np.sqrt(var)
        signed_dev = np.sign(g.y - mu) * np.sqrt(dev)
        std = signed_dev / np.sqrt(1 - hat)
        found = parts(spec, m.theta, g, g, needed_features(spec, g, g))
        sr = i @ r
        comp = {c: found[c] @ sr if c in found else np.zeros(len(r)) for c in search.COMPONENTS}
        out.append(pd.DataFrame({"pid": g.pid, "y": g.y, "fitted": mu, "response": g.y - mu, "deviance": signed_dev, "pearson": pearson, "standardized": std, "hat": hat, "cooksd": std**2 * hat / (len(m.beta) * (1 - hat)), **comp, "nugget": m.theta.get("nugget", 0.0) * sr}))
    return pd.concat(out, ignore_index=True)


def row_statistics(m: Model) -> DataFrame:
    """A row for each observed row: ROW_SCHEMA."""
    spark = m.obs.sparkSession
    if m.spec.family != "gaussian":
        return spark.createDataFrame(_glm_rows(m), ROW_SCHEMA)
    spec, theta, beta, vcov = m.spec, m.theta, m.beta, m.vcov_uncorrected if m.vcov_uncorrected is not None else m.vcov
    if m.data.grouped is None:
        return spark.createDataFrame(pd.concat([_rows_of(spec, theta, beta, vcov, g, p) for g, p in zip(parts_of(m.data), _pairs(m.data), strict=True)], ignore_index=True), ROW_SCHEMA)

    def run(batches):
        for pdf in batches:
            for b in pdf["blob"]:
                yield _rows_of(spec, theta, beta, vcov, load(b))

    return m.data.grouped.mapInPandas(run, ROW_SCHEMA)


def _effects_of(spec: Spec, theta: dict[str, float], g: Group, sr: np.ndarray) -> pd.DataFrame:
    """What the rows of a group say about its random effects, from S^-1 times their residuals."""
    out = [t.by_level(g.frame, sr).mul(theta[f"random:{t.name}"]).rename("blup").rename_axis("level").reset_index().assign(term=t.name) for t in fm.random_terms(spec.random)]
    return pd.concat(out, ignore_index=True)[["term", "level", "blup"]]


def random_effects(m: Model) -> DataFrame:
    """(term, level, blup): the best predictions of the random effects. A level that stands in several local groups gets the mean of
    what they say, zeros aside."""
    kind, spec, theta, beta = "term string, level string, blup double", m.spec, m.theta, m.beta
    spark = m.obs.sparkSession
    if not fm.random_terms(spec.random):
        return spark.createDataFrame([], kind)

    def solved(g, pair=None):
        return np.linalg.solve(sigma(spec, theta, g, pair), g.y - g.offset - g.X @ beta)

    if spec.family != "gaussian":
        st = m.extra["state"]
        found = [_effects_of(spec, theta, g, i @ r) for g, i, r in zip(groups_of(m.data), st["inverse"], st["resid"], strict=True)]
        said = spark.createDataFrame(pd.concat(found, ignore_index=True), kind)
    elif m.data.grouped is None:
        found = [_effects_of(spec, theta, g, solved(g, p)) for g, p in zip(parts_of(m.data), _pairs(m.data), strict=True)]
        said = spark.createDataFrame(pd.concat(found, ignore_index=True), kind)
    else:

        def run(batches):
            for pdf in batches:
                for b in pdf["blob"]:
                    g = load(b)
                    yield _effects_of(spec, theta, g, solved(g))

        said = m.data.grouped.mapInPandas(run, kind)
    return said.groupBy("term", "level").agg(F.coalesce(F.avg(F.when(F.col("blup") != 0, F.col("blup"))), F.lit(0.0)).alias("blup"))


def deviance(m: Model) -> float:
    if m.data.grouped is None and m.spec.family == "gaussian":  # the whitened residuals' squares add up to r'S^-1 r, whatever the root
        left = [replace(g, y=g.y - g.offset - g.X @ m.beta, offset=np.zeros(len(g.y))) for g in parts_of(m.data)]
        return float(add([gaussian_partial(m.spec, m.theta, g, p) for g, p in zip(left, _pairs(m.data), strict=True)])["yy"])
    return float(row_statistics(m).agg(F.sum(F.col("deviance") * F.col("deviance"))).first()[0])


def _null_deviance(m: Model) -> float:
    """The deviance of the model with an intercept alone and no offset, from the gathered rows of an exact fit."""
    total = add([gaussian_partial(m.spec, m.theta, replace(g, X=np.ones((len(g.y), 1)), offset=np.zeros(len(g.y))), p) for g, p in zip(parts_of(m.data), _pairs(m.data), strict=True)])
    return float(total["yy"] - total["xy"] @ np.linalg.solve(total["xx"], total["xy"]))


def pseudo_r2(m: Model, adjusted: bool = False) -> float:
    """1 - deviance / deviance of the model with an intercept alone and the same covariance; at least 0."""
    if not m.data.bound.terms:
        return 0.0
    if m.data.grouped is None and m.spec.family == "gaussian":  # the same rows and covariance, a column of ones
        r2 = max(0.0, 1 - deviance(m) / _null_deviance(m))
        return 1 - (1 - r2) * (m.n - 1) / (m.n - len(m.beta)) if adjusted else r2
    null = replace(m.spec, formula=f"{fm.Formula.parse(m.spec.formula).response} ~ 1")
    base = fit(null, m.obs, m.edges, known=m.theta, index=m.data.index, var_adjust="none")
    r2 = max(0.0, 1 - deviance(m) / deviance(base))
    return 1 - (1 - r2) * (m.n - 1) / (m.n - len(m.beta)) if adjusted else r2


def varcomp(m: Model) -> DataFrame:
    from .infer import variance_components

    shares = {k: v for k, v in m.theta.items() if k.endswith("_de") or k == "nugget" or k.startswith("random:")}
    return variance_components(m.obs.sparkSession, pseudo_r2(m), shares)


def tidy(m: Model, effects: str = "fixed", conf_level: float | None = None) -> DataFrame:
    spark = m.obs.sparkSession
    if effects != "fixed":
        rows = [(k.split("_")[0].split(":")[0], k, float(v), k not in m.free) for k, v in m.theta.items() if effects == "covariance" or k.startswith(effects) or effects == "randcov" and k.startswith("random:")]
        return spark.createDataFrame(rows, "effect string, term string, estimate double, is_known boolean")
    se = np.sqrt(np.diag(m.vcov))
    ci = m.confint(conf_level or 0.95)
    rows = [(k, float(b), float(s), float(b / s), float(2 * (1 - norm_cdf(abs(b / s)))), *map(float, ci[k])) for k, b, s in zip(m.names, m.beta, se, strict=True)]
    out = spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double")
    return (out if conf_level else out.drop("conf_low", "conf_high")).orderBy("term")


def glance(m: Model, name: str = "model") -> DataFrame:
    row = (name, m.n, len(m.beta), m.npar, *map(float, (m.value, m.aic(), m.aicc(), m.bic(), m.loglik(), deviance(m), pseudo_r2(m))))
    return m.obs.sparkSession.createDataFrame([row], "model string, n int, p int, npar int, value double, aic double, aicc double, bic double, loglik double, deviance double, pseudo_r_squared double")


def glances(models: dict[str, Model], sort_by: str = "aicc", decreasing: bool = False) -> DataFrame:
    tables = [glance(m, k) for k, m in models.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out if sort_by == "order" else out.orderBy(F.desc(sort_by) if decreasing else sort_by)


def augment(m: Model) -> DataFrame:
    stats = row_statistics(m).select("pid", F.col("fitted").alias(".fitted"), F.col("response").alias(".resid"), F.col("hat").alias(".hat"), F.col("cooksd").alias(".cooksd"), F.col("standardized").alias(".std.resid"))
    return m.obs.join(stats, "pid")


def anova(m: Model, other: Model | None = None, contrasts: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Wald tests of each term or of given contrasts; with another model their likelihood ratio."""
    spark = m.obs.sparkSession
    if other is not None:
        if m.spec.estmethod == "reml" and m.names != other.names:
            raise ValueError("restricted likelihoods of different designs can't be compared")
        df = abs(m.npar - other.npar) + (abs(len(m.beta) - len(other.beta)) if m.spec.estmethod == "ml" else 0)
        x = float(abs(m.value - other.value))
        return spark.createDataFrame([("likelihood ratio", df, x, chi2_sf(x, df) if df else 1.0)], "effect string, df int, chi2 double, p_value double")
    if contrasts is None:
        contrasts = {}
        for k, term in enumerate([*m.data.bound.terms]):
            own = [i for i, t in enumerate(m.data.bound.term_of) if t == k]
            contrasts[term] = np.eye(len(m.beta))[own]
        if -1 in m.data.bound.term_of:
            contrasts = {"(Intercept)": np.eye(len(m.beta))[:1]} | contrasts
    rows = []
    for name, lm in contrasts.items():
        lm = np.atleast_2d(lm)
        b = lm @ m.beta
        x = float(b @ np.linalg.solve(lm @ m.vcov @ lm.T, b))
        rows.append((name, len(lm), x, chi2_sf(x, len(lm))))
    return spark.createDataFrame(rows, "effect string, df int, chi2 double, p_value double")


def marginal_means(m: Model, factor: str) -> DataFrame:
    """Mean prediction at each level of a factor, other columns of the design at their means."""
    X = np.vstack([g.X for g in groups_of(m.data)])
    base = X.mean(axis=0)
    own = [i for i, nm in enumerate(m.names) if nm.startswith(factor)]
    rows = []
    for lv in m.data.bound.levels[factor]:
        x = base.copy()
        for i in own:
            x[i] = float(m.names[i] == factor + lv)
        rows.append((lv, float(x @ m.beta), float(np.sqrt(x @ m.vcov @ x))))
    return m.obs.sparkSession.createDataFrame(rows, "level string, emmean double, se double")


def summary(m: Model) -> str:
    """The fit as text."""
    se = np.sqrt(np.diag(m.vcov))
    lines = [f"{m.spec.family} model of {m.spec.formula} by {m.spec.estmethod}, n = {m.n}", f"{'term':<20}{'estimate':>12}{'std.error':>12}{'z':>9}{'p':>9}"]
    lines += [f"{k:<20}{b:>12.5g}{s:>12.5g}{b / s:>9.3f}{2 * (1 - float(norm_cdf(abs(b / s)))):>9.4f}" for k, b, s in zip(m.names, m.beta, se, strict=True)]
    lines += [f"{k:<20}{v:>12.5g}{'' if k in m.free else '  (known)'}" for k, v in m.theta.items() if k in m.free or v not in (0.0, 1.0)]
    return "\n".join([*lines, f"-2 log likelihood {m.value:.5g}, AIC {m.aic():.5g}, AICc {m.aicc():.5g}, BIC {m.bic():.5g}"])


def plot_data(m: Model, which: int) -> DataFrame:
    """What the diagnostic plots 1 to 6 show: x, y."""
    s = row_statistics(m)
    cols = {1: ("fitted", F.col("standardized")), 2: ("standardized", F.col("standardized")), 3: ("fitted", F.sqrt(F.abs("standardized"))), 4: ("pid", F.col("cooksd")), 5: ("hat", F.col("standardized")), 6: ("hat", F.col("cooksd"))}
    x, y = cols[which]
    return s.select("pid", F.col(x).cast("double").alias("x"), y.alias("y"))
