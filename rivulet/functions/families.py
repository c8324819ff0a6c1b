"""Families of generalized linear models on the link scale: scores, curvatures, variances, deviances and densities, in numpy,
and as Columns for the parts that are plain arithmetic.

w is the latent value, phi the dispersion, size the number of binomial trials.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import digamma, lgamma, trigamma

FAMILIES = ("poisson", "nbinomial", "binomial", "beta", "Gamma", "inverse.gaussian")
#: Families whose dispersion is 1 by definition.
FIXED = ("poisson", "binomial")


def expit(x):
    return 1 / (1 + np.exp(-np.asarray(x, float)))


def logit(p):
    p = np.asarray(p, float)
    if ((p < 0) | (p > 1)).any():
        raise ValueError("logit is defined from 0 to 1")
    return np.log(p / (1 - p))


def check_response(family: str, y: np.ndarray, size: np.ndarray | None = None) -> None:
    whole = np.all(y == np.floor(y))
    if family == "binomial":
        if size is None or not (np.all(size >= 1) and np.all(size == np.floor(size)) and whole and np.all(y >= 0)):
            raise ValueError("binomial responses are whole numbers from 0 up, of sizes from 1 up")
        if np.all(size == 1) and not np.isin(y, (0, 1)).all():
            raise ValueError("binary responses are 0 or 1")
    elif family == "beta" and not ((y > 0) & (y < 1)).all():
        raise ValueError("beta responses lie between 0 and 1")
    elif family in ("poisson", "nbinomial") and not (whole and (y >= 0).all()):
        raise ValueError(f"{family} responses are whole numbers from 0 up")
    elif family in ("Gamma", "inverse.gaussian") and not (y > 0).all():
        raise ValueError(f"{family} responses are above 0")
    elif family not in FAMILIES:
        raise ValueError(f"no such family: {family}")


def inverse_link(family: str, w, size=1.0):
    return np.exp(w) if family not in ("binomial", "beta") else expit(w) * (size if family == "binomial" else 1.0)


def start(family: str, y) -> np.ndarray:
    return np.zeros(len(y)) if family in ("binomial", "beta") else 0.5 * np.log(np.asarray(y, float) + 1)


def score(family: str, w, y, size, phi):
    """First derivative of the log density."""
    e = np.exp(w)
    if family == "poisson":
        return y - e
    if family == "nbinomial":
        return phi * (y - e) / (phi + e)
    if family == "binomial":
        return y - size * expit(w)
    if family == "Gamma":
        return phi * (y / e - 1)
    if family == "inverse.gaussian":
        return phi * (y / (2 * e) - e / (2 * y)) + 0.5
    k0 = digamma(phi * e / (1 + e)) - digamma(phi / (1 + e)) + np.log(1 / y - 1)
    return -phi * e * k0 / (1 + e) ** 2


def curvature(family: str, w, y, size, phi):
    """Second derivative of the log density."""
    e = np.exp(w)
    if family == "poisson":
        return -e
    if family == "nbinomial":
        return -phi * e * (phi + y) / (phi + e) ** 2
    if family == "binomial":
        return -size * expit(w) / (1 + e)
    if family == "Gamma":
        return -phi * y / e
    if family == "inverse.gaussian":
        return -phi * (e * e + y * y) / (2 * y * e)
    k0 = digamma(phi * e / (1 + e)) - digamma(phi / (1 + e)) + np.log(1 / y - 1)
    k1 = phi * (trigamma(phi * e / (1 + e)) + trigamma(phi / (1 + e))) - 2 * np.sinh(w) * k0
    return -phi * e * e * k1 / (1 + e) ** 4


def log_density(family: str, w, y, size, phi):
    mu = inverse_link(family, w, size)
    if family == "poisson":
        return y * w - mu - lgamma(y + 1)
    if family == "nbinomial":
        return lgamma(y + phi) - lgamma(np.full(len(y), float(phi))) - lgamma(y + 1) + phi * np.log(phi / (phi + mu)) + y * np.log(mu / (phi + mu))
    if family == "binomial":
        return lgamma(size + 1) - lgamma(y + 1) - lgamma(size - y + 1) + y * w - size * np.logaddexp(0, w)
    if family == "Gamma":
        return phi * np.log(phi * y / mu) - phi * y / mu - np.log(y) - lgamma(np.full(len(y), float(phi)))
    if family == "inverse.gaussian":
        return 0.5 * (np.log(phi) + np.log(mu) - np.log(2 * np.pi) - 3 * np.log(y)) - phi * (y - mu) ** 2 / (2 * mu * y)
    a, b = mu * phi, (1 - mu) * phi
    return lgamma(np.full(len(y), float(phi))) - lgamma(a) - lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)


def unit_variance(family: str, mu, size=1.0, phi=1.0):
    return {"poisson": lambda: mu, "nbinomial": lambda: mu / (1 + mu / phi), "binomial": lambda: mu * (1 - mu / size), "Gamma": lambda: mu**2, "inverse.gaussian": lambda: mu**3, "beta": lambda: mu * (1 - mu)}[family]()


def response_variance(family: str, mu, size=1.0, phi=1.0):
    return {"poisson": lambda: mu, "nbinomial": lambda: mu + mu**2 / phi, "binomial": lambda: mu * (1 - mu / size), "Gamma": lambda: mu**2 / phi, "inverse.gaussian": lambda: mu**3 / (mu * phi), "beta": lambda: mu * (1 - mu) / (1 + phi)}[family]()


def _xlogy(x, y):
    return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, y)))


def deviance(family: str, mu, y, size=1.0, phi=1.0):
    """Deviance of each row, at least 0."""
    if family == "poisson":
        half = _xlogy(y, y / mu) - (y - mu)
    elif family == "nbinomial":
        half = _xlogy(y, (y / (y + phi)) / (mu / (mu + phi))) + phi * (np.log(mu + phi) - np.log(y + phi))
    elif family == "binomial":
        half = _xlogy(y, y / mu) + _xlogy(size - y, (size - y) / (size - mu))
    elif family == "Gamma":
        half = -np.log(y / mu) + (y - mu) / mu
    elif family == "inverse.gaussian":
        half = 0.5 * (y - mu) ** 2 / (y * mu**2)
    else:
        half = lgamma(mu * phi) + lgamma((1 - mu) * phi) - lgamma(y * phi) - lgamma((1 - y) * phi) + (y - mu) * phi * np.log(y) + ((1 - y) - (1 - mu)) * phi * np.log1p(-y)
    return np.maximum(2 * half, 0.0)


# --- Columns ----------------------------------------------------------------------------------------------------


def logit_col(p: Column) -> Column:
    return F.when((p < 0) | (p > 1), F.raise_error(F.lit("logit is defined from 0 to 1"))).otherwise(F.log(p / (1 - p)))


def expit_col(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def inverse_link_col(family: str, w: Column, size: Column | float = 1.0) -> Column:
    return F.exp(w) if family not in ("binomial", "beta") else expit_col(w) * (size if family == "binomial" else 1.0)


def score_col(family: str, w: Column, y: Column, size: Column | float, phi: float) -> Column:
    e = F.exp(w)
    return {"poisson": lambda: y - e, "nbinomial": lambda: phi * (y - e) / (phi + e), "binomial": lambda: y - size * expit_col(w), "Gamma": lambda: phi * (y / e - 1), "inverse.gaussian": lambda: phi * (y / (2 * e) - e / (2 * y)) + 0.5}[family]()


def curvature_col(family: str, w: Column, y: Column, size: Column | float, phi: float) -> Column:
    e = F.exp(w)
    return {"poisson": lambda: -e, "nbinomial": lambda: -phi * e * (phi + y) / ((phi + e) * (phi + e)), "binomial": lambda: -size * expit_col(w) / (1 + e), "Gamma": lambda: -phi * y / e, "inverse.gaussian": lambda: -phi * (e * e + y * y) / (2 * y * e)}[family]()


def deviance_col(family: str, mu: Column, y: Column, size: Column | float = 1.0, phi: float = 1.0) -> Column:
    def xlogy(x, z):
        return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(z))

    half = {
        "poisson": lambda: xlogy(y, y / mu) - (y - mu),
        "nbinomial": lambda: xlogy(y, (y / (y + phi)) / (mu / (mu + phi))) + phi * (F.log(mu + phi) - F.log(y + phi)),
        "binomial": lambda: xlogy(y, y / mu) + xlogy(size - y, (size - y) / (size - mu)),
        "Gamma": lambda: -F.log(y / mu) + (y - mu) / mu,
        "inverse.gaussian": lambda: F.lit(0.5) * (y - mu) * (y - mu) / (y * mu * mu),
    }[family]()
    return F.greatest(F.lit(0.0), 2 * half)
