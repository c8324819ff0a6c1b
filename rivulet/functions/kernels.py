"""Covariance kernels over pairs of sites: a Column builder and a numpy twin for each.

A pair has h (total hydrologic distance), a and b (its longer and shorter part), w (weight of additive values, 0 where the sites
aren't flow-connected), mask (same network) and e (Euclidean distance). All kernels give `de`, the partial sill, at distance 0.
One body serves both forms: it is written against the few functions that a backend provides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import bessel_j0, norm_cdf


def _phi(x: Column) -> Column:
    return F.pandas_udf(lambda v: pd.Series(norm_cdf(v.to_numpy())), "double", F.PandasUDFType.SCALAR)(x)


def _j0(x: Column) -> Column:
    return F.pandas_udf(lambda v: pd.Series(bessel_j0(v.to_numpy())), "double", F.PandasUDFType.SCALAR)(x)


class InColumns:
    """The functions that kernels need, on Columns. Conditions guard divisions, since ANSI mode raises on 0."""

    exp, log, sqrt, sin, asin = F.exp, F.log, F.sqrt, F.sin, F.asin
    phi, j0 = staticmethod(_phi), staticmethod(_j0)

    @staticmethod
    def where(cond: Column, yes: Any, no: Any) -> Column:
        return F.when(cond, yes).otherwise(no)

    @staticmethod
    def least(x: Column, y: float) -> Column:
        return F.least(x, F.lit(float(y)))

    @staticmethod
    def safe(x: Column) -> Column:
        """x, with 1 in place of 0, for denominators on a branch that isn't taken."""
        return F.when(x == 0, F.lit(1.0)).otherwise(x)

    zero = staticmethod(lambda x: x * F.lit(0.0))


class InArrays:
    exp, log, sqrt, sin, asin = np.exp, np.log, np.sqrt, np.sin, np.arcsin
    phi, j0 = staticmethod(norm_cdf), staticmethod(bessel_j0)
    where, least, zero = staticmethod(np.where), staticmethod(np.minimum), staticmethod(np.zeros_like)

    @staticmethod
    def safe(x):
        return np.where(x == 0, 1.0, x)


@dataclass(frozen=True)
class Pair:
    """Features of pairs: Columns or arrays."""

    h: Any = None
    a: Any = None
    b: Any = None
    w: Any = None
    mask: Any = None
    e: Any = None


# --- shapes: correlation as a function of distance ---------------------------------------------------------------


def _linear(m, d, r):
    return m.where(d <= r, 1 - d / r, 0.0)


def _spherical(m, d, r):
    t = d / r
    return m.where(d <= r, 1 - 1.5 * t + 0.5 * t * t * t, 0.0)


def _exponential(m, d, r):
    return m.exp(d * (-1.0 / r))


def _mariah(m, d, r):
    q = d * 90.0 / r
    return m.where(q == 0, 1.0, m.log(q + 1) / m.safe(q))


def _epa(m, d, r):
    poly = 16.0 * r**3 + 17.0 * r * r * d - 2.0 * r * d * d - d * d * d
    return m.where(d <= r, (d - r) * (d - r) * poly / (16.0 * r**5), 0.0)


def _gauss_flow(m, d, r):
    t = d / r
    return 2.0 * m.exp(t * t * -1.0) * (1.0 - m.phi(t * math.sqrt(2.0)))


UP = {"linear": _linear, "spherical": _spherical, "exponential": _exponential, "mariah": _mariah, "epa": _epa, "gaussian": _gauss_flow}


def _down_linear(m, p, r):
    return m.where(p.b == 0, _linear(m, p.h, r), _linear(m, p.a, r))


def _down_spherical(m, p, r):
    a, b = p.a / r, p.b / r
    apart = m.where(p.a <= r, (1 - 1.5 * b + 0.5 * a) * (1 - a) * (1 - a), 0.0)
    return m.where(p.b == 0, _spherical(m, p.h, r), apart)


def _down_exponential(m, p, r):
    return _exponential(m, p.h, r)  # for all pairs of a network, connected or not


def _down_mariah(m, p, r):
    qa, qb = p.a * 90.0 / r, p.b * 90.0 / r
    apart = m.where(qa == qb, 1.0 / (qa + 1), (m.log(qa + 1) - m.log(qb + 1)) / m.safe(qa - qb))
    return m.where(p.b == 0, _mariah(m, p.h, r), apart)


def _down_epa(m, p, r):
    a, b = p.a, p.b
    poly = 16.0 * r**3 + 17.0 * r * r * a - 15.0 * r * r * b - 20.0 * r * b * b - 2.0 * r * a * a + 10.0 * r * a * b
    poly = poly + 5.0 * a * a * b - a * a * a - 10.0 * a * b * b
    apart = m.where(a <= r, (a - r) * (a - r) * poly / (16.0 * r**5), 0.0)
    return m.where(b == 0, _epa(m, p.h, r), apart)


def _down_gaussian(m, p, r):
    t = (p.a - p.b) / r
    return 2.0 * m.exp(t * t * -1.0) * (1.0 - m.phi(p.h * (math.sqrt(2.0) / r)))


DOWN = {"linear": _down_linear, "spherical": _down_spherical, "exponential": _down_exponential, "mariah": _down_mariah, "epa": _down_epa, "gaussian": _down_gaussian}


def _gaussian(m, e, r):
    t = e / r
    return m.exp(t * t * -1.0)


def _cosine(m, e, r):
    t = m.least(e / r, 1.0)
    return m.where(e <= r, 1 - (2 / math.pi) * (t * m.sqrt(1 - t * t) + m.asin(t)), 0.0)


def _cubic(m, e, r):
    t = e / r
    return m.where(e <= r, 1 - 7 * t * t + 8.75 * t * t * t - 3.5 * t * t * t * t * t + 0.75 * t * t * t * t * t * t * t, 0.0)


def _pentaspherical(m, e, r):
    t = e / r
    return m.where(e <= r, 1 - 1.875 * t + 1.25 * t * t * t - 0.375 * t * t * t * t * t, 0.0)


def _wave(m, e, r):
    t = e / r
    return m.where(t == 0, 1.0, m.sin(t) / m.safe(t))


def _jbessel(m, e, r):
    return m.j0(m.least(e * r, 1e5))  # the range multiplies here


def _gravity(m, e, r):
    t = e / r
    return 1.0 / m.sqrt(1 + t * t)


def _rquad(m, e, r):
    t = e / r
    return 1.0 / (1 + t * t)


def _magnetic(m, e, r):
    t = e / r
    return 1.0 / ((1 + t * t) * m.sqrt(1 + t * t))


EUCLID = {"exponential": _exponential, "spherical": _spherical, "gaussian": _gaussian, "cosine": _cosine, "cubic": _cubic, "pentaspherical": _pentaspherical, "wave": _wave, "jbessel": _jbessel, "gravity": _gravity, "rquad": _rquad, "magnetic": _magnetic}

TYPES = {"tailup": (*UP, "none"), "taildown": (*DOWN, "none"), "euclid": (*EUCLID, "none"), "nugget": ("nugget", "none")}


def covariance(component: str, kind: str, p: Pair, de: float, range_: float, m=InColumns):
    """The covariance of pairs by one component; 0 for type none."""
    if kind not in TYPES[component]:
        raise ValueError(f"{component} has no type {kind}; it has {', '.join(TYPES[component])}")
    if kind == "none":
        return m.zero(p.e if component == "euclid" else p.h)
    if component == "tailup":
        return p.mask * UP[kind](m, p.h, float(range_)) * p.w * float(de)
    if component == "taildown":
        return p.mask * DOWN[kind](m, p, float(range_)) * float(de)
    return EUCLID[kind](m, p.e, float(range_)) * float(de)


def nugget_diagonal(kind: str, nugget: float, de_total: float, least: float = 0.0) -> float:
    """What stands on the diagonal: the nugget, but at least 1e-4 of all partial sills."""
    return max(float(nugget) if kind == "nugget" else 0.0, 1e-4 * de_total, least)
