"""Parameters of a model's covariance: initial values, the start grid, transforms for optimisation, and the optimisers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

COMPONENTS = ("tailup", "taildown", "euclid")


@dataclass
class Initial:
    """Initial values of a component, and which are known. Missing ones are searched for."""

    component: str
    kind: str
    values: dict[str, float] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)

    @staticmethod
    def make(component: str, kind: str, known: str | list[str] = (), **values: float) -> Initial:
        """known: names, or "given" for all values that are given."""
        return Initial(component, kind, dict(values), set(values) if known == "given" else set(known))


def start_grid(types: dict[str, str], total: float, max_hydro: float, max_euclid: float, anisotropy: bool = False, random: tuple[str, ...] = ()) -> list[dict[str, float]]:
    """Candidates: 1.2 times the variance is shared out so that one part or none leads, with short or long ranges; each candidate
    again with a rotation and a scale if there is anisotropy; random effects get a tenth, half or nine tenths."""
    lead, rest, even = 0.9, 0.1 / 3, 0.25
    near, far = 0.25, 0.75
    parts = (*COMPONENTS, "nugget")
    rows = []
    for who in COMPONENTS:
        for reach in (near, far):
            rows.append(({p: lead if p == who else rest for p in parts}, {p: reach if p == who else near for p in COMPONENTS}))
    rows.append(({p: lead if p == "nugget" else rest for p in parts}, dict.fromkeys(COMPONENTS, near)))
    rows += [(dict.fromkeys(parts, even), dict.fromkeys(COMPONENTS, reach)) for reach in (near, far)]
    out = []
    for share, reach in rows:
        one = {f"{p}_de": share[p] * 1.2 * total for p in COMPONENTS} | {"nugget": share["nugget"] * 1.2 * total}
        one |= {f"{p}_range": reach[p] * (max_euclid if p == "euclid" else max_hydro) for p in COMPONENTS}
        out.append(one | {"rotate": 0.0, "scale": 1.0})
    if anisotropy:
        out += [g | {"rotate": math.pi / 2, "scale": 0.5} for g in out]
    if random:
        mixed = []
        for g in out:
            for spatial in (0.9, 0.1, 0.5):
                scaled = {k: v * spatial if k.endswith("_de") or k == "nugget" else v for k, v in g.items()}
                mixed.append(scaled | {f"random:{r}": (1 - spatial) * 1.2 * total / len(random) for r in random})
        out = mixed
    return [{k: v for k, v in g.items() if _used(k, types)} for g in out]


def _used(name: str, types: dict[str, str]) -> bool:
    component = name.split("_")[0]
    return component not in COMPONENTS or types.get(component, "none") != "none"


def to_free(name: str, value: float) -> float:
    """A parameter without bounds: logarithms, and log odds for rotation and scale."""
    if name == "rotate":
        p = min(max(value / math.pi, 1e-9), 1 - 1e-9)
    elif name == "scale":
        p = min(max(value, 1e-9), 1 - 1e-9)
    else:
        return math.log(max(value, 1e-22))
    return math.log(p / (1 - p))


def from_free(name: str, value: float) -> float:
    value = min(max(value, -50.0), 50.0)
    if name in ("rotate", "scale"):
        p = 1 / (1 + math.exp(-value))
        return p * math.pi if name == "rotate" else p
    return math.exp(value)


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, reltol: float = 1e-4, most: int = 500) -> tuple[np.ndarray, float, int]:
    """Downhill simplex with reflection 1, contraction 1/2, expansion 2."""
    n = len(x0)
    step = max(0.1 * float(np.abs(x0).max(initial=0.0)), 0.1)
    points = np.vstack([x0, x0 + step * np.eye(n)])
    values = np.array([f(p) for p in points])
    calls = n + 1
    while calls < most:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= reltol * (abs(values[0]) + reltol):
            break
        middle = points[:-1].mean(axis=0)
        reflected = 2 * middle - points[-1]
        fr = f(reflected)
        calls += 1
        if fr < values[0]:
            longer = 3 * middle - 2 * points[-1]
            fe = f(longer)
            calls += 1
            points[-1], values[-1] = (longer, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            toward = reflected if fr < values[-1] else points[-1]
            inner = (middle + toward) / 2
            fi = f(inner)
            calls += 1
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
                calls += n
    best = int(np.argmin(values))
    return points[best], float(values[best]), calls


def golden(f: Callable[[float], float], low: float = -50.0, high: float = 50.0, tol: float = 1e-6) -> tuple[float, float]:
    """Minimum of a function of one variable: golden sections, started around the best of a coarse scan."""
    xs = np.linspace(low, high, 41)
    k = int(np.argmin([f(x) for x in xs]))
    a, b = xs[max(k - 1, 0)], xs[min(k + 1, 40)]
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, f(x)


def minimise(f: Callable[[dict[str, float]], float], start: dict[str, float], free: list[str], reltol: float = 1e-4) -> tuple[dict[str, float], float, int]:
    """The best values of the free parameters, by golden sections for one and by a simplex for more; none: a single evaluation."""
    if not free:
        return start, f(start), 1

    def full(x):
        return start | {k: from_free(k, v) for k, v in zip(free, x, strict=True)}

    def safe(x):
        try:
            v = f(full(x))
        except np.linalg.LinAlgError:
            return 1e100
        return v if np.isfinite(v) else 1e100

    if len(free) == 1:
        x, v = golden(lambda t: safe([t]))
        return full([x]), v, 0
    x, v, calls = nelder_mead(safe, np.array([to_free(k, start[k]) for k in free]), reltol)
    return full(x), v, calls
