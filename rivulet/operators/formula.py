"""Model formulas: `y ~ x + g + x:g + x*g + I(expr) + fn(x) + offset(z) - 1`, bound to a DataFrame as Column expressions.

Factors are string or boolean columns; their levels are sorted and the first is left out (treatment contrasts). Levels are those
of the rows a model is fitted on, and new rows are read with the same ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _split(text: str, marks: str) -> list[tuple[str, str]]:
    """Parts of a text outside brackets, each with the mark before it."""
    out, depth, part, mark = [], 0, "", marks[0]
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth == 0 and c in marks:
            if part.strip():
                out.append((mark, part.strip()))
            part, mark = "", c
        else:
            part += c
    if part.strip():
        out.append((mark, part.strip()))
    return out


@dataclass(frozen=True)
class Bound:
    names: list[str]
    column: Column
    terms: list[str]
    term_of: list[int]  # of each name, -1 for the intercept
    levels: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Formula:
    response: str
    terms: tuple[tuple[str, ...], ...]
    intercept: bool
    offset: str | None = None

    @staticmethod
    def parse(text: str) -> Formula:
        left, _, right = text.partition("~")
        terms: list[tuple[str, ...]] = []
        intercept, offset = True, None
        for mark, part in _split(right, "+-"):
            if part in ("1", "0"):
                intercept = (part == "1") == (mark == "+")
                continue
            if part.startswith("offset("):
                offset = part[7:-1].strip()
                continue
            crossed = [p for _, p in _split(part, "*")]
            made: list[tuple[str, ...]] = []
            for c in crossed:
                one = tuple(p for _, p in _split(c, ":"))
                made += [one, *[(*m, *one) for m in made]]
            for t in sorted(made, key=len):
                if mark == "-":
                    terms = [x for x in terms if set(x) != set(t)]
                elif not any(set(x) == set(t) for x in terms):
                    terms.append(t)
        terms.sort(key=len)
        return Formula(left.strip(), tuple(terms), intercept, offset)

    def without_covariates(self) -> Formula:
        return Formula(self.response, (), True, self.offset)

    def bind(self, df: DataFrame, levels: dict[str, list[str]] | None = None) -> Bound:
        """The design as one array column; levels of factors come from df unless they are given."""
        kinds = dict(df.dtypes)
        factors = sorted({p for t in self.terms for p in t if kinds.get(p) in ("string", "boolean")})
        if levels is None:
            row = df.agg(*[F.sort_array(F.collect_set(F.col(f).cast("string"))).alias(f) for f in factors]).first() if factors else {}
            levels = {f: list(row[f]) for f in factors}
        names, cols, owner = [], [], []
        if self.intercept:
            names, cols, owner = ["(Intercept)"], [F.lit(1.0)], [-1]
        full_used = self.intercept
        for k, term in enumerate(self.terms):
            made: list[tuple[str, Column]] = [("", F.lit(1.0))]
            for p in term:
                if p in levels:
                    skip = 1 if full_used else 0
                    full_used = True
                    parts = [(p + lv, (F.col(p).cast("string") == lv).cast("double")) for lv in levels[p][skip:]]
                else:
                    parts = [(p, _expression(p).cast("double"))]
                made = [(f"{a}:{b}" if a else b, ca * cb if a else cb) for a, ca in made for b, cb in parts]
            for name, col in made:
                names.append(name)
                cols.append(col)
                owner.append(k)
        return Bound(names, F.array(*cols), [":".join(t) for t in self.terms], owner, levels)

    def inputs(self) -> list[str]:
        """Names of columns that the formula reads, but for the response."""
        text = " ".join(p for t in self.terms for p in t) + " " + (self.offset or "")
        return sorted(set(re.findall(r"[A-Za-z_]\w*(?!\w*\()", text)) - {"I", "log", "exp", "sqrt", "poly"})


def _expression(text: str) -> Column:
    inner = re.fullmatch(r"I\((.*)\)", text)
    sql = inner[1] if inner else text
    while m := re.search(r"([A-Za-z_]\w*|\d+(?:\.\d+)?|\([^()]*\))\s*\^\s*([A-Za-z_]\w*|\d+(?:\.\d+)?)", sql):
        sql = f"{sql[: m.start()]}power({m[1]}, {m[2]}){sql[m.end() :]}"
    return F.expr(sql)


@dataclass(frozen=True)
class RandomTerm:
    """One variance: of an intercept (slope None) or a slope, by the levels of a group (columns joined)."""

    name: str
    slope: str | None
    group: tuple[str, ...]

    def matrix(self, df, rows=None):
        """Covariance factor: 1 where two rows share a level, times both slopes; df is a pandas frame."""
        import numpy as np

        g = df[list(self.group)].astype(str).agg("|".join, axis=1).to_numpy()
        other = df if rows is None else rows
        h = other[list(self.group)].astype(str).agg("|".join, axis=1).to_numpy()
        out = (g[:, None] == h[None, :]).astype(float)
        if self.slope:
            out *= np.outer(df[self.slope].to_numpy(float), other[self.slope].to_numpy(float))
        return out

    def by_level(self, df, values):
        """The sums of the values, times the slope, of each level's rows; df is a pandas frame."""
        import pandas as pd

        level = df[list(self.group)].astype(str).agg("|".join, axis=1)
        return pd.Series(values * df[self.slope].to_numpy(float) if self.slope else values, index=df.index).groupby(level).sum()


def random_terms(text: str | None) -> list[RandomTerm]:
    """`~ g`, `~ (1 | g)`, `~ (x | g)` (with its intercept), `~ (x - 1 | g)`, `a/b` for a and a:b."""
    out: list[RandomTerm] = []
    for _, part in _split((text or "").lstrip("~ "), "+"):
        body = part.strip("() ")
        left, bar, right = body.partition("|")
        if not bar:
            left, right = "1", body
        names = [p.strip() for p in right.split("/")]
        groups = [tuple(":".join(names[: i + 1]).split(":")) for i in range(len(names))]
        slopes = [p for m, p in _split(left, "+-") if m == "+" and p not in ("1", "0")]
        plain = not re.search(r"-\s*1|\+\s*0|^\s*0", left)
        for g in groups:
            label = ":".join(g)
            if plain:
                out.append(RandomTerm(f"1 | {label}", None, g))
            out += [RandomTerm(f"{s} | {label}", s, g) for s in slopes]
    return out
