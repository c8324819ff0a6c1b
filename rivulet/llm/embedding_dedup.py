"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors.

A vector is made unit, rotated by a fixed random rotation and coded by the signs of its coordinates. With the code its
correction factor is stored: the inner product of the rotated vector and the unit vector of its signs. For a query q the
estimate <code, q> / factor of the inner product is unbiased over rotations, and bounds on its error decide which pairs are
computed exactly: in double precision, from the stored components.

The error bound is EPSILON standard errors of the estimate, as far as that is narrower than what the two angles allow at all:
with angle s between a vector and its code, <v, q> lies between cos(t + s) and cos(t - s), t being the angle between code and q.
With epsilon=None only that certain bound is used, and no link can be lost; it is the default, because at 64 dimensions the
certain bound is about as narrow as five standard errors.

Vectors are compared within groups of equal keys, in pairs of blocks of bounded size. A group may hold any share of the rows:
its blocks meet in separate tasks. A task returns, for each of its rows, how many links it found and which block partner of
smaller number it hooks to, so pairs never leave a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a key, link with
nothing, and so do rows without an id; vectors of different length never link; repeated rows link with each other like any equal
vectors, and rows that share an id take the largest of their counts; an empty table gives an empty result; other columns are
not returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

#: Rows of a block: an eighth of the group, between these.
SMALLEST_BLOCK, LARGEST_BLOCK = 256, 4096
SEED = 20240521


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Rows of +-1 / sqrt(dim) from packed bits."""
    bits = np.unpackbits(codes, axis=1, count=dim)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1])
    codes = np.packbits(turned > 0, axis=1)
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, epsilon: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of coded rows with unit queries, and upper bounds of them."""
    dim = queries.shape[1]
    c = np.clip(factors, 1e-6, 1.0)[:, None]
    dot = signs(codes, dim) @ (queries @ rotation(dim)).T.astype(np.float32)
    dot = np.clip(dot.astype(np.float64), -1, 1)
    est = dot / c
    upper = c * dot + np.sqrt(1 - c * c) * np.sqrt(1 - dot * dot)  # cos(t - s)
    upper = np.where(dot >= c, 1.0, upper)
    if epsilon is not None:
        upper = np.minimum(upper, est + epsilon * np.sqrt((1 - c * c) / (c * c)) / np.sqrt(max(dim - 1, 1)))
    return est, upper + 1e-5  # float32 sums


def index(vectors: DataFrame, id_col: str, vector_col: str, key_col: str) -> DataFrame:
    """(uid, id, key, dim, vector, code, factor) of the vectors that can link; uid numbers the rows."""
    dim = F.size(vector_col)
    good = F.col(id_col).isNotNull() & F.col(key_col).isNotNull() & F.col(vector_col).isNotNull() & (dim > 0)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(good & finite & F.exists(vector_col, lambda x: x != 0)).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(key_col).alias("key"), dim.alias("dim"), F.col(vector_col).alias("vector"))

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            flat = b.column("vector").flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(dims)
            codes: list = [None] * len(dims)
            factors = np.zeros(len(dims))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                m = flat[(ends[own] - d)[:, None] + np.arange(d)[None, :]]
                m = m / np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
                c, f = encode(m)
                factors[own] = f
                for i, x in zip(own, c, strict=True):
                    codes[i] = x.tobytes()
            arrays = [b.column(k) for k in ("uid", "id", "key", "dim", "vector")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(codes, pa.binary()), pa.array(factors)], ["uid", "id", "key", "dim", "vector", "code", "factor"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"uid bigint, id {kinds['id']}, key {kinds['key']}, dim int, vector {kinds['vector']}, code binary, factor double")


def _compare(a: pd.DataFrame, b: pd.DataFrame, least: float, epsilon: float | None):
    """Row numbers (i of a, j of b) of the pairs that link, in slices."""
    va, vb = np.stack(a["vector"].to_numpy()).astype(np.float64), np.stack(b["vector"].to_numpy()).astype(np.float64)
    va, vb = va / np.abs(va).max(axis=1, keepdims=True), vb / np.abs(vb).max(axis=1, keepdims=True)
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
    factors = b["factor"].to_numpy()
    for k in range(0, len(a), 512):
        q = va[k : k + 512] / na[k : k + 512, None]
        _, upper = estimate(codes, factors, q, epsilon)
        j, i = np.nonzero(upper >= least)
        for s in range(0, len(i), 1 << 18):
            ii, jj = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            exact = np.einsum("nd,nd->n", va[k + ii], vb[jj]) / (na[k + ii] * nb[jj])
            yield k + ii[exact >= least], jj[exact >= least]


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", key_col: str = "label", *, least: float = 0.93, epsilon: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, id, n_links) of the vectors that have links, and links (a, b) between ids that connect what is linked."""
    base = cut(index(vectors, id_col, vector_col, key_col))
    sizes = base.groupBy("key", "dim").agg(F.count("*").alias("n"))
    rows = F.least(F.greatest(F.ceil(F.col("n") / 8), F.lit(SMALLEST_BLOCK)), F.lit(LARGEST_BLOCK))
    sizes = sizes.select("key", "dim", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))
    dealt = base.join(sizes, ["key", "dim"]).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    met = dealt.select("uid", "id", "key", "dim", "vector", "code", "factor", "own", F.explode(pairs).alias("pair"))

    def block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "uid"], ignore_index=True)
        same = pdf["pair_i"].iloc[0] == pdf["pair_j"].iloc[0]
        n_a = len(pdf) if same else int((pdf["own"] == pdf["pair_i"].iloc[0]).sum())
        a, b = pdf.iloc[:n_a], (pdf if same else pdf.iloc[n_a:])
        at_b = 0 if same else n_a
        count = np.zeros(len(pdf), np.int64)
        low = np.arange(len(pdf))  # the smallest row that links reach, of those met so far

        def root(x):
            while True:
                up = low[low[x]]
                if (up == low[x]).all():
                    return up
                x = up

        for i, j in _compare(a, b, least, epsilon) if len(a) and len(b) else ():
            j = j + at_b
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, 1)
            np.add.at(count, j, 1)
            while len(i):  # hook larger roots to smaller ones until all pairs agree
                ri, rj = root(i), root(j)
                apart = ri != rj
                i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
                np.minimum.at(low, np.maximum(ri, rj), np.minimum(ri, rj))
        ids, tops = pdf["id"].to_numpy(), pdf["id"].to_numpy()[root(np.arange(len(pdf)))] if len(pdf) else pdf["id"].to_numpy()
        out = pd.DataFrame({"uid": pdf["uid"], "id": ids, "n": count, "hook": tops})
        return out[out["n"] > 0]

    kind = dict(base.dtypes)["id"]
    flat = met.select("uid", "id", "vector", "code", "factor", "own", "key", "dim", F.col("pair.i").alias("pair_i"), F.col("pair.j").alias("pair_j"))
    found = cut(flat.groupBy("key", "dim", "pair_i", "pair_j").applyInPandas(block_pair, f"uid bigint, id {kind}, n bigint, hook {kind}"))
    counts = found.groupBy("uid", "id").agg(F.sum("n").alias("n_links"))
    return counts, found.where("id <> hook").select(F.col("id").alias("a"), F.col("hook").alias("b")).distinct()


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", key_col: str = "label", **how) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors."""
    counts, edges = links(vectors, id_col, vector_col, key_col, **how)
    numbered = vectors.select(F.col(id_col).alias("id"))
    by_id = counts.groupBy("id").agg(F.max("n_links").alias("n_links"))
    groups = components(edges).select(F.col("node").alias("id"), "component")
    out = numbered.join(by_id, "id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
