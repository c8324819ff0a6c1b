"""What the operators share: checkpoints, word and shingle hashes over Arrow batches, seeded uniforms."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEGMENT = 1 << 19


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in spark.checkpoint.dir. Where that is unset, a local folder serves a local master;
    on a cluster executors can't see one another's folders, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-checkpoint-"))
    return df.checkpoint()


def cut_off(df: DataFrame) -> DataFrame:
    """cut, before which the disk of earlier steps' shuffles and checkpoints that nothing refers to any more is given back. Spark gives
    it back when the driver's heap is next collected, which doesn't depend on how much a step writes: with large tables all stay."""
    sc, own = df.sparkSession.sparkContext, df.select("*")  # the plan that is run refers to its shuffles, so it is one of its own
    sc._jvm.System.gc()
    out = cut(own)
    sc._gateway.detach(own._jdf)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the seed and the parts: the same in every run and every engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


# --- vectorised word hashes -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijection on 64 bits that spreads all of them."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        filled = np.full(max(n, _SEGMENT + 4096), base, dtype=U64)
        filled[0] = 1
        have = np.cumprod(filled, dtype=U64)
        if len(have) <= 2 * _SEGMENT:
            _powers[key] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts: 64-bit hashes, byte spans, and each text's range of words."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, at = buffers(column)
        self.raw, self.at = raw, at
        inside = ~_IS_SPACE[raw]
        n = len(raw)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = at[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hashes(raw, lower)

    def _hashes(self, raw: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        w = 0
        while w < len(self.start):
            base = self.start[w]
            stop = max(np.searchsorted(self.end, base + _SEGMENT, side="right"), w + 1)
            s, e = self.start[w:stop] - base, self.end[w:stop] - base
            part = raw[base : base + e[-1]]
            part = (_TO_LOWER[part] if lower else part).astype(U64)
            part += U64(1)
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(part * _power(_BASE, len(part) + 1, "up")[: len(part)], dtype=U64, out=sums[1:])
            h = (sums[e] - sums[s]) * _power(_BASE_INVERSE, len(part) + 1, "down")[s]
            out[w:stop] = mix(h ^ ((e - s).astype(U64) << U64(48)))
            w = stop
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its text."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.hash))


def join_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two aligned hash arrays."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ U64(0xA0761D6478BD642F)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries (not stopped at text ends), by doubling: H(2n)[i] from H(n)[i] and H(n)[i+n]."""
    if len(h) < k:
        return np.zeros(0, U64)
    size, out = 1, h
    while size * 2 <= k:
        out = join_pairs(out[:-size], out[size:])
        size *= 2
    if size < k:  # the last step overlaps
        out = join_pairs(out[: len(h) - k + 1], out[k - size : k - size + len(h) - k + 1])
    return out


def slices(batch: pa.RecordBatch, column: int | str, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of at most most_rows rows and about most_bytes bytes of one column; a longer value is a part by itself."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
    size = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    k = 0
    while k < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most_bytes, side="right"))
        stop = min(max(stop, k + 1), k + most_rows, batch.num_rows)
        yield batch.slice(k, stop - k)
        k = stop


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system after each batch and at its end: workers outlive their tasks, and an executor
    counts what the idle ones hold."""

    def fed(batches):
        for b in batches:
            yield b
            del b
            _release()

    def tidy(batches):
        yield from run(fed(batches))
        _release()

    return tidy


def with_made(df: DataFrame, uses: str, make: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, str]], *, keep_used: bool = True) -> DataFrame:
    """df without the columns of the names in fields (and `uses`, if it isn't kept), and with those that `make` gives for slices of
    the column `uses`.

    Rows go through Python once and flat, so no text moves twice; any names may be taken in df, dots and repeats included.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(uses)]
    through = [n for n in names if keep_used or n != at]
    made = [f"m{i}" for i in range(len(fields))]

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in through], *make(part.column(at))], [*through, *made])

    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True) if n in through]
    out = df.toDF(*names).mapInArrow(tidied(run), ", ".join([*kinds, *[f"{m} {kind}" for m, (_, kind) in zip(made, fields, strict=True)]]))
    taken = {name for name, _ in fields}
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if n in through and c not in taken], *[F.col(m).alias(name) for m, (name, _) in zip(made, fields, strict=True)])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == U64 else h.astype(U64).view(np.int64)
