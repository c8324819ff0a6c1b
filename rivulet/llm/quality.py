"""Quality classifier by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The features of a text are its words, its pairs of neighbouring words, and character n-grams at the starts and ends of its words,
each counted as often as it stands there and hashed into 2^BITS buckets. Two smoothed multinomial models give each bucket a rate:
one of the target, which is the labelled documents of good quality that aren't toxic, one of the raw text, which is all documents.

The log weight of a text is the sum over its features of the log ratio of the two rates, over the root of their number, so that
long texts don't outweigh short ones by length alone. A log ratio counts only as far as it exceeds CERTAIN of its standard errors and
FLAT: the plain ratio of rare n-grams is noise that drowns the rest in long texts (README gives figures). Evidence counts both ways.

Texts are drawn without replacement in proportion to their weights: Gumbel noise, a fixed hash of the row, is added to the log
weight over TEMPERATURE, and the k largest keys are kept. k is the number of documents whose log weight reaches the threshold that
separates best a part of the labelled documents that the models haven't seen.

The target model, the choice of buckets and the threshold come from at most SAMPLE labelled documents, the first by hash, FIT_PARTS
of each FOLDS of them for the model. Raw counts, weights, k and the selection cover all documents. What reaches the driver is
bounded: SAMPLE labels and scores, counts of at most 2^BITS buckets, and histograms.

Defined results: a null, empty or blank text has no features and the log weight 0; without labels of both kinds in both parts of the
sample, or without documents, all are kept; rows with equal id and text have equal keys and are kept or rejected together; rows of
labels that repeat a document count as one, bad if any says so; a null in a row of labels makes it no label; ids may be of any type
and are compared as strings; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, cut, join_pairs, mix, slices, tidied, uniform, with_made

BITS = 21
SAMPLE, FOLDS, FIT_PARTS = 20_000, 4, 3
#: A bucket is judged if the sample holds it so often; how much of a log ratio is taken as chance, in standard errors and flat.
SEEN, CERTAIN, FLAT, SMOOTHING = 4, 1.0, 0.5, 1.0
TEMPERATURE = 0.03
#: Character n-grams of longer words: number for the hash, characters (bytes), and whether from the end.
GRAMS = ((1, 4, False), (2, 6, False), (3, 3, True))


def _coded(raw: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """A hash of the n bytes at each position, letters A to Z lowered."""
    code = np.full(len(at), U64(kind))
    for k in range(n):
        code = code * U64(257) + _LOWER[raw[at + k]]
    return mix(code)


_LOWER = np.arange(256, dtype=U64)
_LOWER[65:91] += U64(32)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each feature of a batch, with repeats."""
    w = Words(column, lower=True)
    doc = np.repeat(np.arange(len(w.at) - 1, dtype=np.int32), w.counts())
    found, owner = [w.hash], [doc]
    if len(doc) > 1:
        same = doc[1:] == doc[:-1]
        found.append(join_pairs(w.hash[:-1][same], w.hash[1:][same]))
        owner.append(doc[1:][same])
    size = w.end - w.start
    for kind, n, from_end in GRAMS:
        long = np.flatnonzero(size > n)
        found.append(_coded(w.raw, (w.end[long] - n) if from_end else w.start[long], n, kind))
        owner.append(doc[long])
    return np.concatenate(owner), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """The log ratios of those buckets that tell target from raw text; all others have 0."""

    buckets: np.ndarray
    ratios: np.ndarray
    _dense: np.ndarray | None = field(default=None, repr=False)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.buckets] = self.ratios
        owner, bucket = features(column)
        n = np.bincount(owner, minlength=len(column))
        return np.bincount(owner, self._dense[bucket], minlength=len(column)) / np.sqrt(np.maximum(n, 1))

    def __getstate__(self):
        return {"buckets": self.buckets, "ratios": self.ratios, "_dense": None}


def log_ratios(target: np.ndarray, raw: np.ndarray, n_target: float, n_raw: float) -> np.ndarray:
    """Smoothed log ratios of the rates, each as far as it is no chance. Raw counts are scaled to the size of the target."""
    scale = n_target / max(n_raw, 1)
    t, r = target + SMOOTHING, raw * scale + SMOOTHING
    ratio = np.log(t / r)
    error = np.sqrt(1 / t + scale / r)
    return np.sign(ratio) * np.maximum(np.abs(ratio) - CERTAIN * error - FLAT, 0.0)


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, good, fit) of at most `sample` labelled documents; fit: whether the models see it."""
    full = labels.where("doc_id is not null and quality is not null and toxic is not null")
    one = full.groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    rows = one.orderBy(F.xxhash64("doc"), "doc").limit(sample).select("doc", "good", (F.pmod(F.xxhash64(F.lit("fold"), "doc"), F.lit(FOLDS)) < FIT_PARTS).alias("fit")).collect()
    return labels.sparkSession.createDataFrame([tuple(r) for r in rows], "doc string, good boolean, fit boolean")


class _Counts:
    """Counts of buckets, gathered in steps of bounded size."""

    def __init__(self):
        self.sums, self.held, self.n = np.zeros(1 << BITS, np.int64), [], 0

    def add(self, bucket: np.ndarray) -> None:
        self.held.append(bucket)
        self.n += len(bucket)
        if self.n > 1 << 20:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            self.sums += np.bincount(np.concatenate(self.held), minlength=1 << BITS)
        self.held, self.n = [], 0
        return self.sums


def _blocks(names: list[str], columns: list[np.ndarray], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + rows]) for c in columns], names)


def target_counts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that the sample holds SEEN times or more, their counts in the target, and the number of the target's features."""

    def count(batches):
        good, every = _Counts(), _Counts()
        for b in batches:
            for part in slices(b, "text"):
                owner, bucket = features(part.column("text"))
                every.add(bucket)
                good.add(bucket[part.column("good").to_numpy(zero_copy_only=False).astype(bool)[owner]])
        sums = every.flush()
        at = np.flatnonzero(sums)
        yield from _blocks(["bucket", "good", "n"], [at, good.flush()[at], sums[at]])

    own = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(sample.where("fit")), "doc").select("text", "good")
    sums = cut(own.mapInArrow(tidied(count), "bucket bigint, good bigint, n bigint").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    total = sums.agg(F.sum("good")).first()[0] or 0
    seen = sums.where(F.col("n") >= SEEN).select("bucket", "good").toArrow().sort_by("bucket")
    return seen["bucket"].to_numpy(), seen["good"].to_numpy(), int(total)


def raw_counts(docs: DataFrame, buckets: np.ndarray, text_col: str) -> tuple[np.ndarray, int]:
    """How often all documents hold each bucket, and the number of all their features."""

    def count(batches):
        sums, total = _Counts(), 0
        for b in batches:
            for part in slices(b, "text"):
                _, bucket = features(part.column("text"))
                sums.add(bucket)
                total += len(bucket)
        found = sums.flush()[buckets]
        at = np.flatnonzero(found)
        yield from _blocks(["at", "n"], [np.append(at, len(buckets)), np.append(found[at], total)])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(tidied(count), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(buckets) + 1, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    buckets, target, n_target = target_counts(docs, sample, id_col, text_col)
    if not n_target:
        return Model(buckets[:0], np.zeros(0, np.float32))
    raw, n_raw = raw_counts(docs, buckets, text_col)
    ratio = log_ratios(target, raw, n_target, n_raw)
    told = ratio != 0
    return Model(buckets[told].astype(np.int32), ratio[told].astype(np.float32))


def _body(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _key(score, ident, body, seed: str):
    return score / TEMPERATURE - F.log(-F.log(uniform(seed, ident, body)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, seed: str = "quality") -> DataFrame:
    """(id, score, key) for each row of docs: log weight, and the key with its Gumbel noise."""
    slim = docs.select(F.col(id_col).alias("id"), _body(F.col(text_col)).alias("body"), F.col(text_col).alias("text"))
    out = with_made(slim, "text", lambda texts: [pa.array(model.scores(texts), pa.float64())], [("score", "double")])
    return out.select("id", "score", _key(F.col("score"), F.col("id"), F.col("body"), seed).alias("key"))


def threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that separates the labelled documents with the highest balanced accuracy; of equals the lowest."""
    if not good.any() or good.all():
        return -np.inf
    values = np.unique(scores)
    kept_good = 1 - np.searchsorted(np.sort(scores[good]), values) / good.sum()
    kept_bad = 1 - np.searchsorted(np.sort(scores[~good]), values) / (~good).sum()
    return float(values[np.argmax(kept_good - kept_bad)])


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value of the column `key`, by histograms of ever narrower ranges: no sort, and a bounded collect."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return -np.inf
    above = 0  # rows over the range
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if n <= few or width <= abs(high) * 1e-15:
            rows = [r[0] for r in inside.select("key").orderBy(F.desc("key")).limit(min(k - above, few)).collect()]
            return rows[-1]
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        found = {int(r[0]): (r[1], r[2], r[3]) for r in inside.groupBy(place.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for b in sorted(found, reverse=True):
            n, low, high = found[b]
            if above + n >= k:
                break
            above += n


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> tuple[Model, DataFrame, float]:
    """The model, (id, score, key) of all documents, and the key from which documents are kept."""
    chosen = labelled(labels, sample)
    model = fit(docs, chosen, id_col, text_col)
    table = cut(scored(docs, model, id_col, text_col))
    held_out = table.join(F.broadcast(chosen.where("not fit")), F.col("id").cast("string") == F.col("doc"))
    known = held_out.groupBy("doc", "good").agg(F.min("score").alias("score")).toArrow()
    least = threshold(known["score"].to_numpy(), known["good"].to_numpy().astype(bool))
    if least == -np.inf:
        return model, table, -np.inf
    return model, table, kth_largest(table, max(1, table.where(F.col("score") >= least).count()))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: str = "quality", **how) -> DataFrame:
    """The rows of docs that the sample keeps. Rows are scored where they are once more, so no text is shuffled."""
    model, _, least = select(docs, labels, id_col, text_col, **how)
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    out = with_made(docs.toDF(*names), text, lambda texts: [pa.array(model.scores(texts), pa.float64())], [("score", "double")])
    kept = out.where(_key(F.col("score"), F.col(ident), _body(F.col(text)), seed) >= F.lit(least))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
