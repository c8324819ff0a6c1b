"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget. Complete epochs come first: every document of the source is taken as often as the budget holds
the whole source. The rest is a weighted sample without replacement: documents are taken in the order of exponential keys
-ln(u) / weight, u being a fixed hash of the document, until the running sum of their sizes reaches what is left; the document
at the edge counts with the words that still fit.

The running sum over a source, which may hold most rows, goes over two levels of RANGES key ranges, so no task sorts a whole
source: only the documents of one range in RANGES * RANGES are ranked one by one. What comes out is one row for each source
(epochs, the key at the edge, the words that fit there), and each document is then decided where it is.

Defined results: a null source is a source of its own, last in order; a null text has size 0; repeated rows are separate
documents, and at the edge equal rows share what fits; an empty table gives an empty result; other columns pass through
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, uniform

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096
#: The table of sources is broadcast up to so many rows; beyond it Spark joins as it sees fit.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: grows with the share of letters and blanks among the characters."""
    odd = F.char_length(F.regexp_replace(text, r"[\p{L} \n]+", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.9) * odd / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.1))


def sampling_key(id_: Column, text: Column, weight: Column, seed: str) -> Column:
    return -F.log(uniform(seed, id_, F.md5(F.coalesce(text, F.lit("")).cast("binary")))) / weight


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(per_source: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with target; one row for each source, so one task orders them.

    Weights repeat over the sources in code point order. No source gets more than cap times its size, and what it can't take
    goes to the others by weight: target = min(cap * size, level * weight). Sources are filled up in the order in which they
    get full; the level is the highest of those that leave the source it is computed at unfilled.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    s = per_source.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    earlier = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    s = s.withColumn("at", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("at") * F.col("w") <= F.col("most"), F.col("at"))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def edges(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(s, source_size, target, epochs, edge, fits): one row for each source of sized (source, s, size, key)."""
    goals = targets(sized.groupBy("source", "s").agg(F.sum("size").alias("source_size")).select("source", "source_size"), weights, share, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    goals = cut(goals.select(_source_key(F.col("source")).alias("s"), "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    small = (lambda df: F.broadcast(df)) if goals.count() <= BROADCAST_SOURCES else (lambda df: df)

    place = (F.lit(1.0) - F.exp(-F.col("key"))) * RANGES
    keys = sized.select("s", "size", "key", F.least(F.floor(place), F.lit(RANGES - 1)).cast("int").alias("r1"), place.alias("place"))
    keys = keys.withColumn("r2", F.floor((F.col("place") - F.col("r1")) * RANGES).cast("int")).drop("place")

    def find(rows: DataFrame, by: str, at: DataFrame, extra: list[Column]) -> DataFrame:
        """The value of `by` where the running sum of a source passes what is left."""
        w = Window.partitionBy("s").orderBy(by)
        sums = rows.groupBy("s", by).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        run = sums.withColumn("before", F.sum("size").over(w) - F.col("size")).join(small(at), "s")
        here = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))
        return run.where(here).select("s", by, (F.col("rest") - F.col("before")).alias("rest"), *extra)

    open_ = goals.where("rest > 0").select("s", "rest")
    first = find(keys, "r1", open_, [])
    second = find(keys.join(small(first), ["s", "r1"]).select("s", "r2", "size", "key", "r1"), "r2", first.select("s", "rest"), []).join(first.select("s", "r1"), "s")
    third = find(keys.join(small(second), ["s", "r1", "r2"]).select("s", "size", "key"), "key", second.select("s", "rest"), [F.col("rows")])
    edge = third.select("s", F.col("key").alias("edge"), F.floor(F.col("rest") / F.col("rows")).cast("bigint").alias("fits"))
    return goals.join(edge, "s", "left").select("s", "source_size", "target", "epochs", "edge", "fits")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", weight: Column | None = None, keep_rows: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs; with keep_rows also `epochs`, the complete epochs of its
    source, and `row`, the whole row as a struct.

    taken counts the words of the document that the mix takes, repeats included. weight: the quality weight of a document,
    above 0; the share of letters by default.
    """
    text = F.col(text_col)
    key = sampling_key(F.col(id_col), text, quality_weight(text) if weight is None else weight, seed)
    slim = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("s"), n_words(text).alias("size"), key.alias("key")]
    sized = cut(docs.select(*slim))
    per_source = cut(edges(sized, weights, share, cap))
    rows = docs.select(F.struct("*").alias("row"), *slim) if keep_rows else sized
    joined = rows.join(F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source, "s")
    part = F.when(F.col("edge").isNull() | (F.col("key") > F.col("edge")), F.lit(0)).when(F.col("key") < F.col("edge"), F.col("size")).otherwise(F.least("fits", "size"))
    return joined.select("id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), *(["epochs", "row"] if keep_rows else []))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it is taken whole, and once more if at least half of the rest is taken.

    A document without words comes with each complete epoch of its source; a source of such documents only has no epoch and goes.
    """
    taken = mix(docs, keep_rows=True, **how)
    times = F.coalesce(F.round(F.col("taken") / F.nullif(F.col("size"), F.lit(0))), F.col("epochs")).cast("int")
    copies = taken.where(times >= 1).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return copies.select("row.*")
