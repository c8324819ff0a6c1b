"""Line dedup: range-partitioned line hashes, sorted by document, give compressed keep bitmaps for each document.

Columns only; no Python runs on the executors.

Defined results: a null or empty text is one empty line; a row is a document, known by its id and content, so repeated rows
count each and share one bitmap; of the rows that hold a key under its largest id all keep it; rows without an id take no part
and keep all lines; an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, lower_ascii

#: Documents are dealt into so many buckets before a key's rows meet, so a key arrives as at most so many rows.
SALTS = 64


def _keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    return F.transform(_lines(lower_ascii(text)), lambda x: F.btrim(x, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), text.alias("text"))


def _hashed(key: Column) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(77), key).alias("h2")]


def keepers(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, last): the keys of at least min_docs documents, each with the largest id that holds it.

    Rows are summed within each task and bucket of documents, range-partitioned by hash and sorted by document; the first
    row of each key is streamed out. A key that stands in most documents arrives as SALTS rows.
    """
    long = F.filter(_keys(F.col("text")), lambda x: F.char_length(x) >= min_chars)
    held = _named(docs, id_col, text_col).where("id is not null").select("id", "body", F.explode(F.array_distinct(long)).alias("key"))
    salted = held.select(*_hashed(F.col("key")), F.pmod("body", F.lit(SALTS)).cast("int").alias("salt"), "id")
    sums = salted.groupBy("h1", "h2", "salt").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy("h1", "h2").orderBy(F.desc("last"), "salt")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sums.repartitionByRange("h1", "h2").select("h1", "h2", "last", F.row_number().over(w).alias("nth"), F.sum("n").over(whole).alias("docs"))
    return ranked.where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", "last")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, body, words): for each document that loses lines, a map from word number to the 64-bit word of its keep bitmap.

    Words in which all lines are kept are left out, and so are documents that keep all lines; no text is returned.
    """
    last = keepers(docs, id_col, text_col, min_chars, min_docs)
    placed = F.filter(F.transform(_keys(F.col("text")), lambda x, i: F.struct(x.alias("key"), i.alias("at"))), lambda s: F.char_length(s["key"]) >= min_chars)
    lines = _named(docs, id_col, text_col).where("id is not null").select("id", "body", F.explode(placed).alias("line"))
    lines = lines.select(*_hashed(F.col("line.key")), "id", "body", F.col("line.at").alias("at"))
    gone = lines.join(last, ["h1", "h2"]).where(F.col("id") < F.col("last"))
    words = gone.groupBy("id", "body", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    return words.groupBy("id", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("words"))


def with_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(row, lines, kept): each row of docs as a struct, its lines, and those that its keep bitmap keeps."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs)
    text = F.col(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), text.alias("text"))
    joined = rows.join(maps, ["id", "body"], "left").select("row", _lines(F.col("text")).alias("lines"), "words")
    dense = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("lines") - 1, 6)), lambda i: F.coalesce(F.element_at("words", i), F.lit(-1).cast("long")))
    joined = joined.withColumn("dense", F.when(F.col("words").isNotNull(), dense))
    kept = F.filter("lines", lambda x, i: F.getbit(F.get("dense", F.shiftright(i, 6)), i % 64) == 1)
    return joined.select("row", "lines", F.when(F.col("words").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the kept lines as text; documents of which no line is kept go. A text that loses nothing stays as it is, null too."""
    out = with_kept(docs, id_col, text_col, **how).where(F.size("kept") > 0)
    same = F.size("kept") == F.size("lines")
    text = F.when(same, F.col(f"row.{text_col}")).otherwise(F.array_join("kept", "\n"))
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
