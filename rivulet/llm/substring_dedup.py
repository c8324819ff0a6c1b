"""Substring dedup by level-wise doubling of repeated windows.

A window is `window` consecutive words of a document; each word goes that a window covers whose words also start in a document
with a smaller id. Windows are judged on the input.

The levels double: runs of RUN words, of twice as many, and so on, at last the windows themselves (4, 8, 13). At each level the run
of a window is that of the level's length with the smallest hash inside the window, which is the same wherever the window stands;
so a level has few distinct runs. A window goes on to the next level only if another document holds its run as well, until none
survives or the windows themselves are judged; a repeat longer than a window is a union of windows, so no level beyond is needed.

Level 1 is sent out as runs of documents without windows. What survives it is extended in the documents: each window that is left
sends its runs of all further levels at once, dealt by the first of them. The levels then are nested groups of the same rows: rows
are grouped by the first run, survivors by the first and the second, and so on, so these levels need one shuffle together, and
two windows are taken as equal only if all their runs are.

Copies of a whole text are settled by 128 bits of the text's hash: all their words go but for the smallest id, and only that one
goes through the levels. Very common runs (in one document of HOT_SHARE in a task) are found first, within bounded memory. They
skip level 1, being repeated anyway. At the later levels the rows of a passage that very many documents hold meet in one sorted
group; it is streamed and spills, but it isn't split.

Defined results: a null or empty text has no words; rows with one id are one document, so their windows don't remove each other;
rows without an id take no part and lose nothing; documents shorter than a window lose nothing; an empty table gives an empty
result; ids may be of any type that has an order; other columns aren't returned. Runs are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Words, cut, grams, lists, signed, slices
from .graph import lookup

WINDOW, RUN = 13, 4


def lengths(window: int, run: int) -> list[int]:
    """The levels' lengths after the first, the window at last."""
    out = []
    while run * 2 < window:
        run *= 2
        out.append(run)
    return [*out, window]


#: A run is very common if so many of a task's documents, and this share of them, hold it, and if half this share of all does.
HOT_LEAST, HOT_SHARE = 48, 0.002


def run_hashes(w: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that stay inside a text, and for each the smallest hash of the runs in it."""
    starts = np.flatnonzero(w.room() >= window)
    if not len(starts):
        return starts, np.zeros(0, U64)
    g = grams(w.hash, run)
    low, n, size = g, window - run + 1, 1
    while size * 2 <= n:  # running minimum over n entries by doubling
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < n:
        low = np.minimum(low[: len(g) - n + 1], low[n - size : n - size + len(g) - n + 1])
    return starts, low[starts]


def _distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how many each has."""
    if not len(h):
        return h, np.zeros(n_docs, np.int64)
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[keep], np.bincount(doc[keep], minlength=n_docs)


def _runs(part: pa.RecordBatch, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(part.column("text"))
    starts, low = run_hashes(w, window, run)
    doc = np.repeat(np.arange(part.num_rows), w.counts())[starts]
    return _distinct(doc, low, part.num_rows)


def hot_runs(texts: DataFrame, window: int, run: int) -> np.ndarray:
    """Sorted hashes of runs that very many documents hold; at most (runs of a document) / (HOT_SHARE / 2) of them."""

    def count(batches):
        seen: list[np.ndarray] = []
        n = held = 0
        for b in batches:
            for part in slices(b, "text"):
                h, _ = _runs(part, window, run)
                seen.append(h)
                n += part.num_rows
                held += len(h)
                if held > 1 << 20:
                    yield frequent(seen, n)
                    seen, n, held = [], 0, 0
        if seen:
            yield frequent(seen, n)

    def frequent(seen, n):
        h, times = np.unique(np.concatenate(seen), return_counts=True)
        often = times >= max(HOT_LEAST, HOT_SHARE * n)
        return pa.RecordBatch.from_arrays([pa.array(np.append(signed(h[often]), 0)), pa.array(np.append(times[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), n))], ["h", "n", "docs"])

    sums = cut(texts.select("text").mapInArrow(count, "h bigint, n bigint, docs bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    docs = sums.agg(F.sum("docs")).first()[0] or 0
    rows = sums.where((F.col("n") > 0) & (F.col("n") >= HOT_SHARE / 2 * docs)).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(rows.view(U64))


def survivors(texts: DataFrame, window: int, run: int, hot: np.ndarray) -> DataFrame:
    """(body, runs): for each distinct text the hashes of its runs that other texts hold as well; hot: runs that are known to be."""

    def spread(batches):
        for b in batches:
            for part in slices(b, "text"):
                h, counts = _runs(part, window, run)
                common = np.isin(h, hot)
                owner = np.repeat(np.arange(part.num_rows), counts)
                rare = lists(signed(h[~common]), np.bincount(owner[~common], minlength=part.num_rows), pa.int64())
                often = lists(signed(h[common]), np.bincount(owner[common], minlength=part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("body"), rare, often], ["body", "rare", "often"])

    # a text is hashed in each of its copies; only rows of the first id are wanted later, so copies do no harm here
    held = texts.select("body", "text").mapInArrow(spread, "body bigint, rare array<bigint>, often array<bigint>")
    every = held.select("body", F.explode(F.concat(F.transform("rare", lambda x: F.struct(x.alias("h"), F.lit(False).alias("hot"))), F.transform("often", lambda x: F.struct(x.alias("h"), F.lit(True).alias("hot"))))).alias("r")).select("body", "r.h", "r.hot")
    w = Window.partitionBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = every.where("not hot").select("h", "body").select("h", "body", F.min("body").over(w).alias("low"), F.max("body").over(w).alias("high")).where("low < high").select("body", "h")
    return rare.unionByName(every.where("hot").select("body", "h")).groupBy("body").agg(F.collect_set("h").alias("runs"))


def _packed(texts: DataFrame) -> DataFrame:
    """(id, body, z): texts compressed before they are shuffled."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for part in slices(b, "text"):
                z = [squeeze.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("body"), pa.array(z, pa.binary())], ["id", "body", "z"])

    return texts.select("id", "body", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, body bigint, z binary")


def _unpacked(column: pa.Array) -> pa.Array:
    loose = zstandard.ZstdDecompressor()
    return pa.array([loose.decompress(z).decode() for z in column.to_pylist()], pa.large_string())


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), F.xxhash64(F.lit("second"), text).alias("body2"), F.col(text_col).alias("text"))


def live_windows(texts: DataFrame, wanted: DataFrame, window: int, run: int) -> DataFrame:
    """(id, l1, l2, ...): for each distinct window that survives level 1 its runs of the further levels, the window's hash last."""
    kind = dict(texts.dtypes)["id"]
    sizes = lengths(window, run)
    names = [f"l{k + 1}" for k in range(len(sizes))]

    def extend(batches):
        for b in batches:
            for part in slices(b, "z", 1 << 19):
                w = Words(_unpacked(part.column("z")))
                starts, low = run_hashes(w, window, run)
                doc = np.repeat(np.arange(part.num_rows), w.counts())[starts]
                live = np.zeros(len(starts), bool)
                runs = part.column("runs")
                values, ends = runs.flatten().to_numpy(), np.cumsum(runs.value_lengths().to_numpy())
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for d in range(part.num_rows):
                    own = slice(edge[d], edge[d + 1])
                    live[own] = np.isin(signed(low[own].copy()), values[ends[d - 1] if d else 0 : ends[d]])
                if not live.any():
                    continue
                doc = doc[live]
                levels = [run_hashes(w, window, n)[1][live] for n in sizes]
                order = np.lexsort((levels[-1], doc))
                h, d = levels[-1][order], doc[order]
                order = order[np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])]
                for k in range(0, len(order), 100_000):
                    at = order[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc[at])), *[pa.array(signed(x[at])) for x in levels]], ["id", *names])

    rows = _packed(texts).join(wanted, ["id", "body"]).dropDuplicates(["id", "body"])
    return rows.mapInArrow(extend, f"id {kind}, {', '.join(n + ' bigint' for n in names)}")


def repeated_windows(rows: DataFrame, names: list[str]) -> DataFrame:
    """(id, h): of the windows (id, *names), those that a smaller id holds as well, level by level."""
    for k in range(1, len(names) + 1):
        w = Window.partitionBy(*names[:k]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = k == len(names)
        rows = rows.select("id", *names, F.min("id").over(w).alias("low"), *([] if last else [F.max("id").over(w).alias("high")]))
        rows = rows.where("id > low" if last else "low < high").select("id", *names)
    return rows.select("id", F.col(names[-1]).alias("h"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(id, copies, windows): for documents that lose words, the hashes of their texts that go as a whole, and of the windows that go."""
    texts = _bodies(docs, id_col, text_col).where("id is not null and text is not null")
    ids = cut(texts.select("id", "body", "body2"))
    first = ids.groupBy("body", "body2").agg(F.min("id").alias("first"))
    copies = lookup(ids, ["body", "body2"], first).where("id > first").groupBy("id").agg(F.collect_set("body").alias("copies"))
    hot = hot_runs(texts, window, run)
    wanted = survivors(texts, window, run, hot).join(first.select("body", F.col("first").alias("id")), "body").select("id", "body", "runs")
    rows = live_windows(texts, wanted, window, run)
    gone = repeated_windows(rows, [c for c in rows.columns if c != "id"])
    gone = gone.groupBy("id").agg(F.collect_list("h").alias("windows"))
    return copies.join(gone, "id", "full")


def kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's kept words joined by blanks; with digest their SHA-256 instead."""
    texts = _bodies(docs, id_col, text_col).drop("body2")
    kind = dict(texts.dtypes)["id"]

    def strip(batches):
        for b in batches:
            for part in slices(b, "z", 1 << 19):
                w = Words(_unpacked(part.column("z")))
                n = len(w.hash)
                starts = np.flatnonzero(w.room() >= window)
                doc = np.repeat(np.arange(part.num_rows), w.counts())
                edge = np.searchsorted(doc[starts], np.arange(part.num_rows + 1))
                bad = np.zeros(len(starts), bool)
                full = signed(grams(w.hash, window)[starts]) if len(starts) else np.zeros(0, np.int64)
                body, copies, gone = part.column("body"), part.column("copies"), part.column("windows")
                for d in range(part.num_rows):
                    own = slice(edge[d], edge[d + 1])
                    if copies[d].is_valid and body[d].as_py() in copies[d].values.to_numpy():
                        bad[own] = True
                    elif gone[d].is_valid:
                        bad[own] = np.isin(full[own], gone[d].values.to_numpy())
                change = np.zeros(n + window + 1, np.int64)
                change[starts[bad]] += 1
                change[starts[bad] + window] -= 1
                keep = np.cumsum(change)[:n] == 0
                out = []
                raw = w.raw.tobytes()
                for d in range(part.num_rows):
                    a, e = w.first[d], w.first[d + 1]
                    k = np.flatnonzero(keep[a:e]) + a
                    text = b" ".join([raw[s:t] for s, t in zip(w.start[k].tolist(), w.end[k].tolist(), strict=True)])
                    out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                words = w.counts()
                left = np.bincount(doc, keep, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(words - left), pa.array(out, pa.string())], ["id", "n_words", "n_removed", "kept"])

    what = decisions(docs, id_col, text_col, window=window, run=run)
    packed = _packed(texts)
    named = packed.where("id is not null").join(what, "id", "left")  # rows without an id stay where they are
    nameless = packed.where("id is null").withColumns({"copies": F.lit(None).cast("array<bigint>"), "windows": F.lit(None).cast("array<bigint>")})
    return named.unionByName(nameless).mapInArrow(strip, f"id {kind}, n_words bigint, n_removed bigint, kept string")
