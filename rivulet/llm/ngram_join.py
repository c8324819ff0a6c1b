"""N-gram Jaccard join: a size-aware heavy-light join of word shingle sets, and its connected components.

Equal sets are one node, known by its smallest document. Nodes that can link to others (see below) give keys, so that any two
that link have a key in common:

* both kinds: the hash range is cut into parts, so many that two sets of a size class that link have some parts alike, whatever
  D shingles they differ by.
* light sets, up to a boundary size: all subsets of a fixed number of parts. With D + LIGHT_PARTS parts at least LIGHT_PARTS are
  alike, so subsets of that many meet; each covers a large share of the set, and a line or passage that is common by itself is
  no such subset.
* heavy sets: inverted lists of single parts, D + 1 of them and some more. A list holds the sets with one and the same content
  of one part, which are near copies; a common shingle alone makes no list.

Sets near the boundary give both kinds of keys, sets near the end of a size class those of two classes, and sets with more empty
parts than planned also plain prefix lists among themselves; so do light sets whose shingles lie in D parts or fewer.

The boundary is the size at which the two together give the fewest keys, from the counts of all sizes.

A list is never expanded into its pairs. Its most central member (the one whose other lists are longest) is its pivot; each
node is compared with the pivot it shares most lists with, which joins near copies into components at once. Then the lists that
still hold several components are compared with their other pivots, and at last, across components only, with each other. Before
sets are fetched, and inside the join that makes them (long lists meet there in pairs of blocks, so none is one task), pairs must agree in size and in a sketch: the number of slots of the hash
range whose contents differ, by a few bits of each, may not be over the number of shingles by which the two may differ. Then they
must have as many lists in common as these leave. Both are certain: no link is lost.
Comparisons are exact intersections of 64-bit shingle hashes.

Before all this, nodes of SCREENED shingles or more that hardly can have a partner are put aside: of the shingles in the lowest
sixteenth of the hash range, a set that links shares about t with one other set. Every set that can be a partner of a screened one
shows its shingles there, those under SCREENED too. A set goes where so few of its L stand in any other set at all that Hoeffding's
bound exp(-L * KL(seen / L, t)), which holds for draws without replacement, is MISSED or less. So the screen is not certain: for
random hashes a set that links is put aside with a chance of at most MISSED. Sets with too few low shingles for that all stay.

Defined results: documents without words have an empty set and link with nothing; a text of fewer words than a shingle is one
shingle; a null id links with nothing; rows that repeat an id and text count once, and rows that share only an id are one node
only where their sets are equal; ids may be of any type that has an order; an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, cut_off, grams, lists, mix, signed, slices, tidied
from .graph import components

LIGHT_PARTS, LARGEST_BOUNDARY, CLASS_RATIO = 3, 40, 1.4
SCREENED, MISSED = 160, 1e-12
#: Rows up to which a table of ids is broadcast.
BROADCAST_ROWS = 500_000
_TAG_PART, _TAG_INDEX, _TAG_SUBSET, _TAG_PREFIX = U64(0x8CB92BA72F3D8DD7), U64(0xE7037ED1A0B428DB), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F)


class Limits:
    """Sizes that follow from the threshold num / den."""

    def __init__(self, num: int, den: int):
        g = math.gcd(num, den)
        self.num, self.den = num // g, den // g

    def apart(self, total: int) -> int:
        """Shingles by which two sets of `total` shingles together can differ and still link."""
        return total * (self.den - self.num) // (self.den + self.num)

    def smallest(self) -> int:
        """The smallest size with a partner that isn't equal."""
        n = 1
        while self.apart(n + n * self.den // self.num) < 1:
            n += 1
        return n

    def share(self, n):
        """Shingles of a set of n that a partner holds at least."""
        return -(-n * self.num // self.den)

    def class_of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(_CLASS_STARTS, n, side="right") - 1

    def differ(self, cls: np.ndarray) -> np.ndarray:
        """Shingles by which two sets of a size class can differ and still link."""
        return 2 * (_CLASS_STARTS[cls + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def parts(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the hash range for a size class, and how many of them may be empty; no parts if no two sets of the class can differ."""
        d = self.differ(cls)
        spare = -(-(d + 1) // 20) + 2
        return np.where(d > 0, d + 1 + spare, 0), spare


_CLASS_STARTS = np.unique(np.floor(CLASS_RATIO ** np.arange(2, 110)).astype(np.int64))
_CLASS_STARTS = np.concatenate([np.arange(1, _CLASS_STARTS[0]), _CLASS_STARTS])


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each text has."""
    w = Words(column, lower=True)
    n_docs, counts = len(w.at) - 1, w.counts()
    starts = np.flatnonzero(w.room() >= k)
    doc = np.repeat(np.arange(n_docs), counts)
    h = grams(w.hash, k)[starts] if len(starts) else np.zeros(0, U64)
    owner = doc[starts]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([mix(grams(w.hash[w.first[d] : w.first[d + 1]], int(counts[d])) + U64(counts[d]))[0] for d in short], U64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[keep], owner[keep]
    return h, np.bincount(owner, minlength=n_docs)


def boundary(sizes: dict[int, int], lim: Limits) -> int:
    """The size up to which sets are light: the one with the fewest keys in all. sizes: numbers of sets by size, up to LARGEST_BOUNDARY."""

    def by_subsets(n):
        d = int(lim.differ(lim.class_of(np.array([n])))[0])
        return math.comb(d + LIGHT_PARTS, LIGHT_PARTS)

    def by_parts(n):
        return int(lim.parts(lim.class_of(np.array([n])))[0][0])

    def cost(x):
        total = 0
        for n, count in sizes.items():
            if n <= x:
                total += count * by_subsets(n)
            if n > x or n * lim.den >= lim.num * (x + 1):
                total += count * by_parts(n)
        return total

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def keys(h: np.ndarray, counts: np.ndarray, lim: Limits, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set, the size class of each key (-1 for all but single parts), and how many keys each set has; h is sorted within each set."""
    first = np.concatenate([[0], np.cumsum(counts)])
    found, classes, owners = [], [], []
    mixed = mix(h)
    cls = lim.class_of(np.maximum(counts, 1))
    some = counts >= lim.smallest()
    heavy = some & ((counts > x) | (counts * lim.den >= lim.num * (x + 1)))
    owner = np.repeat(np.arange(len(counts)), counts)
    for step in (0, 1):
        near_end = counts * lim.den >= lim.num * _CLASS_STARTS[cls + 1]
        n_parts, spare = lim.parts(cls + step)
        own = heavy & (n_parts > 0) & (near_end | (step == 0))
        doc, at, sums, part = _contents(h, mixed, owner, np.flatnonzero(own[owner]), n_parts)
        tag = (cls[doc] + step).astype(U64) * _TAG_PART
        found.append(mix(sums + tag + part * _TAG_INDEX))
        classes.append(cls[doc] + step)
        owners.append(doc)
        filled = np.bincount(doc, minlength=len(counts))
        for d in np.flatnonzero(own & (n_parts - filled > spare)):
            prefix = h[first[d] : first[d] + counts[d] - lim.share(int(counts[d])) + 1]
            found.append(mix((prefix ^ _TAG_PREFIX) + np.array([int(cls[d]) + step], U64) * _TAG_PART))
            classes.append(np.full(len(prefix), -1))
            owners.append(np.full(len(prefix), d))
        d_max = np.where(some & (counts <= x) & (near_end | (step == 0)), lim.differ(cls + step), 0)
        for d in np.unique(d_max[d_max > 0]):
            group = np.flatnonzero(d_max == d)
            p = int(d) + LIGHT_PARTS
            doc, at, sums, part = _contents(h, mixed, owner, np.flatnonzero((d_max == d)[owner]), np.full(len(counts), p))
            grid = np.zeros((len(counts), p), U64)  # an empty part counts as a part with content 0
            grid[doc, part.astype(np.int64)] = mix(sums)
            chosen = np.array(list(combinations(range(p), LIGHT_PARTS)))
            picked = grid[group][:, chosen]
            place = mix(chosen.astype(U64) + U64(1))
            light = mix((picked * (place | U64(1))[None, :, :]).sum(axis=2, dtype=U64) + np.arange(len(chosen), dtype=U64)[None, :] * _TAG_INDEX + (cls[group] + step).astype(U64)[:, None] * _TAG_PART + _TAG_SUBSET)
            filled_parts = (picked != 0).sum(axis=2)
            real = filled_parts > 0
            found.append(light[real])
            classes.append(np.full(int(real.sum()), -1))
            owners.append(np.repeat(group, real.sum(axis=1)))
            for s in group[(grid[group] != 0).sum(axis=1) <= d]:  # all of its shingles may be in parts that differ
                prefix = h[first[s] : first[s] + counts[s] - lim.share(int(counts[s])) + 1]
                found.append(mix((prefix ^ _TAG_PREFIX ^ _TAG_SUBSET) + np.array([int(cls[s]) + step], U64) * _TAG_PART))
                classes.append(np.full(len(prefix), -1))
                owners.append(np.full(len(prefix), s))
    key, kind, who = np.concatenate(found), np.concatenate(classes), np.concatenate(owners).astype(np.int64)
    order = np.argsort(who, kind="stable")
    return key[order], kind[order].astype(np.int32), np.bincount(who, minlength=len(counts))


def _contents(h, mixed, owner, rows, n_parts):
    """For the non-empty parts of the sets that own rows: set, first row, sum of the mixed shingles, and number of the part."""
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(0, U64)
    doc = owner[rows]
    part = ((h[rows] >> U64(32)) * n_parts[doc].astype(U64)) >> U64(32)
    at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[at], at, np.add.reduceat(mixed[rows], at), part[at]


#: A sketch has PLANES bits for each of SLOTS slots of the hash range, in words of 64 bits.
SLOTS, PLANES = 256, 4
SKETCH_WORDS = SLOTS * PLANES // 64


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PLANES bits of the content of each slot of each set. Slots whose bits differ differ in a shingle at least, so two sets
    differ by as many shingles at least as slots have different bits."""
    out = np.zeros((len(counts), SKETCH_WORDS), U64)
    owner = np.repeat(np.arange(len(counts)), counts)
    doc, _, sums, slot = _contents(h, mix(h ^ _TAG_SUBSET), owner, np.arange(len(h)), np.full(len(counts), SLOTS))
    bits = mix(sums)
    for p in range(PLANES):
        word = (slot >> U64(6)).astype(np.int64) + p * (SLOTS // 64)
        np.bitwise_or.at(out, (doc, word), ((bits >> U64(p)) & U64(1)) << (slot & U64(63)))
    return out


def _parts(batch: pa.RecordBatch, n: int):
    for k in range(0, batch.num_rows, n):
        yield batch.slice(k, n)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    """df, as a broadcast if it has few rows."""
    return F.broadcast(df) if _few(df) else df


def sizes_and_digests(texts: DataFrame, k: int, lim: Limits) -> DataFrame:
    """(id, body, n, hi, lo, low): size and 128-bit digest of each row's set, and its shingles in the lowest sixteenth of the range
    if it is screened or can be a partner of a screened one."""
    shown = lim.share(SCREENED)

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                h, counts = shingle_sets(part.column("text"), k)
                at = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(h ^ t), dtype=U64)]) for t in (_TAG_PART, _TAG_INDEX)]
                hi, lo = (mix(s[at[1:]] - s[at[:-1]] + counts.astype(U64)) for s in sums)
                owner = np.repeat(np.arange(part.num_rows), counts)
                low = (h < U64(1 << 60)) & (counts >= shown)[owner]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("body"), pa.array(counts), pa.array(signed(hi)), pa.array(signed(lo)), lists(signed(h[low]), np.bincount(owner[low], minlength=part.num_rows), pa.int64())], ["id", "body", "n", "hi", "lo", "low"])

    return texts.select("id", "body", "text").mapInArrow(tidied(run), f"id {dict(texts.dtypes)['id']}, body bigint, n bigint, hi bigint, lo bigint, low array<bigint>")


def screen(nodes: DataFrame, lim: Limits) -> DataFrame:
    """(node, body, n) of the nodes that may have a partner."""
    t = lim.num / lim.den
    rows = nodes.where(F.size("low") > 0).select("node", F.explode("low").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1").select("h")
    seen = rows.join(shared, "h").groupBy("node").agg(F.count("*").alias("seen"))
    size, joint = F.col("size"), F.coalesce("seen", F.lit(0))
    x = joint / F.nullif(size, F.lit(0))
    far = joint * F.log(F.nullif(x, F.lit(0.0)) / t)  # null, taken as 0, where none is seen
    apart = F.coalesce(far, F.lit(0.0)) + F.coalesce((size - joint) * F.log(F.nullif(1 - x, F.lit(0.0)) / (1 - t)), F.lit(0.0))
    hopeless = (F.col("n") >= SCREENED) & (joint < t * size) & (apart >= -math.log(MISSED))
    some = nodes.where(F.col("n") >= lim.smallest()).select("node", "body", "n", F.size("low").alias("size"))
    return some.join(seen, "node", "left").where(~hopeless).select("node", "body", "n")


def _sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, sh): sorted shingle hashes of the wanted nodes; texts are compressed before they are shuffled."""
    kind = dict(texts.dtypes)["id"]

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for part in slices(b, "text"):
                z = [squeeze.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("body"), pa.array(z, pa.binary())], ["id", "body", "z"])

    def run(batches):
        loose = zstandard.ZstdDecompressor()
        for b in batches:
            for part in slices(b, "z", 1 << 19):
                texts_ = pa.array([loose.decompress(z).decode() for z in part.column("z").to_pylist()], pa.large_string())
                h, counts = shingle_sets(texts_, k)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), lists(signed(h), counts, pa.int64())], ["node", "n", "sh"])

    packed = texts.select("id", "body", "text").mapInArrow(tidied(pack), f"id {kind}, body bigint, z binary")
    ids = wanted.select(F.col("node").alias("id"), "body")
    return packed.join(_small(ids), ["id", "body"], "left_semi").dropDuplicates(["id", "body"]).mapInArrow(tidied(run), f"node {kind}, n bigint, sh array<bigint>")


def _keys(sets: DataFrame, lim: Limits, x: int) -> DataFrame:
    """(node, n, sketch words, keys, classes)."""
    kind = dict(sets.dtypes)["node"]
    words = [f"s{k}" for k in range(SKETCH_WORDS)]

    def run(batches):
        for b in batches:
            for part in _parts(b, 200):
                counts, h = part.column("n").to_numpy(), part.column("sh").flatten().to_numpy().view(U64)
                key, cls, each = keys(h, counts, lim, x)
                bits = signed(sketches(h, counts))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), *[pa.array(bits[:, k].copy()) for k in range(SKETCH_WORDS)], lists(signed(key), each, pa.int64()), lists(cls, each, pa.int32())], ["node", "n", *words, "keys", "classes"])

    return sets.mapInArrow(tidied(run), f"node {kind}, n bigint, {', '.join(w + ' bigint' for w in words)}, keys array<bigint>, classes array<int>")


def _compare(pairs: DataFrame, sets: DataFrame, lim: Limits) -> DataFrame:
    """Those of pairs (a, b) that link."""
    kind = dict(sets.dtypes)["node"]
    pairs = cut_off(pairs)

    def run(batches):
        for batch in batches:
            for part in _parts(batch, 500):
                sa, sb = part.column("sa"), part.column("sb")
                ok = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = lim.den * both >= lim.num * (len(x) + len(y) - both)
                hit = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(hit), part.column("b").filter(hit)], ["a", "b"])

    # the side with fewer distinct sets is met last, so that the others move only once
    seconds = pairs.select("b").distinct()
    if _few(pairs):  # then of the second ones there are few as well
        pairs, seconds = F.broadcast(pairs), F.broadcast(seconds)
    else:
        seconds = _small(seconds)
    left = sets.join(pairs, F.col("node") == F.col("a")).select("a", "b", F.col("sh").alias("sa"))
    right = sets.join(seconds, F.col("node") == F.col("b"), "left_semi").select(F.col("node").alias("b"), F.col("sh").alias("sb"))
    return left.join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidied(run), f"a {kind}, b {kind}")


def node_links(texts: DataFrame, nodes: DataFrame, k: int, lim: Limits) -> DataFrame:
    """Links (a, b) that connect the nodes which links connect."""
    wanted = cut_off(screen(nodes, lim))
    sizes = {int(r[0]): r[1] for r in wanted.where(F.col("n") <= LARGEST_BOUNDARY).groupBy("n").count().collect()}
    sets = cut_off(_sets(texts, wanted, k))
    made = cut_off(_keys(sets, lim, boundary(sizes, lim)))
    rows = made.select("node", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("classes").alias("cls"))).alias("k")).select("node", "k.key", "k.cls")
    shared = rows.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key")
    listed = cut_off(rows.join(shared, "key").select("key", "node", "cls"))
    weight = listed.groupBy("node").agg(F.count("*").alias("weight"))
    pivot = listed.select("key", "node").join(weight, "node").groupBy("key").agg(F.min(F.struct(F.negative("weight").alias("weight"), "node")).alias("top")).select("key", F.col("top.node").alias("pivot"))
    met = listed.join(pivot, "key").where("node <> pivot")
    filled = F.map_from_entries(F.transform(F.array_distinct("classes"), lambda c: F.struct(c, F.size(F.filter("classes", lambda d: d == c)))))
    facts = made.select("node", "n", *[f"s{k}" for k in range(SKETCH_WORDS)], filled.alias("filled"))

    def likely(counted: DataFrame) -> DataFrame:
        """Those of (a, b, cls, k), k lists in common by class, that sizes, sketches and numbers of lists allow; (a, b, k)."""
        i, j = (facts.select(F.col("node").alias(c), *[F.col(f).alias(f"{f}_{c}") for f in facts.columns if f != "node"]) for c in "ab")
        both = counted.join(i, "a").join(j, "b")
        apart = F.floor((F.col("n_a") + F.col("n_b")) * F.lit(lim.den - lim.num) / F.lit(lim.den + lim.num))
        enough = (F.col("cls") < 0) | (F.col("k") >= F.greatest(F.element_at("filled_a", F.col("cls")), F.element_at("filled_b", F.col("cls"))) - apart)
        return both.where(_alike(lim) & enough).groupBy("a", "b").agg(F.sum("k").alias("k"))

    common = cut_off(likely(met.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b"), "cls").agg(F.count("*").alias("k"))))
    best = common.groupBy("a").agg(F.min(F.struct(F.negative("k").alias("k"), "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    links = cut_off(_compare(best, sets, lim))

    named = cut_off(components(links)).withColumnsRenamed({"component": "group"})

    def grouped(df, column, out):
        return df.join(named.select(F.col("node").alias(column), F.col("group").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.col(column)))

    others = grouped(grouped(common.select("a", "b"), "a", "ga"), "b", "gb").where("ga <> gb").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = cut_off(_compare(others, sets, lim))
    links = links.unionByName(more)
    if not more.isEmpty():
        named = cut_off(components(links)).withColumnsRenamed({"component": "group"})
    held = grouped(listed, "node", "group")
    mixed = held.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("members")).where("low < high").select("key", "members")
    left = _dealt(cut_off(held.join(mixed, "key").join(facts.drop("filled"), "node")))
    meet = ("key", "i", "j")
    # both sides have the same columns, so that the members are shuffled once
    a, b = (left.select(*[F.col(f).alias(c if f == "node" else f"{f}_{c}") for f in left.columns]) for c in "ab")
    once = (F.col("i_a") == F.col("j_a")) | (F.col("own_a") != F.col("own_b"))
    same = [F.col(f"{f}_a") == F.col(f"{f}_b") for f in meet]
    across = a.join(b, same[0] & same[1] & same[2] & once & (F.col("group_a") < F.col("group_b")) & _alike(lim)).groupBy("a", "b", F.col("cls_a").alias("cls")).agg(F.count("*").alias("k"))
    tried = common.select("a", "b").unionByName(common.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return links.unionByName(_compare(likely(across).select("a", "b").join(tried, ["a", "b"], "left_anti"), sets, lim))


#: Members of a list that meet in one task; of lists over that, as many as the root of BLOCK times their length.
BLOCK = 512


def _dealt(members: DataFrame) -> DataFrame:
    """The members of lists (key, node, ...; the length as `members`, if it is known) dealt into blocks, once for each pair (i, j) of blocks that theirs, `own`, is in.

    A list has the root of its length over BLOCK as blocks: a member is copied once for each block, so with blocks of a fixed size
    the copies, which are shuffled, would grow with the square of a list. So they grow with the power 1.5, and a pair of blocks in proportion.
    """
    if "members" not in members.columns:
        members = members.join(members.groupBy("key").agg(F.count("*").alias("members")), "key")
    blocks = F.ceil(F.sqrt(F.col("members") / BLOCK)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    return own.withColumn("pair", F.explode(pairs)).select(*[c for c in members.columns if c != "members"], "own", "pair.i", "pair.j")


def _alike(lim: Limits):
    """Whether sizes and sketches of a and b allow a link."""
    words = SLOTS // 64
    bits = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for p in range(PLANES):
            differ = differ.bitwiseOR(F.col(f"s{p * words + w}_a").bitwiseXOR(F.col(f"s{p * words + w}_b")))
        bits = bits + F.bit_count(differ)
    apart = F.floor((F.col("n_a") + F.col("n_b")) * F.lit(lim.den - lim.num) / F.lit(lim.den + lim.num))
    return (F.col("n_a") * lim.den >= F.col("n_b") * lim.num) & (F.col("n_b") * lim.den >= F.col("n_a") * lim.num) & (bits <= apart)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """(id, body, n, component) for each row of docs: size of its shingle set and the smallest id that links reach."""
    lim = Limits(*threshold)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.col(text_col).alias("text"))
    base = cut_off(sizes_and_digests(texts, shingle, lim))
    some = base.where("n > 0 and id is not null")
    nodes = cut_off(some.groupBy("hi", "lo").agg(F.min(F.struct("id", "body", "n", "low")).alias("s")).select("hi", "lo", F.col("s.id").alias("node"), "s.body", "s.n", "s.low"))
    groups = components(node_links(texts.where("id is not null"), nodes, shingle, lim))
    named = nodes.select("hi", "lo", "node").join(groups, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    out = base.select("id", "body", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select("id", "body", "n", F.when(alone, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are the first of their component."""
    found = jaccard_components(docs, id_col, text_col, **how)
    gone = cut_off(found.where("id <> component").select("id", "body").distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of docs can clash
    ident, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.toDF(*names).join(_small(gone), (F.col(ident) == F.col("id")) & (body == F.col("body")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
