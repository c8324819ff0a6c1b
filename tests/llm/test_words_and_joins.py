import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from rivulet.llm import common, ngram_join, substring_dedup
from rivulet.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=2, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "the", "The", "😀x"]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 30, 60, 200, 700]))) for _ in range(n)]
    for i in range(n):
        if docs[i] and rng.random() < 0.6:
            w = docs[rng.randrange(i + 1)].split()
            for _ in range(rng.choice([0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs[i] = (" " if rng.random() < 0.5 else "\n").join(w)
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = [d + " " + passage if rng.random() < 0.4 else d for d in docs]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return [*rows, rows[0], (None, docs[0]), (900, None), (901, ""), (902, " \n\t "), (903, "a" * 20000)]


def test_word_hashes_follow_words():
    texts = ["a bb  a\n", None, "", "É a", " bb", "x" * 5_000_000 + " bb"]
    w = common.Words(pa.array(texts, pa.string()))
    words = [WORD.findall(t or "") for t in texts]
    assert w.counts().tolist() == [len(x) for x in words]
    by_word = defaultdict(set)
    for word, h in zip([x for ws in words for x in ws], w.hash.tolist(), strict=True):
        by_word[word].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    g = common.grams(w.hash, 3)
    assert len(g) == len(w.hash) - 2
    lower = common.Words(pa.array(["AbC É"]), lower=True).hash
    assert lower[0] == common.Words(pa.array(["abc"])).hash[0] and lower[1] == common.Words(pa.array(["É"])).hash[0]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + k) for k in range(30)] + [(300, 300)] + [(rng.randint(400, 450), rng.randint(400, 450)) for _ in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    assert all(root(x) == got.get(x, x) for x in up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_join(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                ri, rj = root(i), root(j)
                up[max(ri, rj)] = min(ri, rj)
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None else -1) for i, s in sets)


def test_jaccard_components_match_all_pairs(spark):
    for seed, k, t in ((2, 3, (90, 100)), (3, 5, (8, 10))):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["id"] if r["id"] is not None else -1, r["n"], r["component"] if r["component"] is not None else -1) for r in ngram_join.jaccard_components(df, shingle=k, threshold=t).collect())
        assert got == plain_join(rows, k, *t)


def test_keys_of_sets_that_link_meet():
    rng = np.random.default_rng(7)
    for num, den in ((9, 10), (4, 5)):
        lim = ngram_join.Limits(num, den)
        for trial in range(300):
            n = int(rng.choice([4, 9, 10, 19, 30, 64, 65, 150, 400]))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop, extra = rng.integers(0, max(1, n // 10) + 1), rng.integers(0, max(1, n // 10) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, extra).astype(np.uint64)]))
            joint = len(np.intersect1d(a, b))
            if den * joint < num * (len(a) + len(b) - joint) or np.array_equal(a, b):
                continue
            key, _, each = ngram_join.keys(np.concatenate([a, b]), np.array([len(a), len(b)]), lim, int(rng.choice([0, 20, 40])))
            assert set(key[: each[0]].tolist()) & set(key[each[0] :].tolist()), (len(a), len(b), num)
    assert ngram_join.boundary({10: 100, 60: 100}, ngram_join.Limits(9, 10)) in range(41)


def plain_windows(rows, n=13):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[j : j + n])
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                gone |= set(range(j, j + n))
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup_matches_all_windows(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.kept_words(df, digest=True).collect())
    assert got == plain_windows(rows)
    assert substring_dedup.kept_words(df.limit(0)).count() == 0
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_levels_of_other_windows(spark):
    assert substring_dedup.lengths(13, 4) == [8, 13] and substring_dedup.lengths(40, 4) == [8, 16, 32, 40] and substring_dedup.lengths(8, 4) == [8]
    rows = [(f"{i:04d}" if i is not None else None, t) for i, t in corpus(6, 40)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as id", "2 as body", "3 as z")
    for n in (6, 24):
        got = sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.kept_words(df, digest=True, window=n).collect())
        assert got == sorted((str(i) if i != -1 else "None", *rest) for i, *rest in plain_windows_of_names(rows, n))


def plain_windows_of_names(rows, n):
    number = {i: k for k, i in enumerate(sorted({i for i, _ in rows if i is not None}))}
    name = {k: i for i, k in number.items()} | {-1: -1}
    return [(name[i], *rest) for i, *rest in plain_windows([(number.get(i), t) for i, t in rows], n)]


def test_very_common_runs(spark):
    common_line = " ".join(f"c{k}" for k in range(30))
    rows = [(i, f"a{i} b{i} {common_line} x{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.kept_words(df, digest=True).collect())
    assert got == plain_windows(rows)


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(11)
    words = ngram_join.SLOTS // 64
    for n in (1, 9, 40, 300, 1200):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[n // 20 :], rng.integers(0, 2**64, n // 20 + 1, dtype=np.uint64)]))
            x, y = ngram_join.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])).reshape(2, ngram_join.PLANES, words)
            differ = np.bitwise_or.reduce(x ^ y, axis=0)
            assert sum(int(v).bit_count() for v in differ) <= len(np.setxor1d(a, b))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 3, 8])):
            w[rng.randrange(150)] = f"u{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["n"], r["component"]) for r in ngram_join.jaccard_components(df, shingle=3, threshold=(90, 100)).collect())
    assert got == plain_join(rows, 3, 90, 100)


def test_links_across_the_border_of_the_screen_are_kept(spark):
    rows = []
    for i in range(12):  # 165 and 155 shingles of three words, 163 and 153 of five
        w = [f"p{i}x{j}" for j in range(167)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:157]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, t in ((3, (90, 100)), (5, (8, 10))):
        got = sorted((r["id"], r["n"], r["component"]) for r in ngram_join.jaccard_components(df, shingle=k, threshold=t).collect())
        assert got == plain_join(rows, k, *t) and len({c for *_, c in got}) == 12


def test_screen_puts_aside_only_what_the_bound_allows(spark):
    lim, size = ngram_join.Limits(9, 10), 40
    rows = [(0, 0, 600, list(range(size))), (1, 0, 600, list(range(20)) + list(range(100, 120))), (2, 0, 150, list(range(20, 38))), (3, 0, 600, list(range(200, 240))), (4, 0, 165, list(range(300, 311)))]
    nodes = spark.createDataFrame(rows, "node long, body long, n long, low array<bigint>")
    # 38 of 40 seen, 20 of 40 seen, not screened, none of 40 seen, none of 11 seen: the bound is 1e-11
    assert sorted(r["node"] for r in ngram_join.screen(nodes, lim).collect()) == [0, 1, 2, 4]


def test_light_sets_with_all_shingles_in_one_part_meet():
    lim = ngram_join.Limits(4, 5)
    for n in (4, 5, 6):
        a = np.arange(1, n + 1, dtype=np.uint64) << np.uint64(33)  # in the lowest part of any few
        b = a[:-1] if n > 4 else np.append(a, np.uint64(99) << np.uint64(33))
        assert lim.den * min(len(a), len(b)) >= lim.num * max(len(a), len(b))
        key, _, each = ngram_join.keys(np.concatenate([a, b]), np.array([len(a), len(b)]), lim, 20)
        assert set(key[: each[0]].tolist()) & set(key[each[0] :].tolist()), n


def test_ids_of_any_type_and_clashing_names(spark):
    rows = [r for r in corpus(8, 25) if r[0] is not None]
    plain = {i: c for i, _, c in plain_join([(f"{i:04d}", t) for i, t in rows], 5, 8, 10)}
    df = spark.createDataFrame([(f"{i:04d}", t, 1, 2, 3) for i, t in rows], "doc_id string, text string, __id int, id int, body int")
    got = {str(r["id"]): str(r["component"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == plain
    first = ngram_join.keep_first(df)
    assert first.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in first.distinct().collect()) == sorted(k for k, v in got.items() if k == v)


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    members = spark.createDataFrame([(k, n) for k in (1, 2) for n in range(15 if k == 1 else 3)], "key long, node long")
    met = ngram_join._dealt(members).collect()
    pairs = {}
    for x in met:
        for y in met:
            if (x["key"], x["i"], x["j"]) == (y["key"], y["i"], y["j"]) and x["node"] < y["node"] and (x["i"] == x["j"] or x["own"] != y["own"]):
                pairs[x["key"], x["node"], y["node"]] = pairs.get((x["key"], x["node"], y["node"]), 0) + 1
    assert len(pairs) == 15 * 14 // 2 + 3 and set(pairs.values()) == {1}
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] if r["id"] is not None else -1, r["n"], r["component"] if r["component"] is not None else -1) for r in ngram_join.jaccard_components(df, shingle=3, threshold=(90, 100)).collect())
    assert got == plain_join(rows, 3, 90, 100)


def test_hot_keys_are_looked_up_by_broadcast(spark, monkeypatch):
    from rivulet.llm import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    links = [(1, 100 + k) for k in range(40)] + [(50, 100 + k) for k in range(30, 60)] + [(2000 + k, 2001 + k) for k in range(9)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: (1 if n < 2000 else 2000) for p in links for n in p}


def test_hot_keys_of_tables_over_one_task(spark, monkeypatch):
    from rivulet.llm import graph

    links = [(1, 100 + k) for k in range(40)] + [(50, 100 + k) for k in range(30, 60)] + [(2000 + k, 2001 + k) for k in range(9)] + [(3000, 3000)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in links], "a string, b string")
    together = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    assert together == sorted(map(tuple, components(df).collect()))
    assert dict(together) == {str(n): ("1" if n < 2000 else "2000") for p in links[:-1] for n in p}


def test_rounds_of_small_link_tables_make_few_tasks(spark):
    """What the driver keeps grows with tasks: at 97 partitions, no round may shuffle."""
    held, sc = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
        sc.setJobGroup("rounds", "")
        got = components(links).collect()
        jobs = sc.statusTracker().getJobIdsForGroup("rounds")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)) is not None)
    assert len(got) == 301 and {r["component"] for r in got} == {0}
    assert tasks < 8 * 97, tasks


def test_copies_of_long_lists_do_not_grow_with_their_square(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    members = spark.range(400).selectExpr("id % 1 as key", "id as node", "400L as members")
    met = ngram_join._dealt(members)
    assert met.columns == ["key", "node", "own", "i", "j"] and met.count() == 400 * 10  # 100 blocks of 4 would make 40,000
    assert met.where("i = j").count() == 400


def test_shuffles_of_a_step_leave_the_disk(spark):
    import time

    def files():
        return sum(str(f.getName()).startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    common.cut_off(spark.range(1))
    time.sleep(3)
    held, made = files(), [common.cut_off(spark.range(1000).repartition(5, "id").groupBy("id").count()) for _ in range(3)]
    time.sleep(1)
    common.cut_off(spark.range(1))
    until = time.time() + 20
    while files() > held and time.time() < until:
        time.sleep(0.2)
    assert files() <= held and all(m.count() == 1000 for m in made)
