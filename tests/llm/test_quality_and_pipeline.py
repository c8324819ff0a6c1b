import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from rivulet.llm import common, line_dedup, mixing, ngram_join, quality


def corpus(spark, n=900):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        kind = i % 5
        if kind == 3:
            w = [x.upper() + "!!" for x in w]
        if kind == 4:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "foul", "wretch"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, 0 if kind == 3 else 1, 1 if kind == 4 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    _, scores, key = quality.select(docs, labels)
    kept = {r["id"]: r["key"] >= key for r in scores.collect()}
    held_out = [i for i in kept if i % 2]
    right = sum(kept[i] == (i % 5 < 3) for i in held_out)
    assert right / len(held_out) > 0.97
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_features(text):
    """Buckets of a text, one word, pair and n-gram after the other."""
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    hashes = [int(common.Words(pa.array([w])).hash[0]) for w in words]
    out = list(hashes)
    for a, b in zip(hashes, hashes[1:]):
        out.append(plain_mix((a * 0xD6E8FEB86659FD93 + (b ^ 0xA0761D6478BD642F)) % 2**64))
    for kind, n, from_end in ((1, 4, False), (2, 6, False), (3, 3, True)):
        for w in (w.encode() for w in words):
            if len(w) > n:
                code = kind
                for byte in w[-n:] if from_end else w[:n]:
                    code = (code * 257 + byte) % 2**64
                out.append(plain_mix(code))
    return [h >> 64 - quality.BITS for h in out]


def plain_selection(docs, labels, fit):
    """(score, key) by id, and the ids that are kept; fit: the labelled ids that the models see."""
    counts = {i: Counter(plain_features(t)) for i, t in docs}
    target, sample, raw = Counter(), Counter(), Counter()
    for i, c in counts.items():
        raw.update(c)
        if i in labels and i in fit:
            sample.update(c)
            if labels[i]:
                target.update(c)
    n_target, n_raw = sum(target.values()), sum(raw.values())
    ratios = {}
    for bucket, n in sample.items():
        if n >= 4:
            t, r = target[bucket] + 1, raw[bucket] * n_target / n_raw + 1
            x = math.log(t / r)
            ratios[bucket] = math.copysign(max(abs(x) - math.sqrt(1 / t + n_target / n_raw / r) - 0.5, 0), x)
    rows = {}
    for i, t in docs:
        score = sum(n * ratios.get(b, 0) for b, n in counts[i].items()) / math.sqrt(max(sum(counts[i].values()), 1))
        body = xxhash.xxh64_intdigest((t or "").encode(), 42)
        name = f"quality|{i if i is not None else 'null'}|{body - 2**64 if body >= 2**63 else body}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows[i] = (score, score / 0.03 - math.log(-math.log(u)))
    held = [(rows[i][0], good) for i, good in labels.items() if i not in fit and i in rows]
    n_good = sum(g for _, g in held)
    if not 0 < n_good < len(held):
        return rows, set(rows)

    def balance(x):
        return sum(s >= x for s, g in held if g) / n_good + sum(s < x for s, g in held if not g) / (len(held) - n_good)

    least = max(sorted({s for s, _ in held}), key=lambda x: (round(balance(x), 9), -x))
    k = max(1, sum(s >= least for s, _ in rows.values()))
    last = sorted((key for _, key in rows.values()), reverse=True)[k - 1]
    return rows, {i for i, (_, key) in rows.items() if key >= last}


def test_selection_matches_a_plain_version(spark):
    docs, labels = corpus(spark, 400)
    docs = docs.unionByName(spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " É one É one É", "en", "s", 0)], docs.schema))
    chosen = {r["doc"]: r for r in quality.labelled(labels).collect()}
    texts = [(str(r["doc_id"]), r["text"]) for r in docs.collect()]
    rows, kept = plain_selection(texts, {i: r["good"] for i, r in chosen.items()}, {i for i, r in chosen.items() if r["fit"]})
    for ids in ("doc_id", "cast(doc_id as string) as doc_id"):  # ids of another type, and two columns whose names clash
        own = docs.selectExpr(ids, "text", "lang", "source", "n_chars", "1 as score", "2 as c1")
        _, table, least = quality.select(own, labels)
        got = {str(r["id"]): r for r in table.collect()}
        assert got.keys() == rows.keys()
        for i, (score, key) in rows.items():
            assert got[i]["score"] == pytest.approx(score, abs=1e-4) and got[i]["key"] == pytest.approx(key, abs=1e-2), i
        assert {i for i, r in got.items() if r["key"] >= least} == kept
        out = quality.keep_good(own, labels)
        assert out.columns == own.columns and {str(r["doc_id"]) for r in out.collect()} == kept
    assert rows["900"][0] == rows["901"][0] == 0


def test_repeated_rows_share_their_fate(spark):
    docs, labels = corpus(spark, 200)
    twice = docs.unionByName(docs)
    labels = labels.unionByName(labels)
    out = [r["doc_id"] for r in quality.keep_good(twice, labels).collect()]
    assert all(n == 2 for n in Counter(out).values()) and 0 < len(out) < 400


def test_odd_rows(spark):
    docs, labels = corpus(spark, 100)
    odd = docs.unionByName(spark.createDataFrame([(None, "a b", "en", "s", 0), (1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x" * 30000, "en", "s", 0)], docs.schema))
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "key double").cache()
    for k in (1, 2, 700, 1200, 3499):
        assert quality.kth_largest(df, k, bins=8, few=100) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, 3500) == -math.inf


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    docs, labels = corpus(spark, 300)
    shared = "this is one long line that many documents of the corpus share"
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, f"{shared}\nword1 word2 {i} " + " ".join(f"word{k}" for k in range(80)), "en", "s1", 0) for i in range(6)], docs.schema))
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "mixing sources to target weights", "sentencepiece encoding"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny).cache()
        seen[name] = docs.collect()
        if name != "sentencepiece encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r["doc_id"] for r in seen["quality classifier"]}
    assert sum(i % 5 < 3 for i in good if i < 300) >= 175 and sum(i % 5 >= 3 for i in good if i < 300) <= 5
    with_line = [r["doc_id"] for r in seen["line dedup"] if "many documents" in r["text"]]
    assert with_line == [1005]
    assert [r["doc_id"] for r in seen["n-gram jaccard join"] if r["doc_id"] >= 1000] == [1000]
    words = sum(len(r["text"].split()) for r in seen["n-gram jaccard join"])
    mixed = sum(len(r["text"].split()) for r in seen["mixing sources to target weights"])
    assert mixed == pytest.approx(1.5 * words, rel=0.05)
    assert all(r["n_ids"] == len(r["ids"]) > 0 for r in seen["sentencepiece encoding"])
    assert len(seen["sentencepiece encoding"]) == len(seen["mixing sources to target weights"])
    assert corpus_pipeline.run(spark, tiny).count() == len(seen["sentencepiece encoding"])
    assert line_dedup and mixing and ngram_join
