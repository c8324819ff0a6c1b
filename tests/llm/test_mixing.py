from collections import defaultdict

import pytest

from rivulet.llm.mixing import mix, mixed_rows, targets


def test_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), None if i % 11 == 0 else f"s{i % 4}") for i in range(400)]
    rows += [(400, None, "s1"), (401, "", None), (7, rows[7][1], rows[7][2]), (500, "one two", "empty?"), (501, "w " * 5000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out)) == sorted(map(tuple, mix(df.repartition(3)).collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        size[key] += r["size"]
        taken[key] += r["taken"]
        target[key] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in out))
    for k, t in taken.items():
        assert size[k] == k[0] and abs(t - target[k]) <= 2


def test_targets_fill_up(spark):
    per = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r[0]: r[2] for r in targets(per).collect()}
    # a can take 20; of what is left b takes its 2000 at most, c the rest
    assert got == pytest.approx({"a": 20.0, "b": 2 / 3 * 2995, "c": 1 / 3 * 2995, None: 0.0}, abs=1e-5)


def test_rows_and_no_rows(spark):
    df = spark.createDataFrame([(i, "a b c", "x", 1) for i in range(8)], "doc_id long, text string, source string, taken int")
    assert mixed_rows(df).count() == 12
    assert mixed_rows(df.limit(0)).count() == 0


def test_documents_without_words_come_with_each_epoch(spark):
    rows = [(i, "a b c", "x") for i in range(8)] + [(8, None, "x"), (9, "", "x"), (10, " \n", "x"), (11, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, epochs in ((1.0, 1), (2.0, 2), (0.5, 0)):
        got = [r["doc_id"] for r in mixed_rows(df, share=share).collect()]
        assert [got.count(i) for i in range(8, 12)] == [epochs] * 3 + [0], share
