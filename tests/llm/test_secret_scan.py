import hashlib
import random
import re

from pyspark.sql import functions as F

from rivulet.llm.secret_scan import RULES, Rule, new_ledger_rows, scan_history, scan_increments

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def texts():
    rng = random.Random(1)
    parts = ["password=hunter22", "SECRET : 'abc123def'", "token=ab", "secret=token:abcdefgh", "api_key=\"x\"", "apikey=Zz9+/=", "AKIA" + "A1" * 8, "AKIAAKIA", "0123456789abcdef" * 2, "é😀", " ", "\n", "passwd==:secret=abcdef", "tokentoken=123456", "ſecret=abcdef"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, "", "x" * 50000 + "token=abcdef"]


def test_matches_regular_expressions(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"], [tuple(s) for s in r["found"]]) for r in scan_history(df).collect())
    assert got == sorted((i, plain(t)) for i, t in [*rows, rows[3], rows[3]])


def test_ledger_scans_only_new_pairs(spark):
    df = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("a", 2, "nothing")], "path string, version int, text string")
    first = new_ledger_rows(df).cache()
    assert first.count() == 2 * len(RULES)
    assert new_ledger_rows(df, ledger=first).count() == 0
    newer = (*RULES[:2], Rule("hex", 2, "[0-9a-f]{8,}", 0, 8, "[0-9a-f]{8}"))
    assert new_ledger_rows(df, ledger=first, rules=newer).select("kind").distinct().collect() == [("hex",)]
    more = df.unionByName(spark.createDataFrame([("c", 1, "token=abcdef"), ("c", 2, "secret=zzzzzz")], df.schema))
    assert new_ledger_rows(more, ledger=first).select("blob").distinct().count() == 1
    found = {(r["row"]["path"], r["row"]["version"]): len(r["found"]) for r in scan_history(more, ledger=first).collect()}
    assert found == {("a", 1): 1, ("b", 1): 1, ("a", 2): 0, ("c", 1): 1, ("c", 2): 1}
    assert scan_history(df.limit(0)).count() == 0
    assert hashlib and F


def test_increments_give_what_one_scan_gives(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(texts())] + [(None, "token=abcdefg", 1, 2)]
    rows += [(100 + i, t, 1, 2) for i, t, *_ in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob int, kind int")
    found, ledger = scan_increments([df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1 or doc_id is null"), df.limit(0)], carry=["doc_id", "blob", "kind"])
    got = sorted((str(r["row"]["doc_id"]), r["row"]["blob"], [tuple(s) for s in r["found"]]) for r in found.collect())
    assert got == sorted((str(i), 1, plain(t)) for i, t, *_ in rows)
    assert ledger.count() == ledger.select("blob", "kind", "version").distinct().count() == len(RULES) * len({t or "" for _, t, *_ in rows})


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"é token=abcdef{k} AKIA{'A1' * 8}\n" for k in range(3000))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    assert {r["row"]["doc_id"]: [tuple(s) for s in r["found"]] for r in scan_history(df).collect()} == {1: plain(text), 2: plain(text[: len(text) // 2])}
