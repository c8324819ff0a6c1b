import hashlib
import random
import re
from collections import defaultdict

from rivulet.llm.line_dedup import line_dedup, with_kept

STRIP = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(STRIP).translate(low)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars and i is not None:
                held[k].append(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    return [[x for x in (t or "").split("\n") if i is None or key(x) not in last or i >= last[key(x)]] for i, t in rows]


def test_matches_a_loop(spark):
    rng = random.Random(3)
    pool = [f"A common line number {k} of the corpus" for k in range(6)] + ["short", "", "  État unis de lumière et d'ombre  ", "X" * 19, "x" * 20]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"a line of its own, {rng.random()}" for _ in range(rng.choice([0, 1, 3, 200])))) for i in range(40)]
    rows += [(5, rows[5][1]), (None, pool[0]), (100, None), (101, ""), (102, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["row"]["doc_id"] if r["row"]["doc_id"] is not None else -1, r["row"]["text"] or "", r["kept"]) for r in with_kept(df).collect())
    want = sorted((i if i is not None else -1, t or "", k) for (i, t), k in zip(rows, plain(rows), strict=True))
    assert got == want


def test_rows_of_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, "t")], "doc_id long, text string, id int, body int, words string")
    assert line_dedup(df).collect() == df.collect()
    assert line_dedup(df.limit(0)).count() == 0
    assert hashlib and re
