import numpy as np

from rivulet.llm.embedding_dedup import encode, estimate, near_dedup


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 24))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.3, 0.5])], int(i % 3)) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, rows[0][1], None), (304, [1.0, 2.0], 0), (305, [2.0, 4.0], 0), (306, [], 0), (307, [None] * 24, 0), (308, [float("inf")] + [1.0] * 23, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_dedup(df).collect()}
    ok = {i: np.array(v) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    links = {i: [j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= 0.93] for i in ok}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i] == (len(links.get(i, [])), min(reach), min(reach) == i)
    assert near_dedup(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 64))
    q = v[:50] + 0.5 * rng.standard_normal((50, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, factors = encode(v)
    est, upper = estimate(codes, factors, q)
    true = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ q.T
    assert abs((est - true).mean()) < 0.005 and (upper >= true).all()
    assert (estimate(codes, factors, q, 6.0)[1] >= true).mean() > 0.999
