import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.functions import topology


def plain(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return -n if n == min(len(a), len(b)) else n


def test_prefix_code_of_known_keys(spark):
    rows = spark.createDataFrame([("1",), ("111",), ("101",), ("011",)], "k string")
    found = [r[0] for r in rows.select(topology.prefix_code(F.col("k"), F.lit("11"))).collect()]
    assert found == [-1, -2, 1, 0]


def test_prefix_code_of_long_keys_matches_a_loop(spark):
    rng = random.Random(5)
    stem = "1" + "".join(rng.choice("01") for _ in range(180))
    pairs = []
    for _ in range(60):
        a = stem[: rng.randint(1, 180)] + "".join(rng.choice("01") for _ in range(rng.randint(0, 20)))
        b = stem[: rng.randint(1, 180)] + "".join(rng.choice("01") for _ in range(rng.randint(0, 20)))
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = [r[0] for r in rows.select(topology.prefix_code(F.col("a"), F.col("b"), 240)).collect()]
    assert found == [plain(a, b) for a, b in pairs]


def test_keys_have_no_longest_length(spark):
    rng = random.Random(6)
    pairs = []
    for n in (59, 60, 61, 119, 120, 121, 500, 3000):
        a = "1" + "".join(rng.choice("01") for _ in range(n - 1))
        turned = a[:-1] + ("0" if a[-1] == "1" else "1")
        pairs += [(a, a), (a, turned), (a, a[: n // 2]), (a[: n // 2] + turned[-1] * 5, a), (a + "01", turned), (a, "0"), ("", a)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = rows.select(topology.prefix_code(F.col("a"), F.col("b")), topology.flow_connected(F.col("a"), F.col("b")), topology.prefix_code(F.col("a"), F.col("b"), 3100)).collect()
    assert [r[0] for r in found] == [r[2] for r in found] == [plain(a, b) for a, b in pairs]
    assert [r[1] for r in found] == [a.startswith(b) or b.startswith(a) for a, b in pairs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**40), st.integers(1, 2**40)), min_size=1, max_size=20))
def test_prefix_code_of_numbers(spark, numbers):
    keys = [(bin(a)[2:], bin(b)[2:]) for a, b in numbers]
    rows = spark.createDataFrame(keys, "a string, b string")
    assert [r[0] for r in rows.select(topology.prefix_code(F.col("a"), F.col("b"))).collect()] == [plain(a, b) for a, b in keys]


def test_network_geometry_round_trip(spark):
    rows = spark.createDataFrame([(1, 5, 10.25, 0.5, 7, 3)], "netID int, rid long, upDist double, ratio double, pid long, locID long")
    text = topology.netgeom_site(*[F.col(c) for c in rows.columns])
    got = rows.select(text.alias("t"), *topology.parse_netgeom(text).values()).first()
    assert got["t"] == "SNETWORK (1 5 10.25 0.5 7 3)" and tuple(got)[1:] == (1, 5, 10.25, 0.5, 7, 3)
    try:
        topology.parse_netgeom(text, ["nothing"])
        raise AssertionError
    except ValueError:
        pass
