"""The pair relation against brute force: locations of many measurements, edges that are unknown, and no pair in a shuffle."""

import math

from pyspark.sql import functions as F

from rivulet.operators import pairs
from rivulet.plans.network import network

SF = "/root/testdata/sf0.001"


def test_locations_of_more_measurements_than_travel_in_one_row(spark):
    edges = spark.createDataFrame([(1, 1, "1", 10.0), (1, 2, "10", 30.0), (1, 3, "11", 40.0)], "netID int, rid long, binaryID string, upDist double")
    rows = [(1, p, p % 2, "10" if p % 2 else "11", 25.0 if p % 2 else 36.0, 0.5, 0.0, float(p % 2)) for p in range(150)] + [(1, 150, 2, "110", 50.0, 0.2, 1.0, 1.0)]
    sites = spark.createDataFrame(rows, "netID int, pid long, locID long, binaryID string, upDist double, afv double, x double, y double")
    got = {(r.pid_i, r.pid_j): (r.d_ij, r.d_ji, r.b) for r in pairs.self_pairs(sites, edges).collect()}
    assert len(got) == pairs.self_pairs(sites, edges).count() == 151 * 152 // 2
    assert got[0, 2] == (0.0, 0.0, 0.0) and got[0, 1] == (26.0, 15.0, 15.0) and got[1, 150] == (15.0, 40.0, 15.0) and got[0, 150] == (0.0, 14.0, 0.0)
    turned = {(r.pid_i, r.pid_j): (r.d_ij, r.d_ji) for r in pairs.both_ways(pairs.self_pairs(sites, edges)).collect()}
    assert len(turned) == 151 * 151 and turned[150, 1] == (40.0, 15.0)


def test_pairs_stay_where_they_meet(spark):
    n = network(spark, SF)
    plan = pairs.both_ways(pairs.self_pairs(n.obs, n.edges)).select(F.sum("h"))._jdf.queryExecution().sparkPlan().toString().splitlines()
    met = next(k for k, line in enumerate(plan) if "SortMergeJoin" in line)
    assert not any("Exchange" in line or "Aggregate" in line for line in plan[3:met])
    assert any("block" in line for line in plan[met : met + 1])


def test_euclidean_pairs_meet_in_cells(spark):
    n = network(spark, SF)
    plan = pairs.euclid_pairs(n.obs, n.obs)._jdf.queryExecution().sparkPlan().toString().splitlines()
    met = next(line for line in plan if "Join" in line or "Product" in line)
    assert "SortMergeJoin [cell_i" in met
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert pairs.euclid_pairs(n.obs, n.obs).rdd.getNumPartitions() <= 5  # 25 by a product of both sides
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_euclidean_pairs_of_places_shared_far_and_unknown(spark):
    rows = [(1 + p % 2, p, 0.0, 3.0) for p in range(150)] + [(1, 150, 4.0, 0.0), (2, 151, -0.0, 3.0), (2, 152, None, 1.0), (None, 153, 4.0, 0.0), (1, None, 4.0, 0.0), (1, 7, 4.0, 0.0)]
    sites = spark.createDataFrame(rows, "netID int, pid long, x double, y double")
    cols = sites.where("pid is null or pid >= 149")

    def key(r):
        return tuple((x is None, x or 0) for x in r)

    got = sorted(((r.pid_i, r.pid_j, r.mask, r.e, r.more) for r in pairs.euclid_pairs(sites, cols, {"more": F.col("e") + 1}).collect()), key=key)
    want = []
    for ni, i, xi, yi in rows:
        for nj, j, xj, yj in rows:
            if j is None or j >= 149:
                e = None if xi is None or xj is None else math.hypot(xi - xj, yi - yj)
                want.append((i, j, None if ni is None or nj is None else float(ni == nj), e, None if e is None else e + 1))
    assert got == sorted(want, key=key)
