"""What plans and fits hold at once, whatever the size of the tables."""

import numpy as np
import pytest

from rivulet.plans.network import network

SF = "/root/testdata/sf0.001"


def test_edges_and_sites_are_not_broadcast(spark):
    n = network(spark, SF)
    for rows in (n.edges, n.obs, n.preds):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _row_matrices(monkeypatch, limit):
    """Fails where a covariance of more rows than the limit is made."""
    from rivulet.operators import models

    made = models.sigma

    def sigma(spec, theta, g, pair=None):
        assert len(g.y) <= limit, f"a matrix of {len(g.y)} rows"
        return made(spec, theta, g, pair)

    monkeypatch.setattr(models, "sigma", sigma)


FLOW = {"tailup": "exponential", "taildown": "exponential", "euclid": "none", "nugget": "nugget"}
THETA = {"tailup_de": 4e6, "tailup_range": 1500.0, "taildown_de": 2e6, "taildown_range": 900.0, "nugget": 4e6}


def test_networks_are_factorised_one_by_one(spark, monkeypatch):
    from rivulet.operators import models, predict

    n = network(spark, SF, obs="customer", preds="supplier")
    spec = models.Spec("y_resp ~ elev", FLOW)
    whole = models.fit(spec, n.obs, n.edges, known=THETA)
    (g,) = whole.data.groups
    s = models.sigma(spec, THETA, g)  # all rows in one matrix
    i = np.linalg.inv(s)
    r = g.y - g.X @ whole.beta
    assert whole.beta == pytest.approx(np.linalg.solve(g.X.T @ i @ g.X, g.X.T @ i @ g.y)) and models.deviance(whole) == pytest.approx(r @ i @ r)
    new = n.preds.toPandas().sort_values(["netID", "pid"], ignore_index=True)
    at = models.to_group(predict._new_rows(whole, n.preds).toPandas(), predict._junctions(whole))
    c0 = models.sigma_between(spec, THETA, at, g)
    h = at.X - c0 @ i @ g.X
    fit, se = at.X @ whole.beta + c0 @ i @ r, np.sqrt(s[0, 0] - ((c0 @ i) * c0).sum(axis=1) + ((h @ whole.vcov) * h).sum(axis=1))
    _row_matrices(monkeypatch, max(np.unique(g.net, return_counts=True)[1]))
    got = predict.predict(models.fit(spec, n.obs, n.edges, known=THETA), n.preds, interval="prediction").toPandas().set_index("pid").loc[new["pid"]]
    assert got["fit"].to_numpy() == pytest.approx(fit) and got["se"].to_numpy() == pytest.approx(se)
    assert models.glance(whole).first()["deviance"] == pytest.approx(r @ i @ r)


@pytest.mark.parametrize("more", [{}, {"partition": "grp"}, {"random": "~ (elev | grp)"}])
def test_fits_without_spatial_components_make_no_matrix_of_rows(spark, monkeypatch, more):
    from rivulet.operators import models

    n = network(spark, SF, obs="customer", preds="supplier")
    spec = models.Spec("y_resp ~ elev", FLOW | {"tailup": "none", "taildown": "none"}, **({"random": "~ (1 | grp)"} | more))
    theta = {"nugget": 4e6} | {f"random:{t.name}": v for t, v in zip(models.fm.random_terms(spec.random), (1e6, 10.0, 5e5), strict=False)}
    plain = models.fit(spec, n.obs, n.edges, known=theta)
    (g,) = plain.data.groups
    i = np.linalg.inv(models.sigma(spec, theta, g))
    c = np.linalg.inv(g.X.T @ i @ g.X)
    beta = c @ g.X.T @ i @ g.y
    r = g.y - g.X @ beta
    value = -np.linalg.slogdet(i)[1] + r @ i @ r - np.linalg.slogdet(c)[1] + (len(r) - 2) * np.log(2 * np.pi)
    _row_matrices(monkeypatch, 0)
    got = models.glance(models.fit(spec, n.obs, n.edges, known=theta)).first()
    assert plain.beta == pytest.approx(beta) and plain.vcov == pytest.approx(c)
    assert (got["value"], got["deviance"]) == pytest.approx((value, r @ i @ r))


def test_pairs_that_touch_are_found_at_their_edges(spark):
    from pyspark.sql import functions as F
    from rivulet.operators import pairs as P
    from rivulet.plans.queries import QUERIES

    n = network(spark, SF, obs="customer")
    edge = n.edges.select("netID", "rid", F.col("upDist").alias("top"), "length")
    # more sites at the lower ends of edges, where two that aren't connected touch, and several measurements of a place
    low = n.obs.join(edge, ["netID", "rid"]).withColumn("upDist", F.when(F.col("locID") % 3 == 0, F.col("top") - F.col("length")).otherwise(F.col("upDist"))).drop("top", "length")
    sites = low.localCheckpoint()
    want = P.self_pairs(sites, n.edges).where("b = 0").drop("e")
    got = P.touching_pairs(sites, n.edges).drop("e")
    want, got = sorted(map(tuple, want.collect())), sorted(map(tuple, got.collect()))
    assert got == want and any(not r[3] for r in got) and any(r[3] and r[1] != r[2] for r in got)
    plan = QUERIES["afv_weight"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "junction" in plan and "block" not in plan  # not all pairs of a network
