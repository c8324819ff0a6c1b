import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import families as fam
from rivulet.operators import formula, models, predict, search
from rivulet.plans.network import network

SF = "/root/testdata/sf0.001"
TYPES = {"tailup": "exponential", "taildown": "spherical", "euclid": "none", "nugget": "nugget"}
THETA = {"tailup_de": 4e6, "tailup_range": 1500.0, "taildown_de": 2e6, "taildown_range": 900.0, "nugget": 4e6}


@pytest.fixture(scope="module")
def net(spark):
    n = network(spark, SF, obs="customer", preds="supplier")
    n.edges, n.obs, n.preds = n.edges.cache(), n.obs.where("pid < 60").cache(), n.preds.cache()
    return n


@pytest.fixture(scope="module")
def model(net):
    return models.fit(models.Spec("y_resp ~ elev + grp", TYPES), net.obs, net.edges, known=THETA)


def test_known_fit_is_generalised_least_squares(model):
    (g,) = model.data.groups
    s = models.sigma(model.spec, THETA, g)
    i = np.linalg.inv(s)
    c = np.linalg.inv(g.X.T @ i @ g.X)
    beta = c @ g.X.T @ i @ g.y
    r = g.y - g.X @ beta
    n, p = g.X.shape
    value = np.linalg.slogdet(s)[1] + r @ i @ r + np.linalg.slogdet(g.X.T @ i @ g.X)[1] + (n - p) * np.log(2 * np.pi)
    assert model.beta == pytest.approx(beta) and model.vcov == pytest.approx(c) and model.value == pytest.approx(value)
    assert np.linalg.eigvalsh(s).min() > 0 and s == pytest.approx(s.T)


def test_pair_features_agree_with_the_relation(net, model):
    from rivulet.operators import pairs

    (g,) = model.data.groups
    p = models.pair_features(g, g)
    at = {int(pid): k for k, pid in enumerate(g.pid)}
    rows = pairs.self_pairs(net.obs.where("y_resp is not null"), net.edges).collect()
    for r in rows:
        i, j = at[r["pid_i"]], at[r["pid_j"]]
        assert (p.h[i, j], p.a[i, j], p.b[i, j], p.w[i, j]) == pytest.approx((r["h"], r["a"], r["b"], r["w"]))
    assert (np.diag(p.h) == 0).all()


def test_one_local_group_is_the_exact_fit(net, model):
    obs = net.obs.withColumn("local_index", F.lit(0))
    local = models.fit(model.spec, obs, net.edges, known=THETA, index="local_index", var_adjust="theoretical")
    assert local.beta == pytest.approx(model.beta) and local.value == pytest.approx(model.value) and local.vcov == pytest.approx(model.vcov)


def test_leave_one_out_is_a_fit_without_the_row(net, model):
    found = {r["pid"]: r for r in predict.loocv(model).collect()}
    pid = sorted(found)[3]
    rest = models.fit(model.spec, net.obs.where(F.col("pid") != pid), net.edges, known=THETA)
    one = predict.predict(rest, net.obs.where(F.col("pid") == pid)).first()
    assert found[pid]["pred"] == pytest.approx(one["fit"]) and found[pid]["se"] == pytest.approx(one["se"], rel=1e-6)


def test_kriging_interpolates_without_a_nugget(net):
    one = net.obs.dropDuplicates(["netID", "locID"])
    m = models.fit(models.Spec("y_resp ~ elev", TYPES), one, net.edges, known=THETA | {"nugget": 0.0})
    found = {r["pid"]: r["fit"] for r in predict.predict(m, one.where("y_resp is not null")).collect()}
    floor = 1e-4 * 6e6  # of the diagonal
    for r in one.where("y_resp is not null").collect():
        assert found[r["pid"]] == pytest.approx(r["y_resp"], abs=6 * floor**0.5)


def test_a_split_prediction_set_predicts_the_same(net, model):
    whole = {r["pid"]: r["fit"] for r in predict.predict(model, net.preds).collect()}
    halves = [r for k in (0, 1) for r in predict.predict(model, net.preds.where(F.col("pid") % 2 == k)).collect()]
    assert {r["pid"]: r["fit"] for r in halves} == pytest.approx(whole)


def test_block_of_one_site_is_its_mean(net, model):
    site = net.preds.limit(1)
    point, block = predict.predict(model, site).first(), predict.predict_block(model, site).first()
    assert block["fit"] == pytest.approx(point["fit"])


def test_free_fit_is_no_worse_than_its_start(net):
    spec = models.Spec("y_resp ~ elev", {"tailup": "none", "taildown": "none", "euclid": "exponential", "nugget": "nugget"})
    m = models.fit(spec, net.obs, net.edges)
    start, free = models._start(m.data, {})
    assert free and m.value <= models.evaluate(m.data, start) + 1e-9


@pytest.mark.parametrize("family", fam.FAMILIES)
def test_scores_are_derivatives(family):
    y = np.array([0.2, 0.7]) if family == "beta" else np.array([1.0, 3.0])
    size, w, h = np.array([4.0, 4.0]), np.array([0.3, -0.4]), 1e-5
    f = lambda x: fam.log_density(family, x, y, size, 2.0)
    assert fam.score(family, w, y, size, 2.0) == pytest.approx((f(w + h) - f(w - h)) / (2 * h), rel=1e-5)
    g = lambda x: fam.score(family, x, y, size, 2.0)
    assert fam.curvature(family, w, y, size, 2.0) == pytest.approx((g(w + h) - g(w - h)) / (2 * h), rel=1e-5)


def test_laplace_of_groups_equals_laplace_of_all(net):
    obs = net.obs.withColumn("y_resp", (F.col("pid") % 7).cast("double")).withColumn("elev", F.col("elev") / 1000)
    spec = models.Spec("y_resp ~ elev", {"tailup": "none", "taildown": "exponential", "euclid": "none", "nugget": "nugget"}, family="poisson")
    theta = {"taildown_de": 0.2, "taildown_range": 900.0, "nugget": 0.1, "dispersion": 1.0}
    m = models.fit(spec, obs, net.edges, known=theta)
    (g,) = m.data.groups
    by_net = [predict._pick(g, np.flatnonzero(g.net == k)) for k in np.unique(g.net)]  # networks are independent here
    assert models.laplace(spec, theta, by_net)["value"] == pytest.approx(m.value, rel=1e-5)


def test_newton_steps_that_overshoot_are_shortened(monkeypatch):
    one, zero = np.ones(1), np.zeros(1)
    g = models.Group(one, one, np.ones((1, 1)), np.array([3.0]), zero, one, np.zeros((1, 2)), zero, one, ["1"], None, {})
    many = [models.replace(g, X=np.ones((1, 1)), y=np.array([y])) for y in (0.0, 3.0, 1.0, 40.0)]
    spec, theta = models.Spec("y ~ 1", {"nugget": "nugget"}, family="poisson"), {"nugget": 2.0, "dispersion": 1.0}
    pairs = [models.kernels.Pair(*[np.zeros((1, 1))] * 6)] * 4
    near = models.laplace(spec, theta, many, pairs)
    monkeypatch.setattr(fam, "start", lambda family, y: np.full(len(y), -6.0))  # a whole step from here goes up by hundreds
    far = models.laplace(spec, theta, many, pairs)
    assert near["converged"] and far["converged"] and far["value"] == pytest.approx(near["value"], rel=1e-6)


def test_local_fits_check_their_response(net):
    spec = models.Spec("y_resp ~ 1", {"nugget": "nugget"}, family="poisson")
    with pytest.raises(ValueError, match="whole numbers"):
        models.fit(spec, net.obs, net.edges, known={"nugget": 1.0}, index="grp")


def test_pseudo_r2_of_a_local_fit_keeps_its_groups(net):
    found = [models.pseudo_r2(models.fit(models.Spec("y_resp ~ elev", TYPES), net.obs.withColumn(c, F.col("netID") % 2), net.edges, known=THETA, index=c, var_adjust="none")) for c in ("local_index", "part")]
    assert found[0] == pytest.approx(found[1])


def test_random_effects(net):
    spec, known = models.Spec("y_resp ~ elev", TYPES, random="~ (elev | grp)"), THETA | {"random:1 | grp": 1e6, "random:elev | grp": 30.0}
    m = models.fit(spec, net.obs, net.edges, known=known)
    (g,) = m.data.groups
    sr = np.linalg.solve(models.sigma(spec, known, g), g.y - g.X @ m.beta)
    levels, elev = g.frame["grp"].to_numpy(), g.frame["elev"].to_numpy(float)
    plain = {("1 | grp", k): 1e6 * sr[levels == k].sum() for k in set(levels)} | {("elev | grp", k): 30.0 * (elev * sr)[levels == k].sum() for k in set(levels)}
    assert {(r["term"], r["level"]): r["blup"] for r in models.random_effects(m).collect()} == pytest.approx(plain)
    assert models.random_effects(models.fit(models.Spec("y_resp ~ elev", TYPES), net.obs, net.edges, known=THETA)).count() == 0


def test_when_distances_are_turned():
    plain, types = {"rotate": 0.0, "scale": 1.0}, {"euclid": "exponential"}
    assert not models.turns(models.Spec("y ~ 1", {"euclid": "none"}, anisotropy=True), {"rotate": 1.0})
    assert models.turns(models.Spec("y ~ 1", types, anisotropy=True), {"rotate": 0.0}) and not models.turns(models.Spec("y ~ 1", types, anisotropy=True), plain)
    assert models.turns(models.Spec("y ~ 1", types), {"scale": 0.5}) and not models.turns(models.Spec("y ~ 1", types), plain)


def test_formula():
    f = formula.Formula.parse("y ~ x*g + I(x^2) + offset(z) - 1")
    assert f.terms == (("x",), ("g",), ("I(x^2)",), ("x", "g")) and not f.intercept and f.offset == "z"
    assert [t.name for t in formula.random_terms("~ (x | a) + b/c")] == ["1 | a", "x | a", "1 | b", "1 | b:c"]


def test_optimisers():
    x, v, _ = search.nelder_mead(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, np.zeros(2), 1e-10)
    assert x == pytest.approx([1, -2], abs=1e-2) and v < 1e-3
    assert search.golden(lambda t: (t - 3.3) ** 2)[0] == pytest.approx(3.3, abs=1e-4)
    for name in ("rotate", "scale", "tailup_de"):
        assert search.from_free(name, search.to_free(name, 0.37)) == pytest.approx(0.37)


def test_queries_take_all_rows(spark, monkeypatch):
    from rivulet.plans import model_queries as q

    sf = SF.replace("0.001", "0.01")
    n = network(spark, sf)
    obs, preds = n.obs.count(), n.preds.count()
    assert (obs, preds) == (100, 1500)
    for name in ("known", "glm"):
        monkeypatch.setattr(q, name, lambda *a, **b: None)
    for name in ("predict", "predict_block", "covmatrix"):  # each gives the rows it is asked about
        monkeypatch.setattr(q.predict, name, lambda m, new, *a, **b: new)
    for name in ["predict_block", "covmatrix_pred_obs", *(f"predict_glm_{f.replace('.', '_').lower()}" for f in q.RESPONSES)]:
        assert q.QUERIES[name](spark, sf).count() == preds, name
    monkeypatch.setattr(q.models, "fit", lambda spec, rows, edges, **b: rows)
    monkeypatch.setattr(q.models, "tidy", lambda rows, *a: rows)
    assert q.QUERIES["fit_lm"](spark, sf).count() == obs
