"""The registered queries of the network engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families, kernels, topology
from ..operators import pairs as P
from ..operators import variogram as V
from .network import VIEWS, Network, network, pairs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS_PAIRS = pairs_sql("v_pairs", "v_obs", "v_obs")
CROSS_PAIRS = pairs_sql("v_cross", "v_preds", "v_obs")


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers a query; sql follows the views and ctes."""

    def add(f: Callable[[Network], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(network(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"WITH {VIEWS}{',' if ctes else ''}{ctes} {sql}"
        return f

    return add


def _net(n: Network):
    from ..sources import folder

    return folder, folder.StreamNetwork(folder.with_netgeom(n.edges, False), n.edges.select("netID", "rid", "binaryID"), folder.with_netgeom(n.obs, True), {"preds": folder.with_netgeom(n.preds, True)})


def obs_pairs(n: Network) -> DataFrame:
    return P.both_ways(P.self_pairs(n.obs, n.edges))


# --- topology and projections ---------------------------------------------------------------------------------------


@query("edges_updist_afv", 'SELECT "netID", rid, "binaryID", length, "upDist", afv FROM v_edges')
def _(n):
    return n.edges


@query("sites_observed", "SELECT * FROM v_obs")
def _(n):
    return n.obs


@query("sites_predicted", "SELECT * FROM v_preds")
def _(n):
    return n.preds


@query("netgeom_encode", """SELECT pid, 'SNETWORK (' || "netID" || ' ' || rid || ' ' || CAST(round("upDist" * 1000) AS BIGINT) || ' ' || CAST(round(ratio * 100) AS BIGINT) || ' ' || pid || ' ' || "locID" || ')' AS netgeom FROM v_obs""")
def _(n):
    up, ratio = F.round(F.col("upDist") * 1000).cast("bigint"), F.round(F.col("ratio") * 100).cast("bigint")
    return n.obs.select("pid", topology.netgeom_site(F.col("netID"), F.col("rid"), up, ratio, F.col("pid"), F.col("locID")).alias("netgeom"))


@query("netgeom_parse", """SELECT pid AS id, "netID" AS "NetworkID", rid AS "SegmentID", "upDist" AS "DistanceUpstream", ratio, pid, "locID" FROM v_obs""")
def _(n):
    text = topology.netgeom_site(*[F.col(c) for c in ("netID", "rid", "upDist", "ratio", "pid", "locID")])
    parsed = topology.parse_netgeom(text)
    return n.obs.select(F.col("pid").alias("id"), *parsed.values())


@query("netgeom_edges", """SELECT rid, "netID" AS "NetworkID", rid AS "SegmentID", "upDist" AS "DistanceUpstream" FROM v_edges""")
def _(n):
    text = topology.netgeom_edge(F.col("netID"), F.col("rid"), F.col("upDist"))
    return n.edges.select("rid", *topology.parse_netgeom(text, site=False).values())


@query("prefix_code", "SELECT pid_i, pid_j, CASE WHEN fc THEN -n ELSE lcp END AS code FROM v_pairs", OBS_PAIRS)
def _(n):
    i, j = (n.obs.select("netID", F.col("pid").alias(f"pid_{s}"), F.col("binaryID").alias(f"k_{s}")) for s in "ij")
    return i.join(j, "netID").select("pid_i", "pid_j", topology.prefix_code(F.col("k_i"), F.col("k_j")).alias("code"))


@query("prefix_code_long", """SELECT net, rid_a, rid_b, CASE WHEN starts_with(x, y) OR starts_with(y, x) THEN -least(length(x), length(y)) ELSE list_max(list_transform(range(0, least(length(x), length(y)) + 1), lambda i: CASE WHEN x[1:i] = y[1:i] THEN i ELSE 0 END)) END AS code
 FROM (SELECT "netID" AS net, rid AS rid_a, repeat("binaryID", 24) AS x FROM v_edges) a JOIN (SELECT "netID" AS net, rid AS rid_b, repeat("binaryID", 24) AS y FROM v_edges) b USING (net) WHERE rid_b = rid_a >> 1 OR rid_b = rid_a""")
def _(n):
    e = n.edges.select(F.col("netID").alias("net"), "rid", F.repeat("binaryID", F.lit(24)).alias("k"))  # keys of 24 to over 120 digits
    a, b = e.select("net", F.col("rid").alias("rid_a"), F.col("k").alias("x")), e.select("net", F.col("rid").alias("rid_b"), F.col("k").alias("y"))
    near = a.withColumn("rid_b", F.explode(F.array_distinct(F.array(F.shiftright("rid_a", 1), F.col("rid_a")))))  # each edge with itself and the one below it
    return near.join(b, ["net", "rid_b"]).select("net", "rid_a", "rid_b", topology.prefix_code(F.col("x"), F.col("y")).alias("code"))


@query("topology_lookup", 'SELECT pid, "netID", rid, "binaryID" FROM v_obs')
def _(n):
    return P.attach_keys(n.obs.drop("binaryID"), n.edges).select("pid", "netID", "rid", "binaryID")


@query("junction_lookup", 'SELECT pid_i, pid_j, ri >> CAST(li - lcp AS INT) AS junction_rid FROM v_pairs', OBS_PAIRS)
def _(n):
    i, j = (n.obs.select("netID", F.col("pid").alias(f"pid_{s}"), F.col("binaryID").alias(f"k_{s}")) for s in "ij")
    met = i.join(j, "netID").withColumn("binaryID", F.substr(F.col("k_i"), F.lit(1), topology.lcp(F.col("k_i"), F.col("k_j"))))
    return met.join(n.edges.select("netID", "binaryID", F.col("rid").alias("junction_rid")), ["netID", "binaryID"], "left").select("pid_i", "pid_j", "junction_rid")


_FEATURES = 'round(d_ij, 6) AS d_ij, round(d_ji, 6) AS d_ji, round(a, 6) AS a, round(b, 6) AS b, round(h, 6) AS h, round(w, 9) AS w, round(e, 9) AS e'


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("netID", "pid_i", "pid_j", "fc", *[F.round(c, 6).alias(c) for c in ("d_ij", "d_ji", "a", "b", "h")], F.round("w", 9).alias("w"), F.round("e", 9).alias("e"))


@query("obs_pairs", f'SELECT "netID", pid_i, pid_j, fc, {_FEATURES} FROM v_pairs', OBS_PAIRS)
def _(n):
    return _rounded(obs_pairs(n))


@query("obs_pred_pairs", f'SELECT "netID", pid_i, pid_j, fc, {_FEATURES} FROM v_cross', CROSS_PAIRS)
def _(n):
    return _rounded(P.cross_pairs(n.preds, n.obs, n.edges))


@query("pred_pairs", f'SELECT "netID", pid_i, pid_j, fc, {_FEATURES} FROM v_pp', pairs_sql("v_pp", 'v_preds', 'v_preds', 'i.pid <= j.pid'))
def _(n):
    return _rounded(P.self_pairs(n.preds, n.edges))


@query("distance_matrix_long", 'SELECT "netID", pid_i AS pid_from, pid_j AS pid_to, round(d_ij, 6) AS d_down FROM v_pairs', OBS_PAIRS)
def _(n):
    return obs_pairs(n).select("netID", F.col("pid_i").alias("pid_from"), F.col("pid_j").alias("pid_to"), F.round("d_ij", 6).alias("d_down"))


@query("euclid_pairs", 'SELECT i.pid AS pid_i, j.pid AS pid_j, CAST(i."netID" = j."netID" AS DOUBLE) AS mask, round(sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)), 9) AS e FROM v_obs i, v_obs j')
def _(n):
    return P.euclid_pairs(n.obs, n.obs, {"e": F.round("e", 9)})


@query("location_dedup", 'SELECT "netID", "locID", count(*) AS sites, min(pid) AS first_pid FROM v_obs GROUP BY 1, 2')
def _(n):
    return n.obs.groupBy("netID", "locID").agg(F.count("*").alias("sites"), F.min("pid").alias("first_pid"))


@query("anisotropy_transform", "SELECT pid, round(cos(0.7e0) * x + sin(0.7e0) * y, 9) AS x1, round((cos(0.7e0) * y - sin(0.7e0) * x) / 0.4e0, 9) AS y1 FROM v_obs")
def _(n):
    x, y = topology.rotate_scale(F.col("x"), F.col("y"), 0.7, 0.4)
    return n.obs.select("pid", F.round(x, 9).alias("x1"), F.round(y, 9).alias("y1"))


@query("anisotropy_inverse", "SELECT pid, round(x, 6) AS x2, round(y, 6) AS y2 FROM v_obs")
def _(n):
    x, y = topology.rotate_scale(F.col("x"), F.col("y"), 0.7, 0.4)
    x, y = topology.unrotate_scale(x, y, 0.7, 0.4)
    return n.obs.select("pid", (F.round(x, 6) + 0.0).alias("x2"), (F.round(y, 6) + 0.0).alias("y2"))


@query("afv_weight", "SELECT pid_i, pid_j, round(w, 9) AS w FROM v_pairs WHERE b = 0", OBS_PAIRS)
def _(n):
    return P.both_ways(P.touching_pairs(n.obs, n.edges)).select("pid_i", "pid_j", F.round("w", 9).alias("w"))


@query("network_summary", 'SELECT "netID", count(*) AS n_edges, max(length("binaryID")) AS depth, round(max("upDist"), 6) AS farthest FROM v_edges GROUP BY 1')
def _(n):
    return n.edges.groupBy("netID").agg(F.count("*").alias("n_edges"), F.max(F.length("binaryID")).cast("bigint").alias("depth"), F.round(F.max("upDist"), 6).alias("farthest"))


@query("bbox_summary", "SELECT count(*) AS n_obs, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, (SELECT count(*) FROM v_preds) AS n_preds FROM v_obs")
def _(n):
    return _net(n)[1].summary().drop("n_vars").withColumn("n_preds", F.col("n_preds").cast("bigint"))


# --- subsets and splits ----------------------------------------------------------------------------------------------


@query("subset_obs", 'SELECT pid FROM v_obs WHERE coalesce("upDist" > 900 AND y_resp > 0, FALSE)')
def _(n):
    folder, net = _net(n)
    return folder.subset(net, "upDist > 900 and y_resp > 0").obs.select("pid")


@query("subset_clip_edges", 'SELECT "netID", rid FROM v_edges WHERE coalesce("netID" = 2 AND "upDist" < 2000, FALSE)')
def _(n):
    folder, net = _net(n)
    return folder.subset(net, "netID = 2 and upDist < 2000", clip=True).edges.select("netID", "rid")


@query("subset_drop_empty_sets", 'SELECT "netID", count(*) AS n_left FROM v_preds WHERE "upDist" > 1500 GROUP BY 1 HAVING count(*) > 0')
def _(n):
    folder, net = _net(n)
    return folder.subset(net, "upDist > 1500", clip=True).preds["preds"].groupBy("netID").agg(F.count("*").alias("n_left"))


@query("split_by_size", "SELECT pid, 'preds-' || ((row_number() OVER (ORDER BY pid) - 1) // 40 + 1) AS set_name FROM v_preds")
def _(n):
    folder, _ = _net(n)
    return folder.named_pieces(n.preds, "preds", size=40).select("pid", "set_name")


@query("split_by_column", "SELECT pid, 'preds-grp-' || grp AS set_name FROM v_preds")
def _(n):
    folder, _ = _net(n)
    return folder.named_pieces(n.preds, "preds", by="grp").select("pid", "set_name")


@query("split_by_predicate", "SELECT pid, elev > 300 AS in_set FROM v_preds")
def _(n):
    folder, net = _net(n)
    taken = folder.split_preds(replace(net, obs=None), "preds", predicate="elev > 300", new_name="high", keep=False).preds["high"]
    return n.preds.select("pid").join(taken.select("pid", F.lit(True).alias("in_set")), "pid", "left").select("pid", F.coalesce("in_set", F.lit(False)).alias("in_set"))


@query("split_keep_pids", "SELECT pid + (SELECT max(pid) FROM v_preds) AS pid, 'SNETWORK (' || \"netID\" || ' ' || rid || ' ' || CAST(round(\"upDist\" * 1000) AS BIGINT) || ' ' || CAST(round(ratio * 100) AS BIGINT) || ' ' || (pid + (SELECT max(pid) FROM v_preds)) || ' ' || \"locID\" || ')' AS netgeom FROM v_preds WHERE grp = 'g1'")
def _(n):
    folder, net = _net(n)
    whole = net.preds["preds"].withColumns({"upDist": F.round(F.col("upDist") * 1000).cast("bigint"), "ratio": F.round(F.col("ratio") * 100).cast("bigint")})
    return folder.split_preds(replace(net, obs=None, preds={"preds": whole}), "preds", predicate="grp = 'g1'", new_name="g1").preds["g1"].select("pid", "netgeom")


@query("missing_split", "SELECT pid, CASE WHEN y_resp IS NULL THEN '.missing' ELSE 'obs' END AS set_name FROM v_obs")
def _(n):
    folder, net = _net(n)
    cut = folder.split_missing(net, "y_resp")
    return cut.get(".missing").select("pid", F.lit(".missing").alias("set_name")).unionByName(cut.get().select("pid", F.lit("obs").alias("set_name")))


@query("duplicate_pids", "SELECT pid, count(*) AS n FROM (SELECT pid FROM v_obs UNION ALL SELECT pid FROM v_preds) GROUP BY pid HAVING count(*) > 1")
def _(n):
    return n.obs.select("pid").unionByName(n.preds.select("pid")).groupBy("pid").agg(F.count("*").alias("n")).where("n > 1")


@query("netid_union", 'SELECT DISTINCT "netID" FROM (SELECT "netID" FROM v_obs UNION SELECT "netID" FROM v_preds)')
def _(n):
    return n.obs.select("netID").union(n.preds.select("netID")).distinct()


@query("pid_membership", "SELECT pid FROM v_preds WHERE pid NOT IN (SELECT pid FROM v_obs)")
def _(n):
    return n.preds.select("pid").join(n.obs.select("pid"), "pid", "left_anti")


@query("complete_cases", 'SELECT count(*) AS n, count(*) FILTER (elev IS NULL OR grp IS NULL) AS bad_x, count(*) FILTER (y_resp IS NULL) AS missing_y, round(var_samp(y_resp), 6) AS var_y FROM v_obs')
def _(n):
    return n.obs.agg(F.count("*").alias("n"), F.count_if(F.col("elev").isNull() | F.col("grp").isNull()).alias("bad_x"), F.count_if(F.col("y_resp").isNull()).alias("missing_y"), F.round(F.var_samp("y_resp"), 6).alias("var_y"))


def _enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return network(spark, sf_dir).obs.withColumn("n_nationkey", (F.col("pid") % 25).cast("int")).join(nation, "n_nationkey").select("pid", "n_name")


QUERIES["attribute_enrichment"] = _enrich
SQL["attribute_enrichment"] = f"WITH {VIEWS} SELECT o.pid, n.n_name FROM v_obs o JOIN nation n ON n.n_nationkey = o.pid % 25"


# --- folders: written to a shared folder and read again -----------------------------------------------------------------


def _folder(n: Network):
    from ..sources import shared

    return *_net(n), shared.folder(n.obs.sparkSession, "network")


@query("folder_roundtrip_obs", "SELECT * FROM v_obs")
def _(n):
    folder, net, path = _folder(n)
    return folder.write_network(net, path).obs.drop("netgeom")


@query("folder_topology", 'SELECT "netID", rid, "binaryID" FROM v_edges')
def _(n):
    folder, net, path = _folder(n)
    return folder.write_network(net, path).topo.select("netID", "rid", "binaryID")


@query("folder_distances", f'SELECT "netID", pid_i, pid_j, fc, {_FEATURES} FROM v_pairs WHERE pid_i <= pid_j', OBS_PAIRS)
def _(n):
    folder, net, path = _folder(n)
    folder.write_distances(net, path)
    return _rounded(folder.read_distances(n.obs.sparkSession, path))


@query("folder_distances_one_network", f'SELECT "netID", pid_i, pid_j, fc, {_FEATURES} FROM v_cross WHERE "netID" = 2', CROSS_PAIRS)
def _(n):
    folder, net, path = _folder(n)
    folder.write_distances(net, path, preds="preds")
    return _rounded(folder.read_distances(n.obs.sparkSession, path, "preds", "obs", 2))


@query("folder_subset_clip", 'SELECT \'edges\' AS part, count(*) AS n FROM v_edges WHERE "upDist" < 3000 UNION ALL SELECT \'obs\', count(*) FROM v_obs WHERE "upDist" < 3000 UNION ALL SELECT \'preds\', count(*) FROM v_preds WHERE "upDist" < 3000')
def _(n):
    folder, net, _path = _folder(n)
    cut = folder.subset(net, "DistanceUpstream < 3000", clip=True)
    rows = [d.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, d in (("edges", cut.edges), ("obs", cut.obs), *cut.preds.items())]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("folder_split_by", "SELECT 'preds-grp-' || grp AS set_name, count(*) AS n FROM v_preds GROUP BY grp")
def _(n):
    folder, net, _path = _folder(n)
    only = folder.StreamNetwork(net.edges, net.topo, None, net.preds)
    sets = folder.split_preds(only, "preds", by="grp", keep=False).preds
    rows = [d.agg(F.lit(k).alias("set_name"), F.count("*").alias("n")) for k, d in sets.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- kernels ----------------------------------------------------------------------------------------------------------

R, DE = 700.0, 2.5
_SPH = "(CASE WHEN {d} <= 7e2 THEN 1 - 1.5e0 * ({d} / 7e2) + 0.5e0 * pow({d} / 7e2, 3) ELSE 0 END)"
_LIN = "(CASE WHEN {d} <= 7e2 THEN 1 - {d} / 7e2 ELSE 0 END)"
_MAR = "(CASE WHEN {d} = 0 THEN 1e0 ELSE ln(90 * {d} / 7e2 + 1) / (90 * {d} / 7e2) END)"
_EPA = "(CASE WHEN {d} <= 7e2 THEN pow({d} - 7e2, 2) * (16 * pow(7e2, 3) + 17 * pow(7e2, 2) * {d} - 2 * 7e2 * pow({d}, 2) - pow({d}, 3)) / (16 * pow(7e2, 5)) ELSE 0 END)"
KERNEL_SQL = {
    ("tailup", "linear"): _LIN.format(d="h") + " * w",
    ("tailup", "spherical"): _SPH.format(d="h") + " * w",
    ("tailup", "exponential"): "exp(-h / 7e2) * w",
    ("tailup", "mariah"): _MAR.format(d="h") + " * w",
    ("tailup", "epa"): _EPA.format(d="h") + " * w",
    ("tailup", "gaussian"): None,
    ("tailup", "none"): "0e0",
    ("taildown", "linear"): f"CASE WHEN b = 0 THEN {_LIN.format(d='h')} ELSE {_LIN.format(d='a')} END",
    ("taildown", "spherical"): f"CASE WHEN b = 0 THEN {_SPH.format(d='h')} WHEN a <= 7e2 THEN (1 - 1.5e0 * b / 7e2 + 0.5e0 * a / 7e2) * pow(1 - a / 7e2, 2) ELSE 0 END",
    ("taildown", "exponential"): "exp(-h / 7e2)",
    ("taildown", "mariah"): f"CASE WHEN b = 0 THEN {_MAR.format(d='h')} WHEN a = b THEN 1 / (90 * a / 7e2 + 1) ELSE (ln(90 * a / 7e2 + 1) - ln(90 * b / 7e2 + 1)) / (90 * a / 7e2 - 90 * b / 7e2) END",
    ("taildown", "epa"): f"CASE WHEN b = 0 THEN {_EPA.format(d='h')} WHEN a <= 7e2 THEN pow(a - 7e2, 2) * (16 * pow(7e2, 3) + 17 * pow(7e2, 2) * a - 15 * pow(7e2, 2) * b - 20 * 7e2 * b * b - 2 * 7e2 * a * a + 10 * 7e2 * a * b + 5 * a * a * b - pow(a, 3) - 10 * a * b * b) / (16 * pow(7e2, 5)) ELSE 0 END",
    ("taildown", "gaussian"): None,
    ("taildown", "none"): "0e0",
    ("euclid", "exponential"): "exp(-e / 7e2)",
    ("euclid", "spherical"): _SPH.format(d="e"),
    ("euclid", "gaussian"): "exp(-pow(e / 7e2, 2))",
    ("euclid", "cosine"): "CASE WHEN e <= 7e2 THEN 1 - 2 / pi() * (least(e / 7e2, 1) * sqrt(1 - pow(least(e / 7e2, 1), 2)) + asin(least(e / 7e2, 1))) ELSE 0 END",
    ("euclid", "cubic"): "CASE WHEN e <= 7e2 THEN 1 - 7 * pow(e / 7e2, 2) + 8.75e0 * pow(e / 7e2, 3) - 3.5e0 * pow(e / 7e2, 5) + 0.75e0 * pow(e / 7e2, 7) ELSE 0 END",
    ("euclid", "pentaspherical"): "CASE WHEN e <= 7e2 THEN 1 - 1.875e0 * (e / 7e2) + 1.25e0 * pow(e / 7e2, 3) - 0.375e0 * pow(e / 7e2, 5) ELSE 0 END",
    ("euclid", "wave"): "CASE WHEN e = 0 THEN 1 ELSE sin(e / 7e2) / (e / 7e2) END",
    ("euclid", "jbessel"): None,
    ("euclid", "gravity"): "pow(1 + pow(e / 7e2, 2), -0.5e0)",
    ("euclid", "rquad"): "pow(1 + pow(e / 7e2, 2), -1)",
    ("euclid", "magnetic"): "pow(1 + pow(e / 7e2, 2), -1.5e0)",
    ("euclid", "none"): "0e0",
}
_EUCLID_PAIRS = 'v_euclid AS (SELECT i.pid AS pid_i, j.pid AS pid_j, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS e FROM v_obs i, v_obs j)'


def _pair() -> kernels.Pair:
    return kernels.Pair(h=F.col("h"), a=F.col("a"), b=F.col("b"), w=F.col("w"), mask=F.lit(1.0), e=F.col("e"))


def _kernel(component: str, kind: str):
    def f(n: Network) -> DataFrame:
        cov = F.round(kernels.covariance(component, kind, _pair(), DE, 0.01 if kind == "jbessel" else R), 9) + 0.0
        at = P.euclid_pairs(n.obs, n.obs, {"cov": cov}) if component == "euclid" else obs_pairs(n).withColumn("cov", cov)
        return at.select("pid_i", "pid_j", "cov")

    body = KERNEL_SQL[component, kind]
    sql = None if body is None else f"SELECT pid_i, pid_j, round(2.5e0 * ({body}), 9) + 0e0 AS cov FROM {'v_euclid' if component == 'euclid' else 'v_pairs'}"
    query(f"kernel_{component}_{kind}", sql, _EUCLID_PAIRS if component == "euclid" else OBS_PAIRS)(f)


for _component, _kind in KERNEL_SQL:
    _kernel(_component, _kind)


@query("kernel_nugget", "SELECT pid, greatest(0.3e0, 1e-4 * (2.5e0 + 1.5e0)) AS nugget, greatest(0e0, 1e-4 * (2.5e0 + 1.5e0)) AS none FROM v_obs")
def _(n):
    return n.obs.select("pid", F.lit(kernels.nugget_diagonal("nugget", 0.3, 4.0)).alias("nugget"), F.lit(kernels.nugget_diagonal("none", 0.3, 4.0)).alias("none"))


_COV = "(exp(-h / 7e2) * w * 2.5e0 + exp(-h / 9e2) * 1.5e0 + CASE WHEN pid_i = pid_j THEN 0.3e0 ELSE 0 END)"


def _composite(df: DataFrame):
    p = _pair()
    cov = kernels.covariance("tailup", "exponential", p, 2.5, 700.0) + kernels.covariance("taildown", "exponential", p, 1.5, 900.0)
    return cov + F.when(F.col("pid_i") == F.col("pid_j"), F.lit(0.3)).otherwise(F.lit(0.0))


@query("cov_composite", f"SELECT pid_i, pid_j, round({_COV}, 9) AS cov FROM v_pairs", OBS_PAIRS)
def _(n):
    return obs_pairs(n).select("pid_i", "pid_j", F.round(_composite(None), 9).alias("cov"))


@query("cov_with_euclid", f"""SELECT u.pid_i, u.pid_j, round(coalesce({_COV.replace('pid_i', 'p.pid_i').replace('pid_j', 'p.pid_j')}, 0) + 0.8e0 * exp(-u.e / 3e2), 9) AS cov
 FROM v_euclid u LEFT JOIN v_pairs p ON p.pid_i = u.pid_i AND p.pid_j = u.pid_j""", f"{OBS_PAIRS}, {_EUCLID_PAIRS}")
def _(n):
    flow = obs_pairs(n).select("pid_i", "pid_j", _composite(None).alias("flow"))
    far = P.euclid_pairs(n.obs, n.obs, {"far": kernels.covariance("euclid", "exponential", _pair(), 0.8, 300.0)})
    return far.join(flow, ["pid_i", "pid_j"], "left").select("pid_i", "pid_j", F.round(F.coalesce("flow", F.lit(0.0)) + F.col("far"), 9).alias("cov"))


def _grouped_pairs(n: Network) -> DataFrame:
    i, j = (n.obs.select(F.col("pid").alias(f"pid_{s}"), F.col("grp").alias(f"g_{s}"), F.col("elev").alias(f"elev_{s}")) for s in "ij")
    return obs_pairs(n).join(i, "pid_i").join(j, "pid_j")


_GROUPED = "v_pairs p JOIN v_obs oi ON oi.pid = p.pid_i JOIN v_obs oj ON oj.pid = p.pid_j"


@query("cov_partition_factor", f"SELECT pid_i, pid_j, round({_COV}, 9) AS cov FROM {_GROUPED} WHERE oi.grp = oj.grp", OBS_PAIRS)
def _(n):
    return _grouped_pairs(n).where("g_i = g_j").select("pid_i", "pid_j", F.round(_composite(None), 9).alias("cov"))


@query("cov_random_intercept", f"SELECT pid_i, pid_j, round({_COV} + CASE WHEN oi.grp = oj.grp THEN 0.7e0 ELSE 0 END, 9) AS cov FROM {_GROUPED}", OBS_PAIRS)
def _(n):
    return _grouped_pairs(n).select("pid_i", "pid_j", F.round(_composite(None) + F.when(F.col("g_i") == F.col("g_j"), 0.7).otherwise(0.0), 9).alias("cov"))


@query("cov_random_slope", f"SELECT pid_i, pid_j, round(CASE WHEN oi.grp = oj.grp THEN 0.7e0 * oi.elev * oj.elev ELSE 0 END, 6) AS cov FROM {_GROUPED}", OBS_PAIRS)
def _(n):
    return _grouped_pairs(n).select("pid_i", "pid_j", F.round(F.when(F.col("g_i") == F.col("g_j"), F.lit(0.7) * F.col("elev_i") * F.col("elev_j")).otherwise(F.lit(0.0)), 6).alias("cov"))


@query("cov_pred_obs", "SELECT pid_i, pid_j, round(exp(-h / 7e2) * w * 2.5e0 + exp(-h / 9e2) * 1.5e0, 9) AS cov FROM v_cross", CROSS_PAIRS)
def _(n):
    p = _pair()
    cov = kernels.covariance("tailup", "exponential", p, 2.5, 700.0) + kernels.covariance("taildown", "exponential", p, 1.5, 900.0)
    return P.cross_pairs(n.preds, n.obs, n.edges).select("pid_i", "pid_j", F.round(cov, 9).alias("cov"))


_AVG = "SELECT pid_j AS pid, round(sum(exp(-h / 7e2) * w * 2.5e0 + exp(-h / 9e2) * 1.5e0) / (SELECT count(*) FROM v_preds), 9) AS avg_cov FROM v_cross GROUP BY pid_j"


def _avg_cov(n: Network) -> DataFrame:
    p = _pair()
    cov = kernels.covariance("tailup", "exponential", p, 2.5, 700.0) + kernels.covariance("taildown", "exponential", p, 1.5, 900.0)
    sums = P.cross_pairs(n.preds, n.obs, n.edges).groupBy(F.col("pid_j").alias("pid")).agg(F.sum(cov).alias("s"))
    return sums.crossJoin(F.broadcast(n.preds.agg(F.count("*").alias("m")))).select("pid", F.round(F.col("s") / F.col("m"), 9).alias("avg_cov"))


@query("avg_cov_by_obs", _AVG, CROSS_PAIRS)
def _(n):
    return _avg_cov(n)


@query("avg_cov_topk", f"SELECT * FROM ({_AVG}) ORDER BY avg_cov DESC, pid LIMIT 20", CROSS_PAIRS)
def _(n):
    return _avg_cov(n).orderBy(F.desc("avg_cov"), "pid").limit(20)


@query("max_distances", "SELECT round(max(h), 6) AS max_h, round(max(e), 6) AS max_e FROM v_pairs", OBS_PAIRS)
def _(n):
    return P.self_pairs(n.obs, n.edges).agg(F.round(F.max("h"), 6).alias("max_h"), F.round(F.max("e"), 6).alias("max_e"))


# --- semivariograms ----------------------------------------------------------------------------------------------------

_RESID = "v_fit AS (SELECT regr_slope(y_resp, elev) AS s, regr_intercept(y_resp, elev) AS c FROM v_obs WHERE y_resp IS NOT NULL), v_resid AS (SELECT pid, grp, y_resp - c - s * elev AS r FROM v_obs, v_fit WHERE y_resp IS NOT NULL)"


def _semi(kind: str, where: str = "", dist: str = "h", pairs: str = "v_pairs") -> str:
    only = {"flowcon": "b = 0", "flowuncon": "b <> 0", "euclid": "TRUE"}[kind]
    return f"v_d AS (SELECT {dist} AS dist, pow(i.r - j.r, 2) AS d2, abs(i.r - j.r) AS d1 FROM {pairs} p JOIN v_resid i ON i.pid = p.pid_i JOIN v_resid j ON j.pid = p.pid_j WHERE pid_i < pid_j AND {only} AND {dist} > 0 {where})"


def _bin_sql(gamma: str) -> str:
    return f"""SELECT s.bin, round(avg(dist), 6) AS dist, round({gamma}, 4) AS gamma, count(dist) AS np
 FROM (SELECT CAST(unnest(range(1, 16)) AS INT) AS bin) s LEFT JOIN (SELECT *, CAST(least(ceil(dist / (cut / 15)), 15) AS INT) AS bin FROM v_d, (SELECT max(dist) / 2 AS cut FROM v_d) WHERE dist <= cut) d ON d.bin = s.bin GROUP BY s.bin"""


def _out(df: DataFrame) -> DataFrame:
    return df.select("bin", F.round("dist", 6).alias("dist"), F.round("gamma", 4).alias("gamma"), "np")


def _semivariogram(name: str, kind: str, gamma: str = "avg(d2) / 2", robust: bool = False, partition: str | None = None):
    where = "AND i.grp = j.grp" if partition else ""

    def f(n: Network) -> DataFrame:
        resid = V.ols_residuals(n.obs, "y_resp", "elev")
        if kind == "euclid":
            at = P.euclid_pairs(n.obs, n.obs)
        else:
            at = P.self_pairs(n.obs, n.edges)
        return _out(V.binned(V.residual_pairs(at, resid, kind, partition), robust=robust))

    ctes = f"{_EUCLID_PAIRS if kind == 'euclid' else OBS_PAIRS}, {_RESID}, {_semi(kind, where, 'e' if kind == 'euclid' else 'h', 'v_euclid' if kind == 'euclid' else 'v_pairs')}"
    query(name, _bin_sql(gamma), ctes)(f)


_ROBUST = "pow(avg(sqrt(d1)), 4) / (0.914e0 + 0.988e0 / nullif(count(dist), 0))"
_semivariogram("torgegram_flowcon", "flowcon")
_semivariogram("torgegram_flowuncon", "flowuncon")
_semivariogram("torgegram_euclid", "euclid")
_semivariogram("torgegram_robust", "flowuncon", _ROBUST, robust=True)
_semivariogram("torgegram_partition", "flowuncon", partition="grp")


@query("torgegram_cloud", "SELECT round(dist, 6) AS dist, round(d2 / 2, 4) AS gamma FROM v_d", f"{OBS_PAIRS}, {_RESID}, {_semi('flowcon')}")
def _(n):
    rows = V.cloud(V.residual_pairs(P.self_pairs(n.obs, n.edges), V.ols_residuals(n.obs, "y_resp", "elev"), "flowcon"))
    return rows.select(F.round("dist", 6).alias("dist"), F.round("gamma", 4).alias("gamma"))


@query("ols_fit", "SELECT round(regr_intercept(y_resp, elev), 6) AS intercept, round(regr_slope(y_resp, elev), 9) AS slope, round((regr_syy(y_resp, elev) - pow(regr_sxy(y_resp, elev), 2) / regr_sxx(y_resp, elev)) / (regr_count(y_resp, elev) - 2), 3) AS s2, regr_count(y_resp, elev) AS n FROM v_obs")
def _(n):
    f = {k: F.expr(f"regr_{k}(y_resp, elev)") for k in ("intercept", "slope", "syy", "sxy", "sxx", "count")}
    return n.obs.agg(F.round(f["intercept"], 6).alias("intercept"), F.round(f["slope"], 9).alias("slope"), F.round((f["syy"] - f["sxy"] * f["sxy"] / f["sxx"]) / (f["count"] - 2), 3).alias("s2"), f["count"].cast("bigint").alias("n"))


# --- families -----------------------------------------------------------------------------------------------------------

_W = "0.01e0 * elev - 3"
_Y = {"poisson": "pid % 7", "nbinomial": "pid % 7", "binomial": "pid % 5", "Gamma": "1 + pid % 9", "inverse.gaussian": "1 + pid % 9"}
_SCORE_SQL = {"poisson": "y - exp(w)", "nbinomial": "2 * (y - exp(w)) / (2 + exp(w))", "binomial": "y - 4 / (1 + exp(-w))", "Gamma": "2 * (y / exp(w) - 1)", "inverse.gaussian": "2 * (y / (2 * exp(w)) - exp(w) / (2 * y)) + 0.5e0"}
_CURVE_SQL = {"poisson": "-exp(w)", "nbinomial": "-2 * exp(w) * (2 + y) / pow(2 + exp(w), 2)", "binomial": "-4 / (1 + exp(-w)) / (1 + exp(w))", "Gamma": "-2 * y / exp(w)", "inverse.gaussian": "-2 * (exp(2 * w) + y * y) / (2 * y * exp(w))"}
_DEV_SQL = {
    "poisson": "CASE WHEN y = 0 THEN 0 ELSE y * ln(y / mu) END - (y - mu)",
    "nbinomial": "CASE WHEN y = 0 THEN 0 ELSE y * (ln(y / (y + 2)) - ln(mu / (mu + 2))) END + 2 * (ln(mu + 2) - ln(y + 2))",
    "binomial": "CASE WHEN y = 0 THEN 0 ELSE y * ln(y / mu) END + CASE WHEN y = 4 THEN 0 ELSE (4 - y) * ln((4 - y) / (4 - mu)) END",
    "Gamma": "-ln(y / mu) + (y - mu) / mu",
    "inverse.gaussian": "0.5e0 * pow(y - mu, 2) / (y * mu * mu)",
}


def _family(family: str):
    mu = "4 / (1 + exp(-w))" if family == "binomial" else "exp(w)"
    view = f"v_f AS (SELECT pid, CAST({_Y[family]} AS DOUBLE) AS y, {_W} AS w FROM v_obs), v_g AS (SELECT *, {mu} AS mu FROM v_f)"

    def base(n: Network) -> DataFrame:
        return n.obs.select("pid", F.expr(f"cast({_Y[family]} as double)").alias("y"), (F.lit(0.01) * F.col("elev") - 3).alias("w")).withColumn("mu", families.inverse_link_col(family, F.col("w"), 4.0))

    tag = family.replace(".", "_").lower()
    query(f"inv_link_{tag}", "SELECT pid, round(mu, 9) AS mu FROM v_g", view)(lambda n: base(n).select("pid", F.round("mu", 9).alias("mu")))
    query(f"glm_score_{tag}", f"SELECT pid, round({_SCORE_SQL[family]}, 7) AS d, round({_CURVE_SQL[family]}, 7) AS dd FROM v_g", view)(
        lambda n: base(n).select("pid", F.round(families.score_col(family, F.col("w"), F.col("y"), 4.0, 2.0), 7).alias("d"), F.round(families.curvature_col(family, F.col("w"), F.col("y"), 4.0, 2.0), 7).alias("dd")))
    query(f"deviance_{tag}", f"SELECT pid, round(greatest(0, 2 * ({_DEV_SQL[family]})), 7) AS dev FROM v_g", view)(
        lambda n: base(n).select("pid", F.round(families.deviance_col(family, F.col("mu"), F.col("y"), 4.0, 2.0), 7).alias("dev")))


for _name in _Y:
    _family(_name)


@query("logit_expit", "SELECT pid, round(ln((ratio + 0.001e0) / (1 - ratio - 0.001e0)), 9) AS logit, round(1 / (1 + exp(-elev / 100)), 9) AS expit FROM v_obs WHERE ratio < 0.99")
def _(n):
    return n.obs.where("ratio < 0.99").select("pid", F.round(families.logit_col(F.col("ratio") + 0.001), 9).alias("logit"), F.round(families.expit_col(F.col("elev") / 100), 9).alias("expit"))


# --- statistics ------------------------------------------------------------------------------------------------------------


@query("loocv_stats", """SELECT round(avg(r), 6) AS bias, round(avg(r / sqrt(se)), 6) AS std_bias, round(avg(r * r), 3) AS mspe, round(sqrt(avg(r * r)), 6) AS rmspe, round(avg(r * r / (se * se)), 6) AS std_mspe,
 round(sqrt(avg(se * se)), 6) AS rav, round(pow(corr(y, p), 2), 9) AS cor2, avg(CAST(abs(r / se) < 1.2815515655446004e0 AS INT)) AS cover_80, avg(CAST(abs(r / se) < 1.6448536269514722e0 AS INT)) AS cover_90, avg(CAST(abs(r / se) < 1.959963984540054e0 AS INT)) AS cover_95
 FROM (SELECT y_resp AS y, 10 * elev AS p, y_resp - 10 * elev AS r, 2000 + elev AS se FROM v_obs WHERE y_resp IS NOT NULL)""")
def _(n):
    from ..operators.infer import loocv_statistics

    rows = n.obs.where("y_resp is not null").select(F.col("y_resp").alias("y"), (10 * F.col("elev")).alias("pred"), (2000 + F.col("elev")).alias("se"))
    s = loocv_statistics(rows)
    digits = {"bias": 6, "std_bias": 6, "mspe": 3, "rmspe": 6, "std_mspe": 6, "rav": 6, "cor2": 9}
    return s.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "cover_80", "cover_90", "cover_95")


@query("auroc", """SELECT round(CASE WHEN auc < 0.5 THEN 1 - auc ELSE auc END, 9) AS auroc FROM (SELECT (sum(CASE WHEN yes THEN rk ELSE 0 END) - n1 * (n1 + 1) / 2e0) / (n1 * n0) AS auc FROM
 (SELECT *, count(*) FILTER (yes) OVER () AS n1, count(*) FILTER (NOT yes) OVER () AS n0 FROM (SELECT y_resp > 4000 AS yes, rank() OVER (ORDER BY elev) + (count(*) OVER (PARTITION BY elev) - 1) / 2e0 AS rk FROM v_obs WHERE y_resp IS NOT NULL)) GROUP BY n1, n0)""")
def _(n):
    from ..operators.infer import auroc

    return auroc(n.obs.where("y_resp is not null").select((F.col("y_resp") > 4000).alias("yes"), F.col("elev").alias("score"))).select(F.round("auroc", 9).alias("auroc"))


@query("residual_quantiles", "SELECT round(quantile_cont(r, 0), 5) AS q0, round(quantile_cont(r, 0.25), 5) AS q25, round(quantile_cont(r, 0.5), 5) AS q50, round(quantile_cont(r, 0.75), 5) AS q75, round(quantile_cont(r, 1), 5) AS q100 FROM v_resid", _RESID)
def _(n):
    r = V.ols_residuals(n.obs, "y_resp", "elev")
    return r.agg(F.percentile("resid", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).select(*[F.round(F.col("q")[i], 5).alias(c) for i, c in enumerate(("q0", "q25", "q50", "q75", "q100"))])


@query("design_matrix", "SELECT pid, 1e0 AS c0, elev AS c1, CAST(grp = 'g1' AS DOUBLE) AS c2, CAST(grp = 'g2' AS DOUBLE) AS c3, elev * CAST(grp = 'g1' AS DOUBLE) AS c4, elev * CAST(grp = 'g2' AS DOUBLE) AS c5 FROM v_obs")
def _(n):
    from ..operators.formula import Formula

    d = Formula.parse("y_resp ~ elev * grp").bind(n.obs)
    return n.obs.select("pid", d.column.alias("x")).select("pid", *[F.col("x")[i].alias(f"c{i}") for i in range(len(d.names))])


@query("gramian", "SELECT count(*) AS n, round(sum(elev), 3) AS s1, round(sum(elev * elev), 1) AS s11, round(sum(y_resp), 3) AS sy, round(sum(y_resp * elev), 1) AS s1y FROM v_obs WHERE y_resp IS NOT NULL")
def _(n):
    x, y = F.col("elev"), F.col("y_resp")
    return n.obs.where("y_resp is not null").agg(F.count("*").alias("n"), F.round(F.sum(x), 3).alias("s1"), F.round(F.sum(x * x), 1).alias("s11"), F.round(F.sum(y), 3).alias("sy"), F.round(F.sum(y * x), 1).alias("s1y"))


@query("info_criteria", "SELECT g AS npar, round(-2 * ll + 2 * g, 9) AS aic, round(-2 * ll + 2 * 100 * g / (100e0 - g - 1), 9) AS aicc, round(-2 * ll + g * ln(100e0), 9) AS bic FROM (SELECT CAST(unnest(range(1, 6)) AS INT) AS g, -35.46e0 AS ll)")
def _(n):
    from ..operators.infer import information_criteria

    rows = n.obs.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("npar"), F.lit(-35.46).alias("loglik"), F.lit(100).alias("n"))
    return information_criteria(rows).select("npar", *[F.round(c, 9).alias(c) for c in ("aic", "aicc", "bic")])


@query("varcomp", "SELECT varcomp, round(proportion, 9) AS proportion FROM (VALUES ('Covariates (PR-sq)', 0.3e0), ('tailup_de', 0.7e0 * 2.5e0 / 4.3e0), ('taildown_de', 0.7e0 * 1.5e0 / 4.3e0), ('nugget', 0.7e0 * 0.3e0 / 4.3e0)) t(varcomp, proportion)")
def _(n):
    from ..operators.infer import variance_components

    return variance_components(n.obs.sparkSession, 0.3, {"tailup_de": 2.5, "taildown_de": 1.5, "nugget": 0.3}).withColumn("proportion", F.round("proportion", 9))


@query("param_grid", """SELECT DISTINCT round(share * 1.2e0 * 10, 9) AS tailup_de, round(range_share * 1000, 6) AS tailup_range, round(u * 12, 9) AS randcov FROM (VALUES (0.9e0, 0.25e0), (0.9e0, 0.75e0), (0.1e0 / 3, 0.25e0), (0.25e0, 0.25e0), (0.25e0, 0.75e0)) a(share, range_share), (VALUES (0.1e0), (0.9e0), (0.5e0)) b(u)""")
def _(n):
    from ..operators.search import start_grid

    rows = {(round(r["tailup_de"], 9), round(r["tailup_range"], 6)) for r in start_grid({"tailup": "exponential", "taildown": "exponential", "euclid": "exponential", "nugget": "nugget"}, 10.0, 1000.0, 500.0)}
    spark = n.obs.sparkSession
    grid = spark.createDataFrame(sorted(rows), "tailup_de double, tailup_range double")
    return grid.crossJoin(spark.createDataFrame([(0.1,), (0.9,), (0.5,)], "u double")).select("tailup_de", "tailup_range", F.round(F.col("u") * 12, 9).alias("randcov")).distinct()


@query("block_pairs", "SELECT i.g AS g1, j.g AS g2 FROM (SELECT DISTINCT pid % 6 AS g FROM v_obs) i JOIN (SELECT DISTINCT pid % 6 AS g FROM v_obs) j ON j.g > i.g")
def _(n):
    g = n.obs.select((F.col("pid") % 6).alias("g")).distinct()
    return g.select(F.col("g").alias("g1")).join(g.select(F.col("g").alias("g2")), F.col("g2") > F.col("g1"))


def queries() -> dict:
    from . import closed_forms, model_queries  # noqa: F401

    return QUERIES | model_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import closed_forms  # noqa: F401

    return dict(SQL)
