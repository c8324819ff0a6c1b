"""A synthetic network over the driver's tables: four heap-numbered binary trees of edges from part, observed sites from supplier,
prediction sites from customer. Each view exists as a DataFrame and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """netID, rid, binaryID, length, upDist (outlet to upper node), afv (product of area shares along the path)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    key = F.col("p_partkey")
    e = part.select((key % 4 + 1).cast("int").alias("netID"), (F.floor(key / 4) + 1).cast("bigint").alias("rid"), (F.lit(100.0) + 10 * F.col("p_size")).alias("length"), "p_retailprice")
    e = e.withColumn("binaryID", F.bin("rid"))
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.length("binaryID") - 1), lambda k: F.call_function("shiftright", F.col("rid"), k))).alias("up")
    # areas add up over what drains through an edge; an edge's share is that of its area among the edges that join with it
    area = e.select("netID", up, cents.alias("cents")).groupBy("netID", F.col("up").alias("rid")).agg(F.sum("cents").alias("area"))
    share = area.withColumn("pi", F.col("area") / F.sum("area").over(Window.partitionBy("netID", F.expr("shiftright(rid, 1)"))))
    # edges and sites meet by sorted joins: the planner goes by the compressed size of a file and would send whole tables through the driver
    facts = e.select("netID", "rid", "length").join(share.select("netID", "rid", "pi").hint("merge"), ["netID", "rid"]).withColumnRenamed("rid", "up")
    # one aggregate over the path gives both the distance to the outlet and the product of the shares
    walked = e.select("netID", "rid", up).join(facts.hint("merge"), ["netID", "up"]).groupBy("netID", "rid")
    own = F.max(F.when(F.col("up") == F.col("rid"), F.col("length"))).alias("length")
    found = walked.agg(own, F.sum("length").alias("upDist"), F.round(F.exp(F.sum(F.log("pi"))), 12).alias("afv"))
    return found.select("netID", "rid", F.bin("rid").alias("binaryID"), "length", "upDist", "afv")


def sites(spark: SparkSession, sf_dir: str, edges_: DataFrame, table: str = "supplier") -> DataFrame:
    """pid, locID, netID, rid, binaryID, ratio, upDist, afv, x, y, elev, grp, y_resp (null in every 13th row)."""
    key, y = {"supplier": ("s_suppkey", "s_acctbal"), "customer": ("c_custkey", "c_acctbal")}[table]
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("pid"), F.col(y).alias("y"))
    m = edges_.sparkSession.read.parquet(f"{sf_dir}/part.parquet").agg(F.floor(F.count("*") / 4).alias("m"))
    loc = F.floor(F.col("pid") / 8) * 4 + F.col("pid") % 4
    s = t.crossJoin(F.broadcast(m)).withColumn("L", loc)
    s = s.select("pid", (F.col("L") + 1).cast("bigint").alias("locID"), (F.col("pid") % 4 + 1).cast("int").alias("netID"), (F.col("L") * 7919 % F.col("m") + 1).cast("bigint").alias("rid"), ((F.col("L") * 37 % 100) / 100.0).alias("ratio"), (F.col("L") * 17 % 1000).cast("double").alias("x"), (F.col("L") * 29 % 997).cast("double").alias("y"), F.concat(F.lit("g"), F.col("pid") % 3).alias("grp"), F.when(F.col("pid") % 13 == 12, F.lit(None).cast("double")).otherwise(F.col("y")).alias("y_resp"))
    s = s.join(edges_.select("netID", "rid", "binaryID", "length", F.col("upDist").alias("edge_up"), "afv").hint("merge"), ["netID", "rid"])
    s = s.withColumn("upDist", F.round(F.col("edge_up") - (1 - F.col("ratio")) * F.col("length"), 3))
    return s.withColumn("elev", F.lit(50.0) + F.col("upDist") * 0.25 + F.col("locID") % 7).select("pid", "locID", "netID", "rid", "binaryID", "ratio", "upDist", "afv", "x", "y", "elev", "grp", "y_resp")


@dataclass
class Network:
    edges: DataFrame
    obs: DataFrame
    preds: DataFrame


def network(spark: SparkSession, sf_dir: str, obs: str = "supplier", preds: str = "customer") -> Network:
    e = edges(spark, sf_dir)
    return Network(e, sites(spark, sf_dir, e, obs), sites(spark, sf_dir, e, preds))


def _sites_sql(table: str, key: str, y: str) -> str:
    return f"""
  SELECT t.pid, t.L + 1 AS "locID", t."netID", t.rid, v."binaryID", t.ratio, round(v."upDist" - (1 - t.ratio) * v.length, 3) AS "upDist", v.afv, t.x, t.y,
         50e0 + round(v."upDist" - (1 - t.ratio) * v.length, 3) * 0.25e0 + (t.L + 1) % 7 AS elev, t.grp, t.y_resp
  FROM (SELECT {key} AS pid, L, CAST({key} % 4 + 1 AS INT) AS "netID", L * 7919 % (SELECT count(*) // 4 FROM part) + 1 AS rid, (L * 37 % 100) / 100e0 AS ratio,
               CAST(L * 17 % 1000 AS DOUBLE) AS x, CAST(L * 29 % 997 AS DOUBLE) AS y, 'g' || ({key} % 3) AS grp, CASE WHEN {key} % 13 = 12 THEN NULL ELSE {y} END AS y_resp
        FROM (SELECT *, ({key} // 8) * 4 + {key} % 4 AS L FROM {table})) t
  JOIN v_edges v ON v."netID" = t."netID" AND v.rid = t.rid"""


#: Common table expressions of the views; a query's SQL follows a WITH of these.
VIEWS = f"""
v_base AS (SELECT CAST(p_partkey % 4 + 1 AS INT) AS "netID", p_partkey // 4 + 1 AS rid, bin(p_partkey // 4 + 1) AS "binaryID", 100e0 + 10 * p_size AS length, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
v_path AS (SELECT "netID", rid, cents, rid >> CAST(unnest(range(0, length("binaryID"))) AS INT) AS up FROM v_base),
v_up AS (SELECT p."netID", p.rid, sum(b.length) AS "upDist" FROM v_path p JOIN v_base b ON b."netID" = p."netID" AND b.rid = p.up GROUP BY 1, 2),
v_area AS (SELECT "netID", up AS rid, CAST(sum(cents) AS BIGINT) AS area FROM v_path GROUP BY 1, 2),
v_pi AS (SELECT "netID", rid, area / CAST(sum(area) OVER (PARTITION BY "netID", rid >> 1) AS DOUBLE) AS pi FROM v_area),
v_afv AS (SELECT p."netID", p.rid, round(exp(sum(ln(i.pi))), 12) AS afv FROM v_path p JOIN v_pi i ON i."netID" = p."netID" AND i.rid = p.up GROUP BY 1, 2),
v_edges AS (SELECT b."netID", b.rid, b."binaryID", b.length, u."upDist", a.afv FROM v_base b JOIN v_up u ON u."netID" = b."netID" AND u.rid = b.rid JOIN v_afv a ON a."netID" = b."netID" AND a.rid = b.rid),
v_obs AS ({_sites_sql("supplier", "s_suppkey", "s_acctbal")}),
v_preds AS ({_sites_sql("customer", "c_custkey", "c_acctbal")})"""


def pairs_sql(name: str, i: str, j: str, where: str = "TRUE") -> str:
    """A common table expression of the ordered pairs of two site views: the same features as the DataFrame operators give."""
    return f"""
{name}_0 AS (SELECT i."netID", i.pid AS pid_i, j.pid AS pid_j, i.rid AS ri, j.rid AS rj, i."upDist" AS ui, j."upDist" AS uj, i.afv AS fi, j.afv AS fj, length(i."binaryID") AS li, length(j."binaryID") AS lj,
    sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS e FROM {i} i JOIN {j} j ON i."netID" = j."netID" WHERE {where}),
{name}_1 AS (SELECT *, least(li, lj) AS n, xor(ri >> CAST(li - least(li, lj) AS INT), rj >> CAST(lj - least(li, lj) AS INT)) AS differ FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN differ = 0 THEN n ELSE n - length(bin(differ)) END AS lcp, differ = 0 AS fc FROM {name}_1),
{name}_3 AS (SELECT p.*, CASE WHEN fc THEN greatest(ui - uj, 0) ELSE greatest(ui - g."upDist", 0) END AS d_ij, CASE WHEN fc THEN greatest(uj - ui, 0) ELSE greatest(uj - g."upDist", 0) END AS d_ji
    FROM {name}_2 p JOIN v_edges g ON g."netID" = p."netID" AND g.rid = p.ri >> CAST(p.li - p.lcp AS INT)),
{name} AS (SELECT *, greatest(d_ij, d_ji) AS a, least(d_ij, d_ji) AS b, d_ij + d_ji AS h, CASE WHEN least(d_ij, d_ji) = 0 THEN sqrt(least(fi, fj) / greatest(fi, fj)) ELSE 0 END AS w FROM {name}_3)"""
