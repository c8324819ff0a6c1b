"""The pair relation: everything that is observed about two sites of a network.

Sites: netID, pid, locID, rid, binaryID, upDist, afv, x, y. Hydrologic pairs meet by an equi-join on netID, one row for each
unordered pair of locations with both directions in it, fanned out to measurements afterwards. Euclidean pairs also cross networks.

Only sites are moved, never pairs: a site brings the distances along its own path, where every junction lies, and the measurements of
its location, so all that follows the join is computed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import topology

SITE = ("netID", "pid", "locID", "rid", "binaryID", "upDist", "afv", "x", "y")


def attach_keys(sites: DataFrame, topo: DataFrame) -> DataFrame:
    """sites with the path key of their edge (null where the edge is unknown)."""
    return sites.join(topo.select("netID", "rid", "binaryID"), ["netID", "rid"], "left")


#: Parts of a network that its pairs are dealt into, and measurements of a location that travel in one row.
BLOCKS, MEASUREMENTS = 32, 64
#: Parts of each side of the Euclidean relation; every part of one side meets every part of the other.
CELLS = 16


def _side(sites: DataFrame, side: str) -> DataFrame:
    """One row for each location and at most MEASUREMENTS of its measurements, `pids`."""
    nth = F.row_number().over(Window.partitionBy("netID", "locID").orderBy("pid"))
    part = F.floor((nth - 1) / MEASUREMENTS).alias("part")
    pids = sites.select("netID", "locID", "pid", part).groupBy("netID", "locID", "part").agg(F.collect_list("pid").alias("pids"))
    whole = locations(sites).select("netID", "locID", "binaryID", "upDist", "afv", "x", "y").join(pids.drop("part"), ["netID", "locID"])
    return whole.select("netID", *[F.col(c).alias(f"{c}_{side}") for c in whole.columns if c != "netID"])


def _path(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(netID, binaryID_i, path): the upper nodes' distances of the edges from the outlet to that of a site, null where one is unknown."""
    keys = sites.select("netID", "binaryID_i").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("binaryID_i"), F.lit(1))), lambda k: F.substr(F.col("binaryID_i"), F.lit(1), k))
    steps = keys.select("netID", "binaryID_i", F.posexplode(prefixes).alias("at", "junction"))
    at = edges.select("netID", F.col("binaryID").alias("junction"), F.col("upDist").alias("up"))
    found = steps.join(at, ["netID", "junction"], "left").groupBy("netID", "binaryID_i").agg(F.sort_array(F.collect_list(F.struct("at", "up"))).alias("steps"))
    return found.select("netID", "binaryID_i", F.transform("steps", lambda s: s["up"]).alias("path"))


def _met(i: DataFrame, j: DataFrame, edges: DataFrame) -> DataFrame:
    """All pairs of rows of two sides within a network, dealt evenly over the tasks: each row of i meets all of j in one block."""
    n = int(i.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = i.join(_path(i, edges), ["netID", "binaryID_i"], "left").withColumn("block", F.pmod(F.xxhash64("locID_i", "pids_i"), F.lit(BLOCKS)).cast("int"))
    j = j.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    return i.repartition(n, "netID", "block").join(j.repartition(n, "netID", "block").hint("merge"), ["netID", "block"])


def features(met: DataFrame, longest: int | None = None) -> DataFrame:
    """Adds lcp, fc, d_ij (i flows to j), d_ji, a, b, h, w and e to rows with sites i and j of one network and i's path."""
    n = topology.lcp(F.col("binaryID_i"), F.col("binaryID_j"), longest)
    met = met.withColumn("lcp", n).withColumn("fc", F.col("lcp") == F.least(F.length("binaryID_i"), F.length("binaryID_j")))
    met = met.withColumn("junction_up", F.get("path", F.col("lcp") - 1))
    up_i, up_j, up = F.col("upDist_i"), F.col("upDist_j"), F.col("junction_up")
    met = met.withColumn("d_ij", topology.down_distance(F.col("fc"), up_i, up_j, up)).withColumn("d_ji", topology.down_distance(F.col("fc"), up_j, up_i, up))
    met = met.withColumn("a", F.greatest("d_ij", "d_ji")).withColumn("b", F.least("d_ij", "d_ji")).withColumn("h", F.col("d_ij") + F.col("d_ji"))
    met = met.withColumn("w", topology.afv_weight(F.col("b"), F.col("afv_i"), F.col("afv_j")))
    return met.withColumn("e", euclid(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j")))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def locations(sites: DataFrame) -> DataFrame:
    """One row for each location, whatever the number of measurements there."""
    return sites.dropDuplicates(["netID", "locID"])


PAIR = ("fc", "d_ij", "d_ji", "a", "b", "h", "w", "e")


def self_pairs(sites: DataFrame, edges: DataFrame, longest: int | None = None) -> DataFrame:
    """All unordered pairs of measurements of a network, pid_i <= pid_j, with their features."""
    met = _met(_side(sites, "i"), _side(sites, "j"), edges).where("locID_i <= locID_j")
    at = features(met, longest).select("netID", "locID_i", "locID_j", "pids_i", "pids_j", *PAIR)
    return _measured(at)


def _measured(at: DataFrame) -> DataFrame:
    """Unordered pairs of measurements, pid_i <= pid_j, from pairs of locations of which each but those of a location with itself stands once."""
    wide = at.withColumn("pid_i", F.explode("pids_i")).withColumn("pid_j", F.explode("pids_j")).where("locID_i <> locID_j or pid_i <= pid_j")
    flip = F.col("pid_i") > F.col("pid_j")
    return wide.select("netID", F.least("pid_i", "pid_j").alias("pid_i"), F.greatest("pid_i", "pid_j").alias("pid_j"), "fc", F.when(flip, F.col("d_ji")).otherwise(F.col("d_ij")).alias("d_ij"), F.when(flip, F.col("d_ij")).otherwise(F.col("d_ji")).alias("d_ji"), "a", "b", "h", "w", "e")


def touching_pairs(sites: DataFrame, edges: DataFrame, longest: int | None = None) -> DataFrame:
    """The pairs of self_pairs with b = 0, without those of a network that have none. Sites have keys here.

    A site of such a pair lies at the edge where the paths join: its own edge, or one below it whose upper node isn't below the site.
    Sites meet others at these edges alone, where the paths of the others pass.
    """
    i, j = _side(sites, "i"), _side(sites, "j")
    i = i.join(_path(i, edges), ["netID", "binaryID_i"], "left")
    steps = F.transform("path", lambda up, k: F.struct((k + 1).alias("at"), up.alias("up")))
    here = F.filter(steps, lambda s: (s["at"] == F.length("binaryID_i")) | F.coalesce(s["up"] >= F.col("upDist_i"), F.lit(True)))
    i = i.withColumn("step", F.explode(here)).withColumn("at", F.col("step.at")).withColumn("junction", F.expr("substr(binaryID_i, 1, at)")).drop("step")
    passed = F.transform(F.sequence(F.lit(1), F.greatest(F.length("binaryID_j"), F.lit(1))), lambda k: F.substr(F.col("binaryID_j"), F.lit(1), k))
    met = features(i.join(j.withColumn("junction", F.explode(passed)).hint("merge"), ["netID", "junction"]), longest).where("lcp = at and b = 0")
    # a pair of which both lie there is found from both sides
    both = (F.col("lcp") == F.length("binaryID_j")) | F.coalesce(F.col("junction_up") >= F.col("upDist_j"), F.lit(True))
    return _measured(met.where((F.col("locID_i") <= F.col("locID_j")) | ~both).select("netID", "locID_i", "locID_j", "pids_i", "pids_j", *PAIR))


def cross_pairs(rows: DataFrame, cols: DataFrame, edges: DataFrame, longest: int | None = None) -> DataFrame:
    """All pairs (pid_i of rows, pid_j of cols) of a network, with their features, both directions in one row."""
    met = _met(_side(rows, "i"), _side(cols, "j"), edges)
    at = features(met, longest).select("netID", "pids_i", "pids_j", *PAIR)
    return at.withColumn("pid_i", F.explode("pids_i")).withColumn("pid_j", F.explode("pids_j")).select("netID", "pid_i", "pid_j", *PAIR)


def _points(sites: DataFrame, side: str) -> DataFrame:
    """One row for each place of a network and at most MEASUREMENTS of its measurements, `pids`, whatever their location is called."""
    at = ["netID", "x", "y"]
    nth = F.row_number().over(Window.partitionBy(*at).orderBy("pid"))
    rows = sites.select(*at, "pid", F.floor((nth - 1) / MEASUREMENTS).alias("part")).groupBy(*at, "part").agg(F.collect_list(F.struct("pid")).alias("pids"))
    return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in (*at, "pids")], F.pmod(F.xxhash64(*at, "pids"), F.lit(CELLS)).cast("int").alias(f"cell_{side}"))


def euclid_pairs(rows: DataFrame, cols: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """All pairs of two sets of sites, across networks too: (pid_i, pid_j, mask, e), and columns made of mask and e.

    Every site has a Euclidean distance to every other; that is the relation itself. Its places meet in CELLS x CELLS cells, so the
    number of tasks doesn't grow with the square of the partitions; distances and made columns are computed once for two places.
    """
    made = made or {}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    i, j = _points(rows, "i").withColumn("cell_j", every), _points(cols, "j").withColumn("cell_i", every)
    met = i.repartition(n, "cell_i", "cell_j").join(j.repartition(n, "cell_i", "cell_j").hint("merge"), ["cell_i", "cell_j"])
    at = met.select("pids_i", "pids_j", (F.col("netID_i") == F.col("netID_j")).cast("double").alias("mask"), euclid(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j")).alias("e")).withColumns(made)
    wide = at.withColumn("at_i", F.explode("pids_i")).withColumn("at_j", F.explode("pids_j"))
    return wide.select(F.col("at_i.pid").alias("pid_i"), F.col("at_j.pid").alias("pid_j"), "mask", "e", *[c for c in made if c not in ("mask", "e")])


def both_ways(pairs: DataFrame) -> DataFrame:
    """Ordered pairs from unordered ones."""
    both = pairs.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True)))).where("not turned or pid_i <> pid_j")
    swapped = [F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("pid_i", "pid_j"), ("pid_j", "pid_i"), ("d_ij", "d_ji"), ("d_ji", "d_ij"))]
    return both.select("netID", *swapped[:2], "fc", *swapped[2:], "a", "b", "h", "w", "e")
