"""Networks as folders: import of vector files and topology tables, and a columnar form of sites, edges, topology and pairs.

The path key of an edge is text and is never read as a number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import topology
from ..operators import pairs
from . import vector

EDGE_COLUMNS, SITE_COLUMNS = ("netID", "rid", "upDist"), ("netID", "rid", "upDist", "ratio", "pid", "locID")
#: Fields that a predicate may name; they are read from the network geometry, not from columns of the same name.
NETWORK_FIELDS = ("NetworkID", "SegmentID", "DistanceUpstream", "ratio", "pid", "locID")


@dataclass(frozen=True)
class StreamNetwork:
    """Edges, topology, one set of observed sites (or none) and named sets of prediction sites."""

    edges: DataFrame
    topo: DataFrame
    obs: DataFrame | None = None
    preds: dict[str, DataFrame] = field(default_factory=dict)
    path: str = ""

    def names(self) -> dict[str, list[str]]:
        return {"edges": self.edges.columns, "obs": self.obs.columns if self.obs is not None else [], **{k: v.columns for k, v in self.preds.items()}}

    def get(self, name: str = "obs") -> DataFrame:
        if name == "obs" and self.obs is None or name not in ("obs", *self.preds):
            raise ValueError(f"no such set of sites: {name}")
        return self.obs if name == "obs" else self.preds[name]

    def put(self, data: DataFrame, name: str = "obs", resize: bool = False) -> StreamNetwork:
        """Takes data in place of a set; row counts must agree unless resize is set."""
        missing = set(SITE_COLUMNS) - set(data.columns)
        if missing:
            raise ValueError(f"sites lack {sorted(missing)}")
        if not resize and data.count() != self.get(name).count():
            raise ValueError("the numbers of rows differ; set resize to replace the rows")
        return replace(self, obs=data) if name == "obs" else replace(self, preds=self.preds | {name: data})

    def add_preds(self, name: str, data: DataFrame) -> StreamNetwork:
        if name in self.preds:
            raise ValueError(f"there is a set {name} already")
        return replace(self, preds=self.preds | {name: data})

    def summary(self) -> DataFrame:
        """Numbers of sites and the box around the edges' sites."""
        box = self.obs.agg(F.count("*").alias("n_obs"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
        n = sum(p.count() for p in self.preds.values())
        return box.withColumns({"n_vars": F.lit(len(self.obs.columns)), "n_preds": F.lit(n)})


def with_netgeom(df: DataFrame, site: bool, overwrite: bool = False) -> DataFrame:
    """df with its network geometry text, unless it has one."""
    needed = set(SITE_COLUMNS if site else EDGE_COLUMNS) - set(df.columns)
    if needed:
        raise ValueError(f"columns are missing: {sorted(needed)}")
    if "netgeom" in df.columns and not overwrite:
        return df
    cols = [F.col(c) for c in (SITE_COLUMNS if site else EDGE_COLUMNS)]
    if site:
        net, rid, up, ratio, pid, loc = cols
        return df.withColumn("netgeom", topology.netgeom_site(net, rid, up, ratio, pid, loc))
    return df.withColumn("netgeom", topology.netgeom_edge(*cols))


def read_topology(spark: SparkSession, folder: str) -> DataFrame:
    """(netID, rid, binaryID) of all netID<k>.dat in a folder."""
    rows = spark.read.schema("rid BIGINT, binaryID STRING").option("header", True).csv(f"{folder}/netID*.dat")
    net = F.regexp_extract(F.input_file_name(), r"netID(\d+)\.dat", 1).cast("int")
    return rows.select(net.alias("netID"), "rid", F.trim("binaryID").alias("binaryID"))


def import_network(spark: SparkSession, folder: str, preds: list[str] = (), include_obs: bool = True, overwrite: bool = False) -> StreamNetwork:
    """Reads edges, sites and prediction sets, checks their geometries and builds network geometries."""
    spark.dataSource.register(vector.VectorSource)

    def layer(name, kind, site):
        df = spark.read.format("network_vector").load(vector.find(folder, name))
        if not df.where(F.col("geometry_kind") != kind).isEmpty():
            raise ValueError(f"{name} has geometries other than {kind}")
        return with_netgeom(df, site, overwrite)

    sets = {p.rsplit("/", 1)[-1].removesuffix(".shp").removesuffix(".gpkg"): p for p in preds}
    obs = layer("sites", "POINT", True) if include_obs else None
    return StreamNetwork(layer("edges", "LINESTRING", False), read_topology(spark, folder), obs, {k: layer(p, "POINT", True) for k, p in sets.items()}, folder)


def write_network(net: StreamNetwork, path: str, overwrite: bool = False) -> StreamNetwork:
    """Writes the columnar form and returns what is read back from it."""
    mode = "overwrite" if overwrite else "errorifexists"
    net.edges.write.mode(mode).parquet(f"{path}/edges")
    net.topo.write.mode(mode).partitionBy("netID").parquet(f"{path}/topo")
    if net.obs is not None:
        net.obs.write.mode(mode).parquet(f"{path}/obs")
    for k, v in net.preds.items():
        v.write.mode(mode).parquet(f"{path}/preds/set={k}")
    return read_network(net.edges.sparkSession, path, list(net.preds), net.obs is not None)


def read_network(spark: SparkSession, path: str, preds: list[str] = (), include_obs: bool = True) -> StreamNetwork:
    obs = spark.read.parquet(f"{path}/obs") if include_obs else None
    return StreamNetwork(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/topo"), obs, {k: spark.read.parquet(f"{path}/preds/set={k}") for k in preds}, path)


def write_distances(net: StreamNetwork, path: str, preds: str | None = None, among_preds: bool = False, overwrite: bool = False, longest: int | None = None) -> None:
    """The pair relation, partitioned by the two sets and the network, so that a scan of one network's pairs reads nothing else."""
    mode = "overwrite" if overwrite else "errorifexists"
    edges = pairs.attach_keys(net.edges.drop("binaryID"), net.topo)

    def keyed(df):
        return pairs.attach_keys(df.drop("binaryID"), net.topo)

    pairs.self_pairs(keyed(net.obs), edges, longest).write.mode(mode).partitionBy("netID").parquet(f"{path}/src=obs/dst=obs")
    if preds:
        pairs.cross_pairs(keyed(net.preds[preds]), keyed(net.obs), edges, longest).write.mode(mode).partitionBy("netID").parquet(f"{path}/src={preds}/dst=obs")
        if among_preds:
            pairs.self_pairs(keyed(net.preds[preds]), edges, longest).write.mode(mode).partitionBy("netID").parquet(f"{path}/src={preds}/dst={preds}")


def read_distances(spark: SparkSession, path: str, src: str = "obs", dst: str = "obs", net_id: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/src={src}/dst={dst}")
    return df if net_id is None else df.where(F.col("netID") == net_id)


def subset(net: StreamNetwork, predicate: str, clip: bool = False) -> StreamNetwork:
    """Sites for which the predicate is true (null is not); with clip also edges and prediction sets, of which empty ones go.

    If the predicate names network fields, they are those of the network geometry.
    """

    def cut(df: DataFrame, site: bool) -> DataFrame:
        own = df
        if any(f in predicate for f in NETWORK_FIELDS) and "netgeom" in df.columns:
            own = df.withColumns({k: v for k, v in topology.parse_netgeom(F.col("netgeom"), site=site).items()})
        return own.where(F.coalesce(F.expr(predicate), F.lit(False))).select(*df.columns)

    obs = cut(net.obs, True)
    if obs.isEmpty():
        raise ValueError("no observed site is left")
    if not clip:
        return replace(net, obs=obs)
    edges = cut(net.edges, False)
    if edges.isEmpty():
        raise ValueError("no edge is left")
    sets = {k: cut(v, True) for k, v in net.preds.items()}
    topo = net.topo.join(edges.select("netID").distinct(), "netID", "left_semi")
    return replace(net, obs=obs, edges=edges, topo=topo, preds={k: v for k, v in sets.items() if not v.isEmpty()})


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with the place of each row in the order of a numeric key, from 1. Rows are ranked within ranges of the key, whose bounds are
    approximate quantiles, and the counts of the ranges before are added; no task sorts the whole table."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("__bounds"))
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(key)))).drop("__bounds")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(key)) + F.col("__before")
    return dealt.join(F.broadcast(counts), "__range").withColumn(out, nth).drop("__range", "__before")


def named_pieces(df: DataFrame, name: str, *, size: int | None = None, by: str | None = None, out: str = "set_name") -> DataFrame:
    """Rows of a prediction set with the names of the pieces they go to: chunks of `size` rows by pid, or the values of a column."""
    if by is not None:
        return df.withColumn(out, F.concat(F.lit(f"{name}-{by}-"), F.col(by).cast("string")))
    nth = F.floor((F.col("__place") - 1) / size) + 1
    return numbered(df, "pid", "__place").withColumn(out, F.concat(F.lit(f"{name}-"), nth.cast("string"))).drop("__place")


def split_preds(net: StreamNetwork, name: str, *, size: int | None = None, by: str | None = None, predicate: str | None = None, new_name: str | None = None, keep: bool = True) -> StreamNetwork:
    """Cuts a prediction set into chunks of `size` rows, into one set for each value of a column, or takes rows by a predicate.

    With keep the original stays, and the pieces get new pids above all others.
    """
    if sum(x is not None for x in (size, by, predicate)) != 1:
        raise ValueError("give exactly one of size, by and predicate")
    df = net.get(name)
    everything = net.obs.select("pid") if net.obs is not None else None
    for p in net.preds.values():
        everything = p.select("pid") if everything is None else everything.unionByName(p.select("pid"))
    if not everything.groupBy("pid").count().where("count > 1").isEmpty():
        raise ValueError("pids are not unique")
    if keep:
        top = everything.agg(F.max("pid").alias("top"))
        df = with_netgeom(df.crossJoin(F.broadcast(top)).withColumn("pid", F.col("pid") + F.col("top")).drop("top"), True, overwrite=True)
    if size is not None:
        n = -(-df.count() // size)
        if n > 1000:
            raise ValueError(f"that makes {n} sets; at most 1000 are made")
        named = named_pieces(df, name, size=size, out="__set")
        pieces = {f"{name}-{k}": named.where(F.col("__set") == f"{name}-{k}").drop("__set") for k in range(1, n + 1)}
    elif by is not None:
        if dict(df.dtypes)[by] not in ("int", "bigint", "string", "boolean"):
            raise ValueError("sets are made by whole numbers, texts or booleans")
        values = [r[0] for r in df.select(by).distinct().orderBy(by).limit(1001).collect()]
        pieces = {f"{name}-{by}-{v}": df.where(F.col(by).eqNullSafe(F.lit(v))) for v in values}
    else:
        pieces = {new_name or f"{name}-subset": df.where(F.expr(predicate))}
    return replace(net, preds=({k: v for k, v in net.preds.items() if keep or k != name}) | pieces)


def split_missing(net: StreamNetwork, response: str) -> StreamNetwork:
    """Observed rows without a response become the prediction set .missing."""
    return replace(net, obs=net.obs.where(F.col(response).isNotNull()), preds=net.preds | {".missing": net.obs.where(F.col(response).isNull())})
