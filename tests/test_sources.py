import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from rivulet.plans.network import network
from rivulet.sources import folder, vector
from rivulet.streaming.scoring import running_bins

SF = "/root/testdata/sf0.001"


def gpkg(path, layer, rows, kind):
    con = sqlite3.connect(path)
    con.execute("create table gpkg_contents (table_name text, data_type text)")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_contents values (?, 'features')", (layer,))
    con.execute("insert into gpkg_geometry_columns values (?, 'geom')", (layer,))
    names = [k for k in rows[0] if k != "points"]
    con.execute(f"create table {layer} (geom blob, {', '.join(names)})")
    for r in rows:
        body = struct.pack("<BI", 1, kind) + (struct.pack("<I", len(r["points"])) if kind == 2 else b"") + b"".join(struct.pack("<dd", *p) for p in r["points"])
        con.execute(f"insert into {layer} values ({', '.join('?' * (len(names) + 1))})", (b"GP\0\x01" + struct.pack("<i", 4326) + body, *[r[k] for k in names]))
    con.commit()
    con.close()


@pytest.fixture
def net_folder(tmp_path):
    edges = [{"netID": 1, "rid": r, "upDist": u, "points": [(0.0, 0.0), (1.0, 1.0)]} for r, u in ((1, 10.0), (2, 25.0), (3, 30.0))]
    sites = [{"netID": 1, "rid": r, "upDist": u, "ratio": 0.5, "pid": p, "locID": p, "points": [(float(p), 2.0)]} for p, r, u in ((1, 1, 5.0), (2, 2, 20.0), (3, 3, 22.0))]
    gpkg(tmp_path / "edges.gpkg", "edges", edges, 2)
    gpkg(tmp_path / "sites.gpkg", "sites", sites, 1)
    (tmp_path / "netID1.dat").write_text('"rid","binaryID"\n1,"1"\n2,"10"\n3,"11"\n')
    return tmp_path


def test_import_subset_and_distances(spark, net_folder, tmp_path):
    net = folder.import_network(spark, str(net_folder))
    assert [tuple(r) for r in net.topo.orderBy("rid").collect()] == [(1, 1, "1"), (1, 2, "10"), (1, 3, "11")]
    assert net.obs.select("netgeom").orderBy("pid").first()[0] == "SNETWORK (1 1 5.0 0.5 1 1)"
    full = folder.StreamNetwork(net.edges, net.topo, net.obs.withColumn("afv", F.lit(0.5)))
    folder.write_distances(full, str(tmp_path / "d"))
    pairs = {(r["pid_i"], r["pid_j"]): (r["d_ij"], r["d_ji"], r["b"]) for r in folder.read_distances(spark, str(tmp_path / "d")).collect()}
    assert pairs[1, 2] == (0.0, 15.0, 0.0) and pairs[2, 3] == (10.0, 12.0, 10.0)
    assert folder.subset(net, "DistanceUpstream > 6").obs.count() == 2
    with pytest.raises(ValueError):
        folder.subset(net, "DistanceUpstream > 600")
    with pytest.raises(ValueError):
        vector.find(str(net_folder), "nothing")


def test_split_and_accessors(spark):
    n = network(spark, SF)
    net = folder.StreamNetwork(n.edges, n.edges.select("netID", "rid", "binaryID"), None, {"preds": folder.with_netgeom(n.preds, True)})
    sets = folder.split_preds(net, "preds", size=60).preds
    assert [sets[k].count() for k in ("preds-1", "preds-2", "preds-3")] == [60, 60, 30] and "preds" in sets
    with pytest.raises(ValueError):
        folder.split_preds(net, "preds", size=3, by="grp")
    with pytest.raises(ValueError):
        net.add_preds("preds", n.preds)
    with pytest.raises(ValueError):
        net.get("obs")


def test_running_bins_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0), (9.0, 4.0), (30.0, 1.0)], "dist double, d2 double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("dist double, d2 double").parquet(str(tmp_path / "in"))
    q = running_bins(stream, 10.0, 2).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bins").collect())) == [(1, 1.0, 2.0, 1), (2, 9.0, 4.0, 1)]


def test_rows_are_numbered_as_by_one_sort(spark):
    rows = [(p * p % 997 - 40,) for p in range(500)]
    df = spark.createDataFrame(sorted(set(rows)), "pid bigint")
    got = [tuple(r) for r in folder.numbered(df, "pid", "nth").orderBy("pid").collect()]
    assert got == [(p, k + 1) for k, (p,) in enumerate(sorted(set(rows)))]
    assert folder.numbered(df.limit(0), "pid", "nth").count() == 0
    named = folder.named_pieces(df, "preds", size=100).groupBy("set_name").count().collect()
    assert max(r["count"] for r in named) == 100 and len(named) == -(-df.count() // 100)
