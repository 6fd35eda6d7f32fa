"""Networks, meshes, statistics, time series, readers and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.covariance import Covariance
from plumbline.operators import geometry, mesh, neighbors, network, statistics, timeseries
from plumbline.sources import files
from plumbline.streaming import hourly

RIVER = [(0, 1), (1, 2), (1, 3), (1, 4), (1, 5), (5, 6)]
SEWER = [(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, 7)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_laplacian_rows_and_diagonal(spark):
    adj = network.adjacency(edges(spark, [*RIVER, (0, 1)]))
    assert {(r["i"], r["j"]): r["v"] for r in adj.collect()}[0, 1] == 2
    lap = network.laplacian(adj)
    assert lap.groupBy("i").agg(F.sum("v").alias("s")).where(F.abs("s") > 1e-12).count() == 0
    nodes = spark.range(8).select(F.col("id").alias("node"))
    normal = network.laplacian(adj, True, nodes).where("i = j").collect()
    assert {r["i"]: round(r["v"], 12) for r in normal} == {**dict.fromkeys(range(7), 1.0), 7: 0.0}
    one_way = spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double")
    assert {(r["i"], r["j"]): r["v"] for r in network.laplacian(one_way).collect()} == {(0, 0): 0.5, (1, 1): 0.5, (0, 1): -0.5, (1, 0): -0.5}


def test_network_covariance(spark):
    a = network.NetworkCovariance.of(edges(spark, RIVER), 7, 1.5)
    b = network.NetworkCovariance.of(edges(spark, RIVER), 7, 1.5, method="precision")
    assert a.c == pytest.approx(b.c, abs=1e-10) and np.linalg.eigvalsh(a.c).min() > 0
    assert a.c @ a.q == pytest.approx(np.eye(7), abs=1e-10)
    d = network.NetworkCovariance(a.lap, 0.5, method="diffusion")
    assert np.linalg.eigvalsh(d.c).min() > 0 and d.c.sum(axis=1) == pytest.approx(np.ones(7))
    for bad in (lambda: network.NetworkCovariance(a.lap, 1, method="x"), lambda: network.NetworkCovariance(np.ones((2, 3)), 1), lambda: network.NetworkCovariance(np.zeros((5001, 5001)), 1)):
        with pytest.raises(ValueError):
            bad()


def test_mass_balance(spark):
    h = network.mass_balance(edges(spark, SEWER))
    x = spark.createDataFrame(list(enumerate([1.0, 2.0, 0.5, 1.5, 3.0, 2.0, 5.0, 5.0])), "node long, x double")
    assert [r["r"] for r in network.residual(h, x).orderBy("h").collect()] == pytest.approx([0, 0, 0, 0])
    weighted = spark.createDataFrame([(0, 4, 0.5), (1, 4, 0.5)], "src long, dst long, w double")
    assert {(r["j"]): r["v"] for r in network.mass_balance(weighted).collect()} == {4: 1.0, 0: -0.5, 1: -0.5}
    dense = np.zeros((4, 8))
    for r in h.collect():
        dense[r["h"], r["j"]] = r["v"]
    gram = np.zeros((8, 8))
    for r in network.gram(h).collect():
        gram[r["i"], r["j"]] = r["v"]
    assert gram == pytest.approx(dense.T @ dense)
    lap = network.NetworkCovariance.of(edges(spark, SEWER), 8, 1.5, 2.0)
    assert network.PhysicsInformed(lap.lap, dense, 1.5, 0.0, 1.0, 2.0).c == pytest.approx(lap.c, abs=1e-10)


def test_precision_kriging_and_gradients(spark):
    line = edges(spark, [(i, i + 1) for i in range(9)])
    cov = network.NetworkCovariance.of(line, 10, 0.3)
    mean, var = network.precision_kriging(cov.q, [2, 5, 8], [1, 3, -1], np.arange(10))
    assert mean[[2, 5, 8]] == pytest.approx([1, 3, -1], abs=0.05) and var[2] < var[0]
    q = network.precision(network.laplacian(network.adjacency(line)), spark.range(10).withColumnRenamed("id", "node"), 0.8)
    x = network.conjugate_gradient(q, spark.createDataFrame([(4, 1.0)], "node long, x double")).orderBy("node").toPandas()["x"]
    dense = network.NetworkCovariance.of(line, 10, 0.8).q
    assert dense @ x.to_numpy() == pytest.approx(np.eye(10)[4], abs=1e-6)
    assert network.sill_rescale([1.0, 2, 3], cov, [0, 1]) > 0
    assert network.hops(line, 0).agg(F.max("hop")).first()[0] == 9


def test_hops_and_gradients_go_to_the_end(spark):
    line = edges(spark, [(i, i + 1) for i in range(104)])
    assert network.hops(line, 0).agg(F.max("hop"), F.count("node")).first()[:] == (104, 105)
    with pytest.raises(RuntimeError):
        network.hops(line, 100, most=3).count()
    assert network.hops(line.where("dst < 4"), 0, most=3).count() == 4
    q = network.precision(network.laplacian(network.adjacency(line.where("dst < 10"))), spark.range(10).withColumnRenamed("id", "node"), 0.8)
    with pytest.raises(RuntimeError):
        network.conjugate_gradient(q, spark.createDataFrame([(4, 1.0)], "node long, x double"), steps=2)


def test_mesh(spark):
    points = np.stack([g.ravel() for g in np.meshgrid(np.linspace(0, 10, 10), np.linspace(0, 10, 10))], axis=1)
    tri = mesh.delaunay(points)
    corner = points[tri]
    e = corner[:, 1:] - corner[:, :1]
    assert 0.5 * np.abs(e[:, 0, 0] * e[:, 1, 1] - e[:, 0, 1] * e[:, 1, 0]).sum() == pytest.approx(100)
    m = mesh.Mesh.from_points(points, max_edge=2.0)
    mass, stiff = m.matrices()
    assert (mass > 0).all() and stiff == pytest.approx(stiff.T) and stiff.sum(axis=1) == pytest.approx(np.zeros(len(mass)), abs=1e-9)
    fem = mesh.fem_entries(*m.tables(spark)).toPandas()
    table = np.zeros_like(stiff)
    table[fem["i"], fem["j"]] = fem["stiffness"]
    assert table == pytest.approx(stiff, abs=1e-9)
    for alpha in (1, 2):
        q = mesh.matern_precision(m, *mesh.matern_params(1.0, 5.0), alpha)
        assert np.linalg.eigvalsh(q).min() > 0
        rows = mesh.precision_entries(mesh.fem_entries(*m.tables(spark)), *mesh.matern_params(1.0, 5.0), alpha).toPandas()
        back = np.zeros_like(q)
        back[rows["i"], rows["j"]] = rows["v"]
        assert back == pytest.approx(q, abs=1e-8)
    with pytest.raises(ValueError):
        mesh.matern_precision(m, 1, 1, 3)
    z = np.sin(points[:, 0])
    mean, var = mesh.spde_kriging(m, points, z, points[:5], 1.0, 5.0)
    assert mean == pytest.approx(z[:5], abs=0.5) and (var > 0).all()


def test_mesh_kriging_in_tasks(spark):
    g = np.random.default_rng(2)
    at = g.random((30, 2)) * 10
    values = np.sin(at[:, 0]) + at[:, 1] / 5
    m = mesh.Mesh.from_points(at, max_edge=1.5)
    est = g.random((12, 2)) * 10
    mean, variance = mesh.spde_kriging(m, at, values, est, 1.0, 4.0)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(est)], "est_id long, coords array<double>")
    got = mesh.spde_kriging_at(m, at, values, table, 1.0, 4.0).orderBy("est_id").toPandas()
    assert got["mean"].to_numpy() == pytest.approx(mean, abs=1e-6) and got["variance"].to_numpy() == pytest.approx(variance, rel=1e-6)


def test_a_fit_of_blocks_is_near_the_whole(monkeypatch):
    g = np.random.default_rng(1)
    at = g.random((240, 2)) * 20
    z = np.linalg.cholesky(Covariance("exponential", [2.0, 6.0]).matrix(at, at) + 0.1 * np.eye(240)) @ g.standard_normal(240) + 5
    whole = statistics.fit_arrays(at, z)
    assert sorted(np.concatenate(statistics._blocks(at, 50)).tolist()) == list(range(240)) and max(map(len, statistics._blocks(at, 50))) <= 50
    monkeypatch.setattr(statistics, "FIT_POINTS", 100)
    monkeypatch.setattr(statistics, "FIT_BLOCK", 90)
    parts = statistics.fit_arrays(at, z)
    assert 0.5 < parts["sill"] / whole["sill"] < 2 and 0.4 < parts["range"] / whole["range"] < 2.5
    monkeypatch.setattr(statistics, "FIT_MOST", 200)
    with pytest.raises(ValueError):
        statistics.fit_arrays(at, z)


def test_sparse_matrices():
    g = np.random.default_rng(3)
    i, j, v = g.integers(0, 20, 60), g.integers(0, 20, 60), g.random(60)
    a = np.zeros((20, 20))
    np.add.at(a, (i, j), v)
    s = network.Csr.of(i, j, v, 20)

    def full(m):
        out = np.zeros((20, 20))
        out[m.rows, m.columns] = m.data
        return out

    assert full(s) == pytest.approx(a) and full(s.times(s)) == pytest.approx(a @ a) and full(s.plus(s, 2.0)) == pytest.approx(3 * a)
    assert s.dot(np.eye(20)) == pytest.approx(a) and s.diagonal == pytest.approx(np.diag(a))
    lap = network.Csr.of(*(np.array(x) for x in ([0, 1, 0, 1], [1, 0, 0, 1], [-1.0, -1, 1, 1])), 3)
    for method in ("regularised", "diffusion"):
        both = [c.block([0, 2], [0, 1, 2]) for c in (network.SparseNetworkCovariance(lap, 0.8, 2.0, method), network.NetworkCovariance(np.array([[1.0, -1, 0], [-1, 1, 0], [0, 0, 0]]), 0.8, 2.0, method))]
        assert both[0] == pytest.approx(both[1], abs=1e-10)


def test_statistics(spark):
    g = np.random.default_rng(2)
    at = g.random((60, 2)) * 10
    cov = Covariance("exponential", [2.0, 4.0])
    obs = statistics.simulate_field(spark, at, cov, 5.0, 1).withColumnRenamed("id", "obs_id")
    fit = statistics.fit_covariance(obs, ["exponential", "spherical"]).collect()
    assert len(fit) == 2 and all(r["sill"] > 0 and r["range"] > 0 for r in fit)
    profile, restricted = (statistics.fit_arrays(at, obs.orderBy("obs_id").toPandas()["z"], restricted=x)["sill"] for x in (False, True))
    assert restricted != profile
    best, value, _ = statistics.nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, [0.0, 0.0], tol=1e-8)
    assert best == pytest.approx([3, -1], abs=1e-3) and value < 1e-6
    v = statistics.variogram(obs, 5.0).collect()
    assert sum(r["n"] for r in v) == sum(1 for i in range(60) for j in range(i) if math.dist(at[i], at[j]) < 5)
    est = spark.createDataFrame([(0, at[0].tolist()), (1, [500.0, 500.0])], "est_id long, coords array<double>")
    idw = {r["est_id"]: r["estimate"] for r in statistics.inverse_distance(est, obs, dmax=8.0).collect()}
    assert idw[0] == obs.orderBy("obs_id").first()["z"] and math.isnan(idw[1])
    nearest = statistics.inverse_distance(est, obs, math.inf).where("est_id = 0").first()["estimate"]
    assert nearest == idw[0]
    margin = statistics.fit_margin(spark.createDataFrame([(h, 50, 2 * math.exp(-3 * h / 4)) for h in (0.1, 0.5, 1.0, 2.0, 4.0)], "lag double, n long, covariance double"), "exponential")
    assert (margin["sill"], margin["range"]) == pytest.approx((2, 4), rel=0.01)
    assert statistics.half_largest_distance(obs) > 0


def test_geometry(spark):
    g = geometry.grid(spark, [0.0, 0.0], [1.0, 2.0], [2, 3]).orderBy("id").collect()
    assert [r["coords"] for r in g] == [[0, 0], [0, 1], [0, 2], [1, 0], [1, 1], [1, 2]]
    rows = spark.createDataFrame([(i, float((i * 37) % 100)) for i in range(100)], "id long, v double")
    assert [r["__rank"] for r in geometry.numbered(rows, ["v"]).orderBy("v").collect()] == list(range(100))
    a, b = (sorted(r["id"] for r in geometry.sample(rows.repartition(n), "id", 10).collect()) for n in (1, 5))
    assert a == b and len(a) == 10
    classes = geometry.by_valid_count(spark.createDataFrame([("x", 1.0)] * 12 + [("y", 1.0)] * 3 + [("z", None)], "site string, v double"), "site", "v")
    assert {r["site"]: r["class"] for r in classes.collect()} == {"x": "hard", "y": "soft", "z": "excluded"}


def test_nearest_in_time(spark):
    series = spark.createDataFrame([(0.0, 1.0), (900.0, 2.0)], "ts double, value double")
    targets = spark.createDataFrame([(1, 600.0), (2, 7200.0), (3, 450.0)], "target_id long, ts double")
    got = {r["target_id"]: r["value"] for r in neighbors.nearest_in_time(targets, series, 600.0).collect()}
    assert got == {1: 2.0, 2: None, 3: 1.0}
    strict = {r["target_id"]: r["value"] for r in neighbors.nearest_in_time(targets, series, 300.0, inclusive=False).collect()}
    assert strict[1] is None


def test_time_series(spark):
    k = timeseries.unit_hydrograph(0.25, 2.0, 3.0)
    assert np.trapezoid(k, dx=0.25) == pytest.approx(1)
    with pytest.raises(ValueError):
        timeseries.unit_hydrograph(1.0, 0.0, 0.0)
    s = spark.range(30).select(F.col("id").alias("step"), F.sin("id").alias("v"))
    v = np.sin(np.arange(30))
    got = timeseries.convolved(s, [0.2, 0.5, 0.3], 0.5).orderBy("step").toPandas()["conv"]
    assert got.to_numpy() == pytest.approx(np.convolve(v, [0.2, 0.5, 0.3])[:30] * 0.5)
    got = timeseries.delayed(s, [], 0.6, 0.25).orderBy("step").toPandas()["delayed"]
    want = np.interp(np.arange(30) * 0.25 - 0.6, np.arange(30) * 0.25, v, left=0)
    assert got.to_numpy() == pytest.approx(want, abs=1e-12)
    assert timeseries.hourly_means(spark.range(10).select(F.col("id").alias("step"), F.col("id").cast("double").alias("v")), [], 4).orderBy("hour").toPandas()["v"].tolist() == [1.5, 5.5]


def test_routing_equals_direct_sum(spark):
    n, dt = 60, 0.25
    local = timeseries.local_inflow(spark, "soft", n, dt).select("node", "step", "v")
    links = spark.createDataFrame(timeseries.LINKS, "src string, dst string, length double")
    got = timeseries.routed(local, links, dt, *timeseries.TRAVEL["soft"]).toPandas().pivot(index="step", columns="node", values="v").sort_index()
    own = local.toPandas().pivot(index="step", columns="node", values="v").sort_index()
    t, flow = np.arange(n) * dt, {}
    for name, *_ in timeseries.NODES:
        flow[name] = own[name].to_numpy() + sum((math.exp(-0.003 * length / 1000) * np.interp(t - length / 0.5 / 3600, t, flow[a], left=0.0) for a, b, length in timeseries.LINKS if b == name), np.zeros(n))
        assert got[name].to_numpy() == pytest.approx(flow[name], abs=1e-9)


def test_no_node_passes_on_less_than_nothing(spark):
    local = spark.createDataFrame([("a", 0, -5.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0), ("c", 0, 0.5), ("c", 1, -9.0)], "node string, step long, v double")
    links = spark.createDataFrame([("a", "b", 0.0), ("b", "c", 0.0), ("a", "c", 0.0)], "src string, dst string, length double")
    got = {(r["node"], r["step"]): r["v"] for r in timeseries.routed(local, links, 0.25, 0.5, 0.003).collect()}
    assert got == {("a", 0): 0, ("a", 1): 2, ("b", 0): 1, ("b", 1): 3, ("c", 0): 1.5, ("c", 1): 0}


def test_a_filter_reaches_routed_flow(spark):
    """Flow of several rounds, then noise, hourly means and a filter by the hour, as the synthetic network has them."""
    links = spark.createDataFrame(timeseries.LINKS, "src string, dst string, length double")
    flow = timeseries.routed(timeseries.local_inflow(spark, "truth", 20, 0.25).select("node", "step", "v"), links, 0.25, *timeseries.TRAVEL["truth"])
    means = timeseries.hourly_means(timeseries.process_noise(flow), ["node"], 4)
    assert means.where(F.col("hour").between(1, 3)).count() == 3 * len(timeseries.NODES)


def test_routing_goes_down_the_longest_path(spark):
    local = spark.createDataFrame([("n00", t, 1.0) for t in range(3)], "node string, step long, v double")
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 0.0) for i in range(20)], "src string, dst string, length double")
    got = timeseries.routed(local, links, 0.25, 0.5, 0.003).collect()
    assert len(got) == 21 * 3 and {r["v"] for r in got} == {1.0}
    with pytest.raises(RuntimeError):
        timeseries.routed(local, links.union(spark.createDataFrame([("n02", "n01", 0.0)], links.schema)), 0.25, 0.5, 0.003, levels=5)


INP = """[TITLE]
;; a comment
[junctions]
J1 100
J2 101 ;x
[STORAGE]
S1 95
[OUTFALLS]
O1 90
[CONDUITS]
C1 J1 J2 120
[PUMPS]
P1 J2 O1
[WEIRS]
W1 J2 NEW
[COORDINATES]
J1 1.5 2.5
[SUBCATCHMENTS]
A r J1
"""


def test_readers(spark, tmp_path):
    (tmp_path / "a.inp").write_text(INP)
    nodes, links = files.sewer_network(spark, str(tmp_path / "a.inp"))
    assert [r["name"] for r in nodes.orderBy("node").collect()] == ["J1", "J2", "NEW", "O1", "S1"]
    assert nodes.where("name = 'J1'").first()["x"] == 1.5
    assert sorted((r["src"], r["dst"], r["length"]) for r in links.collect()) == [(0, 1, 120.0), (1, 2, 50.0), (1, 3, 50.0)]
    assert [tuple(r) for r in files.outlets(spark, str(tmp_path / "a.inp")).collect()] == [("A", "J1")]
    (tmp_path / "m.csv").write_text("Meter,Node\nM1,J1\nM2,\nM1,J2\n")
    assert [tuple(r) for r in files.meter_nodes(spark, str(tmp_path / "m.csv")).collect()] == [("M1", "J2")]
    (tmp_path / "o.csv").write_text("Name,M1,M2\nNode,J1,J2\nType,Flow,depth\nUnit,cfs,ft\n01/02/2024 00:15,1.5,9\nbad date,2,9\n1/2/2024 0:30,x,9\n")
    got = files.observations(spark, str(tmp_path / "o.csv")).orderBy("ts").collect()
    assert [(r["meter"], r["node"], r["value"]) for r in got] == [("M1", "J1", 1.5), ("M1", "J1", None)]
    (tmp_path / "r.txt").write_text("HLY 20240102 03:00 0.5\nHLY 20240103 04:00 999.9\nHLY 20240104 05:00 0.9\nnone\n")
    assert files.top_rain(spark, str(tmp_path / "r.txt")).first()["rain"] == 0.9
    (tmp_path / "p.txt").write_text("title\n2 columns\nlon\npm\n-80.5 12.0\n-81 -9999\n7\n")
    assert [(r["name"], r["value"]) for r in files.named_columns(spark, str(tmp_path / "p.txt")).orderBy("line_no", "name").collect()] == [("lon", -80.5), ("pm", 12.0), ("lon", -81.0), ("pm", None)]
    files.write_results(nodes, str(tmp_path / "out"), ["kind"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("site"), "value")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = hourly.hourly_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == e.count()
    hard = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(10)], "obs_id long, coords array<double>, z double")
    points = spark.createDataFrame([(i, [i + 0.5]) for i in range(4)], "est_id long, coords array<double>")
    points.write.parquet(str(tmp_path / "points"))
    q = hourly.estimate_stream(spark.readStream.schema(points.schema).parquet(str(tmp_path / "points")), hard, str(tmp_path / "est"), str(tmp_path / "c2"), nhmax=4)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "est")).count() == 4
