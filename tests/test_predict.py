"""Estimation end to end, by its invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import softpdf
from plumbline.functions.covariance import Covariance, SpaceTime
from plumbline.operators import neighbors, network, predict

HARD = "obs_id long, coords array<double>, z double"


@pytest.fixture(scope="module")
def line(spark):
    g = np.random.default_rng(0)
    x = np.sort(g.uniform(0, 30, 12))
    z = np.sin(x / 2) + g.normal(0, 0.15, 12)
    return spark.createDataFrame([(i, [float(a)], float(b)) for i, (a, b) in enumerate(zip(x, z, strict=True))], HARD)


def est(spark, *at):
    return spark.createDataFrame([(i, [float(a)]) for i, a in enumerate(at)], "est_id long, coords array<double>")


def soft(spark, *rows):
    return spark.createDataFrame([(i, [float(x)], pdf.row()) for i, (x, pdf) in enumerate(rows)], f"soft_id long, coords array<double>, pdf {softpdf.SCHEMA}")


def test_hard_only_is_kriging(spark, line):
    r = predict.bme_predict(est(spark, 15), line, None, Covariance("exponential", [1, 10])).first()
    assert r["mean"] == r["kriging_mean"] and r["variance"] == r["kriging_var"] and r["skewness"] == 0
    assert r["ci_lower"] < r["mean"] < r["ci_upper"] and r["info"] == "kriging_only nh=12" and len(r["pdf"]) == 200


def test_soft_data_narrow(spark, line):
    base = predict.bme_predict(est(spark, 15), line, None, Covariance("exponential", [1, 10])).first()
    for method in ("gauss_hermite", "laplace", "qmc"):
        r = predict.bme_predict(est(spark, 15), line, soft(spark, (14, softpdf.gaussian(0.1, 0.2))), Covariance("exponential", [1, 10]), nsmax=4, dmax=20, method=method).first()
        assert r["variance"] <= base["variance"] + 1e-6 and r["n_soft"] == 1 and r["info"] == "full_bme nh=12 ns=1"


def test_interval_pulls_and_wide_one_does_not(spark, line):
    cov = Covariance("exponential", [1, 15])
    base = predict.bme_predict(est(spark, 15.4), line, None, cov).first()["mean"]
    up = predict.bme_predict(est(spark, 15.4), line, soft(spark, (15.5, softpdf.interval(1, 3))), cov).first()["mean"]
    wide = predict.bme_predict(est(spark, 15.4), line, soft(spark, (15.5, softpdf.interval(-100, 100))), cov).first()["mean"]
    narrow = predict.bme_predict(est(spark, 15.5), line, soft(spark, (15.5, softpdf.interval(0.79, 0.81))), cov, exact_intervals=True).first()["mean"]
    assert up > base and wide == pytest.approx(base, abs=0.3) and narrow == pytest.approx(0.8, abs=0.05)


def test_prior_duplicate_and_empty(spark, line):
    empty = line.where("z > 1e9")
    r = predict.bme_predict(est(spark, 10), empty, None, Covariance("exponential", [1, 10]), order=math.nan, mean_prior=2.0).first()
    assert (r["mean"], r["variance"], r["info"]) == (2.0, 1.0, "no_data") and math.isnan(r["skewness"])
    first = line.orderBy("obs_id").first()
    d = predict.bme_predict(est(spark, first["coords"][0]), line).first()
    assert d["mean"] == first["z"] and d["variance"] == 0 and d["info"] == "duplicate"
    assert predict.bme_predict(est(spark, 1).where("est_id < 0"), line).count() == 0
    with pytest.raises(ValueError):
        predict.bme_predict(est(spark, 1), line, method="other")


def test_strategies_agree(spark):
    g = np.random.default_rng(3)
    obs = spark.createDataFrame([(i, [float(a) for a in np.round(g.random(2) * 10, 1)]) for i in range(300)], "obs_id long, coords array<double>")
    points = spark.createDataFrame([(i, [float(a) for a in g.random(2) * 10]) for i in range(20)], "est_id long, coords array<double>")

    def rows(**o):
        return sorted((r["est_id"], r["rank"], r["obs_id"]) for r in neighbors.knn(points, obs, 7, **o).collect())

    assert rows(strategy="blocks") == rows(strategy="rounds") == rows(strategy="slices")
    assert rows(strategy="blocks", dmax=1.5) == rows(strategy="cells", dmax=1.5) == rows(strategy="rounds", dmax=1.5)


def test_slices_in_many_dimensions(spark, monkeypatch):
    g = np.random.default_rng(4)
    obs = spark.createDataFrame([(i, [float(a) for a in g.random(6)]) for i in range(200)], "obs_id long, coords array<double>")
    points = spark.createDataFrame([(i, [float(a) for a in g.random(6)]) for i in range(10)], "est_id long, coords array<double>")
    want = sorted(map(tuple, neighbors.knn(points, obs, 5).collect()))
    monkeypatch.setattr(neighbors, "BROADCAST_VALUES", 500)
    assert sorted(map(tuple, neighbors.knn(points, obs, 5).collect())) == want


def _near(a, b):
    return len(a) == len(b) and all(x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], rel=1e-7, abs=1e-9, nan_ok=True) if isinstance(x[k], float) else x[k] == y[k] for k in x) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("order", [None, 0, 1, 2])
def test_shared_data_give_what_joined_data_give(spark, order):
    """Batches that hold all data against the relational way, for hard and soft data, duplicates, points without data and null places."""
    g = np.random.default_rng(6)
    hard = spark.createDataFrame([(i, [float(a) for a in g.random(2) * 10], float(g.normal())) for i in range(120)], HARD)
    s = spark.createDataFrame([(i, [float(a) for a in g.random(2) * 3], softpdf.gaussian(float(g.normal()), 0.4).row()) for i in range(8)], f"soft_id long, coords array<double>, pdf {softpdf.SCHEMA}")
    places = [[float(a) for a in g.random(2) * 10] for _ in range(30)] + [hard.first()["coords"], [500.0, 500.0], None]
    points = spark.createDataFrame(list(enumerate(places)), "est_id long, coords array<double>")
    for data in (None, s):
        got = [sorted((r.asDict() for r in predict.bme_predict(points, hard, data, Covariance("exponential", [1, 6]), nhmax=6, nsmax=2, dmax=4.0, order=order, n_grid=40, strategy=how, density=False).collect()), key=lambda r: r["est_id"]) for how in ("auto", "cells")]
        assert _near(*got) and {r["info"] for r in got[0]} >= {"duplicate", "no_data"}
    hard, s, points = hard.withColumn("t", F.col("obs_id") % 5 * 1.0), s.withColumn("t", F.lit(1.0)), points.where("coords IS NOT NULL").withColumn("t", F.lit(2.0))
    for exact in (False, True):
        got = [sorted((r.asDict() for r in predict.bme_predict_st(points, hard, s, SpaceTime("exponential", [1, 6], "exponential", [1, 4]), nhmax=6, nsmax=2, dmax=4.0, tmax=3.0, order=order, n_grid=40, exact=exact, strategy=how, density=False).collect()), key=lambda r: r["est_id"]) for how in ("auto", "joins")]
        assert _near(*got)


def test_space_time_rounds(spark):
    g = np.random.default_rng(8)
    obs = [(i, [float(a) for a in g.random(2) * 10], float(g.integers(9))) for i in range(300)]
    points = [(i, [float(a) for a in g.random(2) * 10], float(g.integers(9))) for i in range(20)]
    got = neighbors.knn_st(spark.createDataFrame(points, "est_id long, coords array<double>, t double"), spark.createDataFrame(obs, "obs_id long, coords array<double>, t double"), 5, ratio=0.7, exact=True).collect()
    want = {(e, o): i + 1 for e, x, t in points for i, (_, o) in enumerate(sorted((math.dist(x, y) + 0.7 * abs(t - u), o) for o, y, u in obs)[:5])}
    assert {(r["est_id"], r["obs_id"]): r["rank"] for r in got} == want


def test_a_network_of_20000_nodes(spark):
    n, kappa = 20_000, 0.5
    edges = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"))
    cov = network.NetworkCovariance.of(edges, n, kappa, 2.0)
    assert isinstance(cov, network.SparseNetworkCovariance)
    # On a long ring the covariance falls by a fixed factor with each hop.
    factor = 1 + kappa**2 / 2 - math.sqrt((1 + kappa**2 / 2) ** 2 - 1)
    at_0 = 2 / math.sqrt((kappa**2 + 2) ** 2 - 4)
    assert cov.block([5], [5, 6, 9, 19_999])[0] == pytest.approx([at_0, at_0 * factor, at_0 * factor**4, at_0 * factor**6], rel=1e-8)
    hard = spark.createDataFrame([(i, i * 100, float(i % 5)) for i in range(200)], "obs_id long, node long, z double")
    point = spark.createDataFrame([(0, 101), (1, 100)], "est_id long, node long")
    got = {r["est_id"]: r for r in predict.bme_predict_network(point, hard, None, cov, nhmax=1, order=None).collect()}
    assert got[0]["kriging_mean"] == pytest.approx(factor, rel=1e-6) and got[0]["kriging_var"] == pytest.approx(at_0 * (1 - factor**2), rel=1e-6) and got[1]["info"] == "duplicate"
    st = network.NetworkSpaceTime(cov, Covariance("exponential", [1, 3]))
    timed = predict.bme_predict_network_st(point.withColumn("t", F.lit(0.0)), hard.limit(6).withColumn("t", F.lit(0.0)), None, st, nhmax=1, order=None).collect()
    assert {r["est_id"]: r["kriging_mean"] for r in timed}[0] == pytest.approx(factor, rel=1e-6)


def test_coverage_leave_one_out(spark):
    g = np.random.default_rng(42)
    x = np.linspace(0, 30, 30)
    hard = spark.createDataFrame([(i, [float(a)], float(np.sin(a / 5) + g.normal(0, 0.25))) for i, a in enumerate(x)], HARD)
    got = predict.cross_validate(hard, Covariance("exponential", [1, 8]))
    assert got.count() == 30
    inside = got.where(F.abs("error") <= 1.96 * F.sqrt("variance")).count()
    assert inside >= 12 and predict.errors(got).first()["rmse"] < 1


def test_space_time(spark):
    hard = spark.createDataFrame([(i, [float(i)], float(i % 3), float(i % 4)) for i in range(20)], "obs_id long, coords array<double>, t double, z double")
    points = spark.createDataFrame([(0, [3.0], 0.0)], "est_id long, coords array<double>, t double")
    cov = SpaceTime("exponential", [1, 10], "exponential", [1, 6])
    r = predict.bme_predict_st(points, hard, None, cov).first()
    assert r["info"].startswith("kriging_only") and r["variance"] < 1e-6
    far = predict.bme_predict_st(points.withColumn("t", F.lit(100.0)), hard, None, cov).first()
    assert far["kriging_var"] > r["kriging_var"]
    s = spark.createDataFrame([(0, [3.0], 100.0, softpdf.gaussian(2, 0.1).row())], f"soft_id long, coords array<double>, t double, pdf {softpdf.SCHEMA}")
    near = predict.bme_predict_st(points.withColumn("t", F.lit(100.0)), hard, s, cov).first()
    assert near["mean"] == pytest.approx(2, abs=0.2) and near["info"].startswith("full_st_bme")


def test_network(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    cov = network.NetworkCovariance.of(edges, 10, 0.5)
    hard = spark.createDataFrame([(0, 0, 0.0), (9, 9, 0.0)], "obs_id long, node long, z double")
    s = spark.createDataFrame([(4, 4, softpdf.gaussian(3, 0.5).row())], f"soft_id long, node long, pdf {softpdf.SCHEMA}")
    point = spark.createDataFrame([(5, 5), (0, 0)], "est_id long, node long")
    base = {r["est_id"]: r for r in predict.bme_predict_network(point, hard, None, cov).collect()}
    got = {r["est_id"]: r for r in predict.bme_predict_network(point, hard, s, cov).collect()}
    assert got[5]["mean"] > base[5]["mean"] and got[0]["info"] == "duplicate"
    st = network.NetworkSpaceTime(cov, Covariance("exponential", [1, 3]))
    block = st.block([2], [0.0], [2], [5.0]) / st.block([2], [0.0], [2], [0.0])
    assert float(block[0, 0]) == pytest.approx(math.exp(-5))
    timed = predict.bme_predict_network_st(point.withColumn("t", F.lit(1.0)), hard.withColumn("t", F.lit(0.0)), None, st).collect()
    assert all(np.isfinite(r["mean"]) for r in timed)


def test_yearly_maps_in_parts(spark):
    rows = spark.createDataFrame([(2000 + i % 2, float(i * 3 % 7), float(i * 5 % 11), float(i)) for i in range(12)], "year long, x double, y double, z double")
    cells = spark.range(50).select((F.col("id") % 7 + 0.3).alias("x"), (F.floor(F.col("id") / 7) + 0.4).alias("y"))
    one, many = (sorted(map(tuple, predict.yearly_kriging(rows, cells, Covariance("exponential", [1, 10]), n).collect())) for n in (1000, 9))
    assert len(one) == 100 and one == [pytest.approx(x) for x in many]


def test_yearly_maps(spark):
    rows = spark.createDataFrame([(2000, 0.0, 0.0, 1.0), (2000, 5.0, 0.0, 2.0), (2000, 0.0, 5.0, 3.0), (2001, 0.0, 0.0, 1.0)], "year long, x double, y double, z double")
    got = {(r["year"], r["x"]): r for r in predict.yearly_kriging(rows, spark.createDataFrame([(0.0, 0.0), (9.0, 9.0)], "x double, y double"), Covariance("exponential", [1, 10])).collect()}
    assert got[2000, 0.0]["estimate"] == pytest.approx(1, abs=1e-6) and math.isnan(got[2001, 0.0]["estimate"])
