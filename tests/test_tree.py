"""The tree of boxes and tiles of trees against all distances."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.covariance import Covariance
from plumbline.operators import neighbors, predict
from plumbline.operators.tree import Tree
from plumbline.plans import queries


def brute(at, own, ids, k, dmax=math.inf, tmax=math.inf, ratio=None, skip=None):
    out = []
    for i, a in enumerate(at):
        gap = np.abs(a[-1] - own[:, -1]) if ratio is not None else np.zeros(len(own))
        dims = own.shape[1] - (ratio is not None)
        d = np.sqrt(sum((a[j] - own[:, j]) ** 2 for j in range(dims)))
        c = np.flatnonzero((d <= dmax) & (gap <= tmax) & (True if skip is None else ids != skip[i]))
        c = c[np.lexsort((ids[c], (d + (ratio or 0) * gap)[c]))][:k]
        out += [(i, int(x), float(d[x]), q + 1) for q, x in enumerate(c)]
    return out


@pytest.mark.parametrize(("n", "k", "dmax", "tmax", "ratio", "lattice"), [(3000, 20, math.inf, math.inf, None, True), (2000, 3, 2.0, math.inf, None, False), (2000, 8, math.inf, 2.0, 0.5, True), (2000, 8, 9.0, 6.0, 0.5, True), (2000, 4, math.inf, 1.0, 0.0, True), (10, 20, math.inf, math.inf, None, True), (2000, 8, math.inf, 0.5, 0.5, False)])
def test_tree_equals_all_distances(n, k, dmax, tmax, ratio, lattice):
    g = np.random.default_rng(1)
    own = g.integers(0, 20, (n, 3)).astype(float) if lattice else g.uniform(0, 30, (n, 3))
    own, ids = own[:, : 2 + (ratio is not None)], g.permutation(n)
    at = g.uniform(-40, 60, (150, own.shape[1]))
    at[:50] = own[g.integers(0, n, 50)]
    for skip in (None, g.integers(0, n, len(at))):
        got = Tree(own, ids, k + (skip is not None), ratio).nearest(at, k, dmax, tmax, skip)
        assert list(zip(*(x.tolist() for x in got))) == brute(at, own, ids, k, dmax, tmax, ratio, skip)


def test_tree_leaves_most_pairs_out():
    """All distances of these would take minutes."""
    i = np.arange(300_000)
    own = np.stack([i % 97, i // 97], axis=1).astype(float)
    start = time.monotonic()
    r, c, d, _ = neighbors.nearest(own, own, i, 1)
    assert (r == c).all() and not d.any() and time.monotonic() - start < 60


def test_points_far_from_many_data_of_few_places():
    i = np.arange(200_000)
    own, at = np.stack([i % 89, i // 89 % 23], axis=1).astype(float), np.stack([np.arange(500) % 89 + 0.3, np.arange(500) + 100.0], axis=1)
    got = neighbors.nearest(at, own, i, 3)
    few = np.arange(3 * 2047)
    assert list(zip(*(x.tolist() for x in got))) == brute(at, own[few], few, 3)


@pytest.fixture
def tables(spark):
    n = 2000
    obs = spark.range(n).select(F.col("id").alias("obs_id"), F.array(F.pmod("id", F.lit(23)).cast("double"), F.floor(F.col("id") / 23).cast("double")).alias("coords"), F.pmod(F.col("id") * 7, F.lit(24)).cast("double").alias("t"), F.col("id").cast("double").alias("z"))
    # All in a corner of the data, far outside, at data, and nowhere.
    at = F.when(F.col("id") < 200, F.array(F.col("id") / 200.0, F.col("id") / 300.0)).when(F.col("id") < 220, F.array(F.col("id") * 1.0, F.lit(-50.0))).when(F.col("id") < 239, F.array(F.lit(3.0), F.col("id") - 200.0))
    return spark.range(240).select(F.col("id").alias("est_id"), at.alias("coords"), F.pmod("id", F.lit(24)).cast("double").alias("t")), obs


def test_tiles_give_what_one_tree_gives(tables, monkeypatch):
    est, obs = tables
    monkeypatch.setattr(neighbors, "TILE", 150)
    monkeypatch.setattr(neighbors, "TILE_POINTS", 30)

    def rows(df):
        return sorted(map(tuple, df.select("est_id", "rank", "obs_id", "distance").collect()))

    for o in ({}, {"dmax": 4.0}, {"exclude_same": True}):
        assert rows(neighbors.knn(est, obs, 7, strategy="blocks", **o)) == rows(neighbors.knn(est, obs, 7, strategy="rounds", **o))
    for o in ({"tmax": 6.0}, {"tmax": 2.0, "dmax": 6.0}, {}):
        want = rows(neighbors.knn_st(est, obs, 6, ratio=0.5, exact=True, **o))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(neighbors, "BROADCAST_VALUES", 500)
            assert rows(neighbors.knn_st(est, obs, 6, ratio=0.5, exact=True, **o)) == want


def test_estimates_by_tiles_are_those_by_one_tree(tables, monkeypatch):
    est, obs = tables
    want = sorted(map(str, predict.bme_predict(est, obs, None, Covariance("exponential", [4, 12]), nhmax=4, n_grid=20).select("est_id", F.round("mean", 8), "info", "n_hard").collect()))
    for module in (neighbors, predict):
        monkeypatch.setattr(module, "BROADCAST_VALUES", 500)
    monkeypatch.setattr(neighbors, "TILE", 150)
    assert sorted(map(str, predict.bme_predict(est, obs, None, Covariance("exponential", [4, 12]), nhmax=4, n_grid=20).select("est_id", F.round("mean", 8), "info", "n_hard").collect())) == want


def test_few_rows_of_one_file_are_dealt_over_tasks(tables):
    est, obs = tables
    assert neighbors.knn(est.coalesce(1), obs, 3).rdd.getNumPartitions() == 4


def test_many_dimensions_equal_all_distances():
    g = np.random.default_rng(2)
    own, ids = np.round(g.normal(size=(400, 16)), 1), g.permutation(400)
    own[200:] = own[:200]
    got = neighbors.nearest(own, own, ids, 3, skip=ids)
    assert list(zip(*(x.tolist() for x in got))) == brute(own, own, ids, 3, skip=ids)


def test_space_time_queries_rank_all_data(spark, monkeypatch):
    """no cap on the candidates. The one datum of the point's own hour lies behind 60 nearer ones of other hours."""
    est = spark.createDataFrame([(0, [0.0, 0.0], 0.0)], "est_id long, coords array<double>, t double")
    obs = spark.createDataFrame([(i, [1.0 + i / 100, 0.0], 6.0, float(i)) for i in range(60)] + [(60, [2.0, 0.0], 0.0, 60.0)], "obs_id long, coords array<double>, t double, z double")
    monkeypatch.setattr(queries, "_timed", lambda spark, sf_dir: (est, obs))
    got = queries.QUERIES["knn_space_time"](spark, "").orderBy("rank").first()
    assert (got["obs_id"], got["distance"], got["gap"], got["rank"]) == (60, 2.0, 0.0, 1)
    seen = {}
    monkeypatch.setattr(queries.predict, "bme_predict_st", lambda *a, **o: seen.update(o) or est)
    monkeypatch.setattr(queries, "_soft", lambda spark, sf_dir: est.withColumnRenamed("est_id", "soft_id"))
    queries.QUERIES["bme_space_time"](spark, "")
    assert seen["exact"] is True


@pytest.mark.parametrize("method", ["ep", "lis"])
def test_all_methods_have_the_same_neighbours(monkeypatch, method):
    """twelve hard and three soft neighbours, as the other methods have."""
    seen = {}
    for name in ("suppliers", "parts", "_soft"):
        monkeypatch.setattr(queries, name, lambda spark, sf_dir: None)

    class Rows:
        def drop(self, *columns):
            return self

    monkeypatch.setattr(queries.predict, "bme_predict", lambda *a, **o: seen.update(o) or Rows())
    queries.QUERIES[f"bme_{method}"](None, "")
    assert (seen["nhmax"], seen["nsmax"], seen["method"]) == (12, 3, method)
