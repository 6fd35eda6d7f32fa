"""Queries whose results have closed forms, which the SQL states: integrators, modes, densities, networks, and kriging on them.

Parameters come from the tables' keys, so that each row is a case of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import softpdf
from plumbline.functions.covariance import Covariance, SpaceTime
from plumbline.operators import kernels, mesh, neighbors, network, predict, timeseries

from .queries import EDGES_SQL, ST, D, K, P, S, _lattice, _ring, _soft, _timed, events, nation_edges, parts, query, r, suppliers

# --- integrators, modes and summaries -------------------------------------------------------------------------------------

#: Mean and variance of a prior, and of a Gaussian factor, by key.
_CASE = "c AS (SELECT est_id, (est_id % 21 - 10) / 10.0::DOUBLE AS m, (1 + (est_id % 5) * 0.5)::DOUBLE AS v, (est_id % 7 - 3) / 4.0::DOUBLE AS mu, (1.2 + (est_id % 3) * 0.4)::DOUBLE AS s FROM s)"


def _case(e: int) -> tuple[float, float, float, float]:
    return (e % 21 - 10) / 10, 1 + (e % 5) * 0.5, (e % 7 - 3) / 4, 1.2 + (e % 3) * 0.4


def _by_key(keys: DataFrame, one, schema: str) -> DataFrame:
    """``one(key) -> tuple`` over the keys, in batches dealt over all tasks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(int(e)) for e in batch.iloc[:, 0]], columns=names)

    return neighbors.dealt(keys).mapInPandas(run, schema)


_CLOSE = {"gauss_hermite": 0.05, "mc": 0.1, "qmc": 0.1, "ep": 0.01}


@query("integrators", f"WITH {S}, {_CASE} SELECT est_id, round(exp(-0.5 * (m - mu) * (m - mu) / (v + s * s)) / sqrt(2 * pi() * (v + s * s)), 7) AS laplace, round(exp(-0.5 * (m - mu) * (m - mu) / (v + s * s)) / sqrt(2 * pi() * (v + s * s)), 7) AS lis, TRUE AS gauss_hermite, TRUE AS mc, TRUE AS qmc, TRUE AS ep FROM c")
def integrators(spark, sf_dir):
    """One Gaussian factor: exact for Laplace and importance sampling, near the closed form for the others."""

    def one(e):
        m, v, mu, s = _case(e)
        want = math.exp(-0.5 * (m - mu) ** 2 / (v + s * s)) / math.sqrt(2 * math.pi * (v + s * s))
        f = [softpdf.gaussian(mu, s, 60)]
        got = {k: float(kernels.integrate([[m]], [[v]], f, k, seed=e)[0]) for k in kernels.METHODS[1:]}
        return (e, got["laplace"], got["lis"], *(abs(got[k] / want - 1) < tol for k, tol in _CLOSE.items()))

    got = _by_key(suppliers(spark, sf_dir).select("est_id"), one, "est_id long, laplace double, lis double, gauss_hermite boolean, mc boolean, qmc boolean, ep boolean")
    return got.withColumns({"laplace": r("laplace", 7), "lis": r("lis", 7)})


_TWO = "exp(-0.5 * (b * p * p - 2 * 0.3 * p * q + a * q * q) / (a * b - 0.09)) / (2 * pi() * sqrt(a * b - 0.09))"


@query("integrators_two", f"WITH {S}, {_CASE}, t AS (SELECT est_id, v + s * s AS a, v + 3.25 AS b, m - mu AS p, -m - 0.25 AS q FROM c) SELECT est_id, round({_TWO}, 7) AS laplace, TRUE AS gauss_hermite, TRUE AS ep FROM t")
def integrators_two(spark, sf_dir):
    """Two Gaussian factors under a correlated prior; the batch of two means gives each the value it has alone."""

    def one(e):
        m, v, mu, s = _case(e)
        f, cov, means = [softpdf.gaussian(mu, s, 60), softpdf.gaussian(0.25, 1.5, 60)], [[v, 0.3], [0.3, v + 1.0]], [[m, 0.0 - m], [m, m]]
        a, b, p, q = v + s * s, v + 3.25, m - mu, -m - 0.25
        want = math.exp(-0.5 * (b * p * p - 0.6 * p * q + a * q * q) / (a * b - 0.09)) / (2 * math.pi * math.sqrt(a * b - 0.09))
        got = {k: float(kernels.integrate(means, cov, f, k)[0]) for k in ("laplace", "gauss_hermite", "ep")}
        return e, got["laplace"], abs(got["gauss_hermite"] / want - 1) < 0.05, abs(got["ep"] / want - 1) < 0.01

    got = _by_key(suppliers(spark, sf_dir).select("est_id"), one, "est_id long, laplace double, gauss_hermite boolean, ep boolean")
    return got.withColumn("laplace", r("laplace", 7))


@query("posterior_mode", f"""WITH {S}, {_CASE}, t AS (SELECT *, (m / v + mu / (s * s)) / (1 / v + 1 / (s * s)) AS x FROM c)
 SELECT est_id, round(x, 6) AS mode, round(1 / v + 1 / (s * s), 6) AS curvature, round(-(0.5 - m) / v - (0.5 - mu) / (s * s), 6) AS slope, round(-0.5 * (x - m) * (x - m) / v - 0.5 * (x - mu) * (x - mu) / (s * s) - ln(s * sqrt(2 * pi())), 6) AS value,
 round(least(greatest(30 * s / 24, 0.05), 2.0), 6) AS eps FROM t""")
def posterior_mode(spark, sf_dir):
    """Mode of a normal prior times a normal factor, with the target's value, slope, curvature and step of differences."""

    def one(e):
        m, v, mu, s = _case(e)
        t = kernels.Target(np.array([[1 / v]]), [softpdf.gaussian(mu, s)])
        x, bend = t.mode([m], np.array([m]))
        return e, x[0], bend[0, 0], t.derivatives(np.array([0.5]), np.array([m]))[0][0], t.value(x, np.array([m])), t.eps[0]

    got = _by_key(suppliers(spark, sf_dir).select("est_id"), one, "est_id long, mode double, curvature double, slope double, value double, eps double")
    return got.select("est_id", *(r(c).alias(c) for c in got.columns[1:]))


@query("quadrature_points", "SELECT n::BIGINT AS n, CASE WHEN n <= 1 THEN 20 WHEN n = 2 THEN 12 WHEN n = 3 THEN 8 WHEN n = 4 THEN 6 WHEN n <= 6 THEN 5 WHEN n <= 8 THEN 4 ELSE 0 END::BIGINT AS points FROM (SELECT unnest(range(0, 12)) AS n)")
def quadrature_points(spark, sf_dir):
    return _by_key(spark.range(12), lambda n: (n, kernels.quadrature_points(n, 15)), "n long, points long")


def _summary_sql() -> str:
    """One hard and one Gaussian soft neighbour: the factor is a normal density of the conditional mean. 200 grid points."""
    return f"""WITH {P}, {S}, {D}, {K(1)},
 c AS (SELECT c_custkey::BIGINT AS soft_id, (c_custkey % 89 + 0.43)::DOUBLE AS x, (floor(c_custkey / 89) % 23 + 0.77)::DOUBLE AS y, (900 + c_custkey % 211)::DOUBLE AS mu FROM customer),
 n AS (SELECT * FROM (SELECT s.est_id, c.*, row_number() OVER (PARTITION BY s.est_id ORDER BY sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)), soft_id) AS i, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS hs FROM s, c) WHERE i = 1),
 b AS (SELECT k.est_id, k.z - 950 AS zh, n.mu - 950 AS ms, 40000 * exp(-3 * k.distance / 12) AS kh, 40000 * exp(-3 * n.hs / 12) AS ks, 40000 * exp(-3 * sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) / 12) AS sh FROM k JOIN n USING (est_id) JOIN p USING (obs_id)),
 u AS (SELECT *, kh * zh / 40000.0000000001 AS mk, greatest(40000 - kh * kh / 40000.0000000001, 1e-12) AS vk, 40000.0000000001 * 40000.0000000002 - kh * kh AS det FROM b),
 v AS (SELECT *, (ks * 40000.0000000002 - sh * kh) / det AS bk, (sh * 40000.0000000001 - ks * kh) / det AS bh FROM u),
 w AS (SELECT *, 40000.0000000002 - bk * ks - bh * sh + 1e-10 AS vs, least(mk - 5 * sqrt(vk), ms - 200 - 2 * sqrt(vk)) AS low, greatest(mk + 5 * sqrt(vk), ms + 200 + 2 * sqrt(vk)) AS high FROM v),
 g AS (SELECT *, low + (high - low) * j / 199 AS z FROM w, (SELECT unnest(range(0, 200)) AS j)),
 f AS (SELECT est_id, j, z, CASE WHEN j IN (0, 199) THEN 0.5 ELSE 1 END AS t, exp(-0.5 * (z - mk) * (z - mk) / vk - 0.5 * (bk * z + bh * zh - ms) * (bk * z + bh * zh - ms) / (vs + 1600)) AS pdf FROM g),
 m AS (SELECT est_id, sum(z * pdf * t) / sum(pdf * t) AS mean, arg_max(z, pdf) AS mode FROM f GROUP BY est_id),
 q AS (SELECT *, sum(pdf) OVER (PARTITION BY est_id ORDER BY j) / sum(pdf) OVER (PARTITION BY est_id) AS cdf FROM f),
 i AS (SELECT est_id, min(z) FILTER (cdf >= 0.025) AS low, min(z) FILTER (cdf >= 0.975) AS high FROM q GROUP BY est_id),
 d2 AS (SELECT est_id, mean, mode, sum((z - mean) * (z - mean) * pdf * t) / sum(pdf * t) AS variance, sum((z - mean) * (z - mean) * (z - mean) * pdf * t) / sum(pdf * t) AS third FROM f JOIN m USING (est_id) GROUP BY ALL)
 SELECT est_id, round(950 + mean, 2) AS mean, round(950 + mode, 2) AS mode, round(variance, 1) AS variance, round(third / pow(variance, 1.5), 3) + 0.0 AS skewness, round(950 + i.low, 2) AS ci_lower, round(950 + i.high, 2) AS ci_upper, 1 AS n_hard, 1 AS n_soft FROM d2 JOIN i USING (est_id)"""


@query("posterior_summary", _summary_sql())
def posterior_summary(spark, sf_dir):
    """Laplace is exact for a Gaussian density: mean, mode, variance, skewness and interval of each point's posterior."""
    got = predict.bme_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), _soft(spark, sf_dir), Covariance("exponential", [40000, 12]), nhmax=1, nsmax=1, order=None, mean_prior=950.0, method="laplace", density=False)
    return got.select("est_id", *(r(c, 2).alias(c) for c in ("mean", "mode", "ci_lower", "ci_upper")), r("variance", 1).alias("variance"), (r("skewness", 3) + 0.0).alias("skewness"), "n_hard", "n_soft")


@query("kriging_space_time_one", f"""WITH {P}, {S}, {D}, {ST}, c AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance, obs_id) AS near FROM t),
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance + 0.5 * gap, obs_id) AS rank FROM c WHERE near <= 50), v AS (SELECT *, 40000 * exp(-3 * distance / 12) * exp(-3 * gap / 18) AS c0 FROM k WHERE rank = 1)
 SELECT est_id, round(950 + c0 / 40000.0000000001 * (z - 950), 3) AS kriging_mean, round(40000 - c0 * c0 / 40000.0000000001, 3) AS kriging_var, 1 AS n_hard FROM v""")
def kriging_space_time_one(spark, sf_dir):
    est, obs = _timed(spark, sf_dir)
    got = predict.bme_predict_st(est, obs, None, SpaceTime("exponential", [1, 12], "exponential", [1, 18], 40000.0), nhmax=1, order=None, mean_prior=950.0, ratio=0.5, density=False)
    return got.select("est_id", r("kriging_mean", 3).alias("kriging_mean"), r("kriging_var", 3).alias("kriging_var"), "n_hard")


@query("design", f"WITH {P} SELECT obs_id, [1.0, x, y, x * x, x * y, y * y]::DOUBLE[] AS terms FROM p")
def design(spark, sf_dir):
    def run(batches):
        for b in batches:
            at = np.array(b["coords"].tolist(), float).reshape(len(b), 2)
            yield pd.DataFrame({"obs_id": b["obs_id"], "terms": kernels.design(at, 2).tolist()})

    return parts(spark, sf_dir).select("obs_id", "coords").mapInPandas(run, "obs_id long, terms array<double>")


@query("trend_by_line", f"WITH {P} SELECT x, round(regr_intercept(z, y) + regr_slope(z, y) * 2.5, 3) AS trend FROM p GROUP BY x HAVING count(*) > 1")
def trend_by_line(spark, sf_dir):
    """The estimators' own trend of first order, along each line of equal x, at y = 2.5."""
    opt = kernels.Options(order=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["y"]].to_numpy(float)
        return pd.DataFrame({"x": [pdf["x"].iloc[0]], "trend": [kernels.trend(np.array([[2.5]]), at, pdf["z"].to_numpy(float), np.zeros((0, 1)), np.zeros(0), opt)[0]], "n": [len(pdf)]})

    got = parts(spark, sf_dir).select("x", "y", "z").groupBy("x").applyInPandas(run, "x double, trend double, n long")
    return got.where("n > 1").select("x", r("trend", 3).alias("trend"))


# --- soft densities -------------------------------------------------------------------------------------------------------


@query("soft_log", f"WITH {S}, {_CASE} SELECT est_id, round(-0.5 * (0.5 - mu) * (0.5 - mu) / (s * s) - ln(s * sqrt(2 * pi())), 6) AS log_pdf, round(-(0.5 - mu) / (s * s), 6) AS slope, round(-1 / (s * s), 6) AS curvature, round(-0.5 * (0.5 - mu) * (0.5 - mu) / (s * s) - ln(s * sqrt(2 * pi())), 6) AS shifted, round(mu - 5 * s, 6) AS low, round(mu + 5 * s, 6) AS high, TRUE AS exact FROM c")
def soft_log(spark, sf_dir):
    """Log-density, its derivatives, and the same of a shifted density at the shifted place."""

    def one(e):
        _, _, mu, s = _case(e)
        f = softpdf.gaussian(mu, s)
        return (e, float(f.log(0.5)), float(f.slope(0.5)), float(f.curvature(0.5)), float(f.shifted(0.75).log(-0.25)), *f.support, f.analytic is not None)

    got = _by_key(suppliers(spark, sf_dir).select("est_id"), one, "est_id long, log_pdf double, slope double, curvature double, shifted double, low double, high double, exact boolean")
    return got.select("est_id", *(r(c).alias(c) for c in got.columns[1:-1]), "exact")


def _trapezoid(x, y) -> float:
    return float(sum((b - a) * (u + w) / 2 for a, b, u, w in zip(x[:-1], x[1:], y[:-1], y[1:], strict=True)))


def _truncnorm_sql() -> str:
    x = [-60 + 90 * i / 24 for i in range(25)]
    area = _trapezoid(x, [math.exp(-0.5 * (t / 40) ** 2) for t in x])
    mass = 0.5 * (math.erf(30 / 40 / math.sqrt(2)) - math.erf(-60 / 40 / math.sqrt(2)))
    return f"WITH {P} SELECT obs_id, round({1 / area!r}::DOUBLE, 9) AS peak, round({math.exp(-0.5 * 1.5**2) / area!r}::DOUBLE, 9) AS low, 0.0::DOUBLE AS outside, round({math.log(40 * math.sqrt(2 * math.pi)) + math.log(mass)!r}::DOUBLE, 7) AS log_norm FROM p"


@query("soft_truncnorm", _truncnorm_sql())
def soft_truncnorm(spark, sf_dir):
    z = F.col("z")
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.truncnorm_column(z, F.lit(40.0), z - 60, z + 30))
    return p.select("obs_id", r(softpdf.evaluate_column(F.col("pdf"), z), 9).alias("peak"), r(softpdf.evaluate_column(F.col("pdf"), z - 60), 9).alias("low"), softpdf.evaluate_column(F.col("pdf"), z + 31).alias("outside"), r(F.col("pdf.analytic.log_norm"), 7).alias("log_norm"))


def _lognormal_sql() -> str:
    rows = []
    for k in range(5):
        mu, sigma = k / 10, 0.6
        low, high = math.exp(mu - 5 * sigma), math.exp(mu + 5 * sigma)
        x = [low + (high - low) * i / 29 for i in range(30)]
        y = [math.exp(-0.5 * ((math.log(t) - mu) / sigma) ** 2) / t for t in x]
        rows.append(f"({k}, {y[1] / _trapezoid(x, y)!r}::DOUBLE)")
    return f"WITH {P}, v AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(k, d)) SELECT obs_id, round(d, 7) AS second FROM p JOIN v ON v.k = obs_id % 5"


@query("soft_lognormal", _lognormal_sql())
def soft_lognormal(spark, sf_dir):
    """The density at the second grid point."""
    mu = F.pmod("obs_id", F.lit(5)) / 10
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.lognormal_column(mu, F.lit(0.6)))
    return p.select("obs_id", r(F.get("pdf.dens", F.lit(1)), 7).alias("second"))


@query("soft_histogram", f"WITH {P} SELECT obs_id, 0.125::DOUBLE AS first, 0.25::DOUBLE AS second, 0.0::DOUBLE AS outside FROM p")
def soft_histogram(spark, sf_dir):
    z = F.col("z")
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.histogram_column(F.array(z - 3, z - 1, z + 2), F.array(F.lit(1.0), F.lit(2.0))))
    return p.select("obs_id", *(r(softpdf.evaluate_column(F.col("pdf"), z + d), 9).alias(n) for n, d in (("first", -2), ("second", 1), ("outside", 5))))


@query("soft_linear", f"WITH {P} SELECT obs_id, round(1 / 5.5::DOUBLE, 9) AS rising, round(1.5 / 5.5::DOUBLE, 9) AS falling, round(2 / 5.5::DOUBLE, 9) AS top FROM p")
def soft_linear(spark, sf_dir):
    z = F.col("z")
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.linear_column(F.array(z - 1, z, z + 3), F.array(F.lit(0.0), F.lit(2.0), F.lit(1.0))))
    return p.select("obs_id", *(r(softpdf.evaluate_column(F.col("pdf"), z + d), 9).alias(n) for n, d in (("rising", -0.5), ("falling", 1.5), ("top", 0.0))))


def _mixture_sql() -> str:
    def triangle(t, a, m, b):
        return max(0.0, 2 / (b - a) * ((t - a) / (m - a) if t <= m else (b - t) / (b - m)))

    x = [-50 + 150 * i / 59 for i in range(60)]
    y = [0.75 * triangle(t, -50, 0, 50) + 0.25 * triangle(t, 0, 50, 100) for t in x]
    curve = [max(0.0, 1 - (t / 10) ** 2) for t in (-12 + 24 * i / 49 for i in range(50))]
    step = 24 / 49
    return f"WITH {P} SELECT obs_id, round({y[20] / _trapezoid(x, y)!r}::DOUBLE, 9) AS mixed, round({curve[24] / (step * sum(curve))!r}::DOUBLE, 9) AS sampled FROM p"


@query("soft_mixture", _mixture_sql())
def soft_mixture(spark, sf_dir):
    """A mixture of two triangles, and a density from a formula, at one of their grid points each."""
    z = F.col("z")
    triangles = [softpdf.triangular_column(z - 50, z, z + 50), softpdf.triangular_column(z, z + 50, z + 100)]
    p = neighbors.dealt(parts(spark, sf_dir)).withColumns({"t0": triangles[0], "t1": triangles[1]})
    p = p.withColumns({"mix": softpdf.mixture_column([F.col("t0"), F.col("t1")], [3.0, 1.0]), "own": softpdf.sampled_column(lambda t: 1 - ((t - z) / 10) * ((t - z) / 10), z - 12, z + 12)})
    return p.select("obs_id", r(F.get("mix.dens", F.lit(20)), 9).alias("mixed"), r(F.get("own.dens", F.lit(24)), 9).alias("sampled"))


# --- networks: a ring's Laplacian has cosines as eigenvectors -----------------------------------------------------------------


def _ring_sql(n: int, value: str) -> str:
    """Entries by distance d around a ring of n nodes; ``value`` is a function of the eigenvalue ``l``."""
    return f"e AS (SELECT k, 2 - 2 * cos(2 * pi() * k / {n}) AS l FROM (SELECT unnest(range(0, {n})) AS k)), g AS (SELECT d, avg(cos(2 * pi() * k * d / {n}) * ({value})) AS c FROM e, (SELECT unnest(range(0, {n})) AS d) GROUP BY d)"


@query("network_decay", f"WITH {_ring_sql(40, '1 / (0.25 + l)')} SELECT least(d, 40 - d)::BIGINT AS hop, round(avg(c) / (SELECT c FROM g WHERE d = 0), 6) AS correlation, count(*)::BIGINT AS n FROM g GROUP BY 1")
def network_decay(spark, sf_dir):
    cov = network.NetworkCovariance.of(_ring(spark), 40, 0.5)
    return network.decay_by_hop(cov.table(spark), _ring(spark), 0).select("hop", r("correlation").alias("correlation"), "n")


@query("network_footprint", f"WITH {_ring_sql(40, '1 / (0.25 + l)')} SELECT d::BIGINT AS j, round(c / (SELECT c FROM g WHERE d = 0), 6) AS c FROM g")
def network_footprint(spark, sf_dir):
    return network.footprint(network.NetworkCovariance.of(_ring(spark), 40, 0.5).table(spark), 0).select("j", r("c").alias("c"))


@query("network_diffusion", f"WITH {_ring_sql(40, '3 * exp(-0.7 * l)')} SELECT d::BIGINT AS j, round(c, 6) AS c FROM g")
def network_diffusion(spark, sf_dir):
    cov = network.NetworkCovariance.of(_ring(spark), 40, 0.7, 3.0, "diffusion")
    return cov.table(spark).where("i = 0").select("j", r("c").alias("c"))


@query("network_precision", f"WITH {_ring_sql(40, '2 / (2.25 + l)')} SELECT d::BIGINT AS j, round(c, 6) AS c, round((SELECT c FROM g WHERE d = 0), 6) AS variance FROM g")
def network_precision(spark, sf_dir):
    """Covariances with node 0 and marginal variances, of the precision form."""
    cov = network.NetworkCovariance.of(_ring(spark), 40, 1.5, 2.0, "precision")
    return _by_key(spark.range(40), lambda j: (j, float(cov.block([0], [j])[0, 0]), float(cov.variance([j])[0])), "j long, c double, variance double").select("j", r("c").alias("c"), r("variance").alias("variance"))


@query("network_space_time", f"WITH {_ring_sql(40, '1 / (0.25 + l)')} SELECT d::BIGINT AS j, round(5 * c / (SELECT c FROM g WHERE d = 0) * exp(-3 * (d % 4) / 9.0), 6) AS c FROM g")
def network_space_time(spark, sf_dir):
    """Covariances of node 0 at time 0 with node j at time j % 4."""
    cov = network.NetworkSpaceTime(network.NetworkCovariance.of(_ring(spark), 40, 0.5), Covariance("exponential", [1.0, 9.0]), 5.0)
    return _by_key(spark.range(40), lambda j: (j, float(cov([0], [0.0], [j], [float(j % 4)])[0, 0])), "j long, c double").select("j", r("c").alias("c"))


@query("network_ranked", f"""WITH {_ring_sql(40, '1 / (0.25 + l)')}, n AS (SELECT unnest(range(0, 40)) AS est_id), o AS (SELECT unnest([0, 7]) AS obs_id),
 k AS (SELECT est_id, obs_id, c, row_number() OVER (PARTITION BY est_id ORDER BY c DESC) AS i FROM n, o JOIN g ON d = abs(est_id - obs_id)) SELECT est_id::BIGINT AS est_id, obs_id::BIGINT AS obs_id, round(c, 6) AS c, 1 AS rank FROM k WHERE i = 1""")
def network_ranked(spark, sf_dir):
    """The better correlated of two data for each node of a ring, from the table of covariances."""
    nodes = spark.range(40).select(F.col("id").alias("est_id"), F.col("id").alias("node"))
    got = predict.rank_network_data(nodes, nodes.where("node IN (0, 7)").withColumnRenamed("est_id", "obs_id"), network.NetworkCovariance.of(_ring(spark), 40, 0.5).table(spark), 1)
    return got.select("est_id", "obs_id", r("c").alias("c"), "rank")


@query("conjugate_gradient", f"WITH {_ring_sql(16, '1 / (1 + l)')} SELECT j::BIGINT AS node, round(a.c - 2 * b.c, 6) AS x FROM (SELECT unnest(range(0, 16)) AS j) JOIN g a ON a.d = abs(j - 3) JOIN g b ON b.d = abs(j - 11)")
def conjugate_gradient(spark, sf_dir):
    e = _ring(spark, 16)
    q = network.precision(network.laplacian(network.adjacency(e)), spark.range(16).withColumnRenamed("id", "node"), 1.0)
    return network.conjugate_gradient(q, spark.createDataFrame([(3, 1.0), (11, -2.0)], "node long, x double")).select("node", r("x").alias("x"))


_NODE_DATA = f"{P}, o AS (SELECT obs_id % 40 AS node, avg(z) AS z FROM p GROUP BY 1)"


@query("network_kriging_one", f"""WITH {_NODE_DATA}, {_ring_sql(60, '40000 / (0.25 + l)')}, n AS (SELECT unnest(range(0, 60)) AS est_id), v AS (SELECT c FROM g WHERE d = 0),
 k AS (SELECT n.est_id, o.node, o.z, g.c, row_number() OVER (PARTITION BY n.est_id ORDER BY round(g.c, 6) DESC, o.node) AS i FROM n, o JOIN g ON g.d = abs(n.est_id - o.node))
 SELECT k.est_id::BIGINT AS est_id, round(CASE WHEN k.est_id < 40 THEN k.z ELSE 950 + k.c / v.c * (k.z - 950) END, 3) AS mean, round(CASE WHEN k.est_id < 40 THEN 0 ELSE v.c - k.c * k.c / v.c END, 2) AS variance, 1 AS n_hard FROM k, v WHERE i = 1""")
def network_kriging_one(spark, sf_dir):
    """A ring of 60 nodes with data on the first 40; each node from its one best correlated datum."""
    cov = network.NetworkCovariance.of(_ring(spark, 60), 60, 0.5, 40000.0)
    got = predict.bme_predict_network(spark.range(60).select(F.col("id").alias("est_id"), F.col("id").alias("node")), _node_data(spark, sf_dir), None, cov, nhmax=1, order=None, mean_prior=950.0)
    return got.select("est_id", r("mean", 3).alias("mean"), r("variance", 2).alias("variance"), "n_hard")


def _node_data(spark, sf_dir) -> DataFrame:
    return parts(spark, sf_dir).groupBy(F.pmod("obs_id", F.lit(40)).alias("node")).agg(F.avg("z").alias("z")).select(F.col("node").alias("obs_id"), "node", "z")


@query("network_kriging_one_st", f"""WITH {_NODE_DATA}, {_ring_sql(60, '1 / (0.25 + l)')}, n AS (SELECT unnest(range(0, 60)) AS est_id), v AS (SELECT c FROM g WHERE d = 0),
 t AS (SELECT n.est_id, o.node, o.z, 40000 * g.c / v.c * exp(-3 * abs(n.est_id * 0.37 % 5 - o.node * 0.53 % 4) / 9) AS c FROM n, v, o JOIN g ON g.d = abs(n.est_id - o.node)),
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY c DESC, node) AS i FROM t)
 SELECT est_id::BIGINT AS est_id, round(950 + c / 40000 * (z - 950), 2) AS mean, round(40000 - c * c / 40000, 1) AS variance FROM k WHERE i = 1""")
def network_kriging_one_st(spark, sf_dir):
    cov = network.NetworkSpaceTime(network.NetworkCovariance.of(_ring(spark, 60), 60, 0.5), Covariance("exponential", [1.0, 9.0]), 40000.0)
    hard = _node_data(spark, sf_dir).withColumn("t", F.col("node") * 0.53 % 4)
    est = spark.range(60).select(F.col("id").alias("est_id"), F.col("id").alias("node"), (F.col("id") * 0.37 % 5).alias("t"))
    got = predict.bme_predict_network_st(est, hard, None, cov, nhmax=1, order=None, mean_prior=950.0)
    return got.select("est_id", r("mean", 2).alias("mean"), r("variance", 1).alias("variance"))


_PLACES = "n AS (SELECT n_nationkey::BIGINT AS node, (n_nationkey % 7)::DOUBLE AS x, (n_nationkey // 7)::DOUBLE AS y FROM nation UNION ALL SELECT 1000 + r_regionkey, r_regionkey * 2.0, CASE WHEN r_regionkey = 3 THEN NULL ELSE -1.0 END FROM region)"


def _places(spark, sf_dir) -> DataFrame:
    k, g = F.col("n_nationkey").cast("long"), F.col("r_regionkey").cast("long")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("node"), (k % 7).cast("double").alias("x"), F.floor(k / 7).cast("double").alias("y"))
    return nations.union(spark.read.parquet(f"{sf_dir}/region.parquet").select((g + 1000).alias("node"), (g * 2).cast("double").alias("x"), F.when(g != 3, -1.0).alias("y")))


@query("figure_links", f"WITH {EDGES_SQL}, {_PLACES} SELECT src, dst, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.y IS NOT NULL AND b.y IS NOT NULL")
def figure_links(spark, sf_dir):
    """Links as segments; one region has no place."""
    return network.link_segments(nation_edges(spark, sf_dir), _places(spark, sf_dir))


@query("figure_nodes", f"WITH {_PLACES}, v AS (SELECT node, (node * 7 % 23)::DOUBLE AS value FROM n WHERE node < 20), c AS (SELECT quantile_cont(value, 0.95) AS cap FROM v WHERE value > 0) SELECT n.node, x, y, value, CASE WHEN value IS NOT NULL THEN round(least(value, cap), 6) END AS colour FROM n LEFT JOIN v USING (node), c WHERE y IS NOT NULL")
def figure_nodes(spark, sf_dir):
    places = _places(spark, sf_dir)
    values = places.where("node < 20").select("node", (F.col("node") * 7 % 23).cast("double").alias("value"))
    return network.node_field(places, values).select("node", "x", "y", "value", r("colour").alias("colour"))


# --- meshes ---------------------------------------------------------------------------------------------------------------


_FEM = """n AS (SELECT i::BIGINT AS id, (i % 13)::DOUBLE AS x, floor(i / 13) * 0.5 AS y FROM (SELECT unnest(range(0, 169)) AS i)),
 q AS (SELECT (i // 12) * 13 + i % 12 AS a FROM (SELECT unnest(range(0, 144)) AS i)), t AS (SELECT a, a + 1 AS b, a + 13 AS c FROM q UNION ALL SELECT a + 1, a + 14, a + 13 FROM q),
 p AS (SELECT t.*, pa.x AS ax, pa.y AS ay, pb.x AS bx, pb.y AS b_y, pc.x AS cx, pc.y AS cy FROM t JOIN n pa ON pa.id = a JOIN n pb ON pb.id = b JOIN n pc ON pc.id = c),
 h AS (SELECT *, 0.5 * abs((bx - ax) * (cy - ay) - (cx - ax) * (b_y - ay)) AS area FROM p),
 v AS (SELECT a AS id, area, cx - bx AS ex, cy - b_y AS ey, a, b, c FROM h UNION ALL SELECT b, area, ax - cx, ay - cy, a, b, c FROM h UNION ALL SELECT c, area, bx - ax, b_y - ay, a, b, c FROM h),
 f AS (SELECT u.id::BIGINT AS i, w.id::BIGINT AS j, sum(CASE WHEN u.id = w.id THEN u.area / 3 ELSE 0 END) AS mass, sum((u.ex * w.ex + u.ey * w.ey) / (4 * u.area)) AS g FROM v u JOIN v w ON u.a = w.a AND u.b = w.b AND u.c = w.c GROUP BY 1, 2)"""


@query("mesh_precision", f"""WITH {_FEM}, k AS (SELECT 0.5 AS k2, 1 / (4 * pi() * 0.5) AS tau2),
 e AS (SELECT i, j, k2 * k2 * mass + 2 * k2 * g AS v FROM f, k UNION ALL SELECT a.i, b.j, sum(a.g * b.g / m.mass) FROM f a JOIN f m ON m.i = a.j AND m.j = a.j JOIN f b ON b.i = a.j GROUP BY 1, 2)
 SELECT i, j, round(sum(v) * (SELECT tau2 FROM k), 6) + 0.0 AS v FROM e GROUP BY i, j""")
def mesh_precision(spark, sf_dir):
    return mesh.precision_entries(mesh.fem_entries(*_lattice(spark)), *mesh.matern_params(1.0, 4.0)).select("i", "j", (r("v") + 0.0).alias("v"))


@query("mesh_params", f"WITH {S} SELECT est_id, round(sqrt(8) / (1 + est_id % 9), 6) AS kappa, round(1 / (4 * pi() * 8.0 / ((1 + est_id % 9) * (1 + est_id % 9)) * (0.5 + est_id % 4)), 6) AS tau2 FROM s")
def mesh_params(spark, sf_dir):
    return _by_key(suppliers(spark, sf_dir).select("est_id"), lambda e: (e, *mesh.matern_params(0.5 + e % 4, 1.0 + e % 9)), "est_id long, kappa double, tau2 double").select("est_id", r("kappa").alias("kappa"), r("tau2").alias("tau2"))


# --- time series ------------------------------------------------------------------------------------------------------------


@query("hourly_bins", """WITH e AS (SELECT (user_id % 3)::BIGINT AS node, floor((epoch_us(ts) - 1704067200000000) / 900e6)::BIGINT AS step, avg(value) AS v FROM events GROUP BY 1, 2)
 SELECT node, (step // 4)::BIGINT AS hour, round(avg(v), 6) AS v FROM e GROUP BY 1, 2 HAVING count(*) = 4""")
def hourly_bins(spark, sf_dir):
    """The operator that averages series of quarter-hours by complete hour, on the events of three sites."""
    e = events(spark, sf_dir).groupBy(F.pmod("user_id", F.lit(3)).cast("long").alias("node"), F.floor(F.col("t") * 4).alias("step")).agg(F.avg("value").alias("v"))
    return timeseries.hourly_means(e, ["node"], 4).select("node", F.col("hour").cast("long").alias("hour"), r("v").alias("v"))


def _dry_sql() -> str:
    nodes = {n: (0.0, 0.0, 0.0) for n, *_ in timeseries.NODES} | {n: (b, s, p) for n, b, s, p in timeseries.SOURCES["soft"]}
    rows = ", ".join(f"('{n}', {b!r}::DOUBLE, {p!r}::DOUBLE)" for n, (b, _, p) in nodes.items())
    return f"""WITH h AS (SELECT unnest(range(0, 24)) AS h, unnest({timeseries.HOURLY!r}) AS hm), d AS (SELECT unnest(range(0, 7)) AS d, unnest({timeseries.DAILY!r}) AS dm),
 n AS (SELECT * FROM (VALUES {rows}) AS t(node, base, phase)), s AS (SELECT unnest(range(0, 576)) AS step)
 SELECT node, step::BIGINT AS step, round(greatest(base * hm * dm * least(greatest(1 + 0.05 * sin(2 * pi() * (step * 0.25 / 24 + phase)) + 0.03 * cos(4 * pi() * (step * 0.25 / 24 + phase)), 0.84), 1.16), 0), 6) AS dry
 FROM n, s JOIN h ON h = floor(step * 0.25) % 24 JOIN d ON d = floor(step * 0.25 / 24) % 7"""


@query("dry_weather", _dry_sql())
def dry_weather(spark, sf_dir):
    """The nominal run's inflows of all nodes without rain: multipliers by hour and day, and the daily waves."""
    return timeseries.local_inflow(spark, "soft", 576, 0.25).select("node", F.col("step").cast("long").alias("step"), r("dry").alias("dry"))


@query("unit_hydrograph", "WITH t AS (SELECT i, CASE WHEN i * 0.25 <= 2 THEN i * 0.125 ELSE (8 - i * 0.25) / 6 END AS k FROM (SELECT unnest(range(0, 33)) AS i)) SELECT i::BIGINT AS step, round(k / (SELECT sum(k) * 0.25 FROM t), 9) AS k FROM t")
def unit_hydrograph(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(timeseries.unit_hydrograph(0.25, 2.0, 3.0))), "step long, k double").select("step", r("k", 9).alias("k"))


@query("routing", """WITH a AS (SELECT i AS step, (i % 11)::DOUBLE AS v FROM (SELECT unnest(range(0, 200)) AS i)), b AS (SELECT step, 1 + coalesce(exp(-0.18) * lag(v, 2) OVER (ORDER BY step), 0) AS v FROM a),
 c AS (SELECT step, CASE WHEN step >= 2 THEN exp(-0.135) * (0.5 * lag(v, 1) OVER (ORDER BY step) + 0.5 * lag(v, 2) OVER (ORDER BY step)) ELSE 0 END AS v FROM b)
 SELECT 'a' AS node, step::BIGINT AS step, round(v, 6) AS v FROM a UNION ALL SELECT 'b', step, round(v, 6) FROM b UNION ALL SELECT 'c', step, round(v, 6) FROM c""")
def routing(spark, sf_dir):
    """Three nodes in a row, with delays of 2 and 1.5 steps."""
    own = F.when(F.col("node") == "a", F.pmod("step", F.lit(11))).when(F.col("node") == "b", 1).otherwise(0).cast("double")
    local = spark.range(600).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("node"), F.floor(F.col("id") / 3).alias("step")).withColumn("v", own)
    links = spark.createDataFrame([("a", "b", 1800.0), ("b", "c", 1350.0)], "src string, dst string, length double")
    return timeseries.routed(local, links, 0.25, 1.0, 0.1).select("node", F.col("step").cast("long").alias("step"), r("v").alias("v"))


@query("soft_inputs", """WITH n AS (SELECT n_nationkey::BIGINT AS k, (n_nationkey % 5 + 3)::DOUBLE AS depth, (n_nationkey % 7) * 0.1::DOUBLE AS rain, (n_nationkey % 11) * 0.2::DOUBLE AS soft FROM nation),
 s AS (SELECT *, 0.035 + 0.055 * sqrt(soft) + 0.02 * depth / (SELECT max(depth) FROM n) + 0.015 * rain / (SELECT max(rain) FROM n) AS sigma FROM n)
 SELECT k * 100000 + k * 2 AS soft_id, k AS node, (k * 2)::DOUBLE AS t, round(soft, 6) AS mu, round(sigma, 6) AS sigma, round(greatest(soft + 5 * sigma, 0.3), 6) AS upper FROM s WHERE k % 6 <> 0""")
def soft_inputs(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("node_id"), (k * 2).alias("hour"), (k % 5 + 3).cast("double").alias("depth"), (k % 7 * 0.1).alias("rain"), (k % 11 * 0.2).alias("soft"), (k % 6 == 0).alias("is_hard"))
    return timeseries.soft_inputs(rows).select("soft_id", "node", "t", r("mu").alias("mu"), r("sigma").alias("sigma"), r("upper").alias("upper"))
