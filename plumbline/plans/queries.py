"""Queries over the driver's tables, each with SQL for the same rows where SQL can express it.

Geometry: a part is a point at (key % 97, key div 97) with its retail price as value; events are values at hours by
user; nations and regions are a two-level graph. Rounded values make sums comparable between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import softpdf
from plumbline.functions.covariance import Covariance, SpaceTime
from plumbline.functions.special import norm_ppf_sql
from plumbline.operators import geometry, kernels, mesh, neighbors, network, predict, statistics, timeseries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, digits: int = 6) -> Column:
    return F.round(x, digits)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (obs_id, coords, x, y, z)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("obs_id"), F.pmod("p_partkey", F.lit(97)).cast("double").alias("x"), F.floor(F.col("p_partkey") / 97).cast("double").alias("y"), F.col("p_retailprice").cast("double").alias("z"))
    return p.withColumn("coords", F.array("x", "y"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimation points (est_id, coords), off the observations."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("est_id"), (F.pmod("s_suppkey", F.lit(97)) + 0.31).alias("x"), (F.floor(F.col("s_suppkey") / 97) * 3 + 0.17).alias("y"))
    return s.withColumn("coords", F.array("x", "y"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("*", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9).alias("t"))


P = "p AS (SELECT p_partkey::BIGINT AS obs_id, (p_partkey % 97)::DOUBLE AS x, floor(p_partkey / 97)::DOUBLE AS y, p_retailprice::DOUBLE AS z FROM part)"
S = "s AS (SELECT s_suppkey::BIGINT AS est_id, (s_suppkey % 97 + 0.31)::DOUBLE AS x, (floor(s_suppkey / 97) * 3 + 0.17)::DOUBLE AS y FROM supplier)"
D = "d AS (SELECT s.est_id, p.obs_id, p.z, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS distance FROM s, p)"


def K(k: int, dmax: float | None = None) -> str:
    where = f" WHERE distance <= {dmax}" if dmax else ""
    return f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance, obs_id) AS rank FROM d{where}) WHERE rank <= {k})"


EDGES_SQL = "e AS (SELECT n_nationkey::BIGINT AS src, 1000 + n_regionkey::BIGINT AS dst, (1.0 + n_nationkey % 3)::DOUBLE AS w FROM nation)"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.lit(1000) + F.col("n_regionkey")).cast("long").alias("dst"), (1.0 + F.pmod("n_nationkey", F.lit(3))).cast("double").alias("w"))


# --- neighbours -----------------------------------------------------------------------------------------------------------


@query("knn", f"WITH {P}, {S}, {D}, {K(20)} SELECT est_id, obs_id, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn(spark, sf_dir):
    return neighbors.knn(suppliers(spark, sf_dir), parts(spark, sf_dir), 20).select("est_id", "obs_id", r("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("knn_within", f"WITH {P}, {S}, {D}, {K(5, 2.5)} SELECT est_id, obs_id, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn_within(spark, sf_dir):
    return neighbors.knn(suppliers(spark, sf_dir), parts(spark, sf_dir), 5, 2.5).select("est_id", "obs_id", r("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("knn_rounds", f"WITH {P}, {S}, {D}, {K(4)} SELECT est_id, obs_id, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn_rounds(spark, sf_dir):
    return neighbors.knn(suppliers(spark, sf_dir), parts(spark, sf_dir), 4, strategy="rounds").select("est_id", "obs_id", r("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("radius_count", f"WITH {P}, {S}, {D} SELECT est_id, count(*)::BIGINT AS n FROM d WHERE distance <= 3 GROUP BY est_id")
def radius_count(spark, sf_dir):
    return neighbors.within_distance(suppliers(spark, sf_dir), parts(spark, sf_dir), 3.0).groupBy("est_id").agg(F.count(F.lit(1)).alias("n"))


def _timed(spark, sf_dir):
    est = suppliers(spark, sf_dir).withColumn("t", F.pmod("est_id", F.lit(24)).cast("double"))
    return est, parts(spark, sf_dir).withColumn("t", F.pmod(F.col("obs_id") * 7, F.lit(24)).cast("double"))


ST = "t AS (SELECT d.*, abs((d.est_id % 24) - (d.obs_id * 7 % 24))::DOUBLE AS gap FROM d)"


@query("knn_space_time", f"""WITH {P}, {S}, {D}, {ST},
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance + 0.5 * gap, obs_id) AS rank FROM t WHERE gap <= 6)
 SELECT est_id, obs_id, round(distance, 6) AS distance, gap, rank::INT AS rank FROM k WHERE rank <= 8""")
def knn_space_time(spark, sf_dir):
    est, obs = _timed(spark, sf_dir)
    return neighbors.knn_st(est, obs, 8, tmax=6, ratio=0.5, exact=True).select("est_id", "obs_id", r("distance").alias("distance"), "gap", F.col("rank").cast("int").alias("rank"))


@query("knn_space_time_exact", f"""WITH {P}, {S}, {D}, {ST},
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance + 0.5 * gap, obs_id) AS rank FROM t WHERE gap <= 6 AND distance <= 9)
 SELECT est_id, obs_id, round(distance, 6) AS distance, gap, rank::INT AS rank FROM k WHERE rank <= 8""")
def knn_space_time_exact(spark, sf_dir):
    est, obs = _timed(spark, sf_dir)
    return neighbors.knn_st(est, obs, 8, 9.0, 6, 0.5, exact=True).select("est_id", "obs_id", r("distance").alias("distance"), "gap", F.col("rank").cast("int").alias("rank"))


@query("knn_space_time_rounds", f"""WITH {P}, {S}, {D}, {ST},
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance + 0.5 * gap, obs_id) AS rank FROM t WHERE gap <= 6)
 SELECT est_id, obs_id, round(distance, 6) AS distance, gap, rank::INT AS rank FROM k WHERE rank <= 5""")
def knn_space_time_rounds(spark, sf_dir):
    """Without a radius."""
    est, obs = _timed(spark, sf_dir)
    return neighbors.knn_st(est, obs, 5, tmax=6, ratio=0.5, exact=True).select("est_id", "obs_id", r("distance").alias("distance"), "gap", F.col("rank").cast("int").alias("rank"))


@query("snap", f"WITH {P}, {S}, {D}, {K(1)} SELECT est_id, obs_id, round(distance, 6) AS distance FROM k")
def snap(spark, sf_dir):
    return neighbors.snap(suppliers(spark, sf_dir), parts(spark, sf_dir)).select("est_id", "obs_id", r("distance").alias("distance"))


@query("embedding_neighbours", """WITH v AS (SELECT vec_id, embedding FROM embeddings),
 d AS (SELECT a.vec_id AS est_id, b.vec_id AS obs_id, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance, obs_id) AS rank FROM d) SELECT est_id, obs_id, rank::INT AS rank FROM k WHERE rank <= 3""")
def embedding_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("est_id"), F.col("embedding").cast("array<double>").alias("coords"))
    return neighbors.knn(v, v.withColumnRenamed("est_id", "obs_id"), 3, exclude_same=True).select("est_id", "obs_id", F.col("rank").cast("int").alias("rank"))


@query("nearest_in_time", """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, max(value) AS value FROM events GROUP BY user_id, epoch_us(ts)),
 g AS (SELECT DISTINCT user_id, floor(epoch_us(ts) / 21600e6) * 21600 AS ts FROM events),
 c AS (SELECT g.user_id, g.ts, s.value, abs(g.ts - s.ts) AS gap, row_number() OVER (PARTITION BY g.user_id, g.ts ORDER BY abs(g.ts - s.ts), s.ts) AS i FROM g JOIN s ON g.user_id = s.user_id AND abs(g.ts - s.ts) <= 900)
 SELECT g.user_id::BIGINT AS user_id, g.ts::BIGINT AS target_ts, c.value, round(c.gap, 3) AS gap FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.ts = c.ts AND c.i = 1""")
def nearest_in_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "value")
    series = e.groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    targets = e.select("user_id", (F.floor(F.col("ts") / 21600) * 21600).cast("double").alias("ts")).distinct().withColumn("target_id", F.struct("user_id", "ts"))
    return neighbors.nearest_in_time(targets, series, 900.0, ["user_id"]).select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("long").alias("target_ts"), "value", r("gap", 3).alias("gap"))


# --- covariance ----------------------------------------------------------------------------------------------------------

_H = "distance"
_EXPONENTIAL, _GAUSSIAN = f"2.5 * exp(-3 * {_H} / 10)", f"3 * exp(-3 * ({_H} / 8) * ({_H} / 8))"
_SPHERICAL = f"1.5 * (1 - 1.5 * least({_H} / 5, 1) + 0.5 * pow(least({_H} / 5, 1), 3))"
_U = {nu: f"(sqrt(2 * {nu}) / 6 * {_H})" for nu in (0.5, 1.5, 2.5)}
_MATERN = {0.5: f"2 * exp(-{_U[0.5]})", 1.5: f"2 * (1 + {_U[1.5]}) * exp(-{_U[1.5]})", 2.5: f"2 * (1 + {_U[2.5]} + {_U[2.5]} * {_U[2.5]} / 3) * exp(-{_U[2.5]})"}


@query("covariance_models", f"""WITH {P}, {S}, {D}, {K(6)} SELECT est_id, obs_id, round({_EXPONENTIAL}, 6) AS exponential, round({_GAUSSIAN}, 6) AS gaussian, round({_SPHERICAL}, 6) AS spherical,
 round({_MATERN[0.5]}, 6) AS matern_1, round({_MATERN[1.5]}, 6) AS matern_3, round({_MATERN[2.5]}, 6) AS matern_5, CASE WHEN distance < 1e-10 THEN 4.0 ELSE 0.0 END::DOUBLE AS nugget, round(cos(pi() * distance / 12), 6) AS hole_cos,
 round({_EXPONENTIAL} + {_SPHERICAL}, 6) AS nested, round(2.5 - {_EXPONENTIAL}, 6) AS gamma FROM k""")
def covariance_models(spark, sf_dir):
    near = neighbors.knn(suppliers(spark, sf_dir), parts(spark, sf_dir), 6)
    h = F.col("distance")
    c = {
        "exponential": Covariance("exponential", [2.5, 10]), "gaussian": Covariance("gaussian", [3, 8]), "spherical": Covariance("spherical", [1.5, 5]), "matern_1": Covariance("matern", [2, 6, 0.5]),
        "matern_3": Covariance("matern", [2, 6, 1.5]), "matern_5": Covariance("matern", [2, 6, 2.5]), "nugget": Covariance("nugget", [4]), "hole_cos": Covariance("hole_cos", [1, 12]),
        "nested": Covariance(["exponential", "spherical"], [[2.5, 10], [1.5, 5]]),
    }
    return near.select("est_id", "obs_id", *(r(m.column(h)).alias(n) for n, m in c.items()), r(c["exponential"].variogram(h)).alias("gamma"))


@query("covariance_space_time", f"""WITH {P}, {S}, {D}, {ST}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY est_id ORDER BY distance, obs_id) AS rank FROM t) WHERE rank <= 6)
 SELECT est_id, obs_id, round(1.7 * {_EXPONENTIAL} * exp(-3 * gap / 12), 6) AS separable, round(2 * exp(-3 * ((distance + 0.4 * gap) / 9) * ((distance + 0.4 * gap) / 9)), 6) AS gaussian_st, round(2 * exp(-3 * (distance + 0.4 * gap) / 9), 6) AS exponential_st,
 CASE WHEN distance < 1e-10 AND gap < 1e-10 THEN 1.0 ELSE 0.0 END::DOUBLE AS nugget_st FROM k""")
def covariance_space_time(spark, sf_dir):
    est, obs = _timed(spark, sf_dir)
    near = neighbors.knn(est, obs, 6).join(est.select("est_id", F.col("t").alias("te")), "est_id").join(obs.select("obs_id", F.col("t").alias("to")), "obs_id").withColumn("gap", F.abs(F.col("te") - F.col("to")))
    h, u = F.col("distance"), F.col("gap")
    c = {"separable": SpaceTime("exponential", [2.5, 10], "exponential", [1, 12], 1.7), "gaussian_st": SpaceTime("gaussian_st", [2, 9, 0.4]), "exponential_st": SpaceTime("exponential_st", [2, 9, 0.4]), "nugget_st": SpaceTime("nugget_st", [1.0])}
    return near.select("est_id", "obs_id", *(r(m.column(h, u)).alias(n) for n, m in c.items()))


@query("pair_distance_classes", f"WITH {P}, {S}, {D} SELECT floor(distance / 10)::BIGINT AS class, count(*)::BIGINT AS n, round(min(distance), 6) AS least, round(max(distance), 6) AS largest FROM d GROUP BY 1")
def pair_distance_classes(spark, sf_dir):
    d = statistics.distance_classes(parts(spark, sf_dir), suppliers(spark, sf_dir), 10.0)
    return d.select("class", "n", r("least").alias("least"), r("largest").alias("largest"))


# --- estimation ----------------------------------------------------------------------------------------------------------


@query("kriging_one", f"""WITH {P}, {S}, {D}, {K(1)} SELECT est_id, round(950 + 40000 * exp(-3 * distance / 12) / 40000.0000000002 * (z - 950), 3) AS kriging_mean,
 round(40000 - 40000 * exp(-3 * distance / 12) * 40000 * exp(-3 * distance / 12) / 40000.0000000001, 3) AS kriging_var, 1 AS n_hard FROM k""")
def kriging_one(spark, sf_dir):
    got = predict.bme_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), None, Covariance("exponential", [40000, 12]), nhmax=1, order=None, mean_prior=950.0, n_grid=40)
    return got.select("est_id", r("kriging_mean", 3).alias("kriging_mean"), r("kriging_var", 3).alias("kriging_var"), "n_hard")


@query("kriging_two", f"""WITH {P}, {S}, {D}, {K(2)}, a AS (SELECT k.est_id, k.rank, k.z, k.distance AS h, p.x, p.y FROM k JOIN p USING (obs_id)),
 b AS (SELECT u.est_id, u.z AS z1, v.z AS z2, 4 * exp(-3 * u.h / 12) AS c1, 4 * exp(-3 * v.h / 12) AS c2, 4 * exp(-3 * sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) / 12) AS c12 FROM a u JOIN a v ON u.est_id = v.est_id AND u.rank = 1 AND v.rank = 2),
 w AS (SELECT *, (z1 + z2) / 2 AS m, 4.0000000001 * 4.0000000001 - c12 * c12 AS det FROM b),
 l AS (SELECT *, (c1 * 4.0000000001 - c2 * c12) / det AS w1, (c2 * 4.0000000001 - c1 * c12) / det AS w2 FROM w)
 SELECT est_id, round(m + w1 * (z1 - m) + w2 * (z2 - m), 3) AS kriging_mean, round(4 - w1 * c1 - w2 * c2, 5) AS kriging_var FROM l""")
def kriging_two(spark, sf_dir):
    got = predict.bme_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), None, Covariance("exponential", [4, 12]), nhmax=2, n_grid=40)
    return got.select("est_id", r("kriging_mean", 3).alias("kriging_mean"), r("kriging_var", 5).alias("kriging_var"))


@query("no_data", f"WITH {S} SELECT est_id, 950.0::DOUBLE AS mean, 40000.0::DOUBLE AS variance, 'no_data' AS info, 0 AS n_hard FROM s")
def no_data(spark, sf_dir):
    far = parts(spark, sf_dir).withColumn("coords", F.transform("coords", lambda x: x + 1e6))
    got = predict.bme_predict(suppliers(spark, sf_dir), far, None, Covariance("exponential", [40000, 12]), dmax=5.0, order=None, mean_prior=950.0)
    return got.select("est_id", "mean", "variance", "info", "n_hard")


@query("coincident", f"WITH {P} SELECT obs_id AS est_id, z AS mean, 0.0::DOUBLE AS variance, 'duplicate' AS info FROM p")
def coincident(spark, sf_dir):
    """Points that lie on data: each part is estimated from all parts."""
    p = parts(spark, sf_dir)
    est = p.select(F.col("obs_id").alias("est_id"), "coords")
    return predict.bme_predict(est, p, None, Covariance("exponential", [40000, 12]), nhmax=4).select("est_id", "mean", "variance", "info")


def _soft(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("soft_id"), (F.pmod("c_custkey", F.lit(89)) + 0.43).alias("x"), (F.pmod(F.floor(F.col("c_custkey") / 89), F.lit(23)) + 0.77).alias("y"), (900 + F.pmod("c_custkey", F.lit(211))).cast("double").alias("mu"))
    return c.select("soft_id", F.array("x", "y").alias("coords"), softpdf.gaussian_column(F.col("mu"), F.lit(40.0)).alias("pdf"))


_NODES, _WEIGHTS = (list(map(float, v)) for v in kernels.hermite(20))


def _full_sql() -> str:
    """One hard and one soft neighbour: 20 quadrature nodes, 200 grid points, Gaussian density on its 25 points."""
    nodes = ", ".join(f"({n!r}, {w!r})" for n, w in zip(_NODES, _WEIGHTS, strict=True))
    return f"""WITH {P}, {S}, {D}, {K(1)},
 c AS (SELECT c_custkey::BIGINT AS soft_id, (c_custkey % 89 + 0.43)::DOUBLE AS x, (floor(c_custkey / 89) % 23 + 0.77)::DOUBLE AS y, (900 + c_custkey % 211)::DOUBLE AS mu FROM customer),
 n AS (SELECT * FROM (SELECT s.est_id, c.*, row_number() OVER (PARTITION BY s.est_id ORDER BY sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)), soft_id) AS i, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS hs FROM s, c) WHERE i = 1),
 q AS (SELECT * FROM (VALUES {nodes}) AS v(node, weight)),
 b AS (SELECT k.est_id, k.z - 950 AS zh, n.mu - 950 AS ms, 40000 * exp(-3 * k.distance / 12) AS kh, 40000 * exp(-3 * n.hs / 12) AS ks, 40000 * exp(-3 * sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) / 12) AS sh FROM k JOIN n USING (est_id) JOIN p USING (obs_id)),
 u AS (SELECT *, kh * zh / 40000.0000000001 AS mk, greatest(40000 - kh * kh / 40000.0000000001, 1e-12) AS vk, 40000.0000000001 * 40000.0000000002 - kh * kh AS det FROM b),
 v AS (SELECT *, (ks * 40000.0000000002 - sh * kh) / det AS bk, (sh * 40000.0000000001 - ks * kh) / det AS bh FROM u),
 w AS (SELECT *, 40000.0000000002 - bk * ks - bh * sh + 1e-10 AS vs, least(mk - 5 * sqrt(vk), ms - 200 - 2 * sqrt(vk)) AS low, greatest(mk + 5 * sqrt(vk), ms + 200 + 2 * sqrt(vk)) AS high FROM v),
 g AS (SELECT *, low + (high - low) * j / 199 AS z FROM w, (SELECT unnest(range(0, 200)) AS j)),
 x AS (SELECT g.*, weight, (bk * z + bh * zh + node * sqrt(vs) - (ms - 200)) / (400 / 24.0) AS cell FROM g, q),
 f AS (SELECT est_id, j, z, mk, vk, low, high, sum(CASE WHEN cell < 0 OR cell > 24 THEN 0 ELSE weight * ((1 - (cell - least(floor(cell), 23))) * exp(-0.5 * pow(5 * (least(floor(cell), 23) - 12) / 12, 2)) + (cell - least(floor(cell), 23)) * exp(-0.5 * pow(5 * (least(floor(cell), 23) - 11) / 12, 2))) END) AS factor FROM x GROUP BY ALL),
 d2 AS (SELECT *, exp(-0.5 * (z - mk) * (z - mk) / vk) * factor * CASE WHEN j IN (0, 199) THEN 0.5 ELSE 1 END AS pdf FROM f),
 m AS (SELECT est_id, sum(z * pdf) / sum(pdf) AS mean FROM d2 GROUP BY est_id)
 SELECT est_id, round(950 + mean, 2) AS mean, round(sum((z - mean) * (z - mean) * pdf) / sum(pdf), 0) AS variance FROM d2 JOIN m USING (est_id) GROUP BY est_id, mean"""


@query("bme_one_hard_one_soft", _full_sql())
def bme_one_hard_one_soft(spark, sf_dir):
    got = predict.bme_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), _soft(spark, sf_dir), Covariance("exponential", [40000, 12]), nhmax=1, nsmax=1, order=None, mean_prior=950.0)
    return got.select("est_id", r("mean", 2).alias("mean"), r("variance", 0).alias("variance"))


def _bme(method: str):
    def run(spark, sf_dir):
        got = predict.bme_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), _soft(spark, sf_dir), Covariance("exponential", [40000, 12]), nhmax=12, nsmax=3, method=method, n_grid=60, density=False)
        return got.drop("z_grid", "pdf")

    return run


for _method in ("gauss_hermite", "laplace", "mc", "qmc", "ep", "lis"):
    query(f"bme_{_method}")(_bme(_method))


@query("bme_workload")
def bme_workload(spark, sf_dir):
    """1,400 points with 30 hard and 6 soft neighbours on 100 grid points by Laplace, whatever the tables' size."""
    est = spark.range(1400).select(F.col("id").alias("est_id"), F.array((F.pmod("id", F.lit(56)) * 1.7 + 0.11), (F.floor(F.col("id") / 56) * 0.8 + 0.07)).alias("coords"))
    got = predict.bme_predict(est, parts(spark, sf_dir), _soft(spark, sf_dir), Covariance("exponential", [40000, 12]), nhmax=30, nsmax=6, method="laplace", n_grid=100, density=False)
    return got.drop("z_grid", "pdf")


@query("bme_space_time")
def bme_space_time(spark, sf_dir):
    est, obs = _timed(spark, sf_dir)
    soft = _soft(spark, sf_dir).withColumn("t", F.pmod("soft_id", F.lit(24)).cast("double"))
    return predict.bme_predict_st(est, obs, soft, SpaceTime("exponential", [1, 12], "exponential", [1, 18], 40000.0), nhmax=10, nsmax=2, n_grid=60, exact=True, density=False).drop("z_grid", "pdf")


@query("kriging")
def kriging(spark, sf_dir):
    return predict.kriging_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), Covariance("spherical", [40000, 12]), order=1, density=False).drop("z_grid", "pdf")


@query("kriging_measurement_error")
def kriging_measurement_error(spark, sf_dir):
    soft = _soft(spark, sf_dir).select("soft_id", "coords", F.col("pdf.analytic.mu").alias("mean"), F.col("pdf.analytic.sigma").alias("sigma"))
    return predict.kriging_me_predict(suppliers(spark, sf_dir), parts(spark, sf_dir), soft, Covariance("exponential", [40000, 12]), nhmax=10, nsmax=4, n_grid=60, density=False).drop("z_grid", "pdf")


@query("leave_one_out", f"""WITH {P}, d AS (SELECT a.obs_id AS est_id, a.z AS own, b.z, b.obs_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b ON a.obs_id <> b.obs_id),
 {K(1)}, e AS (SELECT 950 + exp(-3 * distance / 12) * 40000 / 40000.0000000001 * (z - 950) - own AS error FROM k) SELECT count(*)::BIGINT AS n, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs(error)), 4) AS mae FROM e""")
def leave_one_out(spark, sf_dir):
    got = predict.cross_validate(parts(spark, sf_dir), Covariance("exponential", [40000, 12]), nhmax=1, order=None, mean_prior=950.0)
    return predict.errors(got).select("n", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"))


@query("inverse_distance", f"WITH {P}, {S}, {D}, {K(8)} SELECT est_id, round(sum(z * pow(distance, -2)) / sum(pow(distance, -2)), 4) AS estimate FROM k GROUP BY est_id")
def inverse_distance(spark, sf_dir):
    return statistics.inverse_distance(suppliers(spark, sf_dir), parts(spark, sf_dir), 2.0, 8).select("est_id", r("estimate", 4).alias("estimate"))


@query("kernel_smoothing", f"WITH {P}, {S}, {D}, {K(8)} SELECT est_id, round(sum(z * exp(-0.5 * distance * distance / 4)) / sum(exp(-0.5 * distance * distance / 4)), 4) AS estimate FROM k GROUP BY est_id")
def kernel_smoothing(spark, sf_dir):
    return statistics.kernel_smoothing(suppliers(spark, sf_dir), parts(spark, sf_dir), 4.0, 8).select("est_id", r("estimate", 4).alias("estimate"))


@query("trend_line", f"WITH {P} SELECT round(regr_slope(z, x), 6) AS slope, round(regr_intercept(z, x), 4) AS intercept FROM p")
def trend_line(spark, sf_dir):
    return parts(spark, sf_dir).agg(r(F.regr_slope("z", "x")).alias("slope"), r(F.regr_intercept("z", "x"), 4).alias("intercept"))


# --- statistics -----------------------------------------------------------------------------------------------------------


@query("variogram", f"""WITH {P}, d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.z - b.z) * (a.z - b.z) AS s FROM p a JOIN p b ON a.obs_id < b.obs_id)
 SELECT floor(d / (10.0 / 15))::INT AS bin, count(*)::BIGINT AS n, round(avg(s) / 2, 3) AS gamma FROM d WHERE d < 10 GROUP BY 1""")
def variogram(spark, sf_dir):
    return statistics.variogram(parts(spark, sf_dir), 10.0, 15).select("bin", "n", r("gamma", 3).alias("gamma"))


_YEARLY = "y AS (SELECT (user_id % 40)::BIGINT AS site, (day(ts))::INT AS year, avg(value) AS z, (user_id % 40 % 8)::DOUBLE AS x, (floor(user_id % 40 / 8))::DOUBLE AS y FROM events GROUP BY ALL)"


def yearly(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).cast("long").alias("site"), F.dayofmonth("ts").alias("year"), "value")
    return e.groupBy("site", "year").agg(F.avg("value").alias("z")).withColumns({"x": F.pmod("site", F.lit(8)).cast("double"), "y": F.floor(F.col("site") / 8).cast("double")})


@query("spatial_margin", f"""WITH {_YEARLY}, c AS (SELECT *, z - avg(z) OVER (PARTITION BY year) AS r FROM y), d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.r * b.r AS c FROM c a JOIN c b ON a.year = b.year)
 SELECT floor(d / 1.5)::INT AS bin, count(*)::BIGINT AS n, round(avg(c), 3) AS covariance FROM d WHERE d < 12 GROUP BY 1""")
def spatial_margin(spark, sf_dir):
    return statistics.spatial_margin(yearly(spark, sf_dir), 1.5, 8).select("bin", "n", r("covariance", 3).alias("covariance"))


@query("temporal_margin", f"""WITH {_YEARLY}, c AS (SELECT *, z - avg(z) OVER (PARTITION BY site) AS r, count(*) OVER (PARTITION BY site) AS n_own FROM y)
 SELECT (b.year - a.year)::INT AS lag, count(*)::BIGINT AS n, round(avg(a.r * b.r), 3) AS covariance FROM c a JOIN c b ON a.site = b.site AND b.year - a.year BETWEEN 0 AND a.n_own // 2 WHERE a.n_own >= 5 GROUP BY 1""")
def temporal_margin(spark, sf_dir):
    return statistics.temporal_margin(yearly(spark, sf_dir)).select("lag", "n", r("covariance", 3).alias("covariance"))


@query("normal_scores", f"WITH {P}, k AS (SELECT obs_id, (row_number() OVER (ORDER BY z, obs_id) - 1 + 0.625) / (count(*) OVER () + 0.25) AS p FROM p) SELECT obs_id, round(p, 9) AS p, round({norm_ppf_sql('p')}, 6) AS score FROM k")
def normal_scores(spark, sf_dir):
    return statistics.normal_scores(parts(spark, sf_dir).select("obs_id", "z"), "obs_id", "z").select("obs_id", r("p", 9).alias("p"), r("score").alias("score"))


@query("describe", f"""WITH {P}, m AS (SELECT count(*) AS n, avg(z) AS mean FROM p), c AS (SELECT m.n, m.mean, avg(pow(z - m.mean, 2)) AS v, avg(pow(z - m.mean, 3)) AS c3, avg(pow(z - m.mean, 4)) AS c4 FROM p, m GROUP BY m.n, m.mean)
 SELECT n::BIGINT AS n, round(mean, 4) AS mean, round(v, 2) AS variance, round(c3 / pow(v, 1.5), 6) AS skewness, round(c4 / (v * v) - 3, 6) AS kurtosis FROM c""")
def describe(spark, sf_dir):
    return statistics.describe(parts(spark, sf_dir), "z").select("n", r("mean", 4).alias("mean"), r("variance", 2).alias("variance"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query("density", f"""WITH {P}, h AS (SELECT count(*) AS n, stddev_samp(z) * pow(count(*), -0.2) AS h FROM p), g AS (SELECT unnest([900.0, 950.0, 1000.0, 1200.0, 1500.0])::DOUBLE AS x)
 SELECT g.x, round(sum(exp(-0.5 * (g.x - z) / h * ((g.x - z) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM p, h, g GROUP BY g.x""")
def density(spark, sf_dir):
    return statistics.density(parts(spark, sf_dir), "z", [900.0, 950.0, 1000.0, 1200.0, 1500.0]).select("x", r("density", 9).alias("density"))


@query("residual_statistics", f"""WITH {_YEARLY}, o AS (SELECT site, avg(z) AS mean, var_pop(z) AS v, count(*) AS n FROM y GROUP BY site), t AS (SELECT quantile_cont(v, 0.5) AS t FROM o WHERE n >= 10)
 SELECT site, round(mean, 4) AS mean, round(greatest(CASE WHEN n >= 10 THEN v ELSE t END, 0.0001), 3) AS variance, n::BIGINT AS n FROM o, t""")
def residual_statistics(spark, sf_dir):
    return statistics.residual_statistics(yearly(spark, sf_dir), "site", "z").select("site", r("mean", 4).alias("mean"), r("variance", 3).alias("variance"), "n")


@query("site_classes", "WITH c AS (SELECT user_id::BIGINT AS user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n::BIGINT AS n_valid, CASE WHEN n >= 70 THEN 'hard' WHEN n >= 60 THEN 'soft' ELSE 'excluded' END AS class FROM c")
def site_classes(spark, sf_dir):
    return geometry.by_valid_count(table(spark, sf_dir, "events"), "user_id", "value", 70, 60).select(F.col("user_id").cast("long").alias("user_id"), "n_valid", "class")


@query("soft_sigma", f"WITH {_YEARLY}, o AS (SELECT site, avg(z) AS z, stddev_pop(z) AS s, count(*) AS n FROM y GROUP BY site) SELECT site, round(sqrt(0.0144 * z * z + pow(CASE WHEN s < 0.5 THEN 1.5 ELSE s END / sqrt(n), 2)), 5) AS sigma FROM o")
def soft_sigma(spark, sf_dir):
    o = yearly(spark, sf_dir).groupBy("site").agg(F.avg("z").alias("z"), F.stddev_pop("z").alias("s"), F.count(F.lit(1)).alias("n"))
    return o.select("site", r(statistics.soft_sigma(F.col("z"), F.col("s"), F.col("n"), 1.5), 5).alias("sigma"))


@query("thinned", f"WITH {P}, k AS (SELECT obs_id, z, row_number() OVER (ORDER BY z, obs_id) - 1 AS i, count(*) OVER () AS n FROM p) SELECT obs_id, z FROM k WHERE i % (n // 150 + 1) = 0")
def thinned(spark, sf_dir):
    return geometry.thinned(parts(spark, sf_dir).select("obs_id", "z"), ["z", "obs_id"], 150)


@query("projection", f"WITH {P}, m AS (SELECT avg(x) AS a, avg(y) AS b FROM p) SELECT obs_id, round((x - a) * cos(radians(b)) * 111.32, 4) AS px, round((y - b) * 111.32, 4) AS py FROM p, m")
def projection(spark, sf_dir):
    p = geometry.equirectangular(parts(spark, sf_dir).select("obs_id", F.col("x").alias("lon"), F.col("y").alias("lat")))
    return p.select("obs_id", r("x", 4).alias("px"), r("y", 4).alias("py"))


@query("active_cells", f"WITH {P}, {S} SELECT obs_id FROM p WHERE EXISTS (SELECT 1 FROM s WHERE (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 4)")
def active_cells(spark, sf_dir):
    return geometry.active(parts(spark, sf_dir), suppliers(spark, sf_dir), 2.0).select("obs_id")


@query("grid", "SELECT (i * 11 + j)::BIGINT AS id, round(i * 0.25::DOUBLE, 6) AS x, round(-1 + j * 0.2::DOUBLE, 6) AS y FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 11)) AS j)")
def grid(spark, sf_dir):
    return geometry.grid(spark, [0.0, -1.0], [2.0, 1.0], [9, 11]).select("id", r(F.get("coords", F.lit(0))).alias("x"), r(F.get("coords", F.lit(1))).alias("y"))


@query("colour_cap", f"WITH {P} SELECT round(quantile_cont(z, 0.95), 4) AS cap FROM p WHERE z > 0")
def colour_cap(spark, sf_dir):
    return statistics.colour_cap(parts(spark, sf_dir), "z").select(r("cap", 4).alias("cap"))


@query("fit")
def fit(spark, sf_dir):
    """A fit of each model to each square of 20 by 20 of the plane, side by side; a square has at most 400 points at any size."""
    tile = F.concat_ws(" ", *(F.floor(F.col(c) / 20).cast("string") for c in ("x", "y")))
    return statistics.fit_covariance(parts(spark, sf_dir).withColumn("tile", tile), ["exponential", "gaussian", "spherical"], by="tile")


# --- soft densities -------------------------------------------------------------------------------------------------------


@query("soft_gaussian", f"""WITH {P}, a AS (SELECT sum(exp(-0.5 * pow(5 * (i - 12) / 12.0, 2)) * CASE WHEN i IN (0, 24) THEN 0.5 ELSE 1 END) * 400 / 24 AS area FROM (SELECT unnest(range(0, 25)) AS i)),
 q AS (SELECT i, i * 400 / 499.0 - 200 AS x, least(floor(i * 24 / 499.0), 23) AS c, i * 24 / 499.0 AS spot FROM (SELECT unnest(range(0, 500)) AS i)),
 f AS (SELECT x, 400 / 499.0 * CASE WHEN i IN (0, 499) THEN 0.5 ELSE 1 END * ((1 - (spot - c)) * exp(-0.5 * pow(5 * (c - 12) / 12.0, 2)) + (spot - c) * exp(-0.5 * pow(5 * (c - 11) / 12.0, 2))) AS m FROM q),
 s AS (SELECT sum(m) AS m0, sum(x * m) AS m1 FROM f)
 SELECT obs_id, round(1 / area, 9) AS peak, round(1 / area * (0.4 * exp(-0.5 * pow(1 * 5 / 12.0, 2)) + 0.6), 9) AS beside, round((z * m0 + m1) / area, 4) AS mean FROM p, a, s""")
def soft_gaussian(spark, sf_dir):
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.gaussian_column(F.col("z"), F.lit(40.0)))
    return p.select("obs_id", r(softpdf.evaluate_column(F.col("pdf"), F.col("z")), 9).alias("peak"), r(softpdf.evaluate_column(F.col("pdf"), F.col("z") + 0.4 * 400 / 24), 9).alias("beside"), r(softpdf.moments_column(F.col("pdf"))["mean"], 4).alias("mean"))


@query("soft_triangular", f"WITH {P} SELECT obs_id, 0.01::DOUBLE AS quarter, 0.0::DOUBLE AS outside, 1.0::DOUBLE AS area FROM p")
def soft_triangular(spark, sf_dir):
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.triangular_column(F.col("z") - 50, F.col("z"), F.col("z") + 50))
    return p.select("obs_id", r(softpdf.evaluate_column(F.col("pdf"), F.col("z") - 25), 9).alias("quarter"), softpdf.evaluate_column(F.col("pdf"), F.col("z") + 60).alias("outside"), r(softpdf.area(F.col("pdf.z_grid"), F.col("pdf.dens")), 9).alias("area"))


@query("soft_uniform", f"""WITH {P}, q AS (SELECT (80 + 0.00016) / 499.0 AS step, -40.00008 + i * (80 + 0.00016) / 499.0 AS x FROM (SELECT unnest(range(1, 499)) AS i)),
 s AS (SELECT sum(step) / (80 * 1.000001) AS m0, sum(x * step) / (80 * 1.000001) AS m1 FROM q) SELECT obs_id, round(1 / (80 * 1.000001::DOUBLE), 9) AS inside, round((z * m0 + m1)::DOUBLE, 4) AS mean FROM p, s""")
def soft_uniform(spark, sf_dir):
    p = neighbors.dealt(parts(spark, sf_dir)).withColumn("pdf", softpdf.uniform_column(F.col("z") - 40, F.col("z") + 40))
    return p.select("obs_id", r(softpdf.evaluate_column(F.col("pdf"), F.col("z") + 3), 9).alias("inside"), r(softpdf.moments_column(F.col("pdf"))["mean"], 4).alias("mean"))


# --- graphs -----------------------------------------------------------------------------------------------------------------


@query("adjacency", f"WITH {EDGES_SQL} SELECT i, j, round(sum(w), 6) AS v FROM (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY i, j")
def adjacency(spark, sf_dir):
    return network.adjacency(nation_edges(spark, sf_dir)).select("i", "j", r("v").alias("v"))


_LAP = f"{EDGES_SQL}, a AS (SELECT i, j, sum(w) AS v FROM (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY i, j), g AS (SELECT i, sum(v) AS d FROM a GROUP BY i), l AS (SELECT i, i AS j, d AS v FROM g UNION ALL SELECT i, j, -v FROM a)"


@query("laplacian", f"WITH {_LAP} SELECT i, j, round(v, 6) AS v FROM l")
def laplacian(spark, sf_dir):
    return network.laplacian(network.adjacency(nation_edges(spark, sf_dir))).select("i", "j", r("v").alias("v"))


@query("laplacian_normalised", f"WITH {_LAP} SELECT l.i, l.j, round(l.v / sqrt(x.d * y.d), 6) AS v FROM l JOIN g x ON x.i = l.i JOIN g y ON y.i = l.j")
def laplacian_normalised(spark, sf_dir):
    return network.laplacian(network.adjacency(nation_edges(spark, sf_dir)), True).select("i", "j", r("v").alias("v"))


@query("precision", f"WITH {_LAP} SELECT i, j, round((v + CASE WHEN i = j THEN 2.25 ELSE 0 END) / 2, 6) AS v FROM l")
def precision(spark, sf_dir):
    e = nation_edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return network.precision(network.laplacian(network.adjacency(e)), nodes, 1.5, 2.0).select("i", "j", r("v").alias("v"))


_H_SQL = f"{EDGES_SQL}, o AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS h FROM (SELECT DISTINCT dst FROM e)), m AS (SELECT h, o.dst AS j, 1.0::DOUBLE AS v FROM o UNION ALL SELECT h, src, -w FROM e JOIN o USING (dst))"


@query("mass_balance", f"WITH {_H_SQL} SELECT h::BIGINT AS h, j, round(v, 6) AS v FROM m")
def mass_balance(spark, sf_dir):
    return network.mass_balance(nation_edges(spark, sf_dir)).select("h", "j", r("v").alias("v"))


@query("mass_balance_gram", f"WITH {_H_SQL} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.h = b.h GROUP BY a.j, b.j")
def mass_balance_gram(spark, sf_dir):
    return network.gram(network.mass_balance(nation_edges(spark, sf_dir))).select("i", "j", r("v").alias("v"))


@query("mass_balance_residual", f"WITH {_H_SQL} SELECT h::BIGINT AS h, round(sum(v * (j % 7)), 6) AS r FROM m GROUP BY h")
def mass_balance_residual(spark, sf_dir):
    e = nation_edges(spark, sf_dir)
    x = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("x", F.pmod("node", F.lit(7)).cast("double"))
    return network.residual(network.mass_balance(e), x).select("h", r("r").alias("r"))


@query("hops", f"WITH {EDGES_SQL}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) SELECT 0::BIGINT AS node, 0::BIGINT AS hop UNION ALL SELECT b, 1 FROM b WHERE a = 0 UNION ALL SELECT DISTINCT y.b, 2 FROM b x JOIN b y ON x.b = y.a WHERE x.a = 0 AND y.b <> 0")
def hops(spark, sf_dir):
    return network.hops(nation_edges(spark, sf_dir), 0)


def _ring(spark, n: int = 40) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"), F.lit(1.0).alias("w"))


@query("network_bme")
def network_bme(spark, sf_dir):
    """A ring of 60 nodes: the parts give data at the first 40, and every other one of the rest has a density."""
    cov = network.NetworkCovariance.of(_ring(spark, 60), 60, 0.5, 40000.0)
    hard = parts(spark, sf_dir).groupBy(F.pmod("obs_id", F.lit(40)).alias("node")).agg(F.avg("z").alias("z")).select(F.col("node").alias("obs_id"), "node", "z")
    soft = spark.range(40, 60, 2).select(F.col("id").alias("soft_id"), F.col("id").alias("node"), softpdf.gaussian_column(F.lit(950.0) + F.col("id"), F.lit(30.0)).alias("pdf"))
    return predict.bme_predict_network(spark.range(60).select(F.col("id").alias("est_id"), F.col("id").alias("node")), hard, soft, cov, nsmax=2, n_grid=60).drop("z_grid", "pdf")


@query("routed_network_bme")
def routed_network_bme(spark, sf_dir):
    """The synthetic sewer network: hard readings and soft flows of one storm, estimated at all nodes and hours."""
    rows = network.checkpointed(timeseries.synthetic_network(spark, window_hours=12, before_peak=6))
    links = spark.createDataFrame([(i, j) for a, b, _ in timeseries.LINKS for i, j in [([n[0] for n in timeseries.NODES].index(a), [n[0] for n in timeseries.NODES].index(b))]], "src long, dst long")
    cov = network.NetworkSpaceTime(network.NetworkCovariance.of(links, 11, 0.6, 0.2), Covariance("exponential", [1.0, 9.0]))
    hard = rows.where("is_hard").select((F.col("node_id") * 1000 + F.col("hour")).alias("obs_id"), F.col("node_id").alias("node"), F.col("hour").cast("double").alias("t"), F.col("hard_value").alias("z"))
    soft = timeseries.soft_inputs(rows)
    soft = soft.select("soft_id", "node", "t", softpdf.truncnorm_column(F.col("mu"), F.col("sigma"), F.lit(0.0), F.col("upper"), 41).alias("pdf"))
    est = rows.select((F.col("node_id") * 1000 + F.col("hour")).alias("est_id"), F.col("node_id").alias("node"), F.col("hour").cast("double").alias("t"))
    return predict.bme_predict_network_st(est, hard, soft, cov, nhmax=20, nsmax=4, n_grid=60).drop("z_grid", "pdf")


@query("network_workload")
def network_workload(spark, sf_dir):
    """The published workload's own sizes: 421 nodes and 491 links, 297 hard data of 17 meters, 1,400 truncated normal densities, 56 nodes at 25 hours, 30 hard and 6 soft neighbours, 100 grid points, Laplace."""
    i = F.col("id")
    tree = spark.range(1, 421).select(F.floor((i - 1) / 2).alias("src"), i.alias("dst"))
    links = tree.union(spark.range(71).select((i * 5 + 11).alias("src"), (i * 5 + 14).alias("dst")))
    cov = network.NetworkSpaceTime(network.NetworkCovariance.of(links, 421, 0.5), Covariance("exponential", [1.0, 9.0]), 4.0)
    at, hour = (F.pmod(i, F.lit(56)) * 7 + 3).alias("node"), F.floor(i / 56).cast("double").alias("t")
    hard = spark.range(297).select(i.alias("obs_id"), (F.pmod(i, F.lit(17)) * 24 + 5).alias("node"), F.floor(i / 17).cast("double").alias("t"), (5 + F.sin(i * 0.7) + F.pmod(i, F.lit(17)) * 0.1).alias("z"))
    soft = spark.range(1400).select(i.alias("soft_id"), at, hour, softpdf.truncnorm_column(5 + F.cos(i * 0.3), 0.4 + F.pmod(i, F.lit(5)) * 0.1, F.lit(0.0), F.lit(12.0)).alias("pdf"))
    est = spark.range(1400).select(i.alias("est_id"), at, hour)
    return predict.bme_predict_network_st(est, hard, soft, cov, nhmax=30, nsmax=6, n_grid=100, method="laplace", density=False).drop("z_grid", "pdf")


# --- meshes -----------------------------------------------------------------------------------------------------------------


def _lattice(spark, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """n by n squares, each cut in two."""
    nodes = spark.range((n + 1) ** 2).select("id", F.pmod("id", F.lit(n + 1)).cast("double").alias("x"), (F.floor(F.col("id") / (n + 1)) * 0.5).alias("y"))
    cell = spark.range(n * n).select((F.floor(F.col("id") / n) * (n + 1) + F.pmod("id", F.lit(n))).alias("a"))
    tri = cell.select(F.explode(F.array(F.struct("a", (F.col("a") + 1).alias("b"), (F.col("a") + n + 1).alias("c")), F.struct((F.col("a") + 1).alias("a"), (F.col("a") + n + 2).alias("b"), (F.col("a") + n + 1).alias("c")))).alias("t"))
    return nodes, tri.select(F.monotonically_increasing_id().alias("id"), "t.a", "t.b", "t.c")


@query("finite_elements", """WITH n AS (SELECT i::BIGINT AS id, (i % 13)::DOUBLE AS x, floor(i / 13) * 0.5 AS y FROM (SELECT unnest(range(0, 169)) AS i)),
 q AS (SELECT (i // 12) * 13 + i % 12 AS a FROM (SELECT unnest(range(0, 144)) AS i)), t AS (SELECT a, a + 1 AS b, a + 13 AS c FROM q UNION ALL SELECT a + 1, a + 14, a + 13 FROM q),
 p AS (SELECT t.*, pa.x AS ax, pa.y AS ay, pb.x AS bx, pb.y AS b_y, pc.x AS cx, pc.y AS cy FROM t JOIN n pa ON pa.id = a JOIN n pb ON pb.id = b JOIN n pc ON pc.id = c),
 e AS (SELECT *, 0.5 * abs((bx - ax) * (cy - ay) - (cx - ax) * (b_y - ay)) AS area FROM p),
 v AS (SELECT a AS id, area, cx - bx AS ex, cy - b_y AS ey, a, b, c FROM e UNION ALL SELECT b, area, ax - cx, ay - cy, a, b, c FROM e UNION ALL SELECT c, area, bx - ax, b_y - ay, a, b, c FROM e)
 SELECT u.id::BIGINT AS i, w.id::BIGINT AS j, round(sum(CASE WHEN u.id = w.id THEN u.area / 3 ELSE 0 END), 6) AS mass, round(sum((u.ex * w.ex + u.ey * w.ey) / (4 * u.area)), 6) AS stiffness FROM v u JOIN v w ON u.a = w.a AND u.b = w.b AND u.c = w.c GROUP BY 1, 2""")
def finite_elements(spark, sf_dir):
    return mesh.fem_entries(*_lattice(spark)).select("i", "j", r("mass").alias("mass"), r("stiffness").alias("stiffness"))


@query("mesh_kriging")
def mesh_kriging(spark, sf_dir):
    """The suppliers' balances on a mesh of their own, estimated at all parts, which stay where they are."""
    s = suppliers(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("est_id"), F.col("s_acctbal").cast("double").alias("z")), "est_id")
    # Suppliers of one place are one datum, their mean, so that the mesh grows with the area.
    obs = s.groupBy("x", "y").agg(F.avg("z").alias("z")).orderBy("x", "y").toPandas().to_numpy(float)
    m = mesh.Mesh.from_points(obs[:, :2], max_edge=6.0)
    est = parts(spark, sf_dir).select(F.col("obs_id").alias("est_id"), "coords")
    got = mesh.spde_kriging_at(m, obs[:, :2], obs[:, 2] - obs[:, 2].mean(), est, 9e6, 12.0)
    return got.select(F.col("est_id").alias("obs_id"), (F.col("mean") + float(obs[:, 2].mean())).alias("mean"), "variance")


# --- time series ------------------------------------------------------------------------------------------------------------


@query("hourly_means", "WITH e AS (SELECT user_id::BIGINT AS user_id, floor(epoch_us(ts) / 3600e6)::BIGINT AS hour, value FROM events) SELECT user_id, hour, round(avg(value), 4) AS value, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def hourly_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).cast("long").alias("hour"), "value")
    return e.groupBy("user_id", "hour").agg(r(F.avg("value"), 4).alias("value"), F.count(F.lit(1)).alias("n"))


@query("best_window", """WITH e AS (SELECT user_id, floor(epoch_us(ts) / 3600e6)::BIGINT AS hour FROM events), s AS (SELECT user_id, hour - k AS start FROM e, (SELECT unnest(range(0, 24)) AS k)),
 w AS (SELECT start, count(DISTINCT user_id) AS nodes, count(*) AS n FROM s GROUP BY start) SELECT start * 3600 AS start, nodes::BIGINT AS nodes, n::BIGINT AS n, (10 * nodes + n)::BIGINT AS score FROM w ORDER BY score DESC, start LIMIT 1""")
def best_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return timeseries.best_window(e, "ts", "user_id").select(F.unix_seconds("start").alias("start"), "nodes", "n", "score")


@query("rain", "SELECT i::BIGINT AS step, round(0.58 * exp(-0.5 * pow((i * 0.25 - 45) / 2.6, 2)) + 0.42 * exp(-0.5 * pow((i * 0.25 - 48.2) / 1.4, 2)) + 0.24 * exp(-0.5 * pow((i * 0.25 - 96.5) / 3.4, 2)) + 0.02 * greatest(sin(2 * pi() * (i * 0.25 - 6) / 24), 0), 6) AS rain FROM (SELECT unnest(range(0, 576)) AS i)")
def rain(spark, sf_dir):
    return spark.range(576).select(F.col("id").alias("step"), r(timeseries.rainfall(F.col("id") * 0.25)).alias("rain"))


@query("convolution", "WITH r AS (SELECT i::BIGINT AS step, (i % 11)::DOUBLE AS v FROM (SELECT unnest(range(0, 200)) AS i)), k AS (SELECT unnest([0, 1, 2, 3]) AS lag, unnest([0.0, 0.5, 0.3, 0.2]) AS k) SELECT r.step, round(sum(x.v * k.k) * 0.25, 6) AS conv FROM r JOIN k ON TRUE JOIN r x ON x.step = r.step - k.lag GROUP BY r.step")
def convolution(spark, sf_dir):
    s = spark.range(200).select(F.col("id").alias("step"), F.pmod("id", F.lit(11)).cast("double").alias("v"))
    return timeseries.convolved(s, [0.0, 0.5, 0.3, 0.2], 0.25).select("step", r("conv").alias("conv"))


@query("delay", "WITH s AS (SELECT g::BIGINT AS g, i::BIGINT AS step, ((i * 7 + g) % 13)::DOUBLE AS v FROM (SELECT unnest(range(0, 50)) AS i), (SELECT unnest(range(0, 3)) AS g)) SELECT g, step, round(coalesce(lag(v, 2) OVER w * 0.6 + lag(v, 3) OVER w * 0.4, 0), 6) AS delayed FROM s WINDOW w AS (PARTITION BY g ORDER BY step)")
def delay(spark, sf_dir):
    s = spark.range(150).select(F.pmod("id", F.lit(3)).alias("g"), F.floor(F.col("id") / 3).alias("step")).withColumn("v", F.pmod(F.col("step") * 7 + F.col("g"), F.lit(13)).cast("double"))
    return timeseries.delayed(s, ["g"], 0.6, 0.25).select("g", "step", r("delayed").alias("delayed"))


@query("synthetic_network")
def synthetic_network(spark, sf_dir):
    return timeseries.synthetic_network(spark)


# --- set operations in use ----------------------------------------------------------------------------------------------------


@query("unobserved_sites", "SELECT c_custkey::BIGINT AS site FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unobserved_sites(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("site")).join(table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("site")), "site", "left_anti")


@query("observed_sites", "SELECT c_custkey::BIGINT AS site FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def observed_sites(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("site")).join(table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("site")), "site", "left_semi")


@query("node_hour_grid", "SELECT (row_number() OVER (ORDER BY node, t) - 1)::BIGINT AS est_id, node, t FROM (SELECT n_nationkey::BIGINT AS node FROM nation), (SELECT unnest(range(0, 24))::BIGINT AS t)")
def node_hour_grid(spark, sf_dir):
    return timeseries.prediction_grid(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node")), spark.range(24).withColumnRenamed("id", "t")).select("est_id", "node", "t")


@query("top_rank_check", f"WITH {P} SELECT obs_id, z FROM p ORDER BY z DESC, obs_id LIMIT 10")
def top_rank_check(spark, sf_dir):
    """A top-k report: the ten largest values."""
    w = Window.orderBy(F.desc("z"), "obs_id")
    return parts(spark, sf_dir).orderBy(F.desc("z"), "obs_id").limit(10).withColumn("i", F.row_number().over(w)).select("obs_id", "z")

