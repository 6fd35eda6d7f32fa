"""Estimation at points: neighbours by joins, covariance and posterior in Arrow batches, one row out for each point.

Data whose number is under a checked bound go to every task: there a batch of points finds its neighbours and is estimated
at once, with nothing shuffled but the points. Otherwise the relational part leaves one row a point with its neighbours as
arrays of structs (``nhmax`` and ``nsmax`` at most, so the size of a row is bounded). Points without soft neighbours never
meet an integrator; those with as many hard neighbours are solved together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.covariance import Covariance, SpaceTime
from plumbline.functions.softpdf import SoftPdf
from plumbline.operators import kernels
from plumbline.operators.kernels import FIELDS, Options
from plumbline.operators.neighbors import BROADCAST_VALUES, MOST_DIMS, _dims, dealt, knn, knn_st, nearest, places, top_covariances
from plumbline.operators.network import checkpointed
from plumbline.operators.tree import Tree


def _order(value: float | None) -> float | None:
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


def _gathered(est: DataFrame, pairs: DataFrame, data: DataFrame, fields: list[str], name: str) -> DataFrame:
    """``est`` with an array of its neighbours' fields, by rank."""
    rows = pairs.join(data, "obs_id").groupBy("est_id").agg(F.sort_array(F.collect_list(F.struct("rank", "obs_id", *fields))).alias(name))
    return est.join(rows, "est_id", "left")


def _as_obs(df: DataFrame, key: str, *fields: str) -> DataFrame:
    return df.select(F.col(key).alias("obs_id"), *fields)


_NAMES = ["est_id", *(f.split()[0] for f in FIELDS.split(", "))]
_KINDS = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "int": pa.int32(), "string": pa.string()}
_TYPES = [pa.int64(), *(_KINDS[f.split()[1]] for f in FIELDS.split(", "))]


def _arrow(out: list[dict]) -> pa.RecordBatch:
    """NaN stays NaN."""
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], type=t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _kernel(rows: DataFrame, one, opt: Options) -> DataFrame:
    """``one(row) -> dict`` over batches."""

    def run(batches):
        for batch in batches:
            yield _arrow([one(r) | {"est_id": r["est_id"]} for r in batch.to_pylist()])

    return dealt(rows, "est_id").mapInArrow(run, f"est_id long, {FIELDS}")


#: Soft data that go to every task, at most; a density has some 50 values.
BROADCAST_SOFT = BROADCAST_VALUES // 64


class _Data:
    """Data that go to every task, by id: places, times, and hard values or densities, which are made when first asked for."""

    def __init__(self, table: pa.Table, dims: int) -> None:
        table = table.sort_by("obs_id")
        self.ids = table.column("obs_id").to_numpy()
        self.at = places(table.column("coords"), dims)
        self.t = table.column("t").to_numpy() if "t" in table.column_names else None
        self.z = table.column("z").to_numpy() if "z" in table.column_names else None
        self.rows = table.column("pdf").combine_chunks() if "pdf" in table.column_names else None
        self.made: dict[int, SoftPdf] = {}
        self.tree: Tree | None = None

    def indexed(self, k: int, timed: tuple[float, float, bool] | None) -> _Data:
        """With the tree that ``_ranked`` searches, made once for all tasks."""
        if self.at.shape[1] > MOST_DIMS and not (timed and timed[2]):
            return self
        exact = timed is not None and timed[2]
        self.tree = Tree(np.column_stack([self.at, self.t]) if exact else self.at, self.ids, k if exact or timed is None else max(4 * k, 50), timed[1] if exact else None)
        return self

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def density(self, i: int) -> SoftPdf:
        if i not in self.made:
            self.made[i] = SoftPdf.from_row(self.rows[i].as_py())
        return self.made[i]


def _collected(data: DataFrame, dims: int, most: int) -> _Data | None:
    """The data, unless there are more than ``most`` values; no more rows than that ever reach the driver."""
    rows = most // (dims + 1)
    table = data.where("coords IS NOT NULL").limit(rows + 1).toArrow()
    return _Data(table, dims) if table.num_rows <= rows else None


def _ranked(at, t, data: _Data, k: int, dmax: float, timed: tuple[float, float, bool] | None, skip=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, datum and distance, by point and rank; ``timed`` has the longest time gap, its weight against distance, and whether all data are ranked."""
    find = data.tree.nearest if data.tree else lambda at, k, dmax, tmax=math.inf, skip=None: nearest(at, data.at, data.ids, k, dmax, skip)
    if timed is None:
        return find(at, k, dmax, skip=skip)[:3]
    tmax, ratio, exact = timed
    if exact:
        return find(np.column_stack([at, t]), k, dmax, tmax)[:3]
    r, c, d, _ = find(at, max(4 * k, 50), dmax)
    gap = np.abs(t[r] - data.t[c])
    r, c, d, gap = (x[gap <= tmax] for x in (r, c, d, gap))
    order = np.lexsort((data.ids[c], d + ratio * gap, r))
    r, c, d = r[order], c[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], d[keep]


class _Near:
    """The neighbours of one batch of points, as ``_Data``, from a column of arrays of structs by rank."""

    def __init__(self, lists: pa.ListArray, dims: int) -> None:
        rows = lists.flatten()
        self.offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))])
        names = [f.name for f in rows.type]
        self.at = places(pc.struct_field(rows, ["coords"]), dims)
        self.t, self.z, self.distance = (pc.struct_field(rows, [n]).to_numpy(zero_copy_only=False).astype(float) if n in names else None for n in ("t", "z", "distance"))
        self.rows = pc.struct_field(rows, ["pdf"]) if "pdf" in names else None

    def density(self, i: int) -> SoftPdf:
        return SoftPdf.from_row(self.rows[i].as_py())

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.at)
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets)), np.arange(n), np.zeros(n) if self.distance is None else self.distance


def _estimates(ids, at, t, hard, near_hard, soft, near_soft, blocks, opt: Options) -> pa.RecordBatch:
    """A batch of points from their neighbours (point, datum, distance), by rank. ``blocks(a, ta, b, tb)`` are covariances between places, a first axis more for a stack of them."""
    (hr, hc, hd), (sr, sc, _), timed = near_hard, near_soft, t is not None
    n, dims = at.shape
    h, s = np.searchsorted(hr, np.arange(n + 1)), np.searchsorted(sr, np.arange(n + 1))
    out: list[dict | None] = [None] * n
    same = np.zeros(n, dtype=bool)
    if not timed:
        has = np.diff(h) > 0
        same[has] = hd[h[:-1][has]] < 1e-10
    for i in np.flatnonzero(same).tolist():
        out[i] = kernels.duplicate(float(hard.z[hc[h[i]]]), int(h[i + 1] - h[i]), int(s[i + 1] - s[i]), opt)
    plain = (np.diff(s) == 0) & ~same & (np.diff(h) > 0)
    for size in np.unique(np.diff(h)[plain]).tolist():
        rows = np.flatnonzero(plain & (np.diff(h) == size))
        for some in np.array_split(rows, -(-len(rows) * size * size // 2_000_000)):
            near = hc[h[:-1][some][:, None] + np.arange(size)]
            xk, xh = at[some][:, None], hard.at[near]
            tk, th = (t[some][:, None], hard.t[near]) if timed else (None, None)
            ckk = float(blocks(xk[:1], None if tk is None else tk[:1], xk[:1], None if tk is None else tk[:1])[0, 0, 0])
            got = kernels.krige(at[some], xh, hard.z[near], ckk, blocks(xk, tk, xh, th)[:, 0], blocks(xh, th, xh, th), opt)
            for i, row in zip(some.tolist(), got or [], strict=False):
                out[i] = row
    for i in range(n):
        if out[i] is None:
            a, b = hc[h[i] : h[i + 1]], sc[s[i] : s[i + 1]]
            xk, xh, xs = at[i][None], hard.at[a], soft.at[b] if soft is not None else np.zeros((0, dims))
            tk, th, ts = (t[i : i + 1], hard.t[a], soft.t[b] if soft is not None else np.zeros(0)) if timed else (None, None, None)
            out[i] = kernels.estimate(xk, xh, hard.z[a], xs, [soft.density(j) for j in b.tolist()], float(blocks(np.zeros((1, dims)), tk, np.zeros((1, dims)), tk)[0, 0]), blocks(xk, tk, xh, th)[0], blocks(xh, th, xh, th), blocks(xk, tk, xs, ts)[0], blocks(xs, ts, xh, th), blocks(xs, ts, xs, ts), opt, None, _seed(ids[i]))
    return _arrow([row | {"est_id": i} for i, row in zip(ids.tolist(), out, strict=True)])


_NONE = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)


def _fused(points: DataFrame, hard: _Data, soft: _Data | None, blocks, nhmax: int, nsmax: int, dmax: float, timed, leave_out: bool, opt: Options, dims: int) -> DataFrame:
    """Neighbours and estimates of batches of points; ``timed`` is that of ``_ranked``."""
    hard = hard.indexed(nhmax + leave_out, timed)
    soft = soft.indexed(nsmax, timed) if soft is not None else None
    shared = points.sparkSession.sparkContext.broadcast((hard, soft))

    def run(batches):
        hard, soft = shared.value
        for batch in batches:
            ids, at = batch.column("est_id").to_numpy(zero_copy_only=False), places(batch.column("coords"), dims)
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(float) if timed else None
            near = _ranked(at, t, hard, nhmax, dmax, timed, ids if leave_out else None)
            yield _estimates(ids, at, t, hard, near, soft, _ranked(at, t, soft, nsmax, dmax, timed) if soft is not None else _NONE, blocks, opt)

    return dealt(points, "est_id").mapInArrow(run, f"est_id long, {FIELDS}")


def _joined(points: DataFrame, hard: DataFrame, near_hard: DataFrame, soft: DataFrame | None, near_soft: DataFrame | None, blocks, opt: Options, timed: bool) -> DataFrame:
    """Estimates from tables of neighbours. Data that are nobody's neighbours are left out before their columns are made."""
    rows, t, dims = points, ["t"] if timed else [], _dims(hard)
    for near, data, fields, name in ((near_hard, hard, ["coords", *t, "z", *([] if timed else ["distance"])], "hard"), (near_soft, soft, ["coords", *t, "pdf"], "soft")):
        if data is not None:
            near = checkpointed(near)
            rows = _gathered(rows, near, data.join(near.select("obs_id").distinct(), "obs_id", "left_semi"), fields, name)

    def run(batches):
        for batch in batches:
            ids, at = batch.column("est_id").to_numpy(zero_copy_only=False), places(batch.column("coords"), dims)
            when = batch.column("t").to_numpy(zero_copy_only=False).astype(float) if timed else None
            hard, soft = _Near(batch.column("hard"), dims), _Near(batch.column("soft"), dims) if "soft" in batch.schema.names else None
            yield _estimates(ids, at, when, hard, hard.ranked(), soft, soft.ranked() if soft else _NONE, blocks, opt)

    return dealt(rows, "est_id").mapInArrow(run, f"est_id long, {FIELDS}")


def _shared_data(points: DataFrame, hard: DataFrame, soft: DataFrame | None, strategy: str, dmax: float):
    """Number of coordinates, and hard and soft data if all of them are few enough to go to every task."""
    if strategy not in ("auto", "blocks"):
        return 0, None, None
    dims = _dims(hard)
    h = _collected(hard, dims, BROADCAST_VALUES)
    s = _collected(soft, dims, BROADCAST_SOFT * (dims + 1)) if soft is not None and h is not None else None
    return dims, h if soft is None or s is not None else None, s


class _Untimed:
    """A network's covariance under a signature with times."""

    def __init__(self, cov) -> None:
        self.cov = cov

    def __call__(self, a, ta, b, tb):
        return self.cov.block(a, b)


class _Pickled:
    """A function of the caller's own, closures included, on its way to the tasks."""

    def __init__(self, f) -> None:
        self.data, self.f = cloudpickle.dumps(f), None

    def __getstate__(self):
        return self.data

    def __setstate__(self, data) -> None:
        self.data, self.f = data, None

    def __call__(self, *args):
        if self.f is None:
            self.f = cloudpickle.loads(self.data)
        return self.f(*args)


def bme_predict(est: DataFrame, hard: DataFrame, soft: DataFrame | None = None, cov: Covariance = Covariance(), nhmax: int = 20, nsmax: int = 8, dmax: float = math.inf, order: float | None = 0, n_grid: int = 200, ci_prob: float = 0.95, n_quad: int = 15, mean_prior: float = 0.0, method: str = "auto", exact_intervals: bool = False, strategy: str = "auto", leave_out: bool = False, density: bool = True) -> DataFrame:
    """Posterior at each (est_id, coords) from hard (obs_id, coords, z) and soft (soft_id, coords, pdf) data.

    ``leave_out`` leaves out the hard datum with the point's own id. Without ``density`` the columns ``z_grid`` and ``pdf`` are
    null. ``strategy`` is that of ``knn``; "auto" and "blocks" send data under a checked number to every task.
    """
    if method not in kernels.METHODS:
        raise ValueError(f"unknown method {method!r}")
    opt = Options(_order(order), n_grid, ci_prob, n_quad, mean_prior, method, "bme", exact_intervals=exact_intervals, density=density)
    points = est.select("est_id", "coords")
    h = _as_obs(hard, "obs_id", "coords", "z")
    s = _as_obs(soft, "soft_id", "coords", "pdf") if soft is not None else None
    dims, few_hard, few_soft = _shared_data(points, h, s, strategy, dmax)
    if few_hard is not None:
        return _fused(points, few_hard, few_soft, lambda a, ta, b, tb: cov.matrix(a, b), nhmax, nsmax, dmax, None, leave_out, opt, dims)
    return _joined(points, h, knn(points, h, nhmax, dmax, strategy, leave_out), s, knn(points, s, nsmax, dmax, strategy) if s is not None else None, lambda a, ta, b, tb: cov.matrix(a, b), opt, False)


def _seed(est_id) -> int:
    return int(est_id) % (2**31)


def bme_predict_st(est: DataFrame, hard: DataFrame, soft: DataFrame | None = None, cov: SpaceTime | None = None, nhmax: int = 20, nsmax: int = 8, dmax: float = math.inf, tmax: float = math.inf, order: float | None = 0, n_grid: int = 200, ci_prob: float = 0.95, n_quad: int = 15, mean_prior: float = 0.0, method: str = "auto", ratio: float = 1.0, exact: bool = False, strategy: str = "auto", density: bool = True) -> DataFrame:
    """As bme_predict with a time ``t`` beside the coordinates. The trend is of the coordinates alone; a datum on the point is no shortcut."""
    cov = cov or SpaceTime("exponential", [1.0, 1.0], "exponential", [1.0, 1.0])
    opt = Options(_order(order), n_grid, ci_prob, n_quad, mean_prior, method, "st_bme", density=density)
    points = est.select("est_id", "coords", "t")
    h = _as_obs(hard, "obs_id", "coords", "t", "z")
    s = _as_obs(soft, "soft_id", "coords", "t", "pdf") if soft is not None else None
    dims, few_hard, few_soft = _shared_data(points, h, s, strategy, dmax)
    if few_hard is not None:
        return _fused(points, few_hard, few_soft, cov.matrix, nhmax, nsmax, dmax, (tmax, ratio, exact), False, opt, dims)
    return _joined(points, h, knn_st(points, h, nhmax, dmax, tmax, ratio, exact), s, knn_st(points, s, nsmax, dmax, tmax, ratio, exact) if s is not None else None, cov.matrix, opt, True)


def bme_predict_network(est: DataFrame, hard: DataFrame, soft: DataFrame | None, cov, nhmax: int = 30, nsmax: int = 8, order: float | None = 0, n_grid: int = 200, ci_prob: float = 0.95, n_quad: int = 15, mean_prior: float = 0.0, method: str = "auto", density: bool = True) -> DataFrame:
    """As bme_predict on a graph: ``node`` replaces the coordinates, and any ``cov`` with ``block(a, b)`` gives covariances.

    The neighbours are the data with the largest covariances in size; all of them if they are few. The trend is the mean of
    the selected hard values.
    """
    return _on_network(est, hard, soft, _Untimed(cov), nhmax, nsmax, Options(_order(order), n_grid, ci_prob, n_quad, mean_prior, method, "network_bme", plain_mean=True, density=density), False)


def bme_predict_network_st(est: DataFrame, hard: DataFrame, soft: DataFrame | None, cov, nhmax: int = 30, nsmax: int = 8, order: float | None = 0, n_grid: int = 200, ci_prob: float = 0.95, n_quad: int = 15, mean_prior: float = 0.0, method: str = "auto", density: bool = True) -> DataFrame:
    """Graph and time: (node, t). ``cov`` is a function of (nodes, times, nodes, times) or has such a ``block``."""
    block = cov.block if hasattr(cov, "block") else _Pickled(cov)
    return _on_network(est, hard, soft, block, nhmax, nsmax, Options(_order(order), n_grid, ci_prob, n_quad, mean_prior, method, "network_st_bme", plain_mean=True, density=density), True)


#: Data on a network that are sent to every task; a network's own matrix has as many entries at its bound of nodes.
NETWORK_DATA = 2_000_000


def _on_network(est, hard, soft, block, nhmax, nsmax, opt, timed) -> DataFrame:
    t = ["t"] if timed else []
    h = hard.select("obs_id", "node", *t, "z").limit(NETWORK_DATA + 1).toArrow().sort_by("obs_id").to_pandas()
    s = soft.select("soft_id", "node", *t, "pdf").limit(NETWORK_DATA + 1).toArrow().sort_by("soft_id").to_pylist() if soft is not None else []
    if max(len(h), len(s)) > NETWORK_DATA:
        raise ValueError(f"more than {NETWORK_DATA} data on a network: rank them by covariance_pairs and top_covariances first")
    s_pdf = [SoftPdf.from_row(r["pdf"]) for r in s]
    if hasattr(block, "__self__") and hasattr(block.__self__, "prepare") and timed:
        block.__self__.prepare(est.sparkSession, [*h["node"], *(r["node"] for r in s)])
    hn, hz = h["node"].to_numpy(), h["z"].to_numpy(float)
    ht = h["t"].to_numpy(float) if timed else None
    sn, st = np.array([r["node"] for r in s], dtype=np.int64), np.array([r["t"] for r in s], float) if timed else None
    shared = est.sparkSession.sparkContext.broadcast((hn, ht, hz, sn, st, s_pdf, block))

    def pick(c, most):
        if len(c) <= most:
            return np.arange(len(c))
        return np.argsort(-np.abs(c), kind="stable")[:most]

    def one(r):
        hn, ht, hz, sn, st, pdfs, block = shared.value
        kn, kt = np.array([r["node"]]), np.array([r["t"]], float) if timed else None
        ckh = block(kn, kt, hn, ht)[0] if len(hn) else np.zeros(0)
        cks = block(kn, kt, sn, st)[0] if len(sn) else np.zeros(0)
        i, j = pick(ckh, nhmax), pick(cks, nsmax)
        a, ta, b, tb = hn[i], ht[i] if timed else None, sn[j], st[j] if timed else None
        same = next((int(x) for x in np.flatnonzero(a == r["node"])), None) if not timed else None
        blank = np.zeros((len(i), 0)), np.zeros((len(j), 0))
        return kernels.estimate(None, blank[0], hz[i], blank[1], [pdfs[x] for x in j], float(block(kn, kt, kn, kt)[0, 0]), ckh[i], block(a, ta, a, ta) if len(a) else np.zeros((0, 0)), cks[j], block(b, tb, a, ta) if len(a) and len(b) else np.zeros((len(b), len(a))), block(b, tb, b, tb) if len(b) else np.zeros((0, 0)), opt, same, _seed(r["est_id"]))

    return _kernel(est.select("est_id", "node", *t), one, opt)


def rank_network_data(est: DataFrame, obs: DataFrame, covariances: DataFrame, k: int) -> DataFrame:
    """The k data with the largest covariances for each point, from a table (i, j, c): two equi-joins and a window."""
    pairs = est.select("est_id", F.col("node").alias("i")).join(covariances, "i").join(obs.select("obs_id", F.col("node").alias("j")), "j").select("est_id", "obs_id", "c")
    return top_covariances(pairs, k)


def kriging_predict(est: DataFrame, hard: DataFrame, cov: Covariance = Covariance(), nhmax: int = 50, n_grid: int = 100, **more) -> DataFrame:
    """Hard data alone."""
    return bme_predict(est, hard, None, cov, nhmax=nhmax, n_grid=n_grid, **more)


def kriging_me_predict(est: DataFrame, hard: DataFrame, soft: DataFrame, cov: Covariance = Covariance(), nhmax: int = 50, nsmax: int = 20, n_grid: int = 100, **more) -> DataFrame:
    """Measurement error: Gaussian soft data (soft_id, coords, mean, sigma)."""
    from plumbline.functions.softpdf import gaussian_column

    return bme_predict(est, hard, soft.select("soft_id", "coords", gaussian_column(F.col("mean"), F.col("sigma")).alias("pdf")), cov, nhmax=nhmax, nsmax=nsmax, n_grid=n_grid, **more)


def yearly_kriging(stations: DataFrame, cells: DataFrame, cov: Covariance, cells_a_task: int = 20_000) -> DataFrame:
    """A simple kriging map of each year: stations (year, x, y, z), cells (x, y); fewer than 3 stations give NaN. (year, x, y, estimate, variance).

    Cells are dealt into parts of some ``cells_a_task``; each part meets the stations of all years, which one task holds.
    """
    parts = -(-cells.count() // cells_a_task) or 1

    def run(at: pd.DataFrame, spots: pd.DataFrame) -> pd.DataFrame:
        out = []
        places = spots[["x", "y"]].to_numpy(float)
        for year, own in at.groupby("year") if len(places) else ():
            known, z = own[["x", "y"]].to_numpy(float), own["z"].to_numpy(float)
            got = pd.DataFrame({"year": year, "x": places[:, 0], "y": places[:, 1], "estimate": math.nan, "variance": math.nan})
            if len(z) >= 3:
                cross = cov.matrix(places, known)
                weights = np.linalg.solve(cov.matrix(known, known) + 1e-10 * np.eye(len(z)), cross.T)
                got = got.assign(estimate=z.mean() + weights.T @ (z - z.mean()), variance=np.maximum(cov.variance - (weights * cross.T).sum(axis=0), 0.0))
            out.append(got)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("year", "x", "y", "estimate", "variance")})

    every = stations.sparkSession.range(parts).select(F.col("id").alias("__part"))
    s = stations.where("z IS NOT NULL").select("year", "x", "y", "z").crossJoin(F.broadcast(every))
    c = cells.select("x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("__part"))
    maps = s.groupBy("__part").cogroup(c.groupBy("__part")).applyInPandas(run, "year long, x double, y double, estimate double, variance double")
    return maps.fillna(math.nan, ["estimate", "variance"])


def cross_validate(hard: DataFrame, cov: Covariance = Covariance(), n_grid: int = 80, **more) -> DataFrame:
    """Leave-one-out: (est_id, z, mean, variance, error), all folds in one job."""
    est = hard.select(F.col("obs_id").alias("est_id"), "coords")
    got = bme_predict(est, hard, None, cov, n_grid=n_grid, leave_out=True, density=False, **more)
    return got.join(hard.select(F.col("obs_id").alias("est_id"), "z"), "est_id").select("est_id", "z", "mean", "variance", (F.col("mean") - F.col("z")).alias("error"))


def errors(rows: DataFrame) -> DataFrame:
    """One row (n, rmse, mae, mean_std) of (error, variance)."""
    return rows.agg(F.count("error").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae"), F.avg(F.sqrt("variance")).alias("mean_std"))


__all__ = ["Options", "bme_predict", "bme_predict_network", "bme_predict_network_st", "bme_predict_st", "cross_validate", "errors", "kriging_me_predict", "kriging_predict", "rank_network_data", "yearly_kriging"]
