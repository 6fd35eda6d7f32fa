"""Graphs: adjacency, Laplacians and mass balance as tables of entries (i, j, v), and covariances of networks.

The sparse algebra is relational: a matrix is a table of its entries, a product a join and a sum. Dense inverses of a
network of up to ``DENSE_NODES`` nodes are made once, on the driver. Of a larger one (up to ``SPARSE_ENTRIES`` entries, which
go to every task) the columns that a point needs are solved by conjugate gradients where the point is estimated; beyond that,
systems are solved on the entry tables.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.covariance import Covariance
from plumbline.operators.geometry import numbered

DENSE_NODES = 5000
#: Entries of a sparse matrix that is collected and sent to every task, and values of its columns that a task keeps.
SPARSE_ENTRIES, KEPT_VALUES = 5_000_000, 1 << 24
#: Rounds after which a table that grows by a union each round is written anew, so that its plan stays short.
COMPACT = 16


def adjacency(edges: DataFrame) -> DataFrame:
    """Entries of both directions of (src, dst[, w]); repeated edges add up."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), w.cast("double").alias("v"))
    return one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def laplacian(adj: DataFrame, normalised: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """D - W with W made symmetric; normalised: with 1 on the diagonal, 0 for a node without edges. ``nodes`` (node) adds those."""
    half = adj.select("i", "j", (F.col("v") / 2).alias("v"))
    w = half.union(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    degree = w.groupBy("i").agg(F.sum("v").alias("d"))
    if nodes is not None:
        degree = nodes.select(F.col("node").alias("i")).join(degree, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"))
    both = degree.select("i", F.col("i").alias("j"), F.col("d").alias("v")).union(w.select("i", "j", -F.col("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    if not normalised:
        return both
    scale = degree.select("i", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("s"))
    return both.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", (F.col("v") * F.col("s") * F.col("t")).alias("v"))


def precision(lap: DataFrame, nodes: DataFrame, kappa: float, sigma2: float = 1.0) -> DataFrame:
    """(kappa^2 I + L) / sigma2."""
    diagonal = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(kappa * kappa).alias("v"))
    return diagonal.union(lap.select("i", "j", "v")).groupBy("i", "j").agg((F.sum("v") / sigma2).alias("v"))


def mass_balance(edges: DataFrame) -> DataFrame:
    """Rows (h, j, v) of the operator: one for each node with a parent, by node, with 1 for itself and -w for its parents."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    heads = edges.select("dst").distinct()
    rows = numbered(checkpointed(heads), ["dst"], "h")
    parents = edges.select("dst", F.col("src").alias("j"), (-w).cast("double").alias("v"))
    own = heads.select("dst", F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    return own.union(parents).groupBy("dst", "j").agg(F.sum("v").alias("v")).join(rows, "dst").select(F.col("h").cast("long").alias("h"), "j", "v")


def gram(h: DataFrame) -> DataFrame:
    """H'H: a self join on the row, and a sum."""
    return h.select("h", F.col("j").alias("i"), F.col("v").alias("__a")).join(h.select("h", "j", F.col("v").alias("__b")), "h").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def residual(h: DataFrame, values: DataFrame) -> DataFrame:
    """Hx of (node, x): (h, r)."""
    return h.join(values.select(F.col("node").alias("j"), "x"), "j").groupBy("h").agg(F.sum(F.col("v") * F.col("x")).alias("r"))


def matvec(m: DataFrame, x: DataFrame) -> DataFrame:
    """Entries (i, j, v) times (node, x): (node, x)."""
    return m.join(x.select(F.col("node").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x")).withColumnRenamed("i", "node")


def conjugate_gradient(m: DataFrame, b: DataFrame, tol: float = 1e-8, steps: int | None = None) -> DataFrame:
    """Solves m x = b on entry tables, with the diagonal as preconditioner: any number of nodes; state is written each step.

    Raises if the residual isn't within ``tol`` of the first after ``steps`` (200, or ten for each node if that is more).
    """
    diagonal = m.where("i = j").select(F.col("i").alias("node"), F.col("v").alias("d"))
    state = diagonal.join(b.select("node", F.col("x").alias("r")), "node", "left").select("node", "d", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))
    state = state.withColumn("p", F.col("r") / F.col("d"))
    state = checkpointed(state)
    rz, first, n = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r")), F.count(F.lit(1))).first()
    if not first or rz is None:
        return state.select("node", "x")
    steps = max(200, 10 * n) if steps is None else steps
    for _ in range(steps):
        q = matvec(m, state.select("node", F.col("p").alias("x"))).withColumnRenamed("x", "q")
        now = checkpointed(state.join(q, "node"))
        alpha = rz / now.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        now = now.select("node", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new, size = now.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        state = checkpointed(now.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")))
        if size <= tol * tol * first:
            break
        rz = new
    else:
        raise RuntimeError(f"residual not settled in {steps} steps")
    return state.select("node", "x")


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, local mode (tests) makes one; a cluster must name one that all its machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir`` and read again; the table goes when the session's JVM ends.

    ``DataFrame.checkpoint`` won't do: where a plan meets its result twice, as unions of rounds do, Spark renames the columns but
    not all constraints on them, and a filter above such a union fails with "key not found".
    """
    spark = df.sparkSession
    path = f"{(spark.sparkContext.getCheckpointDir() or shared_dir(spark)).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def hops(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """(node, hop) by breadth-first rounds of joins, each written, until no node is left; raises if some are beyond ``most`` hops."""
    spark = edges.sparkSession
    step = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = frontier = spark.createDataFrame([(start, 0)], "node long, hop long")
    for hop in count(1):
        new = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        new = checkpointed(new)
        if new.isEmpty():
            break
        if most is not None and hop > most:
            raise RuntimeError(f"nodes beyond {most} hops")
        seen, frontier = seen.union(new), new
        if hop % COMPACT == 0:
            seen = checkpointed(seen)
    return seen


def decay_by_hop(covariances: DataFrame, edges: DataFrame, start: int) -> DataFrame:
    """Mean correlation with ``start`` by hops from it, of a table (i, j, c)."""
    spread = covariances.where("i = j").select(F.col("i").alias("j"), F.col("c").alias("cjj"))
    own = covariances.where((F.col("i") == start) & (F.col("j") == start)).select(F.col("c").alias("cii"))
    row = covariances.where(F.col("i") == start).select("j", "c").join(spread, "j").join(own)
    return row.join(hops(edges, start).withColumnRenamed("node", "j"), "j").groupBy("hop").agg(F.avg(F.col("c") / F.sqrt(F.col("cjj") * F.col("cii"))).alias("correlation"), F.count(F.lit(1)).alias("n"))


def footprint(covariances: DataFrame, start: int) -> DataFrame:
    """A row of the matrix over its largest entry in size: (j, c)."""
    top = F.max(F.abs("c")).over(Window.partitionBy("i"))
    return covariances.where(F.col("i") == start).select("j", (F.col("c") / top).alias("c"))


def link_segments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a figure draws of links (src, dst): (src, dst, x0, y0, x1, y1), without those of which an end has no place in nodes (node, x, y)."""
    at = nodes.select("node", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    start, end = (at.select(F.col("node").alias(k), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i, k in enumerate(("src", "dst")))
    return edges.select("src", "dst").join(start, "src").join(end, "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def node_field(nodes: DataFrame, values: DataFrame, share: float = 0.95) -> DataFrame:
    """What a figure draws of nodes (node, x, y): (node, x, y, value, colour). Nodes without a value are null; colours end at the ``share`` quantile of positive values."""
    top = values.where("value > 0").agg(F.percentile("value", F.lit(share)).alias("cap"))
    rows = nodes.select("node", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").join(values.select("node", "value"), "node", "left").crossJoin(F.broadcast(top))
    return rows.select("node", "x", "y", "value", F.when(F.col("value").isNotNull(), F.least("value", "cap")).alias("colour"))


# --- covariances of networks ---------------------------------------------------------------------------------------------


def dense(entries: DataFrame, n: int) -> np.ndarray:
    """An entry table of a network within the bound as an array."""
    if n > DENSE_NODES:
        raise ValueError(f"{n} nodes: a dense matrix serves up to {DENSE_NODES}")
    out = np.zeros((n, n))
    rows = entries.toPandas()
    np.add.at(out, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["v"].to_numpy(float))
    return out


def _conjugate(q: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    x, d = np.zeros_like(b), np.diag(q)
    r, z = b.copy(), b / d
    p, rz = z.copy(), float(r @ z)
    for _ in range(10 * len(b)):
        if rz <= tol * tol:
            break
        s = q @ p
        a = rz / float(p @ s)
        x, r = x + a * p, r - a * s
        z = r / d
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


@dataclass
class Csr:
    """A square sparse matrix by rows, each with its diagonal entry."""

    at: np.ndarray
    columns: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, i, j, v, n: int) -> Csr:
        """From entries, of which those at one place add up."""
        every = np.arange(n)
        i, j, v = np.concatenate([np.asarray(i, np.int64), every]), np.concatenate([np.asarray(j, np.int64), every]), np.concatenate([np.asarray(v, float), np.zeros(n)])
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        return cls(np.searchsorted(i[first], np.arange(n + 1)), j[first], np.add.reduceat(v, first))

    @classmethod
    def from_table(cls, entries: DataFrame, n: int) -> Csr:
        rows = entries.select("i", "j", "v").limit(SPARSE_ENTRIES + 1).toPandas()
        if len(rows) > SPARSE_ENTRIES:
            raise ValueError(f"over {SPARSE_ENTRIES} entries: use precision() and conjugate_gradient() on tables")
        return cls.of(rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy(float), n)

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    @property
    def diagonal(self) -> np.ndarray:
        return self.data[self.columns == self.rows]

    def plus(self, other: Csr, scale: float = 1.0) -> Csr:
        return Csr.of(*(np.concatenate(x) for x in ((self.rows, other.rows), (self.columns, other.columns), (self.data, scale * other.data))), len(self))

    def shifted(self, diagonal, scale: float = 1.0) -> Csr:
        """(self + diag) * scale."""
        data = self.data.copy()
        data[self.columns == self.rows] += diagonal
        return Csr(self.at, self.columns, data * scale)

    def times(self, other: Csr) -> Csr:
        """The product: each entry meets a row of the other matrix."""
        sizes = np.diff(other.at)[self.columns]
        take = np.repeat(other.at[self.columns] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return Csr.of(np.repeat(self.rows, sizes), other.columns[take], np.repeat(self.data, sizes) * other.data[take], len(self))

    def dot(self, x: np.ndarray) -> np.ndarray:
        """Of columns (n, m)."""
        return np.add.reduceat(self.data[:, None] * x[self.columns], self.at[:-1], axis=0)

    def solve(self, b: np.ndarray, tol: float = 1e-11) -> np.ndarray:
        """Of columns (n, m) for a positive definite matrix: conjugate gradients with the diagonal as preconditioner, all columns in step. Raises if they don't settle."""
        d = self.diagonal[:, None]
        x, r = np.zeros_like(b), b.copy()
        z = r / d
        p, rz = z.copy(), (r * z).sum(axis=0)
        least = tol * tol * np.maximum(rz, 1e-300)
        for _ in range(max(200, 10 * len(self))):
            if (rz <= least).all():
                return x
            s = self.dot(p)
            step = np.where(rz > least, rz / np.maximum((p * s).sum(axis=0), 1e-300), 0.0)
            x += step * p
            r -= step * s
            z = r / d
            rz, before = (r * z).sum(axis=0), rz
            p = z + rz / np.maximum(before, 1e-300) * p
        raise RuntimeError("columns not settled")


class SparseColumns:
    """Columns of a symmetric matrix that isn't held: made when asked for, many together, and kept up to ``KEPT_VALUES`` values."""

    def __init__(self, n: int, make, width: int) -> None:
        self.n, self.make, self.width = n, make, max(1, width)
        self.kept: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def __call__(self, nodes) -> np.ndarray:
        """(m, n) of m nodes."""
        nodes = [int(x) for x in nodes]
        new = [x for x in dict.fromkeys(nodes) if x not in self.kept]
        found = {x: self.kept[x] for x in nodes if x in self.kept}
        for i in range(0, len(new), self.width):
            some = new[i : i + self.width]
            unit = np.zeros((self.n, len(some)))
            unit[some, np.arange(len(some))] = 1.0
            found |= dict(zip(some, self.make(unit).T.copy(), strict=True))
        for x in new:
            while len(self.kept) * self.n >= KEPT_VALUES and self.kept:
                self.kept.pop(next(iter(self.kept)))
            self.kept[x] = found[x]
        return np.stack([found[x] for x in nodes]) if nodes else np.zeros((0, self.n))


class SparseNetworkCovariance:
    """As NetworkCovariance for a network of any number of nodes whose Laplacian has at most ``SPARSE_ENTRIES`` entries.

    Columns come from conjugate gradients; those of a diffusion from its series in steps of a random walk (uniformisation).
    """

    def __init__(self, lap: Csr, kappa: float, sigma2: float = 1.0, method: str = "regularised", extra: Csr | None = None) -> None:
        method = "regularised" if method == "regularized" else method
        if method not in NetworkCovariance.METHODS:
            raise ValueError(f"unknown method {method!r}; there are {', '.join(NetworkCovariance.METHODS)}")
        self.lap, self.kappa, self.sigma2, self.method = lap, kappa, sigma2, method
        self.q = (lap if extra is None else lap.plus(extra)).shifted(kappa * kappa, 1 / sigma2)
        self.columns = SparseColumns(len(lap), self._diffused if method == "diffusion" else self.q.solve, 4_000_000 // max(1, len(lap.data)))
        self.known: dict[int, float] = {}

    def _diffused(self, x: np.ndarray) -> np.ndarray:
        top = float(np.abs(np.add.reduceat(np.abs(self.lap.data), self.lap.at[:-1])).max())
        rate = self.kappa * top
        out, weight, total, k = np.zeros_like(x), math.exp(-min(rate, 700.0)), 0.0, 0
        if rate > 700:
            raise ValueError("kappa times the largest row sum of the Laplacian must be at most 700")
        while total < 1 - 1e-13 and k < rate + 40 * math.sqrt(rate + 1) + 40:
            out += weight * x
            total, k = total + weight, k + 1
            weight *= rate / k
            x = x - self.lap.dot(x) / max(top, 1e-300)
        return self.sigma2 * out

    def block(self, a, b) -> np.ndarray:
        a, b = np.asarray(a, int), np.asarray(b, int)
        if len(np.unique(a)) <= len(np.unique(b)):
            return self.columns(a)[:, b]
        return self.columns(b)[:, a].T

    def variance(self, nodes) -> np.ndarray:
        nodes = np.asarray(nodes, int)
        new = [x for x in dict.fromkeys(nodes.tolist()) if x not in self.known]
        if new:
            got = self.columns(new)
            self.known |= {x: float(got[i, x]) for i, x in enumerate(new)}
        return np.array([self.known[x] for x in nodes.tolist()])

    def prepare(self, spark, nodes) -> None:
        """Variances of nodes that every task needs, each worked out once, in tasks."""
        new = sorted({int(x) for x in nodes} - self.known.keys())
        if not new:
            return
        shared = spark.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                yield batch.assign(v=shared.value.variance(batch["id"]))

        rows = spark.createDataFrame(pd.DataFrame({"id": new})).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
        self.known |= {r["id"]: r["v"] for r in rows.mapInPandas(run, "id long, v double").collect()}


class NetworkCovariance:
    """Covariance between nodes 0..n-1 of a Laplacian: regularised (or precision): sigma2 (kappa^2 I + L)^-1; diffusion: sigma2 exp(-kappa L).

    ``block(a, b)`` gives a slice. The matrix is made on first use.
    """

    METHODS = ("regularised", "precision", "diffusion")

    def __init__(self, lap: np.ndarray, kappa: float, sigma2: float = 1.0, method: str = "regularised", extra: np.ndarray | None = None) -> None:
        method = "regularised" if method == "regularized" else method
        if method not in self.METHODS:
            raise ValueError(f"unknown method {method!r}; there are {', '.join(self.METHODS)}")
        lap = np.asarray(lap, float)
        if lap.ndim != 2 or lap.shape[0] != lap.shape[1]:
            raise ValueError("a Laplacian is square")
        if len(lap) > DENSE_NODES:
            raise ValueError(f"{len(lap)} nodes: beyond {DENSE_NODES}, use SparseNetworkCovariance")
        self.lap, self.kappa, self.sigma2, self.method = lap, kappa, sigma2, method
        self.q = (kappa * kappa * np.eye(len(lap)) + lap + (0 if extra is None else extra)) / sigma2
        self._c: np.ndarray | None = None

    @classmethod
    def of(cls, edges: DataFrame, n: int, kappa: float, sigma2: float = 1.0, method: str = "regularised", normalised: bool = False) -> NetworkCovariance | SparseNetworkCovariance:
        """Of a network of n nodes: with the whole matrix up to ``DENSE_NODES``, else with the columns that are asked for."""
        nodes = edges.sparkSession.range(n).select(F.col("id").alias("node"))
        lap = laplacian(adjacency(edges), normalised, nodes)
        if n > DENSE_NODES:
            return SparseNetworkCovariance(Csr.from_table(lap, n), kappa, sigma2, method)
        return cls(dense(lap, n), kappa, sigma2, method)

    @property
    def c(self) -> np.ndarray:
        if self._c is None:
            if self.method == "diffusion":
                values, vectors = np.linalg.eigh(0.5 * (self.lap + self.lap.T))
                self._c = self.sigma2 * (vectors * np.exp(-self.kappa * values)) @ vectors.T
            else:
                self._c = np.linalg.inv(self.q)
            self._c = 0.5 * (self._c + self._c.T)
        return self._c

    def block(self, a, b) -> np.ndarray:
        return self.c[np.ix_(np.asarray(a, int), np.asarray(b, int))]

    def variance(self, nodes=None) -> np.ndarray:
        d = np.diag(self.c)
        return d if nodes is None else d[np.asarray(nodes, int)]

    def table(self, spark) -> DataFrame:
        """(i, j, c) of all pairs, made in tasks row by row of the matrix."""
        n, shared = len(self.c), spark.sparkContext.broadcast(self.c)

        def run(batches):
            for batch in batches:
                for rows in np.array_split(batch["id"].to_numpy(), -(-len(batch) * n // 1_000_000) or 1):
                    yield pd.DataFrame({"i": np.repeat(rows, n), "j": np.tile(np.arange(n), len(rows)), "c": shared.value[rows].ravel()})

        return spark.range(n).mapInPandas(run, "i long, j long, c double")


class PhysicsInformed(NetworkCovariance):
    """Precision (kappa^2 I + alpha L + lam H'H) / sigma2: what breaks the mass balance H is unlikely."""

    def __init__(self, lap: np.ndarray, h: np.ndarray, kappa: float, lam: float = 1.0, alpha: float = 1.0, sigma2: float = 1.0) -> None:
        h = np.asarray(h, float)
        super().__init__(alpha * np.asarray(lap, float), kappa, sigma2, "regularised", lam * h.T @ h)


class NetworkSpaceTime:
    """Correlation between nodes times a temporal model, times sigma2 (the network's own by default)."""

    def __init__(self, network: NetworkCovariance | SparseNetworkCovariance, time: Covariance, sigma2: float | None = None) -> None:
        self.network, self.time = network, time
        self.sigma2 = network.sigma2 if sigma2 is None else sigma2

    def prepare(self, spark, nodes) -> None:
        if isinstance(self.network, SparseNetworkCovariance):
            self.network.prepare(spark, nodes)

    def block(self, a, ta, b, tb) -> np.ndarray:
        a, b = np.asarray(a, int), np.asarray(b, int)
        sd = [np.sqrt(np.maximum(self.network.variance(x), 0.0)) for x in (a, b)]
        spread = np.maximum(sd[0][:, None] * sd[1][None], 1e-30)
        gap = np.abs(np.asarray(ta, float)[:, None] - np.asarray(tb, float)[None])
        return self.sigma2 * self.network.block(a, b) / spread * self.time.array(gap)

    __call__ = block


def precision_kriging(q: np.ndarray, nodes, values, est, nugget: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Zero-mean kriging from a precision matrix: mean and variance at ``est``. Several data on a node add up."""
    nodes, values = np.asarray(nodes, int), np.asarray(values, float)
    noise = max(nugget, 1e-10)
    a, b = np.array(q, float), np.zeros(len(q))
    np.add.at(a, (nodes, nodes), 1 / noise)
    np.add.at(b, nodes, values / noise)
    try:
        lower = np.linalg.cholesky(a)
        x = np.linalg.solve(lower.T, np.linalg.solve(lower, b))
        half = np.linalg.solve(lower, np.eye(len(q))[:, est])
        variance = (half * half).sum(axis=0)
    except np.linalg.LinAlgError:
        x, variance = _conjugate(a, b), np.full(len(np.atleast_1d(est)), math.nan)
    return x[est], variance


def precision_kriging_at(spark, q: Csr, nodes, values, est: DataFrame, nugget: float = 1e-4) -> DataFrame:
    """As ``precision_kriging`` for a sparse precision matrix and a table ``est`` (est_id, node): (est_id, mean, variance), variances in tasks."""
    nodes, noise = np.asarray(nodes, int), max(nugget, 1e-10)
    a = q.shifted(np.bincount(nodes, minlength=len(q)) / noise)
    mean = a.solve((np.bincount(nodes, weights=np.asarray(values, float), minlength=len(q)) / noise)[:, None])[:, 0]
    shared = spark.sparkContext.broadcast((mean, SparseColumns(len(q), a.solve, 4_000_000 // max(1, len(a.data)))))

    def run(batches):
        mean, columns = shared.value
        for batch in batches:
            some, which = np.unique(batch["node"].to_numpy(), return_inverse=True)
            variance = np.concatenate([columns(part)[np.arange(len(part)), part] for part in np.array_split(some, -(-len(some) // 256))]) if len(some) else np.zeros(0)
            yield pd.DataFrame({"est_id": batch["est_id"], "mean": mean[batch["node"]], "variance": variance[which]})

    # Points of one node are together, so that its column is solved once.
    return est.select("est_id", "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").mapInPandas(run, "est_id long, mean double, variance double")


def sill_rescale(values, cov: NetworkCovariance | SparseNetworkCovariance, nodes) -> float:
    """Variance of the data over the mean variance of their nodes."""
    return float(np.var(values) / np.mean(cov.variance(nodes)))
