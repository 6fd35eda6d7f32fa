"""Finite elements on triangles: meshes, mass and stiffness as entry tables, Matern precision, and kriging on the mesh."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.neighbors import nearest
from plumbline.operators.network import DENSE_NODES, Csr, precision_kriging, precision_kriging_at


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (m, 3) of points in the plane: each point opens the hole of triangles whose circumcircle holds it.

    A tiny fixed shift of each point breaks the ties of regular grids. Meant for meshes of up to some thousand nodes.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), dtype=np.int64)
    low, high = points.min(axis=0), points.max(axis=0)
    scale = float((high - low).max()) or 1.0
    p = (points - (low + high) / 2) / scale + 1e-7 * np.random.default_rng(7).standard_normal((n, 2))
    p = np.vstack([p, [[-50.0, -40.0], [50.0, -40.0], [0.0, 60.0]]])
    tri, circle, alive = np.zeros((8 * n + 64, 3), dtype=np.int64), np.zeros((8 * n + 64, 3)), np.zeros(8 * n + 64, dtype=bool)

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
        return np.column_stack([a + u, (u * u).sum(axis=1)])

    tri[0], alive[0], used = [n, n + 1, n + 2], True, 1
    circle[:1] = circles(tri[:1])
    for i in np.lexsort((p[:n, 1], p[:n, 0])):
        away = p[i] - circle[:used, :2]
        bad = np.flatnonzero(alive[:used] & ((away * away).sum(axis=1) < circle[:used, 2]))
        edges = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        border, times = np.unique(edges, axis=0, return_counts=True)
        border = border[times == 1]
        new = np.column_stack([border, np.full(len(border), i)])
        alive[bad] = False
        slots = np.concatenate([bad, np.arange(used, used + max(0, len(new) - len(bad)))])[: len(new)]
        used = max(used, int(slots.max()) + 1)
        tri[slots], circle[slots], alive[slots] = new, circles(new), True
    found = tri[:used][alive[:used]]
    return found[(found < n).all(axis=1)]


@dataclass
class Mesh:
    """``nodes`` (n, 2) and ``triangles`` (m, 3)."""

    nodes: np.ndarray
    triangles: np.ndarray

    @classmethod
    def from_points(cls, coords, extend: float = 0.1, max_edge: float | None = None) -> Mesh:
        """A regular grid over the padded bounds with the data points in it; grid points next to a data point give way."""
        coords = np.asarray(coords, float)
        low, high = coords.min(axis=0), coords.max(axis=0)
        extent = np.maximum(high - low, 1e-9)
        low, high = low - extend * extent, high + extend * extent
        step = max_edge or float((high - low).max()) / 4
        axes = [np.linspace(a, b, max(3, math.ceil((b - a) / step) + 1)) for a, b in zip(low, high, strict=True)]
        lattice = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)
        kept: list[np.ndarray] = []
        near = 0.05 * step
        cells: dict[tuple[int, int], list[np.ndarray]] = {}
        for point in [*coords, *lattice]:
            cell = tuple(np.floor(point / near).astype(int).tolist())
            if all(((point - q) ** 2).sum() > near * near for i in (-1, 0, 1) for j in (-1, 0, 1) for q in cells.get((cell[0] + i, cell[1] + j), [])):
                cells.setdefault(cell, []).append(point)
                kept.append(point)
        nodes = np.array(kept)
        return cls(nodes, delaunay(nodes))

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """mesh_nodes (id, x, y) and mesh_tri (id, a, b, c)."""
        nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(self.nodes)], "id long, x double, y double")
        return nodes, spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(self.triangles)], "id long, a long, b long, c long")

    def _elements(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lumped mass, and entries (i, j, v) of the stiffness, nine for each triangle."""
        t = self.triangles
        p = self.nodes[t]
        edges = np.stack([p[:, 2] - p[:, 1], p[:, 0] - p[:, 2], p[:, 1] - p[:, 0]], axis=1)
        area = 0.5 * np.abs(edges[:, 0, 0] * edges[:, 1, 1] - edges[:, 0, 1] * edges[:, 1, 0])
        ok = area >= 1e-20
        t, edges, area = t[ok], edges[ok], area[ok]
        mass = np.bincount(t.ravel(), weights=np.repeat(area / 3, 3), minlength=len(self.nodes))
        local = np.einsum("tid,tjd->tij", edges, edges) / (4 * area)[:, None, None]
        return mass, np.repeat(t, 3, axis=1).ravel(), np.tile(t, (1, 3)).ravel(), local.ravel()

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """Lumped mass (a vector) and dense stiffness."""
        if len(self.nodes) > DENSE_NODES:
            raise ValueError(f"a dense stiffness matrix serves up to {DENSE_NODES} nodes; use fem_entries")
        mass, i, j, v = self._elements()
        stiff = np.zeros((len(self.nodes),) * 2)
        np.add.at(stiff, (i, j), v)
        return mass, stiff

    def sparse(self) -> tuple[np.ndarray, Csr]:
        """Lumped mass and sparse stiffness."""
        mass, i, j, v = self._elements()
        return mass, Csr.of(i, j, v, len(self.nodes))


def fem_entries(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Entries (i, j, mass, stiffness) of any mesh: nine for each triangle, summed; mass is lumped onto the diagonal."""
    t = triangles
    for corner in "abc":
        t = t.join(nodes.select(F.col("id").alias(corner), F.struct("x", "y").alias(f"p{corner}")), corner)
    p = {c: (F.col(f"p{c}.x"), F.col(f"p{c}.y")) for c in "abc"}
    opposite = {"a": ("b", "c"), "b": ("c", "a"), "c": ("a", "b")}
    edge = {k: (p[v][0] - p[u][0], p[v][1] - p[u][1]) for k, (u, v) in opposite.items()}
    area = 0.5 * F.abs(edge["a"][0] * edge["b"][1] - edge["a"][1] * edge["b"][0])
    t = t.withColumn("area", area).where("area >= 1e-20")
    entries = [F.struct(F.col(u).alias("i"), F.col(v).alias("j"), (F.col("area") / 3 if u == v else F.lit(0.0)).alias("mass"), ((edge[u][0] * edge[v][0] + edge[u][1] * edge[v][1]) / (4 * F.col("area"))).alias("stiffness")) for u in "abc" for v in "abc"]
    return t.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.mass").alias("mass"), F.sum("e.stiffness").alias("stiffness"))


def matern_params(sigma2: float, length: float, nu: float = 1.0, d: int = 2) -> tuple[float, float]:
    """kappa and tau^2 of a field with this variance, range and smoothness."""
    kappa = math.sqrt(8 * nu) / length
    return kappa, math.gamma(nu) / (math.gamma(nu + d / 2) * (4 * math.pi) ** (d / 2) * kappa ** (2 * nu) * sigma2)


def matern_precision(mesh: Mesh, kappa: float, tau2: float, alpha: int = 2) -> np.ndarray:
    mass, stiff = mesh.matrices()
    if alpha == 1:
        return tau2 * (kappa**2 * np.diag(mass) + stiff)
    if alpha == 2:
        return tau2 * (kappa**4 * np.diag(mass) + 2 * kappa**2 * stiff + (stiff / np.maximum(mass, 1e-300)) @ stiff)
    raise ValueError("alpha is 1 or 2")


def sparse_precision(mesh: Mesh, kappa: float, tau2: float, alpha: int = 2) -> Csr:
    """``matern_precision`` of a mesh of any size."""
    mass, stiff = mesh.sparse()
    if alpha == 1:
        return stiff.shifted(kappa**2 * mass, tau2)
    if alpha != 2:
        raise ValueError("alpha is 1 or 2")
    scaled = Csr(stiff.at, stiff.columns, stiff.data / np.maximum(mass, 1e-300)[stiff.columns])
    return scaled.times(stiff).plus(stiff, 2 * kappa**2).shifted(kappa**4 * mass, tau2)


def precision_entries(fem: DataFrame, kappa: float, tau2: float, alpha: int = 2) -> DataFrame:
    """The same on entry tables: (i, j, v)."""
    base = fem.select("i", "j", (kappa ** (2 * alpha) * F.col("mass") + (kappa**2 * 2 if alpha == 2 else 1.0) * F.col("stiffness")).alias("v"))
    if alpha == 1:
        return base.select("i", "j", (tau2 * F.col("v")).alias("v"))
    if alpha != 2:
        raise ValueError("alpha is 1 or 2")
    mass = fem.where("i = j").select(F.col("i").alias("k"), F.col("mass").alias("m"))
    left, right = fem.select("i", F.col("j").alias("k"), F.col("stiffness").alias("__a")), fem.select(F.col("i").alias("k"), "j", F.col("stiffness").alias("__b"))
    square = left.join(mass, "k").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b") / F.col("m")).alias("v"))
    return base.union(square).groupBy("i", "j").agg((tau2 * F.sum("v")).alias("v"))


def snap_to(mesh: Mesh, coords) -> np.ndarray:
    """Nearest node of each point, the first on ties."""
    coords = np.atleast_2d(np.asarray(coords, float))
    return np.array([int(((mesh.nodes - c) ** 2).sum(axis=1).argmin()) for c in coords])


def spde_kriging(mesh: Mesh, coords, values, est, sigma2: float, length: float, nu: float = 1.0, alpha: int = 2, nugget: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at ``est`` points, by their nearest nodes."""
    q = matern_precision(mesh, *matern_params(sigma2, length, nu), alpha)
    return precision_kriging(q, snap_to(mesh, coords), values, snap_to(mesh, est), nugget)


def spde_kriging_at(mesh: Mesh, coords, values, est: DataFrame, sigma2: float, length: float, nu: float = 1.0, alpha: int = 2, nugget: float = 1e-4) -> DataFrame:
    """``spde_kriging`` at the points of a table (est_id, coords), which stay in it: (est_id, mean, variance). The mesh may have any number of nodes."""
    ids = np.arange(len(mesh.nodes))
    shared = est.sparkSession.sparkContext.broadcast(mesh.nodes)

    def snap(batches):
        for batch in batches:
            at = np.array(batch["coords"].tolist(), float).reshape(len(batch), 2)
            yield pd.DataFrame({"est_id": batch["est_id"], "node": nearest(at, shared.value, np.arange(len(shared.value)), 1)[1]})

    q = sparse_precision(mesh, *matern_params(sigma2, length, nu), alpha)
    at = est.select("est_id", "coords").where("coords IS NOT NULL").mapInPandas(snap, "est_id long, node long")
    own = nearest(np.asarray(coords, float), mesh.nodes, ids, 1)[1]
    return precision_kriging_at(est.sparkSession, q, own, values, at, nugget)
