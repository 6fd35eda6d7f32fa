"""Neighbour joins: nearest k in space and space-time, largest covariances on networks, nearest in time.

Spatial neighbours are found in one of four ways, which give the same rows (ties go to the smaller obs_id):

* *blocks*: observations, collected if their size is under a checked bound, go to every task as one tree.
* *rounds*: observations beyond that are dealt into tiles of the space, each one task's tree. A first round searches the tile that
  a point lies in; a second one the other tiles within the distance of its k-th neighbour so far.
* *cells*: with a finite ``dmax``, an equi-join on squares of that size and their neighbours.
* *slices*: beyond four dimensions, where boxes leave little out, blocks of a bounded size one after the other; the best k of
  each are ranked again.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.geometry import distance, within, within_st
from plumbline.operators.network import checkpointed
from plumbline.operators.tree import Boxes, Tree

#: Values (coordinates and ids) that may be collected and sent to every task.
BROADCAST_VALUES = 4_000_000
#: Coordinates up to which squares have few enough neighbours.
MOST_DIMS = 4


def knn(est: DataFrame, obs: DataFrame, k: int, dmax: float = math.inf, strategy: str = "auto", exclude_same: bool = False) -> DataFrame:
    """(est_id, obs_id, distance, rank) of the nearest k observations within dmax, the bound included.

    ``est`` has (est_id, coords) and ``obs`` (obs_id, coords). ``exclude_same`` leaves out the observation with the point's
    own id (leave-one-out). Null coordinates have no neighbours.
    """
    est = est.select(F.col("est_id").cast("long").alias("est_id"), "coords").where("coords IS NOT NULL")
    obs = obs.select(F.col("obs_id").cast("long").alias("obs_id"), "coords").where("coords IS NOT NULL")
    if strategy == "auto":
        strategy = "blocks" if _small(obs) else "rounds" if _dims(obs) <= MOST_DIMS else "slices"
    if strategy == "blocks":
        return _knn_blocks(est, obs, k, dmax, exclude_same)
    if strategy == "cells":
        return _top(_cell_pairs(est, obs, dmax, exclude_same).where(F.col("distance") <= dmax), k)
    if strategy == "rounds":
        return _knn_tiles(est, obs, k, dmax, exclude_same=exclude_same).drop("gap")
    if strategy == "slices":
        return _knn_slices(est, obs, k, dmax, exclude_same)
    raise ValueError(f"unknown strategy {strategy!r}")


def within_distance(est: DataFrame, obs: DataFrame, dmax: float) -> DataFrame:
    """(est_id, obs_id, distance) of all pairs within dmax, by squares of that size."""
    est, obs = est.select("est_id", "coords").where("coords IS NOT NULL"), obs.select("obs_id", "coords").where("coords IS NOT NULL")
    return _cell_pairs(est, obs, dmax, False).where(within(F.col("distance"), dmax))


def _values(obs: DataFrame) -> int:
    n, width = obs.agg(F.count(F.lit(1)), F.max(F.size("coords"))).first()
    return n * ((width or 0) + 1)


def _small(obs: DataFrame) -> bool:
    return _values(obs) <= BROADCAST_VALUES


def _knn_slices(est: DataFrame, obs: DataFrame, k: int, dmax: float, exclude_same: bool) -> DataFrame:
    n = -(-_values(obs) * 11 // (10 * BROADCAST_VALUES)) or 1
    # Each slice's best k are written, so that only one slice is in memory at a time.
    parts = [checkpointed(_knn_blocks(est, obs.where(F.pmod(F.xxhash64("obs_id"), F.lit(n)) == i), k, dmax, exclude_same)) for i in range(n)]
    return _top(reduce(DataFrame.unionAll, parts).drop("rank"), k)


def _top(pairs: DataFrame, k: int, by: str = "distance") -> DataFrame:
    w = Window.partitionBy("est_id").orderBy(by, "obs_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _of_many(at: np.ndarray, own: np.ndarray, own_ids: np.ndarray, k: int, dmax: float, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` by all distances: matrix products leave few pairs, whose distances are then worked out by columns."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))]
    step, squares = max(1, 4_000_000 // max(1, len(own))), (own * own).sum(axis=1)
    # What a product's rounding may come to.
    slack = 4 * own.shape[1] * np.finfo(float).eps * np.nanmax(squares, initial=0.0)
    for i in range(0, len(at) if len(own) and k > 0 else 0, step):
        a = at[i : i + step]
        base = (a * a).sum(axis=1)
        d = a @ own.T
        d *= -2
        d += squares
        d += base[:, None]
        if skip is not None:
            d[skip[i : i + step, None] == own_ids[None]] = np.inf
        # All at the distance of the k-th are looked at, so that ties go by id whatever partition leaves in front.
        bound = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + 2 * (slack + 4 * own.shape[1] * np.finfo(float).eps * base)
        r, c = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        exact = np.zeros(len(r))
        for j in range(own.shape[1]):
            gap = a[r, j] - own[c, j]
            exact += gap * gap
        exact = np.sqrt(exact)
        order = np.lexsort((own_ids[c], exact, r))
        order = order[exact[order] <= dmax]
        r, c, exact = r[order], c[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        keep = rank <= k
        found.append((i + r[keep], c[keep], exact[keep], rank[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(at: np.ndarray, own: np.ndarray, own_ids: np.ndarray, k: int, dmax: float = math.inf, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Point, observation (as places in ``at`` and ``own``), distance and rank (from 1) of each point's nearest k; ties by ``own_ids``. ``skip`` has an id for each point that is left out."""
    if own.shape[1] > MOST_DIMS:
        return _of_many(at, own, own_ids, k, dmax, skip)
    return Tree(own, own_ids, k + (skip is not None)).nearest(at, k, dmax, skip=skip)


def places(column, dims: int) -> np.ndarray:
    """Coordinates as rows; NaN, which is near nothing, for a null and for another number of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    if (sizes == dims).all() and not column.null_count:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return np.array([x if x is not None and len(x) == dims else [math.nan] * dims for x in column.to_pylist()], float).reshape(-1, dims)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in as many even parts as a shuffle has, whatever parts their files have. A number of its own keeps them from being merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _ids(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def _at(batch, dims: int, timed: bool) -> np.ndarray:
    """Coordinates, and the time after them."""
    at = places(batch.column("coords"), dims)
    return np.column_stack([at, _ids(batch, "t").astype(float)]) if timed else at


def _knn_blocks(est: DataFrame, obs: DataFrame, k: int, dmax: float, exclude_same: bool, tmax: float = math.inf, ratio: float | None = None) -> DataFrame:
    """With ``ratio``, both sides have a time ``t``, and rows a ``gap``."""
    dims, timed = _dims(obs), ratio is not None
    rows = obs.toArrow()
    own_ids, own = _ids(rows, "obs_id"), _at(rows, dims, timed)
    tree = Tree(own, own_ids, k + exclude_same, ratio) if timed or dims <= MOST_DIMS else None
    shared = est.sparkSession.sparkContext.broadcast((own_ids, own, tree))

    def search(batches):
        own_ids, own, tree = shared.value
        for batch in batches:
            names, at = _ids(batch, "est_id"), _at(batch, dims, timed)
            skip = names if exclude_same else None
            r, c, d, rank = tree.nearest(at, k, dmax, tmax, skip) if tree else _of_many(at, own, own_ids, k, dmax, skip)
            gap = [np.abs(at[r, -1] - own[c, -1])] if timed else []
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[r], own_ids[c], d, *gap, rank.astype(np.int32))], ["est_id", "obs_id", "distance", *["gap"] * timed, "rank"])

    return dealt(est, "est_id").mapInArrow(search, f"est_id long, obs_id long, distance double, {'gap double, ' * timed}rank int")


#: Observations of a tile, and points that one task searches in it, about; rows of the sample that tiles are cut by, a tile.
TILE, TILE_POINTS, TILE_SAMPLE = 50_000, 50_000, 256


def _cuts(obs: DataFrame, dims: int, timed: bool, ratio: float | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns and values that halve the space level by level, from a sample's medians. They say where rows go, and nothing else."""
    n = obs.count()
    depth = max(0, math.ceil(math.log2(max(1, n / TILE))))
    every = max(1, n // (TILE_SAMPLE << depth))
    at = _at(obs.where(F.pmod(F.xxhash64("obs_id"), F.lit(every)) == 0).toArrow(), dims, timed)
    parts, columns, values = [at[np.isfinite(at).all(axis=1)]], [], []
    scale = np.ones(dims + timed)
    if timed:
        scale[-1] = ratio
    for _ in range(depth):
        wide = [int((np.ptp(p, axis=0) * scale).argmax()) if len(p) else 0 for p in parts]
        cut = [float(np.median(p[:, j])) if len(p) else 0.0 for p, j in zip(parts, wide, strict=True)]
        parts = [q for p, j, v in zip(parts, wide, cut, strict=True) for q in (p[p[:, j] < v], p[p[:, j] >= v])]
        columns.append(np.array(wide))
        values.append(np.array(cut))
    return columns, values


def _knn_tiles(est: DataFrame, obs: DataFrame, k: int, dmax: float = math.inf, tmax: float = math.inf, ratio: float | None = None, exclude_same: bool = False) -> DataFrame:
    """(est_id, obs_id, distance, gap, rank), the gap null without ``ratio``; with it, both sides have a time ``t``."""
    spark, dims, timed = est.sparkSession, _dims(obs), ratio is not None
    columns, values = _cuts(obs, dims, timed, ratio)
    n_tiles, width = 1 << len(columns), dims + timed
    extra = ["t"] if timed else []
    kinds = "coords array<double>" + ", t double" * timed

    def tile_of(at: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(at), dtype=np.int64)
        for column, value in zip(columns, values, strict=True):
            tile = 2 * tile + (at[np.arange(len(at)), column[tile]] >= value[tile])
        return tile

    def out(batch, key: str, rows: np.ndarray, tile: np.ndarray):
        some = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(tile), some.column(key), *(some.column(c).cast(t) for c, t in [("coords", pa.list_(pa.float64())), ("t", pa.float64())] if c in some.schema.names)], ["tile", key, "coords", *extra])

    def placed(key: str):
        def run(batches):
            for batch in batches:
                at = _at(batch, dims, timed)
                rows = np.flatnonzero(np.isfinite(at).all(axis=1))
                yield out(batch, key, rows, tile_of(at[rows]))

        return run

    own = obs.select("obs_id", "coords", *extra).mapInArrow(placed("obs_id"), f"tile long, obs_id long, {kinds}")
    points = est.select("est_id", "coords", *extra).mapInArrow(placed("est_id"), f"tile long, est_id long, {kinds}")
    ends = own.groupBy("tile").agg(*(f(F.get("coords", F.lit(i))) for f in (F.min, F.max) for i in range(dims)), *((F.min("t"), F.max("t")) if timed else ())).collect()
    low, high = np.full((n_tiles, width), np.nan), np.full((n_tiles, width), np.nan)
    for row in ends:
        low[row[0], :dims], high[row[0], :dims] = row[1 : 1 + dims], row[1 + dims : 1 + 2 * dims]
        if timed:
            low[row[0], -1], high[row[0], -1] = row[1 + 2 * dims :]
    boxes = Boxes.over(low, high, ratio)

    def others(at: np.ndarray, tile: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """The other tiles within each point's bound."""
        parts, found = [np.arange(len(at))], []
        while parts:
            some = parts.pop()
            got = boxes.touched(at[some], bound[some], dmax, tmax)
            if got is None:
                parts += [some[: len(some) // 2], some[len(some) // 2 :]]
            else:
                found.append((some[got[0]], got[1]))
        point, box = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = box != tile[point]
        order = np.argsort(point[keep], kind="stable")
        return np.split(box[keep][order], np.searchsorted(point[keep][order], np.arange(1, len(at)))) if len(at) else []

    listed = "est_id long, " + kinds + ", tile long, obs array<long>, distances array<double>, gaps array<double>, reach double, more array<long>"

    def search(first: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            at, names, tile = _at(left, dims, timed), _ids(left, "est_id"), _ids(left, "tile")
            tree = Tree(_at(right, dims, timed), _ids(right, "obs_id"), k + exclude_same, ratio)
            r, c, d, _ = tree.nearest(at, k, dmax, tmax, names if exclude_same else None)
            gap = np.abs(at[r, -1] - _at(right, dims, timed)[c, -1]) if timed else np.zeros(len(d))
            offsets = np.searchsorted(r, np.arange(len(at) + 1))
            found, last = np.diff(offsets), np.full(len(at), np.inf)
            full = found >= k
            last[full] = (d + (ratio or 0.0) * gap)[offsets[1:][full] - 1]
            more = others(at, tile, last) if first else [[]] * len(at)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (tree.ids[c], d, gap)]
            coords = left.column("coords").combine_chunks()
            return pa.Table.from_arrays([pa.array(names), coords, *(left.column(x) for x in extra), pa.array(tile), *lists, pa.array(last), pa.array([list(m) for m in more], pa.list_(pa.int64()))], ["est_id", "coords", *extra, "tile", "obs", "distances", "gaps", "reach", "more"])

        return run

    def met(points: DataFrame, first: bool) -> DataFrame:
        """Points and their tiles' observations, in a task a tile, or several where many points are in one."""
        counts = np.zeros(n_tiles, dtype=np.int64)
        for tile, n in points.groupBy("tile").count().collect():
            counts[tile] = n
        parts = -(-counts // TILE_POINTS)

        def spread(batches):
            for batch in batches:
                tile = _ids(batch, "tile")
                times = parts[tile]
                starts = np.repeat(np.cumsum(times) - times, times)
                rows = np.repeat(np.arange(len(tile)), times)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(np.arange(len(rows)) - starts)], [*batch.schema.names, "part"])

        def one(batches):
            for batch in batches:
                part = _ids(batch, "est_id") % np.maximum(parts[_ids(batch, "tile")], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

        a = points.mapInArrow(one, f"tile long, est_id long, {kinds}, part long")
        b = own.mapInArrow(spread, f"tile long, obs_id long, {kinds}, part long")
        return dealt(a, "tile", "part").groupBy("tile", "part").cogroup(dealt(b, "tile", "part").groupBy("tile", "part")).applyInArrow(search(first), listed)

    def rows(lists: DataFrame) -> DataFrame:
        each = lists.select("est_id", F.posexplode(F.arrays_zip("obs", "distances", "gaps")).alias("rank", "x"))
        return each.select("est_id", F.col("x.obs").alias("obs_id"), F.col("x.distances").alias("distance"), F.col("x.gaps").alias("gap"), (F.col("rank") + 1).alias("rank"))

    first = checkpointed(met(points, True))
    open_ones = first.where(F.size("more") > 0)
    more = open_ones.select(F.explode("more").alias("tile"), "est_id", "coords", *extra)
    both = rows(open_ones).unionByName(rows(met(more, False))).withColumn("__reach", F.col("distance") + (ratio or 0.0) * F.col("gap"))
    return rows(first.where(F.size("more") == 0)).unionByName(_top(both, k, "__reach").drop("__reach"))


def _cells(coords, size: float):
    return F.transform(coords, lambda x: F.floor(x / size))


def _around(n_dims: int) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for _ in range(n_dims):
        out = [o + [i] for o in out for i in (-1, 0, 1)]
    return out


def _dims(points: DataFrame) -> int:
    row = points.select(F.size("coords")).first()
    return row[0] if row else 1


def _cell_pairs(est: DataFrame, obs: DataFrame, size: float, exclude_same: bool) -> DataFrame:
    dims = _dims(obs)
    if dims > MOST_DIMS:
        raise ValueError(f"cells serve up to {MOST_DIMS} dimensions; use blocks or slices for more")
    near = F.array(*(F.array(*(F.lit(i) for i in shift)) for shift in _around(dims)))
    e = est.select("est_id", F.col("coords").alias("__e"), F.explode(F.transform(near, lambda s: F.zip_with(_cells(F.col("coords"), size), s, lambda a, b: a + b))).alias("__cell"))
    o = obs.select("obs_id", F.col("coords").alias("__o"), _cells(F.col("coords"), size).alias("__cell"))
    pairs = e.join(o, "__cell")
    if exclude_same:
        pairs = pairs.where("est_id <> obs_id")
    return pairs.select("est_id", "obs_id", distance(F.col("__e"), F.col("__o")).alias("distance"))


def knn_st(est: DataFrame, obs: DataFrame, k: int, dmax: float = math.inf, tmax: float = math.inf, ratio: float = 1.0, exact: bool = False) -> DataFrame:
    """Nearest k by distance + ratio * time gap; both with (.., coords, t).

    ``exact`` ranks all. The default takes the max(4k, 50) nearest in space first, as an index over space does.
    """
    if exact:
        e, o = (df.select(F.col(key).cast("long").alias(key), "coords", F.col("t").cast("double").alias("t")).where("coords IS NOT NULL") for df, key in ((est, "est_id"), (obs, "obs_id")))
        found = _knn_blocks(e, o, k, dmax, False, tmax, ratio) if _small(o) else _knn_tiles(e, o, k, dmax, tmax, ratio)
        return found.select("est_id", "obs_id", "distance", "gap", "rank")
    times = est.select("est_id", F.col("t").alias("__te")), obs.select("obs_id", F.col("t").alias("__to"))
    e, o = est.select("est_id", "coords").where("coords IS NOT NULL"), obs.select("obs_id", "coords").where("coords IS NOT NULL")
    near = knn(e, o, max(4 * k, 50), dmax).drop("rank")
    both = near.join(times[0], "est_id").join(times[1], "obs_id").withColumn("gap", F.abs(F.col("__te") - F.col("__to"))).where(within_st(F.col("distance"), F.col("gap"), dmax, tmax))
    return _top(both.withColumn("reach", F.col("distance") + ratio * F.col("gap")).drop("__te", "__to"), k, "reach").select("est_id", "obs_id", "distance", "gap", "rank")


def top_covariances(pairs: DataFrame, k: int) -> DataFrame:
    """The k largest covariances in size of (est_id, obs_id, c) for each point; ties by id."""
    w = Window.partitionBy("est_id").orderBy(F.abs("c").desc(), "obs_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def snap(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each point's nearest node: (est_id, obs_id, distance)."""
    return knn(points, nodes, 1).drop("rank")


def nearest_in_time(targets: DataFrame, series: DataFrame, tolerance: float, by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Each target's nearest value in time within the tolerance (seconds), the earlier on ties; null without.

    ``targets`` has (target_id, ts[, by]) and ``series`` (ts, value[, by]). Both meet in time bins as wide as the tolerance.
    """
    by = by or []
    t = targets.select("target_id", *by, F.col("ts").cast("double").alias("__t")).withColumn("__bin", F.explode(F.array(*(F.floor(F.col("__t") / tolerance) + i for i in (-1, 0, 1)))))
    s = series.select(*by, F.col("ts").cast("double").alias("__s"), "value").withColumn("__bin", F.floor(F.col("__s") / tolerance))
    gap = F.abs(F.col("__t") - F.col("__s"))
    near = t.join(s, [*by, "__bin"]).where(gap <= tolerance if inclusive else gap < tolerance)
    best = near.groupBy("target_id").agg(F.min_by("value", F.struct(gap, "__s")).alias("value"), F.min(gap).alias("gap"))
    return targets.join(best, "target_id", "left")
