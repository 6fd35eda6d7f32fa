"""An exact index of points: a balanced tree of boxes over blocks of one size, searched for many points at once in NumPy."""

from __future__ import annotations

import math

import numpy as np

#: Points whose search starts together, and (point, box) pairs that are held at once.
BATCH, PAIRS = 4096, 400_000


def few_of_a_place(at: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows of finite places, by place and id, with the ``most`` smallest ids of each place: the others are never among as many nearest."""
    rows = np.flatnonzero(np.isfinite(at).all(axis=1))
    rows = rows[np.lexsort((ids[rows], *at[rows].T))]
    if len(rows) <= most:
        return rows
    starts = np.flatnonzero(np.concatenate([[True], (at[rows[1:]] != at[rows[:-1]]).any(axis=1)]))
    since = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[since < most]


class Boxes:
    """Boxes of a balanced tree by level, each level's in a row: ``low`` and ``high`` (boxes, d) have NaN for empty ones.

    With ``ratio`` the last column is a time: places are ranked by distance + ratio * gap instead of by distance.
    """

    def __init__(self, low: list[np.ndarray], high: list[np.ndarray], ratio: float | None = None) -> None:
        self.low, self.high, self.ratio, self.depth = low, high, ratio, len(low) - 1

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray, ratio: float | None = None) -> Boxes:
        """All levels over the last one's boxes, a power of two of them."""
        lows, highs = [low], [high]
        while len(lows[0]) > 1:
            lows.insert(0, np.fmin(lows[0][::2], lows[0][1::2]))
            highs.insert(0, np.fmax(highs[0][::2], highs[0][1::2]))
        return cls(lows, highs, ratio)

    def _reach(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance, time gap and what is ranked by, from absolute differences of each column."""
        dims = len(parts) - (self.ratio is not None)
        d = np.zeros(parts[0].shape)
        for p in parts[:dims]:
            d += p * p
        np.sqrt(d, out=d)
        if self.ratio is None:
            return d, d, d
        return d, parts[-1], d + self.ratio * parts[-1]

    def _to_boxes(self, at: np.ndarray, level: int, box: np.ndarray, far: bool = False):
        low, high = self.low[level][box], self.high[level][box]
        gap = np.maximum(np.abs(at - low), np.abs(high - at)) if far else np.maximum(np.maximum(low - at, at - high), 0.0)
        return self._reach([gap[:, j] for j in range(at.shape[1])])

    def touched(self, at: np.ndarray, bound: np.ndarray, dmax: float = math.inf, tmax: float = math.inf) -> tuple[np.ndarray, np.ndarray] | None:
        """(point, box of the last level) of boxes within each point's bound; None where they are too many to hold for so many points."""
        slack = bound * (1 + 1e-12)
        point, box = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
        for level in range(self.depth + 1):
            if level:
                point, box = np.repeat(point, 2), np.stack([2 * box, 2 * box + 1], axis=1).ravel()
            d, gap, reach = self._to_boxes(at[point], level, box)
            with np.errstate(invalid="ignore"):
                keep = (reach <= slack[point]) & (d <= dmax * (1 + 1e-12))
                if self.ratio is not None:
                    keep &= gap <= tmax
            point, box = point[keep], box[keep]
            if len(point) > PAIRS and len(at) > 1:
                return None
        return point, box


class Tree(Boxes):
    """Places (n, d) with distinct ids, of which up to ``most`` nearest are asked for."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, most: int, ratio: float | None = None) -> None:
        at = np.asarray(at, float)
        rows = few_of_a_place(at, ids, most)
        n, d = len(rows), at.shape[1]
        self.n, leaf = n, min(max(24, most), 128)
        depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
        width = -(-n // 2**depth) or 1
        # The last block is filled up with places that are near nothing.
        points, places = np.full((1, width << depth, d), np.nan), np.full((1, width << depth), -1)
        points[0, :n], places[0, :n] = at[rows], rows
        scale = np.ones(d)
        if ratio is not None:
            scale[-1] = ratio
        lows, highs = [], []
        for level in range(depth + 1):
            low, high = np.fmin.reduce(points, axis=1), np.fmax.reduce(points, axis=1)
            lows.append(low)
            highs.append(high)
            if level < depth:
                wide = np.nan_to_num((high - low) * scale).argmax(axis=1)
                key = np.take_along_axis(points, wide[:, None, None], axis=2)[..., 0]
                half = key.shape[1] // 2
                order = np.argpartition(key, half, axis=1)
                points = np.take_along_axis(points, order[..., None], axis=1).reshape(-1, half, d)
                places = np.take_along_axis(places, order, axis=1).reshape(-1, half)
        super().__init__(lows, highs, ratio)
        self.points, self.places, self.ids = points, places, np.asarray(ids)

    def _in_blocks(self, at: np.ndarray, block: np.ndarray):
        own = self.points[block]
        return self._reach([np.abs(at[:, None, j] - own[..., j]) for j in range(at.shape[1])])

    def nearest(self, at: np.ndarray, k: int, dmax: float = math.inf, tmax: float = math.inf, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Point, datum (as places in ``at`` and the tree's input), distance and rank from 1 of each point's k nearest; ties go to the smaller id, bounds are inclusive. ``skip`` has an id for each point that is left out."""
        at = np.asarray(at, float)
        found: list[tuple[np.ndarray, ...]] = []
        rows = np.flatnonzero(np.isfinite(at).all(axis=1)) if self.n and k > 0 and len(at) else np.zeros(0, dtype=np.int64)
        if len(rows):
            # Points that lie together are searched together.
            leaf = self._descend(at[rows])
            order = np.argsort(leaf, kind="stable")
            rows, leaf = rows[order], leaf[order]
        for i in range(0, len(rows), BATCH):
            some = rows[i : i + BATCH]
            ids = None if skip is None else skip[some]
            found += [(some[r], *rest) for r, *rest in self._search(at[some], leaf[i : i + BATCH], k, dmax, tmax, ids)]
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0), none
        r, c, d, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, r))
        return r[order], c[order], d[order], rank[order]

    def _descend(self, at: np.ndarray) -> np.ndarray:
        box = np.zeros(len(at), dtype=np.int64)
        for level in range(1, self.depth + 1):
            left, right = (np.nan_to_num(self._to_boxes(at, level, 2 * box + i)[2], nan=np.inf) for i in (0, 1))
            box = 2 * box + (right < left)
        return box

    def _search(self, at, leaf, k, dmax, tmax, skip) -> list[tuple[np.ndarray, ...]]:
        d, gap, reach = self._in_blocks(at, leaf)
        with np.errstate(invalid="ignore"):
            reach = np.where((d <= dmax) & ((gap <= tmax) | (self.ratio is None)), reach, np.inf)
        if skip is not None:
            reach[self.ids[self.places[leaf]] == skip[:, None]] = np.inf
        # As many lie within the k-th of the own block; where it has fewer, within a growing radius or nowhere.
        bound = np.partition(reach, k - 1, axis=1)[:, k - 1] if k <= reach.shape[1] else np.full(len(at), np.inf)
        root = np.zeros(len(at), dtype=np.int64)
        whole = self._to_boxes(at, 0, root, far=True)[2] * (1 + 1e-9)
        near, size = self._to_boxes(at, self.depth, leaf)[2], self._to_boxes(at, self.depth, leaf, far=True)[2]
        known = np.isfinite(bound)
        grown = np.minimum(np.nan_to_num(np.maximum(2 * size - near, 1e-9 * whole), nan=np.inf), whole)
        bound, out, left = np.where(known, bound, grown), [], np.arange(len(at))
        while len(left):
            parts = [left]
            unsure: list[np.ndarray] = []
            while parts:
                some = parts.pop()
                got = self._within(at[some], bound[some], dmax, tmax, None if skip is None else skip[some])
                if got is None:
                    parts += [some[: len(some) // 2], some[len(some) // 2 :]]
                    continue
                r, c, d, reach = got
                full = (np.bincount(r, minlength=len(some)) >= k) | (bound[some] >= whole[some])
                if self.ratio is None:
                    full |= bound[some] >= dmax
                unsure.append(some[~full])
                order = np.lexsort((self.ids[c], reach, r))
                r, c, d = r[order], c[order], d[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
                keep = (rank <= k) & full[r]
                out.append((some[r[keep]], c[keep], d[keep], rank[keep]))
            left = np.concatenate(unsure)
            bound[left] = np.minimum(2 * bound[left], whole[left])
        return out

    def _within(self, at, bound, dmax, tmax, skip):
        """All (point, datum, distance, reach) up to each point's bound; None where they are too many to hold for so many points."""
        got = self.touched(at, bound, dmax, tmax)
        if got is None:
            return None
        point, box = got
        found, total = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))], 0
        step = max(1, 2_000_000 // self.points.shape[1])
        for i in range(0, len(point), step):
            p, b = point[i : i + step], box[i : i + step]
            d, gap, reach = self._in_blocks(at[p], b)
            with np.errstate(invalid="ignore"):
                keep = (reach <= bound[p][:, None]) & (d <= dmax)
                if self.ratio is not None:
                    keep &= gap <= tmax
            if skip is not None:
                keep &= self.ids[self.places[b]] != skip[p][:, None]
            r, c = np.nonzero(keep)
            found.append((p[r], self.places[b[r], c], d[r, c], reach[r, c]))
            total += len(r)
            if total > 4_000_000 and len(at) > 1:
                return None
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


