"""Covariance models: each a column expression for joins and a NumPy function for kernels, from one formula.

A formula is written once against a small set of functions (exp, cos, min, where), of which there is a set for columns and
one for arrays. Models are added with ``register``; a model may be a list of names, whose covariances add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import bessel_k


class _Columns:
    exp, cos, sqrt = staticmethod(F.exp), staticmethod(F.cos), staticmethod(F.sqrt)

    @staticmethod
    def least(x, bound):
        return F.least(x, F.lit(float(bound)))

    @staticmethod
    def where(test, yes, no):
        return F.when(test, yes).otherwise(no)


class _Arrays:
    exp, cos, sqrt, least, where = staticmethod(np.exp), staticmethod(np.cos), staticmethod(np.sqrt), staticmethod(np.minimum), staticmethod(np.where)


@dataclass(frozen=True)
class Model:
    """``formula(m, lag, params)`` for m in columns and arrays; ``arrays`` replaces it where only NumPy can do."""

    name: str
    n_params: int
    formula: Callable
    arrays: Callable | None = None

    def column(self, lag: Column, params: Sequence[float]) -> Column:
        return self.formula(_Columns, lag, params)

    def array(self, lag, params: Sequence[float]) -> np.ndarray:
        lag = np.asarray(lag, float)
        return self.arrays(lag, params) if self.arrays else self.formula(_Arrays, lag, params)


SPATIAL: dict[str, Model] = {}
SPACE_TIME: dict[str, Model] = {}


def register(model: Model, into: dict[str, Model] = SPATIAL) -> Model:
    into[model.name] = model
    return model


def _spherical(m, h, p):
    t = m.least(h / p[1], 1.0)
    return p[0] * (1 - 1.5 * t + 0.5 * t * t * t)


def _matern(m, h, p):
    """Closed forms for smoothness 1/2, 3/2 and 5/2."""
    sill, length, nu = p
    if nu not in (0.5, 1.5, 2.5):
        raise ValueError("a column expression needs smoothness 0.5, 1.5 or 2.5; others go through NumPy")
    u = math.sqrt(2 * nu) / length * h
    poly = {0.5: 1.0, 1.5: 1 + u, 2.5: 1 + u + u * u / 3}[nu]
    return sill * poly * m.exp(-u)


def _matern_arrays(h, p):
    sill, length, nu = p
    if nu in (0.5, 1.5, 2.5):
        return _matern(_Arrays, h, p)
    u = math.sqrt(2 * nu) * h / length
    near = h <= 1e-15
    v = np.where(near, 1.0, u)
    return np.where(near, sill, sill * 2 ** (1 - nu) / math.gamma(nu) * v**nu * bessel_k(nu, v))


register(Model("exponential", 2, lambda m, h, p: p[0] * m.exp(-3.0 * h / p[1])))
register(Model("gaussian", 2, lambda m, h, p: p[0] * m.exp(-3.0 * (h / p[1]) * (h / p[1]))))
register(Model("spherical", 2, _spherical))
register(Model("matern", 3, _matern, _matern_arrays))
register(Model("nugget", 1, lambda m, h, p: m.where(h < 1e-10, m.least(h * 0 + float(p[0]), np.inf), h * 0)))
register(Model("hole_cos", 2, lambda m, h, p: p[0] * m.cos(math.pi * h / p[1])))

# Space-time models of both lags: params are (sill, range, time scale).
register(Model("gaussian_st", 3, lambda m, h, p: p[0] * m.exp(-3.0 * ((h[0] + p[2] * h[1]) / p[1]) * ((h[0] + p[2] * h[1]) / p[1]))), SPACE_TIME)
register(Model("exponential_st", 3, lambda m, h, p: p[0] * m.exp(-3.0 * (h[0] + p[2] * h[1]) / p[1])), SPACE_TIME)
register(Model("nugget_st", 1, lambda m, h, p: m.where((h[0] < 1e-10) & (h[1] < 1e-10), h[0] * 0 + float(p[0]), h[0] * 0)), SPACE_TIME)


@dataclass(frozen=True)
class Covariance:
    """One model or the sum of several: ``Covariance("exponential", [1, 10])``, ``Covariance(["nugget", "gaussian"], [[1], [2, 5]])``."""

    model: str | Sequence[str] = "exponential"
    params: Sequence = (1.0, 1.0)

    @property
    def terms(self) -> list[tuple[Model, Sequence[float]]]:
        names, params = ([self.model], [self.params]) if isinstance(self.model, str) else (self.model, self.params)
        if len(names) != len(params):
            raise ValueError("a list of models needs a list of params for each")
        if unknown := [n for n in names if n not in SPATIAL]:
            raise KeyError(f"unknown covariance model {unknown[0]!r}")
        return [(SPATIAL[n], [float(x) for x in p]) for n, p in zip(names, params, strict=True)]

    def column(self, lag: Column) -> Column:
        first, *rest = (m.column(lag, p) for m, p in self.terms)
        return sum(rest, first)

    def array(self, lag) -> np.ndarray:
        return sum(m.array(lag, p) for m, p in self.terms)

    def matrix(self, a, b) -> np.ndarray:
        """Between coordinates (n, d) and (m, d), or stacks of such."""
        return self.array(distances(a, b))

    @property
    def variance(self) -> float:
        return float(self.array(np.zeros(1))[0])

    def variogram(self, lag: Column) -> Column:
        return F.lit(self.variance) - self.column(lag)


@dataclass(frozen=True)
class SpaceTime:
    """Separable (spatial model, temporal model, common sill) or, without a temporal one, a model of both lags."""

    space: str | Sequence[str]
    space_params: Sequence
    time: str | None = None
    time_params: Sequence = ()
    sill: float = 1.0

    def column(self, lag: Column, gap: Column) -> Column:
        if self.time is None:
            return SPACE_TIME[self.space].formula(_Columns, (lag, gap), [float(x) for x in self.space_params])
        return F.lit(float(self.sill)) * Covariance(self.space, self.space_params).column(lag) * Covariance(self.time, self.time_params).column(gap)

    def array(self, lag, gap) -> np.ndarray:
        lag, gap = np.asarray(lag, float), np.asarray(gap, float)
        if self.time is None:
            return SPACE_TIME[self.space].formula(_Arrays, (lag, gap), [float(x) for x in self.space_params])
        return self.sill * Covariance(self.space, self.space_params).array(lag) * Covariance(self.time, self.time_params).array(gap)

    def matrix(self, a, ta, b, tb) -> np.ndarray:
        return self.array(distances(a, b), np.abs(np.asarray(ta, float)[..., :, None] - np.asarray(tb, float)[..., None, :]))


def distances(a, b) -> np.ndarray:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return np.sqrt(np.maximum(((a[..., :, None, :] - b[..., None, :, :]) ** 2).sum(axis=-1), 0.0))
