"""Soft data: densities as a struct column, with builders, moments and evaluation as expressions and as NumPy.

``kind`` is linear (density at each grid point, straight lines between) or histogram (one density a bin). ``analytic``
holds a (possibly truncated) normal's parameters where the log-density is known exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import norm_cdf

SCHEMA = "struct<kind: string, z_grid: array<double>, dens: array<double>, analytic: struct<mu: double, sigma: double, a: double, b: double, log_norm: double>>"
TINY = 1e-300


@dataclass(frozen=True)
class SoftPdf:
    """A density of unit area on ``grid``."""

    grid: np.ndarray
    dens: np.ndarray
    kind: str = "linear"
    analytic: tuple[float, float, float, float, float] | None = None

    @staticmethod
    def make(grid, dens, kind: str = "linear", analytic=None) -> SoftPdf:
        grid, dens = np.asarray(grid, float), np.asarray(dens, float)
        if kind not in ("linear", "histogram"):
            raise ValueError(f"unknown kind of density {kind!r}")
        if len(dens) != len(grid) - (kind == "histogram"):
            raise ValueError("a linear density has a value for each grid point, a histogram one for each bin")
        area = np.trapezoid(dens, grid) if kind == "linear" else float((dens * np.diff(grid)).sum())
        return SoftPdf(grid, dens / area if area > TINY else dens, kind, analytic)

    @staticmethod
    def from_row(row) -> SoftPdf:
        a = row["analytic"]
        return SoftPdf(np.asarray(row["z_grid"], float), np.asarray(row["dens"], float), row["kind"], None if a is None else tuple(a[k] for k in ("mu", "sigma", "a", "b", "log_norm")))

    def row(self) -> tuple:
        return self.kind, self.grid.tolist(), self.dens.tolist(), self.analytic and tuple(map(float, self.analytic))

    @property
    def support(self) -> tuple[float, float]:
        return float(self.grid[0]), float(self.grid[-1])

    def __call__(self, z) -> np.ndarray:
        z = np.asarray(z, float)
        if self.kind == "linear":
            return np.interp(z, self.grid, self.dens, left=0.0, right=0.0)
        bins = np.clip(np.searchsorted(self.grid, z, side="right") - 1, 0, len(self.dens) - 1)
        return np.where((z >= self.grid[0]) & (z <= self.grid[-1]), self.dens[bins], 0.0)

    def log(self, z) -> np.ndarray:
        z = np.asarray(z, float)
        if self.analytic is None:
            with np.errstate(divide="ignore"):
                return np.log(self(z))
        mu, sigma, a, b, log_norm = self.analytic
        return np.where((z >= a) & (z <= b), -0.5 * ((z - mu) / sigma) ** 2 - log_norm, -np.inf)

    def slope(self, z) -> np.ndarray:
        """First derivative of the log-density, where it is analytic."""
        return -(np.asarray(z, float) - self.analytic[0]) / self.analytic[1] ** 2

    def curvature(self, z) -> np.ndarray:
        return np.full_like(np.asarray(z, float), -1.0 / self.analytic[1] ** 2)

    def shifted(self, by: float) -> SoftPdf:
        """The density of z - by."""
        if not by:
            return self
        a = self.analytic
        moved = SoftPdf.make(self.grid - by, self.dens, self.kind)
        return replace(moved, analytic=a and (a[0] - by, a[1], a[2] - by, a[3] - by, a[4]))

    def moments(self) -> tuple[float, float]:
        """Mean and variance by 500 points over the support."""
        z = np.linspace(*self.support, 500)
        f = self(z)
        mean = np.trapezoid(z * f, z)
        return float(mean), float(max(np.trapezoid((z - mean) ** 2 * f, z), 1e-16))


def gaussian(mu: float, sigma: float, points: int = 25, width: float = 5.0) -> SoftPdf:
    z = np.linspace(mu - width * sigma, mu + width * sigma, points)
    return SoftPdf.make(z, np.exp(-0.5 * ((z - mu) / sigma) ** 2), analytic=(mu, sigma, -math.inf, math.inf, math.log(sigma * math.sqrt(2 * math.pi))))


def uniform(a: float, b: float) -> SoftPdf:
    if b <= a:
        raise ValueError("the upper bound must be over the lower one")
    eps, height = max(1e-6 * (b - a), 1e-12), 1 / (b - a)
    return SoftPdf.make([a - eps, a, b, b + eps], [0.0, height, height, 0.0])


interval = uniform


def triangular(a: float, mode: float, b: float) -> SoftPdf:
    """Five points: ends, mode, and half-way up either side."""
    top = 2 / (b - a)
    return SoftPdf.make([a, (a + mode) / 2, mode, (mode + b) / 2, b], [0.0, top / 2, top, top / 2, 0.0])


def truncnorm(mu: float, sigma: float, a: float | None = None, b: float | None = None, points: int = 25) -> SoftPdf:
    a, b = mu - 6 * sigma if a is None else a, mu + 6 * sigma if b is None else b
    z = np.linspace(a, b, points)
    mass = max(float(norm_cdf((b - mu) / sigma) - norm_cdf((a - mu) / sigma)), TINY)
    return SoftPdf.make(z, np.exp(-0.5 * ((z - mu) / sigma) ** 2), analytic=(mu, sigma, a, b, math.log(sigma * math.sqrt(2 * math.pi)) + math.log(mass)))


def lognormal(mu: float, sigma: float, points: int = 30) -> SoftPdf:
    z = np.linspace(max(1e-10, math.exp(mu - 5 * sigma)), math.exp(mu + 5 * sigma), points)
    return SoftPdf.make(z, np.exp(-0.5 * ((np.log(z) - mu) / sigma) ** 2) / z)


def histogram(edges, dens) -> SoftPdf:
    return SoftPdf.make(edges, dens, "histogram")


def linear(grid, dens) -> SoftPdf:
    return SoftPdf.make(grid, dens)


def sampled(density, low: float, high: float, points: int = 50) -> SoftPdf:
    """Of any function that takes an array; what is below 0 counts as 0."""
    z = np.linspace(low, high, points)
    return SoftPdf.make(z, np.maximum(np.asarray(density(z), float), 0.0))


def mixture(parts: list[SoftPdf], weights, points: int = 60) -> SoftPdf:
    w = np.asarray(weights, float) / np.sum(weights)
    z = np.linspace(min(p.support[0] for p in parts), max(p.support[1] for p in parts), points)
    return SoftPdf.make(z, sum(x * p(z) for x, p in zip(w, parts, strict=True)))


# --- the same as expressions -------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _struct(grid: Column, dens, analytic: Column | None = None) -> Column:
    """A linear density of unit area; ``dens`` is a function of the grid."""
    exact = F.lit(None).cast("struct<mu: double, sigma: double, a: double, b: double, log_norm: double>") if analytic is None else analytic

    def scaled(g, d, whole):
        return F.struct(F.lit("linear").alias("kind"), g.alias("z_grid"), F.transform(d, lambda x: x / whole).alias("dens"), exact.alias("analytic"))

    return let(grid, lambda g: let(dens(g), lambda d: let(area(g, d), lambda whole: scaled(g, d, whole))))


def area(grid: Column, dens: Column) -> Column:
    """Trapezoid sum of two arrays."""
    steps = F.sequence(F.lit(1), F.size(grid) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.get(grid, i) - F.get(grid, i - 1)) * (F.get(dens, i) + F.get(dens, i - 1)) / 2)


def spaced(low: Column, high: Column, points: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + (high - low) * i / (points - 1))


def gaussian_column(mu: Column, sigma: Column, points: int = 25, width: float = 5.0) -> Column:
    grid = spaced(mu - width * sigma, mu + width * sigma, points)
    exact = F.struct(mu.cast("double").alias("mu"), sigma.cast("double").alias("sigma"), F.lit(-math.inf).alias("a"), F.lit(math.inf).alias("b"), F.log(sigma * math.sqrt(2 * math.pi)).alias("log_norm"))
    return _struct(grid, lambda g: F.transform(g, lambda z: F.exp(-0.5 * ((z - mu) / sigma) * ((z - mu) / sigma))), exact)


def uniform_column(a: Column, b: Column) -> Column:
    eps, height = F.greatest((b - a) * 1e-6, F.lit(1e-12)), 1 / (b - a)
    return _struct(F.array(a - eps, a + 0.0, b + 0.0, b + eps), lambda g: F.array(F.lit(0.0), height, height, F.lit(0.0)))


def triangular_column(a: Column, mode: Column, b: Column) -> Column:
    top = 2 / (b - a)
    return _struct(F.array(a + 0.0, (a + mode) / 2, mode + 0.0, (mode + b) / 2, b + 0.0), lambda g: F.array(F.lit(0.0), top / 2, top, top / 2, F.lit(0.0)))


def lognormal_column(mu: Column, sigma: Column, points: int = 30) -> Column:
    grid = spaced(F.greatest(F.exp(mu - 5 * sigma), F.lit(1e-10)), F.exp(mu + 5 * sigma), points)
    return _struct(grid, lambda g: F.transform(g, lambda z: F.exp(-0.5 * ((F.log(z) - mu) / sigma) * ((F.log(z) - mu) / sigma)) / z))


def _normal_mass(low: Column, high: Column, steps: int = 240) -> Column:
    """Of the standard normal between two columns, by Simpson's rule over what lies within 9 of 0 (or next to a bound beyond)."""
    ends = F.struct(F.least(F.greatest(low, F.lit(-9.0)), high).alias("a"), F.greatest(F.least(high, F.lit(9.0)), low).alias("b"))

    def whole(p):
        step = (p["b"] - p["a"]) / steps

        def part(first: int, last: int, weight: float) -> Column:
            """Every second place, those of one weight."""
            return weight * F.aggregate(F.sequence(F.lit(first), F.lit(last), F.lit(2)), F.lit(0.0), lambda s, i: s + let(p["a"] + step * i, lambda z: F.exp(z * z * -0.5)))

        ended = F.exp(p["a"] * p["a"] * -0.5) + F.exp(p["b"] * p["b"] * -0.5)
        return F.greatest((ended + part(1, steps - 1, 4.0) + part(2, steps - 2, 2.0)) * step / (3 * math.sqrt(2 * math.pi)), F.lit(TINY))

    return let(ends, whole)


def truncnorm_column(mu: Column, sigma: Column, a: Column, b: Column, points: int = 25) -> Column:
    exact = F.struct(mu.cast("double").alias("mu"), sigma.cast("double").alias("sigma"), a.cast("double").alias("a"), b.cast("double").alias("b"), (F.log(sigma * math.sqrt(2 * math.pi)) + F.log(_normal_mass((a - mu) / sigma, (b - mu) / sigma))).alias("log_norm"))
    return _struct(spaced(a, b, points), lambda g: F.transform(g, lambda z: F.exp(-0.5 * ((z - mu) / sigma) * ((z - mu) / sigma))), exact)


def linear_column(grid: Column, dens: Column) -> Column:
    """Of two arrays of one length."""
    return _struct(grid.cast("array<double>"), lambda g: dens.cast("array<double>"))


def histogram_column(edges: Column, dens: Column) -> Column:
    """Of an array of edges and one of densities, one shorter."""
    edges, dens = edges.cast("array<double>"), dens.cast("array<double>")
    whole = F.aggregate(F.sequence(F.lit(1), F.size(dens)), F.lit(0.0), lambda s, i: s + F.get(dens, i - 1) * (F.get(edges, i) - F.get(edges, i - 1)))
    none = F.lit(None).cast("struct<mu: double, sigma: double, a: double, b: double, log_norm: double>")
    return let(whole, lambda w: F.struct(F.lit("histogram").alias("kind"), edges.alias("z_grid"), F.transform(dens, lambda x: x / w).alias("dens"), none.alias("analytic")))


def sampled_column(density, low: Column, high: Column, points: int = 50) -> Column:
    """Of any function from a column to a column; what is below 0 counts as 0."""
    return _struct(spaced(low, high, points), lambda g: F.transform(g, lambda z: F.greatest(density(z), F.lit(0.0))))


def mixture_column(parts: list[Column], weights: list[float], points: int = 60) -> Column:
    def mixed(all_parts):
        own = [F.get(all_parts, F.lit(i)) for i in range(len(parts))]
        ends = [(F.get(p["z_grid"], F.lit(0)), F.get(p["z_grid"], F.size(p["z_grid"]) - 1)) for p in own]
        low, high = (F.least(*x) if i == 0 else F.greatest(*x) for i, x in enumerate(zip(*ends, strict=True))) if len(parts) > 1 else ends[0]

        def density(z):
            return sum((w / sum(weights) * evaluate_column(p, z) for w, p in zip(weights, own, strict=True)), F.lit(0.0))

        return sampled_column(density, low, high, points)

    return let(F.array(*parts), mixed)


def evaluate_column(pdf: Column, z: Column) -> Column:
    """Density at z: 0 outside the support."""

    def at(p):
        grid, dens = p["pdf"]["z_grid"], p["pdf"]["dens"]

        def line(i):
            below = F.get(dens, i)
            rising = below + (F.get(dens, i + 1) - below) * (p["z"] - F.get(grid, i)) / (F.get(grid, i + 1) - F.get(grid, i))
            return F.when(p["pdf"]["kind"] == "histogram", below).otherwise(rising)

        inside = (p["z"] >= F.get(grid, F.lit(0))) & (p["z"] <= F.get(grid, F.size(grid) - 1))
        # The place is looked up once.
        return F.when(~inside, 0.0).otherwise(let(F.least(F.size(F.filter(grid, lambda g: g <= p["z"])) - 1, F.size(grid) - 2), line))

    return let(F.struct(pdf.alias("pdf"), z.alias("z")), at)


def moments_column(pdf: Column, points: int = 500) -> Column:
    """Struct of mean and variance: trapezoid sums over ``points`` places, those of one piece of the density in closed form."""

    def prepared(p):
        grid = p["z_grid"]
        low = F.get(grid, F.lit(0))
        return F.struct(grid.alias("grid"), p["dens"].alias("dens"), (p["kind"] == "histogram").alias("flat"), low.alias("low"), ((F.get(grid, F.size(grid) - 1) - low) / (points - 1)).alias("step"))

    def first_place(p, i):
        """The first place at or after grid point i."""
        edge = F.get(p["grid"], i)

        def exact(j):
            return F.when(p["low"] + (j - 1) * p["step"] >= edge, j - 1).when(p["low"] + j * p["step"] < edge, j + 1).otherwise(j)

        return let(F.ceil((edge - p["low"]) / p["step"]).cast("double"), exact)

    def sums(p):
        last = F.size(p["grid"]) - 2

        def piece(i):
            """Places a to b of a piece, with its density as c + d * place."""
            end = F.when(i == last, F.lit(points - 1.0)).otherwise(first_place(p, i + 1) - 1)
            below = F.get(p["dens"], i)
            slope = F.when(p["flat"], 0.0).otherwise((F.get(p["dens"], i + 1) - below) / (F.get(p["grid"], i + 1) - F.get(p["grid"], i)))
            return let(slope, lambda d: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(first_place(p, i)).alias("a"), end.alias("b"), (below + d * (p["low"] - F.get(p["grid"], i))).alias("c"), (d * p["step"]).alias("d")))

        def added(s, q):
            a, b, c, d = q["a"], q["b"], q["c"], q["d"]
            # Sums of powers of the whole numbers a to b; 0 where a = b + 1.
            n, one = b - a + 1, (a + b) * (b - a + 1) / 2
            two = (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
            three = (b * (b + 1) / 2) * (b * (b + 1) / 2) - ((a - 1) * a / 2) * ((a - 1) * a / 2)
            return F.struct((s["m0"] + c * n + d * one).alias("m0"), (s["m1"] + c * one + d * two).alias("m1"), (s["m2"] + c * two + d * three).alias("m2"))

        zero = F.struct(F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2"))
        whole = F.aggregate(F.transform(F.sequence(F.lit(0), last), piece), zero, added)
        # The ends count half.
        begin, end = F.get(p["dens"], F.lit(0)) / 2, F.get(p["dens"], F.size(p["dens"]) - 1) / 2
        return let(whole, lambda s: F.struct(((s["m0"] - begin - end) * p["step"]).alias("m0"), ((s["m1"] - (points - 1.0) * end) * p["step"]).alias("m1"), ((s["m2"] - (points - 1.0) ** 2 * end) * p["step"]).alias("m2"), p["low"].alias("low"), p["step"].alias("step")))

    def both(s):
        def spread(mean):
            c = s["low"] - mean
            return F.struct(mean.alias("mean"), F.greatest(c * c * s["m0"] + 2 * c * s["step"] * s["m1"] + s["step"] * s["step"] * s["m2"], F.lit(1e-16)).alias("variance"))

        return let(s["low"] * s["m0"] + s["step"] * s["m1"], spread)

    return let(let(let(pdf, prepared), sums), both)


def shifted_column(pdf: Column, by: Column) -> Column:
    exact = pdf["analytic"]
    moved = F.struct((exact["mu"] - by).alias("mu"), exact["sigma"].alias("sigma"), (exact["a"] - by).alias("a"), (exact["b"] - by).alias("b"), exact["log_norm"].alias("log_norm"))
    return F.struct(pdf["kind"].alias("kind"), F.transform(pdf["z_grid"], lambda z: z - by).alias("z_grid"), pdf["dens"].alias("dens"), F.when(exact.isNotNull(), moved).alias("analytic"))
