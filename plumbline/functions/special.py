"""Special functions that neither Spark nor NumPy has: normal distribution, Bessel K, as NumPy and partly as columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_pdf(x, mu=0.0, sigma=1.0):
    return np.exp(-0.5 * ((np.asarray(x, float) - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


# Acklam's rational approximation of the inverse normal distribution (relative error 1.15e-9).
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
ACKLAM_TAIL = 0.02425


def _poly(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p):
    """Inverse of norm_cdf, the approximation polished by one Halley step; -inf and inf at 0 and 1."""
    p = np.asarray(p, float)
    q = np.clip(p, 1e-300, 1 - 1e-16)
    low, high = q < ACKLAM_TAIL, q > 1 - ACKLAM_TAIL
    tail = np.sqrt(-2 * np.log(np.where(high, 1 - q, q)))
    edge = _poly(ACKLAM_C, tail) / _poly(ACKLAM_D, tail)
    r = (q - 0.5) ** 2
    x = np.where(low, edge, np.where(high, -edge, (q - 0.5) * _poly(ACKLAM_A, r) / _poly(ACKLAM_B, r)))
    e = norm_cdf(x) - q
    u = e * math.sqrt(2 * math.pi) * np.exp(np.minimum(x * x / 2, 700))
    x = x - u / (1 + x * u / 2)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def norm_ppf_column(p: Column) -> Column:
    """The approximation as an expression (no Halley step), which SQL can repeat digit by digit."""
    def tail(x):
        return _poly([F.lit(c) for c in ACKLAM_C], x) / _poly([F.lit(c) for c in ACKLAM_D], x)

    r = (p - 0.5) * (p - 0.5)
    middle = (p - 0.5) * _poly([F.lit(c) for c in ACKLAM_A], r) / _poly([F.lit(c) for c in ACKLAM_B], r)
    return F.when(p < ACKLAM_TAIL, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - ACKLAM_TAIL, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def norm_ppf_sql(p: str) -> str:
    """The same approximation as SQL text."""
    def poly(coefficients, x):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    def tail(x):
        return f"({poly(ACKLAM_C, x)} / {poly(ACKLAM_D, x)})"

    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < {ACKLAM_TAIL} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - ACKLAM_TAIL} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE ({p} - 0.5) * {poly(ACKLAM_A, r)} / {poly(ACKLAM_B, r)} END"


def bessel_k(nu: float, x) -> np.ndarray:
    """Modified Bessel function of the second kind: closed form for half-odd orders up to 5/2, else its integral over cosh."""
    x = np.asarray(x, float)
    if nu in (0.5, 1.5, 2.5):
        series = {0.5: 1.0, 1.5: 1 + 1 / x, 2.5: 1 + 3 / x + 3 / x**2}[nu]
        return np.sqrt(np.pi / (2 * x)) * np.exp(-x) * series
    # The integrand falls as exp(-x cosh t): beyond the last node it is below 1e-300 or so for the smallest x.
    reach = np.arccosh(1 + 750 / max(float(x.min(initial=1.0)), 1e-12)) if x.size else 1.0
    t = np.linspace(0.0, reach, 4001)
    return np.trapezoid(np.exp(-x[..., None] * np.cosh(t)) * np.cosh(nu * t), t, axis=-1)


# Degree, inner coefficients and first direction numbers of the primitive polynomials of a Sobol sequence's
# second and further dimensions (Joe and Kuo, 2008).
SOBOL = [
    (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]),
    (5, 7, [1, 1, 7, 11, 19]), (5, 11, [1, 1, 5, 1, 1]), (5, 13, [1, 1, 1, 3, 11]), (5, 14, [1, 3, 5, 5, 31]), (6, 1, [1, 3, 3, 9, 7, 49]), (6, 13, [1, 1, 1, 15, 21, 21]),
    (6, 16, [1, 3, 1, 13, 27, 49]), (6, 19, [1, 1, 1, 15, 7, 5]), (6, 22, [1, 3, 1, 15, 13, 25]), (6, 25, [1, 1, 5, 5, 19, 61]), (7, 1, [1, 3, 7, 11, 23, 15, 103]), (7, 4, [1, 3, 7, 13, 13, 15, 69]),
]
_BITS = 30


def _directions(d: int) -> list[int]:
    """The direction numbers of a dimension, as integers of ``_BITS`` bits."""
    if not d:
        return [1 << (_BITS - 1 - i) for i in range(_BITS)]
    degree, inner, first = SOBOL[d - 1]
    out = [m << (_BITS - 1 - i) for i, m in enumerate(first)]
    for i in range(degree, _BITS):
        v = out[i - degree] ^ (out[i - degree] >> degree)
        for k in range(1, degree):
            if inner >> (degree - 1 - k) & 1:
                v ^= out[i - k]
        out.append(v)
    return out


def low_discrepancy(n: int, dims: int, seed: int) -> np.ndarray:
    """n points in the unit cube: a Sobol sequence, scrambled in each dimension by a seeded triangular matrix of bits and a shift; the same for one seed."""
    if dims > len(SOBOL) + 1:
        raise ValueError(f"at most {len(SOBOL) + 1} dimensions")
    if n > 1 << _BITS:
        raise ValueError(f"at most {1 << _BITS} points")
    rng, number = np.random.default_rng(seed), np.arange(n, dtype=np.int64)
    out = np.zeros((n, dims))
    for d in range(dims):
        # Bit i of a scrambled number (from the top) is the parity of bits 0 to i under a row of the matrix, which keeps bit i.
        rows = [int(rng.integers(0, 1 << i)) << (_BITS - i) | 1 << (_BITS - 1 - i) for i in range(_BITS)]
        x = np.full(n, int(rng.integers(0, 1 << _BITS)), dtype=np.int64)
        for bit, v in enumerate(_directions(d)[: max(1, int(n - 1).bit_length())]):
            mixed = sum(((rows[i] & v).bit_count() & 1) << (_BITS - 1 - i) for i in range(_BITS))
            x ^= np.where(number >> bit & 1, mixed, 0)
        out[:, d] = (x + 0.5) / (1 << _BITS)
    return out
