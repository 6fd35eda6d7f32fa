"""Models, special functions and soft densities against closed forms."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import softpdf
from plumbline.functions.covariance import SPATIAL, Covariance, Model, SpaceTime, distances, register
from plumbline.functions.special import bessel_k, low_discrepancy, norm_cdf, norm_ppf, norm_ppf_column

MODELS = [("exponential", [2.5, 10]), ("gaussian", [3, 8]), ("spherical", [1.5, 5]), ("matern", [2, 6, 0.5]), ("matern", [2, 6, 1.5]), ("matern", [2, 6, 2.5]), ("nugget", [4]), ("hole_cos", [1, 12])]


@pytest.mark.parametrize(("name", "params"), MODELS)
def test_sill_at_zero_and_column_equals_array(spark, name, params):
    cov = Covariance(name, params)
    assert cov.variance == pytest.approx(params[0])
    lags = [0.0, 0.3, 1.0, 4.9, 5.0, 12.5, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(lags)], "i int, h double").orderBy("i").select(cov.column(F.col("h"))).collect()]
    assert got == pytest.approx(cov.array(np.array(lags)).tolist(), abs=1e-12)


@pytest.mark.parametrize(("name", "params"), [m for m in MODELS if m[0] != "hole_cos"])
def test_positive_definite(name, params):
    points = np.random.default_rng(1).random((40, 2)) * 20
    assert np.linalg.eigvalsh(Covariance(name, params).matrix(points, points)).min() > -1e-10


def test_matern_of_any_smoothness():
    h = np.array([0.0, 0.5, 2.0, 7.0])
    near = Covariance("matern", [2, 6, 1.5000001]).array(h)
    assert near == pytest.approx(Covariance("matern", [2, 6, 1.5]).array(h), rel=1e-5)
    assert bessel_k(1.0, np.array([1.0]))[0] == pytest.approx(0.6019072301972346, rel=1e-9)


def test_nested_space_time_and_registry():
    nested = Covariance(["nugget", "exponential"], [[0.5], [1, 10]])
    assert nested.array(np.array([0.0, 1.0])) == pytest.approx([1.5, math.exp(-0.3)])
    with pytest.raises(KeyError):
        Covariance("none").array(1.0)
    both = SpaceTime("exponential", [1, 10], "exponential", [1, 3], 2.0)
    assert both.array(0.0, 5.0) == pytest.approx(2 * math.exp(-5))
    with pytest.raises(KeyError):
        SpaceTime("none", [1]).array(0.0, 0.0)
    register(Model("linear_drop", 1, lambda m, h, p: m.least(h * -1 + p[0], math.inf)))
    assert Covariance("linear_drop", [3]).array(1.0) == 2.0
    del SPATIAL["linear_drop"]


def test_distances():
    assert distances([[0, 0], [3, 4]], [[0, 0], [4, 2]]).ravel() == pytest.approx([0, math.sqrt(20), 5, math.sqrt(5)])


@settings(max_examples=50, deadline=None)
@given(st.floats(1e-12, 1 - 1e-12))
def test_inverse_normal(p):
    assert float(norm_cdf(norm_ppf(p))) == pytest.approx(p, rel=1e-9, abs=1e-14)


def test_inverse_normal_column(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.975, 0.999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").coalesce(1).select(norm_ppf_column(F.col("p"))).collect()]
    assert got == pytest.approx(norm_ppf(np.array(p)).tolist(), rel=2e-9, abs=1e-9)
    assert norm_ppf([0.0, 1.0]).tolist() == [-math.inf, math.inf]


def test_low_discrepancy_repeats_and_fills():
    a = low_discrepancy(2048, 3, 5)
    assert (a == low_discrepancy(2048, 3, 5)).all() and a.mean(axis=0) == pytest.approx([0.5] * 3, abs=0.01)


BUILT = [softpdf.gaussian(5, 2), softpdf.uniform(2, 6), softpdf.interval(1, 3), softpdf.triangular(0, 1, 4), softpdf.truncnorm(1, 2, 0, 3), softpdf.lognormal(0.5, 0.6), softpdf.histogram([0, 1, 3], [1, 2]), softpdf.linear([0, 1, 2], [0, 3, 0]), softpdf.sampled(lambda z: 1 + np.sin(z), 0, 6), softpdf.mixture([softpdf.gaussian(-3, 0.5), softpdf.gaussian(3, 0.5)], [1, 3])]


@pytest.mark.parametrize("pdf", BUILT)
def test_unit_area(pdf):
    z = np.linspace(*pdf.support, 20001)
    assert np.trapezoid(pdf(z), z) == pytest.approx(1, abs=0.02)
    assert pdf(np.array([pdf.support[0] - 1, pdf.support[1] + 1])).tolist() == [0, 0]


def test_moments_and_shift():
    assert softpdf.gaussian(5, 2, 50).moments() == pytest.approx((5, 4), rel=0.02)
    assert softpdf.uniform(2, 6).moments() == pytest.approx((4, 4 / 3), rel=0.01)
    moved = softpdf.truncnorm(1, 2, 0, 3).shifted(0.5)
    assert moved.support == pytest.approx((-0.5, 2.5)) and moved.analytic[:4] == pytest.approx((0.5, 2, -0.5, 2.5))
    exact = softpdf.gaussian(1, 2)
    assert float(exact.log(3.0)) == pytest.approx(math.log(math.exp(-0.5) / (2 * math.sqrt(2 * math.pi))))
    assert float(exact.slope(3.0)) == -0.5 and float(exact.curvature(3.0)) == -0.25
    with pytest.raises(ValueError):
        softpdf.linear([0, 1], [1])


def test_columns_equal_arrays(spark):
    at = [-3.0, 0.0, 0.4, 1.0, 1.7, 2.2, 9.0]
    one = spark.range(1)
    for column, pdf in (
        (softpdf.gaussian_column(F.lit(1.0), F.lit(0.5)), softpdf.gaussian(1, 0.5)), (softpdf.uniform_column(F.lit(0.0), F.lit(2.0)), softpdf.uniform(0, 2)),
        (softpdf.triangular_column(F.lit(0.0), F.lit(1.0), F.lit(3.0)), softpdf.triangular(0, 1, 3)), (softpdf.lognormal_column(F.lit(0.2), F.lit(0.4)), softpdf.lognormal(0.2, 0.4)),
    ):
        rows = one.select(column.alias("pdf")).select("pdf", F.array(*(softpdf.evaluate_column(F.col("pdf"), F.lit(z)) for z in at)).alias("d"), softpdf.moments_column(F.col("pdf")).alias("m"), softpdf.shifted_column(F.col("pdf"), F.lit(0.25)).alias("s")).first()
        assert rows["d"] == pytest.approx(pdf(np.array(at)).tolist(), abs=1e-9)
        assert (rows["m"]["mean"], rows["m"]["variance"]) == pytest.approx(pdf.moments(), rel=1e-6)
        assert softpdf.SoftPdf.from_row(rows["s"]).grid == pytest.approx(pdf.shifted(0.25).grid)


def test_moments_of_a_density_are_as_quick_as_its_points(spark):
    """500 places that each looked their piece up, several times over, took milliseconds a row."""
    rows = spark.range(0, 4000, 1, 4).select(F.col("id"), softpdf.gaussian_column(F.col("id").cast("double"), F.lit(40.0)).alias("pdf"))
    start = time.monotonic()
    got = rows.select(F.max(F.abs(softpdf.moments_column(F.col("pdf"))["mean"] - F.col("id"))).alias("off")).first()["off"]
    assert got < 0.01 and time.monotonic() - start < 5


def test_moment_columns_equal_arrays(spark):
    pdfs = [softpdf.gaussian(3, 2.0), softpdf.uniform(-2, 5), softpdf.triangular(0, 1, 5), softpdf.truncnorm(1, 2, -3, 4), softpdf.lognormal(0, 0.5), softpdf.histogram([0.0, 1, 2, 4], [1, 2, 1]), softpdf.linear([0, 1, 1.0001, 7], [0, 2, 1, 0])]
    df = spark.createDataFrame([(i, p.row()) for i, p in enumerate(pdfs)], f"i long, pdf {softpdf.SCHEMA}")
    for r in df.select("i", softpdf.moments_column(F.col("pdf")).alias("m")).collect():
        assert (r["m"]["mean"], r["m"]["variance"]) == pytest.approx(pdfs[r["i"]].moments(), rel=1e-9)
