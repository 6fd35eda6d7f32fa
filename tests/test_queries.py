"""Every query of the library gives the rows of its SQL."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from plumbline.operators import timeseries
from plumbline.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(rows):
    return sorted(("|".join("nan" if isinstance(x, float) and math.isnan(x) else f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert tidy(df.select(*columns).collect()) == tidy(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fit_is_of_the_plane_with_all_models(spark):
    got = queries.QUERIES["fit"](spark, SF).collect()
    assert sorted((r["group"], r["model"]) for r in got) == [(f"{x} 0", m) for x in range(5) for m in ("exponential", "gaussian", "spherical")]


def test_synthetic_network_has_all_nodes_and_hours(spark):
    got = [(r["node_id"], r["hour"]) for r in queries.QUERIES["synthetic_network"](spark, SF).collect()]
    first = min(h for _, h in got)
    assert sorted(got) == [(n, h) for n in range(11) for h in range(first, first + 36)]


def test_synthetic_network_equals_plain_arrays(spark):
    """Both runs, rain and the sensors' fixed readings of the whole query, by NumPy's convolution, interpolation and means."""
    rows = queries.QUERIES["synthetic_network"](spark, SF).toPandas()
    n, dt = 576, 0.25
    t = np.arange(n) * dt
    rain = sum(a * np.exp(-0.5 * ((t - b) / c) ** 2) for a, b, c in [(0.58, 45.0, 2.6), (0.42, 48.2, 1.4), (0.24, 96.5, 3.4)]) + 0.02 * np.maximum(np.sin(2 * np.pi * (t - 6) / 24), 0)
    waves = np.array(timeseries.HOURLY)[np.floor(t % 24).astype(int)] * np.array(timeseries.DAILY)[np.floor(t / 24).astype(int) % 7]

    def flows(run):
        (share, peak, recession), (velocity, loss) = timeseries.RESPONSE[run], timeseries.TRAVEL[run]
        conv = np.convolve(np.maximum(rain - 0.04, 0), timeseries.unit_hydrograph(dt, peak, recession))[:n] * dt
        own, flow = {m: (b, s, p) for m, b, s, p in timeseries.SOURCES[run]}, {}
        for name, *_ in timeseries.NODES:
            base, scale, phase = own.get(name, (0.0, 0.0, 0.0))
            turn = 2 * np.pi * (t / 24 + phase)
            flow[name] = base * waves * np.clip(1 + 0.05 * np.sin(turn) + 0.03 * np.cos(2 * turn), 0.84, 1.16) + scale * share * conv
            for a, b, length in timeseries.LINKS:
                if b == name:
                    flow[name] = flow[name] + math.exp(-loss * length / 1000) * np.interp(t - length / velocity / 3600, t, flow[a], left=0.0)
        return flow

    def noisy(name, v):
        draws, smooth = np.random.default_rng([42, *name.encode()]).standard_normal(n), np.empty(n)
        for i, d in enumerate(draws):
            smooth[i] = 0.84 * smooth[i - 1] + 0.32 * d if i else d
        return np.clip(v + (0.010 + 0.035 * np.sqrt(v)) * smooth, 0, None)

    def hourly(v):
        return v.reshape(-1, 4).mean(axis=1)

    soft, truth, wet = flows("soft"), {m: noisy(m, v) for m, v in flows("truth").items()}, hourly(rain)
    first = int(wet.argmax()) - 12
    assert sorted(zip(rows["node"], rows["hour"])) == sorted((m, h) for m in soft for h in range(first, first + 36))
    for m, group in rows.groupby("node"):
        assert group["soft"].to_numpy() == pytest.approx(hourly(soft[m])[group["hour"]], abs=1e-9)
        assert group["truth"].to_numpy() == pytest.approx(hourly(truth[m])[group["hour"]], abs=1e-9)
        assert group["rain"].to_numpy() == pytest.approx(wet[group["hour"]], abs=1e-9)
        assert (group["is_hard"] == group["hard_value"].notna()).all() and (m in timeseries.SENSORS or not group["is_hard"].any())
    always = rows[rows["node"].isin(timeseries.SENSORS) & rows["hour"].isin([first, int(wet.argmax()), first + 35])]
    assert len(always) == 12 and always["is_hard"].all()
