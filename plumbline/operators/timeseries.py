"""Time series and routing on a directed network, and a synthetic sewer network made of them."""

from __future__ import annotations

import math
from datetime import datetime
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.geometry import numbered
from plumbline.operators.network import COMPACT, checkpointed

# Dry-weather multipliers by hour of day and by day of week.
HOURLY = [0.69, 0.65, 0.62, 0.60, 0.63, 0.75, 0.91, 1.06, 1.17, 1.15, 1.09, 1.02, 0.98, 0.99, 1.03, 1.10, 1.20, 1.28, 1.24, 1.14, 1.03, 0.93, 0.83, 0.75]
DAILY = [1.00, 1.02, 1.04, 1.03, 1.06, 0.93, 0.88]
# Nodes (name, x, y, depth) and links (from, to, length in feet) of the synthetic network.
NODES = [
    ("NORTH_A", 0.0, 4200.0, 0.0), ("NORTH_B", 1200.0, 4050.0, 0.0), ("EAST_A", 2700.0, 3950.0, 0.0), ("WEST_A", -300.0, 2200.0, 0.0), ("JUNC_N", 650.0, 2950.0, 1.0), ("JUNC_E", 1900.0, 2850.0, 1.0),
    ("JUNC_C", 1250.0, 1900.0, 2.0), ("CORE", 900.0, 1100.0, 3.0), ("SOUTH_A", 2250.0, 1450.0, 1.0), ("TRUNK", 1200.0, 450.0, 4.0), ("OUTFALL", 1200.0, 0.0, 5.0),
]
LINKS = [
    ("NORTH_A", "JUNC_N", 1450.0), ("NORTH_B", "JUNC_N", 1325.0), ("EAST_A", "JUNC_E", 1500.0), ("JUNC_N", "JUNC_C", 1225.0), ("JUNC_E", "JUNC_C", 1180.0),
    ("WEST_A", "CORE", 1360.0), ("JUNC_C", "CORE", 1120.0), ("SOUTH_A", "TRUNK", 1280.0), ("CORE", "TRUNK", 1080.0), ("TRUNK", "OUTFALL", 860.0),
]
# Node, baseline flow, response scale and phase, of the nominal run and of the one that counts as true.
SOURCES = {
    "soft": [("NORTH_A", 0.36, 2.2, 0.02), ("NORTH_B", 0.27, 1.6, 0.08), ("EAST_A", 0.31, 1.9, 0.15), ("WEST_A", 0.23, 1.4, -0.06), ("SOUTH_A", 0.18, 1.1, 0.21), ("CORE", 0.12, 0.0, -0.02)],
    "truth": [("NORTH_A", 0.378, 2.38, 0.06), ("NORTH_B", 0.258, 1.48, 0.12), ("EAST_A", 0.326, 2.05, 0.20), ("WEST_A", 0.214, 1.30, -0.01), ("SOUTH_A", 0.192, 1.18, 0.27), ("CORE", 0.128, 0.0, 0.02)],
}
# Share of rain, hours to peak and recession ratio of the response; velocity (ft/s) and loss per 1000 ft.
RESPONSE = {"soft": (0.085, 2.0, 3.0), "truth": (0.095, 2.35, 3.4)}
TRAVEL = {"soft": (0.50, 0.003), "truth": (0.47, 0.002)}
SENSORS = ["JUNC_N", "CORE", "TRUNK", "OUTFALL"]


def hour_multiplier(t: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in HOURLY)), (F.floor(F.pmod(t, F.lit(24.0))) + 1).cast("int"))


def day_multiplier(t: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in DAILY)), (F.pmod(F.floor(t / 24.0), F.lit(7)) + 1).cast("int"))


def rainfall(t: Column) -> Column:
    """Three bell-shaped pulses and a faint daily wave, inches an hour."""
    def pulse(height, at, width):
        return height * F.exp(-0.5 * ((t - at) / width) * ((t - at) / width))

    # Height, hour and width of each pulse, and the wave's.
    return pulse(0.58, 45.0, 2.6) + pulse(0.42, 48.2, 1.4) + pulse(0.24, 96.5, 3.4) + 0.02 * F.greatest(F.sin(2 * math.pi * (t - 6.0) / 24.0), F.lit(0.0))


def unit_hydrograph(dt: float, peak: float, recession: float) -> list[float]:
    """Ordinates of a triangle of unit area: up to the peak, and down over ``recession`` times as long."""
    base = peak * (1 + recession)
    t = np.arange(0.0, base + dt, dt)
    up, down = t / max(peak, 1e-12), (base - t) / max(base - peak, 1e-12)
    k = np.where(t <= peak, up, np.where(t <= base, down, 0.0))
    area = np.trapezoid(k, t)
    if area <= 0:
        raise ValueError("a response of no area")
    return (k / area).tolist()


def convolved(series: DataFrame, kernel: list[float], dt: float, value: str = "v") -> DataFrame:
    """Causal convolution of (step, v) with the kernel, times dt: each step's value is spread over the next ones and summed."""
    spread = series.select("step", F.col(value).alias("__v"), F.posexplode(F.array(*(F.lit(float(k)) for k in kernel))).alias("__lag", "__k"))
    out = spread.groupBy((F.col("step") + F.col("__lag")).alias("step")).agg((F.sum(F.col("__v") * F.col("__k")) * dt).alias("conv"))
    return series.join(out, "step", "left")


def delayed(series: DataFrame, by: list[str], delay: float, dt: float, value: str = "v") -> DataFrame:
    """``series`` (.., step, v), steps from 0, with ``delayed``: v as it was ``delay`` hours before, on straight lines between steps and 0 before the first."""
    whole, part = divmod(delay / dt, 1.0)
    w = Window.partitionBy(*by).orderBy("step") if by else Window.orderBy("step")
    late, later = F.lag(value, int(whole)).over(w), F.lag(value, int(whole) + 1).over(w)
    blend = late * (1 - part) + later * part if part else late
    return series.withColumn("delayed", F.coalesce(blend, F.lit(0.0)))


def routed(local: DataFrame, links: DataFrame, dt: float, velocity: float, loss: float, levels: int | None = None) -> DataFrame:
    """Flow (node, step, v) of local inflows (node, step, v) and all that arrives from upstream, delayed and weakened; no node passes on less than 0.

    Rounds from the sources down, each written: a round settles the nodes to which nothing unsettled flows, and passes their
    flow on. There are as many as the longest path has nodes. A cycle, or more than ``levels`` rounds, raises.
    """
    link = links.select("src", "dst", (F.col("length") / max(velocity, 1e-12) / 3600.0 / dt).alias("steps"), F.exp(-loss * F.col("length") / 1000.0).alias("keep"))
    link = checkpointed(link.select("src", "dst", "keep", F.floor("steps").alias("whole"), (F.col("steps") - F.floor("steps")).alias("part")))
    last = local.agg(F.max("step")).first()[0]
    local = local.select("node", "step", "v")
    waiting, total = checkpointed(local.select("node").union(link.select("src")).union(link.select("dst")).distinct()), None
    # The flow at t - delay lies between two steps; before the first step there is none.
    here = F.struct(F.col("whole").alias("n"), (1 - F.col("part")).alias("w"), (F.col("part") > 0).alias("low"))
    after = F.struct((F.col("whole") + 1).alias("n"), F.col("part").alias("w"), F.lit(False).alias("low"))
    for level in count(1):
        held = link.join(waiting.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("held", F.lit(True))
        found = checkpointed(waiting.join(held, "node", "left"))
        ready, waiting = found.where("held IS NULL").select("node"), found.where("held").select("node")
        if ready.isEmpty():
            break
        if levels is not None and level > levels:
            raise RuntimeError(f"flow not settled in {levels} levels")
        flow = local.join(ready, "node", "left_semi")
        if total is not None:
            parts = total.withColumnRenamed("node", "src").join(link.join(ready.withColumnRenamed("node", "dst"), "dst", "left_semi"), "src")
            moved = parts.select("dst", "step", "v", "keep", F.explode(F.array(here, after)).alias("m")).where("NOT (step = 0 AND m.low)")
            flow = flow.union(moved.select(F.col("dst").alias("node"), (F.col("step") + F.col("m.n")).alias("step"), (F.col("v") * F.col("keep") * F.col("m.w")).alias("v")).where(F.col("step") <= last))
        flow = checkpointed(flow.groupBy("node", "step").agg(F.greatest(F.sum("v"), F.lit(0.0)).alias("v")))
        total = flow if total is None else total.unionByName(flow)
        if level % COMPACT == 0:
            total = checkpointed(total)
    if not waiting.isEmpty():
        raise RuntimeError("flow goes round in a circle")
    return local if total is None else total


def hourly_means(series: DataFrame, by: list[str], steps: int, value: str = "v") -> DataFrame:
    """Means of complete hours of (.., step, v); an incomplete last one is left out."""
    return series.groupBy(*by, F.expr(f"step DIV {steps}").alias("hour")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == steps).drop("__n")


def process_noise(series: DataFrame, seed: int = 42) -> DataFrame:
    """(node, step, v) with smooth deviations: a first-order recursion in each node's own group, the same for one seed."""

    # Memory and innovation of the noise, and its size by flow.
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        draws = np.random.default_rng([seed, *pdf["node"].iloc[0].encode()]).standard_normal(len(pdf))
        smooth, level = np.empty(len(pdf)), 0.0
        for i, d in enumerate(draws):
            level = d if i == 0 else 0.84 * level + 0.32 * d
            smooth[i] = level
        v = pdf["v"].to_numpy(float)
        return pdf.assign(v=np.clip(v + (0.010 + 0.035 * np.sqrt(np.maximum(v, 0))) * smooth, 0, None))

    return series.select("node", "step", "v").groupBy("node").applyInPandas(run, "node string, step long, v double")


def best_window(obs: DataFrame, ts: str = "ts", node: str = "node") -> DataFrame:
    """The 24 hours, sliding by one, with the best 10 * nodes + observations; the earliest of equals: (start, nodes, n, score)."""
    slid = obs.groupBy(F.window(ts, "24 hours", "1 hour").alias("w")).agg(F.count_distinct(node).alias("nodes"), F.count(F.lit(1)).alias("n"))
    return slid.select(F.col("w.start").alias("start"), "nodes", "n", (10 * F.col("nodes") + F.col("n")).alias("score")).orderBy(F.desc("score"), "start").limit(1)


def prediction_grid(nodes: DataFrame, hours: DataFrame) -> DataFrame:
    """(est_id, node, t) of all nodes and hours, node by node; both are small."""
    return numbered(nodes.select("node").crossJoin(F.broadcast(hours.select("t"))), ["node", "t"], "est_id").withColumn("est_id", F.col("est_id").cast("long"))


def local_inflow(spark: SparkSession, run: str, n_steps: int, dt: float) -> DataFrame:
    """(node, step, dry, wet, v) of a run's sources; other nodes have 0."""
    steps = spark.range(n_steps).withColumnRenamed("id", "step").withColumn("t", F.col("step") * dt)
    share, peak, recession = RESPONSE[run]
    rain = steps.withColumn("v", F.greatest(rainfall(F.col("t")) - 0.04, F.lit(0.0)))
    wet = convolved(rain, unit_hydrograph(dt, peak, recession), dt).select("step", "t", F.coalesce("conv", F.lit(0.0)).alias("conv"))
    by = spark.createDataFrame([(n, *next(((b, s, p) for m, b, s, p in SOURCES[run] if m == n), (0.0, 0.0, 0.0))) for n, *_ in NODES], "node string, base double, scale double, phase double")
    turn = F.col("t") / 24.0 + F.col("phase")
    # The daily waves and their bounds.
    daily = F.least(F.greatest(1 + 0.05 * F.sin(2 * math.pi * turn) + 0.03 * F.cos(4 * math.pi * turn), F.lit(0.84)), F.lit(1.16))
    both = wet.crossJoin(by).select("node", "step", F.greatest(F.col("base") * hour_multiplier(F.col("t")) * day_multiplier(F.col("t")) * daily, F.lit(0.0)).alias("dry"), F.greatest(F.col("scale") * share * F.col("conv"), F.lit(0.0)).alias("wet"))
    return both.withColumn("v", F.col("dry") + F.col("wet"))


def synthetic_network(spark: SparkSession, seed: int = 42, dt_minutes: int = 15, days: int = 6, window_hours: int = 36, before_peak: int = 12, stride: int = 2, start: datetime = datetime(2024, 4, 1)) -> DataFrame:
    """(node, node_id, depth, hour, ts, rain, soft, truth, is_hard, hard_value) around the largest storm.

    ``soft`` is the nominal run, ``truth`` a run with other settings and smooth noise; hard values are noisy readings of it at
    four sensors: every ``stride`` hours with probability 0.88, and at the first, wettest and last hour. Draws are hashes of
    the seed, node and hour, so they don't depend on how rows are dealt.
    """
    dt = dt_minutes / 60.0
    per_hour, n_steps = round(60 / dt_minutes), round(days * 24 / dt)
    links = spark.createDataFrame(LINKS, "src string, dst string, length double")
    flows = {}
    for run in ("soft", "truth"):
        flow = routed(local_inflow(spark, run, n_steps, dt).select("node", "step", "v"), links, dt, *TRAVEL[run])
        flows[run] = hourly_means(process_noise(flow, seed) if run == "truth" else flow, ["node"], per_hour).withColumnRenamed("v", run)
    rain = hourly_means(spark.range(n_steps).select(F.col("id").alias("step"), rainfall(F.col("id") * dt).alias("v")), [], per_hour).withColumnRenamed("v", "rain")
    peak = rain.agg(F.max_by("hour", F.struct("rain", -F.col("hour")))).first()[0]
    first = min(max(peak - before_peak, 0), max(n_steps // per_hour - window_hours, 0))
    inside = F.col("hour").between(first, first + window_hours - 1)
    storm = rain.where(inside).agg(F.max_by("hour", F.struct("rain", -F.col("hour")))).first()[0]
    nodes = spark.createDataFrame([(n, i, d) for i, (n, _, _, d) in enumerate(NODES)], "node string, node_id long, depth double")
    rows = flows["soft"].where(inside).join(flows["truth"].where(inside), ["node", "hour"]).join(rain.where(inside), "hour").join(F.broadcast(nodes), "node")
    # Share of missed readings, and the readings' noise by flow.
    draw = _uniform(seed, 1)
    hard = F.col("node").isin(SENSORS) & (((F.pmod(F.col("hour") - first, F.lit(stride)) == 0) & (draw > 0.12)) | F.col("hour").isin([first, storm, first + window_hours - 1]))
    # Two uniform draws make a normal one.
    normal = F.sqrt(-2 * F.log(_uniform(seed, 2))) * F.cos(2 * math.pi * _uniform(seed, 3))
    reading = F.greatest(F.col("truth") + normal * (0.012 + 0.018 * F.sqrt(F.greatest("truth", F.lit(0.0)))), F.lit(0.0))
    return rows.select("node", "node_id", "depth", "hour", (F.lit(start) + F.make_interval(hours=F.col("hour").cast("int"))).alias("ts"), "rain", "soft", "truth", hard.alias("is_hard"), F.when(hard, reading).alias("hard_value"))


def _uniform(seed: int, which: int) -> Column:
    return (F.pmod(F.xxhash64("node", "hour", F.lit(seed), F.lit(which)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def soft_inputs(rows: DataFrame, exclude_hard: bool = True) -> DataFrame:
    """(soft_id, node, t, mu, sigma, upper) of the synthetic network: wider with flow, depth and rain."""
    deepest, wettest = rows.agg(F.max("depth"), F.max("rain")).first()
    # The width's parts by flow, depth and rain.
    sigma = 0.035 + 0.055 * F.sqrt(F.greatest("soft", F.lit(0.0))) + 0.020 * F.col("depth") / max(deepest, 1.0) + 0.015 * F.col("rain") / max(wettest, 1e-12)
    kept = rows.where("NOT is_hard") if exclude_hard else rows
    return kept.select((F.col("node_id") * 100000 + F.col("hour")).alias("soft_id"), F.col("node_id").alias("node"), F.col("hour").cast("double").alias("t"), F.col("soft").alias("mu"), sigma.alias("sigma"), F.greatest(F.col("soft") + 5 * sigma, F.lit(0.30)).alias("upper"))
