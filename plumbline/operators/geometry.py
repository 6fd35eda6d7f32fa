"""Points as array columns: distances, projection, predicates, grids, thinning and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Points of the smaller side of all pairs.
PAIR_ROWS = 100_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two coordinate arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pair_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """All distances of a table of points (id, coords) with a small set of such, which goes in full to every task; raises if it has over ``PAIR_ROWS`` rows."""
    if b.limit(PAIR_ROWS + 1).count() > PAIR_ROWS:
        raise ValueError(f"the second table has over {PAIR_ROWS} rows: use within_distance or knn")
    b = F.broadcast(b)
    return a.select(F.col("id").alias("a_id"), F.col("coords").alias("__a")).join(b.select(F.col("id").alias("b_id"), F.col("coords").alias("__b"))).select("a_id", "b_id", distance(F.col("__a"), F.col("__b")).alias("distance"))


def equirectangular(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """x and y in km about the mean longitude and latitude, which are two numbers from one aggregate."""
    mid_lon, mid_lat = points.agg(F.avg(lon), F.avg(lat)).first()
    if mid_lon is None:
        return points.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    return points.withColumns({"x": (F.col(lon) - mid_lon) * (math.cos(math.radians(mid_lat)) * 111.32), "y": (F.col(lat) - mid_lat) * 111.32})


def within(dist: Column, dmax: float) -> Column:
    """The bound itself counts."""
    return dist <= dmax


def within_st(dist: Column, gap: Column, dmax: float, tmax: float) -> Column:
    return (dist <= dmax) & (gap <= tmax)


def coincides(dist: Column) -> Column:
    return dist < 1e-10


def by_valid_count(rows: DataFrame, site: str, value: str, hard_from: int = 12, soft_from: int = 3) -> DataFrame:
    """Each site's number of values and its class: hard, soft or excluded."""
    counted = rows.groupBy(site).agg(F.count(value).alias("n_valid"))
    return counted.withColumn("class", F.when(F.col("n_valid") >= hard_from, "hard").when(F.col("n_valid") >= soft_from, "soft").otherwise("excluded"))


def grid(spark: SparkSession, low: list[float], high: list[float], shape: list[int]) -> DataFrame:
    """A regular grid (id, coords), the last coordinate fastest."""
    n = math.prod(shape)
    rest, parts = F.col("id"), []
    for lo, hi, k in list(zip(low, high, shape, strict=True))[::-1]:
        at = F.pmod(rest, F.lit(k))
        parts.append(F.lit(float(lo)) + at * ((hi - lo) / (k - 1) if k > 1 else 0.0))
        rest = F.floor(rest / k)
    return spark.range(n).select("id", F.array(*parts[::-1]).alias("coords"))


def thinned(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row by order, with k so that at most ``most`` are left. The ranks come from ordered ranges, not from one task."""
    n = rows.count()
    k = n // most + 1
    ranked = numbered(rows, order)
    return ranked.where(F.col("__rank") % k == 0).drop("__rank")


def numbered(rows: DataFrame, order: list[str], name: str = "__rank") -> DataFrame:
    """Rows numbered from 0 in the given order: sorted ranges, whose counts (one row each) give the offsets."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    # The id has the partition in its upper bits and the row's place within it in the lower 33.
    placed = placed.withColumn("__row", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return placed.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for one seed however the rows are dealt."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def active(cells: DataFrame, stations: DataFrame, reach: float) -> DataFrame:
    """Cells (id, x, y) within ``reach`` of a station (x, y), by squares of that size and their neighbours."""
    s = stations.select(F.col("x").alias("__sx"), F.col("y").alias("__sy"), F.floor(F.col("x") / reach).alias("__bx"), F.floor(F.col("y") / reach).alias("__by"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    s = s.select("__sx", "__sy", "__bx", "__by", near.alias("__d")).select("__sx", "__sy", (F.col("__bx") + F.col("__d.i")).alias("__bx"), (F.col("__by") + F.col("__d.j")).alias("__by"))
    c = cells.withColumns({"__bx": F.floor(F.col("x") / reach), "__by": F.floor(F.col("y") / reach)})
    hit = (c["__bx"] == s["__bx"]) & (c["__by"] == s["__by"]) & ((c["x"] - s["__sx"]) * (c["x"] - s["__sx"]) + (c["y"] - s["__sy"]) * (c["y"] - s["__sy"]) <= reach * reach)
    return c.join(s, hit, "left_semi").drop("__bx", "__by")
