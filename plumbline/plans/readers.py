"""Queries over the readers: small files are written to the shared folder of ``spark.checkpoint.dir`` and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.network import shared_dir
from plumbline.sources import files

from .queries import query, r

SEWER = """[TITLE]
;; a small system
[JUNCTIONS]
J1  100
J2  101
[STORAGE]
S1  95
[OUTFALLS]
O1  90
[CONDUITS]
C1  J1  J2  120
[PUMPS]
P1  J2  O1
[COORDINATES]
J1  1.5  2.5
J2  3.0  4.0
[SUBCATCHMENTS]
A  gauge  J1
B  gauge  J2
"""
OBSERVATIONS = """Name,M1,M2,M3
Node,J1,J2,J2
Type,Flow,Depth,Flow
Unit,cfs,ft,cfs
01/02/2024 00:15,1.5,9,4
bad date,2,9,5
1/2/2024 0:30,2.5,8,x
"""
RAIN = "HLY 20240102 03:00 0.5\nHLY 20240103 04:00 999.9\nHLY 20240104 05:00 0.9\nno date here\n"
NAMED = "a title\n2 columns\nlon\npm\n-80.5 12.0\n-81 -9999\n7\n-82.25 3.5\n"


def _written(spark: SparkSession, text: str) -> str:
    """The path of a text file, written by Spark."""
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-text-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path, lineSep="\n")
    return path


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({x})' for x in rows)}) AS t({columns})"


@query("read_sections", _values("section, words", "'JUNCTIONS', 'J1 100'", "'JUNCTIONS', 'J2 101'", "'STORAGE', 'S1 95'", "'OUTFALLS', 'O1 90'", "'CONDUITS', 'C1 J1 J2 120'", "'PUMPS', 'P1 J2 O1'", "'COORDINATES', 'J1 1.5 2.5'", "'COORDINATES', 'J2 3.0 4.0'", "'SUBCATCHMENTS', 'A gauge J1'", "'SUBCATCHMENTS', 'B gauge J2'"))
def read_sections(spark, sf_dir) -> DataFrame:
    return files.sections(spark, _written(spark, SEWER)).where("section <> 'TITLE'").select("section", F.array_join("parts", " ").alias("words"))


@query("read_nodes", _values("node, name, kind, elev, x, y", "0::BIGINT, 'J1', 'junctions', 100.0::DOUBLE, 1.5::DOUBLE, 2.5::DOUBLE", "1, 'J2', 'junctions', 101.0, 3.0, 4.0", "2, 'O1', 'outfalls', 90.0, NULL, NULL", "3, 'S1', 'storage', 95.0, NULL, NULL"))
def read_nodes(spark, sf_dir) -> DataFrame:
    return files.sewer_network(spark, _written(spark, SEWER))[0]


@query("read_links", _values("src, dst, length, kind", "0::BIGINT, 1::BIGINT, 120.0::DOUBLE, 'conduits'", "1, 2, 50.0, 'pumps'"))
def read_links(spark, sf_dir) -> DataFrame:
    """Links by node numbers: the edge array."""
    return files.sewer_network(spark, _written(spark, SEWER))[1].select("src", "dst", "length", "kind")


@query("read_outlets", _values("subcatchment, outlet", "'A', 'J1'", "'B', 'J2'"))
def read_outlets(spark, sf_dir) -> DataFrame:
    return files.outlets(spark, _written(spark, SEWER))


@query("read_meters", _values("meter, node", "'M1', 'J2'", "'M3', 'O1'"))
def read_meters(spark, sf_dir) -> DataFrame:
    return files.meter_nodes(spark, _written(spark, "Meter,Node\nM1,J1\nM2,\nM1,J2\nM3,O1\n"))


@query("read_observations", _values("minute, meter, node, unit, value", "15::BIGINT, 'M1', 'J1', 'cfs', 1.5::DOUBLE", "30, 'M1', 'J1', 'cfs', 2.5", "15, 'M3', 'J2', 'cfs', 4.0", "30, 'M3', 'J2', 'cfs', NULL"))
def read_observations(spark, sf_dir) -> DataFrame:
    got = files.observations(spark, _written(spark, OBSERVATIONS))
    return got.select(F.minute("ts").cast("long").alias("minute"), "meter", "node", "unit", "value")


@query("read_top_rain", _values("day, rain", "'2024-01-04', 0.9::DOUBLE"))
def read_top_rain(spark, sf_dir) -> DataFrame:
    return files.top_rain(spark, _written(spark, RAIN)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "rain")


@query("read_named_columns", _values("name, value, n", "'lon', -80.5::DOUBLE, 1::BIGINT", "'lon', -81.0, 1", "'lon', -82.25, 1", "'pm', 12.0, 1", "'pm', 3.5, 1", "'pm', NULL, 1"))
def read_named_columns(spark, sf_dir) -> DataFrame:
    return files.named_columns(spark, _written(spark, NAMED)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("written_results", "SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS n, round(sum(n_nationkey), 3)::DOUBLE AS total FROM nation GROUP BY 1")
def written_results(spark, sf_dir) -> DataFrame:
    """The sink, partitioned by region, read again."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("double").alias("estimate"))
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-results-{uuid.uuid4().hex}"
    files.write_results(nations, path, ["region"])
    return spark.read.parquet(path).groupBy(F.col("region").cast("long").alias("region")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("estimate"), 3).alias("total"))


@query("read_model_output", "SELECT n_nationkey::BIGINT AS node, (n_nationkey % 24)::BIGINT AS hour, (n_nationkey * 0.5)::DOUBLE AS value FROM nation")
def read_model_output(spark, sf_dir) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("node"))
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-results-{uuid.uuid4().hex}"
    files.write_results(n.select("node", F.timestamp_seconds(F.lit(1704067200) + F.col("node") % 24 * 3600).alias("ts"), (F.col("node") * 0.5).alias("value")), path)
    return files.model_output(spark, path).select("node", F.expr("(unix_seconds(ts) - 1704067200) DIV 3600").alias("hour"), "value")
