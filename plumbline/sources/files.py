"""Readers of sewer-model input files, meter tables, observation tables, precipitation and PM2.5 text files, and a sink.

Files are read as text by Spark, so any store will do. Line numbers come with the whole file as one row: these files are
configuration-sized; long tables are read line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOW_LINKS = ("PUMPS", "ORIFICES", "WEIRS", "OUTLETS")
NODE_SECTIONS = ("JUNCTIONS", "STORAGE", "OUTFALLS")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of small files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return text


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, section, parts): words of each line that is no comment, under the last header before it, upper-cased."""
    rows = lines(spark, path).withColumn("line", F.trim("line"))
    header = F.when(F.col("line").rlike(r"^\[.*\]$"), F.upper(F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(header, ignorenulls=True).over(w)).where(header.isNull() & (F.col("line") != "") & ~F.col("line").startswith(";"))
    return rows.select("file", "line_no", "section", F.split("line", r"\s+").alias("parts"))


def _part(i: int) -> Column:
    return F.get("parts", F.lit(i))


def sewer_network(spark: SparkSession, path: str, link_length: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, name, kind, elev, x, y), numbered from 0 by name, and links (src, dst, src_name, dst_name, length, kind).

    Pumps, orifices, weirs and outlets get ``link_length``; ends of links that no section declares are nodes too.
    """
    rows = sections(spark, path)
    declared = rows.where(F.col("section").isin(*NODE_SECTIONS)).select(_part(0).alias("name"), F.lower("section").alias("kind"), _part(1).try_cast("double").alias("elev"))
    pipes = rows.where("section = 'CONDUITS'").select(_part(1).alias("src_name"), _part(2).alias("dst_name"), _part(3).try_cast("double").alias("length"), F.lit("conduits").alias("kind"))
    others = rows.where(F.col("section").isin(*FLOW_LINKS) & (F.size("parts") >= 3)).select(_part(1).alias("src_name"), _part(2).alias("dst_name"), F.lit(float(link_length)).alias("length"), F.lower("section").alias("kind"))
    links = pipes.union(others)
    names = declared.select("name").union(links.select("src_name")).union(links.select("dst_name")).distinct()
    at = rows.where("section = 'COORDINATES'").where(F.size("parts") >= 3).select(_part(0).alias("name"), _part(1).try_cast("double").alias("x"), _part(2).try_cast("double").alias("y"))
    one = declared.groupBy("name").agg(F.first("kind").alias("kind"), F.first("elev").alias("elev"))
    nodes = names.join(one, "name", "left").join(at.dropDuplicates(["name"]), "name", "left").withColumn("node", (F.row_number().over(Window.orderBy("name")) - 1).cast("long"))
    return nodes.select("node", "name", "kind", "elev", "x", "y"), edge_array(nodes, links)


def edge_array(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with node numbers; unknown ends and loops are left out."""
    src, dst = nodes.select(F.col("node").alias("src"), F.col("name").alias("src_name")), nodes.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    return links.join(src, "src_name").join(dst, "dst_name").where("src <> dst")


def outlets(spark: SparkSession, path: str) -> DataFrame:
    """(subcatchment, outlet)."""
    return sections(spark, path).where("section = 'SUBCATCHMENTS'").select(_part(0).alias("subcatchment"), _part(2).alias("outlet"))


def meter_nodes(spark: SparkSession, path: str, meter: str = "Meter", node: str = "Node") -> DataFrame:
    """(meter, node) of a table with a header; blanks are left out and a meter's last row counts."""
    rows = spark.read.csv(path, header=True).withColumn("__row", F.monotonically_increasing_id()).select(F.trim(meter).alias("meter"), F.trim(node).alias("node"), "__row")
    return rows.where("meter <> '' AND node <> ''").groupBy("meter").agg(F.max_by("node", "__row").alias("node"))


def observations(spark: SparkSession, path: str, kind: str | None = "flow", stamp: str = "M/d/yyyy H:m", header_rows: int = 4) -> DataFrame:
    """(ts, meter, node, type, unit, raw, value) of a wide table with rows of meter, node, type and unit on top; rows without a date are left out."""
    raw = spark.read.csv(path, header=False)
    head = [[(x or "").strip() for x in row] for row in raw.limit(header_rows).collect()]
    wide = [i for i in range(1, len(raw.columns)) if kind is None or head[2][i].lower() == kind.lower()]
    cells = F.array(*(F.struct(*(F.lit(head[r][i]).alias(n) for r, n in enumerate(("meter", "node", "type", "unit"))), F.col(raw.columns[i]).alias("raw")) for i in wide)) if wide else F.array().cast("array<struct<meter:string,node:string,type:string,unit:string,raw:string>>")
    long = raw.select(F.try_to_timestamp(F.trim(raw.columns[0]), F.lit(stamp)).alias("ts"), F.explode(cells).alias("c")).where("ts IS NOT NULL")
    return long.select("ts", "c.meter", "c.node", "c.type", "c.unit", "c.raw", F.col("c.raw").try_cast("double").alias("value"))


def top_rain(spark: SparkSession, path: str) -> DataFrame:
    """The line of the most rain (and latest time) in hourly text: (ts, rain); 900 and more mean missing."""
    at = F.regexp_extract("value", r"(\d{8} \d{2}:\d{2})\s+(-?[\d.]+)", 1)
    rows = spark.read.text(path).select(F.try_to_timestamp(at, F.lit("yyyyMMdd HH:mm")).alias("ts"), F.regexp_extract("value", r"(\d{8} \d{2}:\d{2})\s+(-?[\d.]+)", 2).try_cast("double").alias("rain"))
    return rows.where("ts IS NOT NULL AND rain < 900").agg(F.max(F.struct("rain", "ts")).alias("m")).select("m.ts", "m.rain")


def named_columns(spark: SparkSession, path: str, missing: float = -9998.0) -> DataFrame:
    """Text with a title, the number of columns, their names line by line, then rows by white space: (line_no, name, value); short rows are left out and values up to ``missing`` null.

    The file is read line by line; ``line_no`` grows with the line, but isn't dense.
    """
    rows = spark.read.text(path)
    n = int(rows.limit(2).collect()[1][0].split()[0])
    head = [r[0] for r in rows.limit(n + 2).collect()]
    names = [x.strip() for x in head[2:]]
    parts = rows.select(F.monotonically_increasing_id().alias("line_no"), "value").where(~F.col("value").isin(head)).select("line_no", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= n)
    long = parts.select("line_no", F.posexplode(F.slice("p", 1, n)).alias("i", "raw"))
    value = F.col("raw").try_cast("double")
    return long.select("line_no", F.element_at(F.array(*(F.lit(x) for x in names)), F.col("i") + 1).alias("name"), F.when(value > missing, value).alias("value"))


def model_output(spark: SparkSession, path: str) -> DataFrame:
    """A long table (node, ts, value) of model results, from Parquet; stands in for binary result files."""
    return spark.read.parquet(path).select("node", "ts", F.col("value").cast("double").alias("value"))


def write_results(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Estimates as Parquet."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)
