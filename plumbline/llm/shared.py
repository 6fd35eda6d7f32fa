"""Written tables in the cluster's shared folder, and small helpers for columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, local mode (tests) makes one; a cluster must name one that all its machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark removes the shuffle files of a finished execution, instead of whenever the driver collects its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, so that a lost executor costs no recomputation.

    Shuffle files go when the table is written; the table when ``discard`` gets it, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        df.write.parquet(path)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_plumbline_path"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``cut`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        if path := table.__dict__.pop("_plumbline_path", None):
            at, fs = _hadoop(table.sparkSession, path)
            fs.delete(at, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows on all cores where they come from fewer files than there are cores: one task reads all of a row group."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= n else rows.repartition(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Rows of an Arrow batch of texts; with Spark's own 10,000 some batches of long texts take much of a worker's memory.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch, unless the session has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names and nothing else, so that no other column can clash: ``only(df, a="long")``."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def beside(docs: DataFrame, judge, *used: str) -> DataFrame:
    """The columns of ``docs``, under their own names, of the rows of ``judge(docs)``.

    ``judge`` sees the columns ``used`` by those names and all others under names that clash with nothing.
    """
    names = docs.columns
    inside = [n.lower() if n.lower() in used else f"__{i}" for i, n in enumerate(names)]
    return judge(docs.toDF(*inside)).select(*inside).toDF(*names)


def append(docs: DataFrame, make, fields: str, text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with columns that ``make(texts)`` gives for an Arrow column of texts (and of the columns ``more``); they replace columns of the same name."""
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(fields)
    drop = {n.lower() for n in new.names}
    kept = [i for i, n in enumerate(docs.columns) if n.lower() not in drop]
    at = [n.lower() for n in docs.columns].index(text.lower())
    given = [docs.columns.index(n) for n in more]
    names = [docs.columns[i] for i in kept] + new.names
    schema = T.StructType([docs.schema.fields[i] for i in kept] + new.fields)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(make(batch.column(at), *(batch.column(i) for i in given))), names)

    return docs.mapInArrow(run, schema)
