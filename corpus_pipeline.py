"""A corpus pipeline of five stages over ``documents``; each works on all that its predecessor kept.

Counted as part of ``plumbline.llm``. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import decontaminate, jaccard_join, mixing, pii, quality_classifier
from plumbline.llm.shared import beside, cut, discard, documents

#: SQL can't express training and decoding of the models; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled rows that aren't held out, scores under 0.7.

    Null and empty texts are scored like any other. Rows are judged alone: those that repeat an id, or have none, stay or go by
    their own text. No rows give no rows.
    """
    forest = quality_classifier.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, lambda rows: quality_classifier.classify(rows, forest).where("predicted = 1"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of documents linked by 5-word shingles at 0.8 or more.

    Of rows that repeat a kept id the first by the other columns, in their order and nulls first, stays. Rows without id belong
    to no class: they are compared with nothing, and all stay. Null, empty and blank texts have no shingles: each is a class of
    its own. No rows give no rows.
    """
    classes = jaccard_join.jaccard_classes(docs, k=5, num=80, den=100)
    gone = cut(classes.where("component_id <> doc_id").select("doc_id").distinct())
    # Texts of ids that surely stay aren't shuffled.
    asked = F.coalesce(jaccard_join.maybe(docs, "doc_id", gone), F.lit(False))
    kept = docs.where(~asked).union(beside(docs.where(asked), lambda rows: rows.join(gone.hint("merge"), "doc_id", "left_anti"), "doc_id"))
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    # Rows of ids that surely stand once aren't sorted.
    again = F.coalesce(jaccard_join.maybe(kept, "doc_id", repeated), F.lit(False)) & F.col("doc_id").isNotNull()

    def first(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in rows.columns if c != "doc_id")))
        return rows.withColumn("__nth", nth).where("__nth = 1")

    return kept.where(~again).union(beside(kept.where(again), first, "doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a whole window of the benchmark (13 words hit), or of which a twentieth or more is hit.

    A long document with one passage goes too, though its share is small; a benchmark item of a few words alone removes a
    document only by its share. Null and empty texts have no words and stay. Rows are judged alone, by their own text. No rows
    give no rows.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return beside(docs, lambda rows: decontaminate.find_benchmark(rows, benchmark).where(f"NOT contaminated AND n_hit < {decontaminate.WIDTH}"), "text")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars counts what is left of a text that had some.

    Null and empty texts stay as they are. Rows, repeated or without id, are read alone. No rows give no rows.
    """

    def redacted(rows: DataFrame) -> DataFrame:
        found = pii.find_pii(rows, redact=True)
        return found.withColumn("n_chars", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("text").cast("long")))

    return beside(docs, redacted, "text", "n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture.

    Rows without a source are one class. Rows that repeat one another each have a place; null texts are rows like any other. No
    rows give no rows.
    """
    return mixing.mix(docs, mixing.QUERY_PARTS, mixing.QUERY_REST)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("personal data", private), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's table goes once the next is written. Odd rows: see the stages."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return made
        before, docs = docs, cut(made)
        discard(before)
