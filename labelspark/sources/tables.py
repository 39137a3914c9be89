"""The test tables in the roles of labelled, scored and annotated data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.session import spread

SCORE_SCALE = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(row_id: str) -> Column:
    """Eight tenths train, one validation, one test, by the last digit."""
    digit = F.col(row_id) % 10
    return F.when(digit < 8, "train").when(digit == 8, "validation").otherwise("test")


def _brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def order_labels_long(spark: SparkSession, sf_dir: str, with_parts: bool = False) -> DataFrame:
    """(row_id, split, label), each pair once: the brands of an order.

    ``with_parts`` adds one rare label per part key.
    """
    label = F.col("p_brand")
    if with_parts:
        label = F.explode(F.array(label, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))))
    pairs = _brand_lines(spark, sf_dir).select("row_id", label.alias("label")).distinct()
    return pairs.select("row_id", split_of("row_id").alias("split"), "label")


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, split, labels): sorted brands per order.

    The set is built map-side and holds at most one entry per brand.
    """
    sets = _brand_lines(spark, sf_dir).groupBy("row_id").agg(F.array_sort(F.collect_set("p_brand")).alias("labels"))
    return sets.select("row_id", split_of("row_id").alias("split"), "labels")


def with_source(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``source``: the priority of the order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("source")
    )
    return df.join(orders, "row_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, lang, source), on all cores: text work outweighs the scan."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "source")
    return spread(docs, "row_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, source, split) from documents; the split follows the source."""
    digit = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 10
    split = F.when(digit < 8, "train").when(digit == 8, "validation").otherwise("test")
    return documents(spark, sf_dir).select("row_id", "text", "source", split.alias("split"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, source, split, labels): language plus quality and toxic marks."""
    docs = documents(spark, sf_dir)
    marks = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "row_id")
    found = F.array(
        F.col("lang"),
        F.when(F.col("quality") == 1, F.lit("quality")),
        F.when(F.col("toxic") == 1, F.lit("toxic")),
    )
    return docs.join(marks, "row_id", "left").select(
        "row_id",
        "text",
        "source",
        split_of("row_id").alias("split"),
        F.filter(found, lambda l: l.isNotNull()).alias("labels"),
    )


def logit(value: Column) -> Column:
    return value.cast("double") * SCORE_SCALE


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, split, embedding, truth_ids): embeddings stand for 64-class outputs."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        split_of("vec_id").alias("split"),
        "embedding",
        F.array(F.col("label").cast("bigint")).alias("truth_ids"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, split, logits, truth_ids) with one logit array per row."""
    raw = raw_scores(spark, sf_dir)
    return raw.select("row_id", "split", F.transform("embedding", logit).alias("logits"), "truth_ids")


def brand_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, description): brands and their first part type."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(
        F.min("p_type").alias("description")
    )


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("description")
    )
