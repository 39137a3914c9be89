"""Label vocabulary, counts, encoding, membership and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.text import let, opened
from labelspark.plans.joins import hot_salted_join, salted_join
from labelspark.plans.order import number_rows, number_rows_within
from labelspark.session import settle

# Bucket borders and the largest label list that is kept.
HEAD_FROM = 100
MEDIUM_FROM = 20
MAX_LABELS = 20
UNLABELLED = "-1"
# Most copies of one row made in one place.
COPY_BLOCK = 10_000


def explode_labels(df: DataFrame, *keep: str, labels: str = "labels") -> DataFrame:
    """One row per label occurrence."""
    return df.select(*keep, F.explode(labels).alias("label"))


def label_counts(long: DataFrame, *by: str) -> DataFrame:
    """Occurrences per label; a label repeated in a row counts again."""
    return long.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def label_shares(counts: DataFrame, *by: str) -> DataFrame:
    """Counts divided by their sum, per group if asked."""
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        # a group may hold most labels: spread it
        joined = salted_join(counts, totals, by, ["label"])
        return joined.withColumn("freq", F.col("n").cast("double") / F.col("_total")).drop("_total")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("freq", F.col("n").cast("double") / total)


def label_ranks(counts: DataFrame, by: str | None = None) -> DataFrame:
    """1-based rank by descending count; equal counts go by label."""
    order = [F.desc("n"), F.asc("label")]
    if by:
        return number_rows_within(counts, by, order, "rank")
    return number_rows(counts, order, "_pos").withColumn("rank", F.col("_pos") + 1).drop("_pos")


def top_labels(counts: DataFrame, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), "label").limit(n)


def vocabulary(long: DataFrame, drop_unlabelled: bool = True) -> DataFrame:
    """(label, label_id) with dense ids in code-point order."""
    labels = long.select("label").distinct()
    if drop_unlabelled:
        labels = labels.filter(F.col("label") != UNLABELLED)
    vocab = number_rows(labels, ["label"], "label_id")
    if vocab.limit(2).count() < 2:
        raise ValueError("a vocabulary needs more than one label")
    return vocab


def missing_from_train(train: DataFrame, other: DataFrame) -> DataFrame:
    """Labels of ``other`` that train never shows."""
    return other.select("label").distinct().join(train.select("label").distinct(), "label", "left_anti")


def encode_labels(long: DataFrame, vocab: DataFrame, row_id: str, unknown: str = "error") -> DataFrame:
    """(row_id, label_id), each pair once. ``unknown``: "error" or "ignore"."""
    pairs = long.select(row_id, "label").distinct()
    if unknown == "ignore":
        return salted_join(pairs, vocab, ["label"], [row_id]).select(row_id, "label_id")
    found = salted_join(pairs, vocab, ["label"], [row_id], "left")
    checked = F.when(F.col("label_id").isNotNull(), F.col("label_id")).otherwise(
        F.raise_error(F.concat(F.lit("label not in vocabulary: "), F.col("label"))).cast("bigint")
    )
    return found.select(row_id, checked.alias("label_id"))


def label_ids(encoded: DataFrame, row_id: str) -> DataFrame:
    """(row_id, label_ids) sorted. A row has at most one entry per class."""
    return encoded.groupBy(row_id).agg(F.array_sort(F.collect_set("label_id")).alias("label_ids"))


def multi_hot(ids: Column, n_classes: Column | int) -> Column:
    """Dense 0/1 array of the ids present; ids that are no class are left out.

    Runs of zeros between the sorted ids are joined, so a row costs its classes plus
    its ids, not their product.
    """
    n = (F.lit(n_classes) if isinstance(n_classes, int) else n_classes).cast("int")

    def of(size: Column) -> Column:
        known = F.array_sort(F.array_distinct(F.filter(ids.cast("array<int>"), lambda i: (i >= 0) & (i < size))))
        before = F.concat(F.array(F.lit(-1)), known)
        after = F.concat(known, F.array(size))
        zeros = F.zip_with(before, after, lambda a, b: F.array_repeat(F.lit(0), b - a - 1))
        ones = F.transform(F.sequence(F.lit(0), F.size(known)), lambda i: F.when(i < F.size(known), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
        return F.flatten(F.zip_with(zeros, ones, lambda z, o: F.concat(z, o)))

    return let(n, of)


def decode_multi_hot(hot: Column, names: Column) -> Column:
    """Names of the set positions; ``names`` is an array in id order."""
    pairs = F.arrays_zip(hot.alias("hot"), names.alias("name"))
    return F.transform(F.filter(pairs, lambda p: p["hot"] == 1), lambda p: p["name"])


def encode_single(df: DataFrame, vocab: DataFrame, label: str, row_id: str) -> DataFrame:
    """Single label to id; the unlabelled mark passes through as -1."""
    renamed = vocab.withColumnRenamed("label", label)
    found = salted_join(df, renamed, [label], [row_id], "left")
    return found.withColumn(
        "label_id", F.when(F.col(label) == UNLABELLED, F.lit(-1)).otherwise(F.col("label_id"))
    )


def buckets(counts: DataFrame, head_from: int = HEAD_FROM, medium_from: int = MEDIUM_FROM,
            compat: bool = False) -> DataFrame:
    """Head, medium and tail labels by count.

    ``compat`` also lists every head label under tail, as a missing "else if"
    once did.
    """
    bucket = (
        F.when(F.col("n") >= head_from, F.lit("head"))
        .when(F.col("n") >= medium_from, F.lit("medium"))
        .otherwise(F.lit("tail"))
    )
    if not compat:
        return counts.withColumn("bucket", bucket)
    both = F.when(F.col("n") >= head_from, F.array(F.lit("head"), F.lit("tail"))).otherwise(F.array(bucket))
    return counts.withColumn("bucket", F.explode(both))


def rows_by_bucket(long: DataFrame, bucketed: DataFrame, row_id: str, *keep: str, mode: str = "any") -> DataFrame:
    """(row_id, keep…, bucket): rows with any (or only) labels of a bucket."""
    if mode not in {"any", "all"}:
        raise ValueError(f"mode must be any or all, not {mode!r}")
    rows = long.select(row_id, *keep, "label").distinct()
    if mode == "any":
        tagged = salted_join(rows, bucketed.select("label", "bucket"), ["label"], [row_id])
        return tagged.select(row_id, *keep, "bucket").distinct()
    per_label = bucketed.groupBy("label").agg(F.collect_set("bucket").alias("in_buckets"))
    tagged = salted_join(rows, per_label, ["label"], [row_id], "left")
    names = ["head", "medium", "tail"]
    flags = [
        F.every(F.coalesce(F.array_contains("in_buckets", b), F.lit(False))).alias(b) for b in names
    ]
    wide = tagged.groupBy(row_id, *keep).agg(*flags)
    kept = F.filter(F.array(*[F.when(F.col(b), F.lit(b)) for b in names]), lambda b: b.isNotNull())
    return opened(wide, kept, "bucket", row_id, *keep)


def bucket_shares(bucketed: DataFrame) -> DataFrame:
    """Label frequency renormalised inside its bucket."""
    return label_shares(bucketed, "bucket")


def valid_label_rows(df: DataFrame, valid: DataFrame, row_id: str, labels: str = "labels",
                     max_labels: int = MAX_LABELS) -> DataFrame:
    """Rows with at most ``max_labels`` labels, all of them known codes.

    ``valid`` has column ``code``. Rows without labels, null or empty, pass.
    """
    short = df.filter(F.coalesce(F.size(labels), F.lit(0)) <= max_labels)
    codes = valid.select(F.col("code").alias("label")).distinct()
    pairs = opened(short, F.array_distinct(labels), "label", row_id)
    bad = salted_join(pairs, codes, ["label"], [row_id], "left_anti").select(row_id).distinct()
    return short.join(bad, row_id, "left_anti")


def upsample(df: DataFrame, row_id: str, labels: str = "labels", target: int | None = None) -> DataFrame:
    """Repeat each row floor(target / count of its rarest label) times, once at least.

    ``target`` defaults to the largest label count. Adds ``copy`` from 1. Rows
    repeated more than COPY_BLOCK times are cut into blocks that are spread over
    tasks before they are opened, so one row with a very rare label is not one
    task's work.
    """
    long = df.select(row_id, F.explode(labels).alias("label"))
    # one row per label, used for the target, for hot labels and as the lookup
    counts = settle(label_counts(long), "label-counts")
    goal = F.lit(target) if target is not None else counts.agg(F.max("n")).scalar()
    rarest = hot_salted_join(long, counts, "label", "n", [row_id]).groupBy(row_id).agg(F.min("n").alias("_min"))
    repeats = rarest.select(row_id, F.floor(goal / F.col("_min")).alias("_copies")).filter("_copies > 1")
    repeats = settle(repeats, "copies")
    joined = df.join(repeats, row_id, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    few = joined.filter(F.col("_copies") <= COPY_BLOCK).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPY_BLOCK)))
    many = df.join(repeats.filter(F.col("_copies") > COPY_BLOCK), row_id).withColumn("_block", blocks)
    last = F.least((F.col("_block") + 1) * COPY_BLOCK, F.col("_copies"))
    many = many.repartition(row_id, "_block").withColumn(
        "copy", F.explode(F.sequence(F.col("_block") * COPY_BLOCK + 1, last))
    )
    return few.drop("_copies").unionByName(many.drop("_copies", "_block"))
