"""Dataset profiles: counts, lengths, imbalance, co-occurrence, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.functions import text as T
from labelspark.functions.scores import safe_ratio
from labelspark.operators.labels import explode_labels, label_counts

TOP_N = 5
# Subset kinds and the columns each keeps; the rest read "all".
SUBSETS = [("source", "split"), ("source",), ("split",), ()]


def _subset_copies(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Each (already aggregated) row once per grouping set, "all" where rolled up."""
    keys = F.array(
        *[
            F.struct(*[(F.col(c) if c in s else F.lit("all")).alias(c) for c in ("source", "split")])
            for s in sets
        ]
    )
    others = [c for c in df.columns if c not in {"source", "split"}]
    return df.select(F.explode(keys).alias("_k"), *others).select("_k.source", "_k.split", *others)


def dataset_profile(df: DataFrame, sets: list[tuple[str, ...]] | None = None, text: str = "text",
                    labels: str = "labels") -> DataFrame:
    """One row per subset: sizes, averages, imbalance and the top labels.

    Rows and labels are first summed per (source, split); the roll-ups add those
    sums, so no row of text is copied into several subsets.
    """
    sets = sets or [("source", "split")]
    row_sums = df.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(T.num_words(F.col(text))).alias("_words"),
        F.sum(F.size(labels).cast("bigint")).alias("_labels"),
    )
    per_set = _subset_copies(row_sums, sets).groupBy("source", "split").agg(
        F.sum("_rows").alias("num_examples"), F.sum("_words").alias("_words"), F.sum("_labels").alias("num_labels")
    )
    fine = label_counts(explode_labels(df, "source", "split", labels=labels), "source", "split")
    counts = _subset_copies(fine, sets).groupBy("source", "split", "label").agg(F.sum("n").alias("n"))
    label_stats = counts.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("num_unique_labels"), F.max("n").alias("_max"), F.min("n").alias("_min")
    )
    rank = F.row_number().over(W.partitionBy("source", "split").orderBy(F.desc("n"), "label"))
    # rank <= k is pushed below the shuffle as a per-task limit
    top = (
        counts.withColumn("_rank", rank)
        .filter(F.col("_rank") <= TOP_N)
        .groupBy("source", "split")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "label", "n"))).alias("_top"))
    )
    shown = F.transform("_top", lambda t: F.concat(t["label"], F.lit("("), t["n"].cast("string"), F.lit(")")))
    joined = per_set.join(label_stats, ["source", "split"], "left").join(top, ["source", "split"], "left")
    return joined.select(
        "source",
        "split",
        "num_examples",
        "num_labels",
        F.coalesce("num_unique_labels", F.lit(0)).alias("num_unique_labels"),
        F.coalesce(F.array_join(shown, ", "), F.lit("")).alias("top_labels"),
        safe_ratio(F.col("_words"), F.col("num_examples")).alias("avg_words"),
        safe_ratio(F.col("num_labels"), F.col("num_examples")).alias("avg_labels"),
        safe_ratio(F.col("num_labels"), F.col("num_unique_labels")).alias("avg_label_freq"),
        safe_ratio(F.col("_max"), F.col("_min")).alias("imbalance"),
    )


def histogram(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Row counts per whole value of ``value``."""
    return df.groupBy(*by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mean_labels_truncated(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.agg(F.floor(F.avg(F.size(labels))).cast("bigint").alias("mean_labels"))


def cooccurrence_pairs(df: DataFrame, *by: str, labels: str = "labels", compat: bool = False) -> DataFrame:
    """(label_a, label_b, n): two-label combinations inside each row.

    Equal label lists are counted first, so a frequent list is opened once with
    a weight. Opening is two nested generators: memory per row stays linear in
    its labels, and the pair counters are summed map-side. A list that repeats
    labels is counted by multiplicity, not by position.

    Pairs are stored sorted. ``compat`` counts only pairs that the row already
    lists in sorted order.
    """
    if compat:
        lists = df.groupBy(*by, F.col(labels).alias("_ls")).agg(F.count(F.lit(1)).alias("_w"))
        firsts = lists.select(*by, "_w", "_ls", F.posexplode_outer("_ls").alias("_i", "label_a"))
        rest = F.slice("_ls", F.col("_i") + 2, F.size("_ls"))
        pairs = firsts.select(*by, "_w", "label_a", F.explode_outer(rest).alias("label_b")).filter("label_a <= label_b")
        return pairs.groupBy(*by, "label_a", "label_b").agg(F.sum("_w").alias("n"))
    lists = df.groupBy(*by, F.array_sort(labels).alias("_ls")).agg(F.count(F.lit(1)).alias("_w"))
    distinct = F.array_distinct("_ls")
    last = F.size("_ls")
    repeats = F.transform(
        distinct,
        lambda l: F.struct(
            l.alias("label"),
            F.size(F.filter("_ls", lambda x: x == l)).cast("bigint").alias("m"),
        ),
    )
    single = F.transform(distinct, lambda l: F.struct(l.alias("label"), F.lit(1).cast("bigint").alias("m")))
    counted = lists.select(*by, "_w", F.when(last == F.size(distinct), single).otherwise(repeats).alias("_ls"))
    firsts = counted.select(*by, "_w", "_ls", F.posexplode_outer("_ls").alias("_i", "_a"))
    rest = F.slice("_ls", F.col("_i") + 1, F.size("_ls"))
    pairs = T.opened(firsts, rest, "_b", *by, "_w", "_a").select(
        *by,
        F.col("_a.label").alias("label_a"),
        F.col("_b.label").alias("label_b"),
        F.when(F.col("_a.label") == F.col("_b.label"), F.expr("_w * (_a.m * (_a.m - 1) div 2)"))
        .otherwise(F.col("_w") * F.col("_a.m") * F.col("_b.m"))
        .alias("_n"),
    )
    return pairs.filter("_n > 0").groupBy(*by, "label_a", "label_b").agg(F.sum("_n").alias("n"))


def cooccurrence_ratios(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pair(i, j) / count(j) in both directions; absent pairs are zero and left out."""
    both = pairs.select(F.col("label_a").alias("label_i"), F.col("label_b").alias("label_j"), "n").unionByName(
        pairs.filter("label_a <> label_b").select(
            F.col("label_b").alias("label_i"), F.col("label_a").alias("label_j"), "n"
        )
    )
    base = counts.select(F.col("label").alias("label_j"), F.col("n").alias("_count"))
    return both.join(base, "label_j").select(
        "label_i", "label_j", (F.col("n").cast("double") / F.col("_count")).alias("ratio")
    )


def label_coverage(long: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For split pairs (a, b): labels of b that a lacks, and their share of b.

    One pass: a label's row says in which splits it occurs.
    """
    names = sorted({s for pair in pairs for s in pair})
    flags = [F.max((F.col("split") == s).cast("int")).alias(s) for s in names]
    present = long.filter(F.col("split").isin(names)).groupBy("label").agg(*flags)
    sums = []
    for i, (a, b) in enumerate(pairs):
        sums += [
            F.sum(a).cast("bigint").alias(f"a{i}"),
            F.sum(b).cast("bigint").alias(f"b{i}"),
            F.sum(F.col(b) * (1 - F.col(a))).cast("bigint").alias(f"m{i}"),
        ]
    one = present.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("split_a"),
                F.lit(b).alias("split_b"),
                F.col(f"a{i}").alias("size_a"),
                F.col(f"b{i}").alias("size_b"),
                F.col(f"m{i}").alias("missing"),
                (safe_ratio(F.col(f"m{i}"), F.col(f"b{i}")) * 100).alias("pct"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("_r")).select("_r.*")
