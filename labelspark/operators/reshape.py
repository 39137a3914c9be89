"""Splits, shuffles, batches and mixtures of whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.hashing import hash_hex
from labelspark.plans.order import TOP_N_LIMIT, cut_by_hash, first_rows, number_rows

# Default split sizes and the rows between two checkpoints.
HELD_OUT = 0.2
TEST_ROWS = 1000
BATCH_ROWS = 1024


def split_fraction(df: DataFrame, row_id: str, seed: str = "0", held_out: float = HELD_OUT) -> DataFrame:
    """train / validation / test: the held-out share is rounded up, then halved.

    Test takes the larger half of an odd pool.
    """
    pool = lambda n: F.ceil(n * F.lit(held_out))
    return cut_by_hash(
        df, row_id, seed, [("test", lambda n: F.ceil(pool(n) / 2)), ("validation", pool)], rest="train"
    )


def split_exact(df: DataFrame, row_id: str, seed: str = "0", test_rows: int = TEST_ROWS,
                valid_rows: int | None = None) -> DataFrame:
    """Exactly ``test_rows`` test rows; the rest is validation, or, with
    ``valid_rows``, validation of that size and train."""
    test = ("test", lambda n: F.least(F.lit(test_rows), n))
    if valid_rows is None:
        return cut_by_hash(df, row_id, seed, [test], rest="validation")
    both = ("validation", lambda n: F.least(F.lit(test_rows + valid_rows), n))
    return cut_by_hash(df, row_id, seed, [test, both], rest="train")


def shuffled(df: DataFrame, row_id: str, seed: str = "0", n: int | None = None) -> DataFrame:
    """Seeded order (range-partitioned), or its first ``n`` rows with ``n``, in
    that order for any ``n``."""
    keyed = df.withColumn("_key", hash_hex(seed, row_id))
    if n is None:
        return keyed.orderBy("_key", row_id).drop("_key")
    if n <= TOP_N_LIMIT:
        return keyed.orderBy("_key", row_id).limit(n).drop("_key")
    return (
        cut_by_hash(df, row_id, seed, [("in", lambda total: F.least(F.lit(n), total))], rest="out")
        .filter("split = 'in'")
        .drop("split")
        .withColumn("_key", hash_hex(seed, row_id))
        .orderBy("_key", row_id)
        .drop("_key")
    )


def with_batches(df: DataFrame, order_by: str, size: int = BATCH_ROWS) -> DataFrame:
    """``batch_id``: contiguous runs of ``size`` rows; the last may be short."""
    numbered = number_rows(df, [order_by], "_pos")
    return numbered.withColumn("batch_id", F.floor(F.col("_pos") / size)).drop("_pos")


def mixtures(train: DataFrame, extra: DataFrame, order_by: str) -> DataFrame:
    """All train rows plus the first min(S, int(m*T)) extra rows for each
    multiplier m in {0, 0.5, 1, 2, …, ceil(S/T)}; adds ``multiplier``.

    A row of ``extra`` at position p joins every m with int(m*T) > p, found by
    arithmetic instead of one filter per m.
    """
    t = train.agg(F.count(F.lit(1)).alias("t")).scalar()
    s = extra.agg(F.count(F.lit(1)).alias("s")).scalar()
    none = F.array().cast("array<double>")
    # "_top" is a column so that the sizes are looked up once
    base = train.withColumn("_top", F.ceil(s / t))
    whole = F.when(F.col("_top") >= 1, F.sequence(F.lit(1).cast("bigint"), F.col("_top")).cast("array<double>"))
    every = F.concat(F.array(F.lit(0.0), F.lit(0.5)), F.coalesce(whole, none))
    repeated = base.withColumn("multiplier", F.explode(every)).drop("_top")
    numbered = number_rows(extra, [order_by], "_pos").withColumn("_t", t).withColumn("_top", F.ceil(s / t))
    first = F.floor(F.col("_pos") / F.col("_t")) + 1
    half = F.when(F.floor(F.col("_t") * 0.5) > F.col("_pos"), F.array(F.lit(0.5)))
    later = F.when(first <= F.col("_top"), F.sequence(first, F.col("_top")).cast("array<double>"))
    wanted = F.concat(F.coalesce(half, none), F.coalesce(later, none))
    added = numbered.withColumn("multiplier", F.explode(wanted)).drop("_pos", "_t", "_top")
    return repeated.unionByName(added)


__all__ = [
    "first_rows",
    "mixtures",
    "shuffled",
    "split_exact",
    "split_fraction",
    "with_batches",
]
