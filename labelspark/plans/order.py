"""Positions, prefixes and exact-size random cuts without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.functions.hashing import hash_hex
from labelspark.plans.joins import salted_join
from labelspark.session import settle

# Prefix of a hash key used as its coarse bucket: 16**4 buckets of equal size.
BUCKET_DIGITS = 4
# Above this, a prefix is cut by dense position instead of a top-n heap.
TOP_N_LIMIT = 100_000


def number_rows(df: DataFrame, order_by: Sequence[Column | str], name: str = "ord") -> DataFrame:
    """Dense 0-based position in a total order.

    A range-partitioned sort is written once with (partition, place in
    partition); the start of each partition is a running count over one row per
    sort partition. No task ever sees more than its own range.
    """
    placed = settle(
        df.orderBy(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_id", F.monotonically_increasing_id()),
        "numbered",
    )
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    starts = starts.withColumn(
        "_start", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ).select("_part", "_first", F.coalesce("_start", F.lit(0)).alias("_start"))
    # one row per sort partition: bounded by spark.sql.shuffle.partitions
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_id") - F.col("_first"))
        .drop("_part", "_id", "_first", "_start")
    )


def number_rows_within(
    df: DataFrame, group: str, order_by: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """Dense 1-based rank inside each group, for groups too big for one task."""
    numbered = number_rows(df, [group, *order_by], "_pos")
    first = numbered.groupBy(group).agg(F.min("_pos").alias("_first"))
    return (
        salted_join(numbered, first, [group], ["_pos"])
        .withColumn(name, F.col("_pos") - F.col("_first") + 1)
        .drop("_pos", "_first")
    )


def first_rows(df: DataFrame, n: int, order_by: str = "ord") -> DataFrame:
    """The first ``n`` rows by ``order_by``, in that order."""
    if n <= TOP_N_LIMIT:
        return df.orderBy(order_by).limit(n)
    return number_rows(df, [order_by], "_pos").filter(F.col("_pos") < n).drop("_pos").orderBy(order_by)


Size = Callable[[Column], Column]


def nth_keys(df: DataFrame, key: str, tie: str, ns: Sequence[Size]) -> Column:
    """The n-th smallest (key, tie) for each n, as a struct c0, c1, … of structs.

    Each n is a function of the row count. Pass one counts rows per key prefix.
    Pass two ranks only the rows of the buckets the answers lie in, 1/65536 of
    the data each for a hash key.
    """
    bucket = F.substring(F.col(key), 1, BUCKET_DIGITS)
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    running = counts.withColumn("_upto", F.sum("_n").over(W.orderBy("_bucket"))).withColumn(
        "_total", F.sum("_n").over(W.partitionBy())
    )
    wants = F.array(*[F.struct(F.lit(i).alias("i"), n(F.col("_total")).cast("bigint").alias("want")) for i, n in enumerate(ns)])
    edges = (
        running.select("_bucket", "_n", "_upto", F.explode(wants).alias("_w"))
        .filter((F.col("_upto") - F.col("_n") < F.col("_w.want")) & (F.col("_w.want") <= F.col("_upto")))
        .select("_bucket", F.col("_w.i").alias("_i"), (F.col("_w.want") - F.col("_upto") + F.col("_n")).alias("_skip"))
    )
    # edges holds one row per n at most
    place = F.row_number().over(W.partitionBy("_i", "_bucket").orderBy(key, tie))
    found = (
        df.select(key, tie, bucket.alias("_bucket"))
        .join(F.broadcast(edges), "_bucket")
        .withColumn("_rn", place)
        .filter(F.col("_rn") == F.col("_skip"))
    )
    me = F.struct(F.col(key).alias("key"), F.col(tie).alias("tie"))
    cuts = [F.max(F.when(F.col("_i") == i, me)).alias(f"c{i}") for i in range(len(ns))]
    return found.agg(*cuts).select(F.struct(*[f"c{i}" for i in range(len(ns))]).alias("cuts")).scalar()


def cut_by_hash(df: DataFrame, row_id: str, seed: str, cuts: Sequence[tuple[str, Size]], rest: str) -> DataFrame:
    """Assign ``split``: rows in hash order fill each cut in turn, then ``rest``.

    Each cut gives the *cumulative* size wanted as a function of the row count.
    Sizes are exact; the rows themselves are never shuffled, only compared with
    the boundaries. ``df`` is read three times (twice for ``row_id`` only): pass
    a stored table.
    """
    keyed = df.withColumn("_key", hash_hex(seed, row_id))
    boundaries = nth_keys(keyed.select("_key", row_id), "_key", row_id, [size for _, size in cuts])
    me = F.struct(F.col("_key").alias("key"), F.col(row_id).alias("tie"))
    split = F.lit(rest)
    for i, (name, _) in reversed(list(enumerate(cuts))):
        split = F.when(me <= F.col(f"_cuts.c{i}"), F.lit(name)).otherwise(split)
    return keyed.withColumn("_cuts", boundaries).withColumn("split", split).drop("_key", "_cuts")


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str],
                    spread_by: Sequence[str]) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name.

    The built-in ``percentile`` keeps a group's values in one task. Here all
    rows are numbered by (group, value) over range partitions, which split a
    hot group or a hot value, and only the wanted positions are looked up.
    """
    numbered = number_rows(
        df.select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(*spread_by).alias("_h")).filter(
            F.col("_v").isNotNull()
        ),
        [*by, "_v", "_h"],
        "_pos",
    )
    groups = numbered.groupBy(*by).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    wanted = groups.select(
        *by,
        "_start",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(q)).alias("at"))
                    for name, q in quantiles.items()
                ]
            )
        ).alias("_q"),
    ).select(*by, "_start", "_q.name", "_q.at")
    ends = wanted.select(
        F.col("name"),
        (F.col("at") - F.floor("at")).alias("_part"),
        F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("_off"),
        F.col("_start"),
        F.col("at"),
    ).withColumn("_pos", F.col("_start") + F.col("_off")).distinct()
    found = numbered.join(ends, "_pos")
    low, high = F.col("_off") == F.floor("at"), F.col("_off") == F.ceil("at")
    columns = []
    for name in quantiles:
        mine = F.col("name") == name
        a = F.max(F.when(mine & low, F.col("_v")))
        b = F.max(F.when(mine & high, F.col("_v")))
        t = F.max(F.when(mine, F.col("_part")))
        columns.append((a + (b - a) * t).alias(name))
    return found.groupBy(*by).agg(*columns)
