"""Joins that keep working when one key holds a large share of the rows.

Nothing here forces a broadcast of a table that grows with the data: Spark
broadcasts below its own byte threshold, measured from file statistics or, with
AQE, from finished shuffles. Salting makes the other way safe under skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys whose weight is at least 1/HOT_KEYS of the total; by counting there are
# never more than HOT_KEYS of them, which bounds the only hinted broadcast.
HOT_KEYS = 1000
# Salts of a key that held all rows, per shuffle task.
SALTS_PER_TASK = 16
# Keys that are looked up without a shuffle hold at least 1/FREQUENT_KEYS of the
# weight and have at most KEY_BYTES, which bounds their broadcast.
FREQUENT_KEYS, KEY_BYTES = 2**20, 64


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Join where ``left`` may be skewed on ``on``; ``right`` is copied per salt.

    ``spread_by`` names left columns that differ between rows of one hot key.
    Exact for inner, left, left_semi and left_anti: each left row meets exactly
    one copy of each right row.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join cannot do {how!r}")
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(copies, [*on, "_salt"], how).drop("_salt")


def hot_salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    weight: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """As ``salted_join`` with one right row per key and a known key weight.

    Only hot keys are copied, in proportion to their weight: no salt of a key holds
    more than a sixteenth of a shuffle task's even share, and all copies together are
    at most sixteen per task and one per hot key. A long tail of rare keys is shuffled
    once.
    ``weight`` is a right column holding (about) the number of left rows per key.
    ``right`` is read three times: pass a stored table.
    """
    total = right.agg(F.sum(weight)).scalar()
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col(weight) / total * F.lit(SALTS_PER_TASK * tasks)).cast("int")
    right_n = right.withColumn(
        "_salts", F.when(F.col(weight) * F.lit(hot_keys) >= total, F.greatest(salts, F.lit(1))).otherwise(F.lit(1))
    )
    hot = right_n.filter(F.col("_salts") > 1).select(on, "_salts")
    copies = right_n.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_salts"), F.lit(1))).cast("int"),
    )
    return marked.drop("_salts").join(copies, [on, "_salt"], how).drop("_salt")


def frequent_join(left: DataFrame, right: DataFrame, on: str, weight: str, frequent_keys: int = FREQUENT_KEYS) -> DataFrame:
    """Inner join with one narrow right row per key and a known key weight; only
    rows of rare keys are shuffled.

    Frequent keys, never more than ``frequent_keys`` by counting, are broadcast with
    their right rows. In text they are most of the rows, and no shuffled key is hot.
    ``weight`` is as in ``hot_salted_join``. Both sides are read several times: pass
    stored tables.
    """
    total = right.agg(F.sum(weight)).scalar()
    heavy = (F.col(weight) * F.lit(frequent_keys) >= total) & (F.octet_length(F.col(on).cast("string")) <= KEY_BYTES)
    heavy = F.coalesce(heavy, F.lit(False))
    frequent, rare = right.filter(heavy), right.filter(~heavy)
    met = left.join(F.broadcast(frequent), on)
    rest = left.join(F.broadcast(frequent.select(on)), on, "left_anti").join(rare, on)
    return met.unionByName(rest)
