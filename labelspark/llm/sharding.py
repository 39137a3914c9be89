"""A uniform shuffle into shards of exact size, in DataFrame operations.

How many rows of each block go to each shard is drawn from the multivariate
hypergeometric law, as in a uniformly random permutation. Rows are permuted
inside their block, dealt out by those counts, exchanged, and permuted again
inside their shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.session import settle

# Rows of one input partition are cut into blocks of at most this many, so that
# no window ever holds more.
BLOCK_BITS = 16
# numpy draws from the hypergeometric law for fewer rows than this.
SAMPLER_ROWS = 1_000_000_000


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """(blocks, shards) counts with the given row and column sums, distributed as
    for a uniformly random permutation of all rows."""
    rng = np.random.default_rng(seed)
    left = np.array(shards, np.int64)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, size in enumerate(blocks):
        need, rest = size, int(left.sum())
        if rest >= SAMPLER_ROWS:
            # beyond numpy's sampler: the law itself, by drawing the rows; a block
            # has few of them
            drawn = rng.choice(rest, need, replace=False, shuffle=False)
            out[b] = np.bincount(np.searchsorted(np.cumsum(left), drawn, "right"), minlength=len(shards))
        else:
            for s in range(len(shards)):
                rest -= int(left[s])
                out[b, s] = rng.hypergeometric(int(left[s]), rest, need) if need and left[s] else 0
                need -= int(out[b, s])
        left -= out[b]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart; the larger shards come first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(docs: DataFrame, columns: list[str], shards: int = 16, seed: int = 1) -> DataFrame:
    """``columns`` of ``docs`` with ``shard`` (0 to shards - 1) and ``slot``
    (gapless from 0 within a shard), in uniformly random order.

    Shard sizes differ by one row at most, whatever the rows hold: nulls, ties
    and repeated rows are dealt like any others, because a row is identified by
    its place in the input. That place is fixed by writing ``columns`` to the
    shared folder first; the rest follows from it and ``seed`` alone, so lost
    tasks are redone alike. An empty input gives no rows. Fewer rows than shards
    leave the last shards empty.
    """
    placed = settle(docs.select(*columns, F.monotonically_increasing_id().alias("_row")), "rows")
    # the row's number inside its partition fills the lower 33 bits
    placed = placed.withColumn("_block", F.shiftright("_row", BLOCK_BITS))
    blocks = sorted((r[0], r[1]) for r in placed.groupBy("_block").count().collect())
    total = sum(n for _, n in blocks)
    matrix = communication_matrix([n for _, n in blocks], shard_sizes(total, shards), seed)
    upto = np.cumsum(matrix, axis=1).tolist()
    counts = docs.sparkSession.createDataFrame(
        [(b, row) for (b, _), row in zip(blocks, upto)], "_block bigint, _upto array<bigint>"
    )
    hashed = lambda salt: F.xxhash64("_row", F.lit(f"{seed}-{salt}"))
    local = F.row_number().over(W.partitionBy("_block").orderBy(hashed("first"), "_row"))
    dealt = placed.withColumn("_rank", local).join(counts, "_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("_upto", lambda n: n < F.col("_rank"))).cast("int"))
    # the second permutation: by a hash, in ranges of it small enough for a window
    bits = max(0, int(np.ceil(np.log2(max(1, total / shards / 2 ** (BLOCK_BITS - 1))))))
    key = hashed("second")
    dealt = dealt.withColumn("_key", key).withColumn(
        "_range", F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
    )
    sizes = dealt.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_range")) - F.col("_n")
    sizes = sizes.select("shard", "_range", before.alias("_before"))
    # order of the signed hash inside a range is the order of its lower bits
    place = F.row_number().over(W.partitionBy("shard", "_range").orderBy("_key", "_row"))
    ranked = dealt.withColumn("_place", place).join(sizes, ["shard", "_range"])
    return ranked.select(*columns, "shard", (F.col("_before") + F.col("_place") - 1).cast("bigint").alias("slot"))
