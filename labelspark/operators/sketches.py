"""Summaries that are stored once and added up later, and resampled intervals.

A sketch column holds what a group's rows say about distinct values or quantiles in
a few kilobytes. Sketches of finer groups add up to those of coarser ones, so a
roll-up reads the small table and not the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.hashing import hash_hex

# Standard error of a distinct count: 1.04 / sqrt(2 ** DISTINCT_BITS), 0.8 %.
DISTINCT_BITS = 14
# Rank error of a quantile with 99 % confidence: 0.4 % for this many kept items.
QUANTILE_ITEMS = 800
REPLICATES = 40
# Cumulative Poisson(1) law in steps of 2**-32: fixed values, e**-1 times partial
# sums of 1 / k!, rounded down. A draw at or above the k-th one weighs more than k.
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817)


def sketches(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """One row a group: n_rows, and a sketch column for each value, ``distinct_<v>``
    or ``quantiles_<v>``. Nulls are left out of sketches. Built map-side: each task sends
    one row a group, however many rows a group has."""
    found = [F.hll_sketch_agg(F.col(v).cast("string"), F.lit(DISTINCT_BITS)).alias(f"distinct_{v}") for v in distinct]
    found += [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(QUANTILE_ITEMS)).alias(f"quantiles_{v}") for v in quantiles]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *found)


def rolled_up(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    kinds = {"distinct_": lambda c: F.hll_union_agg(c), "quantiles_": lambda c: F.kll_merge_agg_double(c)}
    found = [
        merge(F.col(c)).alias(c) for c in stored.columns for start, merge in kinds.items() if c.startswith(start)
    ]
    return stored.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *found)


def every_level(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups of all of ``by``, of its first columns, down to one of all rows; a
    column that a level does not have is null."""
    kinds = {c: stored.schema[c].dataType.simpleString() for c in by}
    out = rolled_up(stored, by)
    for n in range(len(by) - 1, -1, -1):
        level = rolled_up(stored, by[:n])
        out = out.unionByName(level.withColumns({c: F.lit(None).cast(kinds[c]) for c in by[n:]}))
    return out


def distinct_count(value: str) -> Column:
    return F.hll_sketch_estimate(f"distinct_{value}").alias(f"n_{value}")


def quantile(value: str, share: float) -> Column:
    """A value whose rank in its group is close to ``share``."""
    return F.kll_sketch_get_quantile_double(F.col(f"quantiles_{value}"), F.lit(share))


def sketched_summary(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """n, mean, population deviation and quantiles of each group in one pass, without
    a sort: quantiles are close in rank, not exact (see ``metrics.latency_summary``)."""
    marks = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_ITEMS)).alias(f"quantiles_{value}")
    found = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), marks
    )
    return found.select(*by, "n", "mean", "deviation", *[quantile(value, q).alias(name) for name, q in quantiles.items()])


def rank_share(df: DataFrame, value: str, marks: DataFrame, mark: str, by: Sequence[str]) -> DataFrame:
    """(by…, below, upto): shares of a group's values below a mark and not above it,
    exactly. ``marks`` has one row a group."""
    met = df.filter(F.col(value).isNotNull()).join(F.broadcast(marks.select(*by, F.col(mark).alias("_mark"))), list(by))
    return met.groupBy(*by).agg(
        F.avg((F.col(value) < F.col("_mark")).cast("double")).alias("below"),
        F.avg((F.col(value) <= F.col("_mark")).cast("double")).alias("upto"),
    )


def _weight(digits: Column) -> Column:
    """The Poisson(1) number of eight hex digits, which sort as the numbers they are."""
    cuts = [f"{cut:08x}" for cut in POISSON]
    found = F.when(digits < cuts[0], 0)
    for k, cut in enumerate(cuts[1:], 1):
        found = found.when(digits < cut, k)
    return found.otherwise(len(cuts))


def poisson_weights(row_id: Column | str, replicates: int, seed: str = "bootstrap") -> Column:
    """``replicates`` Poisson(1) numbers that depend on the row's id alone.

    One hash gives four of them: 32 bits each.
    """
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    parts = []
    for block in range(-(-replicates // 4)):
        hashed = F.array(hash_hex(seed, F.lit(block), row))
        parts.append(F.flatten(F.transform(hashed, lambda h: F.array(*[_weight(F.substring(h, 8 * j + 1, 8)) for j in range(4)]))))
    return F.slice(F.concat(*parts), 1, replicates)


def mean_intervals(df: DataFrame, value: str, row_id: str, by: Sequence[str], replicates: int = REPLICATES,
                   level: float = 0.9, seed: str = "bootstrap") -> DataFrame:
    """(by…, mean, low, high): the mean of each group and its percentile interval
    over resampled tables.

    In a replicate a row counts as often as a Poisson(1) number says, which is drawn
    from its id: all replicates come out of one pass, and a task that is run again draws
    the same. The ends are order statistics, the value at or above the wanted share. Null
    values are left out. A replicate without any row of a group says nothing about it.
    """
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1)))
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), row.alias("_row"))
    # four numbers come from one hash, as in ``poisson_weights``; a line for each hash, not for each replicate
    hashed = known.select(*by, "_v", "_row", blocks.alias("_block")).select(*by, "_v", "_block", hash_hex(seed, "_block", "_row").alias("_h"))
    digits = hashed.select(*by, "_v", "_block", *[F.substring("_h", 8 * j + 1, 8).alias(f"_h{j}") for j in range(4)])
    drawn = digits.select(*by, "_v", "_block", *[_weight(F.col(f"_h{j}")).alias(f"_k{j}") for j in range(4)])
    # a row for each group and four replicates from every task, whatever a group's size
    added = [F.sum(F.col(f"_k{j}") * F.col("_v")).alias(f"_s{j}") for j in range(4)] + [F.sum(f"_k{j}").alias(f"_k{j}") for j in range(4)]
    fours = drawn.groupBy(*by, "_block").agg(*added, F.sum("_v").alias("_all"), F.count(F.lit(1)).alias("_n"))
    each = F.array(*[F.struct((4 * F.col("_block") + j).alias("_b"), F.col(f"_s{j}").alias("_s"), F.col(f"_k{j}").alias("_k")) for j in range(4)])
    sums = fours.select(*by, "_all", "_n", F.inline(each)).filter(F.col("_b") < replicates)
    means = F.array_sort(F.filter(F.collect_list(F.when(F.col("_k") > 0, F.col("_s") / F.col("_k"))), lambda m: m.isNotNull()))
    found = sums.groupBy(*by).agg(F.max(F.when(F.col("_b") == 0, F.col("_all") / F.col("_n"))).alias("mean"), means.alias("_means"))

    def end(share: float) -> Column:
        place = F.greatest(F.ceil(F.size("_means") * F.lit(share)), F.lit(1)).cast("int")
        return F.get("_means", place - 1)

    return found.select(*by, "mean", end((1 - level) / 2).alias("low"), end((1 + level) / 2).alias("high"))
