"""Seeded sampling of codes and list items for synthetic prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.functions.hashing import hash_hex, hash_unit, uniform_int
from labelspark.plans.order import number_rows
from labelspark.session import settle

# Labels and list items per prompt.
MAX_LABELS = 5
N_CRITERIA = 3
# Fewest cells the weight is divided into to find a draw's code by equality.
MIN_CELLS = 4096


def code_intervals(freqs: DataFrame) -> DataFrame:
    """(code, rank, low, freq): consecutive stretches of weight in code order.

    Running sums are taken inside range partitions and shifted by the partition
    totals, as for row positions.
    """
    positive = freqs.filter(F.col("freq") > 0)
    placed = number_rows(positive, ["code"], "rank").withColumn("_chunk", F.floor(F.col("rank") / 100_000))
    chunks = placed.groupBy("_chunk").agg(F.sum("freq").alias("_sum"))
    chunks = chunks.withColumn(
        "_before",
        F.coalesce(F.sum("_sum").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
    )
    run = F.sum("freq").over(W.partitionBy("_chunk").orderBy("rank"))
    high = placed.join(chunks, "_chunk").withColumn("_high", F.col("_before") + run)
    return high.select("code", "rank", (F.col("_high") - F.col("freq")).alias("low"), "freq")


def _past(position: Column, taken: Column, start: str, size: Column | None = None) -> Column:
    """Move a position in what is left to its place among all, past each taken
    stretch (``taken`` is sorted) that begins at or before it."""
    step = (lambda t: t["freq"]) if size is None else (lambda t: size)
    return F.aggregate(taken, position, lambda at, t: F.when(at >= t[start], at + step(t)).otherwise(at))


def _draw(state: DataFrame, row_id: str, intervals: DataFrame, total: float, available: int, cells: int, number: int,
          seed: str) -> DataFrame:
    """One more code for each row that wants one.

    The draw is uniform over the weight not yet taken. Where rounding leaves it
    in no free stretch (weights 2**53 apart), a free code is taken by rank. Both
    are equality joins; rows that want nothing carry keys that match nothing.
    """
    u = hash_unit(hash_hex(seed, F.col(row_id), F.lit(number)))
    active = F.col("_want") > number
    nowhere = -1 - F.pmod(F.xxhash64(row_id), F.lit(1_000_000)).cast("int")
    cell = lambda c: F.least(F.floor(c / total * cells).cast("int"), F.lit(cells - 1))
    left = F.greatest(F.lit(total) - F.aggregate("_taken", F.lit(0.0), lambda s, t: s + t["freq"]), F.lit(0.0))
    found = state.withColumn("_v", _past(u * left, F.col("_taken"), "low"))
    listed = intervals.withColumn("_cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("freq")))))
    listed = listed.select("_cell", F.struct("low", "freq", "rank", "code").alias("_hit"))
    inside = (F.col("_v") >= F.col("_hit.low")) & (F.col("_v") < F.col("_hit.low") + F.col("_hit.freq"))
    found = found.withColumn("_at", F.when(active, cell(F.col("_v"))).otherwise(nowhere))
    found = found.join(listed, (F.col("_at") == F.col("_cell")) & inside, "left")
    missed = active & (F.col("_hit").isNull() | F.exists("_taken", lambda t: t["rank"] == F.col("_hit.rank")))
    by_rank = F.floor(u * F.lit(available - number)).cast("bigint")
    by_rank = _past(by_rank, F.array_sort(F.transform("_taken", lambda t: F.struct(t["rank"].alias("rank")))), "rank", F.lit(1))
    found = found.withColumn("_at", F.when(missed, by_rank).otherwise(nowhere.cast("bigint")))
    ranked = intervals.select(F.col("rank").alias("_rank"), F.struct("low", "freq", "rank", "code").alias("_other"))
    found = found.join(ranked, F.col("_at") == F.col("_rank"), "left")
    one = F.coalesce("_other", "_hit")
    return found.select(
        row_id,
        "_want",
        F.when(active, F.array_sort(F.concat("_taken", F.array(one)))).otherwise(F.col("_taken")).alias("_taken"),
        F.when(active, F.concat("_codes", F.array(one["code"]))).otherwise(F.col("_codes")).alias("_codes"),
    )


def sample_codes(rows: DataFrame, row_id: str, freqs: DataFrame, seed: str = "0", max_labels: int = MAX_LABELS,
                 weighted: bool = True) -> DataFrame:
    """(row_id, pos, code): 1..max_labels codes per row without replacement.

    Each code is drawn by frequency (or evenly) from those the row does not have
    yet, with a seeded number per row and place, so ``max_labels`` draws always
    do, however uneven the frequencies are.
    """
    table = freqs if weighted else freqs.withColumn("freq", F.lit(1.0))
    intervals = settle(code_intervals(table), "intervals")
    available, total = intervals.agg(F.count(F.lit(1)), F.max(F.col("low") + F.col("freq"))).first()
    if available == 0:
        raise ValueError("no code has a positive frequency")
    wanted = F.least(uniform_int(hash_hex(seed, F.col(row_id), F.lit("size")), 1, max_labels), F.lit(available))
    kind = f"array<struct<low: double, freq: double, rank: bigint, code: {intervals.schema['code'].dataType.simpleString()}>>"
    state = rows.select(
        row_id, wanted.alias("_want"), F.array().cast(kind).alias("_taken"), F.array().cast("array<string>").alias("_codes")
    )
    cells = max(MIN_CELLS, available)
    for number in range(min(max_labels, available)):
        state = _draw(state, row_id, intervals, total, available, cells, number, seed)
    return state.select(row_id, F.posexplode("_codes").alias("_place", "code")).select(
        row_id, (F.col("_place") + 1).alias("pos"), "code"
    )


def sample_items(items: Sequence[str], row_id: str, purpose: str, seed: str = "0", k: int = N_CRITERIA) -> Column:
    """Array of ``k`` list items per row, without replacement, in random order."""
    if k > len(items):
        raise ValueError(f"cannot sample {k} of {len(items)} items")
    literals = F.array(*[F.lit(i) for i in items])
    keyed = F.transform(
        literals,
        lambda x, i: F.struct(hash_hex(seed, F.col(row_id), F.lit(purpose), i).alias("key"), x.alias("item")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: e["item"])
