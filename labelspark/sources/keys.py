"""A table of the keys of all texts done, kept beside the output.

Keys are the 32-byte hashes of ``corpus.text_key``. Each batch adds a folder of
its own, in parquet files by the first bits of the key, so that a lookup reads the
files of its own keys' buckets only. When folders are many they are merged into
one, which replaces them in one step; its buckets hold a bounded number of keys
each, so what a small batch reads does not grow with what was done before. Old
outputs are not read, but once for what they held before the table was there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.operators.corpus import text_key
from labelspark.plans.joins import salted_join
from labelspark.sources import versions

PREFIX_BITS = 16
BATCH_BITS = 6  # buckets of a batch's own folder, as a power of two
BUCKET_KEYS = 1_000_000  # keys in a bucket of the merged ones, about
# Batch folders that are read beside the merged keys before they are merged too.
MAX_BATCHES = 16

Batch = tuple[str, int]


def prefix_of(key: Column) -> Column:
    """The first PREFIX_BITS bits of a key."""
    return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int")


def _store(keys: DataFrame, folder: str, bits: int) -> None:
    placed = keys.select("key", F.shiftright(prefix_of(F.col("key")), PREFIX_BITS - bits).alias("bucket"))
    # one file a bucket, in key order: its row groups hold separate ranges
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "key")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


class KeyTable:
    """Keys done, by batches (run, number). The batches of a run come in ascending
    order, one at a time. ``path`` is a folder that only this table uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _merged(self) -> tuple[str, dict] | None:
        """(folder, notes) of the merged keys: ``upto``, the last batch of each run
        that is in, ``bits`` and ``keys``."""
        return versions.current(self.spark, f"{self.path}/merged")

    def _folder(self, batch: Batch) -> str:
        return f"{self.path}/batches/{batch[0]}_{batch[1]:012d}"

    def _open(self) -> list[Batch]:
        """Complete batches that are not merged yet."""
        merged = self._merged()
        upto = merged[1]["upto"] if merged else {}
        out = []
        for name in versions.list_names(self.spark, f"{self.path}/batches"):
            run, _, number = name.rpartition("_")
            if int(number) > upto.get(run, -1) and "_SUCCESS" in versions.list_names(self.spark, f"{self.path}/batches/{name}"):
                out.append((run, int(number)))
        return out

    def holds_batch(self, batch: Batch) -> bool:
        merged = self._merged()
        return batch in self._open() or bool(merged) and batch[1] <= merged[1]["upto"].get(batch[0], -1)

    def add(self, texts: DataFrame, batch: Batch, text: str = "text") -> None:
        """Hold the keys of a batch's texts; a batch that comes again replaces itself."""
        keys = texts.select(text_key(text).alias("key")).filter(F.col("key").isNotNull()).distinct()
        _store(keys, self._folder(batch), BATCH_BITS)

    def files(self, prefixes: Iterable[int] | None = None, without: Batch | None = None) -> list[str]:
        """The bucket folders that hold the keys of some prefixes, or all."""
        merged = self._merged()
        held = [(merged[0], merged[1]["bits"])] if merged else []
        held += [(self._folder(b), BATCH_BITS) for b in self._open() if b != without]
        out = []
        for folder, bits in held:
            wanted = None if prefixes is None else {p >> (PREFIX_BITS - bits) for p in prefixes}
            for name in versions.list_names(self.spark, folder):
                if name.startswith("bucket=") and (wanted is None or int(name.split("=")[1]) in wanted):
                    out.append(f"{folder}/{name}")
        return out

    def keys(self, prefixes: Iterable[int] | None = None, without: Batch | None = None) -> DataFrame:
        """(key): all keys held, each once, or those whose buckets hold the prefixes."""
        found = self.files(prefixes, without)
        if not found:
            return self.spark.createDataFrame([], "key binary")
        return self.spark.read.schema("key binary").parquet(*found).distinct()

    def not_held(self, inputs: DataFrame, text: str = "text", spread_by: str = "row_id", without: Batch | None = None) -> DataFrame:
        """``inputs`` whose text is not held, but for what batch ``without`` added.

        ``inputs`` is read twice, once for the first bits of its keys: 65,536 numbers
        at most reach the driver. A null text is never held.
        """
        name = "_key"
        while name in inputs.columns:
            name += "_"
        keyed = inputs.withColumn(name, text_key(text))
        prefixes = [r[0] for r in keyed.filter(F.col(name).isNotNull()).select(prefix_of(F.col(name))).distinct().collect()]
        held = self.keys(prefixes, without).withColumnRenamed("key", name)
        return salted_join(keyed, held, [name], [spread_by], "left_anti").drop(name)

    def merge(self, without: Batch | None = None) -> bool:
        """Merge all complete batches but ``without`` with the keys merged before, if
        there are more than MAX_BATCHES. Their folders go with the next merge, when no
        reader of the version before them can be left."""
        open_ = [b for b in self._open() if b != without]
        if len(open_) <= MAX_BATCHES:
            return False
        before, place = self._merged(), f"{self.path}/merged"
        old = before[1]["upto"] if before else {}
        upto = reduce(lambda held, b: held | {b[0]: max(b[1], held.get(b[0], -1))}, open_, dict(old))
        keys = self.keys(without=without)
        total = keys.count()
        bits = min(PREFIX_BITS, max(0, ceil(log2(max(1, total / BUCKET_KEYS)))))
        notes = {"upto": upto, "bits": bits, "keys": total}
        versions.publish(self.spark, place, lambda folder: _store(keys, folder, bits), notes)
        versions.drop_old(self.spark, place)
        for name in versions.list_names(self.spark, f"{self.path}/batches"):
            run, _, number = name.rpartition("_")
            if int(number) <= old.get(run, -1):
                versions.delete(self.spark, f"{self.path}/batches/{name}")
        return True

    def catch_up(self, written: Iterable[Batch], read: Callable[[Batch], DataFrame], text: str = "text") -> int:
        """Add batches that an output holds and the table does not, as after a job
        that ended between the two, or where an output is older than its table."""
        missing = [b for b in sorted(written) if not self.holds_batch(b)]
        for batch in missing:
            self.add(read(batch), batch, text)
        return len(missing)
