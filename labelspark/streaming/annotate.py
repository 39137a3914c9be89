"""Incremental annotation and dedup as restartable streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from labelspark.operators.corpus import text_key
from labelspark.sources.keys import Batch, KeyTable
from labelspark.sources.versions import list_names


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, form: str = "json",
                files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def annotate_stream(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
                    text: str = "text", spread_by: str = "row_id", keys: str | None = None) -> StreamingQuery:
    """Annotate what arrives and append it to ``output``; start again at will.

    Each micro-batch first drops texts that were done already, then writes
    below its own (run, batch) folder in overwrite mode, so a replayed batch
    replaces itself and paid work is never done twice. A run is one checkpoint:
    started with a new one, the stream finds all older output and leaves it.

    What was done is looked up in a ``KeyTable`` in folder ``keys``
    (``<output>-keys`` unless given), of which a batch reads its own buckets.
    Output that the table does not know is read once, when a run starts.
    """
    spark = stream.sparkSession
    done = KeyTable(spark, keys or f"{output.rstrip('/')}-keys")

    def folder(batch: Batch) -> str:
        return f"{output}/run_id={batch[0]}/batch_id={batch[1]}"

    def texts(batch: Batch) -> DataFrame:
        return spark.read.schema(T.StructType([T.StructField(text, T.StringType())])).parquet(folder(batch))

    done.catch_up(written_batches(spark, output), texts, text)

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        # the id that Spark keeps with a checkpoint
        run_id = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        own = (run_id, batch_id)
        done.merge(without=own)
        annotate(done.not_held(rows, text, spread_by, without=own)).write.mode("overwrite").parquet(folder(own))
        done.add(texts(own), own, text)

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def written_batches(spark: SparkSession, output: str) -> list[Batch]:
    """(run, batch) of the complete folders of an output."""
    out = []
    for run in list_names(spark, output):
        for batch in list_names(spark, f"{output}/{run}") if run.startswith("run_id=") else ():
            if "_SUCCESS" in list_names(spark, f"{output}/{run}/{batch}"):
                out.append((run.removeprefix("run_id="), int(batch.removeprefix("batch_id="))))
    return out


class FirstArrival(StatefulProcessor):
    """Passes the first row of each key; a timer ends the key's state.

    The state is one timestamp a key: when it was first seen. With a lifetime the key
    is forgotten that long after, in event time, and a later row passes again.
    """

    def __init__(self, columns: list[str], event_time: str, lifetime_ms: int):
        self.columns, self.event_time, self.lifetime_ms = columns, event_time, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        held = self.seen.exists()
        first = None
        for row in rows:  # of one micro-batch: the earliest, ties by the whole row
            rank = (row[self.event_time], repr(row))
            if first is None or rank < first[0]:
                first = (rank, row)
        if held or first is None:
            return
        at = int(first[1][self.event_time].timestamp() * 1000)
        self.seen.update((at,))
        self.handle.registerTimer(at + self.lifetime_ms)
        yield Row(**{c: first[1][c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(stream: DataFrame, event_time: str, lifetime: str = "1 hour", delay: str = "1 hour",
                   text: str = "text") -> DataFrame:
    """First arrival of each text within ``lifetime``, over restarts.

    State is one timestamp a text and goes ``lifetime`` after the text was first seen,
    once the watermark (``delay`` behind the latest event) has passed: its size is
    bounded by the texts of that time, however long the stream runs. Rows later than
    the watermark are dropped. Rows without event time or text cannot be placed and are
    passed over. The session's state store must be RocksDB, see STATE_STORE.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    lifetime_ms = int(spark.range(1).select(F.expr(f"CAST(INTERVAL {lifetime} AS INTERVAL DAY TO SECOND)").alias("i")).first()["i"].total_seconds() * 1000)
    keyed = (
        stream.filter(F.col(event_time).isNotNull() & F.col(text).isNotNull())
        .withWatermark(event_time, delay)
        .withColumn("_text", text_key(text))
    )
    processor = FirstArrival(stream.columns, event_time, lifetime_ms)
    return keyed.groupBy("_text").transformWithState(processor, stream.schema, "Append", "EventTime")


def dedup_stream(stream: DataFrame, text: str = "text", event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """First arrival of each text. State holds 32-byte keys, not texts.

    With an event time the state of keys older than ``delay`` is dropped;
    without one it grows with the number of distinct texts (``first_arrivals`` sets a
    lifetime of its own).
    """
    keyed = stream.withColumn("_text", text_key(text))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_text"]).drop("_text")
    return keyed.dropDuplicates(["_text"]).drop("_text")


def append_stream(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
