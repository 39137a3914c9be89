"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.session import settle

# Python works on this many bytes of text at a time, whatever the batch size.
BLOCK_BYTES = 1_000_000
BATCH_BYTES = "8m"


def give_back() -> None:
    """Return what the allocators hold free to the system: workers are reused, and
    the peak of one stage would add to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which needs no such call
        pass


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose batches are bounded by bytes, so that a run of very
    long texts cannot fill a worker's memory. Free memory is given back at the
    end of a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def fields_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def text_blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes.

    Nulls count as empty. ``offsets`` has one entry more than there are rows and
    starts at 0. A row is never cut, so one long text makes one large block.
    ``lower`` changes letters of all scripts to lower case.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept out of training; a null id is not one of them."""
    return F.coalesce(bucket_of(doc_id, modulus) == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int
) -> DataFrame:
    """(text, label): about ``bound`` labelled rows, one per distinct text.

    ``usable`` is a condition on ``doc_id``. Rows are chosen by a hash of the id,
    the same ones on every run, and written once, so that fitting reads the
    documents a single time. Several labels of one id or text: the largest
    counts. The sampled labels are the only broadcast; their number is bounded.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter(
        F.col("_label").isNotNull() & usable
    )
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    chosen = chosen.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return settle(found.groupBy("text").agg(F.max("_label").alias("label")), "sample")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a small dense logistic regression, intercept last (Newton steps)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(x)))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = logistic(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
