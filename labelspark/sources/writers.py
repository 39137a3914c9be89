"""Sinks. Every writer runs in the tasks; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.text import labelled_line


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite; text is UTF-8, unescaped. Split tables go by source and split,
    which later reads prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


JSON_TYPES = (T.StringType, T.BooleanType, T.NumericType, T.ArrayType, T.MapType, T.StructType)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append; values JSON has no type for are written as text."""
    columns = [
        F.col(f.name) if isinstance(f.dataType, JSON_TYPES) else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes inside a field are doubled, as other CSV programs expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_record(df: DataFrame, path: str) -> None:
    """A one-row result as one JSON file; more than one row is an error."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("a record has one row")
    df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("overwrite").json(path)


def write_labelled_lines(df: DataFrame, path: str, labels: str = "labels", text: str = "text") -> None:
    df.select(labelled_line(F.col(labels), F.col(text)).alias("value")).write.mode("overwrite").text(path)
