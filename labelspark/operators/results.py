"""Task kinds and result bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def task_kind(df: DataFrame, label: str = "label") -> str:
    """multi-label, regression or single-label, from the label column's type."""
    kind = df.schema[label].dataType
    if isinstance(kind, T.ArrayType):
        return "multi-label"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "regression"
    return "single-label"


def regression_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Label as float; text that is no number is an error under ANSI rules."""
    return df.withColumn(label, F.col(label).cast("float"))


def watched(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass a stage while the sink runs, without a scan."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen
