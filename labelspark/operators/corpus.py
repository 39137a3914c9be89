"""Corpus building: tokens to text, filters, exact dedup and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions import text as T
from labelspark.plans.joins import salted_join


def build_corpus(tokenised: DataFrame, tag_names: Sequence[str], tag_part: str = "DISO") -> DataFrame:
    """tokens, ner_tags → raw_text, text, has_diso; rows with empty text go."""
    kept = [c for c in tokenised.columns if c not in {"tokens", "ner_tags"}]
    raw = tokenised.select(*kept, "ner_tags", T.tokens_to_text(F.col("tokens")).alias("raw_text"))
    # cleaning never empties a text, so the cheap test on the raw text will do
    return drop_empty_text(raw, "raw_text").select(
        *kept,
        "raw_text",
        T.clean_text(F.col("raw_text")).alias("text"),
        T.any_tag_contains(F.col("ner_tags"), tag_names, tag_part).alias("has_diso"),
    )


def drop_empty_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop null and empty text; white space counts as text."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def with_labels_only(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.filter(F.size(labels) > 0)


def concat_columns(df: DataFrame, columns: Sequence[str], name: str, delimiter: str = " ") -> DataFrame:
    return df.withColumn(name, T.concat_texts(columns, delimiter))


def select_splits(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Filter by the split column; prunes partitions when stored by split."""
    if keep:
        df = df.filter(F.col("split").isin(list(keep)))
    if drop:
        df = df.filter(~F.col("split").isin(list(drop)))
    return df


def select_named(df: DataFrame, column: str, prefix: str | None = None, suffix: str | None = None,
                 exact: str | None = None) -> DataFrame:
    if prefix is not None:
        df = df.filter(F.col(column).startswith(prefix))
    if suffix is not None:
        df = df.filter(F.col(column).endswith(suffix))
    if exact is not None:
        df = df.filter(F.col(column) == exact)
    return df


def without_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def text_key(column: str) -> Column:
    """SHA-256 of the whole text: 32 bytes travel instead of the document."""
    return F.unhex(F.sha2(F.col(column), 256))


def dedup_exact(df: DataFrame, order_by: str, text: str = "text") -> DataFrame:
    """Keep the first row, by a unique order column, of each distinct text.

    The minimum per text is combined map-side, so a text copied into a third of
    all rows is one row per task by the time it is shuffled; the rows come back
    by their own unique position, which cannot be skewed.
    """
    keep = df.groupBy(text_key(text).alias("_text")).agg(F.min(order_by).alias(order_by)).select(order_by)
    return df.join(keep, order_by, "left_semi")


def dedup_across_splits(df: DataFrame, row_id: str, order: Sequence[str] = ("test", "validation", "train"),
                        text: str = "text") -> DataFrame:
    """Drop rows whose text occurs in an earlier split of ``order``.

    The first split is never reduced and copies inside one split stay.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)]), F.col("split"))
    keyed = df.select(row_id, text_key(text).alias("_text"), rank.alias("_rank"))
    # one row per text found in several splits
    shared = (
        keyed.groupBy("_text")
        .agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_worst"))
        .filter("_best < _worst")
        .select("_text", "_best")
    )
    drop = salted_join(keyed, shared, ["_text"], [row_id]).filter("_rank > _best").select(row_id)
    return df.join(drop, row_id, "left_anti")


def not_yet_done(inputs: DataFrame, done: DataFrame, text: str = "text", spread_by: str = "ord") -> DataFrame:
    """Inputs whose text the output does not hold yet."""
    keys = done.select(text_key(text).alias("_text")).distinct()
    keyed = inputs.withColumn("_text", text_key(text))
    return salted_join(keyed, keys, ["_text"], [spread_by], "left_anti").drop("_text")


def parse_answers(df: DataFrame, output: str = "output") -> tuple[DataFrame, DataFrame]:
    """(accepted with labels, rejected): an answer needs exactly two sections.

    A null answer is rejected like any other without them.

    Accepted rows come out of a generator that yields nothing for the others, so
    an answer is parsed once and not again for the filter.
    """
    labels = T.answer_labels(T.answer_sections(F.col(output)))
    one = T.let(labels, lambda found: F.when(found.isNotNull(), F.array(found)))
    accepted = T.opened(df, one, "labels", *[c for c in df.columns if c != "labels"])
    accepted = accepted.drop(output, "raw_text", "gen_configs")
    # a null answer has no sections
    return accepted, df.filter(F.coalesce(F.size(T.answer_sections(F.col(output))), F.lit(0)) != 2)


def mark_generated(df: DataFrame) -> DataFrame:
    """Generated text gets ``has_diso`` and loses its generation settings."""
    return df.withColumn("has_diso", F.lit(True)).drop("gen_configs")
