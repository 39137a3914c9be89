"""Prompts for labelling, verification and synthetic documents."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.functions.text import fill_template
from labelspark.operators.sample import MAX_LABELS, N_CRITERIA, sample_codes, sample_items
from labelspark.plans.joins import salted_join

def read_template(spark: SparkSession, path: str) -> str:
    """One text file, whole; a setting, not data."""
    return spark.read.text(path, wholetext=True).first()["value"]


def code_line() -> Column:
    return F.concat("code", F.lit(": "), "description")


def context_text(dictionary: DataFrame, order_by: str = "ord", max_chars: int | None = None) -> Column:
    """All ``code: description`` lines in order, as a scalar subquery.

    The whole dictionary is part of every prompt. ``max_chars`` turns a context
    that no model could take into an error before any prompt is made.
    """
    if max_chars is not None:
        check_context(dictionary, max_chars)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("ord"), code_line().alias("line"))))
    return dictionary.agg(F.array_join(F.transform(lines, lambda l: l["line"]), "\n").alias("context")).scalar()


# Characters of a context that a prompt may have; no model takes more.
MAX_CONTEXT = 8_000_000


def check_context(dictionary: DataFrame, max_chars: int) -> None:
    chars = dictionary.agg(F.sum(F.length(code_line()) + 1)).first()[0] or 0
    if chars > max_chars:
        raise ValueError(f"a context of {chars} characters does not fit in a prompt")


def context_value(dictionary: DataFrame, order_by: str = "ord", max_chars: int = MAX_CONTEXT) -> str:
    """The context as a setting of the driver, which tasks get once each. Its size is
    checked first; the lines are sorted by Spark."""
    check_context(dictionary, max_chars)
    rows = dictionary.select(order_by, code_line().alias("line")).orderBy(order_by, "line").filter(F.col("line").isNotNull())
    return "\n".join(r["line"] for r in rows.toLocalIterator())


def labelling_prompts(df: DataFrame, dictionary: DataFrame, template: str, text: str = "text",
                      order_by: str = "ord") -> DataFrame:
    """Adds ``pre_query_str``: instructions, the whole dictionary, the text."""
    context = context_text(dictionary, order_by)
    return df.withColumn("pre_query_str", fill_template(template, context=context, input_text=F.col(text)))


def described_labels(df: DataFrame, row_id: str, dictionary: DataFrame, labels: str = "labels") -> DataFrame:
    """(row_id, label_lines): ``code: description`` per label in list order.

    A code without a description is an error; no labels gives an empty text.
    """
    occurrences = df.select(row_id, F.posexplode(labels).alias("pos", "code"))
    found = salted_join(occurrences, dictionary.select("code", "description"), ["code"], [row_id], "left")
    line = F.when(F.col("description").isNotNull(), code_line()).otherwise(
        F.raise_error(F.concat(F.lit("code without description: "), F.col("code"))).cast("string")
    )
    # a row's labels come from one list and go back into one text
    lines = found.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    joined = df.select(row_id).join(lines, row_id, "left")
    text = F.array_join(F.transform("_l", lambda l: l["line"]), "\n")
    return joined.select(row_id, F.coalesce(text, F.lit("")).alias("label_lines"))


def verification_prompts(df: DataFrame, row_id: str, dictionary: DataFrame, template: str, text: str = "text",
                         labels: str = "labels") -> DataFrame:
    lines = described_labels(df, row_id, dictionary, labels)
    prompt = fill_template(template, input_text=F.col(text), labels=F.col("label_lines"))
    return df.join(lines, row_id).withColumn("pre_query_str", prompt).drop("label_lines")


def list_block(template: str, tag: str) -> tuple[str, list[str]]:
    """The whole ``<tag>`` block of a template and its lines."""
    found = re.search(rf"<{tag}>\n(.+)\n</{tag}>", template, flags=re.DOTALL)
    if not found:
        raise ValueError(f"template has no <{tag}> block")
    return found.group(), found.group(1).split("\n")


def _unescaped(item: str) -> str:
    """Doubled braces are single ones once the template is filled."""
    return "".join(literal for literal, *_ in string.Formatter().parse(item))


def sampled_template(template: str, row_id: str, tags: tuple[str, ...] = ("types", "styles"), seed: str = "0",
                     k: int = N_CRITERIA) -> tuple[str, dict[str, Column]]:
    """Template with each list block as a field, and the sampled lines per row."""
    fields = {}
    for tag in tags:
        block, items = list_block(template, tag)
        template = template.replace(block, "{" + tag + "}")
        fields[tag] = F.array_join(sample_items([_unescaped(i) for i in items], row_id, tag, seed, k), "\n")
    return template, fields


def document_prompts(rows: DataFrame, row_id: str, dictionary: DataFrame, freqs: DataFrame, template: str,
                     seed: str = "0", max_labels: int = MAX_LABELS) -> DataFrame:
    """(row_id, labels, pre_query_str): synthetic-document prompts."""
    codes = sample_codes(rows, row_id, freqs, seed, max_labels)
    labelled = codes.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_c"))
    labelled = labelled.select(row_id, F.transform("_c", lambda c: c["code"]).alias("labels"))
    lines = described_labels(labelled, row_id, dictionary)
    filled, fields = sampled_template(template, row_id, seed=seed)
    prompt = fill_template(filled, labels=F.col("label_lines"), **fields)
    return labelled.join(lines, row_id).select(row_id, "labels", prompt.alias("pre_query_str"))
