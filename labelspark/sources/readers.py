"""Readers with fixed schemas, file order and split names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark import schemas
from labelspark.session import settle


def split_paths(joined: str | Sequence[str]) -> list[str]:
    """``a.jsonl+b.jsonl`` or a list, in order."""
    return joined.split("+") if isinstance(joined, str) else list(joined)


def stem_name(path: str) -> str:
    """File name without extension, dashes and underscores as dots."""
    return re.sub("[-_]", ".", PurePosixPath(path).stem)


def _with_order(placed: DataFrame) -> DataFrame:
    """Turn ``_place`` (position in the file list) into ``ord``: dense position in
    list order, then file order.

    Inside one file block rows keep their order in one task, so a block start
    and a rising id place every row; block sizes give the offsets. Written once,
    because ids are only stable in a written table.
    """
    placed = settle(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    key = ["_place", "_file", "_block"]
    blocks = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # one row per file block, not per record
    before = F.sum("_n").over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return (
        placed.join(blocks, key)
        .withColumn("ord", F.col("_before") + F.col("_id") - F.col("_first"))
        .drop(*key, "_id", "_before", "_first")
    )


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, ordered: bool = False) -> DataFrame:
    """One table from JSONL files; ``ordered`` adds ``ord`` over the file list.

    Each listed path is read as a part of its own, so that its place is known
    whatever its name is; a path may be listed more than once.
    """
    listed = split_paths(paths)
    if not ordered:
        return spark.read.schema(schema).json(listed)
    parts = [
        spark.read.schema(schema)
        .json(path)
        .select(
            "*",
            F.lit(place).alias("_place"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        for place, path in enumerate(listed)
    ]
    return _with_order(reduce(DataFrame.unionAll, parts))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header; a doubled quote is a quote.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per
    file: without it files are split.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(split_paths(paths))


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """JSONL or CSV, told by the extension of the first file."""
    listed = split_paths(paths)
    kind = listed[0].rsplit(".", 1)[-1].lower()
    if kind in {"json", "jsonl"}:
        return read_jsonl(spark, listed, schema)
    if kind == "csv":
        return read_csv(spark, listed, schema)
    raise ValueError(f"expected json, jsonl or csv, not {kind!r}")


def read_splits(spark: SparkSession, files: Mapping[str, str | Sequence[str]], schema: T.StructType,
                source: str | None = None) -> DataFrame:
    """One table with a ``split`` column from named groups of files.

    A group of one file keeps its name; with several, validation and test
    become ``name_<file stem>``, dashes and underscores turned into dots. Train
    files are always one split.
    """
    parts = []
    for name, paths in files.items():
        listed = split_paths(paths)
        groups = {name: listed}
        if name != "train" and len(listed) > 1:
            groups = {f"{name}_{stem_name(path)}": [path] for path in listed}
        for split, members in groups.items():
            df = read_table(spark, members, schema).withColumn("split", F.lit(split))
            parts.append(df.withColumn("source", F.lit(source)) if source else df)
    return reduce(DataFrame.unionByName, parts)


def read_tokenised(spark: SparkSession, root: str, configs: Sequence[str], splits: Sequence[str],
                   form: str = "json") -> DataFrame:
    """Tokenised records from ``root/<config>/<split>*``, as source and split."""
    parts = [
        spark.read.schema(schemas.TOKENISED)
        .format(form)
        .load(f"{root}/{config}/{split}*")
        .select(F.lit(config).alias("source"), F.lit(split).alias("split"), "tokens", "ner_tags")
        for config in configs
        for split in splits
    ]
    return reduce(DataFrame.unionByName, parts)


def read_dictionary(spark: SparkSession, path: str, with_freq: bool = False, ordered: bool = False) -> DataFrame:
    return read_jsonl(spark, path, schemas.CODE_FREQS if with_freq else schemas.CODE_DICTIONARY, ordered)


def explode_by_length(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """{length: [sentence]} JSON text → (keep…, length, pos, sentence)."""
    mapped = df.select(*keep, F.from_json(column, schemas.SENTENCES_BY_LENGTH).alias("_m"))
    # the outer form: otherwise the JSON would be parsed again for a filter on its size
    lists = mapped.select(*keep, F.explode_outer("_m").alias("length", "_ss")).filter(F.col("length").isNotNull())
    return lists.select(*keep, "length", F.posexplode("_ss").alias("pos", "sentence"))


def read_by_length(spark: SparkSession, path: str) -> DataFrame:
    return explode_by_length(spark.read.text(path, wholetext=True), "value")


def read_evaluations(spark: SparkSession, root: str, ending: str = "-pred-eval.json") -> DataFrame:
    """All evaluation records below ``root`` with model and split from the path.

    A record is a file, or a folder of part files as ``write_record`` makes it,
    whose name ends with ``ending``. Model is the stem of the folder it lies in,
    split the name before the ending; paths containing "valid" are left out.
    """
    df = (
        spark.read.schema(schemas.EVALUATION)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", True)
        .json(root)
        .select("*", F.url_decode(F.col("_metadata.file_path")).alias("_path"))
    )
    record = rf"([^/]+)/([^/]*){re.escape(ending)}(?:/part-[^/]*)?\z"
    named = df.filter(F.col("_path").rlike(record) & ~F.col("_path").contains("valid"))
    return named.select(
        F.regexp_replace(F.regexp_extract("_path", record, 1), r"(?<=.)\.[^.]*\z", "").alias("model_name"),
        F.regexp_extract("_path", record, 2).alias("split"),
        *schemas.EVALUATION.fieldNames(),
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    from labelspark.functions.text import line_labels, line_text

    lines = spark.read.text(path)
    return lines.select(line_labels(F.col("value")).alias("labels"), line_text(F.col("value")).alias("text"))
