"""Batch scoring and generation with pluggable models."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.text import fill_template
from labelspark.schemas import GEN_CONFIGS

Predict = Callable[[Sequence[str]], np.ndarray]
Generate = Callable[[Sequence[str]], Sequence[str]]


@dataclass(frozen=True)
class Decoding:
    """Decoding settings kept next to each generated text."""

    model: str
    temperature: float = 0.0
    top_p: float = 1.0
    repetition_penalty: float = 1.0
    max_tokens: int = 4096


def _slices(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), size):
            yield frame.iloc[start : start + size]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches: only a slice's texts are Python strings at one time."""
    for batch in batches:
        for start in range(0, len(batch), size):
            yield batch.slice(start, size)


def score_texts(df: DataFrame, load: Callable[[], Predict], text: str = "text", output: str = "pred_probs",
                batch_size: int = 32) -> DataFrame:
    """Append an array of class probabilities; other columns pass through.

    ``load`` runs once per task, inside the worker, and returns a function from
    texts to a 2-d array.
    """
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != output] + [T.StructField(output, T.ArrayType(T.DoubleType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for part in _slices(frames, batch_size):
            probabilities = np.asarray(predict(part[text].tolist()), dtype="float64")
            yield part.assign(**{output: list(probabilities)})

    return df.drop(output).mapInPandas(run, schema)


def generate_texts(df: DataFrame, load: Callable[[], Generate], decoding: Decoding, output: str = "output",
                   batch_size: int = 1024, chat: Callable[[str], str] | None = None) -> DataFrame:
    """Send ``pre_query_str`` to a model; adds the trimmed output and settings."""
    sent = df.drop(output, "gen_configs")
    kept = [f for f in sent.schema.fields if f.name != "pre_query_str"]
    schema = T.StructType([*kept, T.StructField(output, T.StringType()), T.StructField("_prompt", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = load()
        for part in _parts(batches, batch_size):
            texts = part.column(part.schema.get_field_index("pre_query_str")).to_pylist()
            prompts = [chat(p) if chat else p for p in texts]
            answers = [a.strip() for a in generate(prompts)]
            own = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            made = [pa.array(answers, pa.string()), pa.array(prompts, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[f.name for f in schema.fields])

    generated = sent.mapInArrow(run, schema)
    return generated.withColumn("gen_configs", _configs(F.col("_prompt"), decoding)).drop("_prompt")


def _configs(prompt: Column, decoding: Decoding) -> Column:
    settings = {"prompt": prompt, **{k: F.lit(v) for k, v in asdict(decoding).items()}}
    return F.struct(*[settings[f.name].cast(f.dataType).alias(f.name) for f in GEN_CONFIGS.fields])


def filled(template: str, field: str, constants: Mapping[str, str]) -> Callable[[str | None], str | None]:
    """A function that puts a text in the place of ``{field}``, everything else being
    filled in already; doubled braces are single ones."""
    parts: list[str] = [""]
    for literal, name, *_ in string.Formatter().parse(template):
        parts[-1] += literal
        if name == field:
            parts.append("")
        elif name is not None:
            parts[-1] += constants[name]
    return lambda text: None if text is None else text.join(parts)


def generate_filled(df: DataFrame, load: Callable[[], Generate], decoding: Decoding, template: str, text: str = "text",
                    field: str = "input_text", constants: Mapping[str, str] | None = None, output: str = "output",
                    batch_size: int = 1024) -> DataFrame:
    """As ``generate_texts`` for prompts that are one template with a text of the row.

    What all prompts share travels once, with the task; rows bring their own columns
    alone to the model, and the prompt in ``gen_configs`` is filled in by Spark
    where a later step reads it. A null text makes a null prompt.
    """
    shared = dict(constants or {})
    kept = [f for f in df.schema.fields if f.name not in {output, "gen_configs"}]
    schema = T.StructType([*kept, T.StructField(output, T.StringType())])
    broadcast = df.sparkSession.sparkContext.broadcast((template, field, shared))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate, fill = load(), filled(*broadcast.value)
        for part in _slices(frames, batch_size):
            answers = [a.strip() for a in generate([fill(t) for t in part[text]])]
            yield part.assign(**{output: answers})[[f.name for f in schema.fields]]

    generated = df.drop(output, "gen_configs").mapInPandas(run, schema)
    prompt = fill_template(template, **{k: F.lit(v) for k, v in shared.items()}, **{field: F.col(text)})
    return generated.withColumn("gen_configs", _configs(prompt, decoding))
