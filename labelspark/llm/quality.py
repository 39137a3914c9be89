"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over them, and each overlapping chunk of
a text is max-pooled into one vector and scored. The chunks cover the whole
text; their mean, largest and smallest score make one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from labelspark.llm.common import fields_of, fit_logistic, labelled_sample, logistic, map_arrow, text_blocks

STRIDE = 4  # bytes between filter positions; a filter spans two strides
EMBED = 8
FILTERS = 32
CHUNK = 128  # strides per chunk: 512 bytes
STEP = 112  # strides between chunk starts: 64 bytes of overlap
GROUP = 128  # chunks whose filter outputs are held at a time, some 57 KB of text
# Labelled rows that a model is fitted on, and chunks taken from each of them.
TRAIN_ROWS = 6_000
TRAIN_CHUNKS = 6
EPOCHS = 8
BATCH = 256
RATE = 0.01


@dataclass
class Model:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (2 * STRIDE * EMBED, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (FILTERS,), then its bias
    offset: float
    combine: np.ndarray  # mean, max, min of the chunk scores, log size of a short text, intercept


def padded(raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each text on whole strides (two at least), and stride offsets."""
    strides = np.maximum(2, -(-np.diff(where) // STRIDE))
    starts = np.r_[0, np.cumsum(strides)]
    out = np.zeros(int(starts[-1]) * STRIDE, np.uint8)
    for begin, a, b in zip((starts[:-1] * STRIDE).tolist(), where[:-1].tolist(), where[1:].tolist()):
        out[begin : begin + b - a] = raw[a:b]
    return out, starts


def chunk_spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first filter position, end, text) of every chunk; the last one of a text
    ends with the text."""
    positions = np.diff(starts) - 1
    counts = np.maximum(1, -(-(positions - (CHUNK - 1)) // STEP) + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[text] + number * STEP
    return first, np.minimum(first + CHUNK - 1, starts[text] + positions[text]), text


def activations(raw: np.ndarray, model: Model) -> np.ndarray:
    """Filter outputs at each stride (the last stride starts none)."""
    blocks = model.embed[raw].reshape(-1, STRIDE * EMBED)
    half = STRIDE * EMBED
    out = blocks[:-1] @ model.filters[:half]
    out += blocks[1:] @ model.filters[half:]
    return out


def chunk_scores(raw: np.ndarray, where: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, text) of every chunk of a block of texts.

    Filters run over GROUP chunks at a time, also inside one text, so that memory
    beside the bytes themselves does not depend on how long a text is.
    """
    raw, starts = padded(raw, where)
    first, end, text = chunk_spans(starts)
    scores = np.empty(len(first), np.float32)
    for at in range(0, len(first), GROUP):
        a, b = first[at : at + GROUP], end[at : at + GROUP]
        base, top = int(a[0]), int(b[-1])
        out = activations(raw[base * STRIDE : (top + 1) * STRIDE], model)
        out = np.concatenate([out, np.full((1, out.shape[1]), -np.inf, np.float32)])
        pairs = np.stack([a - base, b - base], axis=1).reshape(-1)
        pooled = np.maximum(np.maximum.reduceat(out, pairs, axis=0)[::2] + model.bias, 0)
        scores[at : at + GROUP] = pooled @ model.dense + model.offset
    return scores, text


def text_features(raw: np.ndarray, where: np.ndarray, model: Model) -> np.ndarray:
    """Mean, largest and smallest chunk score of each text, and how far a text
    that fills no whole chunk fills it. Every text has a chunk."""
    scores, text = chunk_scores(raw, where, model)
    starts = np.searchsorted(text, np.arange(len(where) - 1))
    counts = np.diff(np.r_[starts, len(text)])
    fill = np.log1p(np.minimum(np.diff(where), CHUNK * STRIDE))
    return np.column_stack(
        [np.add.reduceat(scores, starts) / counts, np.maximum.reduceat(scores, starts), np.minimum.reduceat(scores, starts), fill]
    )


def train(chunks: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fit filters to ``chunks`` (n, CHUNK * STRIDE bytes, zero-padded) by Adam."""
    rng = np.random.default_rng(seed)
    width = 2 * STRIDE * EMBED
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Model(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, width**-0.5, (width, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32),
        float(np.log(share / (1 - share))),
        np.array([1.0, 0.0, 0.0, 0.0, 0.0]),
    )
    state = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("embed", "filters", "bias", "dense")}
    state["offset"] = [0.0, 0.0]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            own = chunks[order[at : at + BATCH]]
            n = len(own)
            blocks = model.embed[own].reshape(n, CHUNK, STRIDE * EMBED)
            half = STRIDE * EMBED
            out = blocks[:, :-1] @ model.filters[:half] + blocks[:, 1:] @ model.filters[half:] + model.bias
            place = out.argmax(axis=1)  # (n, FILTERS)
            top = np.maximum(np.take_along_axis(out, place[:, None], 1)[:, 0], 0)
            p = logistic(top @ model.dense + model.offset)
            error = ((p - labels[order[at : at + BATCH]]) / n).astype(np.float32)
            back = error[:, None] * model.dense * (top > 0)  # (n, FILTERS)
            row = np.arange(n)[:, None]
            inputs = np.concatenate([blocks[row, place], blocks[row, place + 1]], axis=2)  # (n, FILTERS, width)
            slopes = {
                "filters": np.einsum("nf,nfw->wf", back, inputs),
                "bias": back.sum(axis=0),
                "dense": error @ top,
                "offset": float(error.sum()),
            }
            touched = own.reshape(n, CHUNK, STRIDE)
            touched = np.concatenate([touched[row, place], touched[row, place + 1]], axis=2).reshape(-1)
            push = (back[:, :, None] * model.filters.T[None]).reshape(-1, EMBED)
            slopes["embed"] = np.stack(
                [np.bincount(touched, push[:, e], 256) for e in range(EMBED)], axis=1
            ).astype(np.float32)
            step += 1
            for name, slope in slopes.items():
                m, v = state[name]
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
                state[name] = [m, v]
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(model, name, getattr(model, name) - move)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, bound: int = TRAIN_ROWS) -> Model | float:
    """Learn from about ``bound`` labelled rows that satisfy ``usable``.

    Each gives up to TRAIN_CHUNKS chunks, spread evenly over its whole text. With
    fewer than two labels in the sample there is nothing to learn: the result is
    then one score for all texts, the share of label 1 (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "quality", usable, bound)

    def run(batches):
        for batch in batches:
            own, ids, marks, number = [], [], [], 0
            labels = batch.column(1).to_pylist()
            for first, _, raw, where in text_blocks(batch.column(0)):
                raw, starts = padded(raw, where)
                begin, end, text = chunk_spans(starts)
                for t in range(len(where) - 1):
                    mine = np.flatnonzero(text == t) if len(where) < 64 else np.arange(*np.searchsorted(text, [t, t + 1]))
                    for c in mine[np.unique(np.linspace(0, len(mine) - 1, TRAIN_CHUNKS).round().astype(int))]:
                        own.append(raw[begin[c] * STRIDE : (end[c] + 1) * STRIDE].tobytes().ljust(CHUNK * STRIDE, b"\0"))
                        ids.append(number)
                        marks.append(int(labels[first + t] > 0))
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array(ids, pa.int32()), pa.array(marks, pa.int32())], ["chunk", "text", "label"]
            )

    # a bounded table: TRAIN_ROWS * TRAIN_CHUNKS chunks of 512 bytes
    rows = map_arrow(sample.select("text", "label"), run, "chunk binary, text int, label int").toArrow()
    marks = rows["label"].to_numpy().astype(np.float32)
    if len(set(marks.tolist())) < 2:
        return float(marks.mean()) if len(marks) else 0.5
    chunks = np.frombuffer(b"".join(rows["chunk"].to_pylist()), np.uint8).reshape(-1, CHUNK * STRIDE)
    # a fixed order, whatever order the tasks ended in
    key = np.lexsort(chunks[:, :64].T[::-1])
    model = train(chunks[key], marks[key])

    def features(batches):
        for batch in batches:
            for first, end, raw, where in text_blocks(batch.column(0)):
                values = text_features(raw, where, model)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[:, i].astype(np.float64)) for i in range(4)] + [batch.column(1)[first:end]], ["a", "b", "c", "d", "label"]
                )

    found = map_arrow(sample.select("text", "label"), features, "a double, b double, c double, d double, label int").toPandas()
    model.combine = fit_logistic(found[["a", "b", "c", "d"]].to_numpy(), (found["label"] > 0).to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model | float, name: str = "quality") -> DataFrame:
    """``docs`` with the chance of label 1; all columns are passed on.

    Null and empty texts are scored as one chunk of padding. ``name`` must be new.
    """
    if name in docs.columns:
        raise ValueError(f"column {name!r} exists")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            p = np.full(len(batch), model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for first, end, raw, where in text_blocks(batch.column(at)):
                    values = text_features(raw, where, model)
                    p[first:end] = logistic(values @ model.combine[:-1] + model.combine[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return map_arrow(docs, run, fields_of(docs) + f", `{name}` double")
