"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit says which
half of the languages a text looks like, and the codeword of smallest weighted
loss wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import fields_of, fit_logistic, map_arrow, text_blocks
from labelspark.session import settle

GRAM = 3
TABLE = 1 << 14
# Distinct labelled texts that a model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
AMBIGUOUS = 0.7  # a smaller share of the winner marks a text as ambiguous
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # (languages, bits) of -1 and 1
    weights: np.ndarray  # (bits, TABLE): log-odds of each n-gram
    slopes: np.ndarray  # (bits, 2): calibration of the mean log-odds


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def gram_buckets(raw: np.ndarray) -> np.ndarray:
    """Table position of the n-gram that starts at each byte; the last two bytes
    of the block start none."""
    low = _LETTERS[raw].astype(np.uint32)
    n = max(0, len(low) - GRAM + 1)
    code = low[:n] | low[1 : n + 1] << 8 | low[2 : n + 2] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) codewords of -1 and 1, far from each other.

    For few languages every way to halve them; otherwise the best of many random
    codes of ten bits per doubling.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        ways = [[1] + [1 if i >> j & 1 else -1 for j in range(n - 1)] for i in range(2 ** (n - 1) - 1)]
        return np.array(ways, np.int8).T
    rng, bits, best = np.random.default_rng(seed), ceil(10 * log2(n)), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        np.fill_diagonal(apart, bits)
        best = max(best, (int(apart.min()), code), key=lambda b: b[0])
    return best[1]


def _means(raw: np.ndarray, where: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(texts, bits): mean log-odds over the n-grams of each text, 0 without any."""
    buckets = np.append(gram_buckets(raw), np.zeros(GRAM, np.uint32))
    ends = np.maximum(where[:-1], where[1:] - (GRAM - 1))
    sizes = ends - where[:-1]
    out = np.zeros((len(sizes), len(weights)))
    for b, table in enumerate(weights):
        total = np.add.reduceat(table[buckets], np.stack([where[:-1], ends], axis=1).reshape(-1), dtype=np.float64)[::2]
        out[:, b] = np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0)
    return out


def fit(docs: DataFrame, usable: Column, bound: int = TRAIN_ROWS) -> Model:
    """Learn from about ``bound`` rows with a language that satisfy ``usable``.

    Equal texts of one language count once. Without such rows the model has no
    language and answers UNKNOWN for every text.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    share = min(1.0, bound / max(1, known.select("doc_id").count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    sample = settle(known.filter(chosen).select("text", "lang").distinct(), "sample")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, end, raw, where in text_blocks(batch.column(0), lower=True):
                buckets = gram_buckets(raw)
                for i in range(end - first):
                    own = buckets[where[i] : max(where[i], where[i + 1] - GRAM + 1)]
                    total = counts.setdefault(labels[first + i], np.zeros(TABLE, np.int64))
                    total += np.bincount(own, minlength=TABLE)
        for lang, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])], ["lang", "bucket", "n"]
            )

    counted = map_arrow(sample, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # at most TABLE rows per language
    names = sorted(r.lang for r in sample.select("lang").distinct().collect())
    codes = codebook(len(names))
    counts = np.zeros((len(names), TABLE))
    counts[rows["lang"].map({l: i for i, l in enumerate(names)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * TABLE)  # languages weigh the same
    weights = np.zeros((codes.shape[1], TABLE), np.float32)
    if len(names) > 1:
        for b in range(codes.shape[1]):
            weights[b] = np.log(shares[codes[:, b] > 0].mean(axis=0)) - np.log(shares[codes[:, b] < 0].mean(axis=0))
    model = Model(names, codes, weights, np.tile([1.0, 0.0], (codes.shape[1], 1)))
    if len(names) < 2:
        return model

    def margins(batches):
        for batch in batches:
            for first, end, raw, where in text_blocks(batch.column(0), lower=True):
                found = _means(raw, where, weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:end], pa.array(found.tolist(), pa.list_(pa.float64()))], ["lang", "means"]
                )

    found = map_arrow(sample, margins, "lang string, means array<double>").toPandas()
    means = np.stack(found["means"].to_list())
    place = found["lang"].map({l: i for i, l in enumerate(names)}).to_numpy(int)
    for b in range(codes.shape[1]):
        model.slopes[b] = fit_logistic(means[:, b : b + 1], (codes[place, b] > 0).astype(float))
    return model


def decode(means: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(language, share of the winner): the calibrated logistic loss weighs bits."""
    margins = means * model.slopes[:, 0] + model.slopes[:, 1]
    losses = np.stack([np.logaddexp(0, -margins * code).sum(axis=1) for code in model.codes], axis=1)
    best = losses.argmin(axis=1)
    shares = np.exp(losses.min(axis=1, keepdims=True) - losses)
    return best, 1.0 / shares.sum(axis=1)


def identify(docs: DataFrame, model: Model, name: str = "lang_pred", share: str = "lang_share", flag: str = "lang_ambiguous") -> DataFrame:
    """``docs`` with the language of the nearest codeword, its share of the
    decoding weight, and whether another codeword comes close.

    A null text, and one without a letter, gets UNKNOWN with share 1, not
    ambiguous. Ties go to the language first in order. All columns are passed
    on; the new names must be new.
    """
    for new in (name, share, flag):
        if new in docs.columns:
            raise ValueError(f"column {new!r} exists")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            lettered = np.fromiter((has_letter(t) for t in texts.to_pylist()), bool, len(texts))
            langs = np.full(len(texts), UNKNOWN, object)
            shares = np.ones(len(texts))
            if model.languages:
                for first, end, raw, where in text_blocks(texts, lower=True):
                    best, won = decode(_means(raw, where, model.weights), model)
                    own = lettered[first:end]
                    langs[first:end][own] = np.array(model.languages, object)[best[own]]
                    shares[first:end][own] = won[own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(shares), pa.array(shares < AMBIGUOUS)],
                [*batch.schema.names, name, share, flag],
            )

    return map_arrow(docs, run, fields_of(docs) + f", `{name}` string, `{share}` double, `{flag}` boolean")
