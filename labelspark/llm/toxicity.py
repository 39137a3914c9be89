"""Toxic passages by maximum-scoring segments.

A text is a sequence of byte 6-grams over letters. Each gram has a log-odds
score under a Dirichlet prior; grams without a significant score cost a constant
drift. All maximal segments of a text are found in one linear scan, and their
scores are turned into expected counts in clean text of that length by the
extreme-value law of segment scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import fields_of, fit_logistic, labelled_sample, logistic, map_arrow, text_blocks
from labelspark.session import settle

GRAM = 6
TABLE_BITS = 21
# Labelled rows that a model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 20_000
PRIOR_SHARE = 0.1  # pseudo-counts of the prior, as a share of the counted grams
MIN_Z = 2.5  # grams below this z-score count as neutral
MAX_GAIN = 6.0
DRIFT = 0.5  # cost of a neutral gram
MAX_E = 0.01  # a segment is significant if clean text has this many or fewer

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def gram_buckets(raw: np.ndarray) -> np.ndarray:
    """Table position of the gram that starts at each byte (GRAM - 1 fewer)."""
    n = len(raw) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    low = _LETTERS[raw].astype(np.uint64)
    code = low[:n].copy()
    for i in range(1, GRAM):
        code |= low[i : n + i] << np.uint64(8 * i)
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


@dataclass
class Model:
    buckets: np.ndarray  # positions of the significant grams
    gains: np.ndarray
    rate: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law
    weights: np.ndarray  # logistic calibration: evidence, intercept
    base: float  # score where nothing could be learned


def maximal_segments(at: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in one linear scan.

    Position ``at[i]`` scores ``gains[i]`` > 0; every position between costs
    ``drift``. Each candidate keeps a link to the last one before it that starts
    from a lower running total, so that no candidate is passed twice.
    """
    found: list[list] = []  # [first, last, total before, total after, link]
    total, previous = 0.0, at[0] - 1 if at else 0
    for position, gain in zip(at, gains):
        total -= drift * (position - previous - 1)
        previous = position
        first, before = position, total
        total += gain
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, position, before, total, j])
                break
            first, before = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in found]


def _table(model: Model) -> np.ndarray:
    table = np.zeros(1 << TABLE_BITS, np.float32)
    table[model.buckets] = model.gains
    return table


def _segments(texts: pa.Array, table: np.ndarray):
    """(length in grams, maximal segments) of each text."""
    for _, _, raw, where in text_blocks(texts, lower=True):
        gains = table[gram_buckets(raw)]
        hits = np.flatnonzero(gains)
        values = gains[hits].astype(np.float64)
        cuts = np.searchsorted(hits, where)
        for i in range(len(where) - 1):
            start, length = int(where[i]), max(0, int(where[i + 1] - where[i]) - GRAM + 1)
            a, b = cuts[i], cuts[i + 1]
            own = hits[a:b] - start
            inside = own < length  # a gram must not reach into the next text
            yield length, maximal_segments(own[inside].tolist(), values[a:b][inside].tolist(), DRIFT) if inside.any() else []


def _evidence(length: int, segments: list, rate: float, scale: float) -> tuple[float, list]:
    """Summed log-significance, and the significant segments with their E-values."""
    if not segments:
        return 0.0, []
    limit = np.log(max(scale * length, 1e-300))
    kept = [(a, b, s, float(np.exp(min(40.0, limit - rate * s)))) for a, b, s in segments]
    kept = [x for x in kept if x[3] <= MAX_E]
    return float(sum(rate * s - limit for _, _, s, _ in kept)), kept


def _counts(sample: DataFrame) -> DataFrame:
    """(bucket, n1, n0): sampled texts of each label that hold a gram."""

    def run(batches):
        counts = np.zeros((2, 1 << TABLE_BITS), np.int32)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for first, end, raw, where in text_blocks(batch.column(0), lower=True):
                buckets = gram_buckets(raw)
                for i in range(end - first):
                    own = buckets[where[i] : max(where[i], where[i + 1] - GRAM + 1)]
                    counts[int(labels[first + i] > 0), np.unique(own)] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))],
                ["bucket", "n1", "n0"],
            )

    partial = map_arrow(sample.select("text", "label"), run, "bucket long, n1 long, n0 long")
    return partial.groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def significant_grams(counts: DataFrame) -> tuple[list, float, float]:
    """Rows (bucket, gain, clean share) of grams typical of label 1, and what
    share of clean text is neutral. At most one row per table position."""
    n1, n0 = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not n1 or not n0:
        return [], 0.0, 1.0
    prior_total = PRIOR_SHARE * (n1 + n0)
    prior = F.lit(PRIOR_SHARE) * (F.col("n1") + F.col("n0"))
    odds = lambda n, all_: F.log((F.col(n) + prior) / (F.lit(all_ + prior_total) - F.col(n) - prior))
    delta = odds("n1", n1) - odds("n0", n0)
    z = delta / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    share = (F.col("n0") + prior) / F.lit(n0 + prior_total)
    rows = (
        counts.select("bucket", F.least(delta, F.lit(MAX_GAIN)).alias("gain"), share.alias("share"), z.alias("z"))
        .filter((F.col("z") >= MIN_Z) & (F.col("gain") > 0))
        .collect()
    )
    return sorted((r.bucket, r.gain, r.share) for r in rows), n1, n0


def decay_rate(gains: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    rest = 1.0 - shares.sum()
    low, high = 1e-6, 20.0
    for _ in range(100):
        rate = (low + high) / 2
        if (shares * np.exp(np.minimum(rate * gains, 600))).sum() + rest * np.exp(-rate * drift) > 1.0:
            high = rate
        else:
            low = rate
    return low


def fit(docs: DataFrame, labels: DataFrame, usable: Column, bound: int = TRAIN_ROWS) -> Model:
    """Learn from about ``bound`` labelled rows that satisfy ``usable``.

    Without both labels in the sample nothing is learned: every score is then
    the share of label 1 (0 without labels).
    """
    sample = labelled_sample(docs, labels, "toxic", usable, bound)
    rows, n1, n0 = significant_grams(settle(_counts(sample), "grams"))
    nothing = np.zeros(0)
    model = Model(nothing.astype(np.int64), nothing, 1.0, 1.0, nothing, 0.0)
    if not rows:
        mean = sample.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
        model.base = float(mean or 0.0)
        return model
    model.buckets = np.array([r[0] for r in rows], np.int64)
    model.gains = np.array([r[1] for r in rows])
    model.rate = decay_rate(model.gains, np.array([r[2] for r in rows]), DRIFT)
    table = _table(model)

    def run(batches):
        for batch in batches:
            best, lengths, found = [], [], []
            for length, segments in _segments(batch.column(0), table):
                best.append(max((s for _, _, s in segments), default=0.0))
                lengths.append(length)
                found.append([s for _, _, s in segments])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(lengths, pa.int64()), pa.array(best, pa.float64()), pa.array(found, pa.list_(pa.float64()))],
                ["label", "n", "best", "found"],
            )

    # a bounded table of numbers: one row per sampled text
    scored = map_arrow(sample.select("text", "label"), run, "label int, n long, best double, found array<double>").collect()
    clean = [(r.n, r.best) for r in scored if r.label <= 0]
    model.scale = len(clean) / max(1e-9, sum(n * np.exp(-model.rate * s) for n, s in clean))
    x = [_evidence(r.n, [(0, 0, s) for s in r.found], model.rate, model.scale)[0] for r in scored]
    model.weights = fit_logistic(np.log1p(np.array(x))[:, None], np.array([float(r.label > 0) for r in scored]))
    return model


def score(docs: DataFrame, model: Model, name: str = "toxicity", spans: str | None = "passages") -> DataFrame:
    """``docs`` with the chance of label 1 and the significant passages.

    A passage has its byte offsets in the lower-cased UTF-8 text, its score and the number
    of such passages expected in clean text. Null and empty texts, and texts
    shorter than a gram, have no evidence and get the score of none. All columns
    are passed on; ``name`` and ``spans`` must be new.
    """
    for new in (name, spans):
        if new in docs.columns:
            raise ValueError(f"column {new!r} exists")
    at = docs.columns.index("text")

    def run(batches):
        table = _table(model)
        for batch in batches:
            evidence, passages = [], []
            for length, segments in _segments(batch.column(at), table):
                x, kept = _evidence(length, segments, model.rate, model.scale)
                evidence.append(x)
                passages.append([{"start": a, "end": b + GRAM, "score": s, "e_value": e} for a, b, s, e in kept])
            if len(model.weights):
                p = logistic(model.weights[0] * np.log1p(np.array(evidence)) + model.weights[1])
            else:
                p = np.full(len(evidence), model.base)
            columns = [*batch.columns, pa.array(p, pa.float64())]
            names = [*batch.schema.names, name]
            if spans:
                kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
                columns.append(pa.array(passages, pa.list_(kind)))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = f", `{name}` double" + (
        f", `{spans}` array<struct<start: bigint, end: bigint, score: double, e_value: double>>" if spans else ""
    )
    return map_arrow(docs, run, fields_of(docs) + extra)
