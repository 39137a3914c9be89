"""Score arithmetic on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """1/(1+e^-x) in the form that never overflows."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def sigmoid_scores(logits: Column) -> Column:
    """Logit array to probability array."""
    return F.transform(logits, lambda v: sigmoid(v.cast("double")))


def argmax_class(scores: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def binarize(scores: Column, threshold: float = 0.5) -> Column:
    """0/1 array for probabilities: at or above the threshold counts."""
    return F.transform(scores, lambda s: F.when(s >= threshold, 1).otherwise(0))


def binarize_logits(logits: Column) -> Column:
    """0/1 array for logits: strictly above zero counts."""
    return F.transform(logits, lambda s: F.when(s > 0, 1).otherwise(0))


def thresholds_met(score: Column, start: float, step: float, steps: int) -> Column:
    """How many of the grid points ``start + i*step`` are <= score.

    A division gives the guess; comparing with the exact neighbours removes
    its rounding error, so the count equals ``steps`` separate comparisons.
    """
    guess = F.floor((score - start) / step).cast("int")
    at = lambda i: F.lit(start) + i * F.lit(step)
    exact = (
        F.when(at(guess + 1) <= score, guess + 2).when(at(guess) <= score, guess + 1).otherwise(guess)
    )
    return F.greatest(F.lit(0), F.least(exact, F.lit(steps)))


def safe_ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num/den as double; ``empty`` when the denominator is zero."""
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(num.cast("double") / den)
