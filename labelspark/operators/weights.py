"""Class weights, logit biases and multi-label losses as aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.scores import log_sigmoid, sigmoid

# Fixed values of the ten criteria.
BETA = 0.99
NEG_SCALE = 2.0
INIT_BIAS = 0.05
BIAS_EPS = 1e-8
FOCAL_ALPHA, FOCAL_GAMMA, FOCAL_WEIGHT = 0.5, 2.0, 5.0


def class_positives(vocab_ids: DataFrame, encoded: DataFrame) -> DataFrame:
    """(label_id, n): rows per class; classes without rows count 0."""
    counts = encoded.groupBy("label_id").agg(F.count(F.lit(1)).alias("_n"))
    return vocab_ids.select("label_id").join(counts, "label_id", "left").select(
        "label_id", F.coalesce("_n", F.lit(0)).alias("n")
    )


def _scaled_to_classes(df: DataFrame, raw: Column, name: str) -> DataFrame:
    """raw * C / sum(raw): weights that average one."""
    with_raw = df.withColumn("_raw", raw)
    factor = with_raw.agg((F.count(F.lit(1)) / F.sum("_raw")).alias("f")).scalar()
    return with_raw.withColumn(name, F.col("_raw") * factor).drop("_raw")


def pos_weights(positives: DataFrame, n_rows: Column, smooth: float = 1.0) -> DataFrame:
    """negatives / positives; 1 for a class without positives."""
    n = F.col("n").cast("double")
    ratio = F.when(n == 0, F.lit(1.0)).otherwise((n_rows - n) / n)
    return positives.withColumn("weight", F.pow(ratio, F.lit(1.0 / smooth)))


def inverse_root_weights(positives: DataFrame, smooth: float = 2.0) -> DataFrame:
    raw = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.pow(F.col("n").cast("double"), F.lit(-1.0 / smooth)))
    return _scaled_to_classes(positives, raw, "weight")


def class_balanced_weights(positives: DataFrame, beta: float = BETA) -> DataFrame:
    n = F.col("n").cast("double")
    raw = F.when(n == 0, F.lit(0.0)).otherwise((1 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), n)))
    return _scaled_to_classes(positives, raw, "weight")


def logit_biases(positives: DataFrame, init_bias: float = INIT_BIAS, eps: float = BIAS_EPS) -> DataFrame:
    """Negative-tolerant bias, larger for frequent classes."""
    total = positives.agg(F.sum("n")).scalar()
    odds = total / (F.col("n") + F.lit(eps)) - 1
    return positives.withColumn("bias", -F.log(odds) * F.lit(init_bias))


def start_bias(n_classes: int) -> float:
    """Classifier bias that makes every class as likely as 1/C at the start."""
    share = 1.0 / n_classes
    return -math.log((1.0 - share) / share)


def start_biases(positives: DataFrame) -> DataFrame:
    c = positives.agg(F.count(F.lit(1))).scalar().cast("double")
    share = F.lit(1.0) / c
    return positives.select("label_id", (-F.log((1 - share) / share)).alias("bias"))


def bce(x: Column, z: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large values."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


def bce_pos_weighted(x: Column, z: Column, p: Column) -> Column:
    return -(p * z * log_sigmoid(x) + (1 - z) * log_sigmoid(-x))


def focal(x: Column, z: Column, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    loss = bce(x, z)
    balance = F.when(z == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return balance * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss


def tolerant_logit(x: Column, z: Column, bias: Column, neg_scale: float = NEG_SCALE) -> Column:
    return (x + bias) * (z + (1 - z) * F.lit(neg_scale))


def tolerant_weight(w: Column, z: Column, neg_scale: float = NEG_SCALE) -> Column:
    return w * (z + (1 - z) / F.lit(neg_scale))


def _plain(x: Column, z: Column, w: Column, b: Column) -> Column:
    return bce(x, z)


# name → (needs, expression of logit, target, weight, bias)
CRITERIA: dict[str, tuple[str | None, bool, Callable[[Column, Column, Column, Column], Column]]] = {
    "bce": (None, False, _plain),
    "pos-weighted-bce": ("pos", False, lambda x, z, w, b: bce_pos_weighted(x, z, w)),
    "weighted-bce": ("inverse_root", False, lambda x, z, w, b: w * bce(x, z)),
    "fl": (None, False, lambda x, z, w, b: F.lit(FOCAL_WEIGHT) * focal(x, z)),
    "cb": ("balanced", False, lambda x, z, w, b: w * bce(x, z)),
    "cb-fl": ("balanced", False, lambda x, z, w, b: w * focal(x, z)),
    "ntr": (None, True, lambda x, z, w, b: bce(tolerant_logit(x, z, b), z)),
    "ntr-fl": (None, True, lambda x, z, w, b: focal(tolerant_logit(x, z, b), z)),
    "cb-ntr": ("balanced", True, lambda x, z, w, b: tolerant_weight(w, z) * bce(tolerant_logit(x, z, b), z)),
    "cb-ntr-fl": ("balanced", True, lambda x, z, w, b: tolerant_weight(w, z) * focal(tolerant_logit(x, z, b), z)),
}


def class_parameters(criterion: str, positives: DataFrame, n_rows: Column) -> DataFrame | None:
    """(label_id, weight, bias) a criterion needs, or None."""
    if criterion not in CRITERIA:
        raise NotImplementedError(f"criterion {criterion} is not supported")
    kind, biased, _ = CRITERIA[criterion]
    if kind is None and not biased:
        return None
    table = positives
    if kind == "pos":
        table = pos_weights(table, n_rows)
    elif kind == "inverse_root":
        table = inverse_root_weights(table)
    elif kind == "balanced":
        table = class_balanced_weights(table)
    else:
        table = table.withColumn("weight", F.lit(1.0))
    table = logit_biases(table) if biased else table.withColumn("bias", F.lit(0.0))
    return table.select("label_id", "weight", "bias")


def loss(cells: DataFrame, criterion: str, positives: DataFrame, n_rows: Column) -> DataFrame:
    """Mean loss over all (row, class) cells as one row.

    ``cells`` has label_id, score (a logit) and truth. Class parameters are one
    double pair per class, no more than one row's logits hold, which bounds the
    broadcast; the sums are combined map-side.
    """
    parameters = class_parameters(criterion, positives, n_rows)
    joined = cells if parameters is None else cells.join(F.broadcast(parameters), "label_id")
    nothing = F.lit(None).cast("double")
    weight = nothing if parameters is None else F.col("weight")
    bias = nothing if parameters is None else F.col("bias")
    value = CRITERIA[criterion][2](F.col("score"), F.col("truth").cast("double"), weight, bias)
    return joined.agg(F.avg(value).alias("loss"))


def distillation_loss(cells: DataFrame, hard: Column, temperature: float = 1.0, kl_weight: float = 0.5) -> DataFrame:
    """(kl, hard, loss) from teacher and student logits per (row, class) cell."""
    p = sigmoid(F.col("teacher") / F.lit(temperature))
    q = log_sigmoid(F.col("student") / F.lit(temperature))
    entropy = F.when(p == 0, F.lit(0.0)).otherwise(p * F.log(p))
    kl = F.avg(entropy - p * q) * F.lit(temperature**2)
    sums = cells.agg(kl.alias("kl"), F.avg(hard).alias("hard"))
    mixed = F.lit(1 - kl_weight) * F.col("hard") + F.lit(kl_weight) * F.col("kl")
    return sums.withColumn("loss", mixed)
