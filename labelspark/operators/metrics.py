"""Micro-averaged evaluation in one pass over sparse or dense predictions.

Counting is arithmetic on TP, FP, FN and the number of (row, class) cells; no
N x C matrix is built, and a search over thresholds or k reads the scores once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.scores import safe_ratio, thresholds_met
from labelspark.functions.text import opened
from labelspark.plans.order import exact_quantiles
from labelspark.session import settle

# The searched thresholds are START + i*STEP below one.
GRID_START = 0.01
COARSE_STEP, COARSE_STEPS = 0.05, 20
FINE_STEP, FINE_STEPS = 0.01, 99

METRICS = ["precision", "recall", "f1", "auc_score"]


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and auc_score to tp, fp, fn, tn.

    An empty denominator scores 1. auc_score is the area under the ROC curve of
    the 0/1 predictions: the mean of both class recalls, null if a class is
    absent.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        safe_ratio(tp, tp + fp, 1.0).alias("precision"),
        safe_ratio(tp, tp + fn, 1.0).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn, 1.0).alias("f1"),
        ((safe_ratio(tp, tp + fn) + safe_ratio(tn, tn + fp)) / 2).alias("auc_score"),
    )


def confusion_in_rows(df: DataFrame, truth: str, predicted: str, n_classes: Column | int, *by: str) -> DataFrame:
    """tp, fp, fn, tn where both label arrays sit in the row: no shuffle by row."""
    cells = F.lit(n_classes) if isinstance(n_classes, int) else n_classes
    t, p = F.array_distinct(truth), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(t, p)).cast("bigint")
    sized = df.select(*by, hit.alias("_tp"), (F.size(p) - hit).alias("_fp"), (F.size(t) - hit).alias("_fn"))
    counted = sized.groupBy(*by).agg(
        F.coalesce(F.sum("_tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("_fp"), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("_fn"), F.lit(0)).alias("fn"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return counted.withColumn("tn", F.col("n_rows") * cells - F.col("tp") - F.col("fp") - F.col("fn"))


def confusion_long(truth: DataFrame, predicted: DataFrame, row_id: str, label: str, *by: str) -> DataFrame:
    """tp, fp, fn from two long tables, matched on (row, label).

    A union and one grouping stand in for the full outer join; the key is the
    pair, so no label or row can overload a task.
    """
    sides = truth.select(*by, row_id, label, F.lit(1).alias("_t"), F.lit(0).alias("_p")).unionByName(
        predicted.select(*by, row_id, label, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    )
    pairs = sides.groupBy(*by, row_id, label).agg(F.max("_t").alias("_t"), F.max("_p").alias("_p"))
    return pairs.groupBy(*by).agg(
        F.sum(F.col("_t") * F.col("_p")).cast("bigint").alias("tp"),
        F.sum((1 - F.col("_t")) * F.col("_p")).cast("bigint").alias("fp"),
        F.sum(F.col("_t") * (1 - F.col("_p"))).cast("bigint").alias("fn"),
    )


def score_cells(df: DataFrame, scores: str, truth_ids: str, *keep: str,
                score: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """(keep…, label_id, score, truth 0/1), one row per class, made in place.

    ``score`` turns a stored value into the score wanted, a sigmoid for example,
    after the array is opened: compiled code per value instead of an
    interpreted array function.
    """
    cells = df.select(*keep, truth_ids, F.posexplode_outer(scores).alias("label_id", "_value"))
    return cells.filter(F.col("label_id").isNotNull()).select(
        *keep,
        "label_id",
        score(F.col("_value").cast("double")).alias("score"),
        F.array_contains(truth_ids, F.col("label_id").cast("bigint")).cast("bigint").alias("truth"),
    )


def threshold_grid(cells: DataFrame, *by: str, start: float = GRID_START, step: float = COARSE_STEP,
                   steps: int = COARSE_STEPS) -> DataFrame:
    """Metrics at every grid threshold from one pass over the scores.

    Each score is reduced to the number of thresholds it meets, so the only
    shuffle carries (steps + 1) counters per task and group. The fan-out to
    thresholds happens on those counters.
    """
    level = thresholds_met(F.col("score"), start, step, steps)
    counters = cells.groupBy(*by, level.alias("_level")).agg(
        F.sum("truth").alias("_pos"), F.sum(1 - F.col("truth")).alias("_neg")
    )
    fanned = counters.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    met = F.col("_i") < F.col("_level")
    counts = fanned.groupBy(*by, "_i").agg(
        F.sum(F.when(met, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(met, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(met, 0).otherwise(F.col("_pos"))).alias("fn"),
        F.sum(F.when(met, 0).otherwise(F.col("_neg"))).alias("tn"),
    )
    threshold = F.lit(start) + F.col("_i") * F.lit(step)
    return with_metrics(counts.select(*by, threshold.alias("threshold"), "tp", "fp", "fn", "tn"))


def evaluate_at(cells: DataFrame, threshold: Column | float, *by: str) -> DataFrame:
    """Metrics at one threshold; a Column may hold a scalar subquery."""
    cut = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = F.col("score") >= cut
    counts = cells.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("truth")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 1 - F.col("truth")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("truth"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(1 - F.col("truth"))).alias("tn"),
    )
    return with_metrics(counts)


def best_by_f1(results: DataFrame, parameter: str, *by: str) -> DataFrame:
    """The row with the highest f1; the smallest parameter breaks ties."""
    if not by:
        return results.orderBy(F.desc("f1"), F.asc(parameter)).limit(1)
    others = [c for c in results.columns if c not in by]
    best = results.groupBy(*by).agg(
        F.max_by(F.struct(*others), F.struct(F.col("f1"), -F.col(parameter))).alias("_best")
    )
    return best.select(*by, "_best.*")


def most_frequent_baseline(train: DataFrame, rows: DataFrame, n_classes: Column, max_k: int = 50,
                           labels: str = "labels") -> DataFrame:
    """Predict the k most frequent train labels for every row, k = 0..max_k.

    ``train`` is long (label); ``rows`` has label arrays. The k-th true positive
    count is a running sum of evaluation counts in train rank order.
    """
    ranked = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(max_k)
    # at most max_k rows from here on
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("label").alias("label"))))
    ranks = ranked.agg(order.alias("_top")).select(F.posexplode("_top").alias("_pos", "_entry"))
    ranks = ranks.select((F.col("_pos") + 1).alias("rank"), F.col("_entry.label").alias("label"))
    # one pass: hits per label, and under the null label the number of rows
    marked = F.concat(F.array_distinct(labels), F.array(F.lit(None).cast("string")))
    seen = settle(
        rows.select(F.explode_outer(marked).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("hits")), "hits"
    )
    n_rows = seen.filter("label IS NULL").agg(F.coalesce(F.sum("hits"), F.lit(0))).scalar()
    positives = seen.filter("label IS NOT NULL").agg(F.coalesce(F.sum("hits"), F.lit(0))).scalar()
    found = F.broadcast(ranks).join(seen, "label", "left").select(
        "rank", F.coalesce("hits", F.lit(0)).alias("hits")
    )
    steps = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_k))))
    inside = F.col("rank") <= F.col("k")
    counted = steps.groupBy("k").agg(
        F.sum(F.when(inside, F.col("hits")).otherwise(0)).alias("tp"),
        F.sum(inside.cast("bigint")).alias("_used"),
    )
    counted = counted.withColumn("fp", n_rows * F.col("_used") - F.col("tp")).withColumn(
        "fn", positives - F.col("tp")
    )
    counted = counted.withColumn("tn", n_rows * n_classes - F.col("tp") - F.col("fp") - F.col("fn"))
    return with_metrics(counted.select("k", "tp", "fp", "fn", "tn"))


def ranked_predictions(df: DataFrame, scores: str, k: int, *keep: str, threshold: float = 0.0) -> DataFrame:
    """The k best classes of each row at or above the threshold.

    Sorted inside the row: score descending, then class id. ``rank`` from 1.
    """
    pairs = F.transform(scores, lambda s, i: F.struct((-s.cast("double")).alias("neg"), i.alias("id")))
    best = F.filter(F.slice(F.array_sort(pairs), 1, k), lambda p: -p["neg"] >= threshold)
    flat = df.select(*keep, F.posexplode_outer(best).alias("_pos", "_entry")).filter(F.col("_pos").isNotNull())
    return flat.select(
        *keep,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_entry.id").cast("bigint").alias("label_id"),
        (-F.col("_entry.neg")).alias("score"),
    )


def top_k_grid(df: DataFrame, scores: str, truth_ids: str, row_id: str, max_k: int = 10,
               threshold: float = 0.0) -> DataFrame:
    """Metrics of the k best classes per row, k = 1..max_k, in one pass.

    The classes counted for true negatives are those seen in truth or among the
    predictions at that k.
    """
    best = ranked_predictions(df, scores, max_k, row_id, truth_ids, threshold=threshold)
    hits = best.select(
        "rank", "label_id", F.array_contains(truth_ids, F.col("label_id")).cast("bigint").alias("hit")
    )
    # (rank, class) counters: at most max_k * classes rows after map-side sums
    cells = hits.groupBy("rank", "label_id").agg(F.sum("hit").alias("_tp"), F.count(F.lit(1)).alias("_n"))
    truth = opened(df, F.array_distinct(truth_ids), "label_id")
    truth_classes = truth.groupBy("label_id").agg(F.count(F.lit(1)).alias("_p"))
    first_seen = (
        cells.select("label_id", "rank")
        .unionByName(truth_classes.select("label_id", F.lit(0).alias("rank")))
        .groupBy("label_id")
        .agg(F.min("rank").alias("rank"))
    )
    ks = F.explode(F.sequence(F.lit(1), F.lit(max_k))).alias("k")
    by_rank = cells.groupBy("rank").agg(F.sum("_tp").alias("_tp"), F.sum("_n").alias("_n"))
    by_seen = first_seen.groupBy("rank").agg(F.count(F.lit(1)).alias("_c"))
    both = by_rank.select("rank", "_tp", "_n", F.lit(0).cast("bigint").alias("_c")).unionByName(
        by_seen.select("rank", F.lit(0).cast("bigint").alias("_tp"), F.lit(0).cast("bigint").alias("_n"), "_c")
    )
    inside = F.col("rank") <= F.col("k")
    counted = both.select("*", ks).groupBy("k").agg(
        *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c) for c in ("_tp", "_n", "_c")]
    )
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    positives = truth_classes.agg(F.coalesce(F.sum("_p"), F.lit(0))).scalar()
    counts = counted.select(
        "k",
        F.col("_tp").alias("tp"),
        (F.col("_n") - F.col("_tp")).alias("fp"),
        (positives - F.col("_tp")).alias("fn"),
        (n_rows * F.col("_c") - F.col("_n") - positives + F.col("_tp")).alias("tn"),
    )
    return with_metrics(counts)


def generated_label_precision(df: DataFrame, generated: str, verified: str, *by: str) -> DataFrame:
    """Share of generated labels that the verifier kept."""
    kept = F.size(F.array_intersect(generated, verified)).cast("bigint")
    sums = df.groupBy(*by).agg(
        F.sum(kept).alias("n_kept"), F.sum(F.size(F.array_distinct(generated)).cast("bigint")).alias("n_generated")
    )
    return sums.withColumn("precision", safe_ratio(F.col("n_kept"), F.col("n_generated"), 1.0))


def latency_summary(df: DataFrame, value: str, row_id: str, *by: str) -> DataFrame:
    """n, mean, median, population deviation and 95th percentile, interpolated."""
    moments = df.groupBy(*by).agg(
        F.count(value).alias("num_iter"),
        F.avg(value).alias("time_avg_ms_per_seq"),
        F.stddev_pop(value).alias("time_std_ms_per_seq"),
    )
    marks = exact_quantiles(
        df, value, {"time_median_ms_per_seq": 0.5, "time_p95_ms_per_seq": 0.95}, by, [row_id]
    )
    return moments.join(marks, list(by))


def mean_by(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def wide_results(results: DataFrame, row: str, split: str, splits: Sequence[str],
                 values: Sequence[str] = METRICS) -> DataFrame:
    """One row per ``row`` with a column ``{split}_{metric}`` for each pair.

    Naming the splits keeps the schema fixed and saves a distinct scan. Of a
    repeated key the row with the greatest ``_order`` wins; without such a column
    a repeated key is an error.
    """
    ordered = "_order" in results.columns

    def cell(s: str, v: str) -> Column:
        mine = F.col(split) == s
        value = F.when(mine, F.col(v))
        if ordered:
            return F.max_by(value, F.when(mine, F.col("_order"))).alias(f"{s}_{v}")
        repeated = F.raise_error(F.lit(f"several results for {s}: add _order")).cast("double")
        return F.when(F.count_if(mine) > 1, repeated).otherwise(F.max(value)).alias(f"{s}_{v}")

    return results.groupBy(row).agg(*[cell(s, v) for s in splits for v in values])
