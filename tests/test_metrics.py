import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.functions import scores as S
from labelspark.operators import metrics as M
from labelspark.plans.flows import evaluate_with_search


def reference(truth, pred):
    """Micro metrics of 0/1 matrices, AUC by ranks with ties."""
    t, p = truth.ravel().astype(bool), pred.ravel().astype(bool)
    tp, fp, fn, tn = (t & p).sum(), (~t & p).sum(), (t & ~p).sum(), (~t & ~p).sum()
    ratio = lambda a, b: a / b if b else 1.0
    auc = None
    if t.any() and not t.all():
        wins = (p[t][:, None] > p[~t][None, :]).mean() + 0.5 * (p[t][:, None] == p[~t][None, :]).mean()
        auc = float(wins)
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), auc


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(3)
    n, c = 60, 7
    scores = rng.random((n, c))
    scores[0] = 0.0
    scores[1] = 1.0
    scores[2] = [0.01 + i * 0.05 for i in range(c)]  # equal to thresholds
    truth = rng.random((n, c)) < 0.3
    rows = [(i, "train" if i % 2 else "test", scores[i].tolist(), np.flatnonzero(truth[i]).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, split string, scores array<double>, truth_ids array<bigint>").repartition(5)
    return scores, truth, df


def close(row, expected):
    for name, want in zip(M.METRICS, expected):
        got = row[name]
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12), (name, got, want)


@pytest.mark.parametrize("step, steps", [(0.05, 20), (0.01, 99)])
def test_one_pass_grid_equals_loop(data, step, steps):
    scores, truth, df = data
    grid = M.threshold_grid(M.score_cells(df, "scores", "truth_ids"), step=step, steps=steps).collect()
    want = np.arange(0.01, 1, step)
    assert len(grid) == steps == len(want)
    for row, threshold in zip(sorted(grid, key=lambda r: r["threshold"]), want):
        assert row["threshold"] == threshold
        close(row, reference(truth, scores >= threshold))
        assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == truth.size


def test_partitions_do_not_matter(data):
    _, _, df = data
    one = M.threshold_grid(M.score_cells(df.coalesce(1), "scores", "truth_ids")).collect()
    many = M.threshold_grid(M.score_cells(df.repartition(9), "scores", "truth_ids")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_search_then_score(data):
    scores, truth, df = data
    cells = M.score_cells(df, "scores", "truth_ids", "split")
    got = evaluate_with_search(cells, valid="train").collect()
    odd = np.arange(len(scores)) % 2 == 1
    by_f1 = [(reference(truth[odd], scores[odd] >= t)[2], -t) for t in np.arange(0.01, 1, 0.05)]
    best = -max(by_f1)[1]
    assert len(got) == 1 and got[0]["threshold"] == best
    close(got[0], reference(truth[~odd], scores[~odd] >= best))


def test_in_rows_equals_long(data, rows_of):
    scores, truth, df = data
    pred = F.transform(
        F.filter(F.transform("scores", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: e["s"] >= 0.6),
        lambda e: e["i"].cast("bigint"),
    )
    rows = df.withColumn("p", pred)
    inside = M.with_metrics(M.confusion_in_rows(rows, "truth_ids", "p", truth.shape[1])).collect()[0]
    close(inside, reference(truth, scores >= 0.6))
    long = M.confusion_long(
        rows.select("row_id", F.explode("truth_ids").alias("label")), rows.select("row_id", F.explode("p").alias("label")),
        "row_id", "label",
    ).collect()[0]
    assert (long["tp"], long["fp"], long["fn"]) == (inside["tp"], inside["fp"], inside["fn"])


@pytest.mark.parametrize("truth, pred", [([], []), ([0, 1], []), ([], [0, 1]), ([0, 1], [0, 1])])
def test_empty_denominators(spark, truth, pred):
    df = spark.createDataFrame([(truth, pred)], "t array<int>, p array<int>")
    row = M.with_metrics(M.confusion_in_rows(df, "t", "p", 2)).collect()[0]
    dense = lambda ids: np.array([[i in ids for i in range(2)]])
    close(row, reference(dense(truth), dense(pred)))


def test_frequent_baseline(spark):
    train = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "label string")
    rows = spark.createDataFrame([(1, ["A", "A"]), (2, ["B", "D"]), (3, [])], "row_id int, labels array<string>")
    got = {r["k"]: r for r in M.most_frequent_baseline(train, rows, F.lit(4), max_k=5).collect()}
    truth = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 0, 0]])
    assert set(got) == set(range(6))
    for k in got:
        pred = np.zeros((3, 4))
        pred[:, : min(k, 3)] = 1
        close(got[k], reference(truth, pred))


def test_top_k(data, rows_of):
    scores, truth, df = data
    best = M.ranked_predictions(df, "scores", 3, "row_id", threshold=0.2)
    for i in range(len(scores)):
        order = sorted(range(7), key=lambda c: (-scores[i][c], c))[:3]
        want = [c for c in order if scores[i][c] >= 0.2]
        assert [r["label_id"] for r in sorted(best.filter(F.col("row_id") == i).collect(), key=lambda r: r["rank"])] == want
        if i > 6:
            break
    for row in M.top_k_grid(df, "scores", "truth_ids", "row_id", max_k=4).collect():
        k = row["k"]
        pred = np.zeros_like(truth)
        for i in range(len(scores)):
            pred[i, sorted(range(7), key=lambda c: (-scores[i][c], c))[:k]] = True
        seen = truth.any(0) | pred.any(0)
        close(row, reference(truth[:, seen], pred[:, seen]))


def test_wide_results(spark):
    df = spark.createDataFrame(
        [("m", "a", 0.1, 1), ("m", "a", 0.2, 2), ("m", "b", 0.3, 1), ("n", "b", 0.4, 1)], "model string, split string, f1 double, _order int"
    )
    got = {r["model"]: (r["a_f1"], r["b_f1"]) for r in M.wide_results(df, "model", "split", ["a", "b"], ["f1"]).collect()}
    assert got == {"m": (0.2, 0.3), "n": (None, 0.4)}


def test_latency(spark):
    values = [5.0, 1.0, 2.0, 2.0, 9.5, 3.0]
    rows = [("x", i, v) for i, v in enumerate(values)] + [("one", 99, 7.0)] + [("hot", 100 + i, 4.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(4)
    got = {r["g"]: r for r in M.latency_summary(df, "v", "id", "g").collect()}
    row = got["x"]
    assert row["num_iter"] == 6 and abs(row["time_avg_ms_per_seq"] - np.mean(values)) < 1e-12
    assert abs(row["time_median_ms_per_seq"] - np.median(values)) < 1e-12
    assert abs(row["time_std_ms_per_seq"] - np.std(values)) < 1e-12
    assert abs(row["time_p95_ms_per_seq"] - np.percentile(values, 95)) < 1e-9
    assert (got["one"]["time_p95_ms_per_seq"], got["one"]["time_std_ms_per_seq"]) == (7.0, 0.0)
    assert got["hot"]["time_median_ms_per_seq"] == 4.0


def test_scores(spark):
    df = spark.createDataFrame([([0.0, 800.0, -800.0, 2.0],)], "x array<double>")
    row = df.select(S.sigmoid_scores(F.col("x")), S.argmax_class(F.col("x")), S.binarize_logits(F.col("x"))).collect()[0]
    assert row[0][:3] == [0.5, 1.0, 0.0] and row[1] == 1 and row[2] == [0, 1, 0, 1]


def test_label_precision(spark):
    df = spark.createDataFrame([(["A", "B"], ["B", "C"]), ([], ["A"])], "g array<string>, v array<string>")
    assert M.generated_label_precision(df, "g", "v").collect()[0]["precision"] == 0.5
