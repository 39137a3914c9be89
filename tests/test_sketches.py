"""Sketches against exact answers, and resampled intervals against plain ones."""

import hashlib
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from labelspark.operators import sketches as K


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.paretovariate(0.8), f"u{int(rng.paretovariate(0.4)) % 40_000}") for i in range(60_000)]
    rows += [(90_000, "a", "x", None, None), (90_001, "c", "x", None, None), (90_002, None, "x", 1.0, "u")]
    return rows, spark.createDataFrame(rows, "id long, source string, split string, value double, who string").repartition(6).cache()


def test_roll_ups_of_stored_sketches_are_close(calls):
    rows, frame = calls
    stored = K.sketches(frame, ["source", "split"], distinct=["who"], quantiles=["value"])
    for r in K.every_level(stored, ["source", "split"]).select("source", "split", "n_rows", K.distinct_count("who")).collect():
        # a null of the data and a level without the column are told apart by their counts
        own = [x for x in rows if r.split is None or (x[1] == r.source and x[2] == r.split)]
        if r.split is None and r.source is not None:
            own = [x for x in rows if x[1] == r.source]
        if r.split is None and r.source is None and r.n_rows != len(rows):
            own = [x for x in rows if x[1] is None]
        assert r.n_rows == len(own)
        exact = len({x[4] for x in own if x[4] is not None})
        assert abs(r.n_who - exact) <= 0.04 * exact
    merged = K.rolled_up(stored, ["source"]).filter("source = 'a'").select(K.quantile("value", 0.95).alias("q")).first().q
    values = sorted(x[3] for x in rows if x[1] == "a" and x[3] is not None)
    assert abs(bisect_right(values, merged) / len(values) - 0.95) <= 0.01


def test_quantiles_of_skewed_values_are_close_in_rank(calls):
    rows, frame = calls
    shares = {"low": 0.01, "median": 0.5, "p95": 0.95, "p999": 0.999}
    found = K.sketched_summary(frame, "value", ["split"], shares)
    for r in found.collect():
        values = sorted(x[3] for x in rows if x[2] == r.split and x[3] is not None)
        assert r.n == len(values) and r["mean"] == pytest.approx(sum(values) / len(values))
        for name, share in shares.items():
            assert abs(bisect_right(values, r[name]) / len(values) - share) <= 0.01
    ranks = K.rank_share(frame, "value", found, "p95", ["split"]).collect()
    assert len(ranks) == 3 and all(r.below <= r.upto and abs(r.upto - 0.95) <= 0.01 for r in ranks)


def plain_weights(row_id, replicates):
    out = []
    for b in range(replicates):
        digits = hashlib.md5(f"bootstrap:{b // 4}:{row_id}".encode()).hexdigest()
        out.append(sum(int(digits[8 * (b % 4) : 8 * (b % 4) + 8], 16) >= cut for cut in K.POISSON))
    return out


def test_weights_are_poisson_and_depend_on_the_id_alone(spark):
    rows = spark.range(3_000).select("id", K.poisson_weights("id", 10).alias("w")).collect()
    assert all(r.w == plain_weights(r.id, 10) for r in rows[:50])
    weights = [w for r in rows for w in r.w]
    mean = sum(weights) / len(weights)
    assert abs(mean - 1) < 0.02 and abs(sum((w - mean) ** 2 for w in weights) / len(weights) - 1) < 0.04


def test_intervals_are_those_of_plain_resampling(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 3 == 0], rng.gauss(10, 3)) for i in range(300)] + [(900, "b", None), (901, "one", 4.0)]
    frame = spark.createDataFrame(rows, "id long, model string, value double").repartition(4)
    for r in K.mean_intervals(frame, "value", "id", ["model"], 40).collect():
        own = [(i, v) for i, m, v in rows if m == r.model and v is not None]
        assert r["mean"] == pytest.approx(sum(v for _, v in own) / len(own))
        means = []
        for b in range(40):
            weights = [plain_weights(i, 40)[b] for i, _ in own]
            if sum(weights):
                means.append(sum(w * v for w, (_, v) in zip(weights, own)) / sum(weights))
        means.sort()
        assert r.low == pytest.approx(means[max(1, -(-len(means) * 5 // 100)) - 1])
        assert r.high == pytest.approx(means[-(-len(means) * 95 // 100) - 1])
        assert r.low <= r["mean"] <= r.high


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, model string, value double")
    assert K.mean_intervals(empty, "value", "id", ["model"]).count() == 0
    assert K.sketched_summary(empty, "value", ["model"], {"m": 0.5}).count() == 0
    assert K.every_level(K.sketches(empty, ["model"], ["value"]), ["model"]).filter("n_rows > 0").count() == 0


def test_an_interval_takes_a_line_for_each_hash(spark):
    """Not one for each replicate, and no number is parsed from its digits."""
    frame = spark.range(40).selectExpr("id", "'a' AS model", "cast(id AS double) AS value")
    plan = K.mean_intervals(frame, "value", "id", ["model"], 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "posexplode" not in plan
    rows = [r.w for r in spark.range(40).select(K.poisson_weights("id", 6).alias("w")).collect()]
    assert rows == [plain_weights(i, 6) for i in range(40)]
