import random

import numpy as np
from pyspark.sql import functions as F

from labelspark.llm import toxicity
from labelspark.llm.common import held_out


def slow_segments(scores):
    """All maximal scoring segments by their definition: take the best, go on left and right."""
    out = []

    def search(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return
        i = -best[2]
        j = i - best[1]
        out.append((i, j - 1, best[0]))
        search(a, i)
        search(j, b)

    search(0, len(scores))
    return sorted(out)


def test_scan_finds_all_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 25)
        gains = {i: rng.randrange(1, 6) for i in range(n) if rng.random() < 0.4}
        scores = [gains.get(i, -0.75) for i in range(n)]
        at = sorted(gains)
        got = toxicity.maximal_segments(at, [gains[i] for i in at], 0.75)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(scores)]
        assert np.allclose([s for *_, s in got], [s for *_, s in slow_segments(scores)])


def test_decay_rate_solves_its_equation():
    gains, shares = np.array([2.0, 5.0]), np.array([0.01, 0.001])
    rate = toxicity.decay_rate(gains, shares, 0.5)
    assert abs((shares * np.exp(rate * gains)).sum() + 0.989 * np.exp(-0.5 * rate) - 1) < 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, ~out)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(out)
    n, right = scored.agg(F.count("*"), F.sum(((F.col("toxicity") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()
    assert n > 50 and right / n > 0.9


def test_edge_rows(spark, edge_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(i, None, int(i % 2)) for i in range(100, 140)] + [(None, 1, 1), (1, 0, None)], no_labels.schema)
    for given in (labels, no_labels):
        model = toxicity.fit(edge_docs, given, F.lit(True))
        rows = toxicity.score(edge_docs, model).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
        assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, labels, F.lit(True)).base == 0.0


def test_a_planted_passage_is_located(spark):
    clean = "the plain words of a quiet day by the river and the old mill "
    rows = [(i, clean * 3 + (f"{i} grubbleworm snarkface " if i % 2 else f"{i} ")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    for r in toxicity.score(docs, model).collect():
        assert (r.toxicity >= 0.5) == bool(r.doc_id % 2)
        if r.doc_id % 2:
            best = max(r.passages, key=lambda p: p.score)
            assert "rubblew" in r.text[best.start : best.end] or "narkfac" in r.text[best.start : best.end]
