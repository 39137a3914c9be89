"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    filled = [(i, c) for i, c in counts if c]
    n_docs, length = len(filled), sum(sum(c.values()) for _, c in filled)
    df = Counter(t for _, c in filled for t in c)
    out = []
    by_id = {}
    for item_id, text in items:
        by_id.setdefault(item_id, set()).update(terms(text))
    for item_id, wanted in by_id.items():
        found = []
        for doc_id, c in filled:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


def corpus(seed, n, items):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary).upper() + rng.choice([",", "", ".", "-"]) for _ in range(k))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(80)]  # ties
    return docs, [(i, text(rng.randrange(1, 25))) for i in range(items)]


def found_rows(spark, docs, items, **settings):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(frame, wanted, **settings).collect()), key=repr)


@pytest.mark.parametrize("seeds", [lexical.SEEDS, 60])
def test_equals_scores_of_all_documents(spark, monkeypatch, seeds):
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    docs, items = corpus(1, 500, 12)
    assert found_rows(spark, docs, items) == plain_search(docs, items)


def test_blocks_of_items_and_small_trees_give_the_same(spark, monkeypatch):
    docs, items = corpus(2, 300, 9)
    want = plain_search(docs, items, 7)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)
    monkeypatch.setattr(lexical, "POINT_CELLS", 2_000)
    assert found_rows(spark, docs, items, top=7) == want


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    items = [(1, "Seven, EIGHT nine"), (2, None), (3, ""), (None, "über straße text"), (4, "!!"), (5, "alpha"), (5, "beta"), (6, "zzzz")]
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted(map(tuple, lexical.search(edge_docs, wanted).collect()), key=repr)
    assert got == plain_search([(r[0], r[1]) for r in edge_rows], items)
    assert lexical.search(no_docs, wanted).count() == 0
    assert lexical.search(edge_docs, wanted.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_node_pairs_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    points = np.zeros((6_000, 60), np.int64)
    for row in range(len(points)):  # topics: few terms of one of six groups
        points[row, 10 * (row % 6) + rng.integers(0, 10, 4)] = rng.integers(1_000, 900_000, 4)
    weights = np.zeros((24, 60), np.int64)
    for item in range(24):
        weights[item, 10 * (item % 6) + rng.integers(0, 10, 5)] = rng.integers(1, 9_000, 5)
    search = lexical.Search(weights, 10, np.ones(24, np.int64))
    ids = pa.array(np.arange(6_000))
    for at in range(0, 6_000, 1_500):
        search.run(points[at : at + 1_500], ids.slice(at, 1_500))
    scores = points @ weights.T
    for item in range(24):
        best = sorted(zip((-scores[:, item]).tolist(), range(6_000)))[:10]
        held = search.best.held[item]
        assert sorted(zip((-np.array(held["score"])).tolist(), held["doc_id"].to_pylist()))[:10] == best
    assert search.scored < 0.3 * 6_000 * 24  # most documents are never scored
