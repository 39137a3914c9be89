"""Similar sets against all pairs, and the tree's bounds against plain sums."""

import random

import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import jaccard


def plain_set(text, words=4):
    own = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def plain_rows(rows, percent=85):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [plain_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def family_texts(seed, families, most):
    """Families around the threshold, with passages that many texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(2)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))]
        if rng.random() < 0.5:
            base += rng.choice(shared)
        for _ in range(rng.randrange(1, most)):
            texts.append(" ".join(edited(rng, base, vocabulary, rng.randrange(0, 6))))
    rng.shuffle(texts)
    return texts


def found_rows(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jaccard.similar_sets(docs, **settings).collect()), key=repr)


def test_edge_rows(edge_docs, edge_rows, no_docs):
    wide = edge_docs.withColumnRenamed("label", "_row").withColumnRenamed("hash", "first")
    got = sorted(map(tuple, jaccard.similar_sets(wide).collect()), key=repr)
    assert got == plain_rows([(r[0], r[1]) for r in edge_rows])
    assert jaccard.similar_sets(no_docs).count() == 0


@pytest.mark.parametrize("tree_rows", [jaccard.TREE_ROWS, 12])
def test_equals_all_pairs(spark, monkeypatch, tree_rows):
    """With one tree for a shingle, and with crowded shingles cut into blocks."""
    monkeypatch.setattr(jaccard, "TREE_ROWS", tree_rows)
    rows = list(enumerate(family_texts(5, 40, 14)))
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (2000, None), (2001, " "), (2002, "one two"), (2003, "one two")]
    want = plain_rows(rows)
    assert found_rows(spark, rows) == want
    assert 10 < len({c for _, _, c in want}) < len(rows) - 80


def test_other_settings(spark):
    rows = list(enumerate(family_texts(6, 15, 8)))
    assert found_rows(spark, rows, percent=60) == plain_rows(rows, 60)


def test_no_pair_escapes_the_tree():
    texts = family_texts(7, 60, 8)
    sets = list(jaccard.Shingler(4).sets(pa.array(texts)))
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    n = np.array([len(s) for s in sets])
    points = jaccard.points_of([jaccard.counted(s) for s in sets])
    tree = jaccard.CountTree(points, n, 85)
    query, point = tree.search(np.arange(len(n)))
    found = set(zip(query.tolist(), point.tolist()))
    links = {(i, j) for i in range(len(n)) for j in range(len(n)) if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])}
    assert links <= found and len(found) < 2 * len(links)
    for i, j in links:  # the meeting rule: a common shingle among the first ones
        first = [set(sets[x][: jaccard.prefix_size(n[x], 85)].tolist()) for x in (i, j)]
        assert first[0] & first[1]
    u, v = tree.forest()
    assert set(zip(u.tolist(), v.tolist())) <= found and len(u) < len(n)


def test_points_of_very_large_sets_stay_bounds():
    rng = np.random.default_rng(1)
    big = np.unique(rng.integers(0, 1 << 62, 900_000).astype(np.uint64))
    other = np.r_[big[:700_000], rng.integers(0, 1 << 62, 9).astype(np.uint64)]
    n = np.array([len(big), len(other)])
    points = jaccard.points_of([jaccard.counted(big), jaccard.counted(other)])
    assert np.minimum(points[0], points[1]).sum() >= 700_000 and (points.sum(axis=1) >= n).all()
