"""Fingerprints and components against a plain restatement and all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from labelspark.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, reach=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                root[find(i)] = find(j)
    out = []
    for i in range(len(prints)):
        group = [ids[j] for j in range(len(prints)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(group, default=None))
    return out


def test_edge_rows(edge_docs, edge_rows):
    got = sorted(map(tuple, simhash.near_duplicates(edge_docs).collect()), key=repr)
    prints = [plain_fingerprint(r[1]) for r in edge_rows]
    ids = [r[0] for r in edge_rows]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(prints, ids))]
    assert got == sorted(want, key=repr)


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def planted(seed, centres, around, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(around):
            value = base
            for bit in rng.sample(range(64), rng.randrange(flips + 1)):
                value ^= 1 << bit
            out.add(value)
    return np.array(sorted(out), np.uint64).view(np.int64)


def linked(spark, values, monkeypatch=None):
    table = spark.createDataFrame([(int(v),) for v in values], "fp long")
    return components.components(simhash.links(table, 4))


def test_clusters_equal_all_pairs(spark):
    values = planted(1, 60, 12, 3)
    roots = {r.node: r.root for r in linked(spark, values).collect()}
    got = [roots.get(int(v), int(v)) for v in values]
    want = plain_components([int(v) & (2**64 - 1) for v in values], [int(v) for v in values])
    assert got == want


def test_crowded_keys_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 64)
    values = planted(2, 2, 700, 3)
    roots = {r.node: r.root for r in linked(spark, values).collect()}
    got = [roots.get(int(v), int(v)) for v in values]
    assert got == plain_components([int(v) & (2**64 - 1) for v in values], [int(v) for v in values])


def test_partitions_keep_the_pigeonhole_promise():
    cells = np.random.default_rng(0).integers(1, 50, (16, 16))
    cells[0] = [4000] + [1] * 15  # a cell without information
    total = int(cells[1].sum())
    for n in (100, total, 10**9):
        plan = simhash.allocate(cells, n, 4)
        assert sum(t + 1 for _, _, t in plan) == 5
        assert all(a < b for a, b, _ in plan) and all(p[1] <= q[0] for p, q in zip(plan, plan[1:]))


def test_both_sides_of_a_pair_share_a_probe():
    rng = random.Random(5)
    for width, threshold in ((12, 0), (16, 1), (16, 2), (20, 3)):
        masks = simhash.probe_masks(width, threshold)
        assert len(masks) == simhash.probe_count(width, threshold)
        for _ in range(50):
            a = rng.getrandbits(width)
            b = a
            for bit in rng.sample(range(width), threshold):
                b ^= 1 << bit
            assert {a ^ int(m) for m in masks} & {b ^ int(m) for m in masks}


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 500)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7)], "u long, v long").repartition(5, F.rand(1))
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 500)}}
