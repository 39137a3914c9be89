import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.llm import decontaminate


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_ends_is_the_best_stretch():
    rng = random.Random(4)
    for _ in range(30):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 8))]
        region = [rng.randrange(4) for _ in range(rng.randrange(0, 10))]
        got = decontaminate.edit_ends(np.array(item), np.array(region, np.int64))
        want = [min(word_distance(item, region[a:b]) for a in range(b + 1)) for b in range(len(region) + 1)]
        assert got.tolist() == want


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[at] = f"new{rng.randrange(1000)}"
        elif kind < 0.67:
            words.insert(at, f"more{rng.randrange(1000)}")
        elif len(words) > 1:
            words.pop(at)
    return words


def test_planted_passages_are_found_and_clean_text_is_not(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows, want = [], {}
    for n in range(400):
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        at = rng.randrange(len(around) + 1)
        if n % 2:
            item = rng.randrange(len(items))
            limit = int(0.2 * len(items[item]))
            body = edited(rng, items[item], rng.randrange(limit + 1))
            around[at:at] = [w.upper() + "," for w in body]
            want[n] = item
        rows.append((n, " ".join(around)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find(docs, benchmark).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*").collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert sum((d, i) in pairs for d, i in want.items()) / len(want) >= 0.93
    texts = dict(rows)
    for r in found:  # every answer is verified: the stretch really is that close
        stretch = texts[r.doc_id].replace(",", "").lower().split()[r.first_word : r.end_word]
        assert word_distance(items[r.item_id], stretch) == r.distance <= 0.2 * len(items[r.item_id])
        assert r.doc_id in want


def test_blocks_of_items_give_the_same_answer(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = decontaminate.find(docs, items).select("doc_id", F.array_sort("items")).collect()
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (5_000,))
    assert len(list(decontaminate.item_blocks(items))) > 1
    cut = decontaminate.find(docs, items).select("doc_id", F.array_sort("items")).collect()
    assert {r.doc_id for r in whole if r[1]} == {r.doc_id for r in cut if r[1]} != set()


def test_edge_rows(spark, edge_docs, no_docs):
    long_item = " ".join(f"q{i}" for i in range(300))
    items = [(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "word"), (None, long_item), (5, "one two three four five six seven eight")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find(edge_docs, benchmark).collect()
    assert len(rows) == edge_docs.count()
    assert sorted((r.doc_id, r["items"][0].item_id) for r in rows if r["items"]) == [(1, 1), (2, 1), (2, 1)]
    assert decontaminate.find(no_docs, benchmark).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] for r in decontaminate.find(edge_docs, empty).collect())


@pytest.mark.parametrize("length", [5, 8, 16, 24, 32, 60, 100, 200, 384])
def test_recall_by_item_length_at_the_edits_allowed(length):
    """Items of one length alone, so that no shorter ones bring more tables."""
    rng = random.Random(length)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(length))) for i in range(40)]
    block = decontaminate._block(items)
    hashes, cuts = [], [0]
    for own in block.words:
        around = [[rng.getrandbits(62) for _ in range(rng.randrange(8, 200))] for _ in range(2)]
        body = edited(rng, own.tolist(), int(0.2 * length + 1e-9))
        hashes += around[0] + [rng.getrandbits(62) if isinstance(w, str) else w for w in body] + around[1]
        cuts.append(len(hashes))
    texts = np.array(hashes, np.uint64), np.array(cuts), block, decontaminate.Table(block.keys)
    found = decontaminate._search(*texts, decontaminate.Table(block.pairs))
    assert found == decontaminate._search(*texts, None)  # the pair filter loses nothing
    assert len({d for d, i, *_ in found if d == i}) >= 0.9 * len(items)
    assert all(d == i for d, i, *_ in found)


def test_pair_filter_changes_no_answer():
    """Common words, repeated items and edits: the same matches with and without."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 70))] for _ in range(60)]
    block = decontaminate._block([(i, " ".join(w)) for i, w in enumerate(items)])
    hash_of = {w: h for text, own in zip(items, block.words) for w, h in zip(text, own.tolist())}
    hashes, cuts = [], [0]
    for n in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        own = items[n % len(items)]
        words[len(words) // 2 : len(words) // 2] = edited(rng, own, rng.randrange(int(0.25 * len(own)) + 1))
        hashes += [hash_of.setdefault(w, rng.getrandbits(62)) for w in words]
        cuts.append(len(hashes))
    texts = np.array(hashes, np.uint64), np.array(cuts), block, decontaminate.Table(block.keys)
    found = decontaminate._search(*texts, decontaminate.Table(block.pairs))
    assert found == decontaminate._search(*texts, None) and len(found) > 200


def test_short_items_scripts_without_blanks_and_text_ids(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(20))
    items = [("four", "alpha beta gamma delta"), ("two", "omega psi"), ("han", han), ("one", "zeta")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    changed = han[:7] + "们" + han[8:]
    texts = ["x alpha beta, gamma delta y", "alpha beta delta gamma", f"前{han}后ok", f"ab {changed}", "omega. Psi", "zeta", han[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.find(docs, benchmark).collect()
    got = sorted((r.doc_id, i.item_id, i.distance, i.first_word, i.end_word) for r in rows for i in r["items"])
    assert got == [(0, "four", 0, 1, 5), (2, "han", 0, 1, 21), (3, "han", 1, 1, 21), (4, "two", 0, 0, 2)]
