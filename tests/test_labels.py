import pytest
from pyspark.sql import functions as F

from labelspark.operators import labels as L
from labelspark.operators import profile as P

ROWS = [
    (0, "train", ["A", "B"]), (1, "train", ["B", "A", "C"]), (2, "train", ["A", "A"]),
    (3, "test", []), (4, "test", ["D", "A"]),
]


@pytest.fixture
def rows(table):
    return table(ROWS, "row_id int, split string, labels array<string>")


def test_counts_and_vocabulary(rows, rows_of):
    long = L.explode_labels(rows, "row_id", "split")
    assert rows_of(L.label_counts(long)) == [("A", 5), ("B", 2), ("C", 1), ("D", 1)]
    vocab = L.vocabulary(long)
    assert rows_of(vocab.select("label", "label_id")) == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    ranks = L.label_ranks(L.label_counts(long, "split"), "split")
    assert rows_of(ranks.select("split", "label", "rank")) == [
        ("test", "A", 1), ("test", "D", 2), ("train", "A", 1), ("train", "B", 2), ("train", "C", 3)
    ]
    assert rows_of(L.label_shares(L.label_counts(long)).select("label", "freq"))[0] == ("A", 5 / 9)
    assert rows_of(L.missing_from_train(long.filter("split='train'"), long.filter("split='test'"))) == [("D",)]


def test_one_label_is_no_vocabulary(table):
    with pytest.raises(ValueError):
        L.vocabulary(table([("A",), ("-1",)], "label string"))


def test_encoding(rows, rows_of, table):
    long = L.explode_labels(rows, "row_id")
    vocab = L.vocabulary(long)
    ids = L.label_ids(L.encode_labels(long, vocab, "row_id"), "row_id")
    assert rows_of(ids) == [(0, [0, 1]), (1, [0, 1, 2]), (2, [0]), (4, [0, 3])]
    hot = L.multi_hot(F.col("label_ids"), 4)
    names = F.array(*[F.lit(x) for x in "ABCD"])
    got = rows_of(ids.select("row_id", hot, L.decode_multi_hot(hot, names)))
    assert got[0] == (0, [1, 1, 0, 0], ["A", "B"])
    small = vocab.filter("label <> 'D'")
    assert len(L.encode_labels(long, small, "row_id", unknown="ignore").collect()) == 7
    with pytest.raises(Exception, match="not in vocabulary: D"):
        L.encode_labels(long, small, "row_id").collect()


def test_single_label(table, rows_of):
    df = table([(1, "x"), (2, "-1"), (3, "y")], "row_id int, label string")
    assert rows_of(L.encode_single(df, L.vocabulary(df), "label", "row_id").select("row_id", "label_id")) == [
        (1, 0), (2, -1), (3, 1)
    ]


def test_bucket_borders(table, rows_of):
    counts = table([("a", 19), ("b", 20), ("c", 99), ("d", 100)], "label string, n bigint")
    assert rows_of(L.buckets(counts).select("label", "bucket")) == [
        ("a", "tail"), ("b", "medium"), ("c", "medium"), ("d", "head")
    ]
    assert ("d", "tail") in rows_of(L.buckets(counts, compat=True).select("label", "bucket"))
    bucketed = L.buckets(counts)
    long = table([(1, "a"), (1, "d"), (2, "b"), (2, "c"), (3, "z")], "row_id int, label string")
    assert rows_of(L.rows_by_bucket(long, bucketed, "row_id")) == [(1, "head"), (1, "tail"), (2, "medium")]
    assert rows_of(L.rows_by_bucket(long, bucketed, "row_id", mode="all")) == [(2, "medium")]
    shares = L.bucket_shares(bucketed).groupBy("bucket").agg(F.sum("freq")).collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in shares)


def test_valid_rows(table, rows_of):
    rows = table([(1, ["A"] * 20), (2, ["A"] * 21), (3, ["A", "Z"]), (4, [])], "row_id int, labels array<string>")
    valid = table([("A",), ("B",)], "code string")
    assert [r[0] for r in rows_of(L.valid_label_rows(rows, valid, "row_id"))] == [1, 4]


def test_upsample(rows, rows_of):
    copies = dict(rows_of(L.upsample(rows, "row_id").groupBy("row_id").count()))
    # target 5: B has 2, C and D have 1
    assert copies == {0: 2, 1: 5, 2: 1, 3: 1, 4: 5}
    assert dict(rows_of(L.upsample(rows, "row_id", target=1).groupBy("row_id").count())) == {i: 1 for i in range(5)}


def test_upsample_in_blocks(rows, rows_of, monkeypatch):
    monkeypatch.setattr(L, "COPY_BLOCK", 7)
    out = L.upsample(rows, "row_id", target=100)
    copies = dict(rows_of(out.groupBy("row_id").agg(F.count_distinct("copy"))))
    assert copies == {0: 50, 1: 100, 2: 20, 3: 1, 4: 100} and out.count() == 271
    assert out.agg(F.min("copy"), F.max("copy")).first()[:] == (1, 100)


def brute_pairs(rows, compat):
    from collections import Counter
    from itertools import combinations

    out = Counter()
    for _, _, labels in rows:
        for a, b in combinations(labels, 2):
            if not compat:
                out[tuple(sorted((a, b)))] += 1
            elif a <= b:
                out[(a, b)] += 1
    return sorted((a, b, n) for (a, b), n in out.items())


@pytest.mark.parametrize("compat", [False, True])
def test_cooccurrence(rows, rows_of, compat):
    assert rows_of(P.cooccurrence_pairs(rows, compat=compat)) == brute_pairs(ROWS, compat)


def test_cooccurrence_ratio(rows, rows_of):
    counts = L.label_counts(L.explode_labels(rows))
    ratios = {(i, j): r for i, j, r in rows_of(P.cooccurrence_ratios(P.cooccurrence_pairs(rows), counts))}
    assert ratios[("A", "B")] == 2 / 2 and ratios[("B", "A")] == 2 / 5 and ratios[("A", "A")] == 1 / 5
    assert ("B", "D") not in ratios


def test_profile(table, rows_of):
    df = table(
        [("s", "train", "a b  c", ["X", "Y"]), ("s", "train", "", ["X"]), ("t", "test", " one ", [])],
        "source string, split string, text string, labels array<string>",
    )
    got = {(r["source"], r["split"]): r for r in P.dataset_profile(df, P.SUBSETS).collect()}
    assert set(got) == {("s", "train"), ("t", "test"), ("s", "all"), ("t", "all"), ("all", "train"), ("all", "test"), ("all", "all")}
    top = got[("s", "train")]
    assert (top["num_examples"], top["num_labels"], top["num_unique_labels"], top["top_labels"]) == (2, 3, 2, "X(2), Y(1)")
    assert (top["avg_words"], top["avg_labels"], top["avg_label_freq"], top["imbalance"]) == (1.5, 1.5, 1.5, 2.0)
    assert got[("all", "all")]["num_examples"] == 3 and got[("t", "test")]["num_unique_labels"] == 0


def test_coverage(rows, rows_of):
    long = L.explode_labels(rows, "split")
    assert rows_of(P.label_coverage(long, [("train", "test"), ("test", "train")])) == [
        ("test", "train", 2, 3, 2, 2 / 3 * 100), ("train", "test", 3, 2, 1, 50.0)
    ]
