import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.functions import text as T
from labelspark.operators import features as X
from labelspark.operators import metrics as M
from labelspark.operators import weights as W
from labelspark.plans import flows
from labelspark.plans.joins import KEY_BYTES, frequent_join
from labelspark.session import settle

RNG = np.random.default_rng(5)
N, C = 40, 6
LOGITS = RNG.normal(0, 3, (N, C))
LOGITS[0] = [50, -50, 50, -50, 0, 0]
TRUTH = (RNG.random((N, C)) < [0.5, 0.3, 0.2, 0.1, 0.05, 0.0]).astype(float)
COUNTS = TRUTH.sum(0)


def sigma(x):
    return 1 / (1 + np.exp(-x))


def ref_bce(x, z):
    return np.maximum(x, 0) - x * z + np.log1p(np.exp(-np.abs(x)))


def ref_focal(x, z):
    b = ref_bce(x, z)
    return 0.5 * (1 - np.exp(-b)) ** 2 * b


def ref_weights():
    with np.errstate(divide="ignore"):
        pos = (N - COUNTS) / COUNTS
        inv = 1 / np.sqrt(COUNTS)
        cb = (1 - 0.99) / (1 - 0.99**COUNTS)
    pos[np.isinf(pos)], inv[np.isinf(inv)], cb[np.isinf(cb)] = 1, 0, 0
    return pos, inv / inv.sum() * C, cb / cb.sum() * C, -np.log(COUNTS.sum() / (COUNTS + 1e-8) - 1) * 0.05


def ref_loss(name):
    pos, inv, cb, bias = ref_weights()
    x, z = LOGITS, TRUTH
    tx = (x + bias) * (1 - z) * 2 + (x + bias) * z
    tw = cb / 2 * (1 - z) + cb * z
    return {
        "bce": ref_bce(x, z),
        "pos-weighted-bce": pos * z * np.logaddexp(0, -x) + (1 - z) * np.logaddexp(0, x),
        "weighted-bce": inv * ref_bce(x, z),
        "fl": 5 * ref_focal(x, z),
        "cb": cb * ref_bce(x, z),
        "cb-fl": cb * ref_focal(x, z),
        "ntr": ref_bce(tx, z),
        "ntr-fl": ref_focal(tx, z),
        "cb-ntr": tw * ref_bce(tx, z),
        "cb-ntr-fl": tw * ref_focal(tx, z),
    }[name].mean()


@pytest.fixture
def tables(spark):
    rows = [(i, LOGITS[i].tolist(), np.flatnonzero(TRUTH[i]).tolist()) for i in range(N)]
    df = spark.createDataFrame(rows, "row_id int, logits array<double>, ids array<bigint>").repartition(3)
    classes = spark.range(C).withColumnRenamed("id", "label_id")
    positives = W.class_positives(classes, df.select(F.explode("ids").alias("label_id")))
    return M.score_cells(df, "logits", "ids"), positives


@pytest.mark.parametrize("name", list(W.CRITERIA))
def test_losses(tables, name):
    cells, positives = tables
    got = W.loss(cells, name, positives, F.lit(N)).first()["loss"]
    assert got == pytest.approx(ref_loss(name), rel=1e-12)


def test_unknown_criterion(tables):
    with pytest.raises(NotImplementedError):
        W.loss(*tables[:1], "nope", tables[1], F.lit(N))


def test_weights(tables):
    _, positives = tables
    pos, inv, cb, bias = ref_weights()
    for df, column, want in [
        (W.pos_weights(positives, F.lit(N)), "weight", pos),
        (W.inverse_root_weights(positives), "weight", inv),
        (W.class_balanced_weights(positives), "weight", cb),
        (W.logit_biases(positives), "bias", bias),
        (W.start_biases(positives), "bias", np.full(C, W.start_bias(C))),
    ]:
        got = [r[column] for r in df.orderBy("label_id").collect()]
        assert got == pytest.approx(want.tolist(), rel=1e-9)


def test_distillation(spark):
    teacher, student = LOGITS[::-1].copy(), LOGITS
    rows = [(float(teacher[i, c]), float(student[i, c]), float(TRUTH[i, c])) for i in range(N) for c in range(C)]
    df = spark.createDataFrame(rows, "teacher double, student double, truth double")
    got = W.distillation_loss(df, W.bce(F.col("student"), F.col("truth")), 2.0, 0.3).first()
    p, q = sigma(teacher / 2), -np.logaddexp(0, -student / 2)
    kl = (p * (np.log(p) - q)).sum() / N / C * 4
    assert got["kl"] == pytest.approx(kl, rel=1e-9)
    assert got["loss"] == pytest.approx(0.7 * ref_bce(student, TRUTH).mean() + 0.3 * kl, rel=1e-9)


DOCS = ["le chat dort le chat", "le chien", "", "un chat et le chien chien"]


def test_tfidf(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "row_id int, text string").repartition(3)
    counts = X.term_counts(df, T.word_tokens(F.col("text")), "row_id")
    train = counts.filter("row_id < 3")
    weights = X.tfidf_weights(counts, X.document_frequency(train), F.lit(3), "row_id")
    got = {(r["row_id"], r["term"]): r["weight"] for r in weights.collect()}
    toks = [re.findall(r"\b\w\w+\b", d) for d in DOCS]
    vocab = {t for d in toks[:3] for t in d}
    for i, d in enumerate(toks):
        raw = {t: d.count(t) * (math.log(4 / (1 + sum(t in x for x in toks[:3]))) + 1) for t in set(d) & vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got.pop((i, t)) == pytest.approx(v / norm, rel=1e-12)
    assert not got


def moved(df):
    """Rows that the shuffles of a plan wrote, by what they were dealt by."""
    df.collect()
    found, nodes = {}, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if name == "ShuffleExchangeExec":
                key = re.sub(r"#\d+L?", "", node.outputPartitioning().toString())
                found[key] = found.get(key, 0) + node.metrics().apply("shuffleRecordsWritten").value()
    return found


def test_frequent_join_moves_rare_keys_only(spark, rows_of):
    long = "x" * (KEY_BYTES + 1)
    keys = ["a"] * 20 + ["b"] * 10 + ["c", "c", "d", "new", "new", None, long, long, long]
    left = settle(spark.createDataFrame(list(enumerate(keys)), "id int, k string").repartition(3))
    right = settle(spark.createDataFrame([("a", 20, 1), ("b", 10, 2), ("c", 2, 3), ("d", 1, 4), ("none", 1, 5), (None, 9, 6), (long, 30, 7)], "k string, n bigint, v int"))
    got = frequent_join(left, right, "k", "n", frequent_keys=8)
    assert rows_of(got.select("id", "k", "n", "v")) == rows_of(left.join(right, "k").select("id", "k", "n", "v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # five rare left rows with a match, two without, three of the long key; four rare right rows
        assert sum(moved(frequent_join(left, right, "k", "n", frequent_keys=8)).values()) <= 8 + 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tfidf_moves_a_frequent_term_once(spark):
    df = spark.createDataFrame([(i, f"le chat {i % 3}0 dort") for i in range(60)] + [(None, "le chat")], "row_id int, text string").repartition(3, "row_id")
    counts = settle(X.term_counts(df, T.word_tokens(F.col("text")), "row_id"))
    frequencies = settle(X.document_frequency(counts))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights = X.tfidf_weights(counts, frequencies, F.lit(61), "row_id")
        # by row, and never by term
        assert sum(moved(weights).values()) == counts.count() == weights.count() == 242
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_classical_features_move_no_vectors(spark, monkeypatch):
    rows = [(i, f"le chat {i % 3}0 dort", "train") for i in range(60)] + [(60, "", "test"), (60, "", "test")]
    df = spark.createDataFrame(rows, "row_id int, text string, split string").repartition(7, "row_id")
    plans = {}
    real = flows.settle
    monkeypatch.setattr(flows, "settle", lambda df, purpose="table", **kw: plans.update({purpose: df}) or real(df, purpose, **kw))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vocabulary, ready = flows.classical_features(df, T.word_tokens(F.col("text")))
        # every cell once and every row once
        assert sum(moved(plans["features"]).values()) <= 4 * 60 + len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert vocabulary.count() == 6 and ready.count() == len(rows)
    assert ready.filter("row_id = 60 and size(indices) = 0 and size(values) = 0").count() == 2
    assert ready.filter("indices = array_sort(indices)").count() == len(rows)


def test_grams(spark):
    df = spark.createDataFrame([(["ab", "c", "ab"],), ([],), (["a"],)], "w array<string>")
    got = sorted(r[0] for r in df.select(X.word_ngrams(F.col("w"), 3)).collect())
    assert got == [[], ["a"], ["ab", "c", "ab", "ab c", "c ab", "ab c ab"]]
    words = spark.createDataFrame([("ab",), ("é",), ("abcdef",)], "w string")
    grams = {r[0]: r[1] for r in words.select("w", X.char_ngrams(F.col("w"))).collect()}
    for word in grams:
        marked = f"<{word}>"
        assert grams[word] == [marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)]
    rows = X.gram_rows(df.withColumn("row_id", F.lit(1)), F.col("w"), "row_id", n=2)
    assert rows.filter("gram = 'ab c'").count() == 1 and rows.filter("gram = '<ab'").count() == 2
    hashed = X.hashed_counts(rows, "row_id", buckets=50)
    assert hashed.agg(F.sum("n")).first()[0] == rows.count()


def test_gram_rows_open_places_in_compiled_code(spark):
    texts = [["ab", "c", "ab"], [], None, ["a"], ["x", None, "y", "z"], ["é d", "e"]]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, w array<string>").repartition(3)
    for n in (1, 3, 5):
        rows = X.gram_rows(df, F.col("w"), "row_id", n=n, chars=False)
        want = [(i, " ".join(t[at : at + k])) for i, t in enumerate(texts) for k in range(1, n + 1) for at in range(len(t or []) - k + 1) if None not in t[at : at + k]]
        assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
    # an array function over all of a text's runs would be interpreted, element by element
    assert not re.search("zip_with|lambda", rows._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("chars", [True, False])
def test_buckets_are_counted_where_grams_are_made(spark, monkeypatch, chars):
    """the same counts as from rows of n-grams, without rows of n-grams."""
    from labelspark.operators import grams

    long, wide = "w" * 70, "слово" * 9
    texts = [["ab", "c", "ab", "ab", "c"], [], None, [""], ["", "x", None, "y", "z"], ["é d", "e", "", "😀a"], [long, wide, "c", long, "c"], [None, "ab"], ["c"] * 30]
    ids = [3, 3, 5, 1, None, None, 7, 8, 9]
    df = spark.createDataFrame(list(zip(ids, texts)), "row_id int, w array<string>").repartition(4)
    want = None
    for chunk, kept, piece in ((50_000, 200_000, 4096), (1, 1, 2), (6, 4, 3)):
        monkeypatch.setattr(grams, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(grams, "KEPT_WORDS", kept)
        monkeypatch.setattr(grams, "PIECE", piece)
        for n in (1, 2, 5):
            made, left = (X.gram_rows(df, F.col("w"), "row_id", n=n, chars=chars, made=m) for m in (True, False))
            want = {tuple(r) for r in X.hashed_counts(made, "row_id", 97, X.portable_bucket).collect()}
            rows = [tuple(r) for r in X.hashed_counts(left, "row_id", 97, X.portable_bucket).collect()]
            assert len(rows) == len(want) and set(rows) == want
            assert {r[0] for r in rows} >= {None, 3, 7}
    other = X.hashed_counts(left, "row_id", 97)
    assert sorted(map(str, other.collect())) == sorted(map(str, X.hashed_counts(made, "row_id", 97).collect()))
    assert "md5" not in X.hashed_counts(left, "row_id", 97, X.portable_bucket)._jdf.queryExecution().executedPlan().toString()


def test_stems_merge(spark, rows_of):
    df = spark.createDataFrame([(1, "chats", 2), (1, "chat", 1), (2, "chats", 5)], "row_id int, term string, tf bigint")
    assert rows_of(X.stem_terms(df, lambda c: F.regexp_replace(c, "s$", ""), "row_id")) == [(1, "chat", 3), (2, "chat", 5)]
