"""One query per operator over the test tables. ``oracles.py`` has the SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.functions import scores as S
from labelspark.functions import stem as ST
from labelspark.functions import text as T
from labelspark.functions.hashing import hash_hex, uniform_int
from labelspark.operators import corpus as C
from labelspark.operators import features as X
from labelspark.operators import infer as I
from labelspark.operators import labels as L
from labelspark.operators import metrics as M
from labelspark.operators import profile as P
from labelspark.operators import prompt as Q
from labelspark.operators import reshape as R
from labelspark.operators import sample as SA
from labelspark.operators import sketches as K
from labelspark.operators import weights as WE
from labelspark.plans import flows
from labelspark.plans.joins import frequent_join
from labelspark.plans.order import first_rows
from labelspark.session import SMALL, TASK_BYTES, new_folder, settle, tasks_for
from labelspark.sources import readers, writers
from labelspark.sources import tables as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings shared with the SQL.
STOPWORDS = ["die", "et", "la", "le", "les", "of", "que", "sh", "sch", "the", "th", "und"]
LABELLING_TEMPLATE = "## Codes\n\n{context}\n\n## Format\n\n{{codes}}\n\n## Text\n\n{input_text}"
VERIFYING_TEMPLATE = "## Text\n\n{input_text}\n\n## Codes\n\n{labels}"
DOCUMENT_TEMPLATE = (
    "Types:\n\n<types>\n- note\n- letter\n- report\n- summary\n- form\n</types>\n\n"
    "Styles:\n\n<styles>\n- long\n- short\n- {{plain}}\n- formal\n</styles>\n\n## Codes\n\n{labels}"
)
N_PROB_CLASSES = 8
TEMPERATURE, KL_WEIGHT = 2.0, 0.3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: Column | str, name: str) -> Column:
    return F.round(column, 6).alias(name)


def rounded_metrics(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "tp", "fp", "fn", "tn", *[r6(m, m) for m in M.METRICS])


# --- labels ----------------------------------------------------------------


@query
def label_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return L.vocabulary(D.order_labels_long(spark, sf, with_parts=True)).select("label", "label_id")


@query
def label_freq(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_counts(P.explode_labels(D.order_labels(spark, sf), "split"), "split")


@query
def label_freq_norm(spark: SparkSession, sf: str) -> DataFrame:
    counts = L.label_counts(D.order_labels_long(spark, sf), "split")
    return L.label_shares(counts, "split").select("split", "label", r6("freq", "freq"))


@query
def label_rank(spark: SparkSession, sf: str) -> DataFrame:
    counts = L.label_counts(D.order_labels_long(spark, sf, with_parts=True), "split")
    return L.label_ranks(counts, "split").select("split", "label", "n", F.col("rank").cast("bigint").alias("rank"))


@query
def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.top_labels(L.label_counts(D.order_labels_long(spark, sf, with_parts=True)), 5)


@query
def multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf)
    vocab = L.vocabulary(long)
    ids = L.label_ids(L.encode_labels(long, vocab, "row_id"), "row_id")
    n = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = ids.withColumn("_n", n)
    hot = L.multi_hot(F.col("label_ids"), F.col("_n"))
    return sized.select("row_id", F.array_join(F.transform(hot, lambda b: b.cast("string")), "").alias("hot"))


@query
def decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf)
    vocab = L.vocabulary(long)
    ids = L.label_ids(L.encode_labels(long, vocab, "row_id"), "row_id")
    # one name per class: as wide as a row's own 0/1 vector
    ordered = F.array_sort(F.collect_list(F.struct("label_id", "label")))
    names = vocab.agg(F.transform(ordered, lambda e: e["label"]).alias("names")).scalar()
    wide = ids.withColumn("_names", names)
    decoded = L.decode_multi_hot(L.multi_hot(F.col("label_ids"), F.size("_names")), F.col("_names"))
    return wide.select("row_id", F.array_join(decoded, ",").alias("labels"))


@query
def single_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    orders = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "P", L.UNLABELLED).otherwise(F.col("o_orderpriority")).alias("label"),
    )
    vocab = L.vocabulary(orders)
    return L.encode_single(orders, vocab, "label", "row_id").select("row_id", "label", "label_id")


@query
def missing_labels(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    return L.missing_from_train(long.filter("split = 'train'"), long.filter("split <> 'train'"))


# --- profile ---------------------------------------------------------------


def _profile(df: DataFrame) -> DataFrame:
    return df.select(
        "source", "split", "num_examples", "num_labels", "num_unique_labels", "top_labels",
        *[r6(c, c) for c in ("avg_words", "avg_labels", "avg_label_freq", "imbalance")],
    )


@query
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(P.dataset_profile(D.labelled_documents(spark, sf)))


@query
def profile_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(P.dataset_profile(D.labelled_documents(spark, sf), P.SUBSETS))


@query
def hist_num_words(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(D.corpus(spark, sf), T.num_words(F.col("text")), "split")


@query
def hist_num_labels(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(D.order_labels(spark, sf), F.size("labels").cast("bigint"), "split")


@query
def mean_labels(spark: SparkSession, sf: str) -> DataFrame:
    return P.mean_labels_truncated(D.order_labels(spark, sf))


@query
def cooccurrence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.cooccurrence_pairs(D.order_labels(spark, sf), "split")


@query
def cooccurrence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.order_labels(spark, sf)
    counts = L.label_counts(P.explode_labels(rows))
    ratios = P.cooccurrence_ratios(P.cooccurrence_pairs(rows), counts)
    return ratios.select("label_i", "label_j", r6("ratio", "ratio"))


@query
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return P.label_coverage(long, pairs).withColumn("pct", F.round("pct", 6))


# --- metrics ---------------------------------------------------------------


def _two_labelings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands of an order's cheap lines as truth, of its big lines as prediction."""
    items = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_quantity")
    parts = D.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("label"))
    lines = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.withColumn("row_id", F.col("l_orderkey")).withColumn("split", D.split_of("row_id"))
    return (
        lines.filter("l_discount >= 0.03").select("split", "row_id", "label"),
        lines.filter("l_quantity >= 15").select("split", "row_id", "label"),
    )


@query
def micro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    truth, predicted = _two_labelings(spark, sf)
    counts = M.confusion_long(truth, predicted, "row_id", "label", "split")
    orders = D.table(spark, sf, "orders").select(D.split_of("o_orderkey").alias("split"))
    n_rows = orders.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
    classes = D.table(spark, sf, "part").agg(F.count_distinct("p_brand").alias("c")).scalar()
    full = counts.join(n_rows, "split").withColumn("tn", F.col("_n") * classes - F.expr("tp + fp + fn")).drop("_n")
    return rounded_metrics(M.with_metrics(full), "split")


@query
def micro_metrics_in_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.labelled_documents(spark, sf)
    has_the = F.when(T.num_words(F.col("text")) > 200, F.lit("quality"))
    guess = F.filter(F.array(F.lit("en"), has_the), lambda l: l.isNotNull())
    counts = M.confusion_in_rows(rows.withColumn("guess", guess), "labels", "guess", 6, "split")
    return rounded_metrics(M.with_metrics(counts), "split")


def _probability(value: Column) -> Column:
    return S.sigmoid(D.logit(value))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return M.score_cells(D.raw_scores(spark, sf), "embedding", "truth_ids", "split", score=_probability)


@query
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = M.threshold_grid(_cells(spark, sf), "split")
    return rounded_metrics(grid.withColumn("threshold", F.round("threshold", 6)), "split", "threshold")


@query
def threshold_grid_fine(spark: SparkSession, sf: str) -> DataFrame:
    grid = M.threshold_grid(_cells(spark, sf), step=M.FINE_STEP, steps=M.FINE_STEPS)
    return rounded_metrics(grid.withColumn("threshold", F.round("threshold", 6)), "threshold")


@query
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    best = M.best_by_f1(M.threshold_grid(_cells(spark, sf)), "threshold")
    return rounded_metrics(best.withColumn("threshold", F.round("threshold", 6)), "threshold")


@query
def tuned_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    scored = flows.evaluate_with_search(_cells(spark, sf))
    return rounded_metrics(scored.withColumn("threshold", F.round("threshold", 6)), "split", "threshold")


@query
def metrics_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_metrics(M.evaluate_at(_cells(spark, sf), 0.66, "split"), "split")


@query
def results_pivot(spark: SparkSession, sf: str) -> DataFrame:
    grid = M.threshold_grid(_cells(spark, sf), "split").withColumn("threshold", F.round("threshold", 6))
    splits = ["test", "train", "validation"]
    wide = M.wide_results(grid, "threshold", "split", splits)
    return wide.select("threshold", *[r6(f"{s}_{m}", f"{s}_{m}") for s in splits for m in M.METRICS])


@query
def topk_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.order_labels(spark, sf)
    train = P.explode_labels(rows.filter("split = 'train'"))
    classes = D.table(spark, sf, "part").agg(F.count_distinct("p_brand").alias("c")).scalar()
    return rounded_metrics(
        M.most_frequent_baseline(train, rows.filter("split = 'validation'"), classes), "k"
    )


@query
def topk_per_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.logits(spark, sf).withColumn("probs", S.sigmoid_scores(F.col("logits")))
    best = M.ranked_predictions(rows, "probs", 3, "row_id", threshold=0.6)
    return best.select("row_id", F.col("rank").cast("bigint").alias("rank"), "label_id", r6("score", "score"))


@query
def topk_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.logits(spark, sf).withColumn("probs", S.sigmoid_scores(F.col("logits")))
    grid = M.top_k_grid(rows, "probs", "truth_ids", "row_id")
    return rounded_metrics(grid.withColumn("k", F.col("k").cast("bigint")), "k")


@query
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return D.logits(spark, sf).select("row_id", S.argmax_class(F.col("logits")).alias("class_id"))


@query
def sigmoid_scores(spark: SparkSession, sf: str) -> DataFrame:
    probs = S.sigmoid_scores(F.col("logits"))
    cells = D.logits(spark, sf).select("row_id", F.posexplode_outer(probs).alias("label_id", "score"))
    return cells.select("row_id", F.col("label_id").cast("bigint").alias("label_id"), r6("score", "score"))


@query
def binarized(spark: SparkSession, sf: str) -> DataFrame:
    def bits(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda b: b.cast("string")), "")

    rows = D.logits(spark, sf).withColumn("probs", S.sigmoid_scores(F.col("logits")))
    return rows.select(
        "row_id", bits(S.binarize(F.col("probs"), 0.6)).alias("by_prob"), bits(S.binarize_logits(F.col("logits"))).alias("by_logit")
    )


@query
def label_precision(spark: SparkSession, sf: str) -> DataFrame:
    truth, predicted = _two_labelings(spark, sf)
    sides = predicted.select("split", "row_id", F.col("label").alias("g"), F.lit(None).cast("string").alias("v"))
    sides = sides.unionByName(truth.select("split", "row_id", F.lit(None).cast("string").alias("g"), F.col("label").alias("v")))
    rows = sides.groupBy("split", "row_id").agg(F.collect_set("g").alias("g"), F.collect_set("v").alias("v"))
    out = M.generated_label_precision(rows, "g", "v", "split")
    return out.select("split", "n_kept", "n_generated", r6("precision", "precision"))


@query
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    calls = D.table(spark, sf, "events").withColumn("length", (F.col("user_id") % 4).cast("string"))
    out = M.latency_summary(calls, "value", "event_id", "event_type", "length")
    names = [c for c in out.columns if c.startswith("time_")]
    return out.select("event_type", "length", "num_iter", *[r6(c, c) for c in names])


# What the sketches promise: relative error of counts, error of ranks.
DISTINCT_ERROR, RANK_ERROR = 0.04, 0.01


@query
def distinct_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of words by source and split, rolled up twice, against exact counts."""
    rows = D.corpus(spark, sf).select("source", "split", F.explode(T.word_tokens(F.lower("text"))).alias("word"))
    stored = settle(K.sketches(rows, ["split", "source"], distinct=["word"]), "sketches")
    found = K.every_level(stored, ["split", "source"]).select("split", "source", "n_rows", K.distinct_count("word"))
    words = settle(rows.distinct(), "words")
    exact = [
        words.groupBy(*keys).agg(F.count_distinct("word").alias("n_exact")).select(
            *[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("split", "source")], "n_exact"
        )
        for keys in (["split", "source"], ["split"], [])
    ]
    exact = exact[0].unionAll(exact[1]).unionAll(exact[2]).withColumnsRenamed({"split": "_split", "source": "_source"})
    met = found.join(exact, F.col("split").eqNullSafe(F.col("_split")) & F.col("source").eqNullSafe(F.col("_source")))
    close = F.abs(F.col("n_word") - F.col("n_exact")) <= DISTINCT_ERROR * F.col("n_exact")
    return met.select("split", "source", "n_rows", "n_exact", close.alias("close"))


@query
def latency_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles without a sort, and whether their exact ranks are close."""
    by = ["event_type", "length"]
    calls = D.table(spark, sf, "events").withColumn("length", (F.col("user_id") % 4).cast("string"))
    marks = {"median": 0.5, "p95": 0.95}
    found = settle(K.sketched_summary(calls, "value", by, marks), "summary")
    out = found.select(*by, F.col("n").alias("num_iter"), r6("mean", "mean"), r6("deviation", "deviation"))
    for name, share in marks.items():
        ranks = K.rank_share(calls, "value", found, name, by)
        close = (F.col("below") <= share + RANK_ERROR) & (F.col("upto") >= share - RANK_ERROR)
        out = out.join(ranks.select(*by, close.alias(f"{name}_close")), by)
    return out


@query
def mean_intervals(spark: SparkSession, sf: str) -> DataFrame:
    calls = D.table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), "value")
    found = K.mean_intervals(calls, "value", "event_id", ["model"])
    return found.select("model", *[r6(c, c) for c in ("mean", "low", "high")])


@query
def mean_by_group(spark: SparkSession, sf: str) -> DataFrame:
    calls = D.table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("string").alias("device"),
        (F.col("user_id") % 4).cast("string").alias("length"),
        F.col("event_type").alias("model"),
        "value",
    )
    return M.mean_by(calls, "value", "device", "length", "model").withColumn("mean_value", F.round("mean_value", 6))


@query
def named_models(spark: SparkSession, sf: str) -> DataFrame:
    names = {"click": "large", "view": "base"}
    return (
        D.table(spark, sf, "events")
        .select(T.map_names(F.col("event_type"), names).alias("model"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- dedup, filters, resume ------------------------------------------------


@query
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedup_exact(D.corpus(spark, sf), "row_id").select("row_id", F.md5("text").alias("text_md5"))


@query
def cross_split_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedup_across_splits(C.drop_empty_text(D.corpus(spark, sf)), "row_id").select("row_id", "split")


@query
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.corpus(spark, sf)
    done = docs.filter("split = 'test'")
    return C.not_yet_done(docs, done, spread_by="row_id").select("row_id")


@query
def filter_valid_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.order_labels(spark, sf)
    valid = D.brand_dictionary(spark, sf).filter("code <> 'Brand#7'")
    kept = L.valid_label_rows(rows, valid, "row_id", max_labels=4)
    return kept.select("row_id", F.array_join("labels", ",").alias("labels"))


@query
def filter_bucket(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    bucketed = L.buckets(L.label_counts(long.filter("split = 'train'")))
    return L.rows_by_bucket(long, bucketed, "row_id").select("row_id", "bucket")


@query
def filter_bucket_all(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True).filter("label like 'P%'")
    bucketed = L.buckets(L.label_counts(long))
    return L.rows_by_bucket(long, bucketed, "row_id", mode="all").select("row_id", "bucket")


# --- reshape ---------------------------------------------------------------


@query
def bucket_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    return L.buckets(L.label_counts(long)).select("label", "n", "bucket")


@query
def bucket_head_tail_compat(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    return L.buckets(L.label_counts(long), compat=True).select("label", "n", "bucket")


@query
def bucket_freqs(spark: SparkSession, sf: str) -> DataFrame:
    bucketed = L.buckets(L.label_counts(D.order_labels_long(spark, sf, with_parts=True)))
    return L.bucket_shares(bucketed).select("bucket", F.col("label").alias("code"), F.round("freq", 9).alias("freq"))


@query
def bucket_rows(spark: SparkSession, sf: str) -> DataFrame:
    long = D.order_labels_long(spark, sf, with_parts=True)
    bucketed = L.buckets(L.label_counts(long.filter("split = 'train'")))
    rows = L.rows_by_bucket(long, bucketed, "row_id", "split")
    return rows.groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def upsample(spark: SparkSession, sf: str) -> DataFrame:
    out = L.upsample(D.labelled_documents(spark, sf), "row_id")
    return out.select("row_id", F.col("copy").cast("bigint").alias("copy"))


@query
def mixture_ratio(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    mixed = R.mixtures(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), "row_id")
    return mixed.select("row_id", "multiplier")


@query
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    orders = D.table(spark, sf, "orders").select("o_orderkey")
    return R.split_exact(orders, "o_orderkey", "7")


@query
def split_exact_three(spark: SparkSession, sf: str) -> DataFrame:
    orders = D.table(spark, sf, "orders").select("o_orderkey")
    return R.split_exact(orders, "o_orderkey", "8", test_rows=1000, valid_rows=1000)


@query
def split_fraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(C.with_labels_only(D.order_labels(spark, sf)).select("row_id"))
    return R.split_fraction(rows, "row_id", "9")


@query
def shuffle_limit(spark: SparkSession, sf: str) -> DataFrame:
    return R.shuffled(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "3", n=500)


@query
def first_n(spark: SparkSession, sf: str) -> DataFrame:
    return first_rows(D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 100, "o_orderkey")


@query
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_batches(D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# --- text ------------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.documents(spark, sf)


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("row_id", T.clean_text(F.col("text")).alias("text"))


@query
def normalize_nfkd(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("row_id", T.normalize_features(F.col("text")).alias("text"))


@query
def normalize_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("row_id", T.normalize_bag(F.col("text")).alias("text"))


def _joined_tokens(tokens: Column) -> list[Column]:
    return [F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens")]


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("row_id", *_joined_tokens(T.word_tokens(F.col("text"))))


@query
def stopwords(spark: SparkSession, sf: str) -> DataFrame:
    words = T.without_stopwords(T.word_tokens(F.lower("text")), STOPWORDS)
    return _docs(spark, sf).select("row_id", *_joined_tokens(words))


@query
def analyze_text(spark: SparkSession, sf: str) -> DataFrame:
    terms = T.analyze(F.col("text"), T.normalize_bag, STOPWORDS, stub_stem)
    return _docs(spark, sf).select("row_id", *_joined_tokens(terms))


def stub_stem(word: Column) -> Column:
    """Stand-in stemmer: drops a plural ending."""
    return F.regexp_replace(word, r"(?:aux|en|er|x|s)\z", "")


@query
def stem_terms(spark: SparkSession, sf: str) -> DataFrame:
    counts = settle(X.term_counts(_docs(spark, sf), T.word_tokens(F.lower("text")), "row_id"), "terms")
    return X.stem_terms(counts, stub_stem, "row_id")


@query
def french_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of the French texts' words, and what always holds of them."""
    docs = D.table(spark, sf, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("row_id"), F.lower("text").alias("text"))
    counts = settle(X.term_counts(docs, T.word_tokens(F.col("text")), "row_id"), "terms")
    stemmed = settle(X.stem_terms(counts, ST.french_stem, "row_id"), "stems")
    sums = stemmed.groupBy("row_id").agg(F.sum("tf").alias("n_words"), F.count(F.lit(1)).alias("n_stems"), F.sum(F.length("term") * F.col("tf")).alias("size"))
    own = counts.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("term") * F.col("tf")).alias("whole"))
    return sums.join(own, "row_id").select("row_id", "n_words", "n_terms", (F.col("n_stems") <= F.col("n_terms")).alias("merged"), (F.col("size") <= F.col("whole")).alias("shorter"))


@query
def labelled_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.labelled_documents(spark, sf)
    line = T.labelled_line(F.col("labels"), T.normalize_bag(F.col("text")))
    return rows.select("row_id", line.alias("line"))


@query
def parse_labelled_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.labelled_documents(spark, sf)
    lines = rows.select("row_id", T.labelled_line(F.col("labels"), F.col("text")).alias("line"))
    return lines.select(
        "row_id", F.array_join(T.line_labels(F.col("line")), " ").alias("labels"), T.line_text(F.col("line")).alias("text")
    )


@query
def split_slug(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/data/My-Set/"), "source", F.lit("_test-"), F.upper("lang"), F.lit(".jsonl"))
    return _docs(spark, sf).select("row_id", T.split_name(path).alias("split_name"), T.slug(path).alias("slug"))


@query
def remove_newlines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("row_id", T.remove_newlines(F.col("text")).alias("text"))


@query
def concat_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = T.concat_texts(["event_type", "value", "props"], " | ")
    events = D.table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)").cast("string"))
    return events.select("event_id", text.alias("text"))


@query
def corpus_from_tokens(spark: SparkSession, sf: str) -> DataFrame:
    names = ["O", "B-DISO", "B-CHEM", "B-PROC"]
    tokenised = _docs(spark, sf).select(
        "row_id",
        F.split("text", " ").alias("tokens"),
        F.transform(F.split("text", " "), lambda t: F.when(F.length(t) > 14, 1).otherwise(F.length(t) % 2 * 3)).alias("ner_tags"),
    )
    return C.build_corpus(tokenised, names).select("row_id", F.md5("raw_text").alias("raw_md5"), "text", F.col("has_diso").cast("int").cast("bigint").alias("has_diso"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers of every shape, and none, built around an order's brands."""
    codes = F.array_join("labels", ", ")
    body = F.concat(F.lit("### Analysis and Code Assignment\n\nWhy.\n\n### Result\n\n"), codes)
    shapes = [
        F.concat(F.lit("```\n"), body, F.lit("\n```")),
        body,
        F.concat(F.lit("## result\n"), codes),
        F.concat(body, F.lit("\n## ANALYSIS\nmore")),
        F.lit("### Analysis\nnone\n### Result\n0"),
        F.concat(F.lit("### analysis\nx\n\n## Result\n"), F.array_join("labels", " , "), F.lit(",")),
        F.concat(body, F.lit("\n``` ")),
        F.concat(body, F.lit("\n```\n")),
    ]
    shape = shapes[0]
    for i, other in enumerate(shapes[1:], 1):
        shape = F.when(F.col("row_id") % len(shapes) == i, other).otherwise(shape)
    # a model may also fail to answer
    return D.order_labels(spark, sf).select("row_id", F.when(F.col("row_id") % 11 != 3, shape).alias("output"))


@query
def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = C.parse_answers(answers(spark, sf))
    return accepted.select("row_id", F.size("labels").cast("bigint").alias("n"), F.array_join("labels", "|").alias("labels"))


@query
def rejected_answers(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = C.parse_answers(answers(spark, sf))
    return rejected.select("row_id", F.md5("output").alias("output_md5"))


# --- prompts ---------------------------------------------------------------


def _ordered_brands(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("code", r"(\d+)", 1).cast("bigint")
    return D.brand_dictionary(spark, sf).withColumn("ord", number)


@query
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    prompts = Q.labelling_prompts(_docs(spark, sf), _ordered_brands(spark, sf), LABELLING_TEMPLATE)
    return prompts.select("row_id", "pre_query_str")


@query
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return Q.described_labels(D.order_labels(spark, sf), "row_id", D.brand_dictionary(spark, sf))


@query
def prompt_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.with_source(D.order_labels(spark, sf), spark, sf)
    rows = rows.withColumn("text", F.concat("source", F.lit(" {labels}")))
    prompts = Q.verification_prompts(rows, "row_id", D.brand_dictionary(spark, sf), VERIFYING_TEMPLATE)
    return prompts.select("row_id", "pre_query_str")


def _brand_freqs(spark: SparkSession, sf: str) -> DataFrame:
    counts = L.label_counts(D.order_labels_long(spark, sf))
    return counts.select(F.col("label").alias("code"), F.col("n").cast("double").alias("freq"))


@query
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    freqs = settle(_brand_freqs(spark, sf))
    drawn = SA.sample_codes(_docs(spark, sf), "row_id", freqs, "5")
    return drawn.select("row_id", F.col("pos").cast("bigint").alias("pos"), "code")


@query
def prompt_sample(spark: SparkSession, sf: str) -> DataFrame:
    _, fields = Q.sampled_template(DOCUMENT_TEMPLATE, "row_id", seed="6")
    return _docs(spark, sf).select("row_id", fields["types"].alias("types"), fields["styles"].alias("styles"))


@query
def uniform_count(spark: SparkSession, sf: str) -> DataFrame:
    n = uniform_int(hash_hex("4", "row_id"), 1, SA.MAX_LABELS)
    return _docs(spark, sf).select("row_id", n.cast("bigint").alias("n"))


@query
def synthetic_prompts(spark: SparkSession, sf: str) -> DataFrame:
    freqs = settle(_brand_freqs(spark, sf))
    prompts = Q.document_prompts(_docs(spark, sf), "row_id", D.brand_dictionary(spark, sf), freqs, DOCUMENT_TEMPLATE, "5")
    return prompts.select("row_id", F.array_join("labels", ",").alias("labels"), "pre_query_str")


# --- features --------------------------------------------------------------


@query
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    train = D.corpus(spark, sf).filter("split = 'train'")
    counts = X.term_counts(train, T.word_tokens(F.lower("text")), "row_id")
    return X.document_frequency(counts).select("term", F.col("df").alias("n_docs"))


@query
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    counts = settle(X.term_counts(D.corpus(spark, sf), T.word_tokens(F.lower("text")), "row_id", "split"), "terms", codec=SMALL)
    train = counts.filter("split = 'train'")
    n_docs = D.corpus(spark, sf).filter("split = 'train'").agg(F.count(F.lit(1)).alias("n")).scalar()
    frequencies = settle(X.document_frequency(train), "df")
    weights = X.tfidf_weights(counts.drop("split"), frequencies, n_docs, "row_id")
    return weights.select("row_id", "term", r6("weight", "weight"))


@query
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = X.gram_rows(_docs(spark, sf), T.word_tokens(F.lower("text")), n=3, chars=False)
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    words = T.opened(_docs(spark, sf), T.word_tokens(F.lower("text")), "word")
    # distinct words first: a frequent word is opened once, with its count
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("m"))
    grams = T.opened(counts, X.char_ngrams(F.col("word")), "gram", "m")
    return grams.groupBy("gram").agg(F.sum("m").alias("n"))


@query
def hashed_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and n-grams per hash bucket: word runs of one to five words, and the
    character n-grams of each word."""
    docs = _docs(spark, sf)
    # of a set number, which Spark does not make fewer
    docs = docs.repartition(tasks_for(docs, TASK_BYTES // 2), "row_id")
    grams = X.gram_rows(docs, T.word_tokens(F.lower("text")), "row_id", made=False)
    counts = X.hashed_counts(grams, "row_id", bucket=X.portable_bucket)
    return counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))


# --- weights and losses ----------------------------------------------------


def _positives(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per class; every position of a score vector is a class."""
    rows = D.raw_scores(spark, sf)
    last = rows.agg((F.max(F.size("embedding")) - 1).cast("bigint").alias("last"))
    classes = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("label_id"))
    return settle(WE.class_positives(classes, rows.select(F.explode("truth_ids").alias("label_id"))), "positives")


def _rows(spark: SparkSession, sf: str) -> Column:
    return D.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()


@query
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _positives(spark, sf)


@query
def weights_pos(spark: SparkSession, sf: str) -> DataFrame:
    return WE.pos_weights(_positives(spark, sf), _rows(spark, sf)).select("label_id", r6("weight", "weight"))


@query
def weights_inv_sqrt(spark: SparkSession, sf: str) -> DataFrame:
    return WE.inverse_root_weights(_positives(spark, sf)).select("label_id", r6("weight", "weight"))


@query
def weights_cb(spark: SparkSession, sf: str) -> DataFrame:
    return WE.class_balanced_weights(_positives(spark, sf)).select("label_id", r6("weight", "weight"))


@query
def ntr_bias(spark: SparkSession, sf: str) -> DataFrame:
    return WE.logit_biases(_positives(spark, sf)).select("label_id", r6("bias", "bias"))


@query
def start_bias(spark: SparkSession, sf: str) -> DataFrame:
    return WE.start_biases(_positives(spark, sf)).select("label_id", r6("bias", "bias"))


def _loss_query(criterion: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cells = M.score_cells(D.raw_scores(spark, sf), "embedding", "truth_ids", score=D.logit)
        out = WE.loss(cells, criterion, _positives(spark, sf), _rows(spark, sf))
        return out.select(r6("loss", "loss"))

    return run


for _name in WE.CRITERIA:
    QUERIES["loss_" + _name.replace("-", "_")] = _loss_query(_name)


@query
def distil_loss(spark: SparkSession, sf: str) -> DataFrame:
    cells = M.score_cells(D.raw_scores(spark, sf), "embedding", "truth_ids", score=D.logit).select(
        F.col("score").alias("student"),
        (F.col("score") * 0.5 + F.col("truth") * 2).alias("teacher"),
        F.col("truth").cast("double").alias("truth"),
    )
    hard = WE.bce(F.col("student"), F.col("truth"))
    out = WE.distillation_loss(cells, hard, TEMPERATURE, KL_WEIGHT)
    return out.select(r6("kl", "kl"), r6("hard", "hard"), r6("loss", "loss"))


# --- sources and sinks -----------------------------------------------------


@query
def jsonl_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Write documents as JSONL by language, read the folders back in list order."""
    folder = new_folder(spark, "jsonl")
    docs = _docs(spark, sf).select("text", F.array("source").alias("labels"), F.lit(True).alias("has_diso"), "row_id", "lang")
    langs = ("fr", "de", "es", "en")
    for lang in langs:
        ordered = docs.filter(F.col("lang") == lang).orderBy("row_id")
        writers.write_jsonl(ordered.drop("row_id", "lang"), f"{folder}/{lang}")
    back = readers.read_jsonl(spark, "+".join(f"{folder}/{lang}" for lang in langs), schemas.LABELLED, ordered=True)
    return back.select(F.col("ord").cast("bigint").alias("ord"), F.md5("text").alias("text_md5"))


@query
def named_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits named after their files, from CSV and JSONL."""
    folder = new_folder(spark, "splits")
    docs = _docs(spark, sf).select("text", "lang")
    files = {}
    parts = (("train", "en", "jsonl"), ("more", "es", "jsonl"), ("test-a", "fr", "jsonl"), ("test_b", "de", "jsonl"))
    for name, lang, form in parts:
        part = docs.filter(F.col("lang") == lang).select("text", F.array("lang").alias("labels"), F.lit(True).alias("has_diso"))
        writers.write_jsonl(part, f"{folder}/{name}.{form}")
        files[name] = f"{folder}/{name}.{form}"
    splits = readers.read_splits(
        spark, {"train": [files["train"], files["more"]], "test": [files["test-a"], files["test_b"]]}, schemas.LABELLED, "docs"
    )
    return splits.groupBy("split", F.element_at("labels", 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    orders = D.table(spark, sf, "orders").select(
        F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("text"),
        F.col("o_orderstatus").alias("label"),
    )
    writers.write_csv(orders, f"{folder}/orders.csv")
    back = readers.read_table(spark, f"{folder}/orders.csv", schemas.SINGLE_LABEL)
    return back.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def labelled_lines_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "lines")
    rows = D.labelled_documents(spark, sf).withColumn("text", T.normalize_bag(F.col("text")))
    writers.write_labelled_lines(rows, folder)
    back = readers.read_labelled_lines(spark, folder)
    return back.groupBy(F.array_join("labels", " ").alias("labels")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def labelled_lines_format(spark: SparkSession, sf: str) -> DataFrame:
    """As ``labelled_lines_file``, written and read as a data source."""
    from labelspark.sources import formats

    formats.register(spark)
    folder = new_folder(spark, "lines-format")
    rows = D.labelled_documents(spark, sf).select("labels", T.normalize_bag(F.col("text")).alias("text"))
    rows.write.format("labelled_lines").mode("append").save(folder)
    back = spark.read.format("labelled_lines").load(folder)
    return back.groupBy(F.array_join("labels", " ").alias("labels")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced from its own content, while a reader holds the old version."""
    from labelspark.sources import versions

    path = new_folder(spark, "replaced")
    versions.replace(D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path)
    before = versions.read(spark, path)
    versions.replace(before.filter("o_orderstatus <> 'O'"), path)
    after = versions.read(spark, path)
    sides = before.withColumn("version", F.lit("old")).unionByName(after.withColumn("version", F.lit("new")))
    return sides.groupBy("version", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "append")
    events = D.table(spark, sf, "events").select("event_id", "ts", "event_type")
    for parity in (0, 1):
        writers.append_jsonl(events.filter(F.col("event_id") % 2 == parity), folder)
    back = spark.read.schema("event_id bigint, ts string, event_type string").json(folder)
    return back.select("event_id", F.unix_micros(F.to_timestamp("ts")).alias("ts"), "event_type")


@query
def gathered_results(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluate per split, save one record each, find them again and pivot."""
    folder = new_folder(spark, "eval")
    scored = settle(M.evaluate_at(_cells(spark, sf), 0.66, "split").withColumn("threshold", F.lit(0.66)))
    for name in ("train", "test", "valid"):
        one = scored.filter(F.col("split").startswith(name)).select(*schemas.EVALUATION.fieldNames())
        writers.write_record(one, f"{folder}/student.v1/{name}-pred-eval.json")
    files = readers.read_evaluations(spark, folder)
    wide = M.wide_results(files, "model_name", "split", ["test", "train"], schemas.EVALUATION.fieldNames())
    return wide.select("model_name", *[r6(c, c) for c in wide.columns if c != "model_name"])


@query
def sentences_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation, {role: [turn texts]} as JSON, opened into rows."""
    talks = D.table(spark, sf, "conversations")
    doc = F.to_json(F.create_map(F.col("role"), F.array(F.col("text"), F.col("role"))))
    flat = readers.explode_by_length(talks.select("conv_id", "turn", doc.alias("doc")), "doc", "conv_id", "turn")
    return flat.select("conv_id", "turn", "length", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query
def tokenised_source(spark: SparkSession, sf: str) -> DataFrame:
    """Tokenised records by language and split, written and read as one table."""
    folder = new_folder(spark, "tokenised")
    langs, splits = ["de", "en", "es", "fr"], ["train", "validation", "test"]
    rows = D.documents(spark, sf).select(
        "lang", D.split_of("row_id").alias("split"), F.split("text", " ").alias("tokens"),
        F.transform(F.split("text", " "), lambda t: F.length(t) % 4).alias("ner_tags"),
    )
    for lang in langs:
        for split in splits:
            part = rows.filter((F.col("lang") == lang) & (F.col("split") == split))
            writers.write_jsonl(part.select("tokens", "ner_tags"), f"{folder}/{lang}/{split}.json")
    back = readers.read_tokenised(spark, folder, langs, splits)
    return back.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_tokens"),
        F.sum(F.aggregate("ner_tags", F.lit(0).cast("bigint"), lambda s, t: s + t)).alias("tags"),
    )


@query
def dictionary_file(spark: SparkSession, sf: str) -> DataFrame:
    """Codes with descriptions and with frequencies, through their files."""
    folder = new_folder(spark, "dictionary")
    writers.write_jsonl(D.part_dictionary(spark, sf).orderBy("code"), f"{folder}/codes.jsonl")
    writers.write_jsonl(_brand_freqs(spark, sf), f"{folder}/freqs.jsonl")
    codes = readers.read_dictionary(spark, f"{folder}/codes.jsonl", ordered=True)
    freqs = readers.read_dictionary(spark, f"{folder}/freqs.jsonl", with_freq=True)
    return codes.select("code", "description", F.col("ord").cast("bigint").alias("n")).unionByName(
        freqs.select("code", F.lit("").alias("description"), F.col("freq").cast("bigint").alias("n"))
    )


@query
def template_file(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt template from its text file, filled with every document."""
    folder = new_folder(spark, "template")
    spark.createDataFrame([(VERIFYING_TEMPLATE,)], "value string").coalesce(1).write.text(folder)
    template = Q.read_template(spark, f"{folder}/part-*.txt").rstrip("\n")
    filled = T.fill_template(template, input_text=F.col("text"), labels=F.col("lang"))
    return _docs(spark, sf).select("row_id", F.md5(filled).alias("prompt_md5"))


@query
def selected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Splits and named rows picked, a column renamed, added and dropped."""
    rows = D.corpus(spark, sf)
    picked = C.select_splits(rows, drop=["validation"])
    named = C.select_named(C.rename_column(picked, "source", "origin"), "origin", prefix="src1")
    marked = C.mark_generated(named.withColumn("gen_configs", F.lit("x")))
    return C.without_columns(marked, "text").select("row_id", "origin", "split", F.col("has_diso").cast("int").alias("has_diso"))


@query
def generation_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Decoding settings kept beside every generated text, and rows counted on the way."""
    from labelspark.operators.results import watched

    prompts = _docs(spark, sf).select("row_id", F.col("text").alias("pre_query_str"))
    made = I.generate_texts(prompts, stub_generate, I.Decoding(model="stub", temperature=0.5, max_tokens=64))
    counted, seen = watched(made, "generated")
    kept = settle(counted, "generated")
    # whole texts are sent; only the column that is shown is cut
    shown = kept.select("row_id", "gen_configs.*").withColumn("prompt", F.substring("prompt", 1, 40))
    return shown.withColumn("n_rows", F.lit(seen.get["n_rows"]).cast("bigint"))


@query
def regression_labels(spark: SparkSession, sf: str) -> DataFrame:
    from labelspark.operators.results import regression_label, task_kind

    docs = D.table(spark, sf, "events").select("event_id", F.col("value").cast("string").alias("label"))
    if task_kind(docs) != "single-label":
        raise AssertionError("text labels are single labels")
    return regression_label(docs).select("event_id", F.round(F.col("label").cast("double"), 2).alias("label"))


# --- inference -------------------------------------------------------------


def stub_predict():
    """Stand-in classifier: probabilities from the text length."""

    def predict(texts):
        n = np.array([len(t) for t in texts], dtype="float64")[:, None]
        classes = np.arange(N_PROB_CLASSES)[None, :]
        return ((n * (classes + 3)) % 97) / 97.0

    return predict


@query
def batch_infer(spark: SparkSession, sf: str) -> DataFrame:
    scored = I.score_texts(_docs(spark, sf).select("row_id", "text"), stub_predict)
    cells = scored.select("row_id", F.posexplode("pred_probs").alias("label_id", "score"))
    return cells.select("row_id", F.col("label_id").cast("bigint").alias("label_id"), r6("score", "score"))


def stub_generate():
    """Stand-in generator: answers with the brand of the prompt's length."""

    def generate(prompts):
        return [f"### Analysis\n\n{len(p)}\n\n### Result\n\nBrand#{len(p) % 30}\n" for p in prompts]

    return generate


STUB = I.Decoding(model="stub")


@query
def generated_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("row_id", "text")
    accepted, _ = flows.weak_labels(docs, _ordered_brands(spark, sf), LABELLING_TEMPLATE, stub_generate, STUB)
    return accepted.select("row_id", F.array_join("labels", ",").alias("labels"))


@query
def annotate_stream(spark: SparkSession, sf: str) -> DataFrame:
    from labelspark.streaming import annotate as A

    folder = new_folder(spark, "annotate")
    docs = D.table(spark, sf, "documents")

    def annotate(batch: DataFrame) -> DataFrame:
        prompts = batch.select("doc_id", "text", T.fill_template("{input_text}", input_text=F.col("text")).alias("pre_query_str"))
        return I.generate_texts(prompts, stub_generate, STUB).select("doc_id", "text", "output")

    for third in range(3):
        docs.filter(F.col("doc_id") % 3 == third).write.mode("append").parquet(f"{folder}/in")
        stream = A.file_stream(spark, f"{folder}/in", docs.schema, "parquet")
        # the last run starts with a new checkpoint over the old output
        state = f"{folder}/state{third // 2}"
        A.annotate_stream(stream, annotate, f"{folder}/out", state, spread_by="doc_id").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("doc_id", F.md5("output").alias("output_md5"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from labelspark.streaming import annotate as A

    folder = new_folder(spark, "dedup")
    docs = D.table(spark, sf, "documents")
    for third in range(3):
        docs.filter(F.col("doc_id") % 3 == third).write.mode("append").parquet(f"{folder}/in")
        stream = A.file_stream(spark, f"{folder}/in", docs.schema, "parquet")
        A.append_stream(A.dedup_stream(stream).select("text"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("text string").parquet(f"{folder}/out").select(F.md5("text").alias("text_md5"))


@query
def first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each kind by arrival, with state that outlives no lifetime."""
    from labelspark.streaming import annotate as A

    folder = new_folder(spark, "arrivals")
    events = D.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", F.col("user_id") % 50).alias("text"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, A.STATE_STORE)
    try:
        for half in range(2):
            middle = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).scalar()
            late = F.unix_micros("ts") > middle
            events.filter(late if half else ~late).write.mode("append").parquet(f"{folder}/in")
            stream = A.file_stream(spark, f"{folder}/in", events.schema, "parquet")
            found = A.first_arrivals(stream, "ts", "10000 days")
            A.append_stream(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(events.schema).parquet(f"{folder}/out").select("event_id", "text")


# --- models ----------------------------------------------------------------

DOC_LABELS = ["de", "en", "es", "fr", "quality", "toxic"]
# A fit ends at this gradient norm, long before so many passes.
FIT_TOL, FIT_PASSES = 1e-4, 100


def _ready(spark: SparkSession, sf: str):
    return D.labelled_documents(spark, sf).withColumn("text", F.lower("text"))


def _ovr(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Three steps, which SQL can follow."""
    from labelspark.operators.models import evaluate_splits

    words = T.word_tokens(F.col("text"))
    _, model, ready = flows.classical_model(_ready(spark, sf), words, DOC_LABELS, kind, 10.0, max_iter=3)
    return rounded_metrics(evaluate_splits(model, ready), "split")


@query
def ovr_lr(spark: SparkSession, sf: str) -> DataFrame:
    return _ovr(spark, sf, "lr")


@query
def ovr_svm(spark: SparkSession, sf: str) -> DataFrame:
    return _ovr(spark, sf, "svm")


@query
def tfidf_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features that models get, opened again."""
    vocabulary, ready = flows.classical_features(_ready(spark, sf), T.word_tokens(F.col("text")))
    cells = T.opened(ready, F.arrays_zip("indices", "values"), "e", "row_id")
    cells = cells.select("row_id", F.col("e.indices").alias("index"), r6("e.values", "weight"))
    named = frequent_join(cells, vocabulary, "index", "df")
    return named.select("row_id", "term", "index", F.col("df").alias("n_docs"), "weight")


def _facts(spark: SparkSession, sf: str, scored: DataFrame, *keys: str) -> DataFrame:
    """What SQL can follow of a fit that it cannot: true labels and cells of each
    split, the score of naming the most frequent training label always, and whether
    the fitted model does better."""
    rows = _ready(spark, sf).select("split", "labels")
    train = rows.filter("split = 'train'").select(F.explode("labels").alias("label"))
    parts = []
    for split in ("train", "validation", "test"):
        grid = M.most_frequent_baseline(train, rows.filter(F.col("split") == split), F.lit(len(DOC_LABELS)), 1)
        parts.append(grid.filter("k = 1").select(F.lit(split).alias("split"), F.col("f1").alias("baseline")))
    baseline = settle(parts[0].unionAll(parts[1]).unionAll(parts[2]), "baseline")
    met = scored.join(F.broadcast(baseline), "split")  # three rows
    return met.select(
        *keys, "split", (F.col("tp") + F.col("fn")).alias("n_true"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_cells"),
        r6("baseline", "baseline"), (F.col("f1") > F.col("baseline")).alias("better"),
    )


@query
def ovr_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, save, reload; search the threshold on validation, score the other splits."""
    from labelspark.operators.models import load_one_vs_rest, save_one_vs_rest

    words = T.word_tokens(F.col("text"))
    _, model, ready = flows.classical_model(_ready(spark, sf), words, DOC_LABELS, "lr", 10.0, FIT_PASSES, tol=FIT_TOL)
    folder = new_folder(spark, "model")
    save_one_vs_rest(model, spark, folder)
    tests = ["train", "test"]
    wide = settle(flows.tuned_classifier(load_one_vs_rest(spark, folder), ready, "tfidf_lr", tests=tests), "tuned")
    cells = load_one_vs_rest(spark, folder).cells(ready).filter(F.col("split").isin(tests))
    counts = cells.groupBy("split").agg(F.sum(F.col("truth").cast("bigint")).alias("n_true"), F.count(F.lit(1)).alias("n_cells"))
    scores = wide.select("model_name", F.explode(F.array(*[F.struct(F.lit(t).alias("split"), F.col(f"{t}_f1").alias("f1")) for t in tests])).alias("s"))
    scores = scores.select("model_name", "s.*")
    facts = scores.join(counts, "split").withColumns({"tp": F.col("n_true"), "fn": F.lit(0), "fp": F.lit(0), "tn": F.col("n_cells") - F.col("n_true")})
    return _facts(spark, sf, facts, "model_name")


@query
def topk_tuned(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(D.order_labels(spark, sf))
    train = rows.filter("split = 'train'").select(F.explode("labels").alias("label"))
    n_classes = rows.select(F.explode("labels").alias("l")).agg(F.count_distinct("l").alias("n")).scalar()
    wide = flows.tuned_top_k(train, rows, n_classes, tests=["test", "train"])
    return wide.select("model_name", "k", *[r6(c, c) for c in wide.columns if c not in {"model_name", "k"}])


@query
def ngram_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from labelspark.operators.models import OneVsRest, evaluate_splits
    from labelspark.operators.solver import BATCH_BYTES, GROUP_BYTES

    words = T.word_tokens(F.col("text"))
    chars = F.flatten(F.transform(words, lambda w: X.char_ngrams(w)))
    ready = X.hashed_vectors(_ready(spark, sf), F.concat(X.word_ngrams(words), chars))
    ready = settle(ready.drop("text"), "vectors", group_bytes=GROUP_BYTES)
    model = OneVsRest(DOC_LABELS, "lr", 1.0, FIT_PASSES, tol=FIT_TOL).fit(ready.filter("split = 'train'"), X.BUCKETS)
    return _facts(spark, sf, settle(evaluate_splits(model, ready), "scored", batch_bytes=BATCH_BYTES))


# Inverse regularisation strengths of the grid.
GRID_C = [100.0, 10.0, 1.0, 0.1, 0.01]


@query
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Micro f1 on validation: the first best of every setting, strictly better."""
    from labelspark.operators.models import OneVsRest, evaluate_models, parameter_grid, search

    vocabulary, ready = flows.classical_features(_ready(spark, sf), T.word_tokens(F.col("text")))
    width, models = vocabulary.count(), []
    for kind in ("lr", "svm"):
        model = OneVsRest(DOC_LABELS, kind, max_iter=FIT_PASSES, tol=FIT_TOL)
        models += model.fit_strengths(ready.filter("split = 'train'"), width, GRID_C)
    scored = evaluate_models(models, ready.filter("split = 'validation'")).collect()  # a row a setting
    found = {(models[r["model"]].kind, models[r["model"]].c): r for r in scored}

    def run(setting: dict) -> float:
        return found[setting["kind"], setting["c"]]["f1"]

    best, _ = search(parameter_grid({"kind": ["lr", "svm"], "c": GRID_C}), run)
    if best is None:
        best = {"kind": "lr", "c": GRID_C[0]}
    top = found[best["kind"], best["c"]]["f1"]
    rows = [(r["f1"] <= top, *[r[c] for c in ("split", "tp", "fp", "fn", "tn", "f1")], kind, c) for (kind, c), r in found.items()]
    out = spark.createDataFrame(rows, "within boolean, split string, tp long, fp long, fn long, tn long, f1 double, kind string, c double")
    return _facts(spark, sf, out.withColumn("f1", F.lit(top)), "kind", "c", "within")


@query
def ratio_search(spark: SparkSession, sf: str) -> DataFrame:
    """English documents added to the other languages' training rows."""
    vocabulary, ready = flows.classical_features(_ready(spark, sf), T.word_tokens(F.col("text")))
    english = F.array_contains("labels", "en")
    train = ready.filter("split = 'train'")
    out = flows.ratio_search(
        train.filter(~english), train.filter(english), ready.filter("split = 'validation'"),
        DOC_LABELS, vocabulary.count(), "row_id", 10.0, FIT_PASSES, FIT_TOL,
    )
    scored = settle(out, "scored").withColumn("split", F.lit("validation"))
    return _facts(spark, sf, scored, "multiplier").drop("split", "better")
