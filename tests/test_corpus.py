import collections

import pytest
from pyspark.sql import functions as F

from labelspark.operators import corpus as C
from labelspark.operators import reshape as R
from labelspark.operators.results import regression_label, task_kind, watched
from labelspark.plans import joins
from labelspark.plans.order import first_rows, number_rows, number_rows_within


def test_dedup_keeps_the_first(table, rows_of):
    df = table([(3, "a"), (1, "a"), (2, "b"), (5, ""), (4, "")], "ord bigint, text string")
    assert rows_of(C.dedup_exact(df, "ord")) == [(1, "a"), (2, "b"), (4, "")]


def test_dedup_across_splits(table, rows_of):
    df = table(
        [(1, "test", "a"), (2, "test", "a"), (3, "validation", "a"), (4, "validation", "b"), (5, "validation", "b"),
         (6, "train", "a"), (7, "train", "b"), (8, "train", "c"), (9, "train", "c")],
        "row_id int, split string, text string",
    )
    kept = [r[0] for r in rows_of(C.dedup_across_splits(df, "row_id").select("row_id"))]
    assert kept == [1, 2, 4, 5, 8, 9]


def test_empty_text_and_build(table, rows_of):
    df = table([(1, ["a", "'", "b"], [1]), (2, [], []), (3, [" "], [0])], "row_id int, tokens array<string>, ner_tags array<int>")
    got = rows_of(C.build_corpus(df, ["O", "B-DISO"]))
    assert got == [(1, "a ' b", "a'b", True), (3, " ", " ", False)]


def test_resume(table, rows_of):
    todo = table([(i, f"t{i % 3}") for i in range(9)], "ord int, text string")
    done = table([("t1",), ("t1",), ("zz",)], "text string")
    assert [r[0] for r in rows_of(C.not_yet_done(todo, done))] == [0, 2, 3, 5, 6, 8]
    assert C.not_yet_done(todo, todo).count() == 0


def test_answers_are_routed(table, rows_of):
    df = table([(1, "### Analysis\nx\n### Result\nA, B"), (2, "bad")], "row_id int, output string")
    accepted, rejected = C.parse_answers(df)
    assert rows_of(accepted) == [(1, ["A", "B"])] and rows_of(rejected.select("row_id")) == [(2,)]


def test_small_helpers(table, rows_of):
    df = table([("train", "s_a", None, 1.5), ("test", "s_b", "x", 2.0)], "split string, name string, t string, label double")
    assert C.select_splits(df, keep=["train"]).count() == 1 and C.select_splits(df, drop=["train"]).count() == 1
    assert C.select_named(df, "name", prefix="s_").count() == 2 and C.select_named(df, "name", suffix="_b").count() == 1
    assert C.select_named(df, "name", exact="s_a").count() == 1
    assert rows_of(C.concat_columns(df, ["name", "t"], "o", "|").select("o")) == [("s_a|",), ("s_b|x",)]
    assert task_kind(df) == "regression" and task_kind(df, "name") == "single-label"
    assert C.mark_generated(df).columns[-1] == "has_diso"
    assert "gone" not in C.without_columns(df, "gone", "t").columns
    with pytest.raises(Exception):
        regression_label(df.select(F.lit("abc").alias("label"))).collect()
    seen, watch = watched(df, "stage")
    seen.write.format("noop").mode("overwrite").save()
    assert watch.get["n_rows"] == 2


@pytest.fixture
def ids(spark):
    return spark.range(0, 1237, 1, 7).withColumnRenamed("id", "row_id")


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_exact_split_sizes(ids):
    assert sizes(R.split_exact(ids, "row_id", test_rows=100)) == {"test": 100, "validation": 1137}
    assert sizes(R.split_exact(ids, "row_id", test_rows=100, valid_rows=50)) == {"test": 100, "validation": 50, "train": 1087}
    assert sizes(R.split_exact(ids, "row_id", test_rows=5000)) == {"test": 1237}
    assert sizes(R.split_exact(ids, "row_id", test_rows=0)) == {"validation": 1237}
    # ceil(1237 / 5) = 248 held out, 124 of them test
    assert sizes(R.split_fraction(ids, "row_id")) == {"train": 989, "test": 124, "validation": 124}
    assert sizes(R.split_fraction(ids.limit(1), "row_id")) == {"test": 1}


def test_split_does_not_depend_on_partitions(ids, rows_of):
    assert rows_of(R.split_fraction(ids.coalesce(1), "row_id")) == rows_of(R.split_fraction(ids.repartition(11), "row_id"))
    assert rows_of(R.split_fraction(ids, "row_id", "1")) != rows_of(R.split_fraction(ids, "row_id", "2"))


def test_numbering(ids, rows_of):
    shuffled = ids.orderBy(F.rand(1))
    assert rows_of(number_rows(shuffled, ["row_id"], "ord").select(F.col("ord") - F.col("row_id")).distinct()) == [(0,)]
    grouped = ids.withColumn("g", F.when(F.col("row_id") < 900, "hot").otherwise(F.col("row_id").cast("string")))
    got = rows_of(number_rows_within(grouped, "g", [F.desc("row_id")]).filter("g = 'hot'").select("row_id", "rank"))
    assert got == [(i, 900 - i) for i in range(900)]


def test_prefix_batches_shuffle(ids, rows_of, monkeypatch):
    assert [r[0] for r in rows_of(first_rows(ids, 5, "row_id"))] == [0, 1, 2, 3, 4]
    monkeypatch.setattr("labelspark.plans.order.TOP_N_LIMIT", 2)
    assert [r[0] for r in rows_of(first_rows(ids, 5, "row_id"))] == [0, 1, 2, 3, 4]
    batches = collections.Counter(r[1] for r in rows_of(R.with_batches(ids, "row_id", 100)))
    assert batches == {**{i: 100 for i in range(12)}, 12: 37}
    order = [r[0] for r in R.shuffled(ids, "row_id").collect()]
    assert sorted(order) == list(range(1237)) and order != sorted(order)
    assert [r[0] for r in R.shuffled(ids, "row_id", n=10).collect()] == order[:10]
    assert sorted(r[0] for r in R.shuffled(ids, "row_id", n=200_000).collect()) == sorted(order)


@pytest.mark.parametrize("t, s", [(4, 10), (10, 3), (3, 0), (5, 5)])
def test_mixtures(spark, t, s):
    train = spark.range(t).select(F.col("id").alias("row_id"), F.lit("t").alias("kind"))
    extra = spark.range(100, 100 + s).select(F.col("id").alias("row_id"), F.lit("s").alias("kind"))
    got = collections.defaultdict(list)
    for r in R.mixtures(train, extra, "row_id").collect():
        if r["kind"] == "s":
            got[r["multiplier"]].append(r["row_id"] - 100)
        else:
            got[(r["multiplier"], "t")].append(r["row_id"])
    ms = [0, 0.5, *range(1, -(-s // t) + 1)]
    for m in ms:
        assert sorted(got[(m, "t")]) == list(range(t))
        assert sorted(got[m]) == list(range(min(s, int(m * t))))
    assert {k for k in got if not isinstance(k, tuple) and got[k]} <= set(ms)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, rows_of, how):
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("no", 4)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(joins.salted_join(left, right, ["k"], ["id"], how)) == rows_of(left.join(right, "k", how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_is_spread(spark, rows_of):
    left = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.hot_salted_join(left, right, "k", "n", ["id"], hot_keys=10)
        want = left.join(right, "k")
        assert rows_of(joined.select("id", "k", "n")) == rows_of(want.select("id", "k", "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], ["id"], "outer")


def test_no_task_gets_more_than_its_share(spark):
    """A key on two thirds of the rows: at most twice the even share per task."""
    left = spark.range(60_000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false"), ("shuffle.partitions", "16")):
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        joined = joins.hot_salted_join(left, right, "k", "n", ["id"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 60_000 and len(sizes) == 16 and max(sizes) <= 2 * 60_000 / 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_null_answers_and_null_labels(table, rows_of):
    answers = table([(1, None), (2, "### Analysis\nx\n### Result\nA"), (3, "nothing")], "row_id int, output string")
    accepted, rejected = C.parse_answers(answers)
    assert [r[0] for r in rows_of(accepted.select("row_id"))] == [2]
    assert [r[0] for r in rows_of(rejected.select("row_id"))] == [1, 3]
    labelled = table([(1, None), (2, []), (3, ["A"]), (4, ["Z"])], "row_id int, labels array<string>")
    codes = table([("A",)], "code string")
    from labelspark.operators.labels import valid_label_rows

    assert [r[0] for r in rows_of(valid_label_rows(labelled, codes, "row_id").select("row_id"))] == [1, 2, 3]


def test_order_is_kept_above_the_heap_limit(spark, monkeypatch):
    from labelspark.operators import reshape
    from labelspark.plans import order

    ids = spark.range(200).withColumnRenamed("id", "row_id").repartition(5)
    small = [r[0] for r in reshape.shuffled(ids, "row_id", n=50).collect()]
    first = [r[0] for r in order.first_rows(ids, 50, "row_id").collect()]
    monkeypatch.setattr(reshape, "TOP_N_LIMIT", 10)
    monkeypatch.setattr(order, "TOP_N_LIMIT", 10)
    assert [r[0] for r in reshape.shuffled(ids, "row_id", n=50).collect()] == small
    assert [r[0] for r in order.first_rows(ids, 50, "row_id").collect()] == first == list(range(50))
