"""Each stage on its own input, against brute force where its rule is exact."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelspark.llm import queries
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns_and_lose_no_clean_rows(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for before, after in steps[:-1]:
        assert after.columns == columns
        assert after.exceptAll(before).count() == 0 and 0.8 * before.count() <= after.count()


def test_one_document_of_each_group_stays(steps):
    before, after = steps[2]
    rows = before.collect()
    ids = [r.doc_id for r in rows]
    want = set(plain_components([plain_fingerprint(r.text) for r in rows], ids))
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_one_stored_row_of_each_group_stays(spark):
    """Null and repeated ids, repeated rows and columns of clashing names."""
    text, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(None, text, 1), (None, text, 1), (5, text, 2), (5, text, 2), (None, other, 3), (None, other, 3), (7, None, 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(5, text, 2), (None, other, 3), (7, None, 4)], key=repr)


def test_no_benchmark_item_is_left(spark, steps):
    words = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = steps[3]
    held = lambda df: {r.doc_id for r in df.collect() if any(i in words(r.text) for i in items)}
    assert not held(after) and {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} >= held(before)


def test_everything_left_is_packed(steps):
    before, after = steps[4]
    totals = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want")).collect()
    assert {r.doc_id for r in totals} == {r.doc_id for r in before.collect()} and all(r.n == r.want for r in totals)


def test_odd_documents_pass_through(spark, edge_docs):
    wide = edge_docs.withColumn("n_chars", F.lit(1)).withColumn("_toxicity", F.lit(0.0)).withColumn("_quality", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns
        assert stage(spark, wide.limit(0), SF).count() == 0
    assert corpus_pipeline.pack(spark, wide, SF).count() >= wide.count()


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.SQL) == {"op11_fim", "op12_jaccard", "op13_search"}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    found = [tuple(r[c] for c in columns) for r in got.collect()]
    order = [want.columns.index(c) for c in columns]
    assert sorted(found, key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_returns_a_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    key, source = ("page_id", "pages") if name == "op10_urls" else ("doc_id", "documents")
    if name == "op13_search":
        items = {r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
        assert {r.item_id for r in rows.collect()} == items
        return
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}
    got = [r[0] for r in rows.select(key).collect()]
    if name == "op3_decontaminate":
        assert set(got) <= ids and got
    elif name == "op4_pack":
        assert set(got) == ids
    else:
        assert sorted(got) == sorted(ids)
