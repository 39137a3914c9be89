import json
import os

import pytest
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.operators.infer import Decoding, generate_texts
from labelspark.sources import readers, writers
from labelspark.streaming import annotate as A


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return str(path)


def record(text, *labels):
    return json.dumps({"text": text, "has_diso": True, "labels": list(labels)}, ensure_ascii=False)


def test_jsonl_order(spark, tmp_path, rows_of):
    b = put(tmp_path / "b.jsonl", [record(f"b{i}") for i in range(50)])
    a = put(tmp_path / "a.jsonl", [record(f"a{i}") for i in range(5)])
    df = readers.read_jsonl(spark, f"{b}+{a}", schemas.LABELLED, ordered=True)
    got = [r[1] for r in rows_of(df.select("ord", "text"))]
    assert got == [f"b{i}" for i in range(50)] + [f"a{i}" for i in range(5)]
    assert [r[0] for r in rows_of(df.select("ord"))] == list(range(55))


def test_order_survives_file_blocks(spark, tmp_path, rows_of):
    path = put(tmp_path / "big.jsonl", [record(f"row {i:05d} " + "x" * 200) for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        df = readers.read_jsonl(spark, path, schemas.LABELLED, ordered=True)
        got = rows_of(df.select("ord", F.substring("text", 5, 5).cast("int")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, i) for i in range(2000)]


def test_splits(spark, tmp_path, rows_of):
    files = {
        "train": [put(tmp_path / "t1.jsonl", [record("a")]), put(tmp_path / "t2.jsonl", [record("b")])],
        "validation": put(tmp_path / "v.jsonl", [record("c")]),
        "test": [put(tmp_path / "my-test_1.jsonl", [record("d")]), put(tmp_path / "other.jsonl", [record("e")])],
    }
    df = readers.read_splits(spark, files, schemas.LABELLED, "src")
    assert rows_of(df.select("text", "split", "source")) == [
        ("a", "train", "src"), ("b", "train", "src"), ("c", "validation", "src"),
        ("d", "test_my.test.1", "src"), ("e", "test_other", "src"),
    ]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.txt", schemas.LABELLED)


def test_csv(spark, tmp_path, rows_of):
    path = str(tmp_path / "out.csv")
    writers.write_csv(spark.createDataFrame([('a, "b"', "x"), ("é", "y")], "text string, label string"), path)
    assert rows_of(readers.read_table(spark, path, schemas.SINGLE_LABEL)) == [('a, "b"', "x"), ("é", "y")]


def test_jsonl_keeps_unicode_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("é œ", "s", "train"), ("b", "s", "test")], "text string, source string, split string")
    path = str(tmp_path / "o")
    writers.write_jsonl(df, path, ["source", "split"])
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".json")]
    assert any("é œ" in open(f, encoding="utf-8").read() for f in files)
    assert spark.read.json(path).filter("split = 'train'").count() == 1


def test_append_and_record(spark, tmp_path, rows_of):
    path = str(tmp_path / "a")
    df = spark.sql("SELECT 1 AS i, DATE'2024-01-02' AS d")
    writers.append_jsonl(df, path)
    writers.append_jsonl(df, path)
    assert rows_of(spark.read.schema("i int, d string").json(path)) == [(1, "2024-01-02")] * 2
    writers.write_record(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    with pytest.raises(ValueError, match="one row"):
        writers.write_record(df.unionAll(df), str(tmp_path / "s"))


def test_written_records_are_found(spark, tmp_path, rows_of):
    df = spark.sql("SELECT 0.1D AS precision, 0.2D AS recall, 0.3D AS f1, 0.4D AS auc_score, 0.5D AS threshold")
    for name in ("my test", "a-valid"):
        writers.write_record(df, str(tmp_path / "student.v1" / f"{name}-pred-eval.json"))
    assert rows_of(readers.read_evaluations(spark, str(tmp_path)).select("model_name", "split", "f1")) == [("student", "my test", 0.3)]


def test_order_of_odd_and_repeated_paths(spark, tmp_path):
    one = put(tmp_path / "b set.jsonl", ['{"text": "1"}', '{"text": "2"}'])
    two = put(tmp_path / "é.jsonl", ['{"text": "3"}'])
    three = put(tmp_path / "x" / "é.jsonl", ['{"text": "4"}'])
    schema = spark.createDataFrame([], "text string").schema
    got = readers.read_jsonl(spark, [one, three, two, one], schema, ordered=True).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in got] == list(enumerate("124312"))


def test_csv_of_other_programs(spark, tmp_path, rows_of):
    path = put(tmp_path / "o.csv", ["text,label", '"he said ""yes"", ok",A', '"two\nlines",B'])
    assert rows_of(readers.read_csv(spark, path, schemas.SINGLE_LABEL, multi_line=True)) == [('he said "yes", ok', "A"), ("two\nlines", "B")]
    first = put(tmp_path / "p.csv", ["text,label", '"he said ""yes"", ok",A'])
    back = readers.read_csv(spark, first, schemas.SINGLE_LABEL)
    assert rows_of(back) == [('he said "yes", ok', "A")]
    writers.write_csv(back, str(tmp_path / "q"))
    part = next((tmp_path / "q").glob("part-*")).read_text()
    assert '"he said ""yes"", ok"' in part


def test_tokenised_dictionary_template(spark, tmp_path, rows_of):
    put(tmp_path / "first" / "train.json", [json.dumps({"tokens": ["a", "b"], "ner_tags": [0, 1]})])
    put(tmp_path / "first" / "test.json", [json.dumps({"tokens": [], "ner_tags": []})])
    df = readers.read_tokenised(spark, str(tmp_path), ["first"], ["train", "test"])
    assert rows_of(df) == [("first", "test", [], []), ("first", "train", ["a", "b"], [0, 1])]
    codes = put(tmp_path / "codes.jsonl", ['{"code": "B", "description": "beta"}', '{"code": "A", "description": "alpha"}'])
    assert rows_of(readers.read_dictionary(spark, codes, ordered=True).select("ord", "code")) == [(0, "B"), (1, "A")]
    from labelspark.operators.prompt import read_template

    assert read_template(spark, put(tmp_path / "p.txt", ["a", "{x}"])) == "a\n{x}\n"


def test_lengths(spark, tmp_path, rows_of):
    path = put(tmp_path / "s.json", [json.dumps({"10": ["a", "b"], "20": []}, indent=1)])
    assert rows_of(readers.read_by_length(spark, path)) == [("10", 0, "a"), ("10", 1, "b")]


def test_evaluations(spark, tmp_path, rows_of):
    def save(name, f1):
        put(tmp_path / name, [json.dumps({"precision": 0.1, "recall": 0.2, "f1": f1, "auc_score": 0.4, "threshold": 0.5}, indent=4)])

    save("student.v2/a-test-pred-eval.json", 0.3)
    save("teacher/a-test-pred-eval.json", 0.6)
    save("teacher/a-valid-pred-eval.json", 0.9)
    save("teacher/other.json", 0.9)
    got = rows_of(readers.read_evaluations(spark, str(tmp_path)).select("model_name", "split", "f1"))
    assert got == [("student", "a-test", 0.3), ("teacher", "a-test", 0.6)]


def test_labelled_lines(spark, tmp_path, rows_of):
    df = spark.createDataFrame([(["A"], "x y"), ([], "z")], "labels array<string>, text string")
    writers.write_labelled_lines(df, str(tmp_path / "l"))
    assert rows_of(readers.read_labelled_lines(spark, str(tmp_path / "l"))) == [([], " z"), (["__label__A"], "x y")]


def test_annotation_restarts(spark, tmp_path, rows_of):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "row_id bigint, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    calls = spark.sparkContext.accumulator(0)

    def annotate(batch):
        def load():
            def run(prompts):
                calls.add(len(prompts))
                return [f"### Result {p}" for p in prompts]

            return run

        return generate_texts(batch.withColumn("pre_query_str", F.col("text")), load, Decoding("m"))

    def run():
        stream = A.file_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        A.annotate_stream(stream, annotate, out, state).awaitTermination()
        return [r[0] for r in rows_of(spark.read.parquet(out).select("row_id"))]

    add([(1, "a"), (2, "b")])
    assert run() == [1, 2]
    add([(3, "a"), (4, "c")])
    add([(5, "c"), (6, "d")])
    got = run()
    # texts seen in an earlier batch are not sent again
    assert got in ([1, 2, 4, 6], [1, 2, 5, 6]) and calls.value == 4
    assert run() == got and calls.value == 4
    # a new checkpoint over the old output sends nothing again and loses nothing
    state = str(tmp_path / "state2")
    assert run() == got and calls.value == 4


def test_stream_dedup(spark, tmp_path, rows_of):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, text string"
    rows = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS ts, explode(array('a','b','a')) AS text")
    rows.coalesce(1).write.json(source)
    rows.coalesce(1).write.mode("append").json(source)
    for time in (None, "ts"):
        stream = A.file_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        A.append_stream(A.dedup_stream(stream, event_time=time), f"{out}{time}", f"{state}{time}").awaitTermination()
        assert [r[1] for r in rows_of(spark.read.schema(schema).parquet(f"{out}{time}"))] == ["a", "b"]
