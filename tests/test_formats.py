"""The library's formats as data sources."""

import json

import pytest
from pyspark.sql import functions as F

from labelspark.sources import formats, readers, writers


@pytest.fixture
def known(spark):
    formats.register(spark)
    return spark


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("".join(f"{r}\n" for r in rows).encode())


def test_reads_what_the_column_reader_reads(known, tmp_path, rows_of):
    rows = [f"__label__{i % 3} " * (i % 4) + f"text {i} é" + "x" * (i % 50) for i in range(500)] + ["", "plain", "__label__a"]
    lines(tmp_path / "in" / "a.txt", rows)
    lines(tmp_path / "in" / "sub" / "b.txt", rows[:7])
    path = str(tmp_path / "in")
    want = rows_of(readers.read_labelled_lines(known, f"{path}/a.txt"))
    for size in (37, 1_000, 10**9):
        read = known.read.format("labelled_lines").option("partBytes", size).load(path)
        assert rows_of(read.filter(F.col("file") == "a.txt").select("labels", "text")) == want
    parts = known.read.format("labelled_lines").option("partBytes", 1_000).load(path)
    assert parts.rdd.getNumPartitions() > 10 and parts.count() == len(rows) + 7


def test_files_are_left_out_when_a_query_is_planned(known, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt"):
        lines(tmp_path / "in" / name, [f"__label__x {name}"])
    read = known.read.format("labelled_lines").load(str(tmp_path / "in"))
    assert read.rdd.getNumPartitions() == 3
    for condition, n in ((F.col("file") == "b.txt", 1), (F.col("file").isin("a.txt", "c.txt"), 2), (F.col("file").startswith("c"), 1)):
        chosen = read.filter(condition)
        assert chosen.rdd.getNumPartitions() == n == chosen.count()
    assert read.filter((F.col("file") == "a.txt") & (F.col("text") == "b.txt")).count() == 0


def test_writes_are_seen_whole_or_not_at_all(known, tmp_path, rows_of):
    path = str(tmp_path / "out")
    rows = known.createDataFrame([(["a", "b"], "x y"), ([], "z"), (None, "no"), (["c"], None)], "labels array<string>, text string")
    save = lambda df, mode: df.write.format("labelled_lines").mode(mode).save(path)
    read = lambda: rows_of(known.read.format("labelled_lines").load(path).select("labels", "text"))
    save(rows.repartition(2), "append")
    got = read()
    assert sorted(text for _, text in got) == [" z", "x y"]
    writers.write_labelled_lines(rows.filter("labels IS NOT NULL AND text IS NOT NULL"), str(tmp_path / "plain"))
    assert got == rows_of(readers.read_labelled_lines(known, str(tmp_path / "plain")))
    broken = known.createDataFrame([(["d"], "fine"), (["e"], "a\nb")], "labels array<string>, text string").repartition(2)
    with pytest.raises(Exception, match="line break"):
        save(broken, "append")
    assert read() == got  # what the tasks of the failed job wrote is not seen
    (tmp_path / "out" / "part-000-left-over.txt").write_text("__label__x left over\n")
    assert read() == got
    save(known.createDataFrame([(["n"], "new")], rows.schema), "append")
    assert len(read()) == 3
    save(known.createDataFrame([(["o"], "only")], rows.schema), "overwrite")
    assert read() == [(["__label__o"], "only")]


def test_streams_in_and_out(known, tmp_path, rows_of):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "labels array<string>, text string"

    def add(*texts):
        known.createDataFrame([(["l"], t) for t in texts], schema).write.format("labelled_lines").mode("append").save(source)

    def run():
        stream = known.readStream.format("labelled_lines").load(source)
        done = stream.select(F.transform("labels", lambda l: F.substring_index(l, "__", -1)).alias("labels"), F.upper("text").alias("text"))
        writer = done.writeStream.format("labelled_lines").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in known.read.format("labelled_lines").load(out).collect())

    add("a", "b")
    assert run() == ["A", "B"]
    add("c")
    assert run() == ["A", "B", "C"]
    assert run() == ["A", "B", "C"]


def test_records_are_found_as_by_the_reader(known, tmp_path, rows_of):
    for name, f1 in (("student.v2/a-test-pred-eval.json", 0.3), ("teacher/a-test-pred-eval.json", 1), ("teacher/a-valid-pred-eval.json", 0.9), ("teacher/o.json", 0.9)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"precision": 0.1, "recall": 0.2, "f1": f1, "auc_score": None, "threshold": 0.5}, indent=2))
    one = known.createDataFrame([(0.1, 0.2, 0.7, 0.4, 0.5)], "precision double, recall double, f1 double, auc_score double, threshold double")
    writers.write_record(one, f"{tmp_path}/saved/b-test-pred-eval.json")
    columns = ["model_name", "split", "precision", "f1", "auc_score"]
    read = known.read.format("evaluation_records").load(str(tmp_path))
    assert rows_of(read.select(*columns)) == rows_of(readers.read_evaluations(known, str(tmp_path)).select(*columns))
    assert read.filter(F.col("file").startswith("teacher")).rdd.getNumPartitions() == 1


def test_lists_of_lines_are_bounded_by_bytes(tmp_path, monkeypatch):
    import pyarrow as pa

    lines = [b"x" * 400 for _ in range(30)]
    (tmp_path / "a.txt").write_bytes(b"\n".join(lines) + b"\n")
    monkeypatch.setattr(formats, "BATCH_BYTES", 1000)
    size = (tmp_path / "a.txt").stat().st_size
    found = list(formats.read_lines(str(tmp_path), formats.FileRange(str(tmp_path / "a.txt"), 0, size)))
    assert sum(found, []) == lines and max(map(len, found)) == 3
    monkeypatch.setattr(formats, "WRITE_ROWS", 7)
    pieces = list(formats._pieces(iter([pa.RecordBatch.from_pydict({"a": list(range(20))})])))
    assert [len(p) for p in pieces] == [7, 7, 6] and sum((p.column(0).to_pylist() for p in pieces), []) == list(range(20))
