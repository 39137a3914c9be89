"""Versions of tables, the table of keys done, and state that expires."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelspark.operators.corpus import text_key
from labelspark.sources import versions
from labelspark.sources.keys import KeyTable, prefix_of
from labelspark.sources import keys as K
from labelspark.streaming import annotate as A


def test_readers_see_one_version(spark, tmp_path, rows_of):
    path = str(tmp_path / "table")
    assert versions.current(spark, path) is None and versions.resolve(spark, path) == path
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(spark.range(3), path, notes={"n": 3})
    before = versions.read(spark, path)
    versions.replace(versions.read(spark, path).filter("id > 0"), path)  # from itself
    assert rows_of(versions.read(spark, path)) == [(1,), (2,)]
    assert rows_of(before) == [(0,), (1,), (2,)]  # a reader of the old version goes on
    assert versions.current(spark, path)[1] == {}
    assert versions.drop_old(spark, path, keep=1) == 1 and rows_of(versions.read(spark, path)) == [(1,), (2,)]


def test_a_write_that_ends_half_way_leaves_the_old_version(spark, tmp_path, rows_of):
    path = str(tmp_path / "table")
    versions.replace(spark.range(5), path)
    broken = spark.range(0, 8, 1, 8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.replace(broken, path)
    assert len(versions.manifests(spark, path)) == 1
    assert [r[0] for r in rows_of(versions.read(spark, path))] == [0, 1, 2, 3, 4]
    versions.replace(spark.range(2), path)
    assert versions.drop_old(spark, path, keep=1) >= 1
    assert len(versions.list_names(spark, f"{path}/versions")) == 1 and versions.read(spark, path).count() == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "table")

    def slow(folder):
        spark.range(1).write.parquet(folder)
        versions.replace(spark.range(2), path)  # another job is faster

    with pytest.raises(FileExistsError):
        versions.publish(spark, path, slow)
    assert versions.read(spark, path).count() == 2 and len(versions.list_names(spark, f"{path}/versions")) == 1


def texts(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_id long, text string")


def test_keys_are_held_merged_and_replaced(spark, tmp_path, rows_of, monkeypatch):
    monkeypatch.setattr(K, "MAX_BATCHES", 3)
    monkeypatch.setattr(K, "BUCKET_KEYS", 20)
    table = KeyTable(spark, str(tmp_path / "keys"))
    inputs = texts(spark, [f"t{i}" for i in range(90)] + [None, "t5", "new"])
    left = lambda **k: sorted((r.text for r in table.not_held(inputs, **k).collect()), key=repr)
    assert len(left()) == 93 and not table.merge()
    merged = 0
    for batch in range(8):
        merged += table.merge(without=("a", batch))
        table.add(texts(spark, [f"t{i}" for i in range(10 * batch, 10 * batch + 12)]), ("a", batch))
        assert len([t for t in left() if t]) == 93 - 1 - 10 * batch - 12 - 1
    assert merged == 1 and table._merged()[1]["upto"] == {"a": 3}
    assert left() == sorted([None, "new", *(f"t{i}" for i in range(82, 90))], key=repr)
    # a batch that comes again replaces itself and does not see its own keys
    assert {"t72", "t81"} <= set(left(without=("a", 7)))
    table.add(texts(spark, ["t72"]), ("a", 7))
    assert "t81" in left() and "t72" not in left()
    assert table.holds_batch(("a", 0)) and table.holds_batch(("a", 7)) and not table.holds_batch(("b", 0))
    assert table.catch_up([("a", 3), ("b", 0)], lambda b: texts(spark, ["new"])) == 1 and "new" not in left()


def test_a_lookup_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MAX_BATCHES", 0)
    monkeypatch.setattr(K, "BUCKET_KEYS", 50)
    sizes, few = [], texts(spark, ["t1", "absent"])
    prefixes = [r[0] for r in few.select(prefix_of(text_key("text"))).collect()]
    for total in (400, 3_200):
        table = KeyTable(spark, str(tmp_path / f"keys{total}"))
        table.add(texts(spark, [f"t{i}" for i in range(total)]), ("a", 0))
        assert table.merge()
        sizes.append(table.keys(prefixes).count())
        assert len(table.files()) > len(table.files(prefixes)) <= 2
        assert [r.text for r in table.not_held(few).collect()] == ["absent"]
    assert sizes[1] <= 2 * sizes[0] + 20  # eight times the keys, as many read


def test_annotation_reads_no_old_output(spark, tmp_path, rows_of):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda names: texts(spark, names).write.mode("append").parquet(source)

    def run(state):
        stream = A.file_stream(spark, source, texts(spark, []).schema, "parquet")
        A.annotate_stream(stream, lambda b: b.withColumn("output", F.upper("text")), out, str(tmp_path / state)).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    add(["a", "b"])
    assert run("s1") == ["a", "b"]
    # the texts of old outputs cannot be read any more: the keys are enough
    for part in (tmp_path / "out").rglob("*.parquet"):
        part.write_bytes(b"unreadable")
    add(["b", "c"])
    stream = A.file_stream(spark, source, texts(spark, []).schema, "parquet")
    A.annotate_stream(stream, lambda b: b, out, str(tmp_path / "s1")).awaitTermination()
    new = [r.text for d in sorted((tmp_path / "out").rglob("batch_id=1")) for r in spark.read.parquet(str(d)).collect()]
    assert new == ["c"]


def test_output_without_a_key_table_is_read_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts(spark, ["a", "b"]).write.parquet(f"{out}/run_id=old/batch_id=0")
    texts(spark, ["b", "c"]).write.parquet(source)
    stream = A.file_stream(spark, source, texts(spark, []).schema, "parquet")
    A.annotate_stream(stream, lambda b: b, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def test_state_expires_over_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "at timestamp, text string, n int"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(ValueError):
        A.first_arrivals(spark.createDataFrame([], schema), "at")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.STATE_STORE)
    try:
        held = []

        def run():
            stream = A.file_stream(spark, source, spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1)
            query = A.append_stream(A.first_arrivals(stream, "at", "30 minutes", "10 minutes"), out, state)
            query.awaitTermination()
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None)
            return sorted((r.n, r.text) for r in spark.read.schema(schema).parquet(out).collect())

        add([(at(1), "a", 2), (at(0), "a", 1), (at(2), "b", 3), (None, "x", 4), (at(3), None, 5)])
        assert run() == [(1, "a"), (3, "b")]
        add([(at(20), "a", 6), (at(21), "c", 7)])  # a is still known, over a restart
        assert run() == [(1, "a"), (3, "b"), (7, "c")]
        add([(at(60), "d", 8)])
        add([(at(61), "d", 9)])
        assert run() == [(1, "a"), (3, "b"), (7, "c"), (8, "d")]
        add([(at(62), "a", 10)])  # a's time is over: it passes again
        assert run()[-1] == (10, "a")
        add([(at(200 + 100 * i), f"late{i}", 20 + i) for i in range(3)])
        run()
        add([(at(900), "end", 30)])
        add([(at(901), "end", 31)])
        run()
        assert held[-1] <= 3  # what is left of eight texts' states and timers
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
