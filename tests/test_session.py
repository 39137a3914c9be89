import os

import pytest

from labelspark import session
from labelspark.session import shared_folder


def test_settle_and_drop(spark):
    df = session.settle(spark.range(10))
    assert df.count() == 10
    folder = session.scratch_folder(spark).removeprefix("file:")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) and os.path.isdir(folder)


def test_empty_table_keeps_its_schema(spark):
    df = session.settle(spark.range(10).filter("id < 0"))
    assert df.columns == ["id"] and df.count() == 0


def test_spread_only_small_tables(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 3)
    assert session.spread(many, "id") is many


def test_functions_travel_without_the_package(spark):
    """Workers get code by value, so another working folder is no problem."""
    from pyspark import cloudpickle

    from labelspark.queries import stub_predict

    assert b"labelspark.queries" not in cloudpickle.dumps(stub_predict).split(b"stub_predict")[0][:40]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_tasks_of_a_large_table_are_bounded(spark, tmp_path):
    spark.range(4_000).selectExpr("id AS row_id", "md5(string(id)) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = session.file_bytes(table)
    for parts in (1, 30):
        dealt = session.spread(table, "row_id", task_bytes=size // parts)
        assert dealt.rdd.getNumPartitions() >= max(4, parts) and dealt.count() == 4_000
    # many scan tasks are dealt anew where each of them is too large
    many = table.repartition(12)
    many.write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        held = spark.read.parquet(str(tmp_path / "m"))
        assert session.spread(held, "row_id").rdd.getNumPartitions() == held.rdd.getNumPartitions() == 12
        assert session.spread(held, "row_id", task_bytes=session.file_bytes(held) // 40).rdd.getNumPartitions() >= 40
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_write_bounds_the_batches_of_its_python_steps(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int32())})

    wide = spark.range(0, 400, 1, 1).selectExpr("array_repeat(id, 1000) AS a")
    before = spark.conf.get(session.ARROW_BYTES)
    whole = session.settle(wide.mapInArrow(sizes, "n int")).collect()
    small = session.settle(wide.mapInArrow(sizes, "n int"), batch_bytes=100_000).collect()
    assert sum(r.n for r in whole) == sum(r.n for r in small) == 400
    assert max(r.n for r in small) < 50 < max(r.n for r in whole) and spark.conf.get(session.ARROW_BYTES) == before
