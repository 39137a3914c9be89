"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that help every job here; memory, executors and shuffle
# partitions belong to the cluster (AQE coalesces small shuffles).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "labelspark", **conf: str) -> SparkSession:
    """A session with SESSION_CONF; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is missing and all of
    Spark runs in one process, as in unit tests; executors of a cluster could not
    see it, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="labelspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_folder(spark)}/labelspark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the scratch folder that nothing else uses."""
    return f"{scratch_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's settled tables, once no result needs them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Lets Spark delete a write's own shuffle files as soon as the write has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Bytes of the rows that Spark hands to a Python worker at one time.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def settle(df: DataFrame, purpose: str = "table", batch_bytes: int | None = None, codec: str | None = None,
           group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, fixes nondeterministic columns, survives lost executors, and
    gives the planner real file sizes, so that Spark's own broadcast threshold
    decides on measured bytes. The shuffles behind it are deleted at once: the
    table stands for them. ``batch_bytes`` bounds what Python steps of this write
    get at one time, for rows that are long arrays. ``codec`` compresses the files
    otherwise than the session does. ``group_bytes`` bounds their row groups, looked at
    after each row: readers and the writer hold one whole, and a task gets whole ones.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    wanted = {SHUFFLE_CLEANUP: "true"} | ({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        # planned anew: a plan keeps the settings of its time
        options = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group_bytes else {}
        df.select("*").write.options(**options).parquet(path, compression=codec)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


# For tables of a row per word: a third smaller than Spark's default, and no slower.
SMALL = "zstd"


# Bytes of table files that one task of text work takes: opened into words, they
# become some thirty times as much in a task's hash tables.
TASK_BYTES = 8 * 2**20


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a scan; 0 where there are none."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks that use all cores and take at most so many bytes of a table's files."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-file_bytes(df) // task_bytes))


def spread(df: DataFrame, *keys: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Use all cores for a table of few file splits, and tasks of bounded size.

    Splitting costs a shuffle, so it happens only where the scan has at most two
    tasks per core (some of them empty when a file is one row group), or tasks
    of more than ``task_bytes``. The number of tasks grows with the files, so what a
    task holds does not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = tasks_for(df, task_bytes)
    scanned = df.rdd.getNumPartitions()
    few = 1 < cores and scanned <= 2 * cores
    return df.repartition(wanted, *keys) if few or scanned < wanted else df
