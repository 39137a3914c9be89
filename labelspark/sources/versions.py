"""Tables that are replaced as a whole: versions and a manifest.

A write makes a folder of its own below ``<path>/versions``; only when all its
part files are there, a manifest with the next number names it. Readers take the
version of the highest manifest, so they see the old table or the new one and
never a mixture, and a job that fails leaves the old one. Two writers that reach
the same number: one gets an error and its version is not seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSIONS, MANIFESTS = "versions", "manifests"
DIGITS = 12


def _files(spark: SparkSession, path: str):
    """(file system, path object) of Hadoop, which knows all stores that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none if there is no such folder."""
    files, folder = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def delete(spark: SparkSession, path: str) -> None:
    files, found = _files(spark, path)
    files.delete(found, True)


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, if nothing has that name; False if something has.

    It is written under another name and renamed, which Hadoop file systems do
    as one step and not over an existing file.
    """
    files, found = _files(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}"
    out = files.create(_files(spark, draft)[1], False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not files.exists(found) and files.rename(_files(spark, draft)[1], found)
    if not done:
        delete(spark, draft)
    return done


def _read_small(spark: SparkSession, path: str) -> str:
    files, found = _files(spark, path)
    stream = files.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    names = list_names(spark, f"{path}/{MANIFESTS}")
    return [int(n) for n in names if len(n) == DIGITS and n.isdigit()]


def current(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """(folder of the current version, its notes), or None before the first."""
    numbers = manifests(spark, path)
    if not numbers:
        return None
    held = json.loads(_read_small(spark, f"{path}/{MANIFESTS}/{numbers[-1]:0{DIGITS}d}"))
    return f"{path}/{VERSIONS}/{held['version']}", held["notes"]


def resolve(spark: SparkSession, path: str) -> str:
    """The folder to read: the current version, or ``path`` itself where it has none."""
    found = current(spark, path)
    return found[0] if found else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None], notes: dict | None = None) -> str:
    """Let ``write`` fill a new folder, then make it the current version."""
    numbers = manifests(spark, path)
    following = numbers[-1] + 1 if numbers else 0
    version = uuid.uuid4().hex
    folder = f"{path}/{VERSIONS}/{version}"
    write(folder)
    line = json.dumps({"version": version, "notes": notes or {}})
    if not _write_new(spark, f"{path}/{MANIFESTS}/{following:0{DIGITS}d}", line):
        delete(spark, folder)
        raise FileExistsError(f"another job replaced {path} meanwhile")
    return folder


def replace(df: DataFrame, path: str, form: str = "parquet", notes: dict | None = None, **options) -> str:
    """Make ``df`` the content of the table at ``path``; it may be read from there."""
    spark = df.sparkSession
    return publish(spark, path, lambda folder: df.write.options(**options).format(form).save(folder), notes)


def read(spark: SparkSession, path: str, form: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options).format(form)
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no complete version")
    return (reader.schema(schema) if schema is not None else reader).load(found[0])


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions but the last ``keep``, and those that no manifest names: no
    job may be writing. Returns how many went."""
    numbers = manifests(spark, path)
    held = set()
    for number in numbers[-keep:]:
        held.add(json.loads(_read_small(spark, f"{path}/{MANIFESTS}/{number:0{DIGITS}d}"))["version"])
    for number in numbers[:-keep]:
        delete(spark, f"{path}/{MANIFESTS}/{number:0{DIGITS}d}")
    gone = [name for name in list_names(spark, f"{path}/{VERSIONS}") if name not in held]
    for name in gone:
        delete(spark, f"{path}/{VERSIONS}/{name}")
    return len(gone)


