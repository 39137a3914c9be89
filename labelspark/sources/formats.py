"""Formats of the library as Spark data sources, batch and stream.

``spark.read.format("labelled_lines")`` and ``format("evaluation_records")`` after
``register(spark)``. Readers plan byte ranges of files and leave out files by their
names; writers put part files into a folder of their own, and a manifest names
those of the tasks that were committed, so a failed job leaves nothing to be read.

Files are reached by Arrow's file systems: a path of a shared folder, or a URI.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from labelspark import schemas

MARK = "__label__"
PART_BYTES = 32 * 2**20
# Lines that are read, and rows that are written, at one time.
BATCH_LINES = 10_000
BATCH_BYTES = 2**20
WRITE_ROWS = 256
MANIFEST = "_manifest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def list_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) below a path, by name.

    In a folder that a writer of this module made, only files that a manifest names.
    """
    files, root = _open(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    committed = _committed(files, [f.path for f in found if f.is_file and posixpath.basename(f.path).startswith(MANIFEST)])
    out = []
    for f in found:
        below = f.path[len(root.rstrip("/")) + 1 :].split("/")
        if f.is_file and not any(map(_hidden, below)) and (committed is None or f.path in committed):
            out.append((f.path, f.size))
    return sorted(out)


def _committed(files: fs.FileSystem, manifests: list[str]) -> set[str] | None:
    if not manifests:
        return None
    out: set[str] = set()
    for path in manifests:
        with files.open_input_stream(path) as stream:
            held = json.loads(stream.read())
        out |= {posixpath.join(posixpath.dirname(path), name) for name in held["files"]}
    return out


@dataclass
class FileRange(ds.InputPartition):
    path: str
    start: int
    end: int


@dataclass
class PartFile(ds.WriterCommitMessage):
    name: str
    rows: int


def plan(files: list[tuple[str, int]], most: int, whole: bool) -> list[FileRange]:
    """Byte ranges of at most ``most`` bytes; whole files where a record may span lines."""
    out = []
    for path, size in files:
        step = max(1, size if whole else most)
        out += [FileRange(path, at, min(size, at + step)) for at in range(0, max(size, 1), step)]
    return out


def read_lines(root: str, part: FileRange) -> Iterator[list[bytes]]:
    """Lists of lines that begin inside the range, without their line ends."""
    files, _ = _open(root)
    with files.open_input_file(part.path) as stream, io.BufferedReader(stream, 2**18) as text:
        text.seek(max(0, part.start - 1))
        if part.start:
            text.readline()  # the line that the byte before the range belongs to
        lines: list[bytes] = []
        at = begun = text.tell()
        for line in iter(text.readline, b""):
            if at >= part.end:
                break
            at += len(line)
            lines.append(line.rstrip(b"\r\n"))
            if len(lines) == BATCH_LINES or at - begun >= BATCH_BYTES:
                yield lines
                lines, begun = [], at
        if lines:
            yield lines


class _FileReader(ds.DataSourceReader):
    """Shared by the formats: planning, and files left out by ``file`` filters."""

    whole = False

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("partBytes", PART_BYTES))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802 - Spark's name
        """Conditions on ``file`` choose files when a query is planned."""
        for one in filters:
            kind = type(one).__name__
            if getattr(one, "attribute", None) == ("file",) and kind in {"EqualTo", "In", "StringStartsWith", "StringEndsWith", "StringContains"}:
                self.wanted.append((kind, one.value))
            else:
                yield one

    def _is_wanted(self, name: str) -> bool:
        tests = {
            "EqualTo": lambda v: name == v,
            "In": lambda v: name in v,
            "StringStartsWith": name.startswith,
            "StringEndsWith": name.endswith,
            "StringContains": lambda v: v in name,
        }
        return all(tests[kind](value) for kind, value in self.wanted)

    def _name(self, path: str) -> str:
        root = _open(self.path)[1].rstrip("/")
        return path[len(root) + 1 :] if path.startswith(root + "/") else posixpath.basename(path)

    def _files(self) -> list[tuple[str, int]]:
        return [f for f in list_files(self.path) if self._is_wanted(self._name(f[0]))]

    def partitions(self) -> list[FileRange]:
        return plan(self._files(), self.most, self.whole)


class _LabelledReader(_FileReader):
    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        name = self._name(partition.path)
        for lines in read_lines(self.path, partition):
            yield parse_lines(lines, name)


def parse_lines(lines: list[bytes], name: str) -> pa.RecordBatch:
    """Words with the label mark are labels, the others the text, as the column
    functions ``line_labels`` and ``line_text`` have it."""
    labels, texts = [], []
    for line in lines:
        words = line.decode().split(" ")
        labels.append([w for w in words if MARK in w])
        texts.append(" ".join(w for w in words if MARK not in w))
    return pa.RecordBatch.from_arrays(
        [pa.array(labels, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array([name] * len(lines), pa.string())],
        ["labels", "text", "file"],
    )


class _StreamOfFiles(ds.DataSourceStreamReader):
    """Files in the order of their names; the offset is the last one taken. New files
    must have later names, as the parts of this module's writers do."""

    def __init__(self, reader: _FileReader):
        self.reader = reader

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = [path for path, _ in self._found()]
        return {"after": names[-1] if names else ""}

    def _found(self) -> list[tuple[str, int]]:
        try:
            return self.reader._files()
        except FileNotFoundError:
            return []

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        new = [f for f in self._found() if start["after"] < f[0] <= end["after"]]
        return plan(new, self.reader.most, self.reader.whole)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), WRITE_ROWS):
            yield batch.slice(at, WRITE_ROWS)


class _LineWriter:
    """Writes part files; nothing counts until a manifest names it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = options.get("job") or uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFile:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.txt", 0
        with files.open_output_stream(posixpath.join(root, name)) as out:
            for batch in _pieces(iterator):
                for labels, text in zip(batch.column("labels").to_pylist(), batch.column("text").to_pylist()):
                    if labels is None or text is None:
                        continue  # a line needs both, as the column function makes null of them
                    if "\n" in text or any("\n" in label or " " in label for label in labels):
                        raise ValueError("a line break in a text, or a blank in a label")
                    out.write(f"{' '.join(MARK + label for label in labels)} {text}\n".encode())
                    rows += 1
        return PartFile(name, rows)

    def _publish(self, messages: list[PartFile | None], number: int, keep: bool) -> None:
        files, root = _open(self.path)
        done = [m for m in messages if m is not None]
        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.is_file] if not keep else []
        # parts get names that sort by batch, then the manifest makes them visible at once
        names = []
        for place, message in enumerate(done):
            name = f"part-{number:012d}-{place:05d}-{message.name[5:]}"
            files.move(posixpath.join(root, message.name), posixpath.join(root, name))
            names.append(name)
        draft = posixpath.join(root, f".draft-{uuid.uuid4().hex}")
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"files": names, "rows": sum(m.rows for m in done)}).encode())
        files.move(draft, posixpath.join(root, f"{MANIFEST}-{number:012d}.json"))
        for path in old:
            if posixpath.basename(path) not in {m.name for m in done} and not path.endswith(f"{MANIFEST}-{number:012d}.json"):
                files.delete_file(path)

    def _drop(self, messages: list[PartFile | None]) -> None:
        files, root = _open(self.path)
        for message in messages:
            path = message and posixpath.join(root, message.name)
            if path and files.get_file_info(path).type == fs.FileType.File:
                files.delete_file(path)

    def _next(self) -> int:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        names = [posixpath.basename(f.path) for f in files.get_file_info(fs.FileSelector(root))]
        return max([int(n[len(MANIFEST) + 1 : -5]) + 1 for n in names if n.startswith(MANIFEST)], default=0)


class _BatchWriter(_LineWriter, ds.DataSourceArrowWriter):
    def commit(self, messages: list[PartFile | None]) -> None:
        self._publish(messages, self._next(), keep=not self.overwrite)

    def abort(self, messages: list[PartFile | None]) -> None:
        self._drop(messages)


class _StreamWriter(_LineWriter, ds.DataSourceStreamArrowWriter):
    """Batch n has manifest n: a batch that is replayed replaces its own."""

    def commit(self, messages: list[PartFile | None], batchId: int) -> None:  # noqa: N803
        self._publish(messages, batchId, keep=True)

    def abort(self, messages: list[PartFile | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class LabelledLines(ds.DataSource):
    """``__label__a __label__b text`` lines: labels with their mark, text, and the file
    below the path. Option ``partBytes`` sets the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "labelled_lines"

    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField("labels", schemas.STRINGS), T.StructField("text", T.StringType()), T.StructField("file", T.StringType())]
        )

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _LabelledReader(self.options)

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:  # noqa: N802
        return _StreamOfFiles(_LabelledReader(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return _BatchWriter(self.options, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(self.options, overwrite)


class _RecordReader(_FileReader):
    whole = True

    def __init__(self, options: dict):
        super().__init__(options)
        self.ending = options.get("ending", "-pred-eval.json")

    def _files(self) -> list[tuple[str, int]]:
        """One range a record; a record is a file, or the part files of a folder."""
        out = []
        for path, size in list_files(self.path):
            if self._record(path) and self._is_wanted(self._name(path)):
                out.append((path, size))
        return out

    def _record(self, path: str) -> tuple[str, str] | None:
        """(model, split) from the path."""
        found = re.search(rf"([^/]+)/([^/]*){re.escape(self.ending)}(?:/part-[^/]*\.json)?\Z", path)
        if not found or "valid" in path:
            return None
        return re.sub(r"(?<=.)\.[^.]*\Z", "", found[1]), found[2]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        with files.open_input_stream(partition.path) as stream:
            text = stream.read().decode()
        if not text.strip():
            return
        held, (model, split) = json.loads(text), self._record(partition.path)
        values = [[model], [split], *([held.get(f)] for f in schemas.EVALUATION.fieldNames()), [self._name(partition.path)]]
        kinds = [pa.string(), pa.string(), *[pa.float64()] * len(schemas.EVALUATION), pa.string()]
        names = ["model_name", "split", *schemas.EVALUATION.fieldNames(), "file"]
        yield pa.RecordBatch.from_arrays([pc.cast(pa.array(v), k) for v, k in zip(values, kinds)], names)


class EvaluationRecords(ds.DataSource):
    """Evaluation records below a path, with model and split from where they lie, as
    ``read_evaluations`` finds them. Option ``ending`` is the end of a record's name."""

    @classmethod
    def name(cls) -> str:
        return "evaluation_records"

    def schema(self) -> T.StructType:
        named = [T.StructField(n, T.StringType()) for n in ("model_name", "split")]
        return T.StructType([*named, *schemas.EVALUATION.fields, T.StructField("file", T.StringType())])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _RecordReader(self.options)

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:  # noqa: N802
        return _StreamOfFiles(_RecordReader(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, with filters passed to them."""
    for source in (LabelledLines, EvaluationRecords):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
