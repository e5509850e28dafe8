"""Arrow files as a Spark data source: record batches are read where they are needed, and tasks write part files.

A file's footer tells where its batches lie, so large files are split at them
and only the wanted columns are decoded; the rows go to Spark as Arrow, never
through the driver.  A write puts each task's batches into a file of its own
in a temporary folder; the commit moves the files of the tasks that counted,
so a task that ran twice, or a job that failed, leaves nothing behind.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.shipping import ship

#: Bytes of a file that one task reads; a batch is never split.
SPLIT_BYTES = 128 << 20
SUFFIXES = (".arrow", ".ipc", ".feather", ".arrows")


def opened(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a URI, or the local one of a plain path."""
    path = re.sub(r"^file:/+", "/", path)
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of the Arrow files in a folder and below it; hidden and temporary ones are left out."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == afs.FileType.File:
        return [(root, info.size)]
    found = fs.get_file_info(afs.FileSelector(root, recursive=True))
    inside = [f for f in found if f.type == afs.FileType.File and f.path.endswith(SUFFIXES) and not any(p[:1] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
    return sorted((f.path, f.size) for f in inside)


def exists(path: str) -> bool:
    fs, root = opened(path)
    return fs.get_file_info(root).type != afs.FileType.NotFound


def is_stream(fs: afs.FileSystem, file: str) -> bool:
    with fs.open_input_file(file) as f:
        return f.read(6) != b"ARROW1"


def file_schema(path: str) -> pa.Schema:
    """The schema of the first file, dictionaries as their values."""
    files = files_of(path)
    if not files:
        raise FileNotFoundError(f"no Arrow files in {path}")
    fs, _ = opened(path)
    with fs.open_input_file(files[0][0]) as f:
        found = pa.ipc.open_stream(f).schema if is_stream(fs, files[0][0]) else pa.ipc.open_file(f).schema
    return pa.schema([pa.field(c.name, _plain(c.type), c.nullable) for c in found])


def _plain(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_unsigned_integer(kind):  # the next larger signed one; the largest as a decimal
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_float16(kind):
        return pa.float32()
    return kind


@dataclass
class Batches(InputPartition):
    """Some record batches of a file; all of them for a stream."""

    file: str
    first: int | None
    end: int | None


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.names = schema.fieldNames()
        self.target = to_arrow_schema(schema)

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = opened(self.path)
        out: list[InputPartition] = []
        for file, size in files_of(self.path):
            if is_stream(fs, file):
                out.append(Batches(file, None, None))
                continue
            with fs.open_input_file(file) as f:
                n = pa.ipc.open_file(f).num_record_batches
            parts = max(1, min(n, -(-size // self.split_bytes)))
            out += [Batches(file, n * i // parts, n * (i + 1) // parts) for i in range(parts)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = opened(self.path)
        # a mapped file is read page by page, as columns are decoded
        source = pa.memory_map(partition.file) if isinstance(fs, afs.LocalFileSystem) else fs.open_input_file(partition.file)
        with source:
            if partition.first is None:
                for batch in pa.ipc.open_stream(source):
                    yield self._made(batch)
                return
            every = pa.ipc.open_file(source).schema.names
            options = pa.ipc.IpcReadOptions(included_fields=[every.index(c) for c in self.names])
            reader = pa.ipc.open_file(source, options=options)
            for i in range(partition.first, partition.end):
                yield self._made(reader.get_batch(i))

    def _made(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = []
        for field in self.target:
            c = batch.column(batch.schema.get_field_index(field.name))
            c = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
            columns.append(c if c.type == field.type else c.cast(field.type, safe=not pa.types.is_timestamp(c.type)))  # nanoseconds are cut to microseconds
        return pa.RecordBatch.from_arrays(columns, schema=self.target)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, stream: bool, compression: str | None):
        self.path, self.schema, self.overwrite, self.stream, self.compression = path, schema, overwrite, stream, compression
        self.job = uuid.uuid4().hex

    def _open(self, fs: afs.FileSystem, file: str, schema: pa.Schema):
        sink = fs.open_output_stream(file)
        options = pa.ipc.IpcWriteOptions(compression=self.compression)
        return sink, (pa.ipc.new_stream if self.stream else pa.ipc.new_file)(sink, schema, options=options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        context = TaskContext.get()
        file, sink, writer = None, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                folder = posixpath.join(root, f"_temporary-{self.job}")
                fs.create_dir(folder)
                file = posixpath.join(folder, f"part-{context.partitionId():05d}-{self.job[:8]}-{context.taskAttemptId()}{'.arrows' if self.stream else '.arrow'}")
                sink, writer = self._open(fs, file, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
        return Written(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root)
        old = [f for f, _ in files_of(self.path)] if self.overwrite else []
        made = [m.file for m in messages if m is not None and m.file]
        for file in made:
            fs.move(file, posixpath.join(root, posixpath.basename(file)))
        if not made and (self.overwrite or not files_of(self.path)):  # an empty table keeps its columns
            file = posixpath.join(root, f"part-00000-{self.job[:8]}{'.arrows' if self.stream else '.arrow'}")
            sink, writer = self._open(fs, file, to_arrow_schema(self.schema))
            writer.close()
            sink.close()
        for file in old:
            fs.delete_file(file)
        self._clean(fs, root)
        with fs.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, fs: afs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, f"_temporary-{self.job}")
        if fs.get_file_info(folder).type != afs.FileType.NotFound:
            fs.delete_dir(folder)


class ArrowFiles(DataSource):
    """Options: path, columns (joined by U+001F; all by default), split_bytes; for writes stream and compression (lz4, zstd)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        found = file_schema(self.options["path"])
        wanted = [c for c in self.options.get("columns", "").split("\x1f") if c]
        missing = set(wanted) - set(found.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return from_arrow_schema(pa.schema([found.field(c) for c in wanted]) if wanted else found, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        compression = self.options.get("compression") or None
        return ArrowWriter(self.options["path"], schema, overwrite, self.options.get("stream", "false") == "true", compression)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("arrow_files")`` known to a session."""
    ship(spark)
    spark.dataSource.register(ArrowFiles)
