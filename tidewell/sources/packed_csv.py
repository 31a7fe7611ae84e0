"""CSV parts packed by xz or zip, which Spark's own CSV source cannot write: a Python data source.

A write commits in two phases. Each task writes one part under a staged name; once all tasks are done, the driver renames
the parts into the folder, and if the job fails it deletes them. So a folder never shows rows of a failed or a
repeated task. Paths are of file systems that pyarrow opens, shared by driver and executors.
"""

from __future__ import annotations

import csv
import io
import lzma
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

CODECS = ("xz", "zip")
_STAGED = "_staged"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedCsv)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts(path: str) -> list[str]:
    """The parts of a folder; none where it does not exist."""
    files, folder = _opened(path)
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.startswith("part-"))


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


@dataclass
class _File(InputPartition):
    path: str


class PackedCsv(DataSource):
    """Options: path, and codec (xz or zip) when writing."""

    @classmethod
    def name(cls) -> str:
        return "packed_csv"

    def schema(self) -> str:
        raise ValueError("packed_csv is read with a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("codec", "xz"), schema, overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, codec: str, schema: T.StructType, overwrite: bool) -> None:
        if codec not in CODECS:
            raise ValueError(f"codec must be one of {CODECS}")
        self.path, self.codec, self.names, self.overwrite, self.job = path, codec, schema.names, overwrite, uuid.uuid4().hex
        self.before = parts(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        """One part, streamed through the codec batch by batch; none of an empty partition."""
        files, folder = _opened(self.path)
        out = None
        name = f"part-{uuid.uuid4().hex}.csv"
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(f"{folder}/{_STAGED}-{self.job}", recursive=True)
                sink = files.open_output_stream(f"{folder}/{_STAGED}-{self.job}/{name}.{self.codec}", compression=None)
                out = _Packed(sink, self.codec, name)
                out.rows([self.names])
            out.rows(zip(*(_texts(c) for c in batch.columns), strict=True))
        if out is None:
            return _Part(None)
        out.close()
        return _Part(f"{name}.{self.codec}")

    def commit(self, messages: Sequence[_Part | None]) -> None:
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{folder}/{_STAGED}-{self.job}/{m.name}", f"{folder}/{m.name}")
        if self.overwrite:
            for old in self.before:
                files.delete_file(old)
        self._clear(files, folder)

    def abort(self, messages: Sequence[_Part | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, files: fs.FileSystem, folder: str) -> None:
        staged = f"{folder}/{_STAGED}-{self.job}"
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


class _Packed:
    """CSV rows into an open stream."""

    def __init__(self, sink: io.IOBase, codec: str, name: str) -> None:
        self.sink, self.archive = sink, None
        if codec == "xz":
            self.body = lzma.open(sink, "wb")
        else:
            self.archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
            self.body = self.archive.open(name, "w", force_zip64=True)
        self.text = io.TextIOWrapper(self.body, "utf-8", newline="")
        self.csv = csv.writer(self.text)

    def rows(self, rows) -> None:
        self.csv.writerows(rows)

    def close(self) -> None:
        self.text.close()
        if self.archive:
            self.archive.close()
        self.sink.close()


def _texts(column: pa.Array) -> list[str]:
    """A column as texts that reading casts back. NULL is an empty field; a text of nothing but backslashes, '' too, gets one more."""
    texts = column.cast(pa.string()).to_pylist()
    return ["" if x is None else x if x.strip("\\") else x + "\\" for x in texts]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.wanted = path, schema

    def partitions(self) -> list[_File]:
        files = parts(self.path)
        return [_File(f) for f in files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.wanted)
        if not partition.path:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as raw:
            archive = zipfile.ZipFile(raw) if partition.path.endswith(".zip") else None
            body = archive.open(archive.namelist()[0]) if archive else lzma.open(raw, "rb")
            rows = csv.reader(io.TextIOWrapper(body, "utf-8", newline=""))
            at = {name: i for i, name in enumerate(next(rows))}
            places = [at.get(f.name) for f in kinds]
            held: list[list[str]] = []
            for row in rows:
                held.append(row)
                if len(held) == 4096:
                    yield _typed(held, places, kinds)
                    held = []
            if held:
                yield _typed(held, places, kinds)


def _typed(rows: list[list[str]], places: list[int | None], kinds: pa.Schema) -> pa.RecordBatch:
    columns = []
    for place, field in zip(places, kinds, strict=True):
        values = [row[place] or None if place is not None else None for row in rows]
        if pa.types.is_string(field.type):
            values = [v if v is None or v.strip("\\") else v[1:] for v in values]
        columns.append(pa.array(values, pa.string()).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=kinds)
