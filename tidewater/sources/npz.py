"""Bundles of numpy arrays (.npz) as a Spark data source: each array is a column, its first axis the rows.

    register(spark)
    df.write.format("npz").option("rows_per_file", 10000).mode("append").save(path)
    spark.read.format("npz").option("rows_per_task", 100000).load(path)

A file is read by as many tasks as it takes for `rows_per_task` rows each; a task reads only its slice of each array.
One-dimensional arrays are numbers, booleans or strings, two-dimensional ones arrays of numbers. A file that lacks a
column gives nulls; arrays of unequal length in a file are an error. The schema is that of the first file, or the one
given. Files of a folder are taken in the order of their names; the column `source_file`, where it is asked for by a
schema, is the file's path. Paths may be any that pyarrow.fs opens.

Written files appear in the folder only once all tasks have succeeded. A null in an array of numbers is stored as NaN;
in other columns it is an error, and so are vectors of unequal length.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS_PER_TASK, ROWS_PER_FILE = 100_000, 100_000
SOURCE = "source_file"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The .npz files of a folder, or the file itself, in order."""
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and f.base_name.endswith(".npz")]


class _Bundle:
    """One open file: the shape and kind of its arrays, and slices of them."""

    def __init__(self, path: str):
        store, inner = _store(path)
        self.zip = zipfile.ZipFile(store.open_input_file(inner))
        self.arrays: dict[str, tuple[tuple[int, ...], bool, np.dtype]] = {}
        for name in self.zip.namelist():
            with self.zip.open(name) as member:
                self.arrays[name.removesuffix(".npy")] = self._header(member)
        sizes = {shape[0] if shape else -1 for shape, _, _ in self.arrays.values()}
        if len(sizes) > 1 or -1 in sizes:
            raise ValueError(f"arrays of unequal length in {path}")
        self.rows = sizes.pop() if sizes else 0

    @staticmethod
    def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
        version = np.lib.format.read_magic(member)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)

    def rows_of(self, name: str, start: int, count: int) -> np.ndarray:
        with self.zip.open(f"{name}.npy") as member:
            shape, by_columns, kind = self._header(member)
            if kind.hasobject:
                raise ValueError(f"array {name} holds Python objects")
            if by_columns and len(shape) > 1:
                flat = np.frombuffer(member.read(), kind)
                return flat.reshape(shape, order="F")[start : start + count]
            row = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            member.seek(start * row, io.SEEK_CUR)
            return np.frombuffer(member.read(count * row), kind).reshape(-1, *shape[1:])


def _spark_type(shape: tuple[int, ...], kind: np.dtype) -> T.DataType:
    one = {"f": T.DoubleType(), "i": T.LongType(), "u": T.LongType(), "b": T.BooleanType(), "U": T.StringType(), "S": T.StringType()}.get(kind.kind)
    if one is None or len(shape) > 2:
        raise ValueError(f"no column type for an array of {kind} with {len(shape)} axes")
    return T.ArrayType(one) if len(shape) == 2 else one


@dataclass
class _Slice(InputPartition):
    path: str
    start: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> list[_Slice]:
        out = []
        for path in _files(self.path):
            whole = _Bundle(path).rows
            out += [_Slice(path, i, min(self.rows, whole - i)) for i in range(0, whole, self.rows)]
        return out or [_Slice("", 0, 0)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        bundle, columns, schema = _Bundle(partition.path), [], to_arrow_schema(self.schema)
        for field in schema:
            if field.name == SOURCE and SOURCE not in bundle.arrays:
                column = pa.array([partition.path] * partition.rows)
            elif field.name not in bundle.arrays:
                column = pa.nulls(partition.rows, field.type)
            else:
                found = bundle.rows_of(field.name, partition.start, partition.rows)
                if found.dtype.kind == "S":
                    found = np.char.decode(found, "utf-8")
                if found.ndim == 2:
                    offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                    column = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                else:
                    column = pa.array(found.tolist() if found.dtype.kind == "U" else found)
            columns.append(column.cast(field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite, self.run = path.rstrip("/"), rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        part, files, held, n = TaskContext.get().partitionId(), [], [], 0
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        for batch in iterator:
            while batch.num_rows:
                some = batch.slice(0, self.rows - n)
                batch = batch.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == self.rows:
                    files.append(self._save(held, f"{name}-{len(files):04d}.npz"))
                    held, n = [], 0
        if n:
            files.append(self._save(held, f"{name}-{len(files):04d}.npz"))
        return _Written(files)

    def _save(self, batches: list[pa.RecordBatch], name: str) -> str:
        rows, buffer = pa.Table.from_batches(batches), io.BytesIO()
        np.savez(buffer, **{c: _array(c, rows.column(c).combine_chunks()) for c in rows.column_names})
        store, inner = _store(self.path)
        store.create_dir(f"{inner}/_run-{self.run}", recursive=True)
        with store.open_output_stream(f"{inner}/_run-{self.run}/{name}") as out:
            out.write(buffer.getvalue())
        return name

    def commit(self, messages: list[_Written | None]) -> None:
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        old = _files(self.path) if self.overwrite else []
        for name in (f for m in messages if m for f in m.files):
            store.move(f"{inner}/_run-{self.run}/{name}", f"{inner}/{name}")
        for path in old:
            store.delete_file(_store(path)[1])
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, inner = _store(self.path)
        if store.get_file_info(f"{inner}/_run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/_run-{self.run}")


def _array(name: str, column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        if column.null_count:
            raise ValueError(f"column {name} holds a null vector")
        lengths = set(column.value_lengths().to_pylist())
        if len(lengths) > 1:
            raise ValueError(f"column {name} holds vectors of unequal length")
        return _array(name, column.flatten()).reshape(len(column), lengths.pop() if lengths else 0)
    if pa.types.is_floating(column.type):
        return column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    if column.null_count:
        raise ValueError(f"column {name} holds a null")
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), np.str_)
    return column.to_numpy(zero_copy_only=False)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no .npz file in {self.options['path']}")
        return T.StructType([T.StructField(n, _spark_type(shape, kind)) for n, (shape, _, kind) in _Bundle(files[0]).arrays.items()])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("rows_per_task", ROWS_PER_TASK)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("rows_per_file", ROWS_PER_FILE)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def read_npz(spark: SparkSession, path: str, schema: str | T.StructType | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    register(spark)
    reader = spark.read.format("npz").option("rows_per_task", rows_per_task)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_npz(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("npz").option("rows_per_file", rows_per_file).mode(mode).save(path)
