"""Typed-header text tables as a data source: `spark.read.format("typed_table")`.

The header of a table names its columns `name:type`. The schema is read off it, `load` chooses columns, and files are read in
ranges of bytes, several tasks to a file, as Arrow batches. A write puts each task's rows into a file of its own, which
becomes part of the table only when all tasks are done. Paths are those of a file system that driver and workers share.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as text
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, NumericType, StringType, StructField, StructType

RANGE_BYTES = 64 << 20
BATCH_ROWS = 10_000
#: Rows that are texts at once on their way to a file.
WRITE_ROWS = 1_000
# The types a header may name.
TYPES = {"token": StringType(), "float": DoubleType(), "float_seq": ArrayType(FloatType())}
ARROW = {"token": pa.string(), "float": pa.float64(), "float_seq": pa.list_(pa.float32())}


def local(path: str) -> str:
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"typed tables lie in a file system that all workers share, not at {path}")
    return found.path if found.scheme else path


def part_files(path: str) -> list[str]:
    """The files of a table: itself, or those of its folder that are no marks and not hidden."""
    path = local(path)
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return [f"{path}/{f}" for f in sorted(os.listdir(path)) if not f.startswith((".", "_"))]


def header_of(files: list[str], sep: str) -> list[tuple[str, str]]:
    """Names and types of the columns, the same in all files."""
    headers = set()
    for name in files:
        with open(name, encoding="utf-8", newline="") as file:
            headers.add(tuple(next(csv.reader(file, delimiter=sep), ())))
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} different headers" if headers else "no file, so no header")
    columns = [(h.partition(":")[0], h.partition(":")[2]) for h in headers.pop()]
    wrong = [f"{n}:{t}" for n, t in columns if t not in TYPES]
    if wrong:
        raise ValueError(f"the type is not one of {', '.join(TYPES)}: {', '.join(wrong)}")
    return columns


def kind_of(column: DataType) -> str:
    if isinstance(column, ArrayType) and isinstance(column.elementType, NumericType):
        return "float_seq"
    return "float" if isinstance(column, (DoubleType, FloatType)) else "token"


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class TypedReader(DataSourceReader):
    def __init__(self, path: str, sep: str, columns: list[tuple[str, str]], load: list[str], range_bytes: int):
        self.path, self.sep, self.columns, self.load, self.range_bytes = path, sep, columns, load, range_bytes

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in part_files(self.path):
            size = os.path.getsize(name)
            out += [Range(name, at, min(at + self.range_bytes, size)) for at in range(0, max(size, 1), self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that start within the range, without the header."""
        with open(partition.file, "rb") as file:
            if partition.start:
                # The line that a range begins within belongs to the range before.
                file.seek(partition.start - 1)
            file.readline()
            held: list[bytes] = []
            while file.tell() < partition.end and (line := file.readline()):
                held.append(line)
                if len(held) == BATCH_ROWS:
                    yield self.batch(held)
                    held = []
            if held:
                yield self.batch(held)

    def batch(self, lines: list[bytes]) -> pa.RecordBatch:
        names = [n for n, _ in self.columns]
        kinds = dict(self.columns)
        table = text.read_csv(
            io.BytesIO(b"".join(lines)),
            text.ReadOptions(column_names=names, use_threads=False),
            text.ParseOptions(delimiter=self.sep, quote_char='"', escape_char="\\", ignore_empty_lines=len(names) > 1),
            text.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=self.load, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
        ).combine_chunks()
        return pa.RecordBatch.from_arrays([parsed(table[n].combine_chunks(), kinds[n]) for n in self.load], self.load)


def parsed(column: pa.Array, kind: str) -> pa.Array:
    if kind == "token":
        return column
    if kind == "float":
        return column.cast(pa.float64())
    # No number at all is an empty list.
    parts = pc.split_pattern(pc.if_else(pc.equal(column, ""), None, column), " ")
    lists = pa.ListArray.from_arrays(parts.offsets, parts.flatten().cast(pa.float32()), mask=parts.is_null()) if len(parts) else parts.cast(ARROW[kind])
    empty = pc.fill_null(pc.equal(column, ""), False)
    return pc.if_else(empty, pa.scalar([], ARROW[kind]), lists) if pc.any(empty).as_py() else lists


class TypedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sep: str, schema: StructType, overwrite: bool):
        self.path, self.sep, self.overwrite = local(path), sep, overwrite
        self.kinds = [(f.name, kind_of(f.dataType)) for f in schema.fields]
        self.run = uuid.uuid4().hex

    def folder(self) -> str:
        return f"{self.path}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder(), exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.tsv"
        with open(f"{self.folder()}/{name}", "w", encoding="utf-8", newline="") as file:
            out = csv.writer(file, delimiter=self.sep, escapechar="\\", doublequote=False, lineterminator="\n")
            out.writerow([f"{n}:{k}" for n, k in self.kinds])
            for batch in iterator:
                for part in (batch.slice(at, WRITE_ROWS) for at in range(0, batch.num_rows, WRITE_ROWS)):
                    columns = [written(part.column(i), kind, self.sep) for i, (_, kind) in enumerate(self.kinds)]
                    file.writelines(self.sep.join(row) + "\n" for row in zip(*columns, strict=True))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        before = [f for f in os.listdir(self.path) if f.startswith("part-")] if self.overwrite else []
        for message in messages:
            if message is not None and message.file:
                os.replace(f"{self.folder()}/{message.file}", f"{self.path}/{message.file}")
        for name in before:
            os.remove(f"{self.path}/{name}")
        self.clear()
        with open(f"{self.path}/_SUCCESS", "w", encoding="utf-8"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Files of attempts that do not count."""
        if os.path.isdir(self.folder()):
            for name in os.listdir(self.folder()):
                os.remove(f"{self.folder()}/{name}")
            os.rmdir(self.folder())


def written(column: pa.Array, kind: str, sep: str) -> list[str]:
    """A column as texts. Numbers of single precision are written with the digits that tell them from others of theirs."""
    if pa.types.is_timestamp(column.type) and column.type.tz:
        # As a row of Python holds it: without a zone, in that of the worker.
        return [field(value and value.astimezone().replace(tzinfo=None), kind, sep) for value in column.to_pylist()]
    if kind != "float_seq" or not pa.types.is_float32(column.type.value_type) or not plain(column.flatten()):
        return [field(value, kind, sep) for value in column.to_pylist()]
    texts = pc.binary_join(pa.ListArray.from_arrays(ends(column), column.flatten().cast(pa.string())), " ")
    empty, there = column.value_lengths().fill_null(0).to_numpy() == 0, np.asarray(column.is_valid())
    return ['""' if none and known else text for text, none, known in zip(texts.to_pylist(), empty, there, strict=True)]


def plain(numbers: pa.Array) -> bool:
    """Whether none of the numbers is missing or not finite."""
    return numbers.null_count == 0 and bool(np.isfinite(numbers.to_numpy()).all())


def ends(column: pa.ListArray) -> pa.Array:
    """Where the lists of a column, null ones empty, lie in its flattened numbers."""
    return pa.array(np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())).astype(np.int32))


def field(value, kind: str, sep: str) -> str:
    """A value as text: null as nothing, an empty text in quotes, and quotes around what could be misread."""
    if value is None:
        return ""
    if kind == "float_seq":
        return " ".join(number(x) for x in value) or '""'
    if kind == "float":
        return repr(float(value))
    written = str(value)
    if "\n" in written or "\r" in written:
        raise ValueError("a value of a typed table holds no line break")
    if written and not any(c in written for c in (sep, '"', "\\")):
        return written
    return '"' + written.replace("\\", "\\\\").replace('"', '\\"') + '"'


class TypedTable(DataSource):
    """Options: path, sep (a tab), load (columns, separated by commas), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "typed_table"

    def _columns(self) -> tuple[list[tuple[str, str]], list[str]]:
        columns = header_of(part_files(self.options["path"]), self.options.get("sep", "\t"))
        names = [n for n, _ in columns]
        load = [c.strip() for c in self.options["load"].split(",")] if self.options.get("load") else names
        missing = [c for c in load if c not in names]
        if missing:
            raise ValueError(f"columns not in the header: {', '.join(missing)}")
        return columns, load

    def schema(self) -> StructType:
        columns, load = self._columns()
        kinds = dict(columns)
        return StructType([StructField(n, TYPES[kinds[n]]) for n in load])

    def reader(self, schema: StructType) -> DataSourceReader:
        columns, load = self._columns()
        return TypedReader(self.options["path"], self.options.get("sep", "\t"), columns, load, int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TypedWriter(self.options["path"], self.options.get("sep", "\t"), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TypedTable)
