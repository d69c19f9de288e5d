"""Binary record files as a Spark data source (format "recordfile").

Reading: options path (file, folder or glob, in any store that pyarrow.fs or Spark knows) and columns
(names with commas between, all by default; .schema(...) does the same).  A file is one partition; a paged
file is one partition per run of pages, read by byte range; of a columnar file only the columns asked for
are read.  Columns are handed to Spark as Arrow batches.  Hidden columns: _record_index, _null_fields (explicit nulls), _file.
Writing: one file per task; options layout (compact, row, columnar, paged) and page_size.
Streaming: readStream reads the complete records (row layouts) or pages (paged) of files that still
grow, each once; a columnar file can't grow, so it is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from ledgerframe.errors import OutOfBounds, RecordError, UnsupportedLayout
from ledgerframe.sources.codec import PAGE_ROWS, Field, Header, RecordFile, column_array, decode_column, decode_header, decode_page, log_header, log_record, log_records, take, unsealed_pages, unsealed_records, write_file

SPARK_TYPES = {"=": T.LongType(), "~": T.DoubleType(), "?": T.BooleanType(), '"': T.StringType(), "$": T.StringType(), "@": T.LongType(), "<": T.BinaryType(), "^": T.StringType()}
HIDDEN = T.StructType([T.StructField("_record_index", T.LongType()), T.StructField("_null_fields", T.ArrayType(T.StringType())), T.StructField("_file", T.StringType())])
BATCH_ROWS = 8_192
HEADER_BYTES = 1 << 16
PAGES_PER_PARTITION = 64
#: Bytes that a streaming step reads of a file at first.
STEP_BYTES = 16 << 20
#: A task that has written this much to a span log begins another one.
LOG_BYTES = 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def files_at(path: str, suffix: str = "") -> list[str]:
    """Files at a path in order, hidden ones left out; names below a store keep its scheme."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else []
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    keep = lambda f: f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name.endswith(suffix)
    return sorted(scheme + f.path for f in found if keep(f))


def read_header(path: str) -> tuple[Header, bytes]:
    """A file's header and its bytes, from the beginning of the file and no more of it than needed."""
    size = HEADER_BYTES
    while True:
        data = read_bytes(path, 0, size)
        try:
            header = decode_header(data)
            return header, data[: header.start]
        except OutOfBounds:
            if len(data) < size:  # the file ends before its header does
                raise
            size *= 4


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def schema_of(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, SPARK_TYPES.get(f.sigil, T.StringType())) for f in fields])


def fields_of(schema: T.StructType) -> list[Field]:
    """Fields of the format for a Spark schema; times are given by the name ending _ns or by metadata sigil."""
    out = []
    for f in schema:
        kind = f.dataType
        sigil = f.metadata.get("sigil") or (
            "?" if isinstance(kind, T.BooleanType) else "=" if isinstance(kind, T.IntegralType) else "~" if isinstance(kind, (T.FloatType, T.DoubleType))
            else '"' if isinstance(kind, T.StringType) else "<" if isinstance(kind, T.BinaryType) else "L" if isinstance(kind, T.ArrayType) else "^"
        )
        if sigil == "^":
            raise RecordError(f"no cells for {kind.simpleString()}")
        out.append(Field(f.name, "@" if sigil == "=" and f.name.endswith("_ns") else sigil))
    return out


@dataclass
class Slice(InputPartition):
    path: str
    pages: tuple[tuple[int, int, int], ...] | None = None  # first record, place, length


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def _files(self) -> list[str]:
        found = files_at(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> T.StructType:
        """The union of the files' fields in the order first seen; fields that a file lacks are absent in it."""
        seen: dict[str, T.StructField] = {}
        for path in self._files():
            for f in schema_of(read_header(path)[0].fields):
                seen.setdefault(f.name, f)
        if "columns" in self.options:
            wanted = [c.strip() for c in self.options["columns"].split(",")]
            if missing := [c for c in wanted if c not in seen]:
                raise RecordError(f"no such column: {', '.join(missing)}")
            seen = {c: seen[c] for c in wanted}
        return T.StructType([*seen.values(), *HIDDEN])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self._files(), schema)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return Growing(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], schema, self.options.get("layout", "compact"), int(self.options.get("page_size", PAGE_ROWS)), overwrite)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.schema = paths, schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if read_header(path)[0].layout != "paged":
                out.append(Slice(path))
                continue
            fs, inner = filesystem(path)
            size = fs.get_file_info(inner).size
            tail, _, count, _ = take(read_bytes(path, size - 28, 28), "<QQII", 0)
            entries = read_bytes(path, tail, 28 * count)
            pages = [take(entries, "<IQIQI", 28 * i) for i in range(count)]
            out += [Slice(path, tuple((p[1], p[3], p[4]) for p in pages[i : i + PAGES_PER_PARTITION])) for i in range(0, count, PAGES_PER_PARTITION)]
        return out or [Slice(self.paths[0])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.pages is None:
            header = read_header(partition.path)[0]
            if header.layout == "columnar":
                yield self._sectors(partition.path, header)
                return
            yield from batches(RecordFile(read_bytes(partition.path)), partition.path, self.schema)
            return
        fields = read_header(partition.path)[0].fields
        for first, at, size in partition.pages:
            _, _, columns, _ = decode_page(fields, read_bytes(partition.path, at, size), 0)
            yield column_batch(fields, columns, first, partition.path, self.schema)

    def _sectors(self, path: str, header: Header) -> pa.RecordBatch:
        """The schema's columns of a columnar file, each read by its byte range."""
        if not header.tail:
            raise UnsupportedLayout("columnar files cannot be streamed")
        fs, inner = filesystem(path)
        tail, count = take(read_bytes(path, fs.get_file_info(inner).size - 20, 20), "<QQ", 0)
        entries = read_bytes(path, tail, 20 * len(header.fields))
        # without any column the first one tells how many records there are
        wanted = [i for i, f in enumerate(header.fields) if f.name in self.schema.names] or [0][: len(header.fields)]
        places = [take(entries, "<HHQQ", 20 * i) for i in wanted]
        columns = [decode_column(read_bytes(path, at, size), 0, header.fields[i], count)[:2] for i, _, at, size in places]
        return column_batch([header.fields[i] for i in wanted], columns, 0, path, self.schema)


class Growing(SimpleDataSourceStreamReader):
    """Files that grow.  An offset holds, by file, the next byte and the next record's index; a step reads some megabytes of a file."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, files = [], dict(start["files"])
        for path in files_at(self.path):
            got, files[path] = self._step(path, *files.get(path, (0, 0)))
            rows += got
        return iter(rows), {"files": files}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for path, (to, _) in end["files"].items():
            yield from self._step(path, *start["files"].get(path, (0, 0)), to)[0]

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the files stay."""

    def _step(self, path: str, at: int, index: int, end: int | None = None) -> tuple[list[tuple], list[int]]:
        """Rows from byte `at` (0: the first record) up to `end`, or as far as a step goes; where to go on."""
        try:
            header, head = read_header(path)
        except OutOfBounds:  # not even the header is complete yet
            return [], [at, index]
        complete = unsealed_pages if header.layout == "paged" else unsealed_records
        at, size = at or header.start, STEP_BYTES
        while True:
            part = read_bytes(path, at, size if end is None else end - at)
            records, next_at = complete(head + part)
            if records or end is not None or len(part) < size:
                break
            size *= 4  # one record or page is longer than a step
        rows = []
        for i, record in enumerate(records, index):
            whole = record | {"_record_index": i, "_null_fields": [k for k, v in record.items() if v is None], "_file": path}
            rows.append(tuple(whole.get(f.name) for f in self.schema))
        return rows, [at + next_at - len(head), index + len(rows)]


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def column_batch(fields: list[Field], columns: list, first: int, path: str, schema: T.StructType) -> pa.RecordBatch:
    n = len(columns[0][0]) if columns else 0
    made = {f.name: column_array(f, *c) for f, c in zip(fields, columns, strict=True) if f.name in schema.names}
    made |= {"_record_index": pa.array(range(first, first + n), pa.int64()), "_null_fields": pa.array([[]] * n, pa.list_(pa.string())), "_file": pa.array([path] * n)}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, arrow_type(f.dataType)) for f in schema], names=schema.names)


def batches(file: RecordFile, path: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if file.layout in ("columnar", "paged"):
        for first, columns in file.batches():
            yield column_batch(file.fields, columns, first, path, schema)
        return
    rows: list[dict] = []
    for i, row in enumerate(file.records()):
        rows.append(row | {"_record_index": i, "_null_fields": [k for k, v in row.items() if v is None], "_file": path})
        if len(rows) == BATCH_ROWS:
            yield row_batch(rows, schema)
            rows = []
    if rows:
        yield row_batch(rows, schema)


def row_batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], arrow_type(f.dataType)) for f in schema], names=schema.names)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    records: int


class Writer(DataSourceWriter):
    """Files appear under their final names only when all tasks have succeeded."""

    def __init__(self, path: str, schema: T.StructType, layout: str, page_rows: int, overwrite: bool):
        self.path, self.layout, self.page_rows, self.overwrite = path.rstrip("/"), layout, page_rows, overwrite
        self.kept = [f for f in schema if f.name not in HIDDEN.names]
        self.fields, self.marks = fields_of(T.StructType(self.kept)), "_null_fields" in schema.names

    def write(self, rows: Iterator) -> Written:
        data = []
        for row in rows:
            nulls = (row["_null_fields"] or []) if self.marks else []
            data.append({f.name: row[f.name] for f in self.fields if row[f.name] is not None or f.name in nulls})
        if not data:
            return Written(None, 0)
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        name = f"{inner}/.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(name) as out:
            out.write(write_file(self.fields, data, self.layout, self.page_rows))
        return Written(name, len(data))

    def commit(self, messages: list[Written]) -> None:
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and not f.base_name.startswith(".")]
        job = uuid.uuid4().hex[:12]
        for i, m in enumerate(m for m in messages if m and m.path):
            fs.move(m.path, f"{inner}/records-{i:05d}-{job}")
        for path in old if self.overwrite else []:
            fs.delete_file(path)

    def abort(self, messages: list[Written]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Source)


def read_through_spark(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Sealed files of a known schema, from any store that Spark reads; each file must fit a task."""
    full = T.StructType([*schema.fields, *HIDDEN])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                yield from batches(RecordFile(content.as_py()), name, full)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, full)


def write_log(spans: DataFrame, path: str, log_bytes: int = LOG_BYTES) -> int:
    """Append logs of the spans in a folder, at least one a task with rows, each of about log_bytes at most; the number of spans.

    As with record files, logs get their names when all tasks have succeeded, so a task that runs again leaves none twice.
    """
    path = path.rstrip("/")

    def append(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(path)
        fs.create_dir(inner, recursive=True)
        filled = (part.select([f for f, c in zip(part.schema.names, part.columns, strict=True) if c.null_count < len(c)] or part.schema.names) for part in parts)
        rows = ({k: v for k, v in row.items() if v is not None} for part in filled for at in range(0, part.num_rows, BATCH_ROWS) for row in part.slice(at, BATCH_ROWS).to_pylist())
        row = next(rows, None)
        while row is not None:
            name, n = f"{inner}/.{uuid.uuid4().hex}.part", 0
            with fs.open_output_stream(name) as out:
                size = out.write(log_header())
                while row is not None and (not n or size < log_bytes):
                    size += out.write(log_record(row))
                    n, row = n + 1, next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    written = spans.mapInArrow(append, "name string, n long").collect()  # a row a log
    fs, inner = filesystem(path)
    fs.create_dir(inner, recursive=True)
    job = uuid.uuid4().hex[:12]
    for i, log in enumerate(written):
        fs.move(log["name"], f"{inner}/{i:05d}-{job}.log")
    return sum(log["n"] for log in written)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Spans of append logs, up to the first damaged record of each."""
    from ledgerframe.operators.spans import SPAN

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                records = islice(log_records(content.as_py()), 1, None)  # without the header
                while rows := [row for row, _ in islice(records, BATCH_ROWS)]:
                    for r in rows:
                        r["payload"] = r["payload"].decode() if isinstance(r.get("payload"), bytes) else r.get("payload")
                        r["parent_span_id"] = r.get("parent_span_id") or None
                    yield row_batch(rows, SPAN)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SPAN)


def directory_index(spark: SparkSession, path: str) -> DataFrame:
    """(uri, path, record_count, size_bytes) of every sealed file below path."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = []
            for content in part.column(2):
                try:
                    counts.append(RecordFile(content.as_py(), verify=False).count)
                except RecordError:
                    counts.append(None)
            paths = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"records://{p.split(':', 1)[-1].lstrip('/')}" for p in paths]), pa.array(paths), pa.array(counts, pa.int64()), part.column(1)], ["uri", "path", "record_count", "size_bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content").mapInArrow(run, "uri string, path string, record_count long, size_bytes long")


def inspect(data: bytes, records: int | None = 3, verify: bool = False) -> dict:
    """What a file holds: layout, flags, fields and the first records (all for None)."""
    file = RecordFile(data, verify)
    wanted = file.count if records is None else min(records, file.count)
    rows = [r for r, _ in zip(file.records(), range(wanted), strict=False)]
    return {"layout": file.layout, "flags": file.header.flags, "record_count": file.count, "size_bytes": len(data), "fields": [{"name": f.name, "sigil": f.sigil, "width": f.width} for f in file.fields], "records": rows}


def record_at(data: bytes, index: int) -> dict:
    if index < 0:
        raise OutOfBounds(f"record index {index} is negative")
    return RecordFile(data).record(index)


__all__ = ["Source", "directory_index", "inspect", "read_log", "read_through_spark", "record_at", "register", "unsealed_pages", "unsealed_records", "write_log"]
