"""Record files by path: what is there, what it holds, what it weighs, and into other formats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.errors import RecordError
from ledgerframe.sources import convert
from ledgerframe.sources.codec import RecordFile, pad8, take
from ledgerframe.sources.recordfile import HIDDEN, directory_index, inspect, read_bytes, read_header, record_at, register
from ledgerframe.sources.textfmt import read_text_records

STATISTICS = "file string, part string, field string, payload long, padding long, bitmap long"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    return directory_index(spark, folder)


def inspected(path: str, records: int | None = 3, verify: bool = False) -> dict:
    """One file's layout, fields and first records (all for None)."""
    return inspect(read_bytes(path), records, verify)


def described(path: str) -> list[dict]:
    """One file's fields, from its header alone."""
    return [{"slot": i, "name": f.name, "sigil": f.sigil} for i, f in enumerate(read_header(path)[0].fields)]


def fetched(path: str, index: int) -> dict:
    return record_at(read_bytes(path), index)


def opened(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("recordfile").load(path)


def to_json(spark: SparkSession, path: str, target: str | None = None, limit: int = 100, binary: str = "base64") -> str | None:
    """Records as a JSON array, or as lines in files at the target; a limit of -1 is all and needs a target, 0 is none."""
    rows = opened(spark, path).drop("_record_index", "_file")
    if target is not None:
        convert.write_json(rows, target, binary, limit)
        return None
    if limit < 0:
        raise RecordError("all records go to files only: give a target")
    return convert.json_array(rows, limit, binary)


def to_csv(spark: SparkSession, path: str, target: str, columns: list[str] | None = None, delimiter: str = ",") -> None:
    convert.write_csv(opened(spark, path), target, columns, delimiter)


def imported(spark: SparkSession, source: str, kind: str, target: str, layout: str = "compact", **options: object) -> int:
    """A file of kind json, ndjson, csv or xml into record files; the number of records."""
    readers = {"json": convert.read_json, "csv": convert.read_csv, "xml": convert.read_xml}
    if kind == "ndjson":
        rows = convert.read_json(spark, source, lines=True, **options)
    elif kind in readers:
        rows = readers[kind](spark, source, **options)
    else:
        raise RecordError(f"no import of {kind!r}")
    return transcoded(rows, target, layout)


def compiled(spark: SparkSession, source: str, target: str, layout: str = "compact") -> int:
    """Text sources into record files; the number of records."""
    return transcoded(read_text_records(spark, source), target, layout)


def transcoded(rows: DataFrame, target: str, layout: str) -> int:
    """Records, of a file of any layout or any other table, into files of the layout; their number."""
    register(rows.sparkSession)
    rows.drop(*(c for c in HIDDEN.names if c != "_null_fields")).write.format("recordfile").mode("overwrite").option("layout", layout).save(target)
    return opened(rows.sparkSession, target).count()


def file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of every sealed columnar or paged file below path: (file, part, field, payload, padding, bitmap, total, percent).

    A row a column (part "column"), and one each for the header, page frames and the index behind the records;
    a file's rows add up to its size.  Files are read one a task row; percent is of the file.  Files of the row
    layouts have no columns: all their records are one part, "records".
    """

    def parts_of(data: bytes) -> Iterator[tuple[str, str | None, int, int, int]]:
        file = RecordFile(data, verify=False)
        tail = file.header.tail or take(data, "<Q", len(data) - 12)[0]
        yield "header", None, file.header.start, 0, 0
        yield "index", None, len(data) - tail, 0, 0
        body = tail - file.header.start
        if file.layout not in ("columnar", "paged"):
            yield "records", None, body, 0, 0
            return
        sums = {f.name: [0, 0, 0] for f in file.fields}
        for _, columns in file.batches():
            for f, (present, values) in zip(file.fields, columns, strict=True):
                bitmap = -(-len(present) // 8)
                payload = 4 * len(values[0]) + len(values[1]) if isinstance(values, tuple) else values.nbytes
                for i, size in enumerate((payload, pad8(payload), bitmap + pad8(bitmap))):
                    sums[f.name][i] += size
        for name, sizes in sums.items():
            yield "column", name, *sizes
        if file.layout == "paged":
            yield "frames", None, body - sum(map(sum, sums.values())), 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *row) for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in parts_of(data.as_py())]
            kinds = [pa.string()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "part", "field", "payload", "padding", "bitmap"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")
    rows = files.select("path", "content").mapInArrow(run, STATISTICS).withColumn("total", F.expr("payload + padding + bitmap"))
    sizes = files.select(F.col("path").alias("file"), "length")
    return rows.join(sizes, "file").select(*rows.columns, F.round(F.col("total") * F.lit(100.0) / F.col("length"), 1).alias("percent"))

