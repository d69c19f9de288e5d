"""Import of JSON, CSV and XML as text columns with inferred types, and export to JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.errors import DepthLimit, ParseFailure, RecordError
from ledgerframe.functions.scalars import bytes_text
from ledgerframe.operators.inference import infer_types, typed
from ledgerframe.operators.records import NULLS

MAX_DEPTH = 64
# Names of kinds in a schema hint.
HINTS = {"i64": "int", "int": "int", "f64": "float", "float": "float", "bool": "bool", "time": "time", "binary": "hex", "hex": "hex", "string": "string", "str": "string"}


def all_text(kind: T.DataType, depth: int = 0) -> T.DataType:
    """The shape of a JSON schema with every leaf as text."""
    if depth > MAX_DEPTH:
        raise DepthLimit("objects are nested too deep")
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, all_text(f.dataType, depth + 1)) for f in kind])
    return T.ArrayType(T.StringType()) if isinstance(kind, T.ArrayType) else T.StringType()


def flattened(frame: DataFrame) -> DataFrame:
    """Nested objects as columns a.b; arrays count as empty."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                c = F.col(".".join(f"`{p}`" for p in here))
                out.append((F.lit(None).cast("string") if isinstance(f.dataType, T.ArrayType) else c).alias(".".join(here)))

    walk(frame.schema, [])
    return frame.select(*out)


def _finished(frame: DataFrame, hint: dict[str, str] | None, policy: str) -> DataFrame:
    """Columns with the hinted kinds, or the inferred ones; the frame is read twice only to infer."""
    if hint is not None:
        return typed(frame.select(*(F.col(f"`{c}`") for c in hint)), {c: HINTS[k] for c, k in hint.items()})
    found = {r.field: r.kind for r in infer_types(frame.toDF(*(c.replace(".", "\x1f") for c in frame.columns)), policy=policy).collect()}  # a row per column
    kinds = {c.replace("\x1f", "."): k for c, k in found.items()}
    if "conflict" in kinds.values():
        raise RecordError("columns of mixed types: " + ", ".join(c for c, k in kinds.items() if k == "conflict"))
    return typed(frame, kinds)


def read_json(spark: SparkSession, path: str, lines: bool = False, hint: dict[str, str] | None = None, policy: str = "string") -> DataFrame:
    """An array of objects, an object with an array `records`, or one object per line."""
    options = {"multiLine": not lines, "mode": "FAILFAST", "primitivesAsString": True}
    schema = spark.read.options(**options).json(path).schema
    frame = spark.read.options(**options).schema(all_text(schema)).json(path)
    inner = schema["records"].dataType if schema.names == ["records"] else None
    if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
        shape = T.StructType([T.StructField("records", T.ArrayType(all_text(inner.elementType)))])
        frame = spark.read.options(**options).schema(shape).json(path).select(F.explode("records").alias("r")).select("r.*")
    return _finished(flattened(frame), hint, policy)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, hint: dict[str, str] | None = None, policy: str = "string") -> DataFrame:
    """CSV with quotes doubled inside quoted cells; without a header, columns are col_0, col_1..."""
    frame = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, quote='"', escape='"', multiLine=True, mode="FAILFAST")
    if not header:
        frame = frame.toDF(*(f"col_{i}" for i in range(len(frame.columns))))
    return _finished(frame, hint, policy)


def read_xml(spark: SparkSession, path: str, record_tag: str, attributes: str = "fields", hint: dict[str, str] | None = None, policy: str = "string") -> DataFrame:
    """Elements of one tag as rows; attributes as fields, or with an @ before their name (attributes="prefix").

    A document type declaration is refused.
    """
    if spark.read.text(path).where(F.col("value").contains("<!DOCTYPE") | F.col("value").contains("<!ENTITY")).limit(1).count():
        raise ParseFailure("document type declarations are not allowed")
    reader = spark.read.format("xml").option("rowTag", record_tag).option("attributePrefix", "@" if attributes == "prefix" else "_attr_").option("inferSchema", False)
    frame = flattened(reader.load(path))
    if attributes != "prefix":
        frame = frame.toDF(*(c.replace("_attr_", "") for c in frame.columns))
    return _finished(frame, hint, policy)


def json_ready(frame: DataFrame, binary: str = "base64") -> Column:
    """A row as JSON: absent fields left out, explicit nulls kept, numbers that aren't finite null."""
    nulls = F.col(NULLS) if NULLS in frame.columns else F.array().cast("array<string>")
    entries = []
    for f in frame.schema:
        if f.name.startswith("_") and f.name in (NULLS, "_record_index", "_file") or (f.name == "_null_fields"):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            if binary == "skip":
                continue
            c = bytes_text(c, binary)
        finite = ~F.isnan(c) & (F.abs(c) != float("inf")) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.lit(True)
        body = F.regexp_replace(F.to_json(F.struct(F.when(finite, c).alias(f.name)), {"ignoreNullFields": "false"}), r"^\{|\}$", "")
        shown = c.isNotNull() | F.array_contains(nulls, f.name)
        entries.append(F.when(shown, body))
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def write_json(frame: DataFrame, path: str, binary: str = "base64", limit: int = -1) -> None:
    """One object per line."""
    rows = frame if limit < 0 else frame.limit(limit)
    rows.select(json_ready(frame, binary).alias("value")).write.text(path)


def json_array(frame: DataFrame, limit: int = 100, binary: str = "base64") -> str:
    """A bounded number of rows as one JSON array."""
    return "[" + ",".join(r.value for r in frame.select(json_ready(frame, binary).alias("value")).limit(limit).collect()) + "]"


def write_csv(frame: DataFrame, path: str, columns: list[str] | None = None, delimiter: str = ",", binary: str = "base64") -> None:
    """CSV with a header; an unknown column is an error, binary is text, hidden columns are left out."""
    columns = columns or [c for c in frame.columns if c not in (NULLS, "_record_index", "_file")]
    unknown = [c for c in columns if c not in frame.columns]
    if unknown:
        raise RecordError(f"no such column: {', '.join(unknown)}")
    kinds = dict(frame.dtypes)
    rows = frame.select(*(bytes_text(F.col(c), binary).alias(c) if kinds[c] == "binary" else F.col(f"`{c}`") for c in columns))
    rows.write.csv(path, header=True, sep=delimiter, quote='"', escape='"')


def verified_copy(original: DataFrame, copy: DataFrame) -> bool:
    """Whether both hold the same rows as often."""
    return original.exceptAll(copy).isEmpty() and copy.exceptAll(original).isEmpty()
