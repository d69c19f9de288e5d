"""The text record format: sigil-typed objects, macros and layout pragmas, read into DataFrames.

A source is a sequence of `key: value` entries and `name { ... }` blocks.  Every value starts with a
sigil (see TYPES); lists hold one type; `!` introduces an expression that is folded while reading.
Blocks of one name become rows of one table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerframe.errors import DepthLimit, ListTypeMismatch, MacroUnresolved, Overflow, ParseFailure

MAX_DEPTH = 64
# The format's sigils and escapes.
TYPES: dict[str, T.DataType] = {"=": T.LongType(), "~": T.DoubleType(), "?": T.BooleanType(), "$": T.StringType(), '"': T.StringType(), "@": T.LongType(), "<": T.BinaryType(), "^": T.NullType()}
ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t", "0": "\0"}
PRAGMA = re.compile(r"^[ \t]*@(layout|page-size)[ \t]+([\w-]+)[ \t]*;?[ \t]*$", re.M)
KEY = re.compile(r'[^\s{}\[\]:",#]+')
STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?)?")


@dataclass
class Value:
    """A value with the sigil it was written with; a list keeps its items' sigil, a block has '{'."""

    sigil: str
    value: object
    item: str = ""


@dataclass
class Source:
    """A parsed source: its entries in order, with pragmas."""

    entries: list[tuple[str, Value]]
    pragmas: dict[str, str] = field(default_factory=dict)


def nanoseconds(text: str) -> int:
    """A time literal: a date, a date and time with up to nine decimals, or plain nanoseconds."""
    if re.fullmatch(r"-?\d+", text):
        return in_range(int(text))
    found = STAMP.fullmatch(text)
    if not found:
        raise ParseFailure(f"not a time: {text!r}")
    parts = [int(x or 0) for x in found.groups()[:6]]
    try:
        seconds = int(datetime(*parts, tzinfo=UTC).timestamp())
    except ValueError as e:
        raise ParseFailure(f"not a time: {text!r}") from e
    return in_range(seconds * 1_000_000_000 + int((found[7] or "").ljust(9, "0")))


def in_range(number: int) -> int:
    if not -(2**63) <= number < 2**63:
        raise Overflow(f"{number} does not fit 64 bits")
    return number


class Parser:
    def __init__(self, text: str, clock: Callable[[], int] = time.time_ns):
        self.text, self.at, self.clock = text, 0, clock

    def fail(self, what: str) -> ParseFailure:
        line = self.text.count("\n", 0, self.at) + 1
        return ParseFailure(f"line {line}: {what}")

    def skip(self) -> str:
        """Pass blanks and comments; the next character, or nothing at the end."""
        found = re.compile(r"(?:\s|#[^\n]*)*").match(self.text, self.at)
        self.at = found.end()
        return self.text[self.at : self.at + 1]

    def take(self, pattern: re.Pattern[str] | str, what: str) -> str:
        found = re.compile(pattern).match(self.text, self.at)
        if not found:
            raise self.fail(f"expected {what}")
        self.at = found.end()
        return found[0]

    def entries(self, depth: int, closing: str) -> list[tuple[str, Value]]:
        if depth > MAX_DEPTH:
            raise DepthLimit("objects are nested too deep")
        out: list[tuple[str, Value]] = []
        while (c := self.skip()) != closing:
            if not c:
                raise self.fail("the object does not end")
            key = self.string() if c == '"' else self.take(KEY, "a key")
            c = self.skip()
            if c == ":":
                self.at += 1
                c = self.skip()
            elif c != "{":
                raise self.fail("expected : or {")
            out.append((key, self.value(c, depth, dict(out))))
            if self.skip() == ",":
                self.at += 1
        self.at += len(closing)
        return out

    def value(self, c: str, depth: int, scope: dict[str, Value]) -> Value:
        if c == "{":
            self.at += 1
            return Value("{", self.entries(depth + 1, "}"))
        if c == "[":
            return self.items(depth + 1)
        self.at += 1
        match c:
            case "=":
                return Value(c, in_range(int(self.take(r"[+-]?\d+", "an integer"))))
            case "~":
                return Value(c, float(self.take(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|nan)", "a number")))
            case "?":
                return Value(c, self.take("true|false", "true or false") == "true")
            case "$":
                return Value(c, self.take(KEY, "a keyword"))
            case '"':
                self.at -= 1
                return Value(c, self.string())
            case "@":
                return Value(c, nanoseconds(self.take(r"[\dT:.-]+", "a time")))
            case "<":
                digits = re.sub(r"\s", "", self.take(r"[0-9a-fA-F\s]*>", "hex digits and >")[:-1])
                if len(digits) % 2:
                    raise self.fail("an odd number of hex digits")
                return Value(c, bytes.fromhex(digits))
            case "^":
                return Value(c, None)
            case "!":
                return self.macro(scope)
        raise self.fail("a value must start with its sigil")

    def items(self, depth: int) -> Value:
        if depth > MAX_DEPTH:
            raise DepthLimit("lists are nested too deep")
        self.at += 1
        out: list[Value] = []
        while (c := self.skip()) != "]":
            if not c:
                raise self.fail("the list does not end")
            out.append(self.value(c, depth, {}))
            if out[-1].sigil != out[0].sigil:
                raise ListTypeMismatch("a list holds values of one type")
            if self.skip() == ",":
                self.at += 1
        self.at += 1
        return Value("[", [v.value for v in out], out[0].sigil if out else "^")

    def string(self) -> str:
        out: list[str] = []
        self.at += 1
        while True:
            out.append(self.take(r'[^"\\]*', "text"))
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c == '"':
                return "".join(out)
            if not c:
                raise self.fail("the string does not end")
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c in ("u", "U"):
                code = int(self.take("[0-9a-fA-F]{%d}" % (4 if c == "u" else 8), "hex digits"), 16)
                if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                    raise self.fail("no such character")
                out.append(chr(code))
            elif c in ESCAPES:
                out.append(ESCAPES[c])
            else:
                raise self.fail(f"unknown escape \\{c}")

    # -- expressions: sums of products of atoms

    def macro(self, scope: dict[str, Value]) -> Value:
        left = self.term(scope)
        while (c := self.skip()) in ("+", "-") and c:
            self.at += 1
            left = self.apply(c, left, self.term(scope))
        return left

    def term(self, scope: dict[str, Value]) -> Value:
        left = self.atom(scope)
        while (c := self.skip()) in ("*", "/", "%") and c:
            self.at += 1
            left = self.apply(c, left, self.atom(scope))
        return left

    def atom(self, scope: dict[str, Value]) -> Value:
        c = self.skip()
        if c == "(":
            self.at += 1
            out = self.macro(scope)
            self.skip()
            self.take(r"\)", ")")
            return out
        if c == "-":
            self.at += 1
            return self.apply("-", Value("=", 0), self.atom(scope))
        if self.text.startswith("now()", self.at):
            self.at += 5
            return Value("@", self.clock())
        if self.text.startswith("len(", self.at):
            self.at += 4
            inner = self.atom(scope)
            self.skip()
            self.take(r"\)", ")")
            if isinstance(inner.value, str):
                return Value("=", len(inner.value.encode()))
            if isinstance(inner.value, bytes):
                return Value("=", len(inner.value))
            raise MacroUnresolved("len() takes text or bytes")
        if c == "@" and not re.compile(r"@\d").match(self.text, self.at):
            self.at += 1
            name = self.take(r"[A-Za-z_][\w-]*", "a key")
            if name not in scope:
                raise MacroUnresolved(f"@{name} is not known here")
            return scope[name]
        if re.compile(r"\d").match(c or " "):
            text = self.take(r"\d+(?:\.\d+)?", "a number")
            return Value("~", float(text)) if "." in text else Value("=", in_range(int(text)))
        if c == '"':
            raw = self.string()
            text = re.sub(r"@([A-Za-z_]\w*)", lambda m: str(scope[m[1]].value) if m[1] in scope else m[0], raw)
            return Value('"', text)
        return self.value(c, 0, scope)

    def apply(self, op: str, left: Value, right: Value) -> Value:
        a, b = left.value, right.value
        if op == "+" and isinstance(a, str):
            return Value('"', a + (b if isinstance(b, str) else str(b)))
        if isinstance(a, bool) or isinstance(b, bool) or not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            raise MacroUnresolved(f"{op} does not apply to these values")
        if op in "/%" and b == 0:
            raise MacroUnresolved("division by zero")
        whole = isinstance(a, int) and isinstance(b, int)
        if op in "/%" and whole:  # toward zero, as in machine arithmetic
            quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            result = quotient if op == "/" else a - quotient * b
        else:
            result = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()
        return Value("@" if "@" in (left.sigil, right.sigil) else "=", in_range(result)) if whole else Value("~", float(result))


def parse(text: str, clock: Callable[[], int] = time.time_ns) -> Source:
    pragmas = {m[1]: m[2] for m in PRAGMA.finditer(text)}
    parser = Parser(PRAGMA.sub("", text), clock)
    out: list[tuple[str, Value]] = []
    # the outermost level ends with the text
    parser.text += "\x00"
    out = parser.entries(0, "\x00")
    return Source(out, pragmas)


def plain(value: Value) -> object:
    """A value as Python data; keys that repeat in a block are collected into a list."""
    if value.sigil != "{":
        return value.value
    out: dict[str, object] = {}
    many: set[str] = set()
    for key, inner in value.value:
        got = plain(inner)
        if key in many:
            out[key].append(got)
        elif key in out:
            out[key] = [out[key], got]
            many.add(key)
        else:
            out[key] = got
    return out


def spark_type(values: list[Value]) -> T.DataType:
    """The Spark type of the values of one field in several records."""
    blocks = [v for v in values if v.sigil == "{"]
    if blocks:
        return struct_type([b.value for b in blocks])
    lists = [v for v in values if v.sigil == "["]
    if lists:
        items = next((v.item for v in lists if v.item != "^"), '"')
        return T.ArrayType(struct_type([i for v in lists for i in v.value]) if items == "{" else TYPES[items])
    kinds = list(dict.fromkeys(v.sigil for v in values if v.sigil != "^"))
    return TYPES[kinds[0]] if kinds else T.StringType()


def struct_type(blocks: list[list[tuple[str, Value]]]) -> T.StructType:
    """The union of fields, in the order first seen; one that repeats within a block is an array."""
    fields: dict[str, list[Value]] = {}
    repeated: set[str] = set()
    for block in blocks:
        names = [k for k, _ in block]
        repeated |= {k for k in names if names.count(k) > 1}
        for key, value in block:
            fields.setdefault(key, []).append(value)
    return T.StructType([T.StructField(k, T.ArrayType(spark_type(v)) if k in repeated else spark_type(v)) for k, v in fields.items()])


def fitted(value: object, kind: T.DataType) -> object:
    """Plain data in the shape of a type: missing fields are None, single values of repeated fields lists."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        value = dict(value) if isinstance(value, dict) else plain(Value("{", value))
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    return value


def records(source: Source) -> tuple[list[dict], T.StructType]:
    """Rows and schema: each top-level block is a row; without blocks, all entries are one row."""
    blocks = [v.value for _, v in source.entries if v.sigil == "{"]
    blocks = blocks or ([source.entries] if source.entries else [])
    schema = struct_type(blocks)
    rows = []
    for block in blocks:
        row = fitted(plain(Value("{", block)), schema)
        row["_null_fields"] = [k for k, v in block if v.sigil == "^"]
        rows.append(row)
    return rows, schema


def read_text_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of all source files at path, with _record_index in each file, _null_fields and _file.

    With a schema, files are parsed where they are read; without one, files are parsed on the driver
    once to find it, so give a schema for large sets.
    """
    files = spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_path AS file")
    if schema is None:
        schema = struct_type([b for row in files.toLocalIterator() for b in _blocks(row.value)])
    full = T.StructType([*schema.fields, T.StructField("_null_fields", T.ArrayType(T.StringType())), T.StructField("_record_index", T.LongType()), T.StructField("_file", T.StringType())])
    kind = schema

    def run(rows: Iterator) -> Iterator[tuple]:
        for row in rows:
            for i, block in enumerate(_blocks(row.value)):
                data = fitted(plain(Value("{", block)), kind)
                yield (*(data[f.name] for f in kind), [k for k, v in block if v.sigil == "^"], i, row.file)

    # text files are small and hand-edited; a row-wise parser needs no vectors
    return spark.createDataFrame(files.rdd.mapPartitions(run), full)


def _blocks(text: str) -> list[list[tuple[str, Value]]]:
    source = parse(text)
    blocks = [v.value for _, v in source.entries if v.sigil == "{"]
    return blocks or ([source.entries] if source.entries else [])
