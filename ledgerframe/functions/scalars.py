"""Scalar functions on columns: time literals, ids, classes of text, coercion, cleanup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text classes, in order of priority.
INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BOOL = r"^(?i:true|false)$"
TIME = r"^[0-9TZ:.+-]{8,}$"
HEX = r"^([0-9a-fA-F]{2}){8,}$"
# What every text of a class other than string consists of.
ANY = r"^(?:[0-9a-fA-FTZ:.+-]+|(?i:true|false))$"
CLASSES = ("int", "float", "bool", "time", "hex", "string")
ISO_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.]([0-9]{1,9}))?)?$"


def is_int(text: Column) -> Column:
    """Whether text is an integer that fits 64 bits."""
    digits = F.ltrim(F.regexp_replace(text, "^[+-]", ""), F.lit("0"))
    fits = (F.length(digits) < 19) | ((F.length(digits) == 19) & ((digits <= "9223372036854775807") | (text.startswith("-") & (digits == "9223372036854775808"))))
    return text.rlike(INT) & fits


def class_code(text: Column) -> Column:
    """The number in CLASSES of the first class whose pattern text fits; NULL for NULL and for empty text.

    One pattern settles text that is none of the others, and one settles integers.
    """
    time_like = text.rlike(TIME) & (text.contains("-") | text.contains("T"))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("int"))
        .when(~text.rlike(ANY), F.lit(5)).when(is_int(text), F.lit(0)).when(text.rlike(FLOAT), F.lit(1)).when(text.rlike(BOOL), F.lit(2)).when(time_like, F.lit(3)).when(text.rlike(HEX), F.lit(4)).otherwise(F.lit(5))
    )


def text_class(text: Column) -> Column:
    """The first class whose pattern text fits; NULL for NULL and for empty text."""
    return F.get(F.array(*map(F.lit, CLASSES)), class_code(text))


def time_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of YYYY-MM-DD[THH:MM:SS[.fraction]] or of a plain integer; NULL for other text."""
    day, clock, fraction = (F.regexp_extract(text, ISO_TIME, i) for i in (1, 2, 3))
    stamp = F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").otherwise(clock), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    whole = F.unix_seconds(stamp) * 1_000_000_000 + F.rpad(F.concat(F.lit("0"), fraction), 10, "0").cast("long")
    return F.when(is_int(text), text.try_cast("long")).when(text.rlike(ISO_TIME), whole)


def timestamp_ns(stamp: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp (UTC)."""
    return F.unix_micros(stamp.cast("timestamp")) * 1000


def timestamp_of(ns: Column) -> Column:
    """The timestamp, to the microsecond, of nanoseconds since 1970."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(38,0)")).cast("long"))


def epoch_days(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long")


def hex_id(value: Column) -> Column:
    """16 hex digits of a 64-bit id."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def trace_hex(high: Column, low: Column) -> Column:
    """32 hex digits of a 128-bit id kept as two 64-bit halves."""
    return F.concat(hex_id(high), hex_id(low))


def hex_long(text: Column) -> Column:
    """The 64-bit pattern of up to 16 hex digits, as a signed number; NULL for other text."""
    padded = F.lpad(F.regexp_replace(text, "^0[xX]", ""), 16, "0")
    high, low = (F.conv(F.substring(padded, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.when(F.regexp_replace(text, "^0[xX]", "").rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def trace_halves(text: Column) -> tuple[Column, Column]:
    """High and low halves of a trace id of 32 hex digits, with or without 0x."""
    clean = F.regexp_replace(text, "^0[xX]", "")
    ok = clean.rlike("^[0-9a-fA-F]{32}$")
    return tuple(F.when(ok, hex_long(F.substring(clean, i, 16))) for i in (1, 17))


def hex_bytes(text: Column) -> Column:
    """Bytes of an even number of hex digits; NULL for other text."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def bytes_text(value: Column, policy: str = "base64") -> Column:
    """Binary as base64 or hex text; NULL under policy skip."""
    return {"base64": F.base64(value), "hex": F.lower(F.hex(value)), "skip": F.lit(None).cast("string")}[policy]


def coerce(text: Column, kind: str) -> Column:
    """Text as a value of the kind; what doesn't parse, and empty text, is absent."""
    text = F.when(text != "", text)
    if kind == "int":
        return F.when(is_int(text), text.try_cast("long"))
    if kind == "float":
        return F.when(text.rlike(FLOAT), text.try_cast("double"))
    if kind == "bool":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return {"time": time_ns, "hex": hex_bytes}.get(kind, lambda c: c)(text)


def numeric_cell(text: Column) -> Column:
    """The number in a spreadsheet cell such as $1,200 or 5%; NULL if there is none."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[$]|[%]$", ""), ",", "")
    return F.when(clean.rlike(FLOAT), clean.try_cast("double"))


def contains_fold(text: Column, needle: str) -> Column:
    """Whether text holds the trimmed needle, whatever the case of letters."""
    return F.contains(F.lower(text), F.lower(F.lit(needle.strip())))


def align8(size: Column) -> Column:
    """size rounded up to a multiple of eight."""
    return (size + 7 - F.pmod(size + 7, F.lit(8))).cast("long")


def bitmap_bytes(rows: Column) -> Column:
    """Bytes of a presence bitmap of so many rows, padded to eight."""
    return align8(F.floor((rows + 7) / 8).cast("long"))


def human_bytes(size: Column) -> Column:
    return (
        F.when(size < 1024, F.format_string("%d B", size)).when(size < 1 << 20, F.format_string("%.1f KiB", size / 1024))
        .when(size < 1 << 30, F.format_string("%.1f MiB", size / (1 << 20))).otherwise(F.format_string("%.1f GiB", size / (1 << 30)))
    )


def unique_names(names: list[str]) -> list[str]:
    """Names as identifiers (letters, digits, underscores), repeats with a suffix _2, _3..."""
    out: list[str] = []
    for raw in names:
        base = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in raw.strip()) or "field"
        base = f"_{base}" if base[0].isdigit() else base
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out
