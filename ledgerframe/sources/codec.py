"""Bytes of binary record files: row, compact row, columnar and paged layouts, and the span log.

A file is a 32-byte preamble, a schema, a data sector, a tail index and a footer; integers are
little-endian.  Rows are dicts: a missing key is absent, None is an explicit null.  Every read is
checked against the bounds, so damaged bytes raise a RecordError and nothing else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ledgerframe.errors import BadMagic, DictMismatch, IncompatibleFlags, InvalidPageMagic, OutOfBounds, RecordError, UnsupportedField, UnsupportedLayout

# Magic bytes, flags and sizes of the format.
FILE, OBJECT, LIST, PAGE, FOOTER, LOG = b"BXYN", b"OXYN", b"LXYN", b"PSXN", b"NXS!", b"NXSW"
COLUMNAR, EMBEDDED, PAGED, PAGE_CRC = 0x1, 0x2, 0x4, 0x8
DENSE, PACKED_BOOLS, NARROW, DELTA_TAIL, REORDER = 0x10, 0x20, 0x40, 0x80, 0x100
COMPACT = DENSE | PACKED_BOOLS | NARROW | DELTA_TAIL | REORDER
VERSION, COMPACT_VERSION = 0x0101, 0x0103
PREAMBLE = 32
DELTA_BLOCK = 1024
PAGE_ROWS = 4096
MAX_LOG_RECORD = 10 << 20
PROMOTED, SHORT_LENGTH = 0x1, 0x2
HASH_SEED, HASH_A, HASH_B = 0x93681D6255313A99, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
VARIABLE, FIXED = '"<', "=~?@"
FORMATS = {"=": "<q", "~": "<d", "@": "<q"}
WIDTHS = {("=", 1): "<B", ("=", 2): "<h", ("=", 4): "<i", ("~", 4): "<f"}


@dataclass
class Field:
    name: str
    sigil: str
    width: int = 8
    attributes: int = 0


@dataclass
class Header:
    """What stands before the data sector, and where that begins."""

    fields: list[Field]
    flags: int = EMBEDDED
    tail: int = 0
    start: int = 0
    pool: list[str] = field(default_factory=list)

    @property
    def layout(self) -> str:
        return "columnar" if self.flags & COLUMNAR else "paged" if self.flags & PAGED else "compact" if self.flags & COMPACT else "row"


def cut(data: bytes, at: int, size: int) -> bytes:
    """size bytes at a place, all of which must be there."""
    if at < 0 or size < 0 or at + size > len(data):
        raise OutOfBounds(f"bytes {at} to {at + size} of {len(data)}")
    return data[at : at + size]


def take(data: bytes, kind: str, at: int) -> tuple:
    size = struct.calcsize(kind)
    if at < 0 or at + size > len(data):
        raise OutOfBounds(f"bytes {at} to {at + size} of {len(data)}")
    return struct.unpack_from(kind, data, at)


def pad8(size: int) -> int:
    return -size % 8


def names(data: bytes, at: int, count: int) -> tuple[list[str], int]:
    """count strings that each end with a zero byte, and where they end."""
    out = []
    for _ in range(count):
        end = data.find(b"\0", at)
        if end < 0:
            raise OutOfBounds("a name does not end")
        try:
            out.append(data[at:end].decode())
        except UnicodeDecodeError as e:
            raise RecordError("a name is not UTF-8") from e
        at = end + 1
    return out, at


def fingerprint(schema: bytes) -> int:
    """The 64-bit hash of schema bytes that the preamble carries."""
    mask = (1 << 64) - 1
    state = HASH_SEED
    for (word,) in struct.iter_unpack("<Q", schema + bytes(pad8(len(schema)))):
        word = word * HASH_A & mask
        state = (state ^ word ^ word >> 33) * HASH_B & mask
        state ^= state >> 33
    state ^= len(schema)
    state = (state ^ state >> 33) * HASH_A & mask
    return state ^ state >> 33


def encode_schema(fields: Sequence[Field], flags: int, pool: Sequence[str] = ()) -> bytes:
    out = struct.pack("<H", len(fields)) + "".join(f.sigil for f in fields).encode()
    out += b"".join(f.name.encode() + b"\0" for f in fields)
    out += bytes(pad8(len(out)))
    if flags & COMPACT:
        if flags & NARROW:
            out += bytes(f.width for f in fields)
        out += bytes(f.attributes for f in fields) + struct.pack("<H", len(pool))
        if pool:
            out += b"".join(v.encode() + b"\0" for v in pool)
            out += bytes(pad8(len(out)))
    return out


def preamble(flags: int, schema: bytes, tail: int) -> bytes:
    return FILE + struct.pack("<HHQQQ", COMPACT_VERSION if flags & COMPACT else VERSION, flags, fingerprint(schema), tail, 0)


def decode_header(data: bytes, verify: bool = True) -> Header:
    if cut(data, 0, 4) != FILE:
        raise BadMagic("not a record file")
    _, flags, key, tail, _ = take(data, "<HHQQQ", 4)
    if flags & COLUMNAR and flags & PAGED or flags & COMPACT and flags & (COLUMNAR | PAGED):
        raise IncompatibleFlags(f"flags {flags:#x}")
    if not flags & EMBEDDED:
        raise IncompatibleFlags("the schema is not in the file")
    (count,) = take(data, "<H", PREAMBLE)
    sigils = cut(data, PREAMBLE + 2, count).decode("latin-1")
    found, at = names(data, PREAMBLE + 2 + count, count)
    at += pad8(at)
    cut(data, PREAMBLE, at - PREAMBLE)
    fields, pool = [Field(n, s) for n, s in zip(found, sigils, strict=True)], []
    if flags & COMPACT:
        if flags & NARROW:
            for f, width in zip(fields, cut(data, at, count), strict=True):
                f.width = width or 8
            at += count
        for f, bits in zip(fields, cut(data, at, count), strict=True):
            f.attributes = bits
        at += count
        (values,) = take(data, "<H", at)
        pool, at = names(data, at + 2, values)
        at += pad8(at) if values else 0
    if verify and fingerprint(data[PREAMBLE:at]) != key:
        raise DictMismatch("the schema's hash differs")
    return Header(fields, flags, tail, at, pool)


# --- cells and records -----------------------------------------------------------------------------


def encode_cell(sigil: str, value: object) -> bytes:
    """A cell of a plain record; its length is a multiple of eight, none for null."""
    if value is None:
        return b""
    if isinstance(value, list):
        item = "~" if any(isinstance(v, float) for v in value) else "="
        body = b"".join(struct.pack(FORMATS[item], v) for v in value)
        return LIST + struct.pack("<IcI3x", 16 + len(body), item.encode(), len(value)) + body
    if sigil in FORMATS:
        return struct.pack(FORMATS[sigil], value)
    if sigil == "?":
        return struct.pack("<B7x", bool(value))
    if sigil in VARIABLE:
        raw = value.encode() if isinstance(value, str) else bytes(value)
        out = struct.pack("<I", len(raw)) + raw
        return out + bytes(pad8(len(out)))
    raise UnsupportedField(f"no cells for type {sigil!r}")


def decode_cell(data: bytes, at: int, sigil: str, end: int) -> object:
    if at == end:
        return None
    if sigil == "L" or end - at > 8 and sigil not in VARIABLE and data[at : at + 4] == LIST:
        return decode_list(data, at)
    if sigil in FORMATS:
        return take(data, FORMATS[sigil], at)[0]
    if sigil == "?":
        return cut(data, at, 1) != b"\0"
    if sigil in VARIABLE:
        (size,) = take(data, "<I", at)
        return text_or_bytes(sigil, cut(data, at + 4, size))
    if sigil == "^":
        return None
    raise UnsupportedField(f"no cells for type {sigil!r}")


def text_or_bytes(sigil: str, raw: bytes) -> str | bytes:
    if sigil == "<":
        return raw
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise RecordError("text is not UTF-8") from e


def decode_list(data: bytes, at: int) -> list:
    if cut(data, at, 4) != LIST:
        raise BadMagic("not a list")
    size, item, count = take(data, "<IcI", at + 4)
    kind = FORMATS.get(item.decode("latin-1"))
    if kind is None or 16 + 8 * count > size:
        raise UnsupportedField("lists hold integers or floats")
    return [x for (x,) in struct.iter_unpack(kind, cut(data, at + 16, 8 * count))]


def encode_mask(present: Sequence[bool]) -> bytes:
    """Presence bits, seven to a byte, the high bit saying that more follow."""
    return mask_bytes(tuple(present))


@lru_cache(4096)
def mask_bytes(present: tuple[bool, ...]) -> bytes:
    groups = [present[i : i + 7] for i in range(0, len(present), 7)] or [()]
    return bytes(sum(1 << k for k, bit in enumerate(g) if bit) | (0x80 if i + 1 < len(groups) else 0) for i, g in enumerate(groups))


def decode_mask(data: bytes, at: int) -> tuple[Sequence[bool], int]:
    end = at
    while True:
        byte = cut(data, end, 1)[0]
        end += 1
        if not byte & 0x80:
            return mask_bits(bytes(data[at:end])), end
        if 7 * (end - at) > 512:
            raise OutOfBounds("too many fields")


@lru_cache(4096)
def mask_bits(mask: bytes) -> tuple[bool, ...]:
    return tuple(bool(byte >> k & 1) for byte in mask for k in range(7))


def encode_record(fields: Sequence[Field], row: dict) -> bytes:
    cells = [encode_cell(f.sigil, row[f.name]) for f in fields if f.name in row]
    mask = encode_mask([f.name in row for f in fields])
    at = 8 + len(mask) + 2 * len(cells)
    gap = pad8(at)
    at += gap
    table = []
    for cell in cells:
        table.append(at)
        at += len(cell)
    if at > 0xFFFF:
        raise RecordError("a record of this layout holds 64 KiB at most")
    return OBJECT + struct.pack("<I", at) + mask + struct.pack(f"<{len(table)}H", *table) + bytes(gap) + b"".join(cells)


def decode_record(fields: Sequence[Field], data: bytes, start: int) -> dict:
    if cut(data, start, 4) != OBJECT:
        raise BadMagic("not a record")
    (length,) = take(data, "<I", start + 4)
    mask, at = decode_mask(data, start + 8)
    there = [f for f, bit in zip(fields, mask, strict=False) if bit]
    table = [*take(data, f"<{len(there)}H", at), length]
    return {f.name: decode_cell(data, start + a, f.sigil, start + b) for f, a, b in zip(there, table, table[1:], strict=False)}


# --- compact records -------------------------------------------------------------------------------


def narrowed(fields: Sequence[Field], rows: Sequence[dict], promote_ratio: float = 0.5, promote_rows: int = 32) -> tuple[list[Field], list[str]]:
    """Fields with the least widths that hold all values, and the pool of promoted texts."""
    out, pool = [], {}
    for f in fields:
        values = [r[f.name] for r in rows if r.get(f.name) is not None]
        width, bits = 8, 0
        if f.sigil == "=" and values:
            low, high = min(values), max(values)
            width = 1 if low >= 0 and high < 1 << 8 else next((w for w in (2, 4) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1), 8)
        if f.sigil == '"' and len(values) >= promote_rows and len(set(values)) <= promote_ratio * len(values) and len(pool) + len(set(values)) <= 0xFFFF and not any("\0" in v for v in values):
            bits = PROMOTED
            for v in values:
                pool.setdefault(v, len(pool))
        elif f.sigil in VARIABLE and max((len(v.encode() if isinstance(v, str) else v) for v in values), default=0) < 1 << 16:
            bits = SHORT_LENGTH
        out.append(Field(f.name, f.sigil, width, bits))
    return out, list(pool)


class CompactRecords:
    """Cells of compact records, by the schema's widths and attributes."""

    def __init__(self, header: Header):
        self.fields, self.flags = header.fields, header.flags
        self.pool, self.codes = header.pool, {v: i for i, v in enumerate(header.pool)}
        self.bools = [f.name for f in self.fields if f.sigil == "?"] if self.flags & PACKED_BOOLS else []
        self.word = -(-len(self.bools) // 8)
        units = []  # what has a cell of its own: fields, and one word for all packed bools
        for f in self.fields:
            if f.sigil == "?" and self.bools:
                if f.name != self.bools[0]:
                    continue
                units.append((None, self.word))
            else:
                units.append((f, self.size(f)))
        self.units = units
        self.dense = sorted(units, key=lambda u: -(u[1] or 0)) if self.flags & REORDER else units
        if self.flags & REORDER:
            fixed = [u for u in units if u[1]]
            self.dense = sorted(fixed, key=lambda u: -u[1]) + [u for u in units if not u[1]]

    def size(self, f: Field) -> int:
        """Bytes of a fixed cell; 0 for inline text and binary."""
        if f.sigil in VARIABLE:
            return 2 if f.attributes & PROMOTED else 0
        return 1 if f.sigil == "?" else f.width if f.sigil in "=~" else 8

    def encode(self, f: Field | None, row: dict) -> bytes:
        if f is None:
            bits = sum(1 << i for i, n in enumerate(self.bools) if row.get(n))
            return bits.to_bytes(self.word, "little")
        value = row[f.name]
        if f.sigil in VARIABLE:
            if f.attributes & PROMOTED:
                return struct.pack("<H", self.codes[value])
            raw = value.encode() if isinstance(value, str) else bytes(value)
            out = struct.pack("<H" if f.attributes & SHORT_LENGTH else "<I", len(raw)) + raw
            return out + bytes(pad8(len(out)))
        if f.sigil == "?":
            return bytes([bool(value)])
        return struct.pack(WIDTHS.get((f.sigil, f.width)) or FORMATS[f.sigil], value)

    def decode(self, data: bytes, at: int, f: Field | None, row: dict) -> int:
        """Read a cell into row; where it ends."""
        if f is None:
            bits = int.from_bytes(cut(data, at, self.word), "little")
            row.update({n: bool(bits >> i & 1) for i, n in enumerate(self.bools) if n in row})
            return at + self.word
        if f.sigil in VARIABLE:
            if f.attributes & PROMOTED:
                (code,) = take(data, "<H", at)
                if code >= len(self.pool):
                    raise OutOfBounds("no such value in the pool")
                row[f.name] = self.pool[code]
                return at + 2
            kind = "<H" if f.attributes & SHORT_LENGTH else "<I"
            (size,) = take(data, kind, at)
            used = struct.calcsize(kind) + size
            row[f.name] = text_or_bytes(f.sigil, cut(data, at + used - size, size))
            return at + used + pad8(used)
        if f.sigil == "?":
            row[f.name] = cut(data, at, 1) != b"\0"
            return at + 1
        kind = WIDTHS.get((f.sigil, f.width)) or FORMATS.get(f.sigil)
        if kind is None:
            raise UnsupportedField(f"no cells for type {f.sigil!r}")
        (row[f.name],) = take(data, kind, at)
        return at + struct.calcsize(kind)

    @staticmethod
    def aligned(at: int, unit: int) -> int:
        return at + -at % unit if unit else at

    def encode_record(self, row: dict) -> bytes:
        if self.flags & DENSE and all(row.get(f.name) is not None for f in self.fields):
            body = b""
            for f, size in self.dense:
                body += bytes(self.aligned(len(body), size if f is None and size in (1, 2, 4, 8) else size if f else 1) - len(body)) + self.encode(f, row)
            return OBJECT + struct.pack("<IB", 9 + len(body), 1) + body
        there = [(f, s) for f, s in self.units if (any(n in row for n in self.bools) if f is None else f.name in row)]
        mask = encode_mask([f.name in row for f in self.fields])
        at = 9 + len(mask) + 2 * len(there)
        table, body = [], b""
        for f, _ in there:
            cell = b"" if f is not None and row[f.name] is None else self.encode(f, row)
            table.append(at + len(body))
            body += cell
        return OBJECT + struct.pack("<IB", at + len(body), 0) + mask + struct.pack(f"<{len(table)}H", *table) + body

    def decode_record(self, data: bytes, start: int) -> dict:
        if cut(data, start, 4) != OBJECT:
            raise BadMagic("not a record")
        length, kind = take(data, "<IB", start + 4)
        if kind & 1:
            row = dict.fromkeys(f.name for f in self.fields)
            base, at = start + 9, 0
            for f, size in self.dense:
                at = self.aligned(at, size if f is None and size in (1, 2, 4, 8) else size if f else 1)
                at = self.decode(data, base + at, f, row) - base
            return row
        mask, at = decode_mask(data, start + 9)
        row = {f.name: None for f, bit in zip(self.fields, mask, strict=False) if bit}
        there = [f for f, _ in self.units if (any(n in row for n in self.bools) if f is None else f.name in row)]
        table = [*take(data, f"<{len(there)}H", at), length]
        for f, a, b in zip(there, table, table[1:], strict=False):
            if a != b:
                self.decode(data, start + a, f, row)
        return row


# --- columns ---------------------------------------------------------------------------------------


def encode_column(f: Field, rows: Sequence[dict]) -> bytes:
    if f.sigil not in FIXED + VARIABLE:
        raise UnsupportedField(f"no columns of type {f.sigil!r}")
    values = [r.get(f.name) for r in rows]
    bits = np.packbits(np.array([v is not None for v in values], bool), bitorder="little").tobytes()
    out = bits + bytes(pad8(len(bits)))
    if f.sigil in VARIABLE:
        raw = [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]
        ends = np.cumsum([0, *map(len, raw)]).astype("<u4")
        out += ends.tobytes() + b"".join(raw)
        return out + bytes(pad8(len(out)))
    return out + np.array([0 if v is None else v for v in values], "<f8" if f.sigil == "~" else "<i8").tobytes()


def decode_column(data: bytes, at: int, f: Field, n: int) -> tuple[np.ndarray, object, int]:
    """(presence, values, where it ends): values is an array, or offsets and bytes of text and binary."""
    size = -(-n // 8)
    present = np.unpackbits(np.frombuffer(cut(data, at, size), np.uint8), bitorder="little")[:n].astype(bool)
    at += size + pad8(size)
    if f.sigil in VARIABLE:
        ends = np.frombuffer(cut(data, at, 4 * (n + 1)), "<u4")
        if (np.diff(ends.astype(np.int64)) < 0).any():
            raise OutOfBounds("offsets descend")
        at += 4 * (n + 1)
        body = cut(data, at, int(ends[-1]))
        used = size + pad8(size) + 4 * (n + 1) + len(body)
        return present, (ends, body), at + len(body) + pad8(used)
    if f.sigil not in FIXED:
        raise UnsupportedField(f"no columns of type {f.sigil!r}")
    values = np.frombuffer(cut(data, at, 8 * n), "<f8" if f.sigil == "~" else "<i8")
    return present, values, at + 8 * n


def column_rows(f: Field, present: np.ndarray, values: object) -> list:
    if f.sigil in VARIABLE:
        ends, body = values
        cells = [text_or_bytes(f.sigil, body[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    else:
        cells = (values != 0).tolist() if f.sigil == "?" else values.tolist()
    return [c if p else None for c, p in zip(cells, present.tolist(), strict=True)]


def column_array(f: Field, present: np.ndarray, values: object) -> object:
    """The column as an Arrow array, its values taken over as they are."""
    import pyarrow as pa

    absent = np.packbits(present, bitorder="little").tobytes()
    if f.sigil in VARIABLE:
        ends, body = values
        return pa.Array.from_buffers(pa.string() if f.sigil == '"' else pa.binary(), len(present), [pa.py_buffer(absent), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
    return pa.array(values != 0 if f.sigil == "?" else values, mask=~present)


def encode_page(fields: Sequence[Field], rows: Sequence[dict], number: int, first: int, crc: bool = False) -> bytes:
    out = PAGE + struct.pack("<IQIHH", number, first, len(rows), len(fields), 0) + b"".join(encode_column(f, rows) for f in fields)
    out += struct.pack("<I", len(out) + 4)
    if crc:
        out += struct.pack("<I", zlib.crc32(out))
    return out + bytes(pad8(len(out)))


def decode_page(fields: Sequence[Field], data: bytes, at: int) -> tuple[int, int, list, int]:
    """(number, first record, columns, where the next page may begin)."""
    if cut(data, at, 4) != PAGE:
        raise InvalidPageMagic(f"no page at byte {at}")
    number, first, n, count, _ = take(data, "<IQIHH", at + 4)
    if count != len(fields):
        raise DictMismatch("the page has other fields")
    start, columns = at, []
    at += 24
    for f in fields:
        present, values, at = decode_column(data, at, f, n)
        columns.append((present, values))
    (length,) = take(data, "<I", at)
    if length != at + 4 - start:
        raise OutOfBounds("the page's length differs")
    return number, first, columns, start + length + pad8(length)


# --- files -----------------------------------------------------------------------------------------


def write_file(fields: Sequence[Field], rows: Sequence[dict], layout: str = "row", page_rows: int = PAGE_ROWS) -> bytes:
    """A sealed file."""
    if layout == "compact":
        return _write_compact(fields, rows)
    flags = EMBEDDED | {"row": 0, "columnar": COLUMNAR, "paged": PAGED}[layout]
    schema = encode_schema(fields, flags)
    start = PREAMBLE + len(schema)
    parts, at = [], start
    if layout == "row":
        offsets = []
        for row in rows:
            offsets.append(at)
            parts.append(encode_record(fields, row))
            at += len(parts[-1]) + pad8(len(parts[-1]))
            parts[-1] += bytes(pad8(len(parts[-1])))
        tail = struct.pack("<I", len(rows)) + b"".join(struct.pack("<HQ", 0, o) for o in offsets)
        end = struct.pack("<Q", at) + FOOTER
    elif layout == "columnar":
        entries = []
        for i, f in enumerate(fields):
            parts.append(encode_column(f, rows))
            entries.append(struct.pack("<HHQQ", i, 0, at, len(parts[-1])))
            at += len(parts[-1])
        tail, end = b"".join(entries), struct.pack("<QQ", at, len(rows)) + FOOTER
    else:
        entries = []
        for number, first in enumerate(range(0, len(rows), page_rows)):
            chunk = rows[first : first + page_rows]
            parts.append(encode_page(fields, chunk, number, first))
            entries.append(struct.pack("<IQIQI", number, first, len(chunk), at, len(parts[-1])))
            at += len(parts[-1])
        tail, end = b"".join(entries), struct.pack("<QQII", at, len(rows), len(entries), page_rows) + FOOTER
    return preamble(flags, schema, at) + schema + b"".join(parts) + tail + end


def _write_compact(fields: Sequence[Field], rows: Sequence[dict]) -> bytes:
    flags = EMBEDDED | COMPACT
    chosen, pool = narrowed(fields, rows)
    schema = encode_schema(chosen, flags, pool)
    records = CompactRecords(Header(chosen, flags, pool=pool))
    at, offsets, parts = PREAMBLE + len(schema), [], []
    for row in rows:
        offsets.append(at)
        parts.append(records.encode_record(row))
        at += len(parts[-1])
    anchors = offsets[::DELTA_BLOCK]
    tail = struct.pack("<IIHH", len(rows), DELTA_BLOCK, 1, len(anchors)) + bytes(4)
    tail += struct.pack(f"<{len(anchors)}Q", *anchors) + struct.pack(f"<{len(rows)}I", *(o - anchors[i // DELTA_BLOCK] for i, o in enumerate(offsets)))
    return preamble(flags, schema, at) + schema + b"".join(parts) + tail + struct.pack("<Q", at) + FOOTER


class RecordFile:
    """A sealed file, opened for reading by record or by column."""

    def __init__(self, data: bytes, verify: bool = True):
        self.data = data
        self.header = h = decode_header(data, verify)
        self.fields, self.layout = h.fields, h.layout
        if data[-4:] != FOOTER:
            raise BadMagic("the file is not sealed")
        if self.layout == "columnar":
            if not h.tail:
                raise UnsupportedLayout("columnar files cannot be streamed")
            tail, self.count = take(data, "<QQ", len(data) - 20)
            entries = [take(data, "<HHQQ", tail + 20 * i) for i in range(len(self.fields))]
            self.columns = {i: (at, size) for i, _, at, size in entries}
        elif self.layout == "paged":
            tail, self.count, pages, self.page_rows = take(data, "<QQII", len(data) - 28)
            cut(data, tail, 28 * pages)
            self.pages = [take(data, "<IQIQI", tail + 28 * i) for i in range(pages)]
        else:
            (footer,) = take(data, "<Q", len(data) - 12)
            tail = h.tail or footer
            self.compact = CompactRecords(h) if self.layout == "compact" else None
            if h.flags & DELTA_TAIL:
                self.count, block, _, anchors = take(data, "<IIHH", tail)
                if not block and self.count:
                    raise OutOfBounds("blocks of no records")
                base = np.frombuffer(cut(data, tail + 16, 8 * anchors), "<u8").astype(np.int64)
                deltas = np.frombuffer(cut(data, tail + 16 + 8 * anchors, 4 * self.count), "<u4").astype(np.int64)
                which = np.arange(self.count) // max(block, 1)
                if self.count and which[-1] >= anchors:
                    raise OutOfBounds("blocks are missing")
                self.offsets = base[which] + deltas if self.count else deltas
            else:
                (self.count,) = take(data, "<I", tail)
                raw = np.frombuffer(cut(data, tail + 4, 10 * self.count), np.uint8).reshape(-1, 10)
                self.offsets = np.ascontiguousarray(raw[:, 2:]).view("<u8").reshape(-1).astype(np.int64)

    def record(self, i: int) -> dict:
        """Record i, absent fields left out."""
        if not 0 <= i < self.count:
            raise OutOfBounds(f"no record {i}")
        if self.layout in ("row", "compact"):
            at = int(self.offsets[i])
            return self.compact.decode_record(self.data, at) if self.compact else decode_record(self.fields, self.data, at)
        if self.layout == "paged":
            page = next(k for k, p in enumerate(self.pages) if p[1] <= i < p[1] + p[2])
            columns, i = self.page(page), i - self.pages[page][1]
        else:
            columns = [self.column(k) for k in range(len(self.fields))]
        return {f.name: column_rows(f, p, v)[i] for f, (p, v) in zip(self.fields, columns, strict=True) if p[i]}

    def column(self, slot: int) -> tuple[np.ndarray, object]:
        if self.layout != "columnar":
            raise UnsupportedLayout("columns are stored apart in columnar files only")
        if slot not in self.columns:
            raise OutOfBounds("the column is missing")
        present, values, _ = decode_column(self.data, self.columns[slot][0], self.fields[slot], self.count)
        return present, values

    def page(self, number: int) -> list:
        return decode_page(self.fields, self.data, self.pages[number][3])[2]

    def batches(self) -> Iterator[tuple[int, list]]:
        """(first record, columns) of each page, or of the whole columnar file."""
        if self.layout == "columnar":
            yield 0, [self.column(k) for k in range(len(self.fields))]
        else:
            for k, p in enumerate(self.pages):
                yield p[1], self.page(k)

    def records(self) -> Iterator[dict]:
        if self.layout in ("row", "compact"):
            yield from (self.record(i) for i in range(self.count))
        else:
            for _, columns in self.batches():
                lists = [(f.name, column_rows(f, *c), c[0]) for f, c in zip(self.fields, columns, strict=True)]
                for i in range(len(lists[0][1]) if lists else 0):
                    yield {n: values[i] for n, values, present in lists if present[i]}


def unsealed_records(data: bytes, at: int | None = None) -> tuple[list[dict], int]:
    """Complete records of a growing row file from byte `at` (or the first), and where the next one begins."""
    h = decode_header(data)
    if h.layout not in ("row", "compact"):
        raise UnsupportedLayout("only row files grow by records")
    compact, at, out = CompactRecords(h) if h.layout == "compact" else None, at or h.start, []
    while at + 8 <= len(data) and data[at : at + 4] == OBJECT:
        (length,) = take(data, "<I", at + 4)
        if length < 8 or at + length > len(data):
            break
        out.append(compact.decode_record(data, at) if compact else decode_record(h.fields, data, at))
        at += length if compact else length + pad8(length)
    return out, at


def unsealed_pages(data: bytes, at: int | None = None) -> tuple[list[dict], int]:
    """Records of the complete pages of a growing paged file from byte `at`, and where the next page begins."""
    h = decode_header(data)
    if h.layout != "paged":
        raise UnsupportedLayout("only paged files grow by pages")
    at, out = at or h.start, []
    while at + 24 <= len(data) and data[at : at + 4] == PAGE:
        try:
            _, _, columns, end = decode_page(h.fields, data, at)
        except OutOfBounds:
            break  # the page is not complete yet
        lists = [(f.name, column_rows(f, *c), c[0]) for f, c in zip(h.fields, columns, strict=True)]
        out += [{n: v[i] for n, v, p in lists if p[i]} for i in range(len(lists[0][1]) if lists else 0)]
        at = end
    return out, at


class PageWriter:
    """Builds a paged file page by page; until seal() it is a growing file that has no tail."""

    def __init__(self, fields: Sequence[Field], page_rows: int = PAGE_ROWS):
        self.fields, self.page_rows, self.pending, self.entries, self.count = fields, page_rows, [], [], 0
        self.schema = encode_schema(fields, EMBEDDED | PAGED)
        self.data = bytearray(preamble(EMBEDDED | PAGED, self.schema, 0) + self.schema)

    def push(self, row: dict) -> None:
        self.pending.append(row)
        if len(self.pending) >= self.page_rows:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            page = encode_page(self.fields, self.pending, len(self.entries), self.count)
            self.entries.append(struct.pack("<IQIQI", len(self.entries), self.count, len(self.pending), len(self.data), len(page)))
            self.data += page
            self.count += len(self.pending)
            self.pending = []

    def seal(self) -> bytes:
        self.flush()
        tail = len(self.data)
        out = self.data + b"".join(self.entries) + struct.pack("<QQII", tail, self.count, len(self.entries), self.page_rows) + FOOTER
        out[:PREAMBLE] = preamble(EMBEDDED | PAGED, self.schema, tail)
        return bytes(out)


# --- span log --------------------------------------------------------------------------------------

SPAN_FIELDS = [Field(n, s) for n, s in [("trace_id_hi", "="), ("trace_id_lo", "="), ("span_id", "="), ("parent_span_id", "="), ("name", '"'), ("service", '"'), ("start_time_ns", "@"), ("duration_ns", "="), ("status_code", "="), ("payload", "<")]]


def log_header(fields: Sequence[Field] = SPAN_FIELDS) -> bytes:
    schema = encode_schema(fields, EMBEDDED)
    return LOG + struct.pack("<HHI", 0x0100, 1, len(schema)) + schema


def log_record(row: dict, fields: Sequence[Field] = SPAN_FIELDS) -> bytes:
    out = encode_record(fields, row)
    return out + bytes(pad8(len(out)))


def log_records(data: bytes) -> Iterator[tuple[dict | None, int]]:
    """Records up to the first damaged, oversized or incomplete one, one at a time, each with its end; first None with the header's end."""
    if cut(data, 0, 4) != LOG:
        raise BadMagic("not a span log")
    (size,) = take(data, "<I", 8)
    schema = cut(data, 12, size)
    (count,) = take(schema, "<H", 0)
    found, _ = names(schema, 2 + count, count)
    fields = [Field(n, s) for n, s in zip(found, schema[2 : 2 + count].decode("latin-1"), strict=True)]
    at = 12 + size
    yield None, at
    while at + 8 <= len(data) and data[at : at + 4] == OBJECT:
        (length,) = take(data, "<I", at + 4)
        if not 8 <= length <= MAX_LOG_RECORD or at + length > len(data):
            break
        try:
            row = decode_record(fields, data, at)
        except RecordError:
            break
        at += length + pad8(length)
        yield row, min(at, len(data))


def recover_log(data: bytes) -> tuple[list[dict], int]:
    """Records up to the first damaged, oversized or incomplete one, and the length that is good.

    A writer that goes on must truncate the log to that length.
    """
    found = [*log_records(data)]
    return [row for row, _ in found[1:]], found[-1][1]
