"""Text columns as flat numpy arrays: words, content hashes, rolling hashes and window minimisers.

A batch of texts is one byte buffer with offsets.  All per-word and per-byte work is done on whole
buffers, so Python runs a few dozen array operations for thousands of documents.  Words are maximal
runs of bytes other than space and 0x09-0x0D, which is what ``[^\\x20\\x09-\\x0D]+`` matches.

Two kinds of hashes.  ``content_hashes`` tells words and lines apart: it chains blocks of eight bytes
through a keyed mix, and callers draw the key per run or per process, so that no text can be written to
collide.  The rolling hashes (``prefix_hashes`` and what cuts spans out of it) are sums modulo 2**64:
over bytes they serve routing only, where what is equal is compared by content afterwards; over
content hashes of words they tell short windows apart.
"""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Sub-batches hold at most this many bytes of text, unless one text alone is longer.
CHUNK_BYTES = 1 << 20
#: A key for content hashes that don't leave this process.
PROCESS_KEY = secrets.randbits(64)
#: Spans up to this length are hashed in blocks for all spans at once.
BLOCKED_BYTES = 96
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator decides by itself
    _libc = None
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Give freed memory back to the system, so that workers kept for later tasks stay small."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    have = len(_powers[0])
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            grown = np.full(size, base, U64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (multiply and shift, invertible)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running hash of a sequence of 64-bit values; span_hashes() cuts any span out of it."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end); equal spans have equal hashes wherever they lie."""
    at = powers(len(prefix))[0]
    return mix((prefix[end] - prefix[start]) * at[start] + (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def window_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, U64)
    return mix((prefix[k:] - prefix[:n]) * powers(n)[0])


def content_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """Keyed hash of the bytes in each [start, end): spans up to BLOCKED_BYTES in eight-byte blocks, all at once; longer ones one by one."""
    size = end - start
    if not len(size):
        return np.zeros(0, U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, U64, padded, strides=(1,))  # the eight bytes from each place on
    masks = U64(2**64 - 1) >> (U64(64) - U64(8) * np.arange(1, 9, dtype=U64))
    salt = np.arange(BLOCKED_BYTES + 1, dtype=U64)
    salt = mix(salt + U64(key & (2**64 - 1)))
    out = salt[np.minimum(size, BLOCKED_BYTES)] ^ (blocks[start] & masks[np.clip(size, 1, 8) - 1])
    out = mix(out)
    live = np.flatnonzero((size > 8) & (size <= BLOCKED_BYTES))
    at, left = start[live] + 8, size[live] - 8
    while len(live):
        out[live] = mix(out[live] ^ (blocks[at] & masks[np.minimum(left, 8) - 1]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero((size > BLOCKED_BYTES) | (size == 0))
    if len(long):
        raw, seed = memoryview(np.ascontiguousarray(data)), key & (2**64 - 1)
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


class Texts:
    """A run of texts as bytes with offsets; null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray) -> Texts:
        if column.null_count:  # otherwise it would only be copied
            column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, where, body = column.buffers()
        if not len(column) or where is None:
            return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        return Texts(data, offsets - offsets[0])

    def chunks(self, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
        """(first text's index, texts) in runs of at most limit bytes."""
        at = 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + limit, "right")) - 1)
            to = min(to, self.n)
            a, b = self.offsets[at], self.offsets[to]
            yield at, Texts(self.data[a:b], self.offsets[at : to + 1] - a)
            at = to

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position (ascending or not) lies in."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Start, end, owner and hash of every word of some texts, in order."""

    def __init__(self, texts: Texts, lower: bool = False, key: int = 0):
        self.key = key
        data = _LOWER[texts.data] if lower else texts.data
        self.texts, self.data = texts, data
        first = np.zeros(len(data) + 1, bool)
        first[texts.offsets] = True
        word = ~_IS_SPACE[data]
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, word[:-1]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, word[1:]
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, texts.offsets)  # of each text's words
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(texts.n), self.counts)

    @cached_property
    def hash(self) -> np.ndarray:
        return content_hashes(self.data, self.start, self.end, self.key)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    size, out = 1, a
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if size < w else out


def minimisers(hashes: np.ndarray, bounds: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which k-gram stands for each window of `width` items.

    hashes: of the k-gram at each item; bounds: of the texts' items.  A window's k-gram is the one of
    least hash in it, the last of these.  It depends on the window's content alone, so equal windows
    name equal k-grams at equal places.  Returns runs of windows: (k-gram's place, first window, last
    window); each window inside one text is in exactly one run.
    """
    span = width - k + 1
    empty = np.zeros(0, np.int64)
    total = int(bounds[-1])
    if total < width:
        return empty, empty, empty
    low = 24
    while total >> low:
        low += 1
    places = U64((1 << low) - 1)
    ranked = (hashes[: total - k + 1] & ~places) | (places - np.arange(total - k + 1, dtype=U64))
    best = (places - (sliding_min(ranked, span) & places)).astype(np.int64)
    valid = np.zeros(total + 1, np.int32)  # windows that lie in one text
    starts, ends = bounds[:-1], bounds[1:] - width + 1
    real = ends > starts
    valid[starts[real]] += 1
    valid[ends[real]] -= 1
    windows = np.flatnonzero(np.cumsum(valid[:-1])[: total - width + 1] > 0)
    if not len(windows):
        return empty, empty, empty
    best = best[windows]
    cut = np.flatnonzero((best[1:] != best[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(windows)]]) - 1
    return best[first], windows[first], windows[last]


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length as compressed byte planes; unpack() gives them back."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        part = raw[at : at + n * size].reshape(size, n) if n else np.zeros((size, 0), np.uint8)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(-1))
        at += n * size
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a stable order that sorts keys, and where each run of equal keys starts in it, with the end."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, np.concatenate([starts, [len(keys)]]).astype(np.int64)


def gather_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after another, and their offsets."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return data[index], offsets
