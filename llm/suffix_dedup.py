"""Suffix-array dedup with a depth-limited radix sort (byte windows).

A byte goes if a `window`-byte string that covers it also starts in a document with a smaller id.
Only suffixes' first `window` bytes matter, so suffixes are put in order by most-significant-digit
passes of eight bytes and no deeper than `window`; groups that are still equal after the last pass
are exactly the repeated windows.  The first, coarsest pass is the routing of ``llm.repeats``: it
sends suffixes to shards by the k-gram that stands for their window and leaves out those whose k-gram
occurs under one id only.  Between passes a group whose windows all have one id is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from llm.repeats import Stretches, cut_repeats
from llm.text_arrays import U64

WINDOW_BYTES = 50
KEY_BYTES = 20


def _digits(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), U64)
    for j in range(8):
        out = (out << U64(8)) | padded[j : j + len(data)]
    return out


def _sorted_groups(data: np.ndarray, at: np.ndarray, seg: np.ndarray, stretches: Stretches, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (numbers into `at`, ascending) whose content occurs under two ids, and the least id of each one's content."""
    digits = _digits(data)
    index = np.arange(len(at), dtype=np.int32)
    group = np.zeros(len(at), np.int32)
    depths = [*range(0, window - 7, 8)]
    if depths[-1] + 8 < window:
        depths.append(window - 8)
    low = np.zeros(0, np.int64)
    for depth in depths:
        digit = digits[at[index] + depth]
        order = np.argsort(digit, kind="stable").astype(np.int32)
        if depth:
            order = order[np.argsort(group[order], kind="stable")]
        index, digit, group = index[order], digit[order], group[order]
        del order
        new = np.ones(len(index), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            break
        size = np.diff(np.concatenate([starts, [len(index)]]))
        low = np.minimum.reduceat(stretches.least[seg[index]], starts)
        stays = low != np.maximum.reduceat(stretches.most[seg[index]], starts)
        index = index[np.repeat(stays, size)]
        low, size = low[stays], size[stays]
        group = np.repeat(np.arange(len(low), dtype=np.int32), size)
    first = low[group] if len(group) else np.zeros(0, np.int64)
    order = np.argsort(index, kind="stable")
    return index[order], first[order]


def _radix(stretches: Stretches, shards: int, window: int) -> pa.Table:
    size = np.array([len(t) for t in stretches.texts], np.int32)
    base = np.cumsum(size, dtype=np.int32) - size
    data = np.frombuffer(b"".join(stretches.texts), np.uint8)
    count = size - window + 1
    seg = np.repeat(np.arange(len(size), dtype=np.int32), count)
    opens = np.cumsum(count, dtype=np.int32) - count
    at = np.arange(len(seg), dtype=np.int32) + (base - opens)[seg]
    index, first = _sorted_groups(data, at, seg, stretches, window)
    seg = seg[index].astype(np.int64)
    return stretches.cuts(seg, at[index] - base[seg].astype(np.int64), first, window, shards)


def remove_repeated_bytes(documents: DataFrame, window: int = WINDOW_BYTES, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """documents with `text` as the remaining bytes (binary), and n_bytes, n_removed, n_spans (long).

    window is 8 bytes at least.  Nulls, repeated ids and empty tables: see ``llm.repeats``.
    """
    if window < 8:
        raise ValueError("window must be 8 bytes at least")
    key = max(4, min(KEY_BYTES, window // 2))
    return cut_repeats(documents, "byte", key, window, lambda s, n: _radix(s, n, window), text, doc_id, [("kept", text, T.BinaryType()), ("items", "n_bytes", T.LongType()), ("removed", "n_removed", T.LongType()), ("spans", "n_spans", T.LongType())], shards)
