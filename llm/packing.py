"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised once, word by word through a bounded cache of the words met; a document is
its ids and the closing id 0, and only a document longer than a sequence is cut.  The plan is made on
the histogram of piece lengths, which has at most `capacity` entries whatever the corpus: pieces over
a third of the capacity go at most two to a sequence, the largest with the largest that fits; then
smaller pieces fill the tightest remaining gap, largest first.  The plan is a list of slots by
(length, rank); each piece finds its slot by its rank among pieces of its length, counted by blocks,
so no length - however common - is ordered in one task.

Defined results: null text counts as empty (one piece, the closing id alone); an empty table gives an
empty table; rows with equal ids are packed one by one.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.text_arrays import PROCESS_KEY, U64, Texts, Words

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of words by a tokenizer that never joins words; keeps those of up to CACHE_WORDS words.

    Words stand in a large sorted table and a small one of those met lately, which is merged into the
    large one when it comes to an eighth of it; ids are appended to a buffer that grows by doubling.
    """

    #: Entries that are there from the first and come back when the others go.
    kept = 0

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; more threads cost CPU time only
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.tables = [(np.zeros(0, U64), np.zeros(0, np.int32)) for _ in range(2)]  # sorted keys, numbers of entries
        self.where, self.size, self.entries = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Take in words by their keys, which ascend and are new; the numbers of their entries."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        entry = np.arange(self.entries, self.entries + len(keys), dtype=np.int32)
        for name, need in (("where", self.entries + len(keys)), ("size", self.entries + len(keys)), ("ids", self.used + len(flat))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.where[entry] = self.used + np.cumsum(size, dtype=np.int64) - size
        self.size[entry] = size
        self.ids[self.used : self.used + len(flat)] = flat
        self.entries, self.used = self.entries + len(keys), self.used + len(flat)
        self.tables[1] = _merged(self.tables[1], (keys, entry))
        if 8 * len(self.tables[1][0]) > len(self.tables[0][0]):
            self.tables = [_merged(*self.tables), (np.zeros(0, U64), np.zeros(0, np.int32))]
        return entry

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and each word's number of ids."""
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        entry = np.full(len(keys), -1, np.int32)
        for known, numbers in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                entry = np.where(known[at] == keys, numbers[at], entry)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.entries + len(new) > CACHE_WORDS + self.kept and self.entries > self.kept:
                self._clear()
                return self.encode(words)
            texts = [words.word(i).decode("utf-8") for i in first[new].tolist()]
            entry[new] = self._add(keys[new], [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        entry = entry[back]
        size, where = self.size[entry].astype(np.int64), self.where[entry]
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(where - (ends - size), size)
        return self.ids[index], size


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(keys, kind="stable")  # two sorted runs
    return keys[order], numbers[order]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, row (a number of the input row), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            rows, crcs = [], []
            for at, part in Texts.of(batch.column(1)).chunks():
                words = Words(part, key=PROCESS_KEY)
                ids, size = encode(words)
                total = np.concatenate([[0], np.cumsum(size)])[words.bounds]
                length = np.diff(total) + 1
                flat = np.full(len(ids) + part.n, END_ID, np.uint32)
                ends = np.cumsum(length)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                count = -(-length // capacity)
                doc = np.repeat(np.arange(part.n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                stop = np.minimum(start + capacity, length[doc])
                base = (ends - length)[doc]
                raw = memoryview(flat.astype("<u4").tobytes())
                crcs += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((base + start).tolist(), (base + stop).tolist(), strict=True)]
                rows.append((doc + at, piece, start, stop - start))
            if rows:
                doc, piece, start, length = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crcs, np.int64))], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(doc_id).cast("long"), F.col(text), F.monotonically_increasing_id().alias("row")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for so many pieces of each length: (lengths in a sequence, number of such sequences)."""
    left = Counter({k: v for k, v in counts.items() if v and k < capacity})
    done: list[tuple[tuple[int, ...], int]] = []
    if counts.get(capacity):
        done.append(((capacity,), counts[capacity]))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((k for k in large if k <= min(size, capacity - size) and left[k] - (k == size) > 0), None)
            if mate is None:
                open_[capacity - size].append(((size,), left[size]))
                left[size] = 0
            else:
                n = left[size] // 2 if mate == size else min(left[size], left[mate])
                left[size] -= n
                left[mate] -= n
                open_[capacity - size - mate].append(((size, mate), n))
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            gap = min((g for g in open_ if g >= size), default=capacity)
            if gap not in open_:
                open_[gap].append(((), -(-left[size] // (gap // size))))
            lengths, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            fit = gap // size
            full = min(n, left[size] // fit)
            left[size] -= full * fit
            if full:
                open_[gap - fit * size].append((lengths + (size,) * fit, full))
            n -= full
            if n and left[size]:
                rest, left[size] = left[size], 0
                open_[gap - rest * size].append((lengths + (size,) * rest, 1))
                n -= 1
            if n and lengths:
                open_[gap].append((lengths, n))
    return done + [x for group in open_.values() for x in group]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs of slots by length: length, first rank, sequence of that rank, offset in it."""
    out, used, sequence = [], Counter(), 0
    for lengths, n in sequences:
        at = 0
        for size in lengths:
            out.append((size, used[size], sequence, at))
            used[size] += n
            at += size
        sequence += n
    out.sort()
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset.  pieces must be a stored table: it is read twice.

    The histogram has at most `capacity` rows; the slots that tasks get are bounded by it too.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    length, rank, sequence, offset = slots(plan(histogram, capacity))
    first = (length << 40) | rank
    blocks = int(max(16, sum(histogram.values()) // 20_000))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    local = placed.withColumn("nth", F.row_number().over(Window.partitionBy("block", "length").orderBy("row", "piece")) - 1)
    ranked = local.join(before, ["length", "block"]).withColumn("rank", F.col("nth") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, nth = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(first, (size << 40) | nth, "right") - 1
            columns = [batch.column(c) for c in NAMES] + [pa.array(sequence[at] + nth - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "sequence_id", "offset"])

    return ranked.select(*NAMES, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    from llm.storage import stored

    return pack_pieces(stored(tokenised_pieces(documents, tokenizer_path, capacity, text, doc_id), "pieces"), capacity)
