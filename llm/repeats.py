"""Find and cut every fixed-width window that also starts in a document with a smaller id.

The work is shared by the word-level phrase automata and the byte-level suffix sort; they differ in
how the windows of one shard are compared.  Four steps, in all of which a shard is of bounded size:

1. ``shared keys``: each window is stood for by one k-gram of it (see ``minimisers``).  Only these
   k-grams' hashes travel, packed by the thousand; a shard of the hash space finds those that occur
   under two ids.  A window whose k-gram occurs under one id only cannot repeat, so this drops
   nothing that counts.
2. ``segments``: each document looks its shared k-grams up and sends the stretches around them, as
   text, to the shard of the k-gram.  Equal windows have equal k-grams, so they meet there.
3. ``resolve`` compares whole windows by their content - no hash decides - and names, per document,
   the spans to cut.
4. ``apply`` cuts the spans out of the documents.

Documents are dealt by id once; steps 2 and 4 reuse that exchange.  One stretch that a third of all
documents hold becomes one entry of a shard with many holders, never pairs of them.

Defined results: null text counts as empty; rows with equal ids never remove anything from each
other; rows with a null id come after all others; texts shorter than a window are kept; an empty table
gives an empty table; input columns with the name of an output (in any case) are replaced by it, and
all others pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.columns import numbered, place, untouched
from llm.text_arrays import U64, Texts, Words, byte_values, gather_spans, grouped, minimisers, mix, pack, prefix_hashes, release, span_hashes, unpack, window_hashes

NO_ID = 2**63 - 1
ID, DEAL = "__repeat_id", "__repeat_deal"
SHARD_BYTES = 2 << 20
#: A task works through several shards where there are more.
MOST_TASKS = 20_000
#: Stands for an id in the entry of a key that a batch has found under two ids.
FOUND = -(2**63)
BLOB = "shard int, body binary"


def shard_count(documents: DataFrame, text: str = "text") -> int:
    """Shards such that each deals with about SHARD_BYTES of text."""
    total = documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return int(max(64, -(-total // SHARD_BYTES)))


def dealt(documents: DataFrame, shards: int, doc_id: str = "doc_id") -> DataFrame:
    """documents with an order key without nulls and the shard that the document belongs to."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return documents.withColumn(ID, key).withColumn(DEAL, F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the leading bits, so keys in order are shards in order."""
    return (((keys >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def blob_rows(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, packed arrays) for each shard that has entries; shard must ascend."""
    bounds = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist() if len(shard) else []
    for at, to in zip(bounds, bounds[1:], strict=False):
        yield int(shard[at]), pack(*(a[at:to] for a in arrays))


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "body"])


def joined(table: pa.Table, *kinds: str) -> list[np.ndarray]:
    """All packed arrays of a shard, one after another."""
    parts = [unpack(x, *kinds) for x in table.column("body").to_pylist()]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def spread(packed: DataFrame, shards: int) -> GroupedData:
    """Groups by shard, over as many tasks as there are shards, or MOST_TASKS: packed rows look small to the planner, their work is not."""
    return packed.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard")


class Anchors:
    """The k-grams that stand for the windows of some texts, each with the run of windows it stands for."""

    def __init__(self, texts: Texts, unit: str, k: int, width: int):
        self.texts, self.width = texts, width
        self.words = Words(texts) if unit == "word" else None
        self.bounds = self.words.bounds if self.words else texts.offsets
        values = self.words.hash if self.words else byte_values(texts.data)
        hashes = window_hashes(prefix_hashes(values), k)
        place, self.first, self.last = minimisers(hashes, self.bounds, k, width)
        # minimisers are small hashes; mixed once more they spread evenly over the shards
        self.key = mix(hashes[place]) if len(place) else np.zeros(0, U64)
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1

    def spans(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans that hold all the windows of the chosen anchors."""
        first, end = self.first[which], self.last[which] + self.width
        return (self.words.start[first], self.words.end[end - 1]) if self.words else (first, end)


def text_marks(texts: Texts) -> np.ndarray:
    """A 32-bit mark of each whole text; it tells rows of one id apart."""
    return (span_hashes(prefix_hashes(byte_values(texts.data)), texts.offsets[:-1], texts.offsets[1:]) >> U64(32)).astype(np.uint32)


def pair_keys(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(U64) + mix(ids.astype(U64)))


def shared_keys(documents: DataFrame, shards: int, unit: str, k: int, width: int, text: str) -> DataFrame:
    """Step 1.  (shard of documents, packed (id, key)) for the keys that occur under two ids or more.

    A key that has two ids in one batch is settled there: its holders go straight to their documents'
    shards, and the key's shard gets one entry that says so.  So a key that a third of all documents
    hold is one entry for each batch in its shard.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, deal = (batch.column(c).to_numpy() for c in (ID, DEAL))
            keys, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for at, part in Texts.of(batch.column(text)).chunks():
                a = Anchors(part, unit, k, width)
                keys.append(a.key)
                docs.append(a.doc + at)
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            if len(keys):  # once per document
                new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
                keys, docs = keys[new], docs[new]
                held, where = ids[docs], deal[docs]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                found = np.minimum.reduceat(held, starts) != np.maximum.reduceat(held, starts)
                settled = np.repeat(found, np.diff(np.concatenate([starts, [len(keys)]])))
                order = np.lexsort((held[settled], where[settled]))
                yield _kinds(1, list(blob_rows(where[settled][order], shards, held[settled][order], keys[settled][order])))
                open_ = ~settled
                open_[starts[found]] = True  # stays as the entry that says so
                held, where = np.where(settled, FOUND, held)[open_], where[open_]
                yield _kinds(0, list(blob_rows(shard_of(keys[open_], shards), shards, keys[open_], held, where)))
            del keys, docs, order
            release()

    def find(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rows = [(key[0].as_py(), body) for body in table.filter(pa.array(kinds == 1)).column("body").to_pylist()]
        keys, ids, deal = joined(table.filter(pa.array(kinds == 0)), "u8", "i8", "i4")
        if len(keys):
            order, starts = grouped(keys)
            ids, deal, keys = ids[order], deal[order], keys[order]
            many = np.repeat(np.minimum.reduceat(ids, starts[:-1]) != np.maximum.reduceat(ids, starts[:-1]), np.diff(starts)) & (ids != FOUND)
            ids, deal, keys = ids[many], deal[many], keys[many]
            order = np.lexsort((keys, ids, deal))
            rows += blob_rows(deal[order], shards, ids[order], keys[order])
        return pa.Table.from_batches([blob_batch(rows)])

    packed = documents.select(ID, DEAL, text).mapInArrow(emit, f"{BLOB}, kind int")
    return spread(packed, shards).applyInArrow(find, BLOB)


def _kinds(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    batch = blob_batch(rows)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rows), kind, np.int32))], ["shard", "body", "kind"])


def segments(documents: DataFrame, shared: DataFrame, shards: int, unit: str, k: int, width: int, text: str) -> DataFrame:
    """Step 2.  (shard of keys, packed stretches): bytes, their lengths, id, mark, first window's place, shard of documents."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SEGMENTS.empty_table()
        known = np.sort(pair_keys(*joined(right, "i8", "u8")))
        ids, deal = left.column(ID).to_numpy(), left.column(DEAL).to_numpy()
        parts = []
        for at, part in Texts.of(left.column(text)).chunks():
            a = Anchors(part, unit, k, width)
            probe = pair_keys(ids[a.doc + at], a.key)
            found = np.searchsorted(known, probe)
            which = np.flatnonzero(known[np.minimum(found, len(known) - 1)] == probe)
            body, offsets = gather_spans(part.data, *a.spans(which))
            doc = a.doc[which]
            parts.append((a.key[which], body, np.diff(offsets), ids[doc + at], text_marks(part)[doc], a.first[which] - a.bounds[doc], deal[doc + at]))
        keys, body, size, ids, marks, place, deal = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum(size)
        order = np.argsort(keys, kind="stable")
        body, offsets = gather_spans(body, (ends - size)[order], ends[order])
        shard = shard_of(keys[order], shards)
        heads = [x[order] for x in (size.astype(np.uint32), ids, marks, place.astype(np.int64), deal)]
        bounds = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist() if len(shard) else []
        rows = [(int(shard[i]), pack(body[offsets[i] : offsets[j]]), pack(*(x[i:j] for x in heads))) for i, j in zip(bounds, bounds[1:], strict=False)]
        release()
        return pa.Table.from_pylist([dict(zip(SEGMENTS.names, r, strict=True)) for r in rows], SEGMENTS)

    # all columns, as in the last step, so that one exchange of the documents serves both
    return documents.groupBy(DEAL).cogroup(shared.groupBy("shard")).applyInArrow(cut, "shard int, body binary, heads binary")


SEGMENTS = pa.schema([("shard", pa.int32()), ("body", pa.binary()), ("heads", pa.binary())])


class Stretches:
    """The different stretches of a shard, and who holds each."""

    def __init__(self, table: pa.Table):
        heads = [unpack(x, "u4", "i8", "u4", "i8", "i4") for x in table.column("heads").to_pylist()]
        size, self.ids, self.marks, self.place, self.deal = (np.concatenate([h[i] for h in heads]) for i in range(5))
        index: dict[bytes, int] = {}
        self.of = np.empty(len(size), np.int64)
        at = 0
        for head, body in zip(heads, table.column("body").to_pylist(), strict=True):
            raw, cut = unpack(body, "u1")[0].tobytes(), 0
            for n in head[0].tolist():
                self.of[at] = index.setdefault(raw[cut : cut + n], len(index))
                cut += n
                at += 1
        self.texts = list(index)
        order, starts = grouped(self.of)
        ranked = self.ids[order]
        self.least, self.most = np.minimum.reduceat(ranked, starts[:-1]), np.maximum.reduceat(ranked, starts[:-1])

    def cuts(self, seg: np.ndarray, pos: np.ndarray, first_id: np.ndarray, width: int, shards: int) -> pa.Table:
        """Spans to cut, from windows (stretch, place in it, least id of the window's content), in order of stretch and place."""
        n = len(self.texts)
        low, high = np.full(n, NO_ID), np.full(n, -(2**63))
        np.minimum.at(low, seg, first_id)
        np.maximum.at(high, seg, first_id)
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (pos[1:] > pos[:-1] + width)]) if len(seg) else np.zeros(0, bool)
        run = np.flatnonzero(new)
        last = np.concatenate([run[1:], [len(seg)]])[: len(run)] - 1
        run_seg, run_lo, run_hi = seg[run], pos[run], pos[last] + width
        run_at = np.searchsorted(run_seg, np.arange(n + 1))
        whole = np.flatnonzero((self.ids > high[self.of]) & (low[self.of] < NO_ID))  # every window of the stretch goes
        count = np.diff(run_at)[self.of[whole]]
        held = np.repeat(whole, count)
        which = np.arange(len(held)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(run_at[self.of[whole]], count)
        out = [(held, run_lo[which], run_hi[which])]
        seg_at = np.searchsorted(seg, np.arange(n + 1))
        for h in np.flatnonzero((self.ids > low[self.of]) & (self.ids <= high[self.of])):  # only some windows go
            a, b = seg_at[self.of[h]], seg_at[self.of[h] + 1]
            p = pos[a:b][first_id[a:b] < self.ids[h]]
            cut = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + width]))
            out.append((np.full(len(cut), h), p[cut], p[np.concatenate([cut[1:], [len(p)]]) - 1] + width))
        held, lo, hi = (np.concatenate([o[i] for o in out]) for i in range(3))
        order = np.argsort(self.deal[held], kind="stable")
        held, lo, hi = held[order], lo[order], hi[order]
        rows = list(blob_rows(self.deal[held], shards, self.ids[held], self.marks[held], self.place[held] + lo, self.place[held] + hi))
        return pa.Table.from_batches([blob_batch(rows)])


def covered(part: Texts, ids: np.ndarray, bounds: np.ndarray, spans: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which items of the texts lie in a span; spans: row key (ascending), start and end inside the row's text."""
    keys, lo, hi = spans
    own = pair_keys(ids, text_marks(part))
    a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    count = b - a
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    base = np.repeat(bounds[:-1], count)
    change = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(change, base + lo[which], 1)
    np.add.at(change, base + hi[which], -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(right: pa.Table) -> tuple[np.ndarray, ...]:
    ids, marks, lo, hi = joined(right, "i8", "u4", "i8", "i8")
    keys = pair_keys(ids, marks)
    order = np.argsort(keys, kind="stable")
    return keys[order], lo[order], hi[order]


def cut_repeats(documents: DataFrame, unit: str, k: int, width: int, resolve: Callable[[Stretches, int], pa.Table], text: str, doc_id: str, outputs: list[tuple[str, str, T.DataType]], shards: int | None = None) -> DataFrame:
    """documents without `text`, plus the outputs: (kind, column name, type) with kind kept, items, removed or spans."""
    shards = shards or shard_count(documents, text)
    names, outer = documents.columns, untouched(documents, text, *(name for _, name, _ in outputs))
    text, doc_id = f"c{place(documents, text)}", f"c{place(documents, doc_id)}"
    documents = numbered(documents)
    rows = dealt(documents, shards, doc_id)
    shared = shared_keys(rows, shards, unit, k, width, text)
    stretches = segments(rows, shared, shards, unit, k, width, text)

    def compare(table: pa.Table) -> pa.Table:
        try:
            return resolve(Stretches(table), shards)
        finally:
            release()

    spans = spread(stretches, shards).applyInArrow(compare, BLOB)
    others = [f"c{i}" for i in outer]
    schema = T.StructType([documents.schema[c] for c in others] + [T.StructField(f"out_{kind}", of) for kind, _, of in outputs])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found = spans_of(right)
        ids = left.column(ID).to_numpy() if left.num_rows else np.zeros(0, np.int64)
        texts = Texts.of(left.column(text))
        got: dict[str, list] = {"kept": [], "items": [], "removed": [], "spans": []}
        for at, part in texts.chunks():
            words = Words(part) if unit == "word" else None
            bounds = words.bounds if words else part.offsets
            gone = covered(part, ids[at : at + part.n], bounds, found)
            total = np.concatenate([[0], np.cumsum(gone)])
            got["items"].append(np.diff(bounds))
            got["removed"].append(total[bounds[1:]] - total[bounds[:-1]])
            opens = np.zeros(len(gone) + 1, bool)
            opens[bounds] = True
            start = gone.copy()
            start[1:] &= ~gone[:-1] | opens[1:-1]
            total = np.concatenate([[0], np.cumsum(start)])
            got["spans"].append(total[bounds[1:]] - total[bounds[:-1]])
            got["kept"].append(kept_words(words, ~gone) if words else kept_bytes(part, ~gone))
        columns = [left.column(c) for c in others]
        for kind, _, _ in outputs:
            columns.append(pa.chunked_array(got[kind], type=ARROW_KEPT[unit]) if kind == "kept" else pa.array(np.concatenate([np.zeros(0, np.int64), *got[kind]]), pa.int64()))
        return pa.Table.from_arrays(columns, schema.names)

    out = rows.groupBy(DEAL).cogroup(spans.groupBy("shard")).applyInArrow(cut, schema)
    return out.toDF(*(names[i] for i in outer), *(name for _, name, _ in outputs))


ARROW_KEPT = {"word": pa.string(), "byte": pa.binary()}


def from_offsets(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def kept_bytes(part: Texts, keep: np.ndarray) -> pa.Array:
    total = np.concatenate([[0], np.cumsum(keep)])
    return from_offsets(pa.binary(), total[part.offsets], part.data[keep])


def kept_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    data = np.concatenate([words.data, np.zeros(1, np.uint8)])
    body, offsets = gather_spans(data, start, end + 1)
    body[offsets[1:] - 1] = 32
    closing = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    real = np.ones(len(body), bool)
    real[offsets[1:][closing] - 1] = False
    size = np.bincount(doc, weights=end - start + 1, minlength=words.texts.n).astype(np.int64)
    size -= size > 0
    return from_offsets(pa.string(), np.concatenate([[0], np.cumsum(size)]), body[real])

