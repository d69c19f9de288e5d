"""SentencePiece encoding and decoding over a relational lattice.

Words are split where no piece can cross: before a run of spaces and around line feeds.  For a table
of words the lattice is relational: substrings of bounded length are exploded, joined to the piece
table on equality, and grouped by word with its characters; a Spark higher-order aggregate folds the edges.  For a unigram
model the fold is Viterbi.  The model at hand is of kind BPE, whose segmentation is not the one of
highest total score, so for it the fold takes, again and again, the best edge that joins two adjacent
segments (the leftmost of equals) - which is what the library's encoder does.  One pass over the edges,
best first, does that as long as no join frees an edge that the pass has left behind.  Only pieces that
are part of a better one can do so (`freeing`); where one does, the pass goes on edge by edge, each time
the best of all.

Every distinct word of up to FOLD_LENGTH characters of a block of documents goes through the relational
lattice, and the block's packed text travels with one of its words, so nothing is shuffled or stored:
the rows of a word come out of the joins one after another, and the words of a block do.  Only longer
words, whose cuts don't fit the 64 bits of the fold's state, are folded by the same rule in the block's
task.  Characters outside the pieces become byte pieces.

Defined results: null and empty text have no pieces; repeated rows are encoded one by one; text that
itself holds the space mark U+2581 decodes to a space there, which round_trip reports as false.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.packing import WordEncoder
from llm.text_arrays import PROCESS_KEY, Texts, content_hashes, gather_spans, release

MARK = "▁"
#: Text of the documents that meet their words' pieces together.
BLOCK_BYTES = 32 << 20
#: Tasks of the relational form of a table of words.
FOLD_TASKS = 48
#: Words up to this length fold in the relational form, whose state is one 64-bit number.
FOLD_LENGTH = 60


@dataclass
class Pieces:
    """A model's pieces: ids and scores of those that text can match, the byte pieces, and all surfaces."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_from: int
    surfaces: list[bytes]
    longest: int
    kind: str

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        ids, scores, surfaces, first = {}, {}, [], -1
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                first = i if value == 0 else first
                surfaces.append(bytes([value]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                surfaces.append(b"")
            else:
                ids[piece], scores[piece] = i, p.get_score(i)
                surfaces.append(piece.replace(MARK, " ").encode())
        if first < 0 or any("\n" in x or MARK in x.lstrip(MARK) for x in ids):
            raise ValueError("the model needs byte pieces, and no piece may cross a word's start")
        bpe = len({*scores.values()}) > 1 and all(float(s).is_integer() for s in scores.values())
        return Pieces(ids, scores, first, surfaces, max(map(len, ids)), "bpe" if bpe else "unigram")

    def crossings(self) -> np.ndarray:
        """Whether a piece may cross from one character to the next, by the last byte of the one and the first of the other."""
        out = np.zeros((256, 256), bool)
        for piece in self.ids:
            bytes_of = [(b" ", MARK.encode()) if c == MARK else (c.encode(),) for c in piece]
            for a, b in pairwise(bytes_of):
                out[np.ix_([x[-1] for x in a], [x[0] for x in b])] = True
        return out

    def of_segments(self, segments: list[str]) -> list[int]:
        out: list[int] = []
        for s in segments:
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += [self.bytes_from + b for b in s.encode()]
        return out

    def fold(self, word: str) -> list[int]:
        """Ids of a word: its characters, joined best score first, leftmost of equals."""
        scores, parts = self.scores, list(word)
        if len(parts) > 64:
            return self.of_segments(self._fold_long(parts))
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.of_segments(parts)

    def _fold_long(self, parts: list[str | None]) -> list[str]:
        """The same in n log n steps, for words without end."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                joined = parts[i] + parts[after[i]]
                if joined in self.scores:
                    heapq.heappush(heap, (-self.scores[joined], i, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]


def freeing(scores: dict[str, float]) -> set[str]:
    """Pieces that, joined to a character or another piece, make one that is as good or better."""
    out = set()
    for piece, score in scores.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if (k == 1 or a in scores) and (len(b) == 1 or b in scores):
                out |= {x for x in (a, b) if len(x) > 1 and scores[x] <= score}
    return out


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(match, id, key): as many rows as the model has pieces; key is a hash, by which lookups are fast."""
    return spark.createDataFrame([*pieces.ids.items()], "match string, id int").withColumn("key", F.xxhash64("match"))


EDGE = "start int, end int, id int, ends bigint, window bigint"
JOIN = "place bigint, frees boolean, ends bigint, inner bigint"


def lattice(words: DataFrame, pieces: Pieces, keep: Sequence[str] = ("word",)) -> DataFrame:
    """(kept columns, word, n, edges, joins) for each row, in order: the pieces that match at the word's places and its
    characters, by place; and those of more than one character, best first.  `ends` are the bits of an edge's two
    ends, `inner` those between, `window` both."""
    longest, names = pieces.longest, [*{"word": 0, **dict.fromkeys(keep)}]
    # the first character, then every longer span that a word can have, by its end: those of a word of n characters are the first ones
    spans = [64, *(start | end << 6 for end in range(2, FOLD_LENGTH + 1) for start in range(max(0, end - longest), end - 1))]
    n = F.greatest(F.char_length("word"), F.lit(1))
    inside = F.least(n, F.lit(longest))
    count = F.expr("inside * (inside + 1) div 2 + (n - inside) * {} - n + 1".format(longest))
    sized = words.select(*names, n.alias("n"), inside.alias("inside")).select(*names, F.slice(F.lit(np.array(spans, np.int32)), F.lit(1), count.cast("int")).alias("spans"))
    placed = sized.select(*names, F.explode_outer("spans").alias("span"))
    start, end = F.col("span").bitwiseAND(63), F.shiftright("span", 6)
    placed = placed.select("*", F.substring("word", start + 1, end - start).alias("piece"))
    # the piece table is bounded by the model; left, so that every word has the row that opens it
    table = F.broadcast(piece_table(words.sparkSession, pieces))
    same = F.col("piece").startswith(F.col("match")) & F.col("match").startswith(F.col("piece"))  # `==` would be a second key
    found = placed.join(table, (F.xxhash64("piece") == F.col("key")) & same, "left").where(F.col("id").isNotNull() | (F.col("span") == spans[0]))
    edge = F.col("span").cast("long").bitwiseOR(F.shiftleft((F.coalesce("id", F.lit(-1)) + 1).cast("long"), 12))
    # the first span opens the word and brings its columns
    rows = found.select(edge.alias("edge"), *(F.when(F.col("span") == spans[0], F.col(c)).alias(c) for c in keep))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select(*keep).schema)
    score, frees = np.zeros(max(pieces.ids.values()) + 2), np.zeros(max(pieces.ids.values()) + 2, bool)
    score[[i + 1 for i in pieces.ids.values()]] = [pieces.scores[k] for k in pieces.ids]
    if pieces.kind == "bpe":
        frees[[pieces.ids[k] + 1 for k in freeing(pieces.scores)]] = True
    single = {ord(k): i for k, i in pieces.ids.items() if len(k) == 1}
    if "word" not in keep:  # spaces stand for marks
        single |= {32: single[ord(MARK)]} if MARK in pieces.ids else {}
    chars = np.array(sorted(single), np.uint32)
    singles = {"chars": np.append(chars, np.uint32(2**32 - 1)), "char_piece": np.array([*(single[c] + 1 for c in chars.tolist()), 0])}
    scored = pieces.kind != "bpe"  # only Viterbi adds scores up
    grouped = partial(_grouped, opens=spans[0], score=score if scored else score[:0], rank=np.unique(-score, return_inverse=True)[1], frees=frees, **singles)
    out = rows.mapInArrow(grouped, f"{types}, edges array<struct<{EDGE}{', score double' * scored}>>, joins array<struct<{JOIN}>>")
    # the word itself need not travel with the edges: it is its surface with marks for spaces
    out = out if "word" in keep else out.withColumn("word", F.translate("surface", " ", MARK))
    return out.withColumn("n", F.char_length("word"))


def _grouped(batches: Iterator[pa.RecordBatch], opens: int, **model: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges, which come word after word, as one row a word."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero((batch.column(0).to_numpy() & 4095) == opens)
        if len(first):  # a word may go on in the next batch
            held.append(batch.slice(0, int(first[-1])))
            yield from _words_of(held, opens, **model)
            held = []
        held.append(batch.slice(int(first[-1]) if len(first) else 0))
    yield from _words_of(held, opens, **model)


def _words_of(held: list[pa.RecordBatch], opens: int, score: np.ndarray, rank: np.ndarray, frees: np.ndarray, chars: np.ndarray, char_piece: np.ndarray) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    edge = rows.column(0).to_numpy()
    opening = (edge & 4095) == opens
    first, word = np.flatnonzero(opening), (np.cumsum(opening) - 1)[~opening]
    names, edge = rows.schema.names[1:], edge[~opening]
    kept = [rows.column(name).take(pa.array(first)) for name in names]
    # characters are edges too, with a piece or not
    texts = Texts.of(kept[0])
    code = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = np.diff(np.concatenate([[0], np.cumsum(texts.data & 0xC0 != 0x80)])[texts.offsets])
    at = np.searchsorted(chars, code)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    word = np.concatenate([word, np.repeat(np.arange(len(first)), size)])
    edge = np.concatenate([edge, place | place + 1 << 6 | np.where(chars[at] == code, char_piece[at], 0) << 12])
    order = np.argsort(word << 12 | edge & 4095)
    word, edge = word[order], edge[order]
    start, end, piece = edge & 63, edge >> 6 & 63, edge >> 12
    one = np.int64(1)
    ends = one << start | one << end
    window = (one << end + 1) - (one << start)
    ids = pa.array((piece - 1).astype(np.int32), mask=piece == 0)
    parts = [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), ids, pa.array(ends), pa.array(window)]
    if len(score):
        parts.append(pa.array(score[piece], mask=piece == 0))
    edges = pa.ListArray.from_arrays(pa.array(np.searchsorted(word, np.arange(len(first) + 1)).astype(np.int32)), pa.StructArray.from_arrays(parts, ["start", "end", "id", "ends", "window", "score"][: len(parts)]))
    joins = np.flatnonzero((piece > 0) & (end > start + 1))
    place = rank[piece[joins]] << 6 | start[joins]
    order = np.argsort(word[joins] << 40 | place, kind="stable")
    joins, place = joins[order], place[order]
    parts = [pa.array(place), pa.array(frees[piece[joins]]), pa.array(ends[joins]), pa.array((window ^ ends)[joins])]
    bounds = np.searchsorted(word[joins], np.arange(len(first) + 1)).astype(np.int32)
    best = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, ["place", "frees", "ends", "inner"]))
    yield pa.RecordBatch.from_arrays([*kept, edges, best], [*names, "edges", "joins"])


def _bpe_cuts() -> Column:
    """Cuts of a word as bits: all at first; the best edge with one cut inside loses it, until there is none."""

    def free(mask: Column, e: Column) -> Column:
        return (F.bit_count(mask.bitwiseAND(e["inner"])) == 1) & (mask.bitwiseAND(e["ends"]) == e["ends"])

    def joined(mask: Column, inner: Column) -> Column:
        return mask.bitwiseAND(F.bitwise_not(inner))

    def best_first(mask: Column) -> Column:
        none = F.lit(0).cast("long")

        def best(m: Column) -> Column:  # joins are in order, so the first that is free is the best
            return F.aggregate("joins", none, lambda found, e: F.when((found == 0) & free(m, e), e["inner"]).otherwise(found))

        return F.aggregate(F.sequence(F.lit(1), F.col("n")), mask, lambda m, _: joined(m, best(m)))

    def step(mask: Column, e: Column) -> Column:
        after = joined(mask, e["inner"])
        left_behind = F.exists("joins", lambda j: (j["place"] <= e["place"]) & free(after, j))
        return F.when(~free(mask, e), mask).when(e["frees"] & left_behind, best_first(after)).otherwise(after)

    every = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") + 1).cast("int")) - 1
    return F.aggregate("joins", every, step)


def _viterbi_cuts() -> Column:
    """Cuts of the path of the highest total score; a character without a piece costs more than any path."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("cuts")))
    worst = F.lit(-1e6)

    def reach(states: Column, end: Column) -> Column:
        def better(best: Column, e: Column) -> Column:
            came = F.get(states, e["start"])
            path = F.struct((came["score"] + F.coalesce(e["score"], worst)).alias("score"), came["cuts"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), end)).alias("cuts"))
            return F.when((e["end"] == end) & (best.isNull() | (path["score"] > best["score"])), path).otherwise(best)

        return F.concat(states, F.array(F.aggregate("edges", F.expr("cast(null as struct<score:double,cuts:bigint>)"), better)))

    states = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, reach)
    return F.element_at(states, -1)["cuts"].bitwiseOR(F.lit(1).cast("long"))


def encode_words(words: DataFrame, pieces: Pieces, kind: str | None = None, tasks: int = FOLD_TASKS, in_place: bool = False) -> DataFrame:
    """(word, ids) for each distinct word of up to FOLD_LENGTH characters, by the relational lattice.

    In place, words are rows of text_blocks, and each of their parts gets a row (surface, body, ids) in the same order.
    """
    keep = ["surface", "body"] if in_place else ["word"]
    if in_place:
        words = words.select(F.posexplode("parts").alias("k", "surface"), F.size("parts").alias("size"), "body")
        words = words.select(F.translate("surface", " ", MARK).alias("word"), "surface", F.when(F.col("k") == F.col("size") - 1, F.col("body")).alias("body"))
    else:
        # folding is work that the planner can't see in the size of the words, so they are dealt out first
        words = words.where(F.char_length("word").between(1, FOLD_LENGTH)).select("word").repartition(tasks, "word").distinct()
    kind = kind or pieces.kind
    grouped = lattice(words, pieces, keep)
    # cuts are bound to a name by a list of one: as a column, they would be folded anew for each edge
    bound = F.array(_bpe_cuts() if kind == "bpe" else _viterbi_cuts())
    path = F.transform(bound, lambda cuts: F.filter("edges", lambda e: cuts.bitwiseAND(e["window"]) == e["ends"]))[0]  # edges are in order

    def ids(e: Column) -> Column:
        raw = F.hex(F.encode(F.substring(F.col("word"), e["start"] + 1, e["end"] - e["start"]), "UTF-8"))
        fallback = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int") + pieces.bytes_from)
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(fallback)

    return grouped.select(*keep, F.flatten(F.transform(path, ids)).alias("ids"))


class Chunks:
    """The words of texts as the pieces see them: a space before each text, cut at spaces and line feeds; and again
    where no piece crosses, if `crossings` tell.  n_words counts the former."""

    def __init__(self, texts: Texts, crossings: np.ndarray | None = None):
        filled = np.diff(texts.offsets) > 0
        self.data = np.insert(texts.data, texts.offsets[:-1][filled], 32)
        self.offsets = texts.offsets + np.concatenate([[0], np.cumsum(filled)])
        space, line = self.data == 32, self.data == 10
        opens = np.zeros(len(self.data) + 1, bool)
        opens[self.offsets] = True
        opens[1:-1] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
        self.n_words = np.diff(np.concatenate([[0], np.cumsum(opens[:-1])])[self.offsets])
        if crossings is not None:
            opens[1:-1] |= ~crossings[self.data[:-1], self.data[1:]] & (self.data[1:] & 0xC0 != 0x80)
        self.start = np.flatnonzero(opens[:-1])
        self.end = np.append(self.start[1:], len(self.data))[: len(self.start)]
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.hash = content_hashes(self.data, self.start, self.end, PROCESS_KEY)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Folder:
    """Folds words, with the interface that the word cache asks of a tokenizer."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def encode_batch_fast(self, words: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        return [SimpleNamespace(ids=self.pieces.fold(w.replace(" ", MARK))) for w in words]


@dataclass
class Head:
    """Words, as bytes one after another with their offsets, and their ids in the same way."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(surfaces: pa.Array, ids: pa.ListArray) -> Head:
        words = Texts.of(surfaces)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return Head(words.data, words.offsets, ids.flatten().to_numpy(zero_copy_only=False), bounds)


class PieceEncoder(WordEncoder):
    """A cache of words' ids that starts with the given ones."""

    def __init__(self, pieces: Pieces, head: Head):
        self.tokenizer, self.head, self.kept = Folder(pieces), head, len(head.offsets) - 1
        self._clear()

    def _clear(self) -> None:
        super()._clear()
        h = self.head
        keys = content_hashes(h.data, h.offsets[:-1], h.offsets[1:], PROCESS_KEY)
        order = np.argsort(keys)
        self.tables[0] = (keys[order], order.astype(np.int32))
        self.where, self.size, self.entries = h.bounds[:-1], np.diff(h.bounds).astype(np.int32), len(keys)
        self.ids, self.used = h.ids.astype(np.uint32), len(h.ids)


_pieces: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    """The pieces of a model; a process keeps the last one."""
    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces.load(path)
    return _pieces[path]


def decode(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts from their ids, and the texts' offsets; the space before each text is included."""
    size = np.array([len(s) for s in pieces.surfaces])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(pieces.surfaces), np.uint8)
    body, offsets = gather_spans(data, (ends - size)[ids], ends[ids])
    return body, offsets[bounds]


def parts_of(words: pa.Array, crossings: np.ndarray) -> pa.ListArray:
    """Of each word the parts of up to FOLD_LENGTH characters, between places where no piece crosses, that no word before has."""
    texts = Texts.of(words)
    data = texts.data
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = ~crossings[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
    opens[texts.offsets] = True
    start = np.flatnonzero(opens[:-1])
    end = np.append(start[1:], len(data))[: len(start)]
    first = np.sort(np.unique(content_hashes(data, start, end, PROCESS_KEY), return_index=True)[1])
    body, offsets = gather_spans(data, start[first], end[first])
    parts = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    short = pc.less_equal(pc.utf8_length(parts), FOLD_LENGTH)
    bounds = np.searchsorted(start[first][short.to_numpy(zero_copy_only=False)], texts.offsets)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts.filter(short).cast(pa.string()))


def text_blocks(documents: DataFrame, text: str, doc_id: str, crossings: np.ndarray, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(parts, body): a row for each distinct word of each run of documents, with those of its parts that no row
    before has; the last has one part at least, if an empty one, and the packed documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in Texts.of(batch.column(1)).chunks(block_bytes):
                found = [pa.array([], pa.large_string())]
                for _, run in part.chunks():
                    chunks = Chunks(run)
                    first = np.unique(chunks.hash, return_index=True)[1]
                    body, offsets = gather_spans(chunks.data, chunks.start[first], chunks.end[first])
                    found.append(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)]))
                parts = parts_of(pc.unique(pa.concat_arrays(found)), crossings)
                if not len(parts) or not len(parts[-1]):
                    parts = pa.concat_arrays([parts.slice(0, max(len(parts) - 1, 0)), pa.array([[""]], pa.list_(pa.string()))])
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(at, part.n), batch.column(1).slice(at, part.n)], ["doc_id", "text"])
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows)
                body = pa.concat_arrays([pa.nulls(len(parts) - 1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())])
                yield pa.RecordBatch.from_arrays([parts, body], ["parts", "body"])
                release()

    return documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(gather, "parts array<string>, body binary")


def encode_documents(documents: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_words, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip, and the ids if asked for."""
    crossings = _model(model_path).crossings()
    folded = encode_words(text_blocks(documents, text, doc_id, crossings), _model(model_path), in_place=True)
    schema = "doc_id long, n_words long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model_path)
        held: list[pa.RecordBatch] = []  # the block's words so far
        for batch in batches:
            at = 0
            for last in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                held.append(batch.slice(at, last + 1 - at))
                at = last + 1
                encoder = PieceEncoder(own, Head.of(*(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))))
                held.clear()
                rows = pa.ipc.open_stream(batch.column(2)[last].as_py()).read_all().combine_chunks()
                numbers = rows.column(0).combine_chunks()
                for k, part in Texts.of(rows.column(1)).chunks():
                    yield encode_part(numbers.slice(k, part.n), part, encoder, own)
                release()
            if at < batch.num_rows:
                held.append(batch.slice(at))

    def encode_part(numbers: pa.Array, part: Texts, encoder: PieceEncoder, own: Pieces) -> pa.RecordBatch:
        chunks = Chunks(part, crossings)
        ids, size = encoder.encode(chunks)
        bounds = np.concatenate([[0], np.cumsum(size)])[chunks.bounds]
        body, offsets = decode(ids, bounds, own)
        if len(body) == len(chunks.data) and (body == chunks.data).all() and (offsets == chunks.offsets).all():
            same = np.ones(part.n, bool)
        else:
            same = np.array([body[a:b].tobytes() == chunks.data[c:d].tobytes() for a, b, c, d in zip(offsets[:-1], offsets[1:], chunks.offsets[:-1], chunks.offsets[1:], strict=True)])
        raw = memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [numbers, pa.array(chunks.n_words), pa.array(np.diff(bounds)), pa.array(np.array(crcs, np.int64)), pa.array(same)]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_pieces", "ids_crc32", "round_trip", "ids"][: len(columns)])

    return folded.select("surface", "ids", "body").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model_path)
        for batch in batches:
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists.to_pylist()])]).astype(np.int64)
            body, offsets = decode(lists.flatten().to_numpy().astype(np.int64), bounds, own)
            texts = [body[a:b].tobytes()[1:].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


