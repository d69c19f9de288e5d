"""Similarity join on word n-gram sets with prefix trees.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.  All
sets are put in one global order, rare shingles first.  Two sets that link share one of their first
n - ceil(0.8 n) + 1 shingles, at places that leave room for the overlap that is needed; so candidates
meet in the shard of a shared early shingle.

1. Shingles that are frequent within batches of documents are counted.  The most frequent (a bounded
   list) come last in the order; the list changes cost only, never results.
2. Each document becomes one row with its early shingles and a parity sketch of its set; documents with
   equal sets become one node.
3. Shards of the shingle space keep shingles that two nodes or more share, and the sketches of their
   nodes.  An element that only one of two sets has flips one bit, so sketches that differ in more bits
   than similar sets differ in elements rule a pair out, exactly.
4. Offers: for each shared shingle, its nodes are paired with a pivot (the node where it comes earliest,
   which is the one with the fewest shingles of its own) and with neighbours in two orders; each node
   keeps its best few.  A group of thousands of near copies thus costs a few pairs per member.
5. Then every remaining pair of nodes of different components that room and sketches leave is proposed,
   so no link between components is missed.  `link_table` has every link, those inside components too:
   it proposes all pairs that room and sketches leave, without offers.
6. Proposed pairs are dealt into cells of bounded size, near copies to one cell, so a text travels once
   or twice and not once for each pair.  A cell puts its full sets, rare shingles first, into one prefix
   tree, and all queries descend it together: overlaps along a common prefix are counted once for all
   sets below, and subtrees whose remaining lengths leave no room are left (``llm.prefix_tree``).

Defined results: null or empty text has an empty set, which links with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle; a null id counts as larger than all others and a
component of null ids only is null; rows with equal ids are judged by their own texts; an empty table
gives an empty table; other columns pass through `component_table` not at all and through `keep_one`
unchanged.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.components import components
from llm.prefix_tree import PrefixTree, needed
from llm.repeats import BLOB, NO_ID, blob_batch, blob_rows, joined, shard_of, spread
from llm.storage import discard, largest, stored
from llm.text_arrays import U64, Texts, Words, grouped, mix, pack, prefix_hashes, release, span_hashes, unpack, window_hashes

SHINGLE_WORDS = 5
PERCENT = 80
#: Entries of the list of frequent shingles: 12 bytes each in every task.
FREQUENT = 1 << 18
COUNT_TOKENS = 2_000_000
#: Text that a shard of the shingle space stands for.
SHARD_BYTES = 8 << 20
#: Pairs that a node is offered before all that are left are proposed.
OFFERS = 3
#: Pairs that one cell verifies, and texts that it holds, at about twice as many at most.
CELL_PAIRS = 2_048
#: Bits of a sketch.
SKETCH = 512
#: Pairs of a shard that are looked at together.
BLOCK_PAIRS = 1 << 18
#: Ids up to which a bit table of them is sent to the pass over the documents: 16 bits each.
BLOOM_IDS = 1 << 23


def shard_number(documents: DataFrame, text: str) -> tuple[int, int]:
    """Shards of the shingle space, and how many low bits of early shingles may be dropped without many more false candidates."""
    total = documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    kept = max(32, int(total).bit_length() - 3 + 12 + 4)  # early shingles, a share of them false, the order's levels
    return int(max(64, -(-total // SHARD_BYTES))), max(0, 64 - 8 * -(-kept // 8))


def shingle_hashes(texts: Texts, width: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle of each text, in order of text and hash."""
    words = Words(texts, lower=True, key=key)
    prefix = prefix_hashes(words.hash)
    hashes = window_hashes(prefix, width)
    at = np.flatnonzero(words.doc[: len(hashes)] == words.doc[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    doc = np.concatenate([words.doc[at], short])
    keys = np.concatenate([hashes[at], span_hashes(prefix, words.bounds[short], words.bounds[short + 1])])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return doc[new], keys[new]


def early(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first items of a set of n must hold one that a similar set shares among its own."""
    return n - -(-percent * n // 100) + 1


def _frequent(documents: DataFrame, text: str, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles, ascending, and the order level of each (larger: later)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, U64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 2].view(np.int64)), pa.array(n[n > 2])], ["key", "n"])

        for batch in batches:
            for _, part in Texts.of(batch.column(0)).chunks():
                held.append(shingle_hashes(part, width, key)[1])
                size += len(held[-1])
                if size > COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        yield flush()
        held.clear()
        release()

    counts = stored(documents.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "frequent")
    top = largest(counts, "n", FREQUENT).toPandas()
    discard(counts)
    keys, n = top["key"].to_numpy(np.int64).view(U64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], np.minimum(np.log2(np.maximum(n[order], 1)).astype(np.int64), 15).astype(U64)


def ordered(doc: np.ndarray, keys: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Items as numbers in the global order, sorted within each text."""
    known, level = frequent
    rank = keys >> U64(4)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        rank |= np.where(known[at] == keys, level[at], U64(0)) << U64(60)
    order = np.lexsort((rank, doc))
    return doc[order], rank[order]


def sketches(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each text SKETCH bits: how many of its items fall to each bit, modulo 2; a row of bytes a text."""
    out = np.zeros((n, SKETCH // 8), np.uint8)
    bit = (keys >> U64(20)).astype(np.int64) & (SKETCH - 1)
    for at in range(0, n, 1024):
        a, b = np.searchsorted(doc, [at, at + 1024])
        m = min(1024, n - at)
        odd = np.bincount((doc[a:b] - at) * SKETCH + bit[a:b], minlength=m * SKETCH) & 1
        out[at : at + m] = np.packbits(odd.astype(bool).reshape(m, SKETCH), axis=1)
    return out


def profiles(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int, text: str, doc_id: str, key: int = 0, dropped: int = 0) -> DataFrame:
    """A row per document: id, n (size of its set), two hashes of the set, its early items (without their lowest bits), packed, and its sketch."""
    low = ~U64((1 << dropped) - 1)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in Texts.of(batch.column(1)).chunks():
                doc, keys = shingle_hashes(part, width, key)
                bounds = np.searchsorted(doc, np.arange(part.n + 1))
                n = np.diff(bounds)
                marks = [_set_hash(keys, bounds, seed) for seed in (1, 2)]
                _, rank = ordered(doc, keys, frequent)
                ends = bounds[:-1] + np.where(n > 0, early(n, percent), 0)
                blobs = [pack(rank[a:b] & low) for a, b in zip(bounds[:-1].tolist(), ends.tolist(), strict=True)]
                sketch = [x.tobytes() for x in sketches(doc, keys, part.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, part.n), pa.array(n), *map(pa.array, marks), pa.array(blobs, pa.binary()), pa.array(sketch, pa.binary())], ["id", "n", "s1", "s2", "early", "sketch"])
        release()

    rows = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text))
    return rows.mapInArrow(profile, "id long, n long, s1 long, s2 long, early binary, sketch binary")


def _set_hash(keys: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys + U64(seed)), dtype=U64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64)).view(np.int64)


#: Of an entry of a shard: item, node, size of its set, the item's place in it.
ENTRY = ("u8", "i8", "u4", "u4")


def shared_items(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, packed entries) of the early items that two nodes or more have: one row a shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [unpack(x, "u8")[0] for x in batch.column("early").to_pylist()]
            if not items:
                continue
            size = np.array([len(x) for x in items])
            keys = np.concatenate(items)
            row = np.repeat(np.arange(len(items)), size)
            place = (np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
            node, n = batch.column("node").to_numpy()[row], batch.column("n").to_numpy().astype(np.uint32)[row]
            mixed = mix(keys)  # the order's levels are uneven, shards should not be
            order = np.argsort(mixed >> U64(32), kind="stable")
            yield blob_batch(list(blob_rows(shard_of(mixed[order], shards), shards, keys[order], node[order], n[order], place[order])))
        release()

    def find(key: tuple, table: pa.Table) -> pa.Table:
        keys, node, n, place = joined(table, *ENTRY)
        order = np.lexsort((node, keys))
        keys, node, n, place = keys[order], node[order], n[order], place[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])])  # rows of one node
        keys, node, n, place = keys[new], node[new], n[new], place[new]
        _, starts = grouped(keys)
        many = np.repeat(np.diff(starts) > 1, np.diff(starts))
        rows = [(key[0].as_py(), pack(*(x[many] for x in (keys, node, n, place))))] if many.any() else []
        release()
        return pa.Table.from_batches([blob_batch(rows)])

    return spread(rows.mapInArrow(emit, BLOB), shards).applyInArrow(find, BLOB)


def node_homes(shared: DataFrame) -> DataFrame:
    """(node, shards, home): where each node has shared items, and one of these items, which near copies have in common as a rule."""

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item, node, _, _ = unpack(body, *ENTRY)
                order = np.lexsort((mix(item), node))
                first = order[np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))]
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(np.full(len(first), shard, np.int32)), pa.array((mix(item[first]) >> U64(1)).view(np.int64))], ["node", "shard", "home"])

    return shared.mapInArrow(nodes_of, "node long, shard int, home long").groupBy("node").agg(F.collect_list("shard").alias("shards"), F.min("home").alias("home"))


def by_home(nodes: DataFrame, homes: DataFrame, column: str) -> DataFrame:
    """(shard, packed node and a column) for every shard where the node has shared items; the column is binary or whole numbers."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column(2).value_lengths().to_pylist(), np.int64)
            shard = batch.column(2).flatten().to_numpy().astype(np.int64)
            order = np.argsort(shard, kind="stable")
            row = np.repeat(np.arange(batch.num_rows), size)[order]
            value = batch.column(1)
            wide = np.frombuffer(b"".join(value.to_pylist()), f"V{SKETCH // 8}") if pa.types.is_binary(value.type) else value.to_numpy()
            bounds = np.searchsorted(shard[order], np.arange(int(shard.max()) + 2)) if len(shard) else np.zeros(1, np.int64)
            node, rows = batch.column(0).to_numpy(), []
            for s in np.flatnonzero(bounds[1:] > bounds[:-1]):
                at = row[bounds[s] : bounds[s + 1]]
                rows.append((int(s), node[at].tobytes() + wide[at].tobytes()))
            yield blob_batch(rows)

    return nodes.join(homes.hint("merge"), "node").select("node", column, "shards").mapInArrow(emit, BLOB)


def _unpacked(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, ascending, and their values, rows of `width` bytes."""
    node, value = [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint8)]
    for body in bodies:
        m = len(body) // (8 + width)
        node.append(np.frombuffer(body, np.int64, m))
        value.append(np.frombuffer(body, np.uint8, offset=8 * m).reshape(m, width))
    node, value = np.concatenate(node), np.concatenate(value)
    order = np.argsort(node)
    return node[order], value[order]


class Shard:
    """Entries of a shard in order of item and size; per entry the row of its node's sketch and the node's component."""

    def __init__(self, left: pa.Table, right: pa.Table):
        item, node, n, place = joined(left, *ENTRY)
        order = np.lexsort((n, item))
        self.item, self.node = item[order], node[order]
        self.n, self.place = n[order].astype(np.int64), place[order].astype(np.int64)
        kinds = right.column("kind").to_pylist()
        bodies = right.column("body").to_pylist()
        known, sketch = _unpacked([b for b, k in zip(bodies, kinds, strict=True) if k == 0], SKETCH // 8)
        self.sketch = np.ascontiguousarray(sketch).view(U64)
        self.row = np.searchsorted(known, self.node)
        labelled, component = _unpacked([b for b, k in zip(bodies, kinds, strict=True) if k == 1], 8)
        self.component = self.node.copy()
        if len(labelled):
            at = np.minimum(np.searchsorted(labelled, self.node), len(labelled) - 1)
            self.component = np.where(labelled[at] == self.node, np.ascontiguousarray(component).view(np.int64).reshape(-1)[at], self.node)

    def possible(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the entries' sets can be similar, by sizes, places and sketches."""
        n, m = self.n[i], self.n[j]
        overlap = needed(n, m, percent)
        out = np.minimum(n - self.place[i], m - self.place[j]) >= overlap
        out &= np.minimum(n, m) >= overlap
        at = np.flatnonzero(out)
        differ = np.bitwise_count(self.sketch[self.row[i[at]]] ^ self.sketch[self.row[j[at]]]).sum(1)
        out[at] = differ <= (n + m - 2 * overlap)[at]
        return out


def by_shard(shared: DataFrame, marks: list[DataFrame], shards: int, propose, schema: str) -> DataFrame:
    """propose(Shard) for every shard; marks: sketches of the nodes by shard, then the components of some."""
    right = marks[0].withColumn("kind", F.lit(0))
    for more in marks[1:]:
        right = right.unionByName(more.withColumn("kind", F.lit(1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return propose(Shard(left, right)) if left.num_rows else pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]).empty_table()
        finally:
            release()

    return shared.repartition(shards, "shard").groupBy("shard").cogroup(right.repartition(shards, "shard").groupBy("shard")).applyInArrow(run, schema)


def _counted(pairs: list[np.ndarray]) -> pa.Table:
    """a, b and how often each pair is there; pairs of smaller and larger node."""
    whole = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    order = np.lexsort((whole[:, 1], whole[:, 0]))
    whole = whole[order]
    first = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]).any(1)])) if len(whole) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(whole)]])) if len(whole) else first
    return pa.Table.from_arrays([pa.array(whole[first, 0]), pa.array(whole[first, 1]), pa.array(times)], ["a", "b", "n"])


PAIRS = "a long, b long, n long"


def offered_pairs(shared: DataFrame, marks: list[DataFrame], shards: int, percent: int, most: int = OFFERS) -> DataFrame:
    """For each node, up to `most` pairs with other nodes, linear in the shared items.

    Each item's nodes are paired with their pivot, and with neighbours in the order of size and in one at
    random.  Of a node's offers that can be similar, those with the most shared items are taken.
    """

    def propose(shard: Shard) -> pa.Table:
        place = np.arange(len(shard.item))
        _, starts = grouped(shard.item)
        size = np.diff(starts)
        order = np.lexsort((mix(shard.node.astype(U64)), shard.place, shard.item))
        chosen = [(place, np.repeat(order[starts[:-1]], size))]
        for order in (place, np.lexsort((mix(shard.node.astype(U64)), shard.item))):
            i, j = order[:-1], order[1:]
            same = shard.item[i] == shard.item[j]
            chosen.append((i[same], j[same]))
        pairs = []
        for i, j in chosen:
            differ = shard.node[i] != shard.node[j]
            i, j = i[differ], j[differ]
            ok = shard.possible(i, j, percent)
            a, b = shard.node[i[ok]], shard.node[j[ok]]
            pairs.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        return _counted(pairs)

    offers = by_shard(shared, marks, shards, propose, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), F.xxhash64("a", "b"))
    ranked = offers.withColumn("node", F.explode(F.array("a", "b"))).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= most).select("a", "b").distinct()


def cross_pairs(shared: DataFrame, marks: list[DataFrame], shards: int, percent: int) -> DataFrame:
    """For each shared item, every pair of nodes of different components that can be similar.

    Only nodes outside the item's largest component look for partners, among all of its nodes within
    their range of sizes; so a group of copies that is joined already costs nothing.
    """

    def propose(shard: Shard) -> pa.Table:
        _, starts = grouped(shard.item)
        size = np.diff(starts)
        group = np.repeat(np.arange(len(size)), size)
        # the largest component of each group
        order = np.lexsort((shard.component, group))
        new = np.flatnonzero(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (shard.component[order][1:] != shard.component[order][:-1])]))
        times = np.diff(np.concatenate([new, [len(order)]]))
        run = np.lexsort((times, group[order][new]))
        last = np.flatnonzero(np.concatenate([group[order][new][run][1:] != group[order][new][run][:-1], [True]]))
        bulk = shard.component[order][new][run][last]
        seeks = np.flatnonzero(shard.component != bulk[group])
        if not len(seeks):
            return _counted([])
        # partners: the run of its group with sizes from percent of its own up; among the seekers the earlier entry asks
        keyed = group << 32 | shard.n
        lo = np.searchsorted(keyed, group[seeks] << 32 | -(-percent * shard.n[seeks] // 100), "left")
        hi = np.searchsorted(keyed, group[seeks] << 32 | (100 * shard.n[seeks] // percent), "right")
        seeking = np.zeros(len(group), bool)
        seeking[seeks] = True
        total = np.cumsum(hi - lo)
        found, at = [], 0
        while at < len(seeks):  # some pairs at a time
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            width = (hi - lo)[at:to]
            i = np.repeat(seeks[at:to], width)
            j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[at:to], width)
            ok = (shard.component[i] != shard.component[j]) & (~seeking[j] | (j > i))
            i, j = i[ok], j[ok]
            ok = shard.possible(i, j, percent)
            a, b = shard.node[i[ok]], shard.node[j[ok]]
            found.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0))
            at = to
        return _counted(found)

    return by_shard(shared, marks, shards, propose, PAIRS).select("a", "b").distinct()


def _bloom_bits(ids: np.ndarray, size: int) -> np.ndarray:
    h = mix(ids.astype(U64))
    return np.concatenate([(h >> U64(s)) & U64(size - 1) for s in (0, 30)]).astype(np.int64)


def _bloom(ids: DataFrame, size: int) -> np.ndarray:
    """A table of `size` bits that holds all ids of the one column, and some others."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_bloom_bits(batch.column(0).to_numpy(), size)] = True
        for i, part in enumerate(np.split(np.packbits(bits), 64)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(part)], pa.binary())], ["shard", "body"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(size // 8 // 64, np.uint8)
        for body in table.column("body").to_pylist():
            out |= unpack(body, "u1")[0]
        return pa.Table.from_batches([blob_batch([(key[0].as_py(), pack(out))])])

    out = np.zeros(size // 8, np.uint8).reshape(64, -1)
    for row in ids.mapInArrow(fill, BLOB).groupBy("shard").applyInArrow(merge, BLOB).collect():  # 64 rows at most
        out[row.shard] = unpack(bytes(row.body), "u1")[0]
    return out.reshape(-1)


def node_bodies(homes: DataFrame, documents: DataFrame, nodes: DataFrame, width: int, text: str, doc_id: str, key: int) -> DataFrame:
    """(node, home, text compressed) of every node that shares an early item, in one pass over the documents.

    With up to BLOOM_IDS such nodes the pass gets a bit table of their ids and sends on few other texts;
    beyond that all texts meet the nodes in the join.
    """
    wanted = stored(nodes.join(homes.select("node", "home").hint("merge"), "node").select("node", "home", "id", "s1"), "wanted")
    count = wanted.count()
    size = max(1 << 16, 1 << (16 * count).bit_length())
    table = zstandard.ZstdCompressor(level=1).compress(_bloom(wanted.select("id"), size).tobytes()) if count <= BLOOM_IDS else None

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(table), np.uint8) if table else None
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), np.arange(batch.num_rows)
            if bits is not None:
                at = _bloom_bits(ids, size).reshape(2, -1)
                rows = np.flatnonzero(((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0))
            if not len(rows):
                continue
            texts = Texts.of(batch.column(1).take(pa.array(rows)))
            for first, part in texts.chunks():
                doc, keys = shingle_hashes(part, width, key)
                s1 = _set_hash(keys, np.searchsorted(doc, np.arange(part.n + 1)), 1)
                packer = zstandard.ZstdCompressor(level=3)
                blobs = [packer.compress(part.bytes_of(i)) for i in range(part.n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[first : first + part.n]]), pa.array(s1), pa.array(blobs, pa.binary())], ["id", "s1", "body"])
        release()

    rows = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text)).mapInArrow(pick, "id long, s1 long, body binary")
    bodies = stored(rows.join(wanted.hint("merge"), ["id", "s1"]).dropDuplicates(["node"]).select("node", "home", "body"), "bodies")
    discard(wanted)
    return bodies


def verified(pairs: DataFrame, bodies: DataFrame, cells: int, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], key: int) -> DataFrame:
    """The pairs (a, b), which must be a stored table, that are similar."""
    # a pair belongs to the cell of a's home; a cell of too many pairs is cut along both sides
    cell = F.pmod(F.xxhash64("home"), F.lit(cells)).alias("cell")
    placed = pairs.join(bodies.select(F.col("node").alias("a"), cell).hint("merge"), "a")
    sizes = placed.groupBy("cell").agg(F.ceil(F.sqrt(F.count("*") / CELL_PAIRS)).alias("cuts"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    placed = stored(placed.join(sizes, "cell").select("a", "b", F.xxhash64("cell", side("a"), side("b")).alias("at")), "placed")
    sent = placed.select("at", F.explode(F.array("a", "b")).alias("node")).distinct().join(bodies.select("node", "body").hint("merge"), "node").select(F.col("at").alias("to"), "node", "body")

    def sets(column: pa.ChunkedArray) -> list[np.ndarray]:
        out, opener = [], zstandard.ZstdDecompressor()
        for _, part in Texts.of(pa.array([opener.decompress(x) for x in column.to_pylist()], pa.binary())).chunks():
            doc, rank = ordered(*shingle_hashes(part, width, key), frequent)
            out += np.split(rank, np.searchsorted(doc, np.arange(1, part.n)))
        return out

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (left.column(c).to_numpy() for c in "ab")
        if len(a):
            right = right.sort_by("node")
            node = right.column("node").to_numpy()
            ok = PrefixTree(sets(right.column("body"))).similar(np.searchsorted(node, a), np.searchsorted(node, b), percent)
            a, b = a[ok], b[ok]
            release()
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = stored(placed.repartition(cells, "at").groupBy("at").cogroup(sent.repartition(cells, "to").groupBy("to")).applyInArrow(check, "a long, b long"), "verified")
    discard(placed)
    return links


class Prepared:
    """What both results start from: documents without text, their nodes, the shared items, sketches by shard, and texts of nodes."""

    def __init__(self, documents: DataFrame, width: int, percent: int, text: str, doc_id: str, shards: int | None):
        counted, dropped = shard_number(documents, text)
        self.shards, self.key = shards or counted, secrets.randbits(64)
        self.frequent = _frequent(documents, text, width, self.key)
        whole = stored(profiles(documents, self.frequent, width, percent, text, doc_id, self.key, dropped), "profiles")
        self.rows = stored(whole.drop("early", "sketch"), "rows")
        sets = self.rows.where(F.col("n") > 0).groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
        self.nodes = stored(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
        one_each = whole.select("id", "s1", "s2", "early", "sketch").join(self.nodes.hint("merge"), ["id", "s1", "s2"])
        self.shared = stored(shared_items(one_each.select("node", "n", "early"), self.shards), "shared")
        self.homes = stored(node_homes(self.shared), "homes")
        self.marks = stored(by_home(one_each.select("node", "sketch").dropDuplicates(["node"]), self.homes, "sketch"), "marks")
        discard(whole)
        self.bodies = node_bodies(self.homes, documents, self.nodes, width, text, doc_id, self.key)

    def check(self, pairs: DataFrame, width: int, percent: int) -> DataFrame:
        out = verified(pairs, self.bodies, self.shards, width, percent, self.frequent, self.key)
        discard(pairs)
        return out


def link_table(documents: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """a_s1, a_s2, a_id, b_s1, b_s2, b_id: every pair of different sets that are similar, once, with the least id of each.

    Pairs inside a component are decided like all others, so a group of n different near copies gives up
    to n * (n - 1) / 2 rows.  The hashes, keyed anew in each run, tell different sets of one id apart.
    """
    it = Prepared(documents, width, percent, text, doc_id, shards)
    links = it.check(stored(cross_pairs(it.shared, [it.marks], it.shards, percent), "pairs"), width, percent)
    for end in ("a", "b"):
        links = links.join(it.nodes.select(F.col("node").alias(end), F.col("s1").alias(f"{end}_s1"), F.col("s2").alias(f"{end}_s2"), F.when(F.col("id") != NO_ID, F.col("id")).alias(f"{end}_id")), end)
    return links.select("a_s1", "a_s2", "a_id", "b_s1", "b_s2", "b_id")


def component_table(documents: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of documents."""
    it = Prepared(documents, width, percent, text, doc_id, shards)
    links = it.check(stored(offered_pairs(it.shared, [it.marks], it.shards, percent), "pairs"), width, percent)
    known = stored(components(links), "known")
    labels = by_home(known.where("node <> component"), it.homes, "component")
    rest = it.check(stored(cross_pairs(it.shared, [it.marks, labels], it.shards, percent), "pairs"), width, percent)
    discard(it.shared, it.marks, it.bodies, it.homes, links)
    for end in ("a", "b"):  # links between components as links of their least nodes
        label = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
        rest = rest.join(label, end, "left").withColumn(end, F.coalesce(f"{end}_of", end)).drop(f"{end}_of")
    more = stored(components(rest), "more")
    whole = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    whole = whole.unionByName(more.join(known.select("node"), "node", "left_anti"))
    placed = it.nodes.select("node", "s1", "s2", "id").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = placed.join(least, "component").select("s1", "s2", "component_id")
    out = it.rows.join(placed, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    clean = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(clean("id").alias("doc_id"), F.col("n").alias("n_shingles"), clean("component_id").alias("component_id"))


def keep_one(documents: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents without those that have a smaller id in their component.

    Of equal rows with an id one stays.  An id goes only if all of its rows have a smaller one; rows with a null id all stay.
    """
    table = stored(component_table(documents, width, percent, text, doc_id), "components")
    by_id = table.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("component_id").alias("most"), F.count("*").alias("rows"))
    gone = stored(by_id.where(F.col("most") < F.col("doc_id")).select(F.col("doc_id").alias(doc_id)), "gone")
    kept = documents.join(gone, doc_id, "left_anti")
    if not by_id.where(F.col("rows") > 1).limit(1).count():
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text]).unionByName(kept.where(F.col(doc_id).isNull()))
