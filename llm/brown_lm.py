"""Language-model scoring with class-based bigrams from exchange clustering.

A word's class is found by exchange clustering.  The words with the most bigram evidence move first, one
at a time, to the class that most raises the class bigram likelihood, until none moves.  Then every word
that training holds EXCHANGE_COUNT times or more is put, in SWEEPS sweeps, where the same gain is
largest: Spark counts each word's neighbours by class over all training text, and the words of a sweep
move together, each judged as if the others stayed.  Only rarer words and words never seen belong to a
class by their form (length, last bytes, letters outside ASCII).  Classes are a table that words meet in
a join, so no table of all words is ever broadcast.  The model is

    P(word | previous) = P(class | previous class) * P(word | class)

with class transitions interpolated with class frequencies, and additive smoothing in each class that
leaves a share to unseen words.  A token that ends each text is a word of a class of its own.

All counts are over all training documents and are aggregated by Spark.  What tasks hold has a proven
bound: HEAD_WORDS frequent words with their counts and classes (the others meet theirs in a join), the
bigrams of EXCHANGE_WORDS of them, and the square of the number of classes.  As neighbours in a sweep,
words outside the HEAD_WORDS stand with their form; the transitions of the model are between the classes
that all words have in the end.

Defined results: null text counts as empty, which is the end token alone; a null id is in training;
no training text gives a uniform model over unseen words; repeated rows are scored and counted one by
one; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.repeats import BLOB, blob_batch, joined, spread
from llm.storage import discard, largest, stored
from llm.text_arrays import U64, Texts, Words, mix, pack, release, unpack

#: Words that are exchanged one at a time, before the sweeps over all.
EXCHANGE_WORDS = 1_024
#: Least occurrences in training of a word that is exchanged.
EXCHANGE_COUNT = 3
SWEEPS = 2
SWEEP_TOKENS = 2_000_000
#: Text that a shard of the words stands for in a sweep.
SHARD_BYTES = 8 << 20
#: Counts whose gains are held ready in a sweep.
SMALL = 32
CLASSES = 96
FORMS = 128
HEAD_WORDS = 1 << 16
ROUNDS = 6
FOLDS, HELD_OUT = 5, 1
INTERPOLATION = 0.95
#: The hash of the end token; no word's hash is known to equal it.
END = U64(0x5851F42D4C957F2D)
END_CLASS = CLASSES + FORMS
#: Codes of a word's neighbours: their class before it, then after it; the word itself after and before it.
AFTER, SELF_AFTER, SELF_BEFORE, CODES = END_CLASS + 1, 2 * END_CLASS + 2, 2 * END_CLASS + 3, 512
#: In sweeps a word is its hash without the bits that hold a code; two words that agree in the rest would share a class.
SHORT = ~U64(CODES - 1)


def exchange(counts: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words from their bigram counts (a square matrix), by exchange clustering.

    Words start in classes by rank.  Each is taken out of its class and put where the sum of
    n log n over class bigrams, less that over class totals, is largest; ties go to the smaller class.
    """
    n = len(counts)
    counts = counts.astype(float)
    of = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = counts @ member, counts.T @ member  # counts of a word before and after each class
    table = member.T @ right
    after, before = table.sum(1), table.sum(0)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            c, r, l, own = of[w], right[w].copy(), left[w].copy(), counts[w, w]
            # take w out
            table[c] -= r
            table[:, c] -= l
            table[c, c] += own
            after[c] -= r.sum()
            before[c] -= l.sum()
            r[c] -= own
            l[c] -= own
            # gain of putting it into each class; the corner cell gets both sides and its own pairs
            rows = (xlogx(table + r) - xlogx(table)).sum(1)
            columns = (xlogx(table + l[:, None]) - xlogx(table)).sum(0)
            corner = np.diag(table)
            gain = rows + columns - (xlogx(corner + r) - xlogx(corner)) - (xlogx(corner + l) - xlogx(corner)) + (xlogx(corner + r + l + own) - xlogx(corner))
            sr, sl = r.sum() + own, l.sum() + own
            gain -= xlogx(after + sr) - xlogx(after) + xlogx(before + sl) - xlogx(before)
            best = int(np.argmax(gain))
            table[best] += r
            table[:, best] += l
            table[best, best] += own
            after[best] += sr
            before[best] += sl
            if best != c:
                moved += 1
                of[w] = best
                right[:, c] -= counts[:, w]
                right[:, best] += counts[:, w]
                left[:, c] -= counts[w]
                left[:, best] += counts[w]
        if not moved:
            break
    return of


def _forms(words: Words) -> np.ndarray:
    """The form class of each word: a hash of its last bytes, length and kind of letters."""
    last = words.data[words.end - 1].astype(U64)
    second = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(U64)
    size = np.minimum((words.end - words.start) // 3, 5).astype(U64)
    wide = np.concatenate([[0], np.cumsum(words.data >= 128)])
    kind = (wide[words.end] > wide[words.start]).astype(U64)
    return (mix(last | second << U64(8) | size << U64(16) | kind << U64(24)) % U64(FORMS)).astype(np.int64) + CLASSES


class Tokens:
    """Hashes of a run of texts' tokens: each text's words, then the end token."""

    def __init__(self, texts: Texts):
        self.words = Words(texts, lower=True)
        self.size = self.words.counts + 1
        self.ends = np.cumsum(self.size)
        self.is_word = np.ones(int(self.ends[-1]) if len(self.ends) else 0, bool)
        self.is_word[self.ends - 1] = False
        self.key = np.full(len(self.is_word), END, U64)
        self.key[self.is_word] = self.words.hash
        self.doc = np.repeat(np.arange(texts.n), self.size)

    def classes(self, model: WordClasses) -> np.ndarray:
        out = np.full(len(self.key), END_CLASS, np.int64)
        out[self.is_word] = model.of(self.words)
        return out


@dataclass
class WordClasses:
    """Classes of the most frequent words by hash (ascending); the others' come from their form."""

    keys: np.ndarray
    classes: np.ndarray

    def of(self, words: Words) -> np.ndarray:
        out = _forms(words)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words.hash), len(self.keys) - 1)
            known = self.keys[at] == words.hash
            out[known] = self.classes[at[known]]
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def _word_counts(training: DataFrame) -> DataFrame:
    """key, form and n of every distinct token."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, forms, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], forms[order][first], np.add.reduceat(n[order], first) if len(first) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size, least = [], 0, SWEEP_TOKENS // 4
            for _, part in Texts.of(batch.column(0)).chunks():
                tokens = Tokens(part)
                keys, first, n = np.unique(tokens.key, return_index=True, return_counts=True)
                form = np.full(len(tokens.key), END_CLASS, np.int32)
                form[tokens.is_word] = _forms(tokens.words)
                parts.append((keys, form[first], n))
                size += len(keys)
                if size > least:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    least = max(SWEEP_TOKENS // 4, 2 * size)
            if parts:
                keys, forms, n = merged(parts)
                yield _batch("key form n", keys.view(np.int64), forms, n)
        release()

    return training.select("text").mapInArrow(count, "key long, form int, n long").groupBy("key").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def _bigrams(training: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts of adjacent pairs of the given words (hashes ascending), over all training text."""
    m = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).chunks():
                words = Words(part, lower=True)
                at = np.minimum(np.searchsorted(keys, words.hash), m - 1)
                known = keys[at] == words.hash
                both = known[1:] & known[:-1] & (words.doc[1:] == words.doc[:-1])
                total += np.bincount(at[:-1][both] * m + at[1:][both], minlength=m * m)
        cells = np.flatnonzero(total)
        yield _batch("cell n", cells, total[cells])

    out = np.zeros(m * m, np.int64)
    if m:  # at most m * m rows
        rows = training.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        out[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out.reshape(m, m)


def counted_rows(cells: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed distinct cells with their counts) of ascending cells, which are counted a shard at a time."""
    starts = np.array([-(-(s << 32) // shards) << 32 for s in range(shards)], U64)  # what shard_of sends to each shard begins here
    bounds = np.append(np.searchsorted(cells, starts), len(cells))
    for shard in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        part = cells[bounds[shard] : bounds[shard + 1]]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        yield shard, pack(part[first], np.diff(np.append(first, len(part))).astype(np.uint32))


def _neighbours(training: DataFrame, model: WordClasses, core: np.ndarray, shards: int) -> DataFrame:
    """(shard, body): the coded neighbours of the words outside the core, with their counts, packed by shard of the words.

    The rows of shard -1 are not words: they hold the counts of class pairs, by tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, np.zeros(AFTER * AFTER, np.int64)

        def flush() -> pa.RecordBatch:
            cells = np.concatenate([np.zeros(0, U64), *held])
            held.clear()
            cells.sort()
            return blob_batch([*counted_rows(cells, shards)])

        for batch in batches:
            for _, part in Texts.of(batch.column(0)).chunks():
                tokens = Tokens(part)
                if not len(tokens.key):
                    continue
                c, key = tokens.classes(model), tokens.key
                before, after = np.concatenate([[END_CLASS], c[:-1]]), np.concatenate([c[1:], [END_CLASS]])
                total += np.bincount(before * AFTER + c, minlength=len(total))
                same = np.concatenate([[False], key[1:] == key[:-1], [False]])
                before = np.where(same[:-1], SELF_BEFORE, before)
                after = np.where(same[1:], SELF_AFTER, after + AFTER)
                short = key & SHORT
                at = tokens.is_word
                if len(core):
                    at = at & (core[np.minimum(np.searchsorted(core, short), len(core) - 1)] != short)
                held.append(short[at] | before[at].astype(U64))
                held.append(short[at] | after[at].astype(U64))
                size += int(at.sum())
                if size > SWEEP_TOKENS:
                    yield flush()
                    release()
                    size = 0
        yield flush()
        release()
        cells = np.flatnonzero(total)
        yield blob_batch([(-1, pack(cells, total[cells]))])

    return stored(training.select("text").mapInArrow(count, BLOB), "neighbours")


def _class_pairs(neighbours: DataFrame) -> np.ndarray:
    """Counts of class pairs of all tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                yield _batch("cell n", *unpack(body, "i8", "i8"))

    out = np.zeros(AFTER * AFTER)
    sums = neighbours.where("shard = -1").select("body").mapInArrow(rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # AFTER * AFTER rows at most
    out[sums.cell.to_numpy(np.int64)] = sums.n.to_numpy(np.int64)
    return out.reshape(AFTER, AFTER)


def placed_words(neighbours: DataFrame, model: WordClasses, used: int, shards: int) -> DataFrame:
    """(short, class, n) of the words with EXCHANGE_COUNT occurrences: of the first `used` classes, the one of most gain."""
    table = _class_pairs(neighbours)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    after, before, corner = table.sum(1)[:used], table.sum(0)[:used], np.diag(table)[:used]
    model_short = model.keys & SHORT

    def gained(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        return xlogx(cells + n) - xlogx(cells)

    def place(packed: pa.Table) -> pa.Table:
        # right and left neighbours: for each of their classes a row with the cells of all classes, and what these gain by 1, 2, ...
        sides = [(cells, np.stack([gained(cells, n) for n in range(1, SMALL + 1)])) for cells in (table[:used].T, table[:, :used])]
        cells, n = joined(packed, "u8", "u4")
        order = np.argsort(cells)
        cells, n = cells[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        cells, n = cells[first], np.add.reduceat(n, first) if len(first) else n
        short, code = cells & SHORT, (cells & ~SHORT).astype(np.int64)
        words = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(cells) else np.zeros(0, np.int64)
        # words seen too rarely have a class by their form
        left = (code < AFTER) | (code == SELF_BEFORE)
        times = np.add.reduceat(np.where(left, n, 0), words) if len(words) else np.zeros(0, np.int64)
        ends = np.concatenate([words[1:], [len(cells)]]).astype(np.int64)
        enough = times >= EXCHANGE_COUNT
        words, ends, times = words[enough], ends[enough], times[enough]
        load, out, at = np.cumsum(ends - words), [], 0
        while at < len(words):  # some thousand neighbours at a time
            to = min(max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + 8192, "right"))), at + 512)
            size = (ends - words)[at:to]
            row = np.repeat(np.arange(to - at), size)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words[at:to], size)
            out.append(best_classes(short[words[at:to]], row, code[entry], n[entry], sides))
            at = to
        release()
        best = np.concatenate([np.zeros(0, np.int32), *out])
        return pa.Table.from_batches([_batch("short class n", short[words].view(np.int64), best.astype(np.int32), times)])

    def best_classes(keys: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        m = len(keys)
        dense = np.bincount(row * CODES + code, weights=n, minlength=m * CODES).reshape(m, CODES)
        left, right, self_n = dense[:, :AFTER], dense[:, AFTER:SELF_AFTER], dense[:, SELF_AFTER]
        now = np.full(m, END_CLASS)
        if len(model_short):
            found = np.minimum(np.searchsorted(model_short, keys), len(model_short) - 1)
            now = np.where(model_short[found] == keys, model.classes[found], END_CLASS)
        inside = np.flatnonzero(now < used)  # these are in the cells of their own class already
        gain = np.zeros((m, used))
        own = np.zeros(m)
        for side, (cells, ready) in zip((right, left), sides, strict=True):
            word, c = np.nonzero(side)
            if not len(word):
                continue
            n = side[word, c].astype(np.int64)
            parts = ready[np.minimum(n, SMALL) - 1, c]
            large = np.flatnonzero(n > SMALL)
            parts[large] = gained(cells[c[large]], n[large, None])
            held = np.flatnonzero(now[word] < used)
            cell = cells[c[held], now[word[held]]]
            own += np.bincount(word[held], weights=xlogx(cell) - xlogx(np.maximum(cell - n[held], 0)), minlength=m)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            gain[word[first]] += np.add.reduceat(parts, first, axis=0)
        r, l, size = right[:, :used], left[:, :used], (right.sum(1) + self_n, left.sum(1) + self_n)
        gain += gained(corner, r + l + self_n[:, None]) - gained(corner, r) - gained(corner, l)  # the corner cell gets both sides and the word's own pairs
        gain -= gained(after, size[0][:, None]) + gained(before, size[1][:, None])
        at = now[inside]
        lost = lambda cells, n: xlogx(cells) - xlogx(np.maximum(cells - n, 0))
        corners = [lost(corner[at], x[inside]) for x in (r[np.arange(m), np.minimum(now, used - 1)], l[np.arange(m), np.minimum(now, used - 1)], (r + l)[np.arange(m), np.minimum(now, used - 1)] + self_n)]
        gain[inside, at] = own[inside] + corners[2] - corners[0] - corners[1] - lost(after[at], size[0][inside]) - lost(before[at], size[1][inside])
        return np.argmax(gain, axis=1)

    return stored(spread(neighbours.where("shard >= 0"), shards).applyInArrow(place, "short long, class int, n long"), "classes")


def _transitions(sequences: DataFrame) -> np.ndarray:
    """Counts of class pairs in the class sequences; the row of END_CLASS is the start of a text."""
    k = AFTER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            c = Texts.of(batch.column(0)).data.astype(np.int64)
            if len(c):
                before = np.concatenate([[END_CLASS], c[:-1]])  # after an end a text starts
                total += np.bincount(before * k + c, minlength=k * k)
        cells = np.flatnonzero(total)
        yield _batch("cell n", cells, total[cells])

    out = np.zeros(k * k, np.int64)
    rows = sequences.select("classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out.reshape(k, k)


def score_texts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the class model)."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    training = rows.where(~held_out(F.col("doc_id")))
    counts = stored(_word_counts(training), "words")
    head = largest(counts, "n", HEAD_WORDS).toPandas().sort_values(["n", "key"], ascending=[False, True])
    order = np.argsort(head["key"].to_numpy(np.int64).view(U64))
    head_key, head_n = head["key"].to_numpy(np.int64).view(U64)[order], head["n"].to_numpy(np.int64)[order]
    head_class = head["form"].to_numpy(np.int64)[order]
    common = head["key"].to_numpy(np.int64).view(U64)
    common = np.sort(common[common != END][:EXCHANGE_WORDS])
    used = min(CLASSES, max(1, len(common) // 4))
    core = exchange(_bigrams(training, common), used) if len(common) else np.zeros(0, np.int64)
    head_class[np.searchsorted(head_key, common)] = core
    model, placed = WordClasses(head_key, head_class), None
    head_short = (head_key & SHORT).view(np.int64)
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(64, -(-size // SHARD_BYTES)))
    for _ in range(SWEEPS if len(common) else 0):
        neighbours, last = _neighbours(training, model, np.unique(common & SHORT), shards), placed
        placed = placed_words(neighbours, model, used, shards)
        discard(neighbours, *([last] if last is not None else []))
        moved = placed.where(F.col("n") >= int(head_n.min())).toPandas()  # in the head, all of them
        head_class = head_class.copy()
        order = np.argsort(moved["short"].to_numpy(np.int64).view(U64))
        moved_short, moved_class = moved["short"].to_numpy(np.int64).view(U64)[order], moved["class"].to_numpy(np.int64)[order]
        if len(moved_short):
            at = np.minimum(np.searchsorted(moved_short, head_short.view(U64)), len(moved_short) - 1)
            known = moved_short[at] == head_short.view(U64)
            head_class[known] = moved_class[at[known]]
        model = WordClasses(head_key, head_class)
    if placed is None:
        lexicon = counts.select("key", "n", F.col("form").alias("class"))
    else:
        first, at = np.unique(common & SHORT, return_index=True)
        core_rows = rows.sparkSession.createDataFrame([*zip(first.view(np.int64).tolist(), core[at].tolist(), strict=True)], "short long, class int")
        short = F.col("key").bitwiseAND(F.lit(-CODES).cast("long"))
        lexicon = stored(counts.withColumn("short", short).join(placed.select("short", "class").unionByName(core_rows), "short", "left").select("key", "n", F.coalesce("class", "form").alias("class")), "lexicon")
    # sizes of the classes: tokens, and distinct words
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    distinct = np.zeros(END_CLASS + 1)
    for row in lexicon.groupBy("class").agg(F.count("*").alias("n")).collect():
        distinct[row["class"]] = row.n
    base = float(np.log10(total.tokens + 0.5 * (total.words + 1)))
    head_log = np.log10(head_n + 0.5)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with its sums over the head and its tokens' classes, and a row per text and other word."""
        for batch in batches:
            numbers, ids = batch.column(2).to_numpy(), batch.column(1)
            for at, part in Texts.of(batch.column(0)).chunks():
                t = Tokens(part)
                c = t.classes(model).astype(np.uint8)
                known = np.zeros(len(t.key), bool)
                logs = np.full(len(t.key), np.log10(0.5))
                if len(head_key):
                    found = np.minimum(np.searchsorted(head_key, t.key), len(head_key) - 1)
                    known = head_key[found] == t.key
                    logs[known] = head_log[found[known]]
                sums = np.bincount(t.doc, weights=logs, minlength=part.n)
                n_known = np.bincount(t.doc[known], minlength=part.n)
                start = t.ends - t.size
                other = np.flatnonzero(~known)
                other = other[np.lexsort((t.key[other], t.doc[other]))]
                doc, key = t.doc[other], t.key[other]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(doc)]]).astype(np.int32)), pa.array((other - start[doc]).astype(np.int32)))
                row, m = numbers[at : at + part.n], len(new)
                info = np.column_stack([t.size, n_known, sums]).tolist()
                blobs = [c[a:b].tobytes() for a, b in zip(start.tolist(), t.ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.concatenate([row, row[doc[new]]])),
                    pa.array(np.concatenate([mix(row.astype(U64)), key[new]]).view(np.int64)),
                    pa.concat_arrays([pa.nulls(part.n, places.type), places]),
                    pa.concat_arrays([ids.slice(at, part.n).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(info, pa.list_(pa.float64())), pa.nulls(m, pa.list_(pa.float64()))]),
                    pa.concat_arrays([pa.array(blobs, pa.binary()), pa.nulls(m, pa.binary())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "places", "doc_id", "info", "classes"])
        release()

    found = rows.select("text", F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row")).mapInArrow(read, "row long, key long, places array<int>, doc_id long, info array<double>, classes binary")
    joined = found.join(lexicon, (found["key"] == lexicon["key"]) & F.col("places").isNotNull(), "left").withColumn("times", F.size("places"))
    own = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("info").alias("info"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).otherwise(0.0)).alias("logs"),
        F.max("classes").alias("classes"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("class", "places"))).alias("others"),
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the classes of words outside the head put in their places."""
        for batch in batches:
            texts = Texts.of(batch.column(4))
            others = batch.column(5)
            words = others.flatten()
            lists = words.field(1)
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.repeat(np.arange(len(others)), np.diff(others.offsets.to_numpy())), size)
            data = texts.data.copy()
            data[texts.offsets[doc] + lists.flatten().to_numpy()] = np.repeat(words.field(0).to_numpy(), size)
            classes = [data[a:b].tobytes() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(classes, pa.binary())], ["doc_id", "info", "more", "logs", "classes"])
        release()

    sequences = stored(own.select("doc_id", "info", "more", "logs", "classes", "others").mapInArrow(complete, "doc_id long, info array<double>, more long, logs double, classes binary"), "sequences")
    discard(counts, *([placed, lexicon] if placed is not None else []))
    pairs = _transitions(sequences.where(~held_out(F.col("doc_id"))))
    tokens = pairs.sum(0).astype(float)
    emission = np.log10(tokens + 0.5 * (distinct + 1))  # denominator of P(word | class)
    emission[END_CLASS] = np.log10(tokens[END_CLASS] + 0.5)  # the class holds one word, whether seen or not
    share = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    smoothed = (pairs + 2 * share) / (pairs.sum(1, keepdims=True) + 2)
    step = np.log10(INTERPOLATION * smoothed + (1 - INTERPOLATION) * share) - emission

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the sum of the class model's steps instead of the classes."""
        for batch in batches:
            texts = Texts.of(batch.column(4))
            c = texts.data.astype(np.int64)
            doc = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
            steps = np.bincount(doc, weights=step[np.concatenate([[END_CLASS], c[:-1]]), c], minlength=texts.n) if len(c) else np.zeros(texts.n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(steps)], ["doc_id", "info", "more", "logs", "steps"])

    own = sequences.mapInArrow(score, "doc_id long, info array<double>, more long, logs double, steps double")
    n_tokens, logs = F.col("info")[0], F.col("info")[2] + F.col("logs")
    score_sum = logs + F.col("steps")
    return own.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), n_tokens.cast("long").alias("n_tokens"), (F.col("info")[1].cast("long") + F.col("more")).alias("n_known"),
        F.lit(total.tokens).cast("long").alias("train_tokens"), (logs - n_tokens * base).alias("base_score"), score_sum.alias("score"), F.pow(F.lit(10.0), -score_sum / n_tokens).alias("perplexity"),
    )
