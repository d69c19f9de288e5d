"""Quality rules: document statistics, two fixed rules, and gradient-boosted trees over the rest.

Statistics come from whole texts, computed for a batch of documents at a time on flat arrays.  The
trees are fitted here, by histogram boosting of the logistic loss with monotonic constraints on chosen
features (more repetition or more symbols never raises the score), on a bounded sample of labelled
documents: at most SAMPLE_ROWS labels, chosen by hash.  They are flattened into numpy node arrays,
and a batch is scored by walking all rows down one level at a time.  Everything else covers all rows.

Defined results: null or empty text has no words and is rejected by rule; documents without labels are
scored like others; without any usable labels only the rules decide; repeated rows are judged one by
one; an empty table gives an empty table; input columns with the name of an output (in any case) are
replaced, and all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.columns import numbered, place, untouched
from llm.text_arrays import PROCESS_KEY, Texts, Words, content_hashes, prefix_hashes, window_hashes

SAMPLE_ROWS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Share of the labelled good documents that the threshold must keep.
KEEP_GOOD = 0.998
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"#*$%&|<>")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
_KIND[list(b".,;:!?")] = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature names with the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "unique_share": 0,
    "digit_share": 0, "upper_share": 0, "punctuation_per_word": 0, "wide_share": 0, "words_per_line": 0, "longest_word": 0, "one_char_share": 0,
}


def _per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def _equal_earlier(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have an equal key earlier in the same document; entries are in order."""
    order = np.lexsort((keys, doc))
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = again
    return out


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS and the features, a row for each text."""
    words, n = Words(texts, key=PROCESS_KEY), texts.n
    data, kind = texts.data, _KIND[texts.data]
    n_words = words.counts.astype(np.int64)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    sizes = chars[words.end] - chars[words.start]
    word_chars = np.bincount(words.doc, weights=sizes, minlength=n).astype(np.int64)
    n_symbols = _per_text(texts, kind == 1)
    # lines: a line ends at \n or with the text
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    opens = np.zeros(len(data) + 2, bool)
    opens[1 : len(data) + 1] = data == 10
    opens[texts.offsets] = True
    start = np.flatnonzero(opens[: len(data)])
    line_doc = texts.doc_of(start)
    end = np.minimum(breaks[np.searchsorted(breaks, start)], texts.offsets[line_doc + 1])
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, line_doc = start[filled], end[filled], line_doc[filled]
    dup = _equal_earlier(content_hashes(data, start, end, PROCESS_KEY), line_doc)
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup_lines = np.bincount(line_doc[dup], minlength=n).astype(np.int64)
    # words in windows that occur again in the same text
    k, total = REPEAT_WINDOW, len(words)
    cover = np.zeros(total + 1, np.int32)
    if total >= k:
        hashes = window_hashes(prefix_hashes(words.hash), k)
        at = np.flatnonzero(words.doc[: total - k + 1] == words.doc[k - 1 :])
        key, doc = hashes[at], words.doc[at]
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        many = np.zeros(len(at), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        np.add.at(cover, at[many], 1)
        np.add.at(cover, at[many] + k, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    n_repeat_words = np.bincount(words.doc[repeated], minlength=n).astype(np.int64)
    seen = _equal_earlier(words.hash, words.doc)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.doc, sizes)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.column_stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / w,
        1 - np.bincount(words.doc[seen], minlength=n) / w, _per_text(texts, kind == 2) / c, _per_text(texts, kind == 3) / c,
        _per_text(texts, kind == 4) / w, _per_text(texts, data >= 0xC0) / c, n_words / np.maximum(n_lines, 1), longest,
        np.bincount(words.doc[sizes == 1], minlength=n) / w,
    ])
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True)), features


@dataclass
class Trees:
    """All trees in flat arrays: leaves point to themselves; a row goes left if its feature is <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cutoff: float = -np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, smallest: int = 20, ridge: float = 1.0) -> Trees:
    """Second-order boosting on binned features.  A split on a constrained feature whose sides would move the wrong way is not taken, and children inherit bounds at its middle."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * smallest:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=len(e) + 1))[:-1] for v in (grad[rows], hess[rows], None))
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                ok = (nl >= smallest) & (len(rows) - nl >= smallest)
                if directions[f]:
                    ok &= (vr - vl) * directions[f] >= 0
                gain = np.where(ok, gain, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (f, i, float(vl[i]), float(vr[i])))
        if best[1]:
            f, i, vl, vr = best[1]
            middle = (vl + vr) / 2
            side = binned[rows, f] <= i
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
            left = grow(rows[side], grad, hess, level + 1, *bounds[0])
            right = grow(rows[~side], grad, hess, level + 1, *bounds[1])
            nodes[me] = [f, float(edges[f][i]), left, right, 0.0]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = Trees(*(np.array([n[i] for n in nodes], k) for i, k in enumerate((int, float, int, int, float))), np.array([first]), depth, 0.0)
        score += tree.score(x)
    arrays = (np.array([n[i] for n in nodes], k) for i, k in enumerate((int, float, int, int, float)))
    return Trees(*arrays, np.array(roots), depth, float(np.log(share / (1 - share))))


def _labelled(documents: DataFrame, labels: DataFrame, sample_rows: int, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample; at most sample_rows of them reach the driver."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    # about 19 of 20 of the rows allowed, by hash: tasks send no more than that
    share = 0.95 * sample_rows / max(1, usable.count())
    chosen = usable if share >= 0.95 else usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = chosen.limit(sample_rows).select(F.col("doc_id").alias("labelled"), "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in Texts.of(batch.column(0)).chunks():
                _, x = statistics(part)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(at, part.n)], ["x", "y"])

    # sample has at most sample_rows rows of two numbers, so it is broadcast
    texts = numbered(documents).select(F.col(f"c{place(documents, doc_id)}").alias("id"), F.col(f"c{place(documents, text)}").alias("body"))
    rows = texts.join(F.broadcast(sample), F.col("id") == F.col("labelled"))
    got = rows.select("body", "quality").mapInArrow(features, "x array<double>, y double").limit(2 * sample_rows).toPandas()
    return np.array(got.x.tolist(), float).reshape(-1, len(FEATURES)), got.y.to_numpy(float)


def fit_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_good: float = KEEP_GOOD, text: str = "text", doc_id: str = "doc_id") -> Trees | None:
    """Trees fitted on a bounded sample of labelled documents; None without two classes among those that pass the rules.

    With few of them a leaf may be smaller than the usual 20 rows, a quarter of all at least.
    """
    x, y = _labelled(documents, labels, sample_rows, text, doc_id)
    passed = rules_pass(np.expm1(x[:, 0]).round(), (x[:, 4] * np.expm1(x[:, 0])).round()) if len(x) else np.zeros(0, bool)
    x, y = x[passed], y[passed]
    order = np.lexsort([*x.T, y])  # the same trees for any order of rows
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return None
    trees = fit_trees(x, y, list(FEATURES.values()), smallest=20 if len(y) >= 50 else max(1, len(y) // 4))
    scores = trees.score(x)
    good = np.sort(scores[y > 0])
    trees.cutoff = float(min(0.0, good[int((1 - keep_good) * len(good))]))
    return trees


def rules_pass(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words >= MIN_WORDS) & (100 * n_repeat_words <= MAX_REPEAT_PERCENT * n_words)


def judge(documents: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """documents with the counts, base_failed, quality_score (null without trees) and kept."""
    added = [*COUNTS, "base_failed", "quality_score", "kept"]
    names, outer = documents.columns, untouched(documents, *added)
    text, others = f"c{place(documents, text)}", [f"c{i}" for i in outer]
    documents = numbered(documents)
    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([documents.schema[c] for c in others] + [T.StructField(f"out_{n}", k) for n, k in zip(added, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in Texts.of(batch.column(text)).chunks():
                counts, x = statistics(part)
                failed = ~rules_pass(counts["n_words"], counts["n_repeat_words"])
                score = trees.score(x) if trees else np.full(part.n, np.nan)
                kept = ~failed & (score >= trees.cutoff if trees else True)
                columns = [batch.column(c).slice(at, part.n) for c in others] + [pa.array(counts[c]) for c in COUNTS]
                columns += [pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.select(*others).mapInArrow(run, schema).toDF(*(names[i] for i in outer), *added)
