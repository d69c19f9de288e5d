"""Word and byte window removal against a brute-force version."""

import random

import pytest

from llm.phrase_automata import remove_repeated_phrases
from llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, b string, shard int"


def brute(rows, split, width):
    """Per row: items, and which of them go."""
    items = [split(text) for _, text in rows]
    least = {}
    for (doc_id, _), seq in zip(rows, items):
        for i in range(len(seq) - width + 1):
            key = tuple(seq[i : i + width])
            order = float("inf") if doc_id is None else doc_id
            least[key] = min(least.get(key, order), order)
    out = []
    for (doc_id, _), seq in zip(rows, items):
        gone = [False] * len(seq)
        for i in range(len(seq) - width + 1):
            if least[tuple(seq[i : i + width])] < (float("inf") if doc_id is None else doc_id):
                gone[i : i + width] = [True] * width
        out.append((seq, gone))
    return out


def corpus(seed, n=60, vocabulary=9):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(vocabulary)}é" for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        rows.append((rng.randrange(50) if i % 7 else i, "".join(w + rng.choice([" ", " ", "\n", "  ", " "]) for w in words)))
    rows += [(3, "same text " * 9), (3, "same text " * 9), (70, "same text " * 9), (71, None), (72, ""), (73, "x" * 300), (74, "x" * 120), (None, "x" * 90), (None, passages[0] and " ".join(passages[0]))]
    rng.shuffle(rows)
    return rows


def words_of(text):
    return (text or "").encode().split()


def bytes_of(text):
    return list((text or "").encode())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "b", 7) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, remove_repeated_phrases(frame, 5, shards=4).select("doc_id", "n_words", "n_removed", "text", "b", "shard").collect()), key=str)
    want = sorted(((i, len(seq), sum(gone), b" ".join(w for w, g in zip(seq, gone) if not g).decode(), "b", 7) for (i, _), (seq, gone) in zip(rows, brute(rows, words_of, 5))), key=str)
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "b", 7) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in remove_repeated_bytes(frame, 18, shards=4).collect()), key=str)
    want = sorted(((i, len(seq), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), bytes(w for w, g in zip(seq, gone) if not g)) for (i, _), (seq, gone) in zip(rows, brute(rows, bytes_of, 18))), key=str)
    assert got == want


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_phrases(frame).collect() == []
    assert remove_repeated_bytes(frame).collect() == []
