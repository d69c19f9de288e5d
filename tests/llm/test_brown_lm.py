import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from llm.brown_lm import counted_rows, exchange, score_texts
from llm.repeats import shard_of
from llm.text_arrays import unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def test_exchange_separates_languages():
    rng = np.random.default_rng(1)
    counts = np.zeros((40, 40))
    for k in range(2):
        counts[k::2, k::2] = rng.integers(5, 50, (20, 20))
    of = exchange(counts, 4)
    assert not {*of[::2]} & {*of[1::2]}


def test_scores(spark):
    rng = random.Random(3)
    a, b = [f"Wa{i}é" for i in range(60)], [f"zb{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices((a, b)[i % 2], [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "Wa1é new"), rows[3], (502, "never seen words")]
    got = score_texts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_sum_to_one_at_most(spark):
    """After any word, the probabilities of all known words, the end and one unseen word of each class are below one."""
    rows = [(i, "a b a c b a") for i in range(20)] + [(100 + i, t) for i, t in enumerate(["a", "b", "c", ""])]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = sum(10 ** got[100 + i] for i in range(4))
    assert 0 < first < 1


def test_rare_words_are_exchanged(spark):
    """Words beyond the 1,024 most frequent have classes by their neighbours: two languages of words of one form."""
    rng = random.Random(4)
    languages = [[f"{i:04d}xx" for i in range(k, 4000, 2)] for k in range(2)]
    rows = [(i, " ".join(rng.choices(languages[i % 2], k=60))) for i in range(1000)]
    probes = [(2000 + i, [rng.choice(languages[0]) for _ in range(40)], [rng.choice(languages[1]) for _ in range(40)]) for i in range(20)]
    apart = [(i, " ".join(a + b)) for i, a, b in probes]
    mixed = [(i + 1000, " ".join(w for pair in zip(a, b, strict=True) for w in pair)) for i, a, b in probes]
    ids = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1]  # all held out
    texts = [t for _, t in apart] + [t for _, t in mixed]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows + list(zip(ids[:40], texts, strict=True)), "doc_id long, text string").repartition(3)).collect()}
    assert all(got[a] > got[b] + 5 for a, b in zip(ids[:20], ids[20:40], strict=True))


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cells_are_counted_in_little_memory():
    """What shards get is what a count of all cells at once gives, without arrays as large as all cells."""
    rng = np.random.default_rng(3)
    cells = np.sort(np.concatenate([rng.integers(0, 2**64, 60_000, np.uint64).repeat(5), np.zeros(3, np.uint64), np.full(2, 2**64 - 1, np.uint64)]))
    for shards in (64, 67, 1):
        tracemalloc.start()
        got = [*counted_rows(cells, shards)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        keys, n = np.unique(cells, return_counts=True)
        of = shard_of(keys, shards)
        assert [s for s, _ in got] == sorted({*of.tolist()})
        for s, body in got:
            k, m = unpack(body, "u8", "u4")
            assert (k == keys[of == s]).all() and (m == n[of == s]).all()
        assert shards == 1 or peak < cells.nbytes
    assert [*counted_rows(cells[:0], 64)] == []
