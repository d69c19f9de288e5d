import re

import numpy as np
import pyarrow as pa

from llm.quality import FEATURES, fit_quality, fit_trees, judge, statistics
from llm.text_arrays import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a b c d e a b c d e", "one two\none two\n\n \none two\nthree", "é #x $$\r\n<b> " * 5, "w " * 40, "\n\nab\nab", " lead", "x\n", "\n", "a b c d e f a b c d e", "l1 l1 \x1c \x85z", "tail line\ntail line"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            cover |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_statistics():
    counts, x = statistics(Texts.of(pa.array(TEXTS)))
    assert list(zip(*(c.tolist() for c in counts.values()))) == [brute(t) for t in TEXTS]
    assert x.shape == (len(TEXTS), len(FEATURES)) and np.isfinite(x).all()


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    trees = fit_trees(x[:2000], y[:2000], [1, -1, 0, 0])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    line = np.zeros((50, 4))
    line[:, 1] = np.linspace(-3, 3, 50)
    assert (np.diff(trees.score(line)) <= 1e-12).all()


def test_judge(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(30)), 1, "x") for i in range(100)]
    bad = [(i, " ".join(f"#{(i * 7 + k * k) % 97}$$" for k in range(30)), 0, "x") for i in range(100, 200)]
    rows = [*good, *bad, good[0], (None, None, None, "x"), (500, "", None, "x")]
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, kept2 string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = judge(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id < 100) for r in got)
    assert [r for r in got if r.doc_id == 500][0].base_failed
    assert judge(docs.limit(0), None).collect() == []
    assert fit_quality(docs, labels.limit(0)) is None


def test_few_labels_are_fitted(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(30)), 1) for i in range(20)]
    bad = [(i, " ".join(f"#{(i * 7 + k * k) % 97}$$" for k in range(30)), 0) for i in range(100, 120)]
    for n in (1, 3, 20):
        docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in good[:n] + bad[:n]], "doc_id long, quality int")
        assert all(r.kept == (r.doc_id < 100) for r in judge(docs, fit_quality(docs, labels)).collect())
