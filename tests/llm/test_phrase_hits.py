"""Occurrences of passages against a brute-force version, with hashes that tell windows apart and with ones that don't."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from llm import phrase_automata

WINDOW = 4


def located(stretches):
    """What is handed over to be cut: (stretch, place, least id) of each window."""
    got = []
    stretches.cuts = lambda seg, pos, least, width, shards: got.extend(zip(seg.tolist(), pos.tolist(), least.tolist(), strict=True))
    phrase_automata._locate(stretches, 1, WINDOW)
    return got


def brute(stretches):
    ids = {}
    windows = [(s, p, tuple(t.split()[p : p + WINDOW])) for s, t in enumerate(stretches.texts) for p in range(len(t.split()) - WINDOW + 1)]
    for s, _, w in windows:
        ids.setdefault(w, set()).update([int(stretches.least[s]), int(stretches.most[s])])
    return [(s, p, min(ids[w])) for s, p, w in windows if len(ids[w]) > 1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl"])
@pytest.mark.parametrize("clash", [False, True])
def test_every_window_under_two_ids_is_found(monkeypatch, letters, clash):
    if clash:
        plain = phrase_automata.window_hashes
        monkeypatch.setattr(phrase_automata, "window_hashes", lambda *a: plain(*a) % np.uint64(3))
    rng = random.Random(len(letters))
    for _ in range(60):
        phrases = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(3)]
        texts = [" ".join("".join(rng.choice([*phrases, "xyz", "a"]) for _ in range(rng.randrange(4)))).encode() for _ in range(12)]
        least = np.array([rng.randrange(20) for _ in texts])
        stretches = SimpleNamespace(texts=texts, least=least, most=least + [rng.randrange(2) for _ in texts])
        assert located(stretches) == brute(stretches)


def test_one_passage_is_compiled_once():
    text = "a b c d e f g h".split()
    seen = []
    stretches = SimpleNamespace(texts=[" ".join(text).encode(), " ".join(["x", *text, "y"]).encode()], least=np.array([1, 2]), most=np.array([1, 2]))
    real = phrase_automata._occurrences
    try:
        phrase_automata._occurrences = lambda lines, passages, window: seen.append(passages) or real(lines, passages, window)
        assert len(located(stretches)) == 10
    finally:
        phrase_automata._occurrences = real
    assert [len(p) for p in seen[0]] == [8]
