"""Substring dedup by repeated-phrase automata (word windows).

A window is `window` consecutive words of one document.  A word goes if a window that covers it also
starts in a document with a smaller id; windows are judged on the input.  Each shard confirms which
windows recur under two ids, joins neighbouring ones into passages, compiles the passages into an
Aho-Corasick automaton (pyahocorasick) over words, one code point per word, and streams all stretches
of text routed to it through the automaton, so that every occurrence is located.  Documents with no stretch that could recur send none; see
``llm.repeats`` for the routing and for the defined results on nulls, repeats and empty input.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from llm.repeats import NO_ID, Stretches, cut_repeats
from llm.text_arrays import U64, grouped, mix, prefix_hashes, window_hashes

WINDOW_WORDS = 13
KEY_WORDS = 5


def _letter(n: int) -> str:
    """The n-th code point that is not a surrogate."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)


def _passages(seg: np.ndarray, at: np.ndarray, stretches: Stretches, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First and last window of each passage, on one holder, and how many windows all passages' occurrences hold.

    Windows of equal keys are a group; groups under one id only are left out.  A passage is a chain of groups
    each of which follows the one before wherever that occurs, and nowhere else: so no window is in two passages,
    and where one of its windows occurs, the whole passage does.
    """
    order, starts = grouped(keys)
    size, n = np.diff(starts), len(starts) - 1
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(n), size)
    recurs = np.minimum.reduceat(stretches.least[seg][order], starts[:-1]) != np.maximum.reduceat(stretches.most[seg][order], starts[:-1])
    beside = (seg[1:] == seg[:-1]) & (at[1:] == at[:-1] + 1)
    after, before = np.full((2, len(keys)), -1)
    after[:-1][beside], before[1:][beside] = group[1:][beside], group[:-1][beside]

    def only(near: np.ndarray) -> np.ndarray:
        low, high = np.minimum.reduceat(near[order], starts[:-1]), np.maximum.reduceat(near[order], starts[:-1])
        return np.where(low == high, low, -1)

    follower, leader = only(after), only(before)
    goes_on = (follower >= 0) & (leader[follower] == np.arange(n)) & recurs & recurs[follower]
    head = recurs.copy()
    head[follower[goes_on]] = False
    first = order[starts[:-1]][head]
    closes = np.flatnonzero(~goes_on[group])
    return first, closes[np.searchsorted(closes, first)], int(size[recurs].sum())


def _occurrences(lines: list[str], passages: list[str], window: int) -> np.ndarray:
    """(stretch, first window, windows, passage) of every occurrence, by an automaton over the passages."""
    automaton = ahocorasick.Automaton()
    for number, passage in enumerate(passages):
        automaton.add_word(passage, (len(passage), number))
    automaton.make_automaton()
    found = [(i, end + 1 - size, size - window + 1, number) for i, line in enumerate(lines) for end, (size, number) in automaton.iter(line)]
    return np.array(found, np.int64).reshape(-1, 4)


def _locate(stretches: Stretches, shards: int, window: int) -> pa.Table:
    letters: dict[bytes, str] = {}
    lines = ["".join([letters.get(w) or letters.setdefault(w, _letter(len(letters))) for w in text.split()]) for text in stretches.texts]
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    seg = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + bounds[seg]

    def found_by(keys: np.ndarray) -> tuple[np.ndarray, int]:
        first, last, expected = _passages(seg, at, stretches, keys)
        places = zip(seg[first].tolist(), (at[first] - bounds[seg[first]]).tolist(), (at[last] - bounds[seg[last]] + window).tolist(), strict=True)
        return _occurrences(lines, [lines[s][a:b] for s, a, b in places], window) if len(first) else np.zeros((0, 4), np.int64), expected

    hits = np.zeros((0, 4), np.int64)
    if len(seg):
        hits, expected = found_by(window_hashes(prefix_hashes(mix(codes.astype(U64))), window)[at])
        if hits[:, 2].sum() != expected:  # different windows of one hash: told apart word by word
            hits, _ = found_by(np.unique(codes[at[:, None] + np.arange(window)], axis=0, return_inverse=True)[1])
    stretch, place, windows, passage = hits.T
    low, high = np.full(len(hits), NO_ID), np.full(len(hits), -(2**63))  # there are no more passages than hits
    np.minimum.at(low, passage, stretches.least[stretch])
    np.maximum.at(high, passage, stretches.most[stretch])
    recurs = low[passage] != high[passage]
    stretch, place, windows, passage = hits[recurs].T
    # each window of each occurrence; occurrences come in order and share no window
    pos = np.repeat(place, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return stretches.cuts(np.repeat(stretch, windows), pos, np.repeat(low[passage], windows), window, shards)


def remove_repeated_phrases(documents: DataFrame, window: int = WINDOW_WORDS, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """documents with `text` as the kept words joined by one space, and n_words and n_removed (long).

    An empty table gives an empty table; a document shorter than a window keeps all its words.
    """
    key = max(1, min(KEY_WORDS, window - 1))
    return cut_repeats(documents, "word", key, window, lambda s, n: _locate(s, n, window), text, doc_id, [("kept", text, T.StringType()), ("items", "n_words", T.LongType()), ("removed", "n_removed", T.LongType())], shards)
