import random
import re

import numpy as np
import pytest

from llm.components import components
from llm.ngram_join import component_table, keep_one, link_table, sketches
from llm.prefix_tree import PrefixTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 62), 1 << 62 if doc_id is None else doc_id)
    clean = lambda x: None if x == 1 << 62 else x
    return sorted(((doc_id, len(sets[i]), clean(least[root(i)])) for i, (doc_id, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: [f"W{rng.randrange(30) if rng.random() < 0.3 else rng.randrange(10**6)}é" for _ in range(n)]
    passage, rows = new(30), []
    for _ in range(25):
        words = new(rng.randrange(1, 60)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40) + rng.randrange(2)):
                copy[rng.randrange(len(copy))] = rng.choice(new(1))
            if rng.random() < 0.3:
                copy = copy[: -1 - rng.randrange(3)] or copy
            rows.append((rng.randrange(10**6), rng.choice([" ", "\n"]).join(copy).replace("W", rng.choice("Ww"))))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), rows[0], (rows[0][0], "other text with the same id here"), (None, rows[1][1]), (None, "alone here null id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted(map(tuple, component_table(frame, shards=3).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_all_links(spark):
    """Links between different texts of one component are decided too."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(rng.sample(range(80), 14))]
    rows += [(100 + i, t) for i, t in corpus(8) if i is not None]
    rows = [*dict(rows).items()]
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    least = {}
    for i, s in sets.items():
        least[s] = min(least.get(s, i), i)
    nodes = [(i, s) for s, i in least.items() if s]
    want = sorted((min(i, j), max(i, j)) for k, (i, s) in enumerate(nodes) for j, t in nodes[:k] if 100 * len(s & t) >= 80 * len(s | t))
    got = link_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=3).collect()
    assert sorted((min(r.a_id, r.b_id), max(r.a_id, r.b_id)) for r in got) == want
    assert sum(j < 14 for _, j in want) > 13  # more than hold a component together


def test_tree(monkeypatch):
    rng = random.Random(5)
    sets = [np.unique(np.array(rng.sample(range(40), rng.randrange(1, 25)), np.uint64)) for _ in range(100)]
    base = [rng.randrange(2**63) for _ in range(300)]
    for _ in range(60):  # near copies
        gone = rng.choice([0.05, 0.1, 0.12])
        sets.append(np.unique(np.array([x for x in base if rng.random() > gone] + [rng.randrange(2**63) for _ in range(rng.randrange(30))], np.uint64)))
    sets += [sets[0], sets[1], sets[120]]
    left, right = (np.array([rng.randrange(len(sets)) for _ in range(3000)]) for _ in range(2))
    want = [100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert PrefixTree(sets).similar(left, right, 80).tolist() == want and sum(want) > 50
    monkeypatch.setattr("llm.prefix_tree.STEP_ITEMS", 100)
    assert PrefixTree(sets).similar(left, right, 80).tolist() == want
    assert PrefixTree(sets).similar(left[:0], right[:0], 80).tolist() == []


def test_sketches_never_rule_out_a_link():
    rng = random.Random(6)
    for _ in range(200):
        x = {rng.randrange(2**63) for _ in range(rng.randrange(1, 400))}
        y = set(rng.sample(sorted(x), rng.randrange(len(x) + 1))) | {rng.randrange(2**63) for _ in range(rng.randrange(60))}
        keys = np.array(sorted(x) + sorted(y), np.uint64)
        a, b = sketches(np.repeat([0, 1], [len(x), len(y)]), keys, 2)
        assert np.bitwise_count(a ^ b).sum() <= len(x ^ y)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Offers, rounds, cells and blocks that are cut all agree with brute force."""
    monkeypatch.setattr("llm.ngram_join.CELL_PAIRS", 50)
    monkeypatch.setattr("llm.ngram_join.BLOCK_PAIRS", 64)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, component_table(frame, shards=5).collect()), key=str) == brute(rows)


def test_links(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(139, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 100}


def test_keep_one(spark):
    text = "a b c d e f g h i j k l m"
    rows = [(3, text), (1, text), (2, text + " n"), (4, "else"), (4, "else"), (None, text), (5, "")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text), (4, "else"), (None, text), (5, "")], key=str)


def test_rows_without_id_stay(spark):
    """Whether or not another id occurs twice."""
    text = "a b c d e f g h i j k l m"
    for more in ([(4, "else")], [(4, "else"), (4, "else")]):
        got = keep_one(spark.createDataFrame([(None, text), (None, text), *more], "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(None, text), (None, text), (4, "else")], key=str)


def test_empty(spark):
    assert component_table(spark.createDataFrame([], "doc_id long, text string")).collect() == []
