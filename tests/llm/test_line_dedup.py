import random

import pytest

from llm.line_dedup import remove_boilerplate


def brute(rows, min_sites):
    sites, first = {}, {}
    for doc_id, text, source in rows:
        for line in [] if text is None else text.split("\n"):
            if line.strip(" "):
                sites.setdefault(line, set())
                if source is not None:
                    sites[line].add(source)
                if doc_id is not None:
                    first[line] = min(first.get(line, doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if len(sites.get(x, ())) < min_sites or first.get(x) == doc_id]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept), "c"))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [3, 10])
def test_against_brute_force(spark, min_sites):
    rng = random.Random(min_sites)
    pool = [f"line {i} é" for i in range(25)] + ["", " ", "  x"]
    rows = [(i, "\n".join(rng.choice(pool[: 3 + i % 25]) for _ in range(rng.randrange(8))), f"s{rng.randrange(14)}") for i in range(120)]
    rows += [(7, None, "s1"), (None, "line 1 é\nline 2 é", "s2"), (8, "line 1 é\r", None), rows[5], rows[5], (9, "", "s1")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, h1 string").repartition(3)
    got = remove_boilerplate(frame, min_sites).select("doc_id", "text", "n_lines", "n_removed", "h1").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, min_sites)


def test_empty(spark):
    assert remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
