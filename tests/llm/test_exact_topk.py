import math
import random

import pytest
from pyspark.sql import functions as F

from llm.exact_topk import top_k


@pytest.mark.parametrize("blocks", [(8192, 1024), (40, 7)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(blocks[0])
    base = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, base if i % 4 == 0 else [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [math.nan] * 6), (1150, [math.inf] * 6), (1200, [0.0] * 6), (1250, [1.0, 2.0]), (None, base), (1301, [1.0, -2.0])]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, rank string").repartition(4)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, F.col("vec_id") % 50 == 0, block_rows=blocks[0], query_rows=blocks[1]).collect()]
    clean = [(i, [math.floor(256 * r) for r in v]) for i, v in frame.select("vec_id", "embedding").collect() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in clean:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []
