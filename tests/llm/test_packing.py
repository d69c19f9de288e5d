import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.packing import pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
    sequences = plan(counts, 100)
    placed: dict[int, int] = {}
    for lengths, n in sequences:
        assert sum(lengths) <= 100 and n > 0 and lengths
        assert sum(3 * k > 100 for k in lengths) <= 2
        for k in lengths:
            placed[k] = placed.get(k, 0) + n
    assert placed == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(n for _, n in sequences) <= 1.25 * total / 100 + sum(n for k, n in counts.items() if 2 * k > 100) + 1


def test_documents(spark):
    rng = random.Random(1)
    texts = ["", None, "Hello  WORLD\n\tit's 42% <|endoftext|> é é  x y", "don't <|startoftext|>x"] + [" ".join(rng.choice(["the", "Zebra's", "éàü", "12ab", "quux!", "日本"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    rows = [(i % 70, t) for i, t in enumerate(texts)] + [(None, "null id")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 64).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(-1 if i is None else i, p, p * 64, len(ids[p * 64 : p * 64 + 64]), zlib.crc32(np.array(ids[p * 64 : p * 64 + 64], "<u4").tobytes())) for p in range(-(-len(ids) // 64))]
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1].tolist()] and group.length.sum() <= 64
    assert got.sequence_id.nunique() <= got.length.sum() / 64 * 1.1 + 1


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
