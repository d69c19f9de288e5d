"""Texts longer than a chunk, and input columns whose names an operator could use itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm.line_dedup import remove_boilerplate
from llm.ngram_join import component_table
from llm.packing import pack_documents
from llm.phrase_automata import remove_repeated_phrases
from llm.quality import fit_quality, judge
from llm.sentencepiece_lattice import encode_documents
from llm.suffix_dedup import remove_repeated_bytes
from llm.text_arrays import CHUNK_BYTES


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**7)}é" for _ in range(130_000)]
    near = list(words)
    near[5000] = "changed"
    rows = [(1, " ".join(words)), (2, "short text before"), (3, " ".join(near)), (4, "x " + " ".join(words[40_000:40_040]) + " y"), (5, None)]
    assert len(rows[0][1].encode()) > CHUNK_BYTES
    return rows


def test_long_texts_repeat(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in remove_repeated_phrases(frame, shards=4).collect()}
    # in the near copy, the windows that hold the changed word stay and with them that word alone; the short one loses the passage
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 0, 3: 129_999, 4: 40, 5: 0}
    assert got[3].text == "changed" and got[4].text == "x y" and got[1].text == rows[0][1]
    got = {r.doc_id: bytes(r.text) for r in remove_repeated_bytes(frame, shards=4).collect()}
    assert got[1].decode() == rows[0][1] and len(got[3]) < 60 and b"changed"[:5] in got[3] and got[5] == b""


def test_long_texts_join(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in component_table(frame, shards=4).collect()} == {1: (129_996, 1), 2: (1, 2), 3: (129_996, 1), 4: (38, 4), 5: (0, 5)}


def test_long_texts_encode(spark, rows):
    frame = spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = [*Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids, 0]
    got = sorted((r.piece, r.length, r.ids_crc32) for r in pack_documents(frame, path).collect() if r.doc_id == 1)
    assert got == [(k, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in encode_documents(frame, path).collect()}
    want = SentencePieceProcessor(model_file=path).encode(rows[0][1])
    assert got[1] == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()), True)


NAMES = ["c0", "__r1", "GONE", "__repeat_id", "__repeat_deal", "shard", "__quality", "labelled", "body", "id", "key", "node"]


def test_columns_of_any_name(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage}\nown line {i} with some more words in it than ten\nfooter", f"s{i % 12}", *(f"{n}{i}" for n in NAMES), "replaced") for i in range(24)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    frame = lambda last: spark.createDataFrame(rows, f"{schema}, `{last}` string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    documents = frame("KEPT")
    for out, replaced in (
        (remove_boilerplate(frame("N_LINES")), "N_LINES"),
        (remove_repeated_phrases(frame("N_Words"), shards=3), "N_Words"),
        (remove_repeated_bytes(frame("N_Spans"), shards=3), "N_Spans"),
        (judge(documents, fit_quality(documents, labels)), "KEPT"),
    ):
        assert replaced not in out.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        got = {r.doc_id: tuple(r[n] for n in ["source", *NAMES]) for r in out.collect()}
        assert got == {r[0]: r[2:-1] for r in rows}
