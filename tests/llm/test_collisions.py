"""Text written so that sums modulo 2**64 collide: both Thue-Morse words have equal ones for any letters and base."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm.brown_lm import score_texts
from llm.ngram_join import component_table
from llm.packing import pack_documents
from llm.quality import statistics
from llm.sentencepiece_lattice import encode_documents
from llm.text_arrays import BLOCKED_BYTES, Texts, Words, content_hashes

FIRST = "".join("ab"[i.bit_count() % 2] for i in range(2048))
SECOND = "".join("ba"[i.bit_count() % 2] for i in range(2048))


def test_content_hashes():
    words = [b"", b"\0", b"\0\0", *(b"x" * n for n in range(1, 130)), *(b"x" * n + b"y" for n in range(130)), FIRST.encode(), SECOND.encode()]
    data = np.frombuffer(b"".join(words) * 2, np.uint8)
    ends = np.cumsum([len(w) for w in words * 2])
    for key in (0, 5, 2**64 - 1):
        got = content_hashes(data, ends - [len(w) for w in words * 2], ends, key)
        assert (got[: len(words)] == got[len(words) :]).all() and len(set(got.tolist())) == len(words)
    assert len(content_hashes(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert max(map(len, words)) > BLOCKED_BYTES


def test_words_and_lines_stay_apart():
    texts = Texts.of(pa.array([f"{FIRST} {SECOND}", f"{FIRST}\n{SECOND}\n{FIRST}"]))
    assert len(set(Words(texts).hash.tolist())) == 2
    counts, _ = statistics(texts)
    assert counts["n_dup_lines"].tolist() == [0, 1]


def test_tokenizers(spark):
    frame = spark.createDataFrame([(1, FIRST), (2, SECOND)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.ids_crc32 for r in pack_documents(frame, path).collect() if r.piece == 0}
    for i, text in ((1, FIRST), (2, SECOND)):
        ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0][:2048]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    got = {r.doc_id: list(r.ids) for r in encode_documents(frame, path, with_ids=True).collect()}
    assert got == {1: library.encode(FIRST), 2: library.encode(SECOND)}


def test_sets_do_not_link(spark):
    frame = spark.createDataFrame([(1, FIRST), (2, SECOND), (3, FIRST)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in component_table(frame, shards=3).collect()} == {1: 1, 2: 2, 3: 1}


def test_words_are_counted_apart(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    frame = spark.createDataFrame([(train[0], FIRST), (held[0], SECOND), (held[1], FIRST)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in score_texts(frame).collect()} == {train[0]: 2, held[0]: 1, held[1]: 2}
