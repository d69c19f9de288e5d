import random
import zlib

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor

import llm.sentencepiece_lattice as lattice_module
from llm.sentencepiece_lattice import FOLD_LENGTH, MARK, Pieces, decode_documents, encode_documents, encode_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  Hello  world\n\nä x", "tab\tend \n", "日本語 text ﬁ ①", "a" * 5000, "x1y2" * 60 + " é", "\n", "don't stop, won't stop", "é \x85  z", "mark ▁ here", "<s> </s> <0x0A>", "🙂🙂 ok"]


def corpus():
    rng = random.Random(4)
    parts = ["tion", "é", "ing", "Th", "e", "of", "ß", "12", ".", "eau", "zz"]
    return TEXTS + [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(rng.randrange(30))) for _ in range(60)]


def test_documents(spark):
    rows = [(i % 70, t) for i, t in enumerate(corpus())]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    encoded = encode_documents(frame, PATH, with_ids=True)
    got = encoded.collect()
    library = SentencePieceProcessor(model_file=PATH)
    want = [(i, library.encode(t or "")) for i, t in rows]
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(want)
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert sum(not r.round_trip for r in got) == 1
    back = sorted((r.doc_id, r.text) for r in decode_documents(encoded, PATH).collect())
    assert back == sorted((i, (t or "").replace(MARK, " ")) for i, t in rows)


def test_relational_fold_equals_the_library(spark):
    words = sorted({MARK + w for t in corpus() if t for w in t.split() if len(w) < FOLD_LENGTH} | {"x", "日本", MARK * 3})
    pieces = Pieces.load(PATH)
    got = {r.word: list(r.ids) for r in encode_words(spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "word string"), pieces).collect()}
    assert got == {w: pieces.fold(w) for w in words}


def test_viterbi(spark):
    scores = {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -1.5, "bc": -1.2, "abc": -3.0}
    pieces = Pieces({k: i for i, k in enumerate(scores)}, scores, 100, [k.encode() for k in scores], 3, "unigram")
    got = {r.word: list(r.ids) for r in encode_words(spark.createDataFrame([("abc",), ("ab",), ("aé",), ("cab",)], "word string"), pieces).collect()}
    assert got == {"abc": [0, 4], "ab": [3], "aé": [0, 100 + 0xC3, 100 + 0xA9], "cab": [2, 3]}


def test_empty(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_every_word_goes_through_the_lattice(spark, monkeypatch):
    """Tasks fold no word of up to FOLD_LENGTH characters, however many distinct words there are."""
    rows = [(i, " ".join(f"w{i * 400 + k:x}é" for k in range(400))) for i in range(100)]
    sent = {}
    made = lattice_module.encode_words

    def counted(words, *args, **kwargs):
        sent["n"] = words.count()
        return made(words, *args, **kwargs)

    monkeypatch.setattr(lattice_module, "encode_words", counted)
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), PATH, with_ids=True).collect()
    library = SentencePieceProcessor(model_file=PATH)
    assert sent["n"] == 40_000 and sorted((r.doc_id, list(r.ids)) for r in got) == [(i, library.encode(t)) for i, t in rows]


def test_nothing_is_shuffled_or_stored_and_a_word_is_folded_once(spark, monkeypatch):
    monkeypatch.setattr("llm.storage.fresh_path", lambda *_: 1 / 0)
    plan = encode_documents(spark.createDataFrame([(1, "a word")], "doc_id long, text string"), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    # with the fold inside the filter of edges, it was done again for each edge
    cuts = "aggregate(joins"
    assert cuts in plan and plan.index(cuts) < plan.index("filter(edges")


def test_a_join_that_frees_a_better_one(spark):
    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "d": -9.0, "bc": -2.0, "abc": -1.0, "cd": -3.0, "abcd": -4.0, "aa": -5.0}
    pieces = Pieces({k: i for i, k in enumerate(scores)}, scores, 100, [k.encode() for k in scores], 4, "bpe")
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdé", k=rng.randrange(1, 14))) for _ in range(400)} | {"abcd", "dabc", "aaaaa", "abc" * 20})
    got = {r.word: list(r.ids) for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert "bc" in lattice_module.freeing(scores) and "aa" not in lattice_module.freeing(scores)
    assert got == {w: pieces.fold(w) for w in words}


def test_words_are_cut_where_no_piece_crosses(spark):
    rows = [(1, "no,yes no.yes ((x))###y 12.34 ñandú—é," + "ab,." * 40), (2, ""), (3, None), (4, "z" * 70), (5, "▁a, ▁,a")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), PATH, with_ids=True).collect()
    library = SentencePieceProcessor(model_file=PATH)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(i, library.encode(t or "")) for i, t in rows]
    assert {r.doc_id: r.n_words for r in got} == {1: 5, 2: 0, 3: 0, 4: 1, 5: 2}
