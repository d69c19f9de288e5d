"""The pipeline on a small table, stage by stage, against plain Python."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_repeats import brute as brute_windows
from tests.llm.test_repeats import words_of


def documents():
    rng = random.Random(9)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, passage = new(8), new(30)
    rows = []
    for i in range(60):
        text = "\n".join([new(40), notice if i % 2 else new(6), (passage + " " + new(20)) if i % 5 == 0 else new(25)])
        rows.append((i, text, "en", f"s{i % 15}", len(text)))
    rows += [(100 + i, rows[i][1].replace("1", "7", 1), "en", "s1", rows[i][4]) for i in range(6)]
    rows += [(200 + i, " ".join(f"#{w}$$" for w in new(40).split()), "en", "s2", 9) for i in range(60)]
    rows += [(300, None, "en", "s3", 0), (301, "too short", "en", "s4", 9)]
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = sorted(docs.collect()), spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            texts = {r.doc_id: r.text for r in got}
            assert len(texts) == len(got) and all(r.n_chars == len(r.text) for r in got if k in (1, 3))
        pairs = [(r.doc_id, r.text) for r in before]
        if k == 0:
            assert sorted(texts) == [*range(60), *range(100, 106)]
        elif k == 1:
            want = {i: text for i, text, _, removed, _ in brute_lines([(r.doc_id, r.text, r.source) for r in before], 10) if text.strip() or not removed}
            assert texts == want and any(texts[r.doc_id] != r.text for r in before)
        elif k == 2:
            assert texts == {i: dict(pairs)[i] for i, _, group in brute_groups(pairs) if i == group} and len(texts) < len(pairs)
        elif k == 3:
            want = {i: b" ".join(w for w, g in zip(seq, gone) if not g).decode() for (i, _), (seq, gone) in zip(pairs, brute_windows(pairs, words_of, 13))}
            assert texts == {i: t for i, t in want.items() if t} and any(len(t.split()) < 60 for t in texts.values())
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs}
            assert {r.doc_id: r.length for r in got} == want
            total: dict[int, int] = {}
            for r in got:
                total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
            assert max(total.values()) <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(again) == len(got)
