"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import line_dedup, oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.line_dedup import remove_boilerplate

    out = remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.exact_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.brown_lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op5_gradient_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.quality import COUNTS, fit_quality, judge

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(documents, fit_quality(documents, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.phrase_automata import remove_repeated_phrases

    out = remove_repeated_phrases(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.ngram_join import component_table

    return component_table(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.suffix_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op10_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.sentencepiece_lattice import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_reassembly": op2_warc_reassembly,
    "op3_threshold_topk": op3_threshold_topk,
    "op4_brown_class_lm": op4_brown_class_lm,
    "op5_gradient_boosted_rules": op5_gradient_boosted_rules,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece_lattice": op10_sentencepiece_lattice,
}

#: DuckDB statements for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_warc_reassembly": oracles.WARC,
    "op3_threshold_topk": oracles.TOP_K,
    "op6_phrase_automata": oracles.PHRASES,
    "op7_ngram_jaccard_join": oracles.JACCARD,
    "op9_suffix_dedup": oracles.BYTES,
}
