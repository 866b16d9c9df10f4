"""The queries of this subpackage: each dealt operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate as leaks
from tarn.llm import lines, mtree, repair, repetition, trie
from tarn.llm.lines import dedup_lines
from tarn.llm.minhash import near_duplicates
from tarn.llm.mtree import top_k
from tarn.llm.packing import pack
from tarn.llm.private import KINDS, find_private, spans_text
from tarn.llm.repetition import repetition_rules
from tarn.llm.sentencepieces import encoded_digest
from tarn.llm.substrings import remove_repeats
from tarn.llm.token_files import read_tokens, token_path, write_tokens
from tarn.llm.toxicity import CATEGORIES, score_toxicity
from tarn.llm.trie import prefix_trie


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


def op1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_texts(spark, sf))


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup_lines(_table(spark, sf, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.md5("clean_text").alias("clean_md5"))


def op3_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    rows = remove_repeats(_texts(spark, sf))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return rows.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256", "n_shared_words")


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return read_tokens(write_tokens(_texts(spark, sf), token_path(spark)))


def op5_repetition_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = repetition_rules(_texts(spark, sf))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words",
        "base_failed", "kept",
    )


def op6_sentencepieces(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_digest(_texts(spark, sf))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_texts(spark, sf))


def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_table(spark, sf, "embeddings")).drop("n_scored")


def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    rows = find_private(_texts(spark, sf))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    digest = F.sha2(spans_text(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, spans_text(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_toxicity(_texts(spark, sf), _table(spark, sf, "labels"))
    return rows.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], "is_toxic")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(_table(spark, sf, "conversations"))


def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = leaks.decontaminate(_texts(spark, sf), _table(spark, sf, "benchmark"))
    n_hit = leaks.n_hit(F.col("hits"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(_table(spark, sf, "conversations"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_line_dedup,
        op3_repeated_substrings,
        op4_token_files,
        op5_repetition_rules,
        op6_sentencepieces,
        op7_packing,
        op8_exact_top_k,
        op9_personal_data,
        op10_toxicity,
        op11_conversation_repair,
        op12_decontamination,
        op13_prefix_trie,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op5_repetition_rules": repetition.SQL,
    "op8_exact_top_k": mtree.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_decontamination": leaks.SQL,
    "op13_prefix_trie": trie.SQL,
}
