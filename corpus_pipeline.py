"""A corpus through five operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.rowid import with_row_id
from tarn.llm.lines import dedup_lines
from tarn.llm.minhash import near_duplicates
from tarn.llm.packing import pack
from tarn.llm.private import find_private, redact
from tarn.llm.toxicity import score_toxicity
from tarn.session import durable, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(rows: DataFrame) -> DataFrame:
    chars = F.length("text").cast("long").alias("n_chars")
    return rows.select(*[chars if c == "n_chars" else c for c in COLUMNS])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).where("not is_toxic").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its boilerplate lines."""
    rows = dedup_lines(docs.select(*COLUMNS))
    return _as_documents(rows.withColumn("text", F.col("clean_text")))


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each id and text in ``_row``, in the order of the ids, null
    ids last. Where ids are unique and not null they are the numbers."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    no_id, text = F.col("doc_id").isNull(), F.coalesce(F.md5("text"), F.lit(""))
    docs = docs.withColumns({"_no_id": no_id, "_id": F.coalesce("doc_id", F.lit(0)), "_text": text})
    key = ["_no_id", "_id", "_text"]
    names = with_row_id(docs.select(*key).distinct(), key, "_row")
    # Copies of a row are one row.
    return durable(docs.join(names, key).drop(*key).dropDuplicates(["_row"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, null ids
    last. Rows are told apart by id and text together: ids may repeat or be null."""
    named = _named(docs.select(*COLUMNS))
    kept = near_duplicates(named.select(F.col("_row").alias("doc_id"), "text")).where("kept")
    return named.join(kept.select(F.col("doc_id").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    rows = find_private(docs.select(*COLUMNS))
    return _as_documents(rows.withColumn("text", redact(F.col("text"), F.col("spans"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("private", private),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Toxicity, personal data and packing rest on learned weights and token ids.
ORACLE_SQL = None
