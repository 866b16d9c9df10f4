"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.located import FILE, ROW, located
from tarn.functions.sizes import spread

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query, with equivalent DuckDB SQL where one exists."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents", *columns: str) -> DataFrame:
    """A table whose rows are costly to process, on all cores."""
    return spread(table(spark, sf, name).select(*(columns or ("*",))))


# --- inputs derived row by row from the given tables -------------------------

MD_SQL = r"""md AS (
  SELECT doc_id, '# doc ' || doc_id || chr(10)
         || regexp_replace(text, '\.\n([^ \n]+) ', '.' || chr(10) || chr(10) || '## \1' || chr(10) || '\1 ', 'g') AS text
  FROM documents)"""


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown: a title, and a heading before every paragraph."""
    body = F.regexp_replace("text", "\\.\n([^ \n]+) ", ".\n\n## $1\n$1 ")
    return texts(spark, sf).select(
        "doc_id",
        F.concat(F.lit("# doc "), F.col("doc_id").cast("string"), F.lit("\n"), body).alias("text"),
    )


PARA_SQL = r"""paras_in AS (
  SELECT doc_id, regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g') AS text FROM documents)"""


def blank_separated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a blank line after every line that ends a sentence."""
    return texts(spark, sf).select(
        "doc_id", F.regexp_replace("text", "\\.\n", ".\n\n").alias("text")
    )


ENT_SQL = """ent AS (
  SELECT lang AS workspace_id, source AS collection_id,
         'ent_' || substr(sha256(text), 1, 16) AS entity_id,
         substr(sha256(text), 1, 16) AS content_hash,
         max(doc_id) AS doc_id, max(doc_id) || '.md' AS name, count(*) AS copies
  FROM documents GROUP BY ALL)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploaded files."""
    return _as_files(table(spark, sf, "documents"))


def located_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the place of each row."""
    return _as_files(located(table(spark, sf, "documents")), FILE, ROW)


def _as_files(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("collection_id"),
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"),
        F.col("text").cast("binary").alias("content"),
        *more,
    )
