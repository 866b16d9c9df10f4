"""Rows are found again by their places, and contents are in no shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from tarn.checks.base import located_files
from tarn.functions.located import at_places, located, stored
from tarn.operators import chunking as C
from tarn.operators import entities as E
from tarn.plans.ingest import ingest
from tarn.schema import ext_routes

SF = "/root/testdata/sf0.001"


def exchanged(df) -> set[str]:
    """Names of the columns that a plan shuffles or broadcasts."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\) \w*Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert blocks, "the plan has no exchange"
    return {name.split("#")[0].strip() for block in blocks for name in block.split(",")}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Files of several row groups, more rows than one bitmap covers."""
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df = spark.range(100_000).select((F.col("id") % 30_000).alias("k"), "id", F.concat(F.lit("body"), F.col("id")).alias("content"))
    df.repartition(2, "id").sortWithinPartitions("id").write.option("parquet.block.size", "65536").parquet(path)
    return located(spark.read.parquet(path))


@pytest.mark.parametrize("bitmaps", [8_192, 1])
def test_places(rows, bitmaps):
    wanted = rows.where("id % 7 = 3 or id in (0, 99999)").select("_file", "_row")
    got = {r["id"] for r in at_places(rows, wanted, bitmaps).collect()}
    assert got == {i for i in range(100_000) if i % 7 == 3 or i in (0, 99_999)}


def test_no_place_is_wanted(rows):
    kept = at_places(rows, rows.where("id < 0").select("_file", "_row"))
    assert kept.columns == ["k", "id", "content"] and kept.count() == 0


def test_last_write_wins(spark, rows):
    got = E.dedup_by_content(rows, "id", ["k"])
    assert "content" not in exchanged(got)
    plain = E.dedup_by_content(rows.drop("_file", "_row"), "id", ["k"])
    assert sorted(got.collect()) == sorted(plain.collect()) and got.columns == plain.columns


def test_null_and_equal_orders(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("b", None, "z"), (None, 2, "v"), (None, 2, "w")], "k string, n int, content string")
    got = {r["k"]: r["content"] for r in E.dedup_by_content(stored(df.coalesce(1)), "n", ["k"]).collect()}
    assert got["a"] == "y" and got["b"] == "z" and got[None] == "w" and len(got) == 3
    assert E.dedup_by_content(stored(df.limit(0)), "n", ["k"]).count() == 0


def test_bodies_of_pages_are_not_shuffled(spark):
    pages = located(spark.read.parquet(f"{SF}/pages.parquet"))
    got = E.url_entities(pages, "url_hash", "page_id")
    assert "html" not in exchanged(got)
    # Columns whose names the places use inside do no harm.
    named = E.url_entities(pages.withColumn("_at", F.lit(1)).withColumn("_last", F.lit(2)), "url_hash", "page_id")
    assert named.drop("_at", "_last").count() == got.count()


def test_texts_of_chunks_are_not_shuffled(spark):
    chunks = C.chunk_sentences(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = C.dedup_chunks(chunks, "doc_id")
    assert "text" not in exchanged(got)
    assert got.count() == chunks.select("text").distinct().count()
    inside = C.dedup_chunks(chunks, "doc_id", within_document=True)
    assert inside.count() == chunks.select("doc_id", "text").distinct().count()


def test_ingest_shuffles_no_content(spark, tmp_path):
    now = F.lit("2024-02-01").cast("timestamp")
    # As many files as there are cores, or more.
    spark.read.parquet(f"{SF}/documents.parquet").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        done = ingest(located_files(spark, str(tmp_path)), ext_routes(spark), now, "doc_id")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert not {"content", "text"} & exchanged(done.chunks)
    assert "_file" not in done.rejected.columns
    keys = ["workspace_id", "collection_id", "entity_id"]
    for small in (done.entities, done.reps, done.log):
        assert "content#" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert done.chunks.select(*keys).distinct().count() == done.entities.count()
    # Files without places give the same.
    plain = ingest(located_files(spark, SF).drop("_file", "_row"), ext_routes(spark), now, "doc_id")
    assert sorted(plain.entities.collect()) == sorted(done.entities.collect())
