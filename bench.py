"""Benchmark of the headline jobs; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
Every job is run twice and the faster run counts, so the figures leave out JVM
start-up and compilation. Indexes are built once, and their times stand apart in ``builds``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import functions as F

    from tarn import get_session
    from tarn.checks import QUERIES
    from tarn.checks.base import markdown
    from tarn.checks.search import DIM, joint_index, joint_queries, text_index, text_queries, vector_index
    from tarn.checks.storage import tree_parts
    from tarn.operators import search as S
    from tarn.operators import text_index as X
    from tarn.operators import vfs as V
    from tarn.operators.chunking import ChunkConfig, chunk_documents
    from tarn.operators.library import chunk_library
    from tarn.session import durable, scratch_path

    spark = get_session(
        "tarn-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tarn-bench-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cpus = spark.sparkContext.defaultParallelism

    # The given files have one row group each, which is one task whatever the number of cores.
    # A lake has many files: the inputs are written so first, and every job reads them.
    def lake(df):
        return durable(df.repartition(cpus))

    md = lake(markdown(spark, SF))
    n_docs = md.count()
    vectors = lake(vector_index(spark, SF))
    n_vectors = vectors.count()
    texts = lake(text_index(spark, SF))
    asked = lake(text_queries(spark, SF))
    n_asked = asked.count()
    joint, joint_asked = lake(joint_index(spark, SF)), lake(joint_queries(spark, SF))
    entities, reps = tree_parts(spark, SF, heavy=True)
    reps, tree = lake(reps), lake(V.vfs_tree(entities, reps))
    indexes, grep_indexes = [], []

    def build(make, held):
        """A job that writes an index; searches use the one built last."""

        def job():
            path = scratch_path(spark, "bench-index")
            make(path)
            held.append(X.TextIndex(spark, path))
            return spark.range(1)

        return job

    def vector_queries(n: int):
        return vectors.orderBy("chunk_index").limit(n).select(F.col("chunk_index").alias("query_id"), "embedding")

    def registered(name: str):
        return lambda: QUERIES[name](spark, SF)

    jobs = {
        "chunk_documents": lambda: chunk_documents(md, ChunkConfig()),
        "chunk_small": lambda: chunk_documents(md, ChunkConfig(chunk_tokens=32)),
        "chunk_library": lambda: chunk_library(md.withColumn("name", F.lit("x.md"))),
        "semantic_1": lambda: S.search_semantic(vectors, vector_queries(1), 10, DIM),
        "semantic_100": lambda: S.search_semantic(vectors, vector_queries(100), 10, DIM),
        "semantic_1000": lambda: S.search_semantic(vectors, vector_queries(1000), 10, DIM),
        "build_text_index": build(lambda path: X.write_text_index(texts, path), indexes),
        "build_grep_index": build(lambda path: V.write_grep_index(reps, path), grep_indexes),
        "lexical_1": lambda: X.search_lexical_written(indexes[-1], asked.orderBy("query_id").limit(1), 10, payload=False),
        "lexical_all": lambda: X.search_lexical_written(indexes[-1], asked, 10, payload=False),
        "hybrid_all": lambda: S.search_hybrid(joint, joint_asked, 10, DIM, text_index=indexes[-1]),
        "substring": lambda: X.search_substring_written(indexes[-1], asked, 10),
        "vfs_grep": lambda: V.vfs_grep(tree, grep_indexes[-1], "th[ei]s? (in|on)", limit=500),
        "vfs_grep_rare": lambda: V.vfs_grep(tree, grep_indexes[-1], "licen[sc]e.*permitted", limit=500),
        "lexical_scan": lambda: S.search_lexical(texts, asked, 10, payload=False),
        "grep_scan": lambda: V.vfs_grep(tree, reps, "th[ei]s? (in|on)", limit=500),
        "sync_index": registered("sync_index"),
        "sync_written_index": registered("sync_written_index"),
        "search_ann": registered("search_ann"),
        "detect_drift": registered("detect_drift"),
        "cascade_stale": registered("cascade_stale"),
        "content_dedup": registered("content_dedup"),
        "file_changes": registered("file_changes"),
        "dedup_tasks": registered("dedup_tasks"),
        "as_of_time": registered("as_of_time"),
        "query_table": registered("query_table"),
        "query_tables": registered("query_tables"),
        "profile": registered("profile"),
    }
    seconds, builds = {}, {}
    for name, job in jobs.items():
        runs = []
        for _ in range(1 if name.startswith("build") else 2):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        (builds if name.startswith("build") else seconds)[name] = round(min(runs), 3)
        print(name, round(min(runs), 3), file=sys.stderr, flush=True)
    n_chunks = chunk_documents(md, ChunkConfig()).count()
    n_small = chunk_documents(md, ChunkConfig(chunk_tokens=32)).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "builds": builds,
                "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
                "rates": {
                    "documents": n_docs,
                    "chunks_per_sec": round(n_chunks / seconds["chunk_documents"]),
                    "small_chunks_per_sec": round(n_small / seconds["chunk_small"]),
                    "semantic_queries_per_sec": round(1000 / seconds["semantic_1000"]),
                    "lexical_queries_per_sec": round(n_asked / seconds["lexical_all"]),
                    "hybrid_queries_per_sec": round(n_asked / seconds["hybrid_all"]),
                    "vectors": n_vectors,
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
