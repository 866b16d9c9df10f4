"""Steps that once held more than their results: pairs as rows, texts per needle, summaries per entity."""

from __future__ import annotations

import contextlib
import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarn.operators import metrics as M
from tarn.operators import search as S
from tarn.operators import text_index as X
from tarn.operators import vector_index as V
from tarn.session import scratch_path

VECTORS = "entity_id string, rep_name string, chunk_index long, embedding array<float>"
CHUNKS = "entity_id string, rep_name string, chunk_index long, text string"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_blocks_of_queries_are_exact_and_carry_no_vectors(spark, tmp_path, monkeypatch):
    """Equal, zero and broken vectors among them; tiny blocks, tiles and caches."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8)).astype("float32")
    data[40:60], data[70] = data[40], 0
    rows = [(f"v{i % 17}", "canonical_md", i, v.tolist()) for i, v in enumerate(data)]
    rows += [("broken", "canonical_md", 0, [float("nan")] * 8), ("none", "canonical_md", 0, None)]
    index = spark.createDataFrame(rows, VECTORS)
    queries = index.select(F.xxhash64("entity_id", "chunk_index").alias("query_id"), "embedding")
    for name, size in (("PART", 7), ("TILE", 500), ("KEPT", 400)):
        monkeypatch.setattr(V, name, size)
    for metric in ("l2", "cosine"):
        path = str(tmp_path / metric)
        V.write_vector_index(index, path, 8, cells=9, metric=metric)
        written = V.VectorIndex(spark, path)
        found = V.nearest_written(written, queries, 5)
        want = S.nearest(index, queries, 5, 8, metric)
        listed = lambda df: sorted((r["query_id"], r["rank"], r["entity_id"], r["chunk_index"], round(r["distance"], 6)) for r in df.collect())
        assert listed(found) == listed(want)
        assert listed(V.nearest_written(written, queries, 5, probe=9)) == listed(want)
    assert "embedding" not in V._pairs(written, queries.where("embedding[0] <= 0"), 5, None, False).columns


def test_watch_status_is_exact_and_counts_entities_apart(spark):
    events = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 2)).alias("strategy_id"),
        F.lit("2024-01-15 11:30:00").cast("timestamp").alias("ts"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double")).alias("lag"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 4001).alias("entity_id"),
    ).unionByName(spark.sql("SELECT 'bare' AS strategy_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, CAST(NULL AS double) AS lag, CAST(NULL AS bigint) AS entity_id"))
    rows = events.collect()
    found = M.watch_status(events, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    got = {r["strategy_id"]: (r["events_last_hour"], r["lag_p99"], r["entities_managed"]) for r in found.collect()}
    for name in (None, "s0", "s1", "bare"):
        mine = [r for r in rows if r["strategy_id"] == name]
        lags = sorted(r["lag"] for r in mine if r["lag"] is not None)
        want = lags[len(lags) - len(lags) // 100 - 1] if lags else None
        assert got[name] == (len(mine) if name != "bare" else 0, want, len({r["entity_id"] for r in mine} - {None}))
    assert all("entity_id" not in line for line in plan_of(found).splitlines() if "percentile" in line)


def test_terms_are_counted_as_the_text_has_them(spark):
    index = spark.createDataFrame([("a", "r", 0, "b A b é É"), ("b", "r", 0, None), ("c", "r", 0, "1")], CHUNKS)
    got = {r["entity_id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in S.lexical_terms(index).collect()}
    assert got == {"a": (5, [("a", 1), ("b", 2), ("é", 2)]), "b": (0, []), "c": (1, [("1", 1)])}
    assert "array_sort" not in plan_of(S.lexical_terms(index))


def test_postings_are_ranked_without_a_shuffle_of_pairs(spark):
    index = spark.createDataFrame([(f"e{i}", "r", 0, f"the w{i % 7} w{i % 3}") for i in range(200)], CHUNKS)
    asked = spark.createDataFrame([(i, f"the w{i}") for i in range(7)], "query_id long, text string")
    found = S.rank_postings(S.lexical_postings(index), S.corpus_stats(index), asked, 5)
    assert not any("Exchange" in line and "query_id" in line and "entity_id" in line.split("]")[0] for line in plan_of(found).splitlines())
    keyed = lambda df: sorted((r["query_id"], r["rank"], r["entity_id"], round(r["score"], 6)) for r in df.collect())
    assert keyed(found) == keyed(S.rank_chunks(index, asked, 5))


def test_a_text_is_lowered_once_for_its_needles(spark, monkeypatch):
    monkeypatch.setattr(X, "NEEDLES", 3)
    index = spark.createDataFrame([(f"e{i}", "r", 0, f"The W{i % 7} x{i % 3} zebra") for i in range(120)], CHUNKS)
    texts = ["the", "w1", "W2 X", "zebra", "x", "EBR", "absent", "w3", "he w"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    path = scratch_path(spark, "text-index")
    X.write_text_index(index, path)
    found = X.substring_hits_written(X.TextIndex(spark, path), asked)
    want = S.substring_hits(index, asked)
    keyed = lambda df: sorted((r["query_id"], r["entity_id"]) for r in df.collect())
    plan = plan_of(found)
    assert keyed(found) == keyed(want) and len(keyed(want)) > 300
    assert not any("Filter" in line and "array(lower(text" in line for line in plan.splitlines())


def test_stand_in_model_counts_a_shared_part_once(monkeypatch):
    """each window holds the texts of its neighbours, which were all counted again for it."""
    from collections import Counter

    from tarn.operators import embedding as E

    parts = [f"once{i}é ΟΣ, Twice\ntwice{i}" for i in range(40)] + ["", "\n", "ΟΔΟΣ"]
    texts = ["\n\n".join(parts[max(0, i - 4) : i + 5]) for i in range(len(parts))] + ["", " .,", "ΑΣ\n\n\nΣΑ"]
    want = np.zeros((len(texts), 32))
    for row, text in enumerate(texts):
        for token, n in Counter(re.findall(r"\w+", text.lower())).items():
            digest = hashlib.sha256(token.encode()).hexdigest()
            want[row, int(digest[:8], 16) % 32] += n if digest[8] >= "8" else -n
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = (want / np.where(norms > 0, norms, 1)).astype(np.float32)
    calls = []
    real = hashlib.sha256
    monkeypatch.setattr(E.hashlib, "sha256", lambda raw: calls.append(raw) or real(raw))
    got = E.hashed_embedder(32)(texts, "retrieval.passage")
    assert (got == want).all() and got.dtype == np.float32
    assert len(calls) <= 4 * len(parts)
    monkeypatch.setattr(E, "PARTS_KEPT", 3)
    assert (E.hashed_embedder(32)(texts, "retrieval.passage") == want).all()


def test_trigrams_are_sorted_not_hashed(monkeypatch):
    """``np.unique`` hashes numbers one by one, a hundred times slower than their sort."""
    rows = pa.RecordBatch.from_pydict({"doc": [0, 1, 2, 4096], "text": ["abcabc", "ab", None, "xabc"]})
    monkeypatch.setattr(X.np, "unique", None)
    got = [r for batch in X._gram_rows([rows]) for r in batch.to_pylist()]
    code = lambda s: int.from_bytes(s.encode(), "big")
    assert got == [
        {"gram": code("abc"), "shard": 0, "docs": [0]}, {"gram": code("bca"), "shard": 0, "docs": [0]},
        {"gram": code("cab"), "shard": 0, "docs": [0]},
        {"gram": code("abc"), "shard": 1, "docs": [0]}, {"gram": code("xab"), "shard": 1, "docs": [0]},
    ]


def test_single_precision_only_chooses_what_is_computed_in_double():
    """Vectors closer together than single precision tells, far from the origin, tiny, and too large for it."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1, 16))
    near = base + rng.normal(size=(300, 16)) * 1e-7
    for v, q in (
        (near, near[:40] + 1e-8), (near + 1e4, near[:40] + 1e4), (near * 1e-22, near[:40] * 1e-22), (near * 1e16, near[:40] * 1e16),
        (np.repeat(near[:30], 10, 0), near[:40]), (rng.normal(size=(300, 16)), rng.normal(size=(40, 16))),
    ):
        for metric in ("l2", "cosine"):
            v1, q1 = V._geometry(v, metric), V._geometry(np.vstack([q, np.full((1, 16), np.nan)]), metric)
            found = V._Nearest(q1, 5, metric)
            assert (found.short is None) == (metric == "l2" and v.max() > 1e15)
            for a in range(0, 300, 70):
                part = v1[a : a + 70]
                for rows in (np.arange(0, 40, 2), np.arange(1, 40, 2)):
                    found.add(rows, np.arange(a, a + len(part)), part)
            difference = q1[:40, None, :] - v1[None]
            d = np.sqrt(np.square(difference).sum(2)) if metric == "l2" else 1.0 - (q1[:40, None, :] * v1[None]).sum(2)
            d = np.round(d, 9)
            order = np.array([np.lexsort((np.arange(300), row))[:5] for row in d])
            assert (found.place[:40] == order).all() and (found.distance[:40] == np.take_along_axis(d, order, 1)).all()
