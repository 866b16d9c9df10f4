"""Hot keys, block borders and large inputs give the same answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions.ordered import carry_last, ordered_blocks, previous, running_max, running_sum
from tarn.functions.rowid import with_row_id
from tarn.operators import chunking as C
from tarn.operators import search as S
from tarn.operators import vector_index as V


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small inputs would otherwise be merged into one sort partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(spark, n=4000):
    """Half of the rows share one key."""
    rnd = random.Random(5)
    rows = [("hot" if i % 2 else f"k{i % 7}", i, rnd.randint(-9, 9), rnd.random() < 0.3) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, v long, known boolean").repartition(8)
    return rows, df.withColumn("v2", F.when(F.col("known"), F.col("v")))


def test_ordered_blocks_spread_a_hot_key(spark):
    _, df = hot_rows(spark)
    blocks = ordered_blocks(df, ["key"], ["at"])
    assert blocks.filter("key = 'hot'").select("_block").distinct().count() > 1


def test_running_operations(spark):
    rows, df = hot_rows(spark)
    blocks = ordered_blocks(df, ["key"], ["at"])
    out = running_sum(blocks, ["key"], F.col("v"), "s")
    out = running_sum(out, ["key"], F.col("v"), "sx", exclusive=True)
    out = running_max(out, ["key"], F.col("v"), "m", exclusive=True)
    out = previous(out, ["key"], F.col("v2"), "p")
    out = carry_last(out, ["key"], F.col("v2"), "c")
    got = {(r["key"], r["at"]): (r["s"], r["sx"], r["m"], r["p"], r["c"]) for r in out.collect()}
    by_key = {}
    for key, at, v, known in sorted(rows, key=lambda r: (r[0], r[1])):
        total, top, before, last = by_key.get(key, (0, None, None, None))
        mine = v if known else None
        carried = mine if mine is not None else last
        assert got[key, at] == (total + v, total, top, before, carried)
        by_key[key] = (total + v, v if top is None else max(top, v), mine, carried)


def test_running_sum_without_key(spark):
    rows, df = hot_rows(spark)
    got = {r["at"]: r["s"] for r in running_sum(ordered_blocks(df, [], ["at"]), [], F.col("v"), "s").collect()}
    total = 0
    for _, at, v, _ in sorted(rows, key=lambda r: r[1]):
        total += v
        assert got[at] == total


def test_row_ids_are_dense(spark):
    ids = [r["_row_id"] for r in with_row_id(spark.range(0, 5000, 1, 7), ["id"]).orderBy("id").collect()]
    assert ids == list(range(5000))


def test_window_blocks(spark):
    chunks = spark.range(200).select(
        F.lit("doc").alias("doc"), F.col("id").alias("chunk_index"), F.concat(F.lit("t"), F.col("id")).alias("text")
    )
    small = C.sliding_window(chunks, "doc", 9, block=8).orderBy("chunk_index").collect()
    large = C.sliding_window(chunks, "doc", 9).orderBy("chunk_index").collect()
    assert small == large
    assert small[100]["embedding_text"] == "\n\n".join(f"t{i}" for i in range(96, 105))


def vectors(spark, n, dim=8, copies=0):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[:copies] = data[0]
    rows = [(f"e{i:05d}", "canonical_md", i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "entity_id string, rep_name string, chunk_index long, embedding array<float>")
    return data, df.repartition(6)


def brute(data, queries, k):
    out = {}
    for q in queries:
        d = np.round(np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(1)), 9)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(data)), d))[:k]]
    return out


def ranked(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["chunk_index"])
    return got


def test_nearest_with_many_copies(spark, monkeypatch):
    # A third of the vectors are copies of one: ties at every rank.
    data, index = vectors(spark, 900, copies=300)
    picks = [0, 5, 299, 300, 700]
    queries = index.filter(F.col("chunk_index").isin(picks)).select(F.col("chunk_index").alias("query_id"), "embedding")
    want = brute(data, picks, 7)
    assert ranked(S.nearest(index, queries, 7, 8)) == want
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(V, "CELL_ROWS", 100)
    monkeypatch.setattr(V, "PART", 2)
    assert ranked(S.nearest(index, queries, 7, 8)) == want


def test_cells_are_exact_and_skip(spark, tmp_path):
    """Clustered vectors: two rounds are exact, and few cells hold nearly all neighbours."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 8)) * 10
    data = middles[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))
    rows = [("e", "canonical_md", i, v.astype("float32").tolist()) for i, v in enumerate(data)]
    index = spark.createDataFrame(rows, "entity_id string, rep_name string, chunk_index long, embedding array<float>")
    queries = index.filter("chunk_index % 7 = 0").select(F.col("chunk_index").alias("query_id"), "embedding")
    for metric in ("l2", "cosine"):
        path = str(tmp_path / metric)
        V.write_vector_index(index, path, 8, cells=20, metric=metric)
        written = V.VectorIndex(spark, path)
        assert written.n.sum() == 1500 and len(written.n) > 10
        exact = V.nearest_written(written, queries, 10)
        assert ranked(exact) == ranked(S.nearest(index, queries, 10, 8, metric))
        assert V.recall(exact, V.nearest_written(written, queries, 10, probe=3)).first()["recall"] >= 0.9
    read = V._pairs(written, queries.withColumn("kth", F.lit(0.0)), 10, None, True).count()
    assert read < 0.3 * queries.count() * 20


def test_cells_of_odd_tables(spark, tmp_path):
    schema = "entity_id string, chunk_index long, embedding array<float>"
    none = spark.createDataFrame([("a", 0, None), ("b", 0, [1.0])], schema)
    V.write_vector_index(none, str(tmp_path / "none"), 2)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    assert V.nearest_written(V.VectorIndex(spark, str(tmp_path / "none")), asked, 3).count() == 0
    few = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [1.0, 0.0]), ("c", 0, [0.0, 5.0])], schema)
    V.write_vector_index(few, str(tmp_path / "few"), 2, cells=9)
    found = V.nearest_written(V.VectorIndex(spark, str(tmp_path / "few")), asked, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["entity_id"], r["rank"]) for r in found] == [(1, "a", 1), (1, "b", 2), (1, "c", 3)]


def test_ann_with_all_cells_is_exact(spark):
    data, index = vectors(spark, 400)
    queries = index.filter("chunk_index < 5").select(F.col("chunk_index").alias("query_id"), "embedding")
    centres = S.fit_cells(index, 6, 8)
    celled = S.assign_cells(index, centres, 8)
    assert ranked(S.search_ann(celled, queries, centres, 5, 8, probe=6)) == brute(data, range(5), 5)
    few = S.search_ann(celled, queries, centres, 1, 8, probe=1)
    # The cell of a query holds the query itself.
    assert ranked(few) == {i: [i] for i in range(5)}


def test_written_postings(spark, tmp_path):
    texts = ["vector search engine", "graph engine", "vector vector", "nothing here"]
    index = spark.createDataFrame([(f"e{i}", i, t) for i, t in enumerate(texts)], "entity_id string, chunk_index long, text string")
    asked = spark.createDataFrame([(1, "vector engine"), (2, "graph")], "query_id int, text string")
    S.write_postings(index, str(tmp_path / "p"), 4)
    cols = ["query_id", "entity_id", "rank", "score"]
    direct = S.search_lexical(index, asked, 3).select(*cols).orderBy("query_id", "rank").collect()
    written = S.search_lexical_written(spark, str(tmp_path / "p"), asked, 3, 4).select(*cols).orderBy("query_id", "rank").collect()
    assert direct == written and len(direct) == 4


def test_long_document_positions(spark):
    # More items than one block of the in-row fold.
    text = "\n".join(f"# h{i}\nbody {i}" for i in range(1500))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = C.split_headers(df).select("start_pos", "text").collect()
    assert len(got) == 1500
    assert all(text[r["start_pos"]:].startswith(r["text"]) for r in got)


def greedy(sizes, limit):
    """Straightforward packing to compare with."""
    groups, current, total = [], [], 0
    for i, n in enumerate(sizes):
        t = n // 4
        if t > limit:
            if current:
                groups.append(current)
            groups.append([i])
            current, total = [], 0
        elif total + t <= limit:
            current.append(i)
            total += t
        else:
            groups.append(current)
            current, total = [i], t
    return groups + ([current] if current else [])


def test_packing_against_brute_force(spark):
    rnd = random.Random(11)
    cases = [[rnd.choice([0, 3, 8, 20, 40, 70]) for _ in range(rnd.randint(1, 700))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, sizes array<long>")
    for r in df.select("id", C.pack(F.transform("sizes", lambda n: F.floor(n / 4)), 12).alias("g")).collect():
        want = greedy(cases[r["id"]], 12)
        assert [(g["first"], g["last"]) for g in r["g"]] == [(w[0], w[-1]) for w in want]


def test_windows_of_a_long_document_are_built_in_blocks(spark, monkeypatch):
    text = "\n\n".join(f"Paragraph {i} of the text has some words." for i in range(300))
    docs = spark.createDataFrame([(1, text, 7), (2, "short", 8), (3, "", 9), (4, None, 9)], "id long, text string, at int")
    cfg = C.ChunkConfig(chunk_tokens=8)
    got = {}
    for block in (1, 5, 64, 10_000):
        monkeypatch.setattr(C, "WINDOW_BLOCK", block)
        got[block] = C.chunk_documents(docs, cfg).orderBy("id", "chunk_index").collect()
    assert len(got[64]) > 200 and got[64][0]["at"] == 7
    assert got[1] == got[5] == got[64] == got[10_000]
    own = [r["text"] for r in got[64] if r["id"] == 1]
    assert [r["chunk_index"] for r in got[64] if r["id"] == 1] == list(range(len(own)))
    for i in (0, 3, 63, 64, 67, 130, len(own) - 1):
        around = own[max(0, i - cfg.half_window): i + cfg.half_window + 1]
        assert got[64][i]["embedding_text"] == "\n\n".join(around)
