"""Equal contents in two collections, long and circular rule graphs, many queries."""

import pytest
from pyspark.sql import functions as F
from test_scale import brute, ranked, vectors

from tarn.operators import entities as E
from tarn.operators import lineage as L
from tarn.operators import search as S


def rules(spark, pairs):
    return spark.createDataFrame(pairs, "input_rep string, output_rep string")


def test_long_chain(spark):
    chain = rules(spark, [(f"r{i:02}", f"r{i + 1:02}") for i in range(40)])
    down = {r["rep_type"]: r["depth"] for r in L.lineage(chain, "r00").collect()}
    assert down == {f"r{i:02}": i for i in range(1, 41)}
    changed = spark.createDataFrame([("e", "r00")], "entity_id string, rep_type string")
    assert L.cascade_stale(changed, chain).count() == 40


def test_wide_diamonds(spark):
    # 3 ** 18 paths between the ends.
    pairs = []
    for i in range(18):
        for side in "abc":
            pairs += [(f"n{i}", f"n{i}{side}"), (f"n{i}{side}", f"n{i + 1}")]
    found = L.rule_closure(rules(spark, pairs)).filter("input_rep = 'n0' AND output_rep = 'n18'").collect()
    assert [r["depth"] for r in found] == [36]


def test_longest_path_counts(spark):
    depth = L.rule_closure(rules(spark, [("a", "b"), ("b", "c"), ("a", "c")])).filter("output_rep = 'c' AND input_rep = 'a'")
    assert depth.first()["depth"] == 2


def test_cycle(spark):
    circle = rules(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    with pytest.raises(ValueError, match="'a', 'b'"):
        L.rule_closure(circle)
    assert {tuple(r) for r in L.reachable(circle).collect()} == {(x, y) for x in "ab" for y in "abc"}


def test_no_rules(spark):
    assert L.rule_closure(rules(spark, [])).count() == 0


TWO = "workspace_id string, collection_id string, entity_id string, "


def two_scopes(spark):
    rows = [(w, "c", f"e{i}", i, f"word{i} shared", [float(i), 1.0]) for w in ("w1", "w2") for i in range(3)]
    return spark.createDataFrame(rows, TWO + "chunk_index long, text string, embedding array<double>")


def test_search_across_collections(spark):
    index = two_scopes(spark)
    queries = spark.createDataFrame([(1, "word0", [0.0, 1.0])], "query_id int, text string, embedding array<double>")
    for found in (
        S.search_semantic(index, queries, 2, 2),
        S.search_lexical(index, queries, 2),
        S.search_hybrid(index, queries, 2, 2),
    ):
        got = sorted((r["rank"], r["workspace_id"], r["entity_id"]) for r in found.collect())
        assert got == [(1, "w1", "e0"), (2, "w2", "e0")]


def test_hidden_in_one_scope(spark):
    states = [("w1", "c", "e0", "hidden"), ("w2", "c", "e0", "enabled")]
    entities = spark.createDataFrame(states, TWO + "status string")
    seen = S.visible_chunks(two_scopes(spark), entities).collect()
    assert [(r["workspace_id"], r["entity_id"]) for r in seen] == [("w2", "e0")]
    with pytest.raises(ValueError, match="different columns"):
        S.visible_chunks(two_scopes(spark), entities.drop("workspace_id"))


def test_delete_in_one_scope(spark):
    entities = two_scopes(spark).select("workspace_id", "collection_id", "entity_id", F.lit("enabled").alias("status"))
    entities = entities.withColumn("updated_at", F.current_timestamp())
    gone = spark.createDataFrame([("w1", "c", "e0")], TWO.rstrip(", "))
    left = E.delete_entities(entities, gone, F.current_timestamp(), hard=True)
    assert left.count() == 5 and left.filter("entity_id = 'e0'").first()["workspace_id"] == "w2"


def test_ann_in_batches(spark, monkeypatch):
    data, index = vectors(spark, 200)
    queries = index.filter("chunk_index < 9").select(F.col("chunk_index").alias("query_id"), "embedding")
    centres = S.fit_cells(index, 4, 8)
    celled = S.assign_cells(index, centres, 8)
    whole = ranked(S.search_ann(celled, queries, centres, 3, 8, probe=2))
    monkeypatch.setattr(S, "ANN_BATCH", 3)
    assert ranked(S.search_ann(celled, queries, centres, 3, 8, probe=2)) == whole
    assert ranked(S.search_ann(celled, queries, centres, 3, 8, probe=4)) == brute(data, range(9), 3)


def test_equal_vectors_are_at_distance_zero(spark):
    _, index = vectors(spark, 200)
    unit = index.withColumn("embedding", F.transform("embedding", lambda x: x / 3.0))
    found = S.nearest(unit, unit.select(F.col("chunk_index").alias("query_id"), "embedding"), 1, 8)
    assert {r["distance"] for r in found.collect()} == {0.0}


def test_null_text_on_both_sides(spark, monkeypatch):
    rows = [("a", 0, "red fox"), ("b", 1, None), ("c", 2, "fox"), ("d", 3, "")]
    index = spark.createDataFrame(rows, "entity_id string, chunk_index long, text string")
    asked = spark.createDataFrame([(1, "fox"), (2, "red fox")], "query_id int, text string")

    def run():
        return sorted((r["query_id"], r["rank"], r["entity_id"], r["score"]) for r in S.rank_chunks(index, asked, 3).collect())

    small = run()
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 0)
    assert run() == small and len(small) == 4


def scoped(spark, rows, columns):
    return spark.createDataFrame(rows, f"workspace_id string, collection_id string, {columns}")


def test_edges_stay_in_their_collection(spark):
    edges = scoped(spark, [("w", "a", "x", "y"), ("w", "b", "x", "y")], "src string, dst string")
    entities = scoped(spark, [("w", "a", "x", "stale"), ("w", "a", "x", "deleted"), ("w", "b", "y", "stale")], "entity_id string, status string")
    got = {(r["collection_id"], r["status"]) for r in L.edge_status(edges, entities).collect()}
    assert got == {("a", "deleted"), ("b", "stale")} and L.edge_status(edges, entities).count() == 2
    seeds = scoped(spark, [("w", "a", "y")], "entity_id string")
    reached = [(r["collection_id"], r["entity_id"], r["hop"]) for r in L.neighbors(edges, seeds, 2).orderBy("hop").collect()]
    assert reached == [("a", "y", 0), ("a", "x", 1)]
    with pytest.raises(ValueError, match="differently"):
        L.edge_status(edges, entities.drop("workspace_id"))


def test_hits_changes_and_evidence_keep_their_collection(spark):
    chunks = scoped(spark, [("w", "a", "x", 0, 0), ("w", "b", "x", 7, 5)], "entity_id string, chunk_index long, start_pos long")
    hits = scoped(spark, [("w", "a", "x", 1, 9), ("w", "b", "x", 2, 9)], "entity_id string, hit_id long, position long")
    located = {(r["collection_id"], r["hit_id"]): r["chunk_index"] for r in S.locate_hits(hits, chunks).collect()}
    assert located == {("a", 1): 0, ("b", 2): 7}
    state = "entity_id string, scope string, name string, content_hash string, status string"
    old = scoped(spark, [("w", "a", "x", "raw", "f", "1", "ok"), ("w", "b", "x", "raw", "f", "1", "ok")], state)
    new = scoped(spark, [("w", "a", "x", "raw", "f", "2", "ok"), ("w", "b", "x", "raw", "f", "1", "ok")], state)
    assert [(r["collection_id"], r["change"]) for r in L.classify_changes(old, new).collect()] == [("a", "C1")]
    found = scoped(spark, [("w", "a", 1, "x", "0", 2.0), ("w", "b", 1, "x", "0", 1.0)], "query_id long, entity_id string, evidence_id string, score double")
    none = found.limit(0)
    assert [r["collection_id"] for r in S.evidence_pack(found, none, none, 5).orderBy("rank").collect()] == ["a", "b"]


def test_layout_blocks_of_a_chunk(spark):
    from tarn.operators.chunking import align_layout

    chunks = scoped(spark, [("w", "a", "x", 0, 0, 10), ("w", "b", "x", 0, 0, 10)], "entity_id string, chunk_index long, start_pos long, end_pos long")
    blocks = scoped(
        spark,
        [("w", "a", "x", 2, 1, 4, 12, "table", 0, [0.0, 1.0]), ("w", "a", "x", 1, 0, 0, 4, "heading", 2, None), ("w", "b", "x", 9, 5, 20, 30, "text", 0, None)],
        "entity_id string, block_id long, page long, start_pos long, end_pos long, type string, level int, bbox array<double>",
    )
    got = {r["collection_id"]: r for r in align_layout(chunks, blocks).collect()}
    assert [tuple(b) for b in got["a"]["layout_blocks"]] == [(1, 0, "heading", 2, None), (2, 1, "table", 0, [0.0, 1.0])]
    assert (got["a"]["block_count"], got["a"]["primary_page"], got["a"]["last_block"], got["b"]["block_count"]) == (2, 0, 2, 0)


def test_sql_names_are_private(spark):
    from tarn.operators.tables import query_table, query_tables

    first, second = spark.range(3), spark.range(5)
    a, b = query_table(first, "SELECT count(*) AS n FROM t"), query_table(second, "WITH u AS (SELECT * FROM t) SELECT count(*) AS n FROM u")
    assert (a.first()["n"], b.first()["n"]) == (3, 5)
    assert query_tables({"x": first, "y": second}, "SELECT count(*) AS n FROM x JOIN y USING (id);").first()["n"] == 3
    assert not [v for v in spark.catalog.listTables() if v.name in ("t", "x", "y") or v.name.startswith("query_")]
