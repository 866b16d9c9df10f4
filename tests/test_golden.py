"""Golden cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import hash16, slugify, split_lines, truncate_center
from tarn.operators import chunking as C
from tarn.operators import entities as E
from tarn.operators import library as B
from tarn.operators import lineage as L
from tarn.operators import search as S
from tarn.operators import vfs as V
from tarn.schema import ext_routes, lineage_rules
from tarn.sources import index_table as X
from tarn.streaming import changes as W
from tarn.streaming import tasks as T


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_headers(docs):
    got = C.split_headers(docs("# Title 1\nContent 1\n# Title 2\nContent 2")).collect()
    assert [r["header"] for r in got] == ["Title 1", "Title 2"]
    got = rows(C.split_headers(docs("Intro text\n# First Header\nBody")), "header", "level", "start_pos", "text")
    assert got == [(None, 0, 0, "Intro text"), ("First Header", 1, 11, "# First Header\nBody")]
    assert C.split_headers(docs("")).count() == 0
    odd = rows(C.split_headers(docs("#no\n####### seven\n#\n# \n## yes  \n")), "header", "level")
    assert odd == [(None, 0), ("yes", 2)]


def test_tables(docs):
    text = "Some text\n| A | B |\n|---|---|\n| 1 | 2 |\nMore text"
    assert rows(C.find_tables(docs(text)), "start_line", "end_line") == [(1, 3)]
    assert C.find_tables(docs("a|b\ntext\nc|d\ne")).count() == 2
    assert rows(C.find_tables(docs("x\na|b")), "start_line", "end_line") == [(1, 1)]


def test_center_and_slug(spark):
    assert one(spark, truncate_center(F.lit("0123456789"), 4)) == "3456"
    assert one(spark, truncate_center(F.lit("0123456789"), 5)) == "23456"
    assert one(spark, slugify(F.lit("Q3 Pricing!"))) == "q3-pricing"
    assert one(spark, slugify(F.lit("***"))) == "section"
    assert one(spark, slugify(F.lit("Über uns_2"))) == "über-uns-2"


def test_packing(docs):
    text = "\n\n".join("x" * n for n in (12, 16, 20, 4, 36))
    got = rows(C.pack_paragraphs(docs(text), 8), "chunk_type", "chunk_chars", "start_pos", "is_truncated")
    assert got == [
        ("paragraph_group", 28, 0, False), ("paragraph_split", 24, 32, False),
        ("forced_split", 32, 60, True), ("forced_split", 4, 92, True),
    ]


def test_packing_with_first_offsets(docs):
    text = "\n\n".join("x" * n for n in (12, 16, 20, 4, 36))
    got = rows(C.pack_paragraphs(docs(text), 8, compat=True), "start_pos", "end_pos")
    # A paragraph position counts lines there.
    assert got == [(0, 30), (4, 30), (8, 40), (40, 44)]
    hard = "a" * 10 + ". " + "b" * 60 + ". " + "c" * 5
    default = rows(C.pack_paragraphs(docs(hard), 8), "start_pos")
    compat = rows(C.pack_paragraphs(docs(hard), 8, compat=True), "start_pos")
    assert [r[0] for r in default] == [0, 11, 43, 73]
    assert [r[0] for r in compat] == [0, 11, 43, 11]


def test_own_token_count(docs):
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    cfg = C.ChunkConfig(chunk_tokens=3, tokens=words)
    got = rows(C.chunk_documents(docs("a b\n\nc\n\nd e. f g h i."), cfg), "text", "token_count")
    assert got == [("a b\n\nc", 3), ("d e.", 2), (" f g h i.", 5)]


def test_window_truncation(spark):
    texts = F.array(*[F.lit("x" * n) for n in (5, 3, 10, 4, 6)])
    kept = one(spark, C.truncate_window(texts, F.lit(2), 20))
    assert [len(t) for t in kept] == [3, 10]


def test_sliding_window(docs):
    got = C.chunk_documents(docs("# A\nx\n# B\ny\n# C\nz"), C.ChunkConfig(window_size=3)).collect()
    assert got[1]["embedding_text"] == "\n\n".join(r["text"] for r in got)
    assert all(r["text"] in r["embedding_text"] for r in got)
    even = C.chunk_documents(docs("# A\nx\n# B\ny\n# C\nz"), C.ChunkConfig(window_size=2)).collect()
    assert [r["window_size"] for r in even] == [2, 3, 2]


def test_library_sections(docs):
    got = B.split_library_sections(docs("# A\nx\n## B\ny\n# C\nz")).collect()
    assert [([h for h in r["headers"] if h], r["content"], r["start_pos"]) for r in got] == [
        (["A"], "x", 4), (["A", "B"], "y", 11), (["C"], "z", 17),
    ]


def test_separators(docs):
    df = docs("---", "***", "--").withColumnRenamed("text", "content")
    assert rows(B.drop_separators(df), "content") == [("--",)]


def test_rrf(spark):
    def channel(names):
        return spark.createDataFrame(
            [(1, n, "canonical_md", 0, i + 1) for i, n in enumerate(names)],
            "query_id int, entity_id string, rep_name string, chunk_index int, rank int",
        )

    fused = S.fuse_rrf([(channel("ABC"), 0.7), (channel("BD"), 0.3)], 10)
    got = {r["entity_id"]: round(r["score"], 7) for r in fused.collect()}
    assert got == {"B": 0.0162084, "A": 0.0114754, "C": 0.0111111, "D": 0.0048387}


def test_no_hit(spark, docs):
    index = docs("Python is a programming language").select(
        F.lit("e").alias("entity_id"), F.col("id").alias("chunk_index"), "text"
    )
    asked = spark.createDataFrame([(1, "zzz_nonexistent_zzz")], "query_id int, text string")
    assert S.search_lexical(index, asked).count() == 0
    assert S.search_substring(index, asked).count() == 0


def tree(spark, content="line1\nline2\nTARGET LINE\nline4\nline5"):
    entities = spark.createDataFrame(
        [("w", "c", "e1", "document", "doc1.md", "enabled", "h", 1, ["x"])],
        "workspace_id string, collection_id string, entity_id string, entity_type string, name string, "
        "status string, content_hash string, version int, labels array<string>",
    )
    reps = spark.createDataFrame(
        [("w", "c", "e1", "source_original", 9, content), ("w", "c", "e1", "canonical_md", 9, "nothing")],
        "workspace_id string, collection_id string, entity_id string, rep_type string, size long, content string",
    )
    return V.vfs_tree(entities, reps), reps


def test_glob(spark):
    found = V.vfs_glob(tree(spark)[0], "**/*.md")
    assert sorted(r["path"] for r in found.collect()) == ["/doc1.md", "/doc1.md/canonical.md"]
    assert V.vfs_glob(tree(spark)[0], "/doc[!2-9].md").count() == 1


def test_grep(spark):
    t, reps = tree(spark)
    hit = V.vfs_grep(t, reps, "target").collect()
    assert [(h["line_number"], h["context_before"], h["context_after"]) for h in hit] == [
        (3, ["line1", "line2"], ["line4", "line5"])
    ]
    assert V.vfs_grep(t, reps, "[invalid").count() == 0
    assert V.vfs_grep(t, reps, "target", prefix="/other").count() == 0
    assert V.vfs_grep(t, reps, "line", limit=2).count() == 2


def test_split_lines(spark):
    assert one(spark, split_lines(F.lit("a\r\nb\x0cc\n"))) == ["a", "b", "c"]
    assert one(spark, split_lines(F.lit("a\n\n"))) == ["a", ""]
    assert one(spark, split_lines(F.lit(""))) == []


def test_cascade(spark):
    changed = spark.createDataFrame([("e", "source_original")], "entity_id string, rep_type string")
    got = {r["rep_type"] for r in L.cascade_stale(changed, lineage_rules(spark)).collect()}
    assert got == {"canonical_md", "rep_pdf", "page_image"}


def drift(spark, meta, reps, index):
    key = "workspace_id string, collection_id string, entity_id string"
    frame = lambda data, extra: spark.createDataFrame([("w", "c", "e", *d) for d in data], key + extra)
    found = L.detect_drift(
        frame([()], ""), frame(meta, ", content_hash string"), frame(reps, ", rep_type string, content_hash string"),
        frame(index, ", rep_name string, chunk_index int, text string"),
    )
    return sorted((r["drift_type"], r["detail"].split()[-3] if r["drift_type"] == "missing_rep" else "") for r in found.collect())


def test_drift(spark):
    source, canonical = ("source_original", "h"), ("canonical_md", "h")
    chunk = ("canonical_md", 0, "t")
    assert drift(spark, [("h",)], [source], []) == [("missing_rep", "canonical_md")]
    assert drift(spark, [("h",)], [source, canonical], []) == [("missing_index", "")]
    assert drift(spark, [], [source], [chunk]) == [("missing_meta", "")]
    assert drift(spark, [("old",)], [source, canonical], [chunk]) == [("stale_rep", "")]
    assert drift(spark, [("h",)], [source, canonical], [chunk]) == []


def test_file_changes(spark):
    snap = lambda d: spark.createDataFrame(list(d.items()), "path string, content_hash string")
    got = W.file_changes(snap({"a": "h1", "b": "h2"}), snap({"b": "h3", "c": "h4"}))
    assert {r["path"]: r["event_type"] for r in got.collect()} == {"c": "created", "b": "modified", "a": "deleted"}
    assert W.file_changes(None, snap({"a": "h1"})).count() == 0


def test_backoff(spark):
    tasks = spark.createDataFrame([(a,) for a in range(5)], "attempts long").withColumn(
        "last_attempt_at", F.lit("2024-01-01").cast("timestamp")
    )
    got = rows(T.next_attempts(tasks).orderBy("attempts"), "retry_in", "status")
    assert got == [(2, "pending"), (4, "pending"), (8, "pending"), (16, "pending"), (None, "failed")]


def test_versions(spark):
    clock = F.lit("2024-01-01").cast("timestamp")
    rows_ = spark.createDataFrame([("w", "c", "a.md", bytearray(b"abc"))], "workspace_id string, collection_id string, name string, content binary")
    entity = E.new_entities(rows_, clock).drop("content")
    assert entity.first()["entity_id"] == "ent_ba7816bf8f01cfea"
    seen, triggers = [entity.first()["version"]], []
    for text in ("b", "c", "d"):
        new = entity.select(*E.ENTITY_KEY, F.lit(text).alias("content"))
        entity, log, reps = E.update_content(entity, new, clock)
        seen.append(entity.first()["version"])
        triggers.append(log.first()["trigger"])
        assert reps.first()["rep_type"] == "source_original"
    assert seen == [1, 2, 3, 4] and triggers == ["content_update"] * 3
    _, log, reps = E.update_content(entity, entity.select(*E.ENTITY_KEY, F.lit("d").alias("content")), clock)
    assert log.count() == 0 and reps.count() == 0


def test_migration(spark):
    old = spark.createDataFrame([(1,)], "chunk_index int")
    df, version, applied = X.migrate(old, 0)
    assert df.first()["rep_name"] == "canonical_md" and (version, applied) == (2, 1)
    assert X.migrate(df, version)[1:] == (2, 0)

    def fail(_):
        raise RuntimeError("step failed")

    with pytest.raises(RuntimeError):
        X.migrate(old, 0, {1: fail, 2: X.MIGRATIONS[2]})


def test_ids(spark):
    ids = spark.createDataFrame([(v,) for v in ("ws_1", "a.b-c", "", "../x", "a/b", "a b", "a\\b", "a\n")], "id string")
    good, bad = E.validate_ids(ids, "id")
    assert {r["id"] for r in good.collect()} == {"ws_1", "a.b-c"} and bad.count() == 6


def test_upsert(spark):
    schema = "workspace_id string, collection_id string, entity_id string, rep_name string, chunk_index int, text string"
    row = lambda e, i, t: ("w", "c", e, "canonical_md", i, t)
    target = spark.createDataFrame([row("a", 0, "version 1"), row("b", 0, "other")], schema)
    staged = spark.createDataFrame([row("a", 0, "version 2"), row("a", 1, "extra chunk")], schema)
    got = {r["text"] for r in X.replace_reps(target, staged).collect()}
    assert got == {"version 2", "extra chunk", "other"}


def test_event_history(spark):
    events = spark.range(1500).select(
        F.col("id").alias("event_id"), F.lit("x").alias("event_type"), F.timestamp_seconds("id").alias("ts")
    )
    got = [r["event_id"] for r in E.event_history(events, None, 1000).collect()]
    assert got == list(range(500, 1500))


def test_routes(spark):
    names = spark.createDataFrame([("a.MD",), ("b.pdf",), ("c.xyz",), ("noext",), ("d.wps",)], "name string")
    got = {r["name"]: (r["format"], r["entity_type"]) for r in E.route_files(names, ext_routes(spark)).collect()}
    assert got == {"a.MD": ("md", "document"), "b.pdf": ("pdf", "document"), "c.xyz": ("xyz", None),
                   "noext": (None, None), "d.wps": ("wps", "document")}


def test_hash(spark):
    assert one(spark, hash16(F.lit("abc"))) == "ba7816bf8f01cfea"
