"""Vector and search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.checks.base import query, table, texts
from tarn.checks.entities import with_status
from tarn.functions.rowid import with_row_id
from tarn.functions.vectors import cosine, l2_normalize, mrl_truncate
from tarn.operators import search as S
from tarn.operators import text_index as X
from tarn.operators import vector_index as V
from tarn.operators.embedding import embedding_input, hashed_embedder, embed, mock_embed
from tarn.session import durable, scratch_path

DIM = 64


def vector_index(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("entity_id"),
        F.lit("canonical_md").alias("rep_name"),
        F.col("vec_id").alias("chunk_index"),
        "embedding",
        "label",
    )


def centroids(spark, sf):
    """One query per label: the mean of its vectors."""
    mean = F.array(*[F.avg(F.col("embedding")[i]).cast("float") for i in range(DIM)])
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("query_id")).agg(
        mean.alias("embedding")
    )


CENTRES_SQL = """centres AS (
  SELECT label::bigint AS query_id, list(m ORDER BY i) AS qv FROM (
    SELECT label, i, avg(x)::float::double AS m
    FROM (SELECT label, unnest(embedding)::double AS x, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label)"""


def topk_sql(source: str, k: int, distance: str = "list_distance(e.embedding::double[], q.qv)") -> str:
    return f"""SELECT query_id, entity_id, chunk_index, score, rank FROM (
  SELECT q.query_id, 'v' || e.vec_id AS entity_id, e.vec_id AS chunk_index, round({distance}, 6) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY round({distance}, 9), 'v' || e.vec_id) AS rank
  FROM {source} e, centres q) WHERE rank <= {k}"""


def ranked(df, score="score"):
    return df.select(
        "query_id", "entity_id", "chunk_index", F.round(score, 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query("l2_normalize", """SELECT vec_id, round(list_sum([x * x for x in v]), 6) AS norm2, round(v[1], 6) AS first
FROM (SELECT vec_id, [x * 3 / sqrt(list_sum([y * y * 9 for y in embedding::double[]])) for x in embedding::double[]] AS v FROM embeddings)""")
def normalize(spark, sf):
    tripled = table(spark, sf, "embeddings").select(
        "vec_id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v")
    )
    return tripled.select(
        "vec_id",
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"),
        F.round(F.col("v")[0], 6).alias("first"),
    )


@query("cosine_to_centroid", f"""WITH {CENTRES_SQL} SELECT vec_id, round(list_cosine_similarity(embedding::double[], qv), 6) AS similarity
FROM embeddings e JOIN centres q ON q.query_id = e.label""")
def cosine_to_centroid(spark, sf):
    mean = centroids(spark, sf).withColumnRenamed("embedding", "centre")
    joined = table(spark, sf, "embeddings").join(mean, F.col("label") == F.col("query_id"))
    return joined.select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


@query("embedding_input", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE role || ': ' || text END AS input FROM conversations""")
def embedding_inputs(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "embedding_text", F.when(F.col("role") == "user", F.lit("")).otherwise(F.concat("role", F.lit(": "), "text"))
    )
    return rows.select("conv_id", "turn", embedding_input(rows).alias("input"))


@query("semantic_topk", f"WITH {CENTRES_SQL} {topk_sql('embeddings', 5)}")
def semantic_topk(spark, sf):
    return ranked(S.search_semantic(vector_index(spark, sf), centroids(spark, sf), 5, DIM))


@query("semantic_topk_cosine", f"WITH {CENTRES_SQL} {topk_sql('embeddings', 5, '1 - list_cosine_similarity(e.embedding::double[], q.qv)')}")
def semantic_topk_cosine(spark, sf):
    return ranked(S.search_semantic(vector_index(spark, sf), centroids(spark, sf), 5, DIM, "cosine"))


@query(
    "search_across_collections",
    f"""WITH {CENTRES_SQL}, scoped AS (
  SELECT query_id, 'v' || (vec_id // 2) AS entity_id, 'w' || (vec_id % 2) AS workspace_id,
         round(list_distance(e.embedding::double[], q.qv), 9) AS dist FROM embeddings e, centres q)
SELECT query_id, entity_id, workspace_id, round(dist, 5) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY dist, entity_id, workspace_id) AS rank
FROM scoped QUALIFY rank <= 20""",
)
def search_across_collections(spark, sf):
    """Every entity id is found in two workspaces, as ids of equal contents are."""
    index = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id") % 2).alias("workspace_id"), F.lit("c").alias("collection_id"),
        F.concat(F.lit("v"), F.floor(F.col("vec_id") / 2)).alias("entity_id"), F.lit("canonical_md").alias("rep_name"),
        F.lit(0).cast("long").alias("chunk_index"), "embedding",
    )
    found = S.search_semantic(index, centroids(spark, sf), 20, DIM)
    return found.select(
        "query_id", "entity_id", "workspace_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "mrl_topk",
    f"""WITH {CENTRES_SQL},
n AS (SELECT vec_id, [x / sqrt(list_sum([y * y for y in embedding[1:16]::double[]])) for x in embedding[1:16]::double[]] AS v FROM embeddings),
m AS (SELECT query_id, [x / sqrt(list_sum([y * y for y in qv[1:16]])) for x in qv[1:16]] AS qv FROM centres)
SELECT query_id, entity_id, score, rank FROM (
  SELECT query_id, 'v' || vec_id AS entity_id, round(list_distance(v, qv), 5) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, qv), 'v' || vec_id) AS rank FROM n, m)
WHERE rank <= 5""",
)
def mrl_topk(spark, sf):
    cut = lambda df: df.withColumn("embedding", mrl_truncate(F.col("embedding"), 16))
    found = S.search_semantic(cut(vector_index(spark, sf)), cut(centroids(spark, sf)), 5, 16)
    return found.select("query_id", "entity_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def text_index(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"),
        F.lit("canonical_md").alias("rep_name"),
        F.lit(0).cast("long").alias("chunk_index"),
        "text",
    )


def text_queries(spark, sf):
    """Query texts: every benchmark item."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def written_texts(spark, sf, grams=True):
    """The text index of all documents, written for this run."""
    path = scratch_path(spark, "text-index")
    X.write_text_index(text_index(spark, sf), path, grams=grams)
    return X.TextIndex(spark, path)


BM25_SQL = r"""chunk AS (SELECT 'doc_' || doc_id AS entity_id, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM chunk),
post AS (SELECT term, entity_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT unnest(toks) AS term, entity_id, len(toks) AS dl FROM chunk) GROUP BY ALL),
ask AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT query_id, entity_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
           / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 9) AS score
  FROM ask JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM bm)"""


LEXICAL_SQL = f"""WITH {BM25_SQL} SELECT query_id, entity_id, 0::bigint AS chunk_index, round(score, 6) AS score, rank
FROM lex WHERE rank <= 10"""


@query("lexical_bm25", LEXICAL_SQL)
def lexical_bm25(spark, sf):
    return ranked(X.search_lexical_written(written_texts(spark, sf, grams=False), text_queries(spark, sf), 10))


@query("lexical_scan", LEXICAL_SQL)
def lexical_scan(spark, sf):
    """The same without an index: every text is read."""
    return ranked(S.search_lexical(text_index(spark, sf), text_queries(spark, sf), 10))


@query("lexical_joined", LEXICAL_SQL)
def lexical_joined(spark, sf):
    """The same over written blocks by joins, as batches of any size are ranked."""
    return ranked(X._rank_joined(written_texts(spark, sf, grams=False), text_queries(spark, sf), 10))


@query("lexical_written", LEXICAL_SQL)
def lexical_written(spark, sf):
    """The same ranking over postings written by term bucket."""
    path = scratch_path(spark, "postings")
    S.write_postings(text_index(spark, sf), path, 16)
    return ranked(S.search_lexical_written(spark, path, text_queries(spark, sf), 10, 16))


@query(
    "lexical_postings",
    r"""SELECT term, 'doc_' || doc_id AS entity_id, count(*) AS tf, any_value(dl)::bigint AS dl
FROM (SELECT unnest(toks) AS term, doc_id, len(toks) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents))
GROUP BY term, doc_id""",
)
def lexical_postings(spark, sf):
    return S.lexical_postings(text_index(spark, sf)).select("term", "entity_id", "tf", "dl")


SUBSTRING_SQL = """SELECT query_id, entity_id, rank FROM (
  SELECT b.item_id AS query_id, 'doc_' || d.doc_id AS entity_id, row_number() OVER (PARTITION BY b.item_id ORDER BY 'doc_' || d.doc_id) AS rank
  FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))) WHERE rank <= 10"""


@query("search_substring", SUBSTRING_SQL)
def search_substring(spark, sf):
    found = X.search_substring_written(written_texts(spark, sf), text_queries(spark, sf), 10)
    return found.select("query_id", "entity_id", F.col("rank").cast("long").alias("rank"))


@query("substring_scan", SUBSTRING_SQL)
def substring_scan(spark, sf):
    """The same without an index: every text is tested."""
    found = S.search_substring(text_index(spark, sf), text_queries(spark, sf), 10)
    return found.select("query_id", "entity_id", F.col("rank").cast("long").alias("rank"))


@query(
    "substring_words",
    """WITH words AS (
  SELECT row_number() OVER (ORDER BY w) AS query_id, w FROM (
    SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '')
SELECT query_id, count(*) AS n, min('doc_' || doc_id) AS first FROM words JOIN documents ON contains(lower(text), lower(w)) GROUP BY query_id""",
)
def substring_words(spark, sf):
    """Every word of the benchmark as a needle, short ones too: how many documents hold it."""
    words = text_queries(spark, sf).select(F.explode(F.split("text", " ", -1)).alias("text")).where("text <> ''").distinct()
    asked = with_row_id(words, ["text"], "query_id").withColumn("query_id", F.col("query_id") + 1)
    hits = X.substring_hits_written(written_texts(spark, sf), asked)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first"))


def joint_index(spark, sf):
    """All documents under one key, with their vector where they have one."""
    return text_index(spark, sf).join(
        table(spark, sf, "embeddings").select(F.concat(F.lit("doc_"), F.col("vec_id")).alias("entity_id"), "embedding", "label"),
        "entity_id",
        "left",
    )


HYBRID_SQL = f"""{CENTRES_SQL}, {BM25_SQL},
sem AS (
  SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, entity_id) AS rank FROM (
    SELECT b.item_id AS query_id, 'doc_' || e.vec_id AS entity_id, round(list_distance(e.embedding::double[], c.qv), 9) AS dist
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, benchmark b JOIN centres c ON c.query_id = b.item_id % 10)),
parts AS (
  SELECT query_id, entity_id, 0 AS ch, rank, 0.7::double / (60 + rank) AS part FROM sem WHERE rank <= 30
  UNION ALL SELECT query_id, entity_id, 1, rank, 0.3::double / (60 + rank) FROM lex WHERE rank <= 30),
fused AS (SELECT query_id, entity_id, sum(part) AS score, min((ch, rank)) AS first FROM parts GROUP BY ALL)"""


def joint_queries(spark, sf):
    """Benchmark items with the vector of one of the label centroids."""
    return text_queries(spark, sf).withColumn("_c", F.col("query_id") % 10).join(
        centroids(spark, sf).withColumnRenamed("query_id", "_c"), "_c"
    ).drop("_c")


HYBRID_TOP_SQL = f"""WITH {HYBRID_SQL}
SELECT query_id, entity_id, 0::bigint AS chunk_index, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, entity_id) AS rank FROM fused) WHERE rank <= 10"""


@query("hybrid_rrf", HYBRID_TOP_SQL)
def hybrid_rrf(spark, sf):
    written = written_texts(spark, sf, grams=False)
    return ranked(S.search_hybrid(joint_index(spark, sf), joint_queries(spark, sf), 10, DIM, text_index=written))


@query("hybrid_scan", HYBRID_TOP_SQL)
def hybrid_scan(spark, sf):
    """The same without an index of the texts."""
    return ranked(S.search_hybrid(joint_index(spark, sf), joint_queries(spark, sf), 10, DIM))


@query(
    "search_dispatch",
    f"""WITH {CENTRES_SQL}, {BM25_SQL}, sem AS (
  SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, entity_id) AS rank FROM (
    SELECT b.item_id AS query_id, 'doc_' || e.vec_id AS entity_id, round(list_distance(e.embedding::double[], c.qv), 9) AS dist
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, benchmark b JOIN centres c ON c.query_id = b.item_id))
SELECT query_id, entity_id, rank, 'semantic' AS search_type FROM sem WHERE rank <= 5
UNION ALL SELECT query_id, entity_id, rank, 'lexical' FROM lex WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM centres)""",
)
def search_dispatch(spark, sf):
    asked = text_queries(spark, sf).join(centroids(spark, sf), "query_id", "left")
    found = S.search(joint_index(spark, sf), asked, "semantic", 5, dim=DIM)
    return found.select("query_id", "entity_id", F.col("rank").cast("long").alias("rank"), "search_type")


@query(
    "search_filtered",
    f"""WITH {CENTRES_SQL}, ok AS (SELECT e.* FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id
   WHERE coalesce(l.toxic, 0) = 0 AND coalesce(l.quality, 1) = 1 AND e.label >= 5 AND e.vec_id IN (SELECT doc_id FROM documents))
{topk_sql('ok', 5)}""",
)
def search_filtered(spark, sf):
    status = with_status(spark, sf).select(F.concat(F.lit("v"), F.col("doc_id")).alias("entity_id"), "status")
    found = S.search(
        vector_index(spark, sf), centroids(spark, sf), "semantic", 5, entities=status, where=F.col("label") >= 5, dim=DIM
    )
    return ranked(found)


@query(
    "search_within",
    f"""WITH {CENTRES_SQL}, ok AS (SELECT * FROM embeddings WHERE vec_id IN (
   SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING sum(o_totalprice) > 1000000))
{topk_sql('ok', 5)}""",
)
def search_within(spark, sf):
    rich = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).filter("s > 1000000")
    ids = rich.select(F.concat(F.lit("v"), F.col("o_custkey")).alias("entity_id"))
    return ranked(S.search_within(vector_index(spark, sf), centroids(spark, sf), ids, 5, DIM))


@query(
    "search_dual",
    f"""WITH {CENTRES_SQL}, a AS (
  SELECT query_id, 'v' || vec_id AS entity_id, round(list_distance(embedding::double[], qv), 9) AS d, 'first' AS channel FROM embeddings, centres
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, entity_id) <= 5),
b AS (
  SELECT query_id, 'v' || vec_id AS entity_id, round(list_distance(list_reverse(embedding)::double[], qv), 9) AS d, 'second' AS channel FROM embeddings, centres
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, entity_id) <= 5),
m AS (SELECT query_id, entity_id, min(d) AS d, min_by(channel, (d, channel)) AS channel FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, entity_id, round(d, 6) AS score, channel FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, entity_id) <= 5""",
)
def search_dual(spark, sf):
    first = vector_index(spark, sf)
    second = first.withColumn("embedding", F.reverse("embedding"))
    return S.search_dual(first, second, centroids(spark, sf), 5, DIM).select(
        "query_id", "entity_id", F.round("distance", 6).alias("score"), "channel"
    )


@query(
    "evidence_pack",
    f"""WITH {BM25_SQL},
rows AS (
  SELECT b.item_id AS query_id, 'orders' AS entity_id, o_orderkey::varchar AS evidence_id, 'table_row' AS type, 1.0::double AS score, 1 AS o
  FROM benchmark b JOIN orders ON o_custkey = b.item_id),
hits AS (
  SELECT b.item_id AS query_id, 'doc_' || d.doc_id AS entity_id, '0' AS evidence_id, 'grep_hit' AS type, length(d.text)::double AS score, 2 AS o
  FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
alle AS (
  SELECT query_id, entity_id, '0' AS evidence_id, 'chunk' AS type, score, 0 AS o FROM lex WHERE rank <= 8
  UNION ALL SELECT * FROM rows UNION ALL SELECT * FROM hits),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, entity_id, evidence_id) AS type_rank FROM alle)
SELECT query_id, type, entity_id, evidence_id, round(1.0::double / (60 + type_rank), 6) AS fused FROM tr
WHERE type_rank <= 8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY type_rank, o, entity_id, evidence_id) <= 8""",
)
def evidence_pack(spark, sf):
    chunks = S.search_lexical(text_index(spark, sf), text_queries(spark, sf), 8, payload=False).select(
        "query_id", "entity_id", F.col("chunk_index").cast("string").alias("evidence_id"), "score"
    )
    rows = table(spark, sf, "benchmark").join(
        table(spark, sf, "orders"), F.col("o_custkey") == F.col("item_id")
    ).select(
        F.col("item_id").alias("query_id"), F.lit("orders").alias("entity_id"),
        F.col("o_orderkey").cast("string").alias("evidence_id"),
    )
    lengths = table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"), F.length("text").cast("double").alias("score")
    )
    hits = S.substring_hits(text_index(spark, sf), text_queries(spark, sf)).join(lengths, "entity_id").select(
        "query_id", "entity_id", F.col("chunk_index").cast("string").alias("evidence_id"), "score"
    )
    return S.evidence_pack(chunks, rows, hits, 8).select(
        "query_id", "type", "entity_id", "evidence_id", F.round("fused", 6).alias("fused")
    )


@query(
    "locate_hits",
    r"""WITH lines AS (
  SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
pos AS (SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS position FROM lines)
SELECT 'doc_' || doc_id AS entity_id, line AS hit_id, position, least(position // 300, greatest(ceil((total - 300) / 300.0), 0)::bigint) AS chunk_index
FROM (SELECT *, sum(length(txt) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM pos)
WHERE contains(lower(txt), 'the')""",
)
def locate_hits(spark, sf):
    from tarn.functions.arrays import explode_rows, running_offsets
    from tarn.operators.chunking import chunk_fixed

    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"), "text")
    lines = docs.select("entity_id", F.split("text", "\n", -1).alias("ls")).withColumn(
        "at", running_offsets(F.transform("ls", lambda x: F.length(x) + 1))
    )
    hits = explode_rows(lines, ["entity_id"], F.arrays_zip("ls", "at"), "hit_id", "z").filter(
        F.contains(F.lower("z.ls"), F.lit("the"))
    ).select("entity_id", "hit_id", F.col("z.at").alias("position"))
    return S.locate_hits(hits, chunk_fixed(docs, 300))


@query("search_ann")
def search_ann(spark, sf):
    index = vector_index(spark, sf)
    centres = S.fit_cells(index, 8, DIM)
    found = S.search_ann(S.assign_cells(index, centres, DIM), centroids(spark, sf), centres, 5, DIM, probe=4)
    return ranked(found, "distance")


MANY_SQL = """asked AS (
  SELECT vec_id * 8 + r AS query_id, list_concat(embedding[r * 8 + 1:], embedding[:r * 8])::double[] AS qv
  FROM embeddings, (SELECT unnest(range(8)) AS r))"""


def many_queries(spark, sf):
    """Every vector in eight rotations: at sf0.01 more queries than are broadcast."""
    turned = F.concat(F.slice("embedding", F.col("r") * 8 + 1, DIM), F.slice("embedding", 1, F.col("r") * 8))
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r")).select(
        (F.col("vec_id") * 8 + F.col("r")).alias("query_id"), turned.alias("embedding")
    )


def _top_many(distance: str) -> str:
    return f"""WITH {MANY_SQL} SELECT query_id, 'v' || vec_id AS entity_id, vec_id AS chunk_index, round(d, 6) AS score, rank FROM (
  SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, 'v' || vec_id) AS rank FROM (
    SELECT query_id, vec_id, round({distance}, 9) AS d FROM embeddings e, asked)) WHERE rank <= 3"""


@query("semantic_many", _top_many("list_distance(e.embedding::double[], qv)"))
def semantic_many(spark, sf):
    """A query table that does not fit a broadcast, over cells of vectors."""
    return ranked(S.nearest(vector_index(spark, sf), many_queries(spark, sf), 3, DIM), "distance")


@query("semantic_many_cosine", _top_many("1 - list_cosine_similarity(e.embedding::double[], qv)"))
def semantic_many_cosine(spark, sf):
    return ranked(S.nearest(vector_index(spark, sf), many_queries(spark, sf), 3, DIM, "cosine"), "distance")


@query("search_cells", f"WITH {CENTRES_SQL} {topk_sql('embeddings', 5)}")
def search_cells(spark, sf):
    """A kept index of 12 cells, searched exactly in two rounds."""
    path = scratch_path(spark, "vectors")
    V.write_vector_index(vector_index(spark, sf), path, DIM, cells=12)
    return ranked(V.nearest_written(V.VectorIndex(spark, path), centroids(spark, sf), 5), "distance")


@query("search_ann_all_cells", f"WITH {CENTRES_SQL} {topk_sql('embeddings', 5)}")
def search_ann_all_cells(spark, sf):
    """The approximate search with all cells probed."""
    path = scratch_path(spark, "vectors")
    V.write_vector_index(vector_index(spark, sf), path, DIM, cells=12)
    return ranked(V.nearest_written(V.VectorIndex(spark, path), centroids(spark, sf), 5, probe=12), "distance")


@query("search_ann_recall")
def search_ann_recall(spark, sf):
    """Recall at 10 of the approximate search, every vector a query, by cells probed of 12."""
    path = scratch_path(spark, "vectors")
    index = vector_index(spark, sf)
    V.write_vector_index(index, path, DIM, cells=12)
    written, asked = V.VectorIndex(spark, path), index.select(F.col("chunk_index").alias("query_id"), "embedding")
    exact = durable(V.nearest_written(written, asked, 10))
    rows = [V.recall(exact, V.nearest_written(written, asked, 10, probe=p)).withColumn("probe", F.lit(p)) for p in (3, 6, 9, 12)]
    return reduce(DataFrame.unionByName, rows)


def _embed_sql(source: str, key: str, dim: int) -> str:
    return rf"""WITH tok AS (
  SELECT {key}, t, sha256(t) AS h, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM {source}) GROUP BY ALL),
slots AS (
  SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS slot, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN n ELSE -n END)::DOUBLE AS c
  FROM tok GROUP BY ALL),
vectors AS (SELECT {key}, string_agg(slot || ':' || printf('%.5f', (c / z)::FLOAT::DOUBLE), ',' ORDER BY slot) AS v
  FROM slots JOIN (SELECT {key}, sqrt(sum(c * c)) AS z FROM slots GROUP BY ALL) USING ({key}) WHERE c <> 0 GROUP BY ALL)
SELECT {key}, coalesce(v, '') AS v FROM {source} LEFT JOIN vectors USING ({key})"""


def _spelled(vector: str):
    """The components of a vector that are not zero, with their places."""
    placed = F.transform(vector, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    return F.array_join(
        F.transform(F.filter(placed, lambda p: p["x"] != 0), lambda p: F.format_string("%d:%.5f", p["i"], p["x"])), ","
    )


@query("embed_documents", _embed_sql("documents", "doc_id", DIM))
def embed_documents(spark, sf):
    rows = embed(texts(spark, sf, "documents", "doc_id", "text"), hashed_embedder(DIM))
    return rows.select("doc_id", _spelled("embedding").alias("v"))


@query("mock_embed", _embed_sql("conversations", "conv_id, turn", 32))
def mock_embedding(spark, sf):
    rows = mock_embed(table(spark, sf, "conversations").select("conv_id", "turn", "text"), 32)
    return rows.select("conv_id", "turn", _spelled("embedding").alias("v"))
