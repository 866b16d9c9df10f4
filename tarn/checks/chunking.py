"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import MD_SQL, PARA_SQL, blank_separated, markdown, query, table, texts
from tarn.functions.text import count_tokens, slugify, truncate_center
from tarn.operators import chunking as C

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS txt
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {src}))"""

SECTIONS_SQL = r"""marked AS (
  SELECT *, regexp_matches(txt, '^#{1,6}\s.') AS is_h,
         coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM lines),
numbered AS (
  SELECT *, sum(is_h::int) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM marked),
sections AS (
  SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS section_index,
         CASE WHEN first_h THEN trim(regexp_extract(first_line, '^#{1,6}\s+(.*)$', 1)) END AS header,
         CASE WHEN first_h THEN length(regexp_extract(first_line, '^(#+)', 1)) ELSE 0 END::bigint AS level,
         start_pos, text
  FROM (SELECT doc_id, grp, min_by(is_h, line) AS first_h, min_by(txt, line) AS first_line,
               min(pos)::bigint AS start_pos, string_agg(txt, chr(10) ORDER BY line) AS text
        FROM numbered GROUP BY doc_id, grp))"""


def pack_sql(name: str, items: str, limit: int) -> str:
    """Greedy packing of ``items(k, idx, n)`` by recursion over ``idx``."""
    return f"""{name} AS (
  SELECT k, idx, n // 4 AS tok, n // 4 > {limit} AS big, 0 AS grp FROM {items} WHERE idx = 0
  UNION ALL
  SELECT i.k, i.idx,
         CASE WHEN NOT p.big AND p.tok + i.n // 4 <= {limit} THEN p.tok + i.n // 4 ELSE i.n // 4 END,
         i.n // 4 > {limit},
         CASE WHEN NOT p.big AND p.tok + i.n // 4 <= {limit} THEN p.grp ELSE p.grp + 1 END
  FROM {name} p JOIN {items} i ON i.k = p.k AND i.idx = p.idx + 1)"""


def pieces_sql(limit: int, keep_small: bool, compat: bool = False) -> str:
    """Pieces of ``sections(doc_id, section_index, header, level, start_pos, text)``.

    With ``compat`` paragraphs are placed by line, a hard cut does not advance the
    position, and a final sentence mark leaves an empty sentence.
    """
    place = "start_line" if compat else "start_pos"
    moved = "CASE WHEN big THEN 0 ELSE length(text) END" if compat else "length(text)"
    split = "regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+|[^。！？.!?]+')"
    if compat:
        split = f"CASE WHEN regexp_matches(text, '[。！？.!?]$') THEN list_append({split}, '') ELSE {split} END"
    small = f"length(text) // 4 <= {limit}" if keep_small else "false"
    return rf"""slines AS (
  SELECT doc_id, section_index, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS txt
  FROM (SELECT doc_id, section_index, string_split(text, chr(10)) AS ls FROM sections WHERE NOT ({small}))),
spos AS (
  SELECT *, trim(txt) = '' AS blank,
         coalesce(sum(length(txt) + 1) OVER w, 0) AS pos,
         sum((trim(txt) = '')::int) OVER (PARTITION BY doc_id, section_index ORDER BY line) AS isl
  FROM slines WINDOW w AS (PARTITION BY doc_id, section_index ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
para AS (
  SELECT doc_id, section_index, doc_id || '/' || section_index AS k,
         row_number() OVER (PARTITION BY doc_id, section_index ORDER BY isl) - 1 AS idx,
         text, length(text) AS n, start_pos, start_line
  FROM (SELECT doc_id, section_index, isl, string_agg(txt, chr(10) ORDER BY line) AS text,
               min(pos)::bigint AS start_pos, min(line) AS start_line
        FROM spos WHERE NOT blank GROUP BY ALL)),
{pack_sql("ppack", "para", limit)},
pjoin AS (
  SELECT para.*, ppack.tok, ppack.big, ppack.grp FROM para JOIN ppack USING (k, idx)),
pgroups AS (
  SELECT doc_id, section_index, k, grp, big, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text,
         min({place}) AS rel, max(tok) AS tok, sum(n)::bigint AS n, min(idx) AS idx,
         coalesce(lead(big) OVER (PARTITION BY k ORDER BY grp), false) AS before_big
  FROM pjoin GROUP BY doc_id, section_index, k, grp, big),
sent AS (
  SELECT k, idx, sk AS pk, unnest(generate_series(0, len(ss) - 1)) AS sidx, unnest(ss) AS text
  FROM (SELECT k, idx, k || '/' || idx AS sk, {split} AS ss
        FROM pgroups WHERE big)),
sitems AS (SELECT pk AS k, sidx AS idx, length(text) AS n FROM sent),
{pack_sql("spack", "sitems", limit)},
sgroups AS (
  SELECT s.k, s.idx, p.grp AS sgrp, p.big, string_agg(s.text, '' ORDER BY s.sidx) AS text, max(p.tok) AS tok
  FROM sent s JOIN spack p ON p.k = s.pk AND p.idx = s.sidx GROUP BY ALL),
splaced AS (
  SELECT *, coalesce(sum({moved}) OVER (PARTITION BY k, idx ORDER BY sgrp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS off,
         sgrp < max(sgrp) OVER (PARTITION BY k, idx) AS more
  FROM sgroups),
forced AS (
  SELECT k, idx, sgrp, 0 AS cut, off, text, tok, more AS trunc FROM splaced WHERE NOT big
  UNION ALL SELECT k, idx, sgrp, 0, off, substr(text, 1, {limit * 4}), length(substr(text, 1, {limit * 4})) // 4, true FROM splaced WHERE big
  UNION ALL SELECT k, idx, sgrp, 1, off + {limit * 4}, substr(text, {limit * 4 + 1}), length(substr(text, {limit * 4 + 1})) // 4, true
            FROM splaced WHERE big AND length(text) > {limit * 4}),
allp AS (
  SELECT doc_id, section_index, 0 AS g, 0 AS sg, 0 AS cut, text, start_pos, length(text) // 4 AS token_count,
         length(text) AS chunk_chars, 'header_chunk' AS chunk_type, false AS is_truncated, header, level
  FROM sections WHERE {small}
  UNION ALL
  SELECT doc_id, section_index, g.grp, 0, 0, g.text, s.start_pos + g.rel, g.tok, g.n,
         CASE WHEN before_big THEN 'paragraph_split' ELSE 'paragraph_group' END, false, header, level
  FROM pgroups g JOIN sections s USING (doc_id, section_index) WHERE NOT big
  UNION ALL
  SELECT doc_id, section_index, g.grp, f.sgrp, f.cut, f.text, s.start_pos + g.rel + f.off, f.tok, length(f.text),
         'forced_split', f.trunc, header, level
  FROM pgroups g JOIN sections s USING (doc_id, section_index) JOIN forced f ON f.k = g.k AND f.idx = g.idx WHERE big),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, g, sg, cut) - 1 AS chunk_index,
         text, start_pos, start_pos + length(text) AS end_pos, token_count::bigint AS token_count,
         chunk_chars::bigint AS chunk_chars, header, level, chunk_type, is_truncated
  FROM allp)"""


WHOLE_SQL = """sections AS (
  SELECT doc_id, 0 AS section_index, NULL::varchar AS header, 0::bigint AS level, 0::bigint AS start_pos, text FROM {src})"""


@query(
    "split_headers",
    f"""WITH {MD_SQL}, {LINES_SQL.format(src="md")}, {SECTIONS_SQL}
SELECT doc_id, section_index, header, level, start_pos, text FROM sections""",
)
def split_headers(spark, sf):
    return C.split_headers(markdown(spark, sf))


ISLANDS_SQL = """tl AS (
  SELECT doc_id, line, txt, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS isl
  FROM lines WHERE contains(txt, '|')),
tables AS (
  SELECT doc_id, min(line) AS start_line, max(line) AS end_line, string_agg(txt, chr(10) ORDER BY line) AS content
  FROM tl GROUP BY doc_id, isl)"""


@query("find_tables", f"WITH {LINES_SQL.format(src='documents')}, {ISLANDS_SQL} SELECT * FROM tables")
def find_tables(spark, sf):
    return C.find_tables(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "inside_table",
    f"""WITH {LINES_SQL.format(src='documents')}, {ISLANDS_SQL}
SELECT l.doc_id, l.line FROM lines l
WHERE EXISTS (SELECT 1 FROM tables t WHERE t.doc_id = l.doc_id AND l.line BETWEEN t.start_line AND t.end_line)""",
)
def inside_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "_")).select(
        "doc_id", F.col("line").cast("long").alias("line")
    )
    return C.inside_table(lines, C.find_tables(docs), "doc_id")


@query(
    "split_paragraphs",
    f"""WITH {PARA_SQL}, {WHOLE_SQL.format(src="paras_in")},
{pieces_sql(64, False).split("ppack AS (")[0].rstrip().rstrip(",")}
SELECT doc_id, idx AS paragraph_index, text, start_pos, start_line FROM para""",
)
def split_paragraphs(spark, sf):
    return C.split_paragraphs(blank_separated(spark, sf))


@query("count_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


@query(
    "pack_paragraphs",
    f"""WITH RECURSIVE {PARA_SQL}, {WHOLE_SQL.format(src="paras_in")}, {pieces_sql(64, False)}
SELECT doc_id, chunk_index AS piece_index, text, start_pos, end_pos, token_count, chunk_chars, chunk_type, is_truncated
FROM pieces""",
)
def pack_paragraphs(spark, sf):
    return C.pack_paragraphs(blank_separated(spark, sf), 64).drop("header", "level")


@query(
    "pack_paragraphs_compat",
    f"""WITH RECURSIVE {PARA_SQL}, {WHOLE_SQL.format(src="paras_in")}, {pieces_sql(16, False, True)}
SELECT doc_id, chunk_index AS piece_index, text, start_pos, end_pos, token_count, chunk_chars, chunk_type, is_truncated
FROM pieces""",
)
def pack_paragraphs_compat(spark, sf):
    return C.pack_paragraphs(blank_separated(spark, sf), 16, compat=True).drop("header", "level")


@query(
    "split_sentences",
    f"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents WHERE length(text) // 4 > 32),
{WHOLE_SQL.format(src="src")}, {pieces_sql(32, False)}
SELECT doc_id, chunk_index AS piece_index, text, start_pos, end_pos, token_count, chunk_type, is_truncated FROM pieces""",
)
def split_sentences(spark, sf):
    docs = texts(spark, sf).select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return C.split_long_paragraphs(docs, 32).drop("header", "level", "chunk_chars")


@query(
    "slug_anchor",
    rf"""WITH {MD_SQL}, {LINES_SQL.format(src="md")}, {SECTIONS_SQL},
slugged AS (
  SELECT doc_id, section_index, header, start_pos,
         trim(regexp_replace(regexp_replace(lower(header), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') AS s
  FROM sections)
SELECT doc_id, section_index, CASE WHEN header IS NULL OR header = '' THEN '' WHEN s = '' THEN 'section' ELSE s END AS slug,
       start_pos AS char_offset
FROM slugged WHERE NOT ((header IS NULL OR header = '') AND start_pos = 0)""",
)
def slug_anchor(spark, sf):
    sections = C.with_anchor(C.split_headers(markdown(spark, sf)))
    return sections.filter(F.col("anchor").isNotNull()).select("doc_id", "section_index", "anchor.*")


@query(
    "sliding_window",
    """SELECT conv_id, turn AS chunk_index, count(*) OVER w AS window_size,
       string_agg(text, chr(10) || chr(10)) OVER w AS embedding_text
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
)
def sliding_window(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), "text")
    return C.sliding_window(turns, "conv_id", 9, 1_000_000).drop("text")


@query(
    "truncate_window",
    """WITH RECURSIVE n AS (
  SELECT conv_id, turn, text, length(text) AS len,
         count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
win AS (
  SELECT c.conv_id, c.turn, c.text AS centre, c.len AS clen,
         (SELECT sum(o.len + 2) - 2 FROM n o WHERE o.conv_id = c.conv_id AND abs(o.turn - c.turn) <= 4) AS wlen
  FROM n c),
grow AS (
  SELECT conv_id, turn, 0 AS d, turn AS lo, turn AS hi, clen AS length, true AS lopen, true AS ropen
  FROM win WHERE wlen > 900 AND clen < 900
  UNION ALL
  SELECT conv_id, turn, d + 1, CASE WHEN takel THEN turn - d - 1 ELSE lo END, CASE WHEN taker THEN turn + d + 1 ELSE hi END,
         length + CASE WHEN takel THEN l ELSE 0 END + CASE WHEN taker THEN r ELSE 0 END, takel, taker
  FROM (
    SELECT g.*, a.len + 2 AS l, b.len + 2 AS r,
           coalesce(CASE WHEN NOT ropen OR b.len IS NULL OR a.len <= b.len THEN length + a.len + 2 <= 900
             ELSE length + a.len + 2 + CASE WHEN length + b.len + 2 <= 900 THEN b.len + 2 ELSE 0 END <= 900 END AND lopen, false) AS takel,
           coalesce(CASE WHEN NOT lopen OR a.len IS NULL OR b.len < a.len THEN length + b.len + 2 <= 900
             ELSE length + b.len + 2 + CASE WHEN length + a.len + 2 <= 900 THEN a.len + 2 ELSE 0 END <= 900 END AND ropen, false) AS taker
    FROM grow g
    LEFT JOIN n a ON a.conv_id = g.conv_id AND a.turn = g.turn - g.d - 1
    LEFT JOIN n b ON b.conv_id = g.conv_id AND b.turn = g.turn + g.d + 1
    WHERE g.d < 4)),
bounds AS (
  SELECT conv_id, turn, lo, hi FROM grow WHERE d = 4
  UNION ALL SELECT conv_id, turn, turn - 4, turn + 4 FROM win WHERE wlen <= 900)
SELECT b.conv_id, b.turn AS chunk_index, string_agg(o.text, chr(10) || chr(10) ORDER BY o.turn) AS embedding_text, count(*) AS window_size
FROM bounds b JOIN n o ON o.conv_id = b.conv_id AND o.turn BETWEEN b.lo AND b.hi GROUP BY b.conv_id, b.turn
UNION ALL
SELECT conv_id, turn, substr(centre, ((clen - 900) // 2 + 1)::int, 900), 1 FROM win WHERE wlen > 900 AND clen >= 900""",
)
def truncate_window(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), "text")
    return C.sliding_window(turns, "conv_id", 9, 900).drop("text")


@query(
    "truncate_center",
    """SELECT doc_id, CASE WHEN length(text) <= 101 THEN text
       ELSE substr(text, ((length(text) - 101) // 2 + 1)::int, 101) END AS middle FROM documents""",
)
def center(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_center(F.col("text"), 101).alias("middle"))


CHUNKS_SQL = f"{MD_SQL}, {LINES_SQL.format(src='md')}, {SECTIONS_SQL}, {pieces_sql(128, True)}"


@query(
    "chunk_documents",
    f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, chunk_index, text, start_pos, end_pos, token_count, chunk_chars, header, level, chunk_type, is_truncated,
       count(*) OVER w AS window_size, sha256(string_agg(text, chr(10) || chr(10)) OVER w) AS embedding_hash
FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def chunk_documents(spark, sf):
    cfg = C.ChunkConfig(chunk_tokens=128, window_size=5, max_window_length=1_000_000)
    chunks = C.chunk_documents(markdown(spark, sf), cfg)
    return chunks.withColumn("embedding_hash", F.sha2("embedding_text", 256)).drop("embedding_text", "anchor")


@query(
    "chunk_stats",
    f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT lang, count(*) AS chunk_count, sum(token_count)::bigint AS total_tokens, round(avg(token_count), 6) AS avg_tokens
FROM pieces JOIN documents USING (doc_id) GROUP BY lang""",
)
def chunk_stats(spark, sf):
    docs = markdown(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    stats = C.chunk_stats(C.chunk_documents(docs, C.ChunkConfig(chunk_tokens=128)), "lang")
    return stats.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    "window_metadata",
    """SELECT conv_id, turn AS chunk_index, count(*) OVER w AS window_size,
       length(string_agg(text, chr(10) || chr(10)) OVER w) AS embedding_text_chars, role AS chunk_role, role AS window_index
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def window_metadata(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("chunk_index"), "text",
        F.create_map(F.lit("chunk_role"), "role", F.lit("window_index"), "role").alias("caller"),
    )
    windowed = C.window_metadata(C.sliding_window(turns, "conv_id", 3, 1_000_000), "caller")
    return windowed.select(
        "conv_id", "chunk_index",
        F.col("metadata")["window_size"].cast("long").alias("window_size"),
        F.col("metadata")["embedding_text_chars"].cast("long").alias("embedding_text_chars"),
        F.col("metadata")["chunk_role"].alias("chunk_role"),
        F.col("metadata")["window_index"].alias("window_index"),
    )


@query(
    "chunk_fixed",
    """SELECT doc_id, i AS chunk_index, i * 180 AS start_pos, substr(text, (i * 180 + 1)::int, 200) AS text
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 200) / 180.0), 0)::bigint)) AS i FROM documents)""",
)
def chunk_fixed(spark, sf):
    return C.chunk_fixed(table(spark, sf, "documents").select("doc_id", "text"), 200, 20)


SENTENCES_SQL = r"""sents AS (
  SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS chunk_index, unnest(ss) AS text
  FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+|[^。！？.!?]+') AS ss FROM documents)),
placed AS (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_pos
  FROM sents)"""


@query("chunk_sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, chunk_index, start_pos, text FROM placed")
def chunk_sentences(spark, sf):
    return C.chunk_sentences(texts(spark, sf, "documents", "doc_id", "text"))


@query(
    "dedup_chunks",
    f"""WITH {SENTENCES_SQL}
SELECT doc_id, chunk_index, text FROM placed
QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id, chunk_index) = 1""",
)
def dedup_chunks(spark, sf):
    chunks = C.chunk_sentences(texts(spark, sf, "documents", "doc_id", "text"))
    return C.dedup_chunks(chunks, "doc_id").select("doc_id", "chunk_index", "text")


LAYOUT_SQL = f"""{LINES_SQL.format(src="documents")},
boxed AS (
  SELECT doc_id, line AS block_id, line // 10 AS page, pos AS start_pos, least(pos + length(txt) + 1, total) AS end_pos,
         CASE WHEN contains(txt, '|') THEN 'table' ELSE 'text' END AS type
  FROM (SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos,
               sum(length(txt) + 1) OVER (PARTITION BY doc_id)::bigint - 1 AS total FROM lines)),
blocks AS (SELECT * FROM boxed)"""


def _layout_blocks(spark, sf):
    """Layout blocks of a document: its lines, ten to a page; lines with a bar are tables."""
    from tarn.functions.arrays import running_offsets

    return (
        table(spark, sf, "documents")
        .select("doc_id", F.split("text", "\n", -1).alias("ls"), F.length("text").cast("long").alias("total"))
        .withColumn("at", running_offsets(F.transform("ls", lambda x: F.length(x) + 1)))
        .select("doc_id", "total", F.posexplode(F.arrays_zip("ls", "at")).alias("i", "z"))
        .filter(F.col("z.ls").isNotNull())
        .select(
            F.col("doc_id").alias("entity_id"),
            F.col("i").cast("long").alias("block_id"),
            F.floor(F.col("i") / 10).alias("page"),
            F.when(F.contains(F.col("z.ls"), F.lit("|")), F.lit("table")).otherwise(F.lit("text")).alias("type"),
            F.col("z.at").alias("start_pos"),
            F.least(F.col("z.at") + F.length("z.ls") + 1, F.col("total")).alias("end_pos"),
        )
    )


@query(
    "align_layout",
    f"""WITH {LAYOUT_SQL},
chunks AS (
  SELECT doc_id, i AS chunk_index, i * 200 AS start_pos, least(i * 200 + 200, length(text)) AS end_pos
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 200) / 200.0), 0)::bigint)) AS i FROM documents))
SELECT c.doc_id AS entity_id, c.chunk_index, count(b.block_id) AS block_count,
       coalesce(min_by(b.page, b.block_id), -1) AS primary_page, coalesce(max(b.block_id), -1) AS last_block,
       coalesce(string_agg(b.block_id || ' ' || b.type || ' ' || b.page, ',' ORDER BY b.start_pos, b.block_id), '') AS layout_blocks
FROM chunks c LEFT JOIN blocks b ON b.doc_id = c.doc_id AND c.start_pos < b.end_pos AND b.start_pos < c.end_pos
GROUP BY c.doc_id, c.chunk_index""",
)
def align_layout(spark, sf):
    chunks = C.chunk_fixed(table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), "text"), 200)
    chunks = chunks.withColumn("end_pos", F.col("start_pos") + F.length("text"))
    aligned = C.align_layout(chunks, _layout_blocks(spark, sf))
    return aligned.select(
        "entity_id", "chunk_index", "block_count",
        F.coalesce("primary_page", F.lit(-1).cast("long")).alias("primary_page"),
        F.coalesce("last_block", F.lit(-1).cast("long")).alias("last_block"),
        F.coalesce(
            F.array_join(F.transform("layout_blocks", lambda b: F.concat_ws(" ", b["block_id"], b["type"], b["page"])), ","), F.lit("")
        ).alias("layout_blocks"),
    )


@query(
    "layout_coverage",
    f"""WITH {LAYOUT_SQL}
SELECT d.doc_id AS entity_id, coalesce(sum(b.end_pos - b.start_pos), 0)::bigint AS covered,
       coalesce(sum(b.end_pos - b.start_pos), 0) < length(any_value(d.text)) AS stale
FROM documents d LEFT JOIN blocks b USING (doc_id) GROUP BY d.doc_id""",
)
def layout_coverage(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("entity_id"), F.length("text").cast("long").alias("n_chars")
    )
    return C.layout_coverage(docs, _layout_blocks(spark, sf)).drop("n_chars")


@query(
    "chunk_semantic",
    """WITH near AS (
  SELECT label, vec_id,
         list_inner_product(embedding::double[], lag(embedding::double[]) OVER (PARTITION BY label ORDER BY vec_id)) AS dot,
         sqrt(list_inner_product(embedding::double[], embedding::double[])) AS norm
  FROM embeddings),
cut AS (
  SELECT *, coalesce(dot / (norm * lag(norm) OVER (PARTITION BY label ORDER BY vec_id)) < 0.1, false) AS brk FROM near)
SELECT label, vec_id, sum(brk::int) OVER (PARTITION BY label ORDER BY vec_id)::bigint AS segment FROM cut""",
)
def chunk_semantic(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_index")
    return C.chunk_semantic(vectors, "label", 0.1).select(
        "label", F.col("chunk_index").alias("vec_id"), "segment"
    )


@query(
    "chunk_structured",
    """SELECT 'graph_json' AS rep_type, 'c' || c_custkey AS entity_id, 0::bigint AS chunk_index,
       c_name || ' lives in ' || n_name AS text, -1.0::double AS time_start, -1.0::double AS time_end
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'mind_map', 'p' || p_partkey, i, CASE WHEN i = 0 THEN p_name ELSE p_type END, -1, -1
FROM part, (SELECT unnest([0::bigint, 1::bigint]) AS i)
UNION ALL SELECT 'transcript', 'e' || event_id, 0, event_type, value, value + 1 FROM events
UNION ALL SELECT 'table_json', 's' || s_suppkey, 0, '{"name":"' || s_name || '"}', -1, -1 FROM supplier""",
)
def chunk_structured(spark, sf):
    def rep(df, kind, key, content):
        return df.select(
            F.lit(kind).alias("rep_type"), F.expr(key).alias("entity_id"), F.expr(content).alias("content")
        )

    people = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    reps = (
        rep(people, "graph_json", "concat('c', c_custkey)",
            "to_json(struct(array(struct(c_name AS subject, 'lives in' AS predicate, n_name AS object)) AS triples))")
        .unionByName(rep(table(spark, sf, "part"), "mind_map", "concat('p', p_partkey)",
                         "to_json(struct(array(struct(p_name AS title), struct(p_type AS title)) AS nodes))"))
        .unionByName(rep(table(spark, sf, "events"), "transcript", "concat('e', event_id)",
                         "to_json(struct(array(struct(value AS start, value + 1 AS end, event_type AS text)) AS segments))"))
        .unionByName(rep(table(spark, sf, "supplier"), "table_json", "concat('s', s_suppkey)",
                         "to_json(struct(s_name AS name))"))
    )
    return C.chunk_structured(reps).withColumn("time_start", F.coalesce("time_start", F.lit(-1.0))).withColumn(
        "time_end", F.coalesce("time_end", F.lit(-1.0))
    )


@query(
    "index_reps",
    f"""WITH RECURSIVE src AS (
  SELECT doc_id, text, CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'text' WHEN 'es' THEN 'lexical' END AS mode FROM documents),
sections AS (SELECT doc_id, 0 AS section_index, NULL::varchar AS header, 0::bigint AS level, 0::bigint AS start_pos, text
             FROM src WHERE mode IS NOT NULL AND trim(text) <> ''), {pieces_sql(256, True)}
SELECT doc_id, chunk_index, mode AS index_mode, token_count, chunk_type,
       (CASE WHEN mode = 'lexical' THEN 0 ELSE 32 END)::bigint AS dims
FROM pieces JOIN src USING (doc_id)""",
)
def index_reps(spark, sf):
    from tarn.operators.embedding import embed, hashed_embedder
    from tarn.schema import lineage_rules

    extra = spark.createDataFrame([("ocr_to_txt", "lexical")], "step string, index_mode string")
    rules = lineage_rules(spark).select("step", "index_mode").unionByName(extra)
    steps = F.expr(
        "CASE lang WHEN 'en' THEN 'md_passthru' WHEN 'fr' THEN 'png_to_md' WHEN 'es' THEN 'ocr_to_txt' ELSE 'pdf_to_png' END"
    )
    reps = texts(spark, sf).select(
        "doc_id", steps.alias("transform"), F.col("text").alias("content")
    )
    chunks = C.index_reps(reps, rules, embed=lambda df: embed(df, hashed_embedder(32)))
    return chunks.select(
        "doc_id", "chunk_index", "index_mode", "token_count", "chunk_type",
        F.size("embedding").cast("long").alias("dims"),
    )


@query("slugify_names", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') AS slug FROM part""")
def slugify_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", slugify(F.col("p_name")).alias("slug"))
