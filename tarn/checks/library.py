"""Library mode queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import markdown, query, table, texts
from tarn.checks.chunking import LINES_SQL
from tarn.functions.arrays import explode_rows
from tarn.operators import library as B
from tarn.operators.chunking import ChunkConfig

# Documents with headings of three levels, anchors, tables of contents and separators.
DEEP_SQL = r"""deep AS (
  SELECT doc_id, lang, '# Source ' || source || '<a id="s' || source || '"></a>' || chr(10) || '## ' || lang || chr(10) || '---' || chr(10)
         || '## Contents' || chr(10) || '1. one' || chr(10)
         || regexp_replace(text, '\.\n([^ \n]+) ', '.' || chr(10) || '### Page 7 \1' || chr(10) || '\1 ', 'g') AS text
  FROM documents)"""


def deep(spark, sf):
    body = F.regexp_replace("text", "\\.\n([^ \n]+) ", ".\n### Page 7 $1\n$1 ")
    return texts(spark, sf).select(
        "doc_id", "lang",
        F.concat(F.lit("# Source "), "source", F.lit('<a id="s'), "source", F.lit('"></a>\n## '), "lang",
                 F.lit("\n---\n## Contents\n1. one\n"), body).alias("text"),
    )


SECTIONS_SQL = rf"""{LINES_SQL.format(src="deep")},
marked AS (
  SELECT *, length(regexp_extract(txt, '^(#{{1,6}})\s.', 1)) AS lvl,
         coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos
  FROM lines),
grp AS (
  SELECT *, sum((lvl > 0)::int) OVER w AS g,
         last_value(CASE WHEN lvl = 1 THEN line END IGNORE NULLS) OVER w AS l1,
         last_value(CASE WHEN lvl = 2 THEN line END IGNORE NULLS) OVER w AS l2,
         last_value(CASE WHEN lvl = 3 THEN line END IGNORE NULLS) OVER w AS l3
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
heads AS (
  SELECT doc_id, g, max(l1) AS l1, CASE WHEN max(l2) > max(l1) THEN max(l2) END AS l2,
         CASE WHEN max(l3) > max(l2) AND max(l3) > max(l1) THEN max(l3) END AS l3,
         regexp_replace(regexp_replace(string_agg(CASE WHEN lvl = 0 THEN txt END, chr(10) ORDER BY line), '^\n+', ''), '\n+$', '') AS content,
         min(CASE WHEN lvl = 0 THEN pos END) AS start_pos
  FROM grp GROUP BY doc_id, g HAVING count_if(lvl = 0) > 0),
secs AS (
  SELECT h.doc_id, dense_rank() OVER (PARTITION BY h.doc_id ORDER BY g) - 1 AS section_index,
         coalesce(trim(regexp_extract(a.txt, '^#+\s+(.*)$', 1)), '') AS h1, coalesce(trim(regexp_extract(b.txt, '^#+\s+(.*)$', 1)), '') AS h2,
         coalesce(trim(regexp_extract(c.txt, '^#+\s+(.*)$', 1)), '') AS h3, content, start_pos
  FROM heads h LEFT JOIN lines a ON a.doc_id = h.doc_id AND a.line = h.l1
  LEFT JOIN lines b ON b.doc_id = h.doc_id AND b.line = h.l2 LEFT JOIN lines c ON c.doc_id = h.doc_id AND c.line = h.l3),
paths AS (
  SELECT *, array_to_string(list_filter([trim(regexp_replace(h1, '<a id="[^"]+"></a>', '', 'g')), h2, h3], lambda x: x <> ''), '-') AS path FROM secs)"""


@query("library_sections", f"WITH {DEEP_SQL}, {SECTIONS_SQL} SELECT doc_id, section_index, h1, h2, h3, content, start_pos FROM secs")
def library_sections(spark, sf):
    secs = B.split_library_sections(deep(spark, sf).drop("lang"))
    return secs.select(
        "doc_id", "section_index", *[F.coalesce(F.col("headers")[i], F.lit("")).alias(f"h{i + 1}") for i in range(3)],
        "content", "start_pos",
    )


@query(
    "heading_path",
    rf"""WITH {DEEP_SQL}, {SECTIONS_SQL}
SELECT doc_id, section_index, path, regexp_extract(h1, '<a id="([^"]+)">', 1) AS anchor FROM paths""",
)
def heading_path(spark, sf):
    secs = B.split_library_sections(deep(spark, sf).drop("lang"))
    path = B.heading_path(F.col("headers"))
    return secs.select("doc_id", "section_index", path.alias("path"), B.section_anchor(F.col("headers"), path).alias("anchor"))


@query(
    "page_anchor",
    rf"""WITH {DEEP_SQL}, {SECTIONS_SQL}
SELECT doc_id, section_index, CASE WHEN contains(path, 'Page 7') THEN 'Page 7' ELSE '' END AS anchor FROM paths""",
)
def page_anchor(spark, sf):
    secs = B.split_library_sections(deep(spark, sf).drop("lang"))
    plain = F.transform("headers", lambda h: F.regexp_replace(h, "<a id.*", ""))
    return secs.select("doc_id", "section_index", B.section_anchor(plain, B.heading_path(plain)).alias("anchor"))


TOC_WORDS = "'(?i)目录|目次|table of contents|contents|toc|索引|index'"


@query(
    "drop_toc",
    rf"""WITH {DEEP_SQL}, {SECTIONS_SQL},
ls AS (SELECT doc_id, section_index, trim(unnest(string_split(content, chr(10)))) AS ln FROM secs),
share AS (
  SELECT doc_id, section_index, avg(CASE WHEN regexp_matches(ln, '\[.*?\]\(.*?\)') OR regexp_matches(ln, '(?i)<a\s+.*?href=.*?>')
         OR (regexp_matches(ln, '(?i)^\s*(\d+\.\s+\S+|第[一二三四五六七八九十\d]+章\s+\S+|Chapter\s+\d+\s+\S+)') AND NOT regexp_matches(ln, '\s{{3,}}|\t{{2,}}')) THEN 1.0 ELSE 0.0 END) AS r,
         avg(length(ln)) AS n FROM ls WHERE ln <> '' GROUP BY ALL)
SELECT doc_id, section_index FROM secs LEFT JOIN share USING (doc_id, section_index)
WHERE NOT (regexp_matches(regexp_replace(h1, '<a id="[^"]+"></a>', '', 'g'), {TOC_WORDS}) OR regexp_matches(h2, {TOC_WORDS}) OR regexp_matches(h3, {TOC_WORDS})
           OR coalesce(r > 0.5 OR (r > 0.3 AND n < 50), false))""",
)
def drop_toc(spark, sf):
    return B.drop_toc(B.split_library_sections(deep(spark, sf).drop("lang"))).select("doc_id", "section_index")


@query("drop_separators", rf"""WITH {DEEP_SQL}, {SECTIONS_SQL} SELECT doc_id, section_index FROM secs WHERE NOT regexp_full_match(trim(content), '[-*_]{{3,}}')""")
def drop_separators(spark, sf):
    return B.drop_separators(B.split_library_sections(deep(spark, sf).drop("lang"))).select("doc_id", "section_index")


@query(
    "document_title",
    r"""SELECT page_id, CASE WHEN ends_with(name, '.html') THEN 'Page <' || lang || '>' ELSE replace(name, '%20', ' ') END AS title
FROM (SELECT page_id, regexp_extract(url, 'example\.[a-z]+/([a-z]+)', 1) AS lang,
             regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '([^/]*)$', 1) AS name FROM pages)""",
)
def document_title(spark, sf):
    pages = table(spark, sf, "pages").withColumn("lang", F.regexp_extract("url", "example\\.[a-z]+/([a-z]+)", 1))
    text = F.when(
        F.regexp_replace("url", "[?#].*$", "").endswith(".html"),
        F.concat(F.lit("intro\n# Contents\nx\n# Page <"), "lang", F.lit('><a id="p"></a>  \n# Other\n')),
    ).otherwise(F.lit("no heading\n## deeper\n"))
    return pages.select("page_id", B.document_title(text, F.concat(F.lit("`"), "url", F.lit("`"))).alias("title"))


@query(
    "library_tables",
    rf"""WITH {LINES_SQL.format(src="documents")},
pos AS (SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS p FROM lines),
hit AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS isl FROM pos
        WHERE length(txt) - length(replace(txt, '|', '')) >= 2 OR regexp_matches(trim(txt), '^[+-][-=|\s+]*[+-]$'))
SELECT doc_id, min(p) AS start_char, max(p + length(txt)) AS end_char FROM hit GROUP BY doc_id, isl""",
)
def library_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return explode_rows(docs, ["doc_id"], B.library_tables(F.col("text")), "_i", "_t").select("doc_id", "_t.*")


@query(
    "code_blocks",
    rf"""WITH src AS (SELECT doc_id, regexp_replace(text, '\.\n', '.' || chr(10) || CASE WHEN lang = 'en' THEN '```' ELSE '~~~' END || chr(10), 'g') AS text FROM documents),
{LINES_SQL.format(src="src")},
pos AS (SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS p,
        max(line) OVER (PARTITION BY doc_id) AS last FROM lines),
ends AS (SELECT doc_id, p + length(txt) AS doc_end FROM pos WHERE line = last),
fences AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS n FROM pos WHERE txt IN ('```', '~~~'))
SELECT a.doc_id, a.p AS start_char, coalesce(b.p + 3, doc_end) AS end_char
FROM fences a LEFT JOIN fences b ON b.doc_id = a.doc_id AND b.n = a.n + 1 JOIN ends e ON e.doc_id = a.doc_id WHERE a.n % 2 = 0""",
)
def code_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    fenced = docs.select("doc_id", F.when(F.col("lang") == "en", F.regexp_replace("text", "\\.\n", ".\n```\n"))
                         .otherwise(F.regexp_replace("text", "\\.\n", ".\n~~~\n")).alias("text"))
    return explode_rows(fenced, ["doc_id"], B.code_blocks(F.col("text")), "_i", "_t").select("doc_id", "_t.*")


@query("chunk_library")
def chunk_library(spark, sf):
    docs = markdown(spark, sf).withColumn("name", F.concat("doc_id", F.lit(".md")))
    return B.chunk_library(docs, ChunkConfig(window_size=3)).drop("name")
