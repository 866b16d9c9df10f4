"""Cross-site boilerplate lines, by distinct-site sketches. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.arrays import let
from tarn.functions.sizes import broadcast_if_small
from tarn.session import durable

MIN_SITES = 10
SKETCH_LOG_SIZE = 12
BROADCAST_ROWS = 100_000
BLANK = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(docs: DataFrame) -> DataFrame:
    """Rows are named by id and text together: ids may repeat or be null."""
    return docs.withColumn("_row", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: _row, pos, site, and a 128-bit name of the
    trimmed line."""
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lines = _key(docs).select("_row", site.alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(BLANK))
    named = lines.select("_row", "pos", "site", line.alias("line")).where("line <> ''")
    return named.select(
        "_row",
        "pos",
        "site",
        F.xxhash64("line").alias("k1"),
        F.xxhash64(F.lit("line"), F.reverse("line")).alias("k2"),
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(k1, k2) of lines found on at least ``min_sites`` distinct sites.

    A sketch of the sites is kept for each line and merged before and after the shuffle, so
    a line found in a third of all rows is no single task's work. Where the estimate could
    fall on either side, the sites of these lines alone are counted exactly.
    """
    margin = max(2, math.ceil(min_sites / 10))
    spread = lines.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", SKETCH_LOG_SIZE).alias("sketch")
    )
    spread = spread.where(F.col("n") >= min_sites)
    spread = durable(spread.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites")))
    sure = spread.where(F.col("sites") > min_sites + margin).select("k1", "k2")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("k1", "k2")
    sites = lines.select("k1", "k2", "site").join(broadcast_if_small(near, BROADCAST_ROWS), ["k1", "k2"])
    counted = sites.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return durable(sure.union(counted.where(F.col("n") >= min_sites).select("k1", "k2")))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose places are not in ``gone``, which ascends: the stretches between the
    places, so the work grows with the lines and not with lines times places."""

    def cut(both: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(both["gone"], lambda p: p + 1))
        ends = F.concat(both["gone"], F.array(F.size(both["lines"])))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(both["lines"], a + 1, b - a)))

    return let(F.struct(lines.alias("lines"), gone.alias("gone")), cut)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with n_lines, n_boilerplate, n_removed and
    ``clean_text``, the text without its boilerplate lines.

    A line, without white space at its ends, is boilerplate if it is found on ``min_sites``
    distinct sources. Such lines are removed at any share of the text; only a document with
    no line of its own is left whole, for the removal of near duplicates. Copies stay copies:
    equal texts lose equal lines. Blank lines are never counted or removed. A null source is
    a site of its own; a null text stays null, with 0 lines. Repeated rows are treated alike.
    Columns of ``docs`` named like the added ones are replaced.
    """
    added = ("n_lines", "n_boilerplate", "n_removed", "clean_text")
    docs = docs.drop(*added)
    lines = occurrences(docs)
    bad = boilerplate(lines, min_sites)
    hits = lines.join(broadcast_if_small(bad, BROADCAST_ROWS), ["k1", "k2"])
    hits = hits.groupBy("_row.doc_id", "_row.h").agg(F.array_sort(F.collect_set("pos")).alias("_hits"))
    doc_id, h = F.coalesce("doc_id", F.lit(0)), F.col("h")
    hits = hits.select(doc_id.alias("_id"), F.col("doc_id").isNull().alias("_no_id"), h.alias("_h"), "_hits")
    rows = docs.withColumns(
        {"_id": F.coalesce("doc_id", F.lit(0)), "_no_id": F.col("doc_id").isNull(), "_h": F.xxhash64("text")}
    ).join(hits, ["_id", "_no_id", "_h"], "left")
    split = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(_lines(F.col("text")))
    real = F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != "")
    rows = rows.withColumns(
        {
            "n_lines": F.size(real).cast("long"),
            "n_boilerplate": F.when(F.col("_hits").isNull(), 0).otherwise(F.size("_hits")).cast("long"),
        }
    )
    cut = (F.col("n_boilerplate") > 0) & (F.col("n_boilerplate") < F.col("n_lines"))
    kept = F.array_join(_without(split, F.col("_hits")), "\n")
    rows = rows.withColumns(
        {
            "n_removed": F.when(cut, F.col("n_boilerplate")).otherwise(F.lit(0).cast("long")),
            "clean_text": F.when(cut, kept).otherwise(F.col("text")),
        }
    )
    return rows.select(*docs.columns, *added)


SQL = f"""
WITH split_lines AS (
  SELECT doc_id, coalesce(source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         unnest(string_split(text, chr(10))) AS raw FROM documents),
named AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM split_lines),
bad AS (
  SELECT line FROM named WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT n.*, n.line <> '' AS real_line, b.line IS NOT NULL AS hit FROM named n LEFT JOIN bad b ON n.line = b.line),
totals AS (
  SELECT doc_id, count(*) FILTER (real_line) AS n_lines, count(*) FILTER (hit) AS n_boilerplate,
         count(*) FILTER (hit) < count(*) FILTER (real_line) AS cut
  FROM marked GROUP BY doc_id),
kept AS (
  SELECT m.doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT (hit AND cut)) AS clean
  FROM marked m JOIN totals t ON m.doc_id = t.doc_id GROUP BY m.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate,
       CASE WHEN cut THEN n_boilerplate ELSE 0 END AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(clean, '')) END AS clean_md5
FROM documents d LEFT JOIN totals t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
