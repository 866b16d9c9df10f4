"""Markdown and text to chunks.

A document is one row and stays one row until its chunks are known: header
split, paragraph packing and the sliding window are array expressions, so the
whole chunking job is a projection followed by one ``posexplode`` and never
shuffles. Chunk tables that are already exploded have :func:`sliding_window`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.arrays import (
    explode_rows,
    indexes,
    let,
    prefix_states,
    running_offsets,
    runs,
    tail,
)
from tarn.functions.located import FILE, ROW, at_places, stored
from tarn.functions.text import count_tokens, slugify, strip, truncate_center

# Pieces whose windows are in one row at a time.
WINDOW_BLOCK = 64

# Fixed value: characters that end a sentence.
SENTENCE_ENDS = "。！？.!?"

_HEADER_START = "(?<=\\n)(?=#{1,6}[^\\S\\n][^\\n])"
_HEADER_LINE = "(?Ud)^(#{1,6})\\s+(.+?)\\s*$"
_BLANK_GAP = "(?U)\\n\\s*\\n"
_GAP_COPY = "(?U)(\\n\\s*\\n)"


@dataclass(frozen=True)
class ChunkConfig:
    """Chunking limits. ``compat`` reproduces the offsets of the first
    implementation, where a paragraph position counts lines instead of
    characters and a hard cut does not advance the position. ``tokens`` counts
    the tokens of a text by a column expression."""

    chunk_tokens: int = 256
    window_size: int = 9
    max_window_length: int = 12000
    compat: bool = False
    tokens: Callable[[Column], Column] = count_tokens

    @property
    def half_window(self) -> int:
        return self.window_size // 2


# --- header sections -------------------------------------------------------


def header_sections(text: Column) -> Column:
    """``array<struct<header, level, start_pos, text>>`` of a Markdown text."""

    def build(pieces: Column) -> Column:
        return let(
            running_offsets(F.transform(pieces, lambda p: F.length(p))),
            lambda starts: F.transform(
                pieces,
                lambda p, i: let(
                    F.substring_index(p, "\n", 1),
                    lambda line: F.struct(
                        F.when(
                            F.regexp_like(line, F.lit(_HEADER_LINE)),
                            strip(F.regexp_extract(line, _HEADER_LINE, 2)),
                        ).alias("header"),
                        F.length(F.regexp_extract(line, _HEADER_LINE, 1)).cast("long").alias("level"),
                        starts[i].alias("start_pos"),
                        F.when(
                            i < F.size(pieces) - 1, F.substring(p, F.lit(1), F.length(p) - 1)
                        ).otherwise(p).alias("text"),
                    ),
                ),
            ),
        )

    return let(F.split(text, _HEADER_START, -1), build)


def split_headers(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per header section; empty text gives no rows."""
    keep = [c for c in df.columns if c != text]
    return (
        explode_rows(
            df.filter(F.length(text) > 0), keep, header_sections(F.col(text)), "section_index", "_s"
        )
        .select(*keep, "section_index", "_s.*")
    )


# --- tables ----------------------------------------------------------------


def table_runs(text: Column) -> Column:
    """Runs of lines that contain a pipe."""
    return let(
        F.split(text, "\n", -1),
        lambda lines: F.transform(
            runs(F.transform(lines, lambda ln: F.contains(ln, F.lit("|")))),
            lambda r: F.struct(
                r["first"].cast("long").alias("start_line"),
                r["last"].cast("long").alias("end_line"),
                F.array_join(
                    F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n"
                ).alias("content"),
            ),
        ),
    )


def find_tables(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per table with its line range (0-based, inclusive)."""
    keep = [c for c in df.columns if c != text]
    return (
        explode_rows(
            df.filter(F.contains(text, F.lit("|"))), keep, table_runs(F.col(text)), "_i", "_t"
        )
        .select(*keep, "_t.*")
    )


def inside_table(lines: DataFrame, tables: DataFrame, doc: str, bucket: int = 256) -> DataFrame:
    """Lines (``doc``, ``line``) that lie inside a table of the same document.

    The range join becomes an equi-join on (document, line bucket), which also
    spreads one very long document over many tasks.
    """
    ranges = tables.select(
        F.col(doc),
        "start_line",
        "end_line",
        F.explode(
            F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))
        ).alias("_bucket"),
    )
    placed = lines.withColumn("_bucket", F.floor(F.col("line") / bucket))
    hit = (
        (placed[doc] == ranges[doc])
        & (placed["_bucket"] == ranges["_bucket"])
        & placed["line"].between(ranges["start_line"], ranges["end_line"])
    )
    return placed.join(ranges, hit, "left_semi").drop("_bucket")


# --- paragraphs ------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    """``array<struct<text, n, start_pos, start_line>>``: runs of non-blank lines."""

    def build(body: Column, lead: Column) -> Column:
        return let(
            F.split(body, _BLANK_GAP, -1),
            lambda parts: let(
                F.regexp_extract_all(body, F.lit(_GAP_COPY), 1),
                lambda gaps: let(
                    F.transform(
                        parts,
                        lambda p, i: F.struct(
                            (F.length(p) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0)))
                            .cast("long").alias("chars"),
                            (_newlines(p) + F.coalesce(_newlines(F.get(gaps, i)), F.lit(0)))
                            .cast("long").alias("lines"),
                        ),
                    ),
                    lambda sizes: let(
                        prefix_states(
                            sizes,
                            F.struct(
                                F.length(lead).cast("long").alias("chars"),
                                _newlines(lead).cast("long").alias("lines"),
                            ),
                            lambda at, s: F.struct(
                                (at["chars"] + s["chars"]).alias("chars"),
                                (at["lines"] + s["lines"]).alias("lines"),
                            ),
                        ),
                        lambda starts: F.transform(
                            parts,
                            lambda p, i: F.struct(
                                p.alias("text"),
                                F.length(p).cast("long").alias("n"),
                                starts[i]["chars"].alias("start_pos"),
                                starts[i]["lines"].alias("start_line"),
                            ),
                        ),
                    ),
                ),
            ),
        )

    lead = F.regexp_extract(text, "(?U)^(\\s*\\n)", 1)
    body = F.regexp_replace(
        F.substring(text, F.length(lead) + 1, F.length(text)), "(?U)\\n\\s*\\z", ""
    )
    return let(
        F.struct(lead.alias("lead"), body.alias("body")),
        lambda b: F.when(
            F.regexp_like(b["body"], F.lit("(?U)\\S")), build(b["body"], b["lead"])
        ).otherwise(_no_paragraphs()),
    )


def _newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def _no_paragraphs() -> Column:
    return F.array().cast(
        "array<struct<text:string,n:bigint,start_pos:bigint,start_line:bigint>>"
    )


def split_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph with its character and line position."""
    keep = [c for c in df.columns if c != text]
    return (
        explode_rows(df, keep, paragraphs(F.col(text)), "paragraph_index", "_p")
        .select(
            *keep,
            "paragraph_index",
            F.col("_p.text").alias("text"),
            F.col("_p.start_pos").alias("start_pos"),
            F.col("_p.start_line").alias("start_line"),
        )
    )


# --- greedy packing --------------------------------------------------------


def pack(tokens: Column, limit: int) -> Column:
    """Greedy groups over ``array<bigint>`` of token counts.

    Returns ``array<struct<first, last, tokens, big>>``: item ranges whose counts
    add up to at most ``limit``; an item above it stands alone.
    """

    def step(prev: Column, t: Column) -> Column:
        return let(
            ~prev["big"] & (t <= limit) & (prev["tokens"] + t <= limit),
            lambda joins: F.struct(
                F.when(joins, prev["tokens"] + t).otherwise(t).alias("tokens"),
                (t > limit).alias("big"),
                (~joins).alias("opens"),
            ),
        )

    zero = F.struct(
        F.lit(0).cast("long").alias("tokens"), F.lit(True).alias("big"), F.lit(True).alias("opens")
    )

    def ranges(states: Column) -> Column:
        n = F.size(states)
        return let(
            F.filter(indexes(states), lambda i: states[i]["opens"]),
            lambda firsts: F.transform(
                firsts,
                lambda f, g: let(
                    F.coalesce(F.get(firsts, g + 1), n) - 1,
                    lambda last: F.struct(
                        f.alias("first"),
                        last.alias("last"),
                        states[last]["tokens"].alias("tokens"),
                        states[last]["big"].alias("big"),
                    ),
                ),
            ),
        )

    return let(tail(prefix_states(tokens, zero, step)), ranges)


def _piece(text: Column, start: Column, tokens: Column, chars: Column, kind: str | Column,
           truncated: Column) -> Column:
    return F.struct(
        text.alias("text"),
        start.cast("long").alias("start_pos"),
        (start + F.length(text)).cast("long").alias("end_pos"),
        tokens.cast("long").alias("token_count"),
        chars.cast("long").alias("chunk_chars"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("chunk_type"),
        truncated.alias("is_truncated"),
    )


def sentences(text: Column, keep_empty: bool = False) -> Column:
    """Sentences with their end marks. ``keep_empty`` adds the empty remainder
    after a final end mark."""
    found = F.when(
        F.length(text) > 0,
        F.split(text, f"(?<=[{SENTENCE_ENDS}])(?=[^{SENTENCE_ENDS}])", -1),
    ).otherwise(F.array().cast("array<string>"))
    if not keep_empty:
        return found
    ended = F.regexp_like(text, F.lit(f"[{SENTENCE_ENDS}]\\z"))
    return F.when(ended, F.concat(found, F.array(F.lit("")))).otherwise(found)


def _forced_pieces(parts: Column, groups: Column, offsets: Column, start: Column,
                   cfg: ChunkConfig) -> Column:
    """Chunks of one paragraph above the limit: packed sentences, and a hard cut
    for a sentence that is itself above it."""
    cut = cfg.chunk_tokens * 4

    def one(g: Column, k: Column) -> Column:
        body = F.array_join(F.slice(parts, g["first"] + 1, g["last"] - g["first"] + 1), "")
        at = start + offsets[g["first"]]
        return let(
            F.struct(body.alias("t"), at.alias("at")),
            lambda b: F.when(
                g["big"],
                F.filter(
                    F.array(
                        _cut(F.substring(b["t"], 1, cut), b["at"], cfg),
                        _cut(F.substring(b["t"], F.lit(cut + 1), F.length(b["t"])), b["at"] + cut, cfg),
                    ),
                    lambda c: c["chunk_chars"] > 0,
                ),
            ).otherwise(
                F.array(
                    _piece(b["t"], b["at"], g["tokens"], F.length(b["t"]), "forced_split",
                           k < F.size(groups) - 1)
                )
            ),
        )

    return F.flatten(F.transform(groups, one))


def _cut(text: Column, start: Column, cfg: ChunkConfig) -> Column:
    return _piece(text, start, cfg.tokens(text), F.length(text), "forced_split", F.lit(True))


def _section_pieces(paras: Column, groups: Column, cuts: Column, start: Column,
                    cfg: ChunkConfig) -> Column:
    """Chunks of one section above the limit."""

    def para_start(p: Column) -> Column:
        return start + (p["start_line"] if cfg.compat else p["start_pos"])

    def one(g: Column, k: Column) -> Column:
        cut = cuts[g["first"]]
        inside = F.slice(paras, g["first"] + 1, g["last"] - g["first"] + 1)
        return F.when(
            g["big"],
            _forced_pieces(cut["parts"], cut["groups"], cut["offsets"],
                           para_start(paras[g["first"]]), cfg),
        ).otherwise(
            F.array(
                _piece(
                    F.array_join(F.transform(inside, lambda p: p["text"]), "\n\n"),
                    para_start(paras[g["first"]]),
                    g["tokens"],
                    F.aggregate(inside, F.lit(0).cast("long"), lambda a, p: a + p["n"]),
                    F.when(
                        F.coalesce(F.get(groups, k + 1)["big"], F.lit(False)),
                        F.lit("paragraph_split"),
                    ).otherwise(F.lit("paragraph_group")),
                    F.lit(False),
                )
            )
        )

    return F.flatten(F.transform(groups, one))


def _with_pieces(df: DataFrame, cfg: ChunkConfig, whole: bool) -> DataFrame:
    """Turn ``_sections`` into ``_pieces``, the chunks of a document in order.

    ``whole`` keeps a section within the limit as one ``header_chunk``. Every
    stage is a column of its own: the expressions stay shallow and Catalyst
    evaluates each of them once per document.
    """

    def small(sec: Column) -> Column:
        return cfg.tokens(sec["text"]) <= cfg.chunk_tokens if whole else F.lit(False)

    def advance(s: Column) -> Column:
        if cfg.compat:
            return F.when(cfg.tokens(s) > cfg.chunk_tokens, 0).otherwise(F.length(s))
        return F.length(s)

    no_parts = F.array().cast("array<string>")
    staged = (
        df.withColumn(
            "_paras",
            F.transform(
                "_sections",
                lambda s: F.when(small(s), _no_paragraphs()).otherwise(paragraphs(s["text"])),
            ),
        )
        .withColumn(
            "_groups",
            F.transform(
                "_paras",
                lambda ps: pack(F.transform(ps, lambda p: cfg.tokens(p["text"])), cfg.chunk_tokens),
            ),
        )
        .withColumn(
            "_parts",
            F.transform(
                "_paras",
                lambda ps: F.transform(
                    ps,
                    lambda p: F.when(
                        cfg.tokens(p["text"]) > cfg.chunk_tokens, sentences(p["text"], cfg.compat)
                    ).otherwise(no_parts),
                ),
            ),
        )
        .withColumn(
            "_cuts",
            F.transform(
                "_parts",
                lambda ps: F.transform(
                    ps,
                    lambda parts: F.struct(
                        parts.alias("parts"),
                        pack(
                            F.transform(parts, lambda s: cfg.tokens(s)), cfg.chunk_tokens
                        ).alias("groups"),
                        running_offsets(F.transform(parts, advance)).alias("offsets"),
                    ),
                ),
            ),
        )
    )

    def one(z: Column) -> Column:
        sec = z["_sections"]
        pieces = F.when(
            small(sec),
            F.array(
                _piece(
                    sec["text"], sec["start_pos"], cfg.tokens(sec["text"]),
                    F.length(sec["text"]), "header_chunk", F.lit(False),
                )
            ),
        ).otherwise(
            _section_pieces(z["_paras"], z["_groups"], z["_cuts"], sec["start_pos"], cfg)
        )
        return F.transform(
            pieces,
            lambda p: F.struct(
                *[p[c].alias(c) for c in ("text", "start_pos", "end_pos", "token_count", "chunk_chars")],
                sec["header"].alias("header"),
                sec["level"].alias("level"),
                *[p[c].alias(c) for c in ("chunk_type", "is_truncated")],
            ),
        )

    # The arrays enter the lambda zipped: a column named inside it could be
    # inlined there and evaluated anew for every section.
    zipped = F.arrays_zip("_sections", "_paras", "_groups", "_cuts")
    return staged.withColumn("_pieces", F.flatten(F.transform(zipped, one))).drop(
        "_sections", "_paras", "_groups", "_parts", "_cuts"
    )


def _one_section(text: str, start: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(None).cast("string").alias("header"),
            F.lit(0).cast("long").alias("level"),
            start.alias("start_pos"),
            F.col(text).alias("text"),
        )
    )


def _explode_pieces(df: DataFrame, keep: list[str]) -> DataFrame:
    return explode_rows(df, keep, "_pieces", "piece_index", "_p").select(
        *keep, "piece_index", "_p.*"
    )


def pack_paragraphs(df: DataFrame, limit: int, text: str = "text", start: str | None = None,
                    compat: bool = False) -> DataFrame:
    """Chunk texts by greedy paragraph packing, without looking at headers."""
    cfg = ChunkConfig(chunk_tokens=limit, compat=compat)
    keep = [c for c in df.columns if c not in (text, start)]
    at = F.col(start) if start else F.lit(0).cast("long")
    staged = df.select(*keep, _one_section(text, at).alias("_sections"))
    return _explode_pieces(_with_pieces(staged, cfg, whole=False), keep)


def split_long_paragraphs(df: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Forced sentence split of the texts above the limit."""
    return pack_paragraphs(df.filter(count_tokens(F.col(text)) > limit), limit, text)


# --- sliding window --------------------------------------------------------


def truncate_window(texts: Column, centre: Column, limit: int) -> Column:
    """The texts kept when a window is over the limit.

    Grows outward from the centre; at each distance the shorter neighbour comes
    first (left on a tie) and a side that does not fit is closed for good.
    """

    def grow(state: Column, d: Column) -> Column:
        left_len = F.length(F.get(texts, centre - d)) + 2
        right_len = F.length(F.get(texts, centre + d)) + 2
        left_open = state["left_open"] & (centre - d >= 0)
        right_open = state["right_open"] & (centre + d < F.size(texts))
        return let(
            F.struct(
                F.when(left_open, left_len).alias("l"),
                F.when(right_open, right_len).alias("r"),
            ),
            lambda c: let(
                # The neighbour tried second only gets the room left by the first.
                F.struct(
                    F.coalesce(
                        F.when(
                            c["r"].isNull() | (c["l"] <= c["r"]),
                            state["length"] + c["l"] <= limit,
                        ).otherwise(
                            state["length"] + c["l"]
                            + F.when(state["length"] + c["r"] <= limit, c["r"]).otherwise(0)
                            <= limit
                        ),
                        F.lit(False),
                    ).alias("take_l"),
                    F.coalesce(
                        F.when(
                            c["l"].isNull() | (c["r"] < c["l"]),
                            state["length"] + c["r"] <= limit,
                        ).otherwise(
                            state["length"] + c["r"]
                            + F.when(state["length"] + c["l"] <= limit, c["l"]).otherwise(0)
                            <= limit
                        ),
                        F.lit(False),
                    ).alias("take_r"),
                ),
                lambda t: F.struct(
                    (state["lo"] - F.when(t["take_l"], 1).otherwise(0)).alias("lo"),
                    (state["hi"] + F.when(t["take_r"], 1).otherwise(0)).alias("hi"),
                    (
                        state["length"]
                        + F.when(t["take_l"], c["l"]).otherwise(0)
                        + F.when(t["take_r"], c["r"]).otherwise(0)
                    ).alias("length"),
                    t["take_l"].alias("left_open"),
                    t["take_r"].alias("right_open"),
                ),
            ),
        )

    far = F.greatest(centre, F.size(texts) - centre - 1)
    start = F.struct(
        centre.alias("lo"),
        centre.alias("hi"),
        F.length(texts[centre]).alias("length"),
        F.lit(True).alias("left_open"),
        F.lit(True).alias("right_open"),
    )
    grown = F.aggregate(
        F.when(far >= 1, F.sequence(F.lit(1), far)).otherwise(F.array().cast("array<int>")),
        start,
        grow,
        lambda s: F.slice(texts, s["lo"] + 1, s["hi"] - s["lo"] + 1),
    )
    return F.when(
        F.length(texts[centre]) >= limit, F.array(truncate_center(texts[centre], limit))
    ).otherwise(grown)


def window_texts(texts: Column, centre: Column, limit: int) -> Column:
    """The window itself, or what truncation leaves of it."""
    total = F.aggregate(texts, F.lit(-2), lambda a, t: a + F.length(t) + 2)
    return F.when(total > limit, truncate_window(texts, centre, limit)).otherwise(texts)


def explode_windows(df: DataFrame, keep: list[str], cfg: ChunkConfig, field: str = "text") -> DataFrame:
    """One row for each of ``_pieces``: ``chunk_index``, the piece as ``_piece``, and ``_window``,
    the window around it joined over ``field``.

    Pieces leave their document in blocks, with copies of the few pieces next to a block's
    borders, and windows are built inside a block. So a row holds the windows of one block,
    however long the document is, and nothing is shuffled.
    """
    half = cfg.half_window

    def block(pieces: Column, at: Column) -> Column:
        low = F.greatest(at - half, F.lit(0))
        high = F.least(at + WINDOW_BLOCK + half, F.size(pieces))
        return F.struct(
            at.alias("at"), (at - low).alias("lead"), F.least(F.lit(WINDOW_BLOCK), F.size(pieces) - at).alias("n"),
            F.slice(pieces, low + 1, high - low).alias("pieces"),
        )

    def blocks(pieces: Column) -> Column:
        starts = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(WINDOW_BLOCK)))
        return F.transform(starts, lambda at: block(pieces, at))

    def one(pieces: Column, i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        around = F.slice(pieces, low + 1, F.least(i + half + 1, F.size(pieces)) - low)
        kept = let(
            F.transform(around, lambda c: c[field]),
            lambda texts: window_texts(texts, i - low, cfg.max_window_length),
        )
        window = let(
            kept,
            lambda w: F.struct(
                F.array_join(w, "\n\n").alias("embedding_text"),
                F.size(w).cast("long").alias("window_size"),
            ),
        )
        return F.struct(F.get(pieces, i).alias("piece"), window.alias("window"))

    cut = explode_rows(df, keep, let(F.col("_pieces"), blocks), "_number", "_cut")
    inside = F.sequence(F.col("_cut.lead"), F.col("_cut.lead") + F.col("_cut.n") - 1)
    rows = let(F.col("_cut.pieces"), lambda pieces: F.transform(inside, lambda i: one(pieces, i)))
    at = F.col("_cut.at").alias("_at")
    return explode_rows(cut.select(*keep, at, "_cut"), [*keep, "_at"], rows, "_place", "_row").select(
        *keep, (F.col("_at") + F.col("_place")).alias("chunk_index"),
        F.col("_row.piece").alias("_piece"), F.col("_row.window").alias("_window"),
    )


def window_metadata(df: DataFrame, caller: str | None = None) -> DataFrame:
    """Window facts as a string map; entries of the ``caller`` map win."""
    own = F.create_map(
        F.lit("window_size"), F.col("window_size").cast("string"),
        F.lit("window_index"), F.col("chunk_index").cast("string"),
        F.lit("target_chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("embedding_text_chars"), F.length("embedding_text").cast("string"),
    )
    if caller is None:
        return df.withColumn("metadata", own)
    theirs = F.coalesce(F.col(caller), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(theirs, k))
    return df.withColumn("metadata", F.map_concat(kept, theirs))


def sliding_window(df: DataFrame, doc: str, size: int = 9, max_len: int = 12000,
                   text: str = "text", block: int = 1024) -> DataFrame:
    """``embedding_text`` for an exploded chunk table with dense ``chunk_index``.

    A document's chunks are cut into blocks; the few chunks next to a border are
    copied to the neighbouring block, so that every window is local to its block
    and a document with very many chunks uses many tasks.
    """
    half = size // 2
    home = F.floor(F.col("chunk_index") / block)
    lower = F.floor((F.col("chunk_index") - half) / block)
    upper = F.floor((F.col("chunk_index") + half) / block)
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_distinct(F.array(lower, home, upper)))
    )
    around = Window.partitionBy(doc, "_block").orderBy("chunk_index").rowsBetween(-half, half)
    windowed = (
        spread.withColumn(
            "_w",
            F.collect_list(F.struct(F.col("chunk_index").alias("i"), F.col(text).alias("t"))).over(
                around
            ),
        )
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )
    centre = F.array_position(F.transform("_w", lambda x: x["i"]), F.col("chunk_index")).cast("int") - 1
    return (
        windowed.withColumn("_centre", centre)
        .withColumn(
            "_w", window_texts(F.transform("_w", lambda x: x["t"]), F.col("_centre"), max_len)
        )
        .withColumn("embedding_text", F.array_join("_w", "\n\n"))
        .withColumn("window_size", F.size("_w").cast("long"))
        .drop("_w", "_centre")
    )


# --- the whole job ---------------------------------------------------------


def with_anchor(df: DataFrame) -> DataFrame:
    """Heading slug and character offset; null without a header at position 0."""
    anchor = F.struct(
        F.when(F.col("header").isNull() | (F.col("header") == ""), F.lit(""))
        .otherwise(slugify(F.col("header"))).alias("slug"),
        F.col("start_pos").alias("char_offset"),
    )
    bare = (F.col("header").isNull() | (F.col("header") == "")) & (F.col("start_pos") == 0)
    return df.withColumn("anchor", F.when(~bare, anchor))


def chunk_documents(df: DataFrame, cfg: ChunkConfig | None = None, text: str = "text") -> DataFrame:
    """Documents to windowed chunks with a dense ``chunk_index`` per document."""
    cfg = cfg or ChunkConfig()
    keep = [c for c in df.columns if c != text]
    sections = df.filter(F.length(text) > 0).select(
        *keep, header_sections(F.col(text)).alias("_sections")
    )
    pieces = _with_pieces(sections, cfg, whole=True)
    windows = explode_windows(pieces, keep, cfg)
    return with_anchor(windows.select(*keep, "chunk_index", "_piece.*", "_window.*"))


def chunk_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    """Chunk count, total and mean token count."""
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("token_count").alias("total_tokens"),
        F.avg("token_count").alias("avg_tokens"),
    )


def index_reps(reps: DataFrame, rules: DataFrame, cfg: ChunkConfig | None = None,
               embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks of representations by the index mode of the step that made them.

    ``text`` chunks are embedded, ``lexical`` chunks carry an empty vector, other
    modes and blank texts are left out. ``rules`` is the fixed lineage table.
    """
    modes = rules.filter(F.col("index_mode").isin("text", "lexical")).select(
        "step", "index_mode"
    ).distinct()
    wanted = reps.join(F.broadcast(modes), reps["transform"] == modes["step"]).drop("step")
    wanted = wanted.filter(F.regexp_like("content", F.lit("(?U)\\S")))
    chunks = chunk_documents(wanted.withColumnRenamed("content", "text"), cfg)
    empty = F.array().cast("array<float>")
    lexical = chunks.filter(F.col("index_mode") == "lexical").withColumn("embedding", empty)
    textual = chunks.filter(F.col("index_mode") == "text")
    textual = embed(textual) if embed else textual.withColumn("embedding", empty)
    return textual.unionByName(lexical)


# --- further chunkers ------------------------------------------------------


def chunk_fixed(df: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Fixed-size character chunks; the last one ends with the text.

    The text is cut once into strides and a chunk is put together from
    neighbouring ones: no substring is searched from the start of the text, and
    the exploded rows do not carry the text along.
    """
    stride = size - overlap
    span = -(-size // stride)
    keep = [c for c in df.columns if c != text]
    strides = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), 0)
    last = F.greatest(F.ceil((F.length(text) - size) / stride), F.lit(0)).cast("int")
    chunks = let(
        strides,
        lambda s: F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(F.array_join(F.slice(s, i + 1, F.lit(span)), ""), F.lit(1), F.lit(size)),
        ),
    )
    rows = explode_rows(df.filter(F.length(text) > 0), keep, chunks, "chunk_index", "_c")
    return rows.select(
        *keep, "chunk_index", (F.col("chunk_index") * stride).alias("start_pos"), F.col("_c").alias("text")
    )


def chunk_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One chunk per sentence."""
    keep = [c for c in df.columns if c != text]
    parts = sentences(F.col(text))
    return (
        explode_rows(
            df.select(*keep, parts.alias("_s")).withColumn(
                "_at", running_offsets(F.transform("_s", lambda s: F.length(s)))
            ),
            keep,
            F.arrays_zip("_s", "_at"),
            "chunk_index",
            "_z",
        )
        .filter(F.col("_z._s").isNotNull())
        .select(
            *keep,
            "chunk_index",
            F.col("_z._at").alias("start_pos"),
            F.col("_z._s").alias("text"),
        )
    )


def dedup_chunks(chunks: DataFrame, doc: str, within_document: bool = False,
                 text: str = "text") -> DataFrame:
    """Keep the first chunk of every distinct text.

    One aggregate on the hash, in which copies collapse in the map tasks. Texts do not
    travel: chunks without places (``functions/located.py``) are written once, and the
    first ones are read again by their places.
    """
    keyed = stored(chunks.withColumn("chunk_hash", F.sha2(text, 256)))
    group = [doc, "chunk_hash"] if within_document else ["chunk_hash"]
    first = keyed.groupBy(*group).agg(
        F.min_by(F.struct(FILE, ROW), F.struct(doc, "chunk_index", FILE, ROW)).alias("_first")
    )
    return at_places(keyed, first.select("_first.*"))


def overlapping(left: DataFrame, right: DataFrame, key: str | list[str], bucket: int) -> DataFrame:
    """Pairs whose half-open ``[start_pos, end_pos)`` overlaps inside ``key``.

    Both sides are spread over fixed-length position buckets; the pair is kept
    in the bucket where the later of the two starts, so it appears once.
    """

    keys = [key] if isinstance(key, str) else list(key)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col("start_pos") / bucket),
                    F.floor(F.greatest(F.col("end_pos") - 1, F.col("start_pos")) / bucket),
                )
            ),
        )

    a = placed(left)
    b = placed(right).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.col("start_pos").alias("_start"),
        F.col("end_pos").alias("_end"),
        *[c for c in right.columns if c not in (*keys, "start_pos", "end_pos")],
    )
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & (a[c] == b[f"_k{i}"])
    cond = (
        same
        & (a["_bucket"] == b["_b"])
        & (a["start_pos"] < b["_end"])
        & (b["_start"] < a["end_pos"])
        & (a["_bucket"] == F.floor(F.greatest(a["start_pos"], b["_start"]) / bucket))
    )
    return a.join(b, cond).drop("_bucket", "_b", *[f"_k{i}" for i in range(len(keys))])


def align_layout(chunks: DataFrame, blocks: DataFrame, key: str = "entity_id",
                 bucket: int = 4096) -> DataFrame:
    """Per chunk the layout blocks that overlap it, in reading order, their number, and its
    primary page, the page of the first one.

    ``layout_blocks`` holds ``block_id``, ``page`` and what else the blocks have of ``type``,
    ``level`` and ``bbox``. Workspace and collection belong to the key where both tables have
    them. A chunk is of bounded length, so its list is short.
    """
    keys = [c for c in ("workspace_id", "collection_id") if c in chunks.columns and c in blocks.columns] + [key]
    more = [c for c in ("type", "level", "bbox") if c in blocks.columns]
    pairs = overlapping(
        chunks.select(*keys, "chunk_index", "start_pos", "end_pos"),
        blocks.select(*keys, "start_pos", "end_pos", "block_id", "page", *more),
        keys,
        bucket,
    )
    block = F.struct("_start", "block_id", "page", *more)
    hits = pairs.groupBy(*keys, "chunk_index").agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    kept = F.transform("_blocks", lambda b: F.struct(*[b[c].alias(c) for c in ("block_id", "page", *more)]))
    hits = hits.select(
        *keys, "chunk_index", F.size("_blocks").cast("long").alias("block_count"), kept.alias("layout_blocks"),
        F.col("_blocks")[0]["page"].alias("primary_page"), F.col("_blocks")[0]["block_id"].alias("first_block"),
        F.element_at("_blocks", -1)["block_id"].alias("last_block"),
    )
    return chunks.join(hits, [*keys, "chunk_index"], "left").withColumn(
        "block_count", F.coalesce("block_count", F.lit(0).cast("long"))
    )


def chunk_semantic(sentence_vectors: DataFrame, doc: str, threshold: float) -> DataFrame:
    """Group a document's sentences, with a break wherever the cosine similarity
    of two neighbours is below ``threshold``."""
    from tarn.functions.ordered import ordered_blocks, previous, running_sum
    from tarn.functions.vectors import cosine

    blocks = ordered_blocks(sentence_vectors, [doc], ["chunk_index"])
    near = previous(blocks, [doc], F.col("embedding"), "_before")
    opened = near.withColumn(
        "_break",
        F.coalesce(cosine(F.col("embedding"), F.col("_before")) < threshold, F.lit(False)).cast("long"),
    ).drop("_before")
    grouped = running_sum(opened, [doc], F.col("_break"), "segment")
    return grouped.drop("_block", "_pos", "_break")


def layout_coverage(documents: DataFrame, blocks: DataFrame, key: str = "entity_id") -> DataFrame:
    """Covered characters per document; ``stale`` unless the blocks cover all of it.
    Workspace and collection belong to the key where both tables have them."""
    from tarn.functions.ordered import ordered_blocks, running_max

    keys = [c for c in ("workspace_id", "collection_id") if c in documents.columns and c in blocks.columns] + [key]
    placed = ordered_blocks(
        blocks.select(*keys, "start_pos", "end_pos", "block_id"), keys, ["start_pos", "end_pos", "block_id"]
    )
    reach = running_max(placed, keys, F.col("end_pos"), "_reach", exclusive=True)
    gained = F.greatest(
        F.col("end_pos") - F.greatest("start_pos", F.coalesce("_reach", F.lit(0))), F.lit(0)
    )
    covered = reach.groupBy(*keys).agg(F.sum(gained).cast("long").alias("covered"))
    return documents.join(covered, keys, "left").withColumn(
        "covered", F.coalesce("covered", F.lit(0).cast("long"))
    ).withColumn("stale", F.col("covered") < F.col("n_chars"))


def chunk_structured(reps: DataFrame) -> DataFrame:
    """Structured representations to chunks.

    ``mind_map`` gives one chunk per node, ``graph_json`` per triple,
    ``transcript`` per time segment and ``table_json`` one per table.
    """
    text = F.col("content")
    nodes = F.transform(
        F.from_json(text, "nodes array<struct<title:string>>")["nodes"],
        lambda n: F.struct(n["title"].alias("text"), F.lit(None).cast("double").alias("time_start"),
                           F.lit(None).cast("double").alias("time_end")),
    )
    triples = F.transform(
        F.from_json(
            text, "triples array<struct<subject:string,predicate:string,object:string>>"
        )["triples"],
        lambda t: F.struct(
            F.concat_ws(" ", t["subject"], t["predicate"], t["object"]).alias("text"),
            F.lit(None).cast("double").alias("time_start"),
            F.lit(None).cast("double").alias("time_end"),
        ),
    )
    segments = F.transform(
        F.from_json(text, "segments array<struct<start:double,end:double,text:string>>")["segments"],
        lambda s: F.struct(s["text"].alias("text"), s["start"].alias("time_start"),
                           s["end"].alias("time_end")),
    )
    whole = F.array(
        F.struct(text.alias("text"), F.lit(None).cast("double").alias("time_start"),
                 F.lit(None).cast("double").alias("time_end"))
    )
    parts = (
        F.when(F.col("rep_type") == "mind_map", nodes)
        .when(F.col("rep_type") == "graph_json", triples)
        .when(F.col("rep_type") == "transcript", segments)
        .when(F.col("rep_type").isin("table_md", "table_json"), whole)
    )
    keep = [c for c in reps.columns if c != "content"]
    return (
        explode_rows(reps, keep, parts, "chunk_index", "_c")
        .select(*keep, "chunk_index", "_c.*")
    )

