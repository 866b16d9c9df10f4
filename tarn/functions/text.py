"""Text expressions. ``\\w`` and ``\\s`` differ between regex dialects, so the
classes are written out or switched to Unicode with ``(?U)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that mark a table of contents.
TOC_KEYWORDS = ("目录", "目次", "table of contents", "contents", "toc", "索引", "index")

# Line ends recognised when a file is cut into lines for grep.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def count_tokens(col: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Token estimate of four characters each, or the count of a given tokenizer."""
    if tokenizer is not None:
        return F.coalesce(tokenizer(col), F.length(col)).cast("long")
    return F.floor(F.length(F.coalesce(col, F.lit(""))) / 4).cast("long")


def slugify(col: Column) -> Column:
    """Heading text as a URL fragment; ``section`` when nothing is left."""
    kept = F.regexp_replace(F.lower(col), "[^\\p{L}\\p{N}_\\s-]", "")
    dashed = F.regexp_replace(kept, "[\\s_]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("section")).otherwise(trimmed)


def truncate_center(col: Column, limit: Column | int) -> Column:
    """The middle ``limit`` characters."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.floor((F.length(col) - limit) / 2).cast("int")
    return F.when(F.length(col) <= limit, col).otherwise(F.substring(col, start + 1, limit))


def split_lines(col: Column) -> Column:
    """Lines of a file as grep sees them; a final line end adds no line."""
    body = F.regexp_replace(col, f"(?:{LINE_ENDS})\\z", "")
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_ENDS, -1)
    )


def decode_text(content: Column) -> Column:
    """Bytes as text, malformed sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strip_anchor_tags(col: Column) -> Column:
    return strip(F.regexp_replace(col, '<a id="[^"]+"></a>', ""))


def contains_toc_keyword(col: Column) -> Column:
    lowered = F.lower(col)
    found = F.lit(False)
    for word in TOC_KEYWORDS:
        found = found | F.contains(lowered, F.lit(word))
    return found


def url_unquote(col: Column) -> Column:
    """Percent-decode; ``+`` stays, and text that cannot be decoded is kept."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def clean_file_title(name: Column) -> Column:
    """A readable title from a file name or URL."""
    bare = F.regexp_replace(strip(F.regexp_replace(strip(name), "^`+|`+$", "")), "^`+|`+$", "")
    decoded = url_unquote(bare)
    path = strip(F.regexp_replace(decoded, "[?#].*$", ""))
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(base, "(?i)\\.md$", "")


def hash16(col: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 16)


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot, or the empty string."""
    return F.regexp_extract(F.lower(name), "(\\.[^.]*)$", 1)


def fnmatch_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close]
            negate = body.startswith("!")
            body = body[1:] if negate else body
            safe = "".join("\\" + c if c in "\\[]^&" else c for c in body)
            out.append(f"[{'^' if negate else ''}{safe}]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch in "/_ " else "\\" + ch)
        i += 1
    return "(?s)^" + "".join(out) + "\\z"
