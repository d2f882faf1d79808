"""Scalar text functions as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; Java's \s needs (?U) and lacks the information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"


@cache
def accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition, marks dropped, is one other letter; and those letters."""
    source, target = [], []
    for code in range(0xC0, 0x3000):
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(kept) == 1 and kept[0] != chr(code):
            source.append(chr(code))
            target.append(kept[0])
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without its non-spacing marks; null for null."""
    source, target = accent_map()
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Accents off first, then lower case: the order matters for dotted capitals."""
    return F.lower(strip_accents(c))


def trimmed(c: Column) -> Column:
    return F.when(c.rlike(r"^[^!-~]|[^!-~]$"), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def collapsed(c: Column) -> Column:
    """White space trimmed and each inner run made one space; plain ASCII without such runs is passed through."""
    return F.when(c.rlike(r"^ |  | $|[^ -~]"), F.trim(F.regexp_replace(c, f"{SPACE}+", " "))).otherwise(c)


def estimate_tokens(c: Column) -> Column:
    """0 for an empty text, else code points div 4 and at least 1; null for null."""
    n = F.char_length(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), (n / 4).cast("int"))).cast("int")


def truncate(c: Column, limit: int) -> Column:
    flat = collapsed(c)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(max(0, limit - 1)))), F.lit("…")))


def slug(c: Column, fallback: str = "general", max_length: int = 48) -> Column:
    """A file-name-safe slug; dots stay so that dotted domains survive."""
    dashed = F.regexp_replace(trimmed(normalize(c)), r"[^a-z0-9._-]+", "-")
    bare = F.regexp_replace(F.regexp_replace(dashed, r"^[-._]+|[-._]+$", ""), r"-{2,}", "-")
    return F.coalesce(F.nullif(F.left(bare, F.lit(max_length)), F.lit("")), F.lit(fallback))


def short_hash(c: Column, length: int = 8) -> Column:
    return F.left(F.sha2(c, 256), F.lit(length))
