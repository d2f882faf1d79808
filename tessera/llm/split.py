"""Splitting oversized items at natural boundaries.

A hierarchy of separators, section, paragraph, line, sentence, word and character, is applied to a text only as deep
as its parts need; the parts are packed greedily up to the limit, each piece opening with the last words of the one before.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS = 900, 40
#: Levels from coarse to fine; a cut lies at the end of each match.
SEPARATORS = (
    ("section", re.compile(r"\n(?=#{1,6}\s|={4,}|-{4,}|\*{3,}|\f|(?:chapter|section|cap[ií]tulo|kapitel|chapitre)\s+[\divxlc]+\b)", re.IGNORECASE)),
    ("paragraph", re.compile(r"(?:^|(?<=\n))[^\S\n]*\n")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…][\"'”’»›)\]}“‘]*\s+")),
    ("word", re.compile(r"\s+")),
)


LEVELS = tuple(name for name, _ in SEPARATORS) + ("character",)


class Hierarchy:
    """The places in a text where each level of separators cuts, found once for the whole text when a level is needed."""

    def __init__(self, text: str) -> None:
        self.text, self.places = text, {}

    def cuts(self, level: int, start: int, end: int) -> list[int]:
        if level not in self.places:
            self.places[level] = [m.end() for m in SEPARATORS[level][1].finditer(self.text)]
        places = self.places[level]
        return places[bisect_right(places, start) : bisect_left(places, end)]

    def parts(self, start: int, end: int, size: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
        """Consecutive spans of at most `size` characters, each with the level that ends it; a level is applied only to
        what the levels above it leave too large."""
        if level == len(SEPARATORS):
            while end - start > size:
                k = _hard_cut(self.text, start + size, start)
                yield start, k, level
                start = k
            yield start, end, level
            return
        edges = [start, *self.cuts(level, start, end), end]
        for a, b in zip(edges, edges[1:]):
            if b - a <= size:
                yield a, b, level
            else:
                yield from self.parts(a, b, size, level + 1)

    def boundary(self, size: int) -> str:
        """The level down to which the hierarchy must cut, from paragraphs on, to leave no part above `size` characters."""
        deepest = LEVELS[max(level for _, _, level in self.parts(0, len(self.text), size, 1))]
        return deepest if deepest in ("paragraph", "line", "sentence") else "none"

    def opening(self, body: int, overlap: int) -> int:
        """Where a piece opens whose body begins at `body`: at least `overlap` characters before it, at the start of a
        word if one lies within as much again."""
        at = body - overlap
        if at <= 0:
            return 0
        for k in range(at, max(0, at - overlap), -1):
            if self.text[k - 1].isspace() and not self.text[k].isspace():
                return k
        return _hard_cut(self.text, at, max(0, at - overlap))


def natural_boundary(text: str, size: int) -> str:
    return Hierarchy(text).boundary(size)


def _hard_cut(text: str, at: int, start: int) -> int:
    """A place at or a little before `at` that divides neither a line end nor a letter from its marks."""
    for back in range(min(32, at - start - 1)):
        k = at - back
        if not (text[k - 1] == "\r" and text[k] == "\n") and not unicodedata.combining(text[k]):
            return k
    return at


def split_text(text: str, limit: int, overlap: int, hierarchy: Hierarchy | None = None) -> list[tuple[int, int, int, str]]:
    """Pieces (from, body from, to, cut before): text[from:to] is at most `limit` characters; bodies tile the text.

    Parts are packed greedily; each piece but the first opens with the end of the one before, `overlap` characters at
    least and less than twice as many, from the start of a word where there is one."""
    cut = hierarchy or Hierarchy(text)
    pieces: list[tuple[int, int, int, str]] = []
    opens = start = end = 0
    before = "start"
    for a, b, level in cut.parts(0, len(text), limit - max(0, 2 * overlap - 1)):
        if b - opens > limit and end > start:
            pieces.append((opens, start, end, before))
            opens, start, before = cut.opening(a, overlap) if overlap else a, a, last
        end, last = b, LEVELS[level]
    if end > start:
        pieces.append((opens, start, end, before))
    return pieces


_PIECES = "block_id bigint, source string, ord int, piece int, n_pieces int, start_line int, body_offset int, overlap_chars int, cut string, boundary string, text string"


def _splitter(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECES.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _PIECES.split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                hierarchy = Hierarchy(text)
                pieces, boundary = split_text(text, limit, overlap, hierarchy), hierarchy.boundary(limit)
                lines = [m.start() for m in re.finditer("\n", text)]
                out = [
                    (row["block_id"], row["source"], row["ord"], i, len(pieces), None if row["start_line"] is None else row["start_line"] + bisect_left(lines, a), body, body - a, cut, boundary, text[a:b])
                    for i, (a, body, b, cut) in enumerate(pieces)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*out))], schema=schema)

    return run


def split_oversized(blocks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of every block whose text has more than `max_tokens` tokens (code points div 4).

    Each piece, its overlap with the piece before included, has at most `max_tokens`; no piece leaves its block, so
    none crosses a hard boundary. `start_line` is the line on which the piece begins, null if the block's is null;
    `boundary` the level down to which the hierarchy has to cut. The overlap begins with a whole word where there is one. Redelivered block ids count once (the largest text);
    blocks with a null id count once per text. Null, blank and short texts give no piece; an empty table gives an empty
    result; extra columns are ignored.
    """
    limit = max_tokens * 4 + 3
    large = blocks.select("block_id", "text", "start_line", "source", "ord").where(F.char_length("text") > limit)
    once = large.groupBy("block_id", F.when(F.col("block_id").isNull(), F.md5("text")).alias("_k")).agg(F.max(F.struct("text", "start_line", "source", "ord")).alias("b"))
    rows = once.select("block_id", "b.text", F.col("b.start_line").cast("int").alias("start_line"), "b.source", F.col("b.ord").cast("int").alias("ord"))
    return rows.mapInArrow(_splitter(limit, overlap_tokens * 4), _PIECES)


def refreshed_chunks(chunks: DataFrame, blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """chunks with `oversized` following the text: the code points of its blocks, from first to last, div 4.

    Blocks are found by equality on (source, ord) after the chunk's range of ord is unfolded; a chunk whose first or
    last block is missing, or that has a null id, keeps a null.
    """
    sizes = blocks.select("block_id", "source", "ord", F.char_length("text").alias("n")).where("block_id is not null").groupBy("block_id").agg(F.max(F.struct("source", "ord", F.coalesce("n", F.lit(0)).alias("n"))).alias("b"))
    sizes = sizes.select("block_id", "b.*")
    ends = lambda side: sizes.select(F.col("block_id").alias(side), F.col("source").alias(f"{side}_source"), F.col("ord").alias(f"{side}_ord"))
    keyed = chunks.select("chunk_id", "first_block_id", "last_block_id").distinct().join(ends("first_block_id"), "first_block_id").join(ends("last_block_id"), "last_block_id").where("first_block_id_ord <= last_block_id_ord")
    spans = keyed.select("chunk_id", F.col("first_block_id_source").alias("source"), F.explode(F.sequence("first_block_id_ord", "last_block_id_ord")).alias("ord"))
    total = spans.join(sizes, ["source", "ord"]).groupBy("chunk_id").agg((F.sum("n") > max_tokens * 4 + 3).alias("_over"))
    return chunks.drop("oversized").join(total, "chunk_id", "left").withColumnRenamed("_over", "oversized")
