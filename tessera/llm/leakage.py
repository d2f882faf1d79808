"""Evaluation texts leaking into training text.

A window of an item's words within `budget` word edits of a passage leaves at least one of its budget + 1 pieces
intact (pigeonhole), so exact hits of the pieces find all candidates; Myers' bit-parallel algorithm then gives the
true edit distance of the window to the passage around the hit.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BUDGET = 12, 2
#: Items, and characters of items, to a pass over the corpus. Their words and pieces are what each task holds; further items take further passes.
ITEMS_A_PASS, CHARS_A_PASS = 50_000, 16_000_000
_BLOCKS: dict[str, Items] = {}  # the block a worker process read last, kept for its next tasks
_GAP = re.compile(r"[\W_]+")
_FOUND = "doc_id bigint, item_id bigint, distance int, windows int, words int"


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case and without accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return _GAP.sub(" ", text.lower()).split()


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance, in words, of the whole pattern to any stretch of the text."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


class Items:
    """The words, windows and pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget, self.size = window, budget, window // (budget + 1)
        self.words = {i: words_of(t) for i, t in items}
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for i, words in self.words.items():
            for k in range(len(words) - self.size + 1) if len(words) >= window else ():
                self.pieces.setdefault(tuple(words[k : k + self.size]), []).append((i, k))
        self.vocabulary = {w for piece in self.pieces for w in piece}

    def leaks(self, text: str) -> dict[int, tuple[int, int]]:
        """By item: the least distance of its windows to the text, and the number of windows within the budget."""
        words = words_of(text)
        size, window, budget = self.size, self.window, self.budget
        known = bytes(map(self.vocabulary.__contains__, words))
        run = b"\x01" * size
        at = known.find(run)
        near: dict[tuple[int, int], set[int]] = {}
        while at >= 0:
            for i, k in self.pieces.get(tuple(words[at : at + size]), ()):
                for first in range(max(0, k - window + size), min(k, len(self.words[i]) - window) + 1):
                    if (k - first) % size == 0:  # only the budget + 1 pieces of that window
                        near.setdefault((i, first), set()).add(at - (k - first))
            at = known.find(run, at + 1)
        found: dict[int, list[int]] = {}
        for (i, first), starts in near.items():
            pattern, best = self.words[i][first : first + window], window
            for start in starts:
                stretch = words[max(0, start - budget) : start + window + budget]
                best = min(best, 0 if stretch[min(start, budget) :][:window] == pattern else myers(pattern, stretch))
                if not best:
                    break
            if best <= budget:
                found.setdefault(i, []).append(best)
        return {i: (min(d), len(d)) for i, d in found.items()}


def _block(token: str, items: list[tuple[int, str]], window: int, budget: int) -> Items:
    if token not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[token] = Items(items, window, budget)
    return _BLOCKS[token]


def _finder(items: list[tuple[int, str]], window: int, budget: int):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(token, items, window, budget)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, (distance, windows) in block.leaks(text.as_py()).items():
                    out.append((doc, i, distance, windows, len(block.words[i])))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(columns)], names)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """(doc_id, item_id, distance, windows, words): documents with a passage within `budget` word edits of `window`
    consecutive words of an item; the least distance and the number of the item's windows that are near.

    Items are taken in blocks of at most ITEMS_A_PASS items and about CHARS_A_PASS characters, each block a pass over the whole corpus without a shuffle; the held-out
    set is what is broadcast, one block at a time. Items of fewer words than the window, null texts and null item ids
    give no row; repeated items count once (the largest text), repeated documents give repeated rows' result once.
    """
    if budget < 0 or window < budget + 1:
        raise ValueError("the window needs more words than the error budget")
    unique = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    result = None
    block: list[tuple[int, str]] = []
    finders, chars = [], 0
    for row in unique.orderBy("item_id").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if len(block) == ITEMS_A_PASS or chars >= CHARS_A_PASS:
            finders.append(_finder(block, window, budget))
            block, chars = [], 0
    if block or not finders:
        finders.append(_finder(block, window, budget))
    for finder in finders:
        one = corpus.mapInArrow(finder, _FOUND)
        result = one if result is None else result.unionByName(one)
    return result.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("windows").alias("windows"), F.max("words").alias("words"))
