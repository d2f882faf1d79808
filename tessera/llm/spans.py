"""Long exact spans shared between records.

Texts are cut into content-defined chunks: a gear hash rolls over 32 characters, and a cut lies wherever it is least
among 84 neighbours in a row. Both depend on nearby characters alone, so an insertion moves few cuts, and every span
of 200 characters holds a whole chunk with the 32 characters its first cut was found on. Chunk digests that occur in
two different texts mark the places where a shared span can lie; there, and only there, every window of 200
characters is hashed, and a window in two documents is a shared span. All counting is by aggregation, so a chunk that
a third of the records share costs no pairs; records with the same text are judged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import small, written

SPAN, GEAR = 200, 32
_SLAB = 1 << 20
#: Rows of two hashes, under 10 MB in all, up to which they are broadcast.
NARROW_ROWS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A text is told by 128 bits of hash and its length.
_TEXT = ["text_id", "text_id2", "n_chars"]
_CHUNKS = "doc_id bigint, text_id bigint, text_id2 bigint, n_chars bigint, digests array<bigint>"
_WINDOWS = "doc_id bigint, start array<int>, h1 array<bigint>, h2 array<smallint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def reach(span: int) -> int:
    """The neighbours among which a cut is least: two neighbouring cuts then lie in any span."""
    return (span - GEAR + 1) // 2


def _least(codes: np.ndarray, wide: int) -> np.ndarray:
    """For each of len(codes) - wide + 1 beginnings, where the gear hash is least among `wide` places; the last of equals."""
    n = len(codes)
    hashed = _mix(codes.astype(np.uint64) + _BASE).astype(np.uint32)
    for step in (1, 2, 4, 8, 16):
        rolled = hashed.copy()
        rolled[step:] += hashed[:-step] << np.uint32(step)
        hashed = rolled
    order = (hashed.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size = 1
    while size * 2 <= wide:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    if size < wide:
        order = np.minimum(order[: len(order) - (wide - size)], order[wide - size :])
    return 0xFFFFFFFF - (order & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _cuts_in(codes: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """Cuts (last character of the gear window) of texts laid end to end, each beginning at one of `starts`."""
    n = len(codes)
    if n < GEAR + wide:
        return np.zeros(0, np.int64)
    places = _least(codes, wide)
    ends = np.append(starts[1:], n)
    usable = np.zeros(len(places) + 1, np.int32)  # +1 where windows of one text begin, -1 where they end
    first, last = starts + GEAR - 1, ends - wide + 1
    fits = last > first
    np.add.at(usable, first[fits], 1)
    np.add.at(usable, last[fits], -1)
    places = places[np.cumsum(usable[:-1]) > 0]
    return places[np.append(True, places[1:] != places[:-1])] if len(places) else places


def cuts(codes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The cuts of one text, in slabs, so that memory doesn't follow its length."""
    wide, zero = reach(span), np.zeros(1, np.int64)
    if len(codes) <= 2 * _SLAB:
        return _cuts_in(codes, zero, wide)
    found = []
    for at in range(0, len(codes), _SLAB):
        low = max(0, at - GEAR + 1)
        found.append(low + _cuts_in(codes[low : at + _SLAB + wide], zero, wide))
    return np.unique(np.concatenate(found))


def _prefix(codes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters' values times powers of a base, and the inverse powers that make stretches comparable."""
    base = _BASE + np.uint64(2 * seed)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.full(len(codes), base, np.uint64))
    inverses = np.cumprod(np.full(len(codes) + 1, inverse, np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) * np.uint64(2 * seed + 1) + _BASE) * powers)]), inverses


def stretch_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of codes[start:end]; starts ascend. Equal stretches have equal hashes wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, low + _SLAB)))
        part = slice(at, upto)
        sums, inverses = _prefix(codes[low : int(ends[part].max())], seed)
        a, b = starts[part] - low, ends[part] - low
        out[part] = _mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))
        at = upto
    return out


def _batched(ids: list, texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """Texts in groups of about a slab of characters."""
    group, size = [], 0
    for doc, text in zip(ids, texts):
        text = text.as_py()
        group.append((doc, text))
        size += len(text)
        if size >= _SLAB // 2:
            yield group
            group, size = [], 0
    if group:
        yield group


def _chunker(span: int):
    wide = reach(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _batched(batch.column(0).to_pylist(), batch.column(1)):
                sizes = np.array([len(t) for _, t in group], np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[:-1]
                codes = code_points("".join(t for _, t in group))
                found = _cuts_in(codes, starts, wide) if len(codes) <= 2 * _SLAB else np.concatenate([s + cuts(codes[s : s + n], span) for s, n in zip(starts, sizes)])
                owner = np.searchsorted(starts, found, "right") - 1
                inside = np.flatnonzero(owner[1:] == owner[:-1])
                digests = stretch_hashes(codes, found[inside] - GEAR + 1, found[inside + 1] + 1).view(np.int64)
                offsets = np.searchsorted(owner[inside], np.arange(len(group) + 1)).astype(np.int32)
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for _, t in group), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in group], pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(digests)),
                    ],
                    ["doc_id", *_TEXT, "digests"],
                )

    return run


def candidate_starts(codes: np.ndarray, flagged: np.ndarray, span: int) -> np.ndarray:
    """Where windows of `span` characters begin whose own cuts enclose only flagged chunks.

    A window's own cuts are those that places inside it decide: from the least of its first places to the least of
    its last. Another text with the same window has the same cuts there, and so the same chunks, one at least."""
    wide, found, out = reach(span), cuts(codes, span), []
    bad = np.ones(max(0, len(found) - 1), np.int64)
    bad[flagged] = 0
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(bad)])
    for low in range(0, len(codes) - span + 1, _SLAB):
        part = codes[low : low + _SLAB + span - 1]
        least = low + _least(part, wide)
        n = len(part) - span + 1
        first = np.searchsorted(found, least[GEAR - 1 : GEAR - 1 + n])
        last = np.searchsorted(found, least[span - wide : span - wide + n])
        out.append(low + np.flatnonzero(before[first] == before[last]))
    return np.concatenate(out)


def _windower(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, flagged in zip(*(batch.column(i) for i in range(3))):
                codes = code_points(text.as_py())
                at = candidate_starts(codes, np.array(flagged.as_py(), np.int64), span)
                for k in range(0, len(at), _SLAB):
                    some = at[k : k + _SLAB]
                    h1 = stretch_hashes(codes, some, some + span, 1).view(np.int64)
                    h2 = (stretch_hashes(codes, some, some + span, 2) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), one(some.astype(np.int32), pa.int32()), one(h1, pa.int64()), one(h2, pa.int16())], ["doc_id", "start", "h1", "h2"])

    return run


def shared_windows(documents: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(text groups, windows): doc_id, n_chars and whether another document has the very text; and (doc_id, start) of
    every window of `span` characters that occurs in a document of another text, for one document of each text."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text").where(F.char_length("text") >= span)
    chunks = written(texts.mapInArrow(_chunker(span), _CHUNKS), "chunks")
    groups = chunks.groupBy(*_TEXT).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    narrow = chunks.select("doc_id", *_TEXT).join(groups, _TEXT).select("doc_id", "n_chars", (F.col("first") != F.col("last")).alias("copied"), (F.col("doc_id") == F.col("first")).alias("stands"))
    # Digests within a text are made distinct before they leave it; the text, not the document, is what must differ.
    exploded = chunks.select("text_id", F.explode(F.array_distinct("digests")).alias("digest"))
    common = written(exploded.groupBy("digest").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a <> b").select("digest"), "common")
    placed = chunks.select("doc_id", *_TEXT, F.posexplode("digests").alias("place", "digest"))
    marked = placed.join(small(common), "digest").groupBy("doc_id", *_TEXT).agg(F.collect_list("place").alias("places"))
    standing = written(marked.join(groups, _TEXT).where("doc_id = first").select("doc_id", "places"), "marked")
    windows = texts.join(small(standing), "doc_id").select("doc_id", "text", "places").mapInArrow(_windower(span), _WINDOWS)
    hashed = written(windows.select("doc_id", F.explode(F.arrays_zip("start", "h1", "h2")).alias("w")).select("doc_id", "w.*"), "windows")
    # A window that occurs twice in all is known from the two ends of its group; only commoner ones are looked up again.
    ends = [F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min_by("start", "doc_id").alias("at_a"), F.max_by("start", "doc_id").alias("at_b"), F.count("*").alias("n")]
    common_windows = written(hashed.groupBy("h1", "h2").agg(*ends).where("a <> b").select(*[F.when(F.col("n") == 2, F.col(c)).alias(c) for c in ("a", "b", "at_a", "at_b")], *[F.when(F.col("n") > 2, F.col(c)).alias(c) for c in ("h1", "h2")]), "found")
    pairs = common_windows.where("a is not null")
    twice = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("at_a").alias("start")), F.struct(F.col("b").alias("doc_id"), F.col("at_b").alias("start")))).alias("w")).select("w.*")
    often = hashed.join(small(common_windows.where("h1 is not null").select("h1", "h2"), NARROW_ROWS), ["h1", "h2"]).select("doc_id", "start")
    return narrow, twice.unionByName(often)


def shared_characters(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, shared_chars): the code points of each document that lie in a verbatim span of at least `span` that
    also occurs in another document; documents without one give no row.

    Repeats inside one document, or of one doc_id with the same text, do not count. Null texts and null ids give no
    row; texts under `span` share nothing; very long texts are read in slabs.
    """
    narrow, windows = shared_windows(documents, span)
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
    steps = windows.distinct().withColumn("step", F.least(F.coalesce(after - F.col("start"), F.lit(span)), F.lit(span)))
    partly = steps.groupBy("doc_id").agg(F.sum("step").alias("shared_chars"))
    whole = narrow.where("copied").select("doc_id", F.col("n_chars").alias("shared_chars")).distinct()
    single = narrow.where("not copied").select("doc_id").distinct()
    return whole.unionByName(partly.join(single, "doc_id", "left_semi"))


def shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, start, length) of the maximal shared stretches; exact copies give one stretch, the whole text."""
    narrow, windows = shared_windows(documents, span)
    by_start = Window.partitionBy("doc_id").orderBy("start")
    fresh = F.when(F.col("start") - F.lag("start").over(by_start) <= span, 0).otherwise(1)
    runs = windows.distinct().withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_start))
    partly = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + span).alias("length")).drop("run")
    whole = narrow.where("copied").select("doc_id", F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("length")).distinct()
    single = narrow.where("not copied").select("doc_id").distinct()
    return whole.unionByName(partly.join(single, "doc_id", "left_semi"))
