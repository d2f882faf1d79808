"""Filling fixed-capacity containers with items, by minimum bin slack.

Only the histogram of item lengths, at most one row per length up to the capacity, is solved in one place: a bitset
subset-sum picks, for the longest remaining length, the multiset of remaining lengths that comes closest to the
capacity, and that filling is repeated while the counts last. Each filling uses up a length, so their number is bounded
by the capacity however many items there are. Items learn their container from their rank within their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

CAPACITY = 2048
_PIECES = "doc_id bigint, n_tokens bigint, pieces array<int>"


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: how many}, with the longest length in it, whose sum is the largest up to the capacity.

    Lengths are tried from long to short; bit s of a set says that s can be reached. It stops at the first set that
    reaches the capacity, and backtracks through the sets for the counts."""
    lengths = sorted((x for x, c in counts.items() if c), reverse=True)
    longest = lengths[0]
    full = (1 << capacity + 1) - 1
    reached = 1 << longest
    sets = []
    for length in lengths:
        before = reached
        left = counts[length] - (length == longest)
        left = min(left, (capacity - longest) // length)
        step = 1
        while left > 0 and not reached >> capacity:
            take = min(step, left)
            reached |= reached << length * take & full
            left -= take
            step *= 2
        sets.append((length, before))
        if reached >> capacity:
            break
    total = reached.bit_length() - 1
    filling = {longest: 1}
    for length, before in reversed(sets):
        while not before >> total & 1:
            total -= length
            filling[length] = filling.get(length, 0) + 1
    return filling


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(containers, filling) until the counts are used up."""
    left = {x: c for x, c in counts.items() if c}
    out = []
    while left:
        filling = best_filling(left, capacity)
        times = min(left[x] // k for x, k in filling.items())
        out.append((times, filling))
        for x, k in filling.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def _measure(tokens: Callable[[], Callable[[list[str]], list[int]]], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens()
        for batch in batches:
            sizes = count(batch.column(1).to_pylist())
            pieces = [[capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0) for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(pieces, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "pieces"])

    return run


def byte_pair_counter(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts tokens of a public byte-pair vocabulary, given as a file of ranks that every worker can read; loaded once in each.

    Without the file the task fails and names it; no other count takes its place."""

    def load() -> Callable[[list[str]], list[int]]:
        import base64
        import os

        import tiktoken

        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {path}: pass the path of a file of byte-pair ranks that every worker can read")

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        # Fixed value: the pattern that the vocabulary's tokenizer splits text by.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]

    return load


def pack(documents: DataFrame, counter: Callable[[], Callable[[list[str]], list[int]]], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container): every piece of every document in one container of `capacity` tokens.

    A document is one piece unless it alone exceeds the capacity; then its full pieces take a container each and its
    rest is packed as an item. Empty and null texts have no token: piece 0, 0 tokens, a null container. Repeated rows
    are packed as often as they come; null ids are packed as well. Container ids are 0, 1, ... without gaps.
    """
    sized = written(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measure(counter, capacity), _PIECES), "sizes")
    void = sized.where("size(pieces) = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container"))
    items = sized.select("doc_id", F.posexplode("pieces").alias("piece", "n_tokens"))
    counts = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).toLocalIterator()}  # at most `capacity` rows
    # For each length the stretches of its ranks: so many containers from `base`, `each` items of this length in each.
    stretches, used, base = [], dict.fromkeys(counts, 0), 0
    for times, filling in fillings(counts, capacity):
        for length, each in filling.items():
            stretches.append((length, used[length], used[length] + each * times, base, each))
            used[length] += each * times
        base += times
    spark = documents.sparkSession
    plan = spark.createDataFrame(stretches or [(0, 0, 0, 0, 1)], "n_tokens int, low bigint, high bigint, base bigint, each int")
    by_length = plan.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "each"))).alias("stretches"))
    # Ranks: a length may hold a third of all items, so its items are ranked in slots and the slots laid end to end.
    slots = max(1, sum(counts.values()) // 20_000)
    slotted = items.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    sizes = slotted.groupBy("n_tokens", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = slotted.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "slot").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "slot"]).withColumn("rank", F.col("rank") + F.col("offset"))
    held = ranked.join(F.broadcast(by_length), "n_tokens").withColumn("s", F.filter("stretches", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0])
    container = F.col("s.base") + F.floor((F.col("rank") - F.col("s.low")) / F.col("s.each"))
    return held.select("doc_id", "piece", "n_tokens", container.cast("bigint").alias("container")).unionByName(void)
