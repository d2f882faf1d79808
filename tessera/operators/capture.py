"""Captured conversations: merged turns, fragments with a token budget, marks of how far a session was read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

SLOT = 4096


def clean_turns(turns: DataFrame) -> DataFrame:
    """Each message's turn once, with a plain role (other where it is none of user, assistant, system)."""
    role = F.lower(trimmed(F.coalesce("role", F.lit(""))))
    rows = turns.where("message_id is not null and session_id is not null").groupBy("session_id", "message_id").agg(F.max(F.struct("ord", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "timestamp")).alias("t"))
    plain = F.when(F.col("t.role").isin("user", "assistant", "system"), F.col("t.role")).otherwise("other")
    return rows.select("session_id", "message_id", F.col("t.ord").alias("ord"), plain.alias("role"), F.col("t.text").alias("text"), F.col("t.timestamp").alias("timestamp"))


def merge_turns(turns: DataFrame) -> DataFrame:
    """(session_id, first_ord, role, records, chars): runs of consecutive assistant records become one turn.

    Runs are found within stretches of `ord`; a stretch learns from the one before it how that ended, so a session
    with a third of all rows is spread over many tasks."""
    rows = clean_turns(turns).withColumn("slot", F.floor(F.col("ord") / SLOT))
    by = Window.partitionBy("session_id", "slot").orderBy("ord", "message_id")
    ends = rows.groupBy("session_id", "slot").agg(F.max(F.struct("ord", "message_id", "role")).alias("e")).withColumn("_before", F.lag("e.role").over(Window.partitionBy("session_id").orderBy("slot"))).drop("e")
    linked = rows.withColumn("_lag", F.lag("role").over(by)).join(ends, ["session_id", "slot"])
    starts = ~((F.col("role") == "assistant") & (F.coalesce("_lag", "_before", F.lit("")) == "assistant"))
    marked = linked.withColumn("_start", F.when(starts, F.col("ord")))
    inner = F.max("_start").over(by.rowsBetween(Window.unboundedPreceding, 0))
    carried = marked.groupBy("session_id", "slot").agg(F.max("_start").alias("_top")).withColumn("_carry", F.max("_top").over(Window.partitionBy("session_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    placed = marked.withColumn("_inner", inner).join(carried, ["session_id", "slot"]).withColumn("first_ord", F.coalesce("_inner", "_carry"))
    return placed.groupBy("session_id", "first_ord").agg(F.max("role").alias("role"), F.count("*").alias("records"), F.sum(F.char_length("text")).alias("chars"))


_FRAGMENTS = "session_id string, fragment int, first_ord int, last_ord int, turns int, tokens int"


def _fragmenter(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in _FRAGMENTS.split(", ")]
        session, number, first, last, turns, tokens, out = None, 0, 0, 0, 0, 0, []
        for batch in batches:
            for s, ord_, role, size in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and (s != session or role == "user" and tokens >= budget):
                    out.append((session, number, first, last, turns, tokens))
                    number, turns, tokens = number + 1, 0, 0
                if s != session:
                    session, number = s, 0
                if not turns:
                    first = ord_
                last, turns, tokens = ord_, turns + 1, tokens + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if turns:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((session, number, first, last, turns, tokens), types)], names)

    return run


def fragments(turns: DataFrame, budget: int = 600) -> DataFrame:
    """Runs of a session's turns that are cut only before a user's turn, once the budget of tokens is reached.

    Where the next cut falls depends on the one before, so a session is read in order as a stream, holding one
    fragment's counts; only sizes are shuffled. Turns without text count no token."""
    n = F.char_length("text")
    size = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")
    rows = clean_turns(turns).select("session_id", F.col("ord").cast("int").alias("ord"), "role", size.alias("size"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ord").mapInArrow(_fragmenter(budget), _FRAGMENTS)


def high_water(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, last_instant, last_id, messages): how far each session has been read, by (instant, id); rows (key, id, instant
    in bigint). Null sessions, ids and instants do not count."""
    rows = messages.where(F.col(key).isNotNull() & F.col("id").isNotNull() & F.col("instant").isNotNull())
    top = F.max(F.struct("instant", "id"))
    return rows.groupBy(key).agg(top.alias("_t"), F.count_distinct("id").alias("messages")).select(key, F.col("_t.instant").alias("last_instant"), F.col("_t.id").alias("last_id"), "messages")


def unread(messages: DataFrame, marks: DataFrame, key: str = "session_id") -> DataFrame:
    """Messages beyond the mark of their session, of sessions without one, or without an instant, which no mark covers."""
    rows = messages.join(marks.select(key, "last_instant", "last_id"), key, "left")
    beyond = (F.col("instant") > F.col("last_instant")) | (F.col("instant") == F.col("last_instant")) & (F.col("id") > F.col("last_id"))
    return rows.where(F.col("last_instant").isNull() | F.col("instant").isNull() | beyond).drop("last_instant", "last_id")


def filled_times(turns: DataFrame) -> DataFrame:
    """turns (session_id, ord, timestamp, ...) with `last_seen`, the latest timestamp that stands at or before each in its
    session's order. Stretches of `ord` carry it over, so that a large session is spread over many tasks."""
    rows = turns.withColumn("_slot", F.floor(F.col("ord") / SLOT))
    inner = F.last("timestamp", ignorenulls=True).over(Window.partitionBy("session_id", "_slot").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.groupBy("session_id", "_slot").agg(F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("ord"))).alias("_top"))
    before = Window.partitionBy("session_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(F.col("session_id").alias("_s"), F.col("_slot").alias("_t"), F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    return rows.withColumn("_inner", inner).join(carried, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("_slot").eqNullSafe(F.col("_t")), "left").withColumn("last_seen", F.coalesce("_inner", "_carry")).drop("_slot", "_inner", "_carry", "_s", "_t")


def totals(fragments: DataFrame) -> DataFrame:
    """One row of what was captured: sessions, fragments, turns, tokens."""
    return fragments.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("fragments"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
