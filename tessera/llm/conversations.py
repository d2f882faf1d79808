"""Rebuilding conversations from message rows.

Rows are partitioned and sorted by (session, instant, message id), bounds falling inside a session too, so a session
with a third of all rows is spread over tasks. A finite-state automaton reads each session's symbols in order; since
its transitions compose, each task reports for its stretch of a session which state leads to which, and the few
stretches of a session are composed in order afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.operators.timestamps import normalize_instants, with_session_zone
from tessera.session import written

ROLES = ("user", "assistant", "system")
#: Symbols: void or system turn, user, assistant, broken message. States: nothing yet, user last, assistant last, broken.
VOID, USER, ASSISTANT, BROKEN = range(4)
NEXT = ((0, 1, 3, 3), (1, 1, 2, 3), (2, 1, 2, 3), (3, 3, 3, 3))
REASONS = ("empty", "unanswered", None, "broken")


def _monoid() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All state maps that words over the symbols give, and the table of their products."""
    identity = tuple(range(4))
    maps, todo = [identity], [identity]
    while todo:
        m = todo.pop()
        for symbol in range(4):
            n = tuple(NEXT[s][symbol] for s in m)
            if n not in maps:
                maps.append(n)
                todo.append(n)
    return maps, [[maps.index(tuple(b[s] for s in a)) for b in maps] for a in maps]


MAPS, PRODUCT = _monoid()
AFTER = [[MAPS.index(tuple(NEXT[s][symbol] for s in m)) for symbol in range(4)] for m in MAPS]
_READ = "session_id string, id string, symbol int, part int, place bigint, state_map int"


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their place in this task's stretch of the session and the map of the stretch so far."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    current, place, state = object(), 0, 0
    for batch in batches:
        sessions, ids, symbols = (batch.column(i).to_pylist() for i in range(3))
        places, states = [], []
        for session, symbol in zip(sessions, symbols):
            if session != current:
                current, place, state = session, 0, 0
            state = AFTER[state][symbol]
            places.append(place)
            states.append(state)
            place += 1
        n = len(sessions)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(states, pa.int32())],
            ["session_id", "id", "symbol", "part", "place", "state_map"],
        )


def clean_role(c: Column) -> Column:
    role = F.lower(trimmed(c))
    return F.when(role.isin(*ROLES), role)


def read_messages(messages: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each message once, in its session's order, with its symbol, place and automaton state.

    Redelivered ids count once (largest session id, earliest instant); a null session id drops the message. A turn's
    role is that of the largest of its repeated rows. A message with a null id has no turn and is broken.
    """
    rows = with_session_zone(messages.select("id", "session_id", "time_created"), sessions)
    timed = normalize_instants(rows, "time_created", "_zone").select("id", "session_id", "epoch").where("session_id is not null")
    once = timed.where("id is not null").groupBy("id").agg(F.max("session_id").alias("session_id"), F.min("epoch").alias("epoch"))
    once = once.unionByName(timed.where("id is null"))
    speaks = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    said = turns.where("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(F.max(F.struct(clean_role(F.col("role")).alias("role"), speaks.alias("speaks"))).alias("turn"))
    joined = once.join(said, "id", "left")
    symbol = (
        F.when(F.col("turn").isNull() | F.col("epoch").isNull() | F.col("turn.role").isNull(), BROKEN)
        .when(~F.col("turn.speaks") | (F.col("turn.role") == "system"), VOID)
        .when(F.col("turn.role") == "user", USER)
        .otherwise(ASSISTANT)
    )
    keyed = joined.select("session_id", "id", symbol.cast("int").alias("symbol"), "epoch")
    order = ["session_id", "epoch", "id"]
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("session_id", "id", "symbol").mapInArrow(_automaton, _READ), "conversations")


def _verdicts(read: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, reason): reason null for whole conversations; over all ids of sessions and of messages."""
    size = len(MAPS)
    table = F.array(*[F.lit(x) for row in PRODUCT for x in row])
    ends = F.array(*[F.lit(REASONS[m[0]]) for m in MAPS])
    stretches = read.groupBy("session_id", "part").agg(F.max_by("state_map", "place").alias("m"))
    whole = stretches.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("s"))
    folded = F.aggregate("s", F.lit(0), lambda acc, x: F.element_at(table, acc * size + x["m"] + 1))
    heard = whole.select("session_id", folded.alias("m"))
    listed = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct().withColumn("listed", F.lit(True))
    both = heard.join(listed, "session_id", "full")
    reason = F.when(F.col("listed").isNull(), "broken").when(F.col("m").isNull(), "empty").otherwise(F.element_at(ends, F.col("m") + 1))
    return both.select("session_id", reason.alias("reason"))


def dropped_sessions(messages: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, reason) of the conversations to drop: broken, empty or unanswered."""
    return _verdicts(read_messages(messages, turns, sessions), sessions).where("reason is not null")


def conversations(messages: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """The turns (session_id, position, message_id, role, text) of whole conversations, void turns left out.

    Positions count from 0 over the session's messages in order of instant, ties by message id. Repeated turn rows
    count once; sessions to drop give no row; empty tables give an empty result.
    """
    read = read_messages(messages, turns, sessions)
    kept = _verdicts(read, sessions).where("reason is null").select("session_id")
    sizes = read.groupBy("session_id", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = read.where(F.col("id").isNotNull()).join(offsets, ["session_id", "part"]).join(kept, "session_id", "left_semi").select("session_id", (F.col("base") + F.col("place")).alias("position"), F.col("id").alias("message_id"), "symbol")
    said = turns.where("message_id is not null").groupBy("message_id").agg(F.max(F.struct(clean_role(F.col("role")).alias("role"), "text")).alias("t"))
    return placed.where(F.col("symbol").isin(USER, ASSISTANT)).join(said, "message_id").select("session_id", "position", "message_id", "t.role", "t.text")
