"""History of changing attributes: versions with their period of validity.

Snapshots or updates are partitioned on common bounds by (entity, instant, tie) and sorted there, which merges the
sorted runs of all inputs k ways; an iterator over each partition holds one open version and emits it closed when the
payload changes. Bounds may fall inside an entity, even inside one instant of it, so that an entity with a third of all
rows is spread over many tasks. What is open at a partition's ends is settled from three rows of each partition at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, normalize
from tessera.operators.timestamps import parse_distinct, utc_text
from tessera.session import written

_MERGED = "entity string, payload string, valid_from bigint, valid_to bigint, part int, mark int"
_FIELDS = pa.schema([("entity", pa.string()), ("payload", pa.string()), ("valid_from", pa.int64()), ("valid_to", pa.int64()), ("part", pa.int32()), ("mark", pa.int32())])
#: A closed version; the run a partition begins with, closed or open; the version open before the partition's last
#: instant; and that last instant, whose payload a larger tie in the next partition may still replace.
_CLOSED, _HEAD_CLOSED, _HEAD_OPEN, _OPEN, _TAIL = 0, 1, 2, 3, 4
#: Parts subject and attribute in an entity's name; as white space it stands in neither.
_SEPARATOR = "\x1f"


def _differs(column: pa.Array) -> pa.Array:
    """For each value but the first, whether it differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions from rows (entity, instant, payload) sorted by entity, instant and tie. Holds one row and one open version."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    pending = opened = None  # the row read last, whose instant may go on; the version open so far
    head = True  # whether the open version is the run that the partition begins with
    names = ["entity", "instant", "payload"]

    def row(mark: int, version: tuple, until: int | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(entity=version[0], payload=version[2], valid_from=version[1], valid_to=until, part=part, mark=mark)], _FIELDS)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).cast(t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
        if pending is not None:
            columns = [pa.concat_arrays([pa.array([v], c.type), c]) for v, c in zip(pending, columns)]
        n = len(columns[0])
        pending = tuple(c[n - 1].as_py() for c in columns)
        if n == 1:
            continue
        whole = pc.indices_nonzero(pc.or_(_differs(columns[0]), _differs(columns[1])))  # the last row of each instant but the pending one
        if not len(whole):
            continue
        columns = [c.take(whole) for c in columns]
        if opened is not None:  # an open version stands for the payload held so far
            columns = [pa.concat_arrays([pa.array([v], c.type), c]) for v, c in zip(opened, columns)]
        changed = pc.or_(_differs(columns[0]), _differs(columns[2])) if len(columns[0]) > 1 else pa.array([], pa.bool_())
        starts = pa.concat_arrays([pa.array([0], pa.int64()), pc.add(pc.indices_nonzero(changed).cast(pa.int64()), 1)])
        entity, instant, payload = (c.take(starts) for c in columns)
        k = len(starts)
        opened = entity[k - 1].as_py(), instant[k - 1].as_py(), payload[k - 1].as_py()
        if k > 1:
            until = pc.if_else(_differs(entity), pa.scalar(None, pa.int64()), instant.slice(1))
            marks = [_CLOSED] * (k - 1)
            if head:
                marks[0], head = _HEAD_CLOSED, False
            yield pa.RecordBatch.from_arrays([entity.slice(0, k - 1), payload.slice(0, k - 1), instant.slice(0, k - 1), until, pa.array([part] * (k - 1), pa.int32()), pa.array(marks, pa.int32())], schema=_FIELDS)
    if opened is not None:
        yield row(_HEAD_OPEN if head else _OPEN, opened)
    if pending is not None:
        yield row(_TAIL, pending)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The versions that run over partitions' ends, from the partitions' edges in order."""
    out: list[dict] = []
    current = pending = None

    def close(until: int | None) -> None:
        out.append(dict(entity=current[0], payload=current[2], valid_from=current[1], valid_to=until))

    def apply(row: tuple) -> None:
        nonlocal current
        if current is not None and (current[0], current[2]) == (row[0], row[2]):
            return
        if current is not None:
            close(row[1] if current[0] == row[0] else None)
        current = row

    for batch in batches:
        for r in batch.to_pylist():
            row, mark = (r["entity"], r["valid_from"], r["payload"]), r["mark"]
            if pending is not None and mark != _OPEN:
                if pending[:2] != row[:2]:  # else the same instant goes on in this partition, with larger ties
                    apply(pending)
                pending = None
            if mark == _TAIL:
                pending = row
            elif mark == _OPEN:
                current = row
            else:
                apply(row)
                if mark == _HEAD_CLOSED:
                    close(r["valid_to"])
                    current = None
    if pending is not None:
        apply(pending)
    if current is not None:
        close(None)
    yield pa.RecordBatch.from_pylist(out, pa.schema(list(_FIELDS)[:4]))


def merge_versions(snapshots: Sequence[DataFrame]) -> DataFrame:
    """Versions (entity, payload, valid_from, valid_to; instants in bigint) of inputs (entity, instant, payload, tie).

    At one instant the row with the largest `tie` (then payload; a null tie is the smallest) counts. A payload equal to
    the one before starts no version. valid_to is the next version's start, null while open. Rows with a null among
    entity, instant and payload do not count; an empty input gives no version. Extra columns are ignored.
    """
    rows = None
    for each in snapshots:
        one = each.select("entity", "instant", "payload", F.col("tie").cast("string").alias("tie"))
        rows = one if rows is None else rows.unionByName(one)
    # Where a row came from cuts even a row repeated without end. Bounds are sampled from the written table, and the
    # filter reads it too: before the write it would repeat whatever expression made the instants.
    order = ["entity", "instant", "tie", "payload", "origin"]
    rows = written(rows.withColumn("origin", F.spark_partition_id()), "updates").where("entity is not null and instant is not null and payload is not null")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("entity", "instant", "payload")
    merged = written(sorted_rows.mapInArrow(_merge, _MERGED), "versions")
    edges = merged.where(F.col("mark") != _CLOSED).repartition(1).sortWithinPartitions("part", "mark")  # three rows of a partition at most
    settled = edges.mapInArrow(_settle, "entity string, payload string, valid_from bigint, valid_to bigint")
    return merged.where(F.col("mark") == _CLOSED).select("entity", "payload", "valid_from", "valid_to").unionByName(settled)


def fact_history(facts: DataFrame) -> DataFrame:
    """Gapless versions (subject, attribute, value, valid_from, valid_to as UTC text) of a facts table.

    Subject, attribute and value compare in lower case, without accents, white space trimmed and collapsed. Rows with
    a null or blank value or a null, blank or unreadable timestamp do not count, nor do rows without subject or
    attribute. Exact repeats count once. Timestamps are read where they stand, as few repeat.
    """
    base = facts.where("subject is not null and attribute is not null and value is not null and timestamp is not null")
    # Parser and text functions are two stages of code: as one they are too much for a method of generated code.
    dated = parse_distinct(base.select("subject", "attribute", "value", F.col("timestamp").alias("raw"), F.lit(None).cast("string").alias("zone"), F.col("fact_id").alias("tie")), "raw", "zone")
    dated = written(dated.select("subject", "attribute", "value", F.col("epoch").alias("instant"), "tie"), "dated").where("instant is not null")
    bare = dated.select(*[normalize(F.col(c)).alias(c) for c in ("subject", "attribute", "value")], "instant", "tie")
    keyed = bare.select(*[collapsed(F.col(c)).alias(c) for c in ("subject", "attribute", "value")], "instant", "tie").where("value <> ''")
    versions = merge_versions([keyed.select(F.concat("subject", F.lit(_SEPARATOR), "attribute").alias("entity"), "instant", F.col("value").alias("payload"), "tie")])
    parts = F.split("entity", _SEPARATOR)
    return versions.select(parts[0].alias("subject"), parts[1].alias("attribute"), F.col("payload").alias("value"), utc_text(F.col("valid_from")).alias("valid_from"), utc_text(F.col("valid_to")).alias("valid_to"))
