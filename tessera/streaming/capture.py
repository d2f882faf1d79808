"""Capture in sweeps: transcript files grow, turns are taken once; sessions counted as a stream; late facts re-resolve their keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.facts import key_of, timeline
from tessera.session import shared_dir, written
from tessera.sources.transcripts import parse_dialect_a, parse_dialect_b


def capture_stream(spark: SparkSession, pattern: str, out: str, checkpoint: str, dialect: str = "a") -> None:
    """Takes the turns that transcript files hold and the table at `out` lacks, then stops. A second run takes what came since.

    The record at `checkpoint` has the size and time that each file had when it was read; files that differ from it,
    new, grown or rewritten, are read again and merged by their turns' keys. A last line that is not yet whole gives no turn
    and is taken by the run that finds it whole. The record is written after the turns, so that a run that fails is
    made good by the next."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "length", "modificationTime")
    seen = f"{checkpoint}/files"
    if _exists(spark, seen):
        files = files.join(spark.read.parquet(seen), ["path", "length", "modificationTime"], "left_anti")
    changed = written(files, "changed")  # as listed now: what is added from here on counts as not yet read
    paths = [r.path for r in changed.select("path").collect()]
    if not paths:
        return
    lines = spark.read.option("__globPaths__", "false").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    turns = {"a": parse_dialect_a, "b": parse_dialect_b}[dialect](lines)
    upsert(turns.withColumn("turn_key", F.sha2(F.to_json(F.struct("path", "session_id", "timestamp", "role", "text", "actions")), 256)), out)
    changed.write.mode("append").parquet(seen)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def upsert(turns: DataFrame, out: str) -> None:
    """Adds the turns whose key the table at `out` lacks, as a batch folder of their own. A key is a hash of the content."""
    spark, number = turns.sparkSession, 0
    turns = turns.dropDuplicates(["turn_key"])
    if _exists(spark, out):
        stored = spark.read.parquet(out)
        number = (stored.agg(F.max("batch")).first()[0] or 0) + 1
        turns = turns.join(stored.select("turn_key"), "turn_key", "left_anti")
    turns.write.mode("append").parquet(f"{out}/batch={number}")


def session_counts(spark: SparkSession, pattern: str, schema: str, timeout: str = "30 minutes"):
    """A streaming aggregate: turns by session, late rows within the watermark counted."""
    rows = spark.readStream.schema(schema).parquet(pattern)
    return rows.withWatermark("at", timeout).groupBy(F.session_window("at", timeout), "session_id").agg(F.count("*").alias("turns"))


def streamed_counts(spark: SparkSession, path: str, keys: list[str], measures: dict) -> DataFrame:
    """Counts by key of the rows that a stream of files has brought so far: each micro-batch is counted by itself and written
    under its number, so that one that is run again replaces itself; the parts are added up. Takes all there is, then stops."""
    out, state = (f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}" for label in ("counts", "stream"))
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).where(" and ".join(f"{k} is not null" for k in keys))

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(count).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, out):
        return spark.read.parquet(path).limit(0).groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])


def resolve_late(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """The timeline of the keys that a batch of facts touches, from all their facts, however they spell subject and
    attribute: late ones are always accepted."""
    touched = batch.select(key_of().alias("_key")).where("_key is not null").distinct()
    affected = facts.withColumn("_key", key_of()).join(touched, "_key", "left_semi").drop("_key").unionByName(batch)
    return timeline(affected)
