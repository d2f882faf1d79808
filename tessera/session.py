"""Reading tables, cutting lineage and checking sizes before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which `small` lets a side be broadcast, whatever the planner's own threshold is.
BROADCAST_ROWS = 20_000
#: Bytes up to which it does; arrays and strings count by their length.
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of intermediate tables that this process wrote and has not yet discarded.
_WRITTEN: list[str] = []


def file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a columnar table into the shared folder and reads it back with its statistics.

    Later jobs and retried tasks may read it, so it stays until `discard` or the end of the driver's process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    files, there = file_system(spark, path)
    files.deleteOnExit(there)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far, once the results that read them are done; returns their number."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        files, there = file_system(spark, path)
        files.delete(there, True)
    return len(paths)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        total += F.coalesce(F.size(F.col(f.name)) * 8 if kind == "array" else F.octet_length(F.col(f.name)) if kind == "string" else F.lit(8), F.lit(8)).cast("bigint")
    return total


def small(df: DataFrame, rows: int | None = None, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only if `df`, a table already written, has at most `rows` rows and about `size` bytes; else the join shuffles."""
    bound = BROADCAST_ROWS if rows is None else rows
    n, total = df.limit(bound + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= bound and total <= size else df
