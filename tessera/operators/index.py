"""An inverted index that is written once and read by every ranking: postings in the order of their terms.

A posting carries its document's length and its term's document frequency, so that a query reads only the postings of
its own terms and needs one shuffle, by (query, document).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.terms import term_counts
from tessera.session import file_system, shared_dir, table, written


@dataclass(frozen=True)
class Index:
    """postings (doc, term, tf, len, df), sorted by term; the number of documents and their mean length, at least 1."""

    postings: DataFrame
    doc: str
    n_docs: int
    avg_len: float


def _made(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, int, float]:
    """Documents without a term count among the documents."""
    tf = written(term_counts(docs, [doc], text), "terms")
    size = tf.groupBy(doc).agg(F.sum("tf").alias("len"))
    freq = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    n = docs.count()
    rows = tf.join(size, doc).join(freq, "term")
    # A term that a third of the documents have is cut by document.
    return rows.repartitionByRange("term", doc).sortWithinPartitions("term", doc).select(doc, "term", "tf", "len", "df"), n, max(1.0, total / max(1, n))


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
    """The index of rows (doc, text) for this process; null texts have no term, an empty table gives an empty index."""
    postings, n, avg_len = _made(docs, doc, text)
    return Index(written(postings, "index"), doc, n, avg_len)


def table_index(spark: SparkSession, folder: str, name: str, doc: str = "doc_id", text: str = "text") -> Index:
    """The index of a stored table, kept in the shared folder and used again until the table's files change.

    It is written under a name of its own and then renamed, so that a run that fails leaves none."""
    files, there = file_system(spark, f"{folder}/{name}.parquet")
    listing = [there] if files.getFileStatus(there).isFile() else [s.getPath() for s in files.listStatus(there)]
    marks = sorted(f"{p}:{(s := files.getFileStatus(p)).getLen()}:{s.getModificationTime()}" for p in listing)
    mark = hashlib.sha256("|".join([*marks, doc, text]).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark).rstrip('/')}/index-{name}-{mark}"
    final = file_system(spark, path)[1]
    if not files_exist(spark, path):
        postings, n, avg_len = _made(table(spark, folder, name), doc, text)
        draft = f"{path}.{hashlib.sha256(str(id(postings)).encode()).hexdigest()[:8]}"
        postings.write.mode("overwrite").option("compression", "zstd").parquet(f"{draft}/postings")
        spark.createDataFrame([(n, avg_len)], "n_docs bigint, avg_len double").coalesce(1).write.mode("overwrite").parquet(f"{draft}/stats")
        store, made = file_system(spark, draft)
        if not store.rename(made, final):
            store.delete(made, True)  # another run was first
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), doc, stats.n_docs, stats.avg_len)


def files_exist(spark: SparkSession, path: str) -> bool:
    store, there = file_system(spark, path)
    return store.exists(there)
