"""Files as tables: directories of documents, project trees, leaf and node files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes worth indexing; folders never worth it, at any depth or at the root only.
SUFFIXES = (
    "py pyi java kt kts scala groovy js mjs cjs jsx ts tsx c h cc cpp cxx hpp hh cs go rs swift php rb sql md txt rst xml yml yaml toml ini cfg "
    "properties gradle json html css scss sh bash zsh"
).split()
SKIPPED = ".git .hg .svn __pycache__ node_modules .venv venv dist build target .idea .vscode .gradle .mvn .next .nuxt coverage .pytest_cache .mypy_cache .tox".split()
SKIPPED_AT_ROOT = "out bin obj env".split()
MAX_BYTES = 256 * 1024
LEAF_SCHEMA = (
    "leaf_id string, schema_version int, timestamp string, ingested_at string, data_type string, domain string, title string, tags array<string>, keywords array<string>, "
    "entities array<string>, parent_id string, source string, span struct<start_line:int,end_line:int>, order_index int, token_estimate int, checksum string, oversized boolean, "
    "status string, superseded_by string, extra struct<chunker:string,block_kind:string,blocks:int,detection_confidence:double,context:string,oversized_reason:string>"
)
#: Marks around a leaf file's header; {} is the store's own tag.
OPEN, CLOSE = "<<<{}-META", "{}-META>>>"


def relative_path(root: str) -> Column:
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return F.regexp_replace(F.url_decode(path), f"^{root.rstrip('/')}/", "")


def kept(path: Column) -> Column:
    """Whether a relative path is worth indexing: a known suffix, no skipped or hidden folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    bad = F.exists(folders, lambda f: f.isin(*SKIPPED) | f.startswith("."))
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SUFFIXES) & ~bad & ~F.element_at(F.split(path, "/"), 1).isin(*SKIPPED_AT_ROOT)


def read_documents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(source, text, mtime) of all text files below a folder, one row each; folders of build output are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    rows = rows.select(relative_path(root).alias("source"), F.col("value").alias("text"), F.date_trunc("second", F.col("_metadata.file_modification_time")).alias("mtime"))
    return rows.where(kept(F.col("source")))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, mtime) of one text file, whatever its suffix; its source is its name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("source"), F.col("value").alias("text"), F.date_trunc("second", F.col("_metadata.file_modification_time")).alias("mtime"))


def scan_project(spark: SparkSession, root: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, size, mtime, too_large) of a project's files, without their content: what change detection reads first.

    Files over `max_bytes` are marked, not left out; None is no bound."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.select(relative_path(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where(kept(F.col("path"))).withColumn("too_large", F.lit(False) if max_bytes is None else F.col("size") > max_bytes)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, digest): with the content read, for files whose size or time has changed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(relative_path(root).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def read_leaves(spark: SparkSession, root: str, tag: str = "LEAF") -> DataFrame:
    """Leaf files: a JSON header between two marks, one line break, the body. The first closing mark ends the header.

    `malformed` tells files without marks or with a header that is no JSON; unknown keys are ignored."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(relative_path(root).alias("path"), "value")
    pattern = rf"(?s)^{OPEN.format(tag)}\s*(.*?)\s*{CLOSE.format(tag)}\r?\n?(.*)$"
    header, body = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    parsed = F.from_json(F.nullif(header, F.lit("")), LEAF_SCHEMA, {"mode": "PERMISSIVE"})
    rows = rows.select("path", parsed.alias("h"), body.alias("content"))
    return rows.select("path", "h.*", "content", F.col("h.leaf_id").isNull().alias("malformed"))


def write_leaves(leaves: DataFrame, root: str) -> None:
    """Leaves as a columnar table, a folder for each domain, so that a domain's scan reads no other."""
    leaves.write.mode("overwrite").partitionBy("domain").parquet(root)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def read_lines(documents: DataFrame, start: int, end: int) -> DataFrame:
    """(source, line, text) of the lines from `start` to `end`, counted from 1."""
    rows = documents.select("source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1).where(F.col("line").between(start, end))


def read_nodes(spark: SparkSession, root: str, layer: int | None = None) -> DataFrame:
    """Node files, one JSON document each; `malformed` tells files that are none. A layer's nodes are found by the column."""
    schema = "id string, layer int, domain string, title string, summary string, keywords array<string>, entities array<string>, tags array<string>, children array<string>, parent_id string, timestamp string, leaf_count bigint"
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(relative_path(root).alias("path"), F.from_json("value", schema).alias("n"))
    nodes = rows.select("path", "n.*", F.col("n.id").isNull().alias("malformed"))
    return nodes if layer is None else nodes.where(F.col("layer") == layer)


def read_changes(now: DataFrame, before: DataFrame, context: int = 2, share: float = 0.6) -> DataFrame:
    """(source, status, text): how files (source, text) read now differ from the copies last read: new, unchanged (without a
    text), changed with the lines that differ and `context` lines around them, or, where that would take more than `share` of
    the text, whole. Differences are made in Python, for changed files only."""
    import difflib

    old = before.select("source", F.col("text").alias("_old"))
    rows = now.select("source", "text").join(old, "source", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for source, text, then in zip(*(c.to_pylist() for c in batch.columns)):
                lines = list(difflib.unified_diff(then.splitlines(), text.splitlines(), "before", "now", n=context, lineterm=""))
                diff = "\n".join(lines)
                out.append((source, "diff", diff) if len(diff) < share * len(text) else (source, "changed", text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["source", "status", "text"])

    changed = rows.where("_old is not null and text is not null and _old <> text").mapInArrow(run, "source string, status string, text string")
    plain = rows.where("_old is null or text is null or _old = text")
    same = F.col("_old").isNotNull() & (F.col("_old") == F.col("text"))
    return changed.unionByName(plain.select("source", F.when(same, "unchanged").otherwise("new").alias("status"), F.when(~same, F.col("text")).alias("text")))
