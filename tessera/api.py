"""A thin facade over the operators, for programs and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import NotFound, StoreNotInitialised
from tessera.functions import terms, text
from tessera.functions.notes import leading_date
from tessera.operators import chunking, classify, facts, ranking, search, store, summaries, tree
from tessera.operators.timestamps import utc_text
from tessera.session import file_system, written
from tessera.sources import files


@dataclass(frozen=True)
class Config:
    branch_factor: int = 8
    target_tokens: int = 2000
    max_tokens: int = 3000
    min_tokens: int = 120
    beam_width: int = 3
    symbols: bool = False

    def __post_init__(self) -> None:
        if self.branch_factor < 2 or not 0 < self.min_tokens <= self.target_tokens <= self.max_tokens or self.beam_width < 1:
            raise ValueError("the settings contradict each other")

    @classmethod
    def of(cls, values: dict) -> Config:
        """From a mapping; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def values(self) -> dict:
        return asdict(self)

    def save(self, spark: SparkSession, root: str) -> None:
        """As JSON beside the store."""
        spark.createDataFrame([(json.dumps(self.values()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/config")

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Config:
        """The settings saved beside a store, or the defaults."""
        path = f"{root.rstrip('/')}/config"
        store_files, there = file_system(spark, path)
        return cls.of(json.loads("".join(r.value for r in spark.read.text(path).collect()))) if store_files.exists(there) else cls()


#: Settings of a store for the memory of one session, and of one for a project's code.
SESSION, PROJECT = Config(branch_factor=4, target_tokens=400, max_tokens=1200), Config(target_tokens=400, max_tokens=1200, symbols=True)
_LEAF = "leaf_id string, timestamp string, ingested_at string, data_type string, domain string, source string, order_index int, title string, tags array<string>, keywords array<string>, entities array<string>, start_line int, end_line int, parent_id string, status string, superseded_by string, oversized boolean, token_estimate int, checksum string, context string, content string"


class Memory:
    """A store in a folder: tables leaves, facts and supersessions; nodes and everything else are derived from them.

    A table is a folder of numbered versions; one that is written whole is the current one, so that a run that fails leaves
    the version before it. `detector` takes documents (doc_id, source, text) to (doc_id, data_type, domain), `chunkers` has
    functions by data type as in chunking.blocks_by_type, `summarizer` is as in tree.build_tree."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, detector: Callable = classify.detect, chunkers: dict | None = None, summarizer: Callable = summaries.summarize_nodes, rules: tuple = facts.RULES) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config.load(spark, root)
        self.detector, self.chunkers, self.summarizer, self.rules = detector, chunkers, summarizer, rules

    # ------------------------------------------------------------ tables
    def _versions(self, name: str) -> list[str]:
        there, folder = file_system(self.spark, f"{self.root}/{name}")
        if not there.exists(folder):
            return []
        found = [s.getPath() for s in there.listStatus(folder)]
        return sorted(p.getName() for p in found if there.exists(file_system(self.spark, f"{p}/_SUCCESS")[1]))

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        versions = self._versions(name)
        if versions:
            return self.spark.read.parquet(f"{self.root}/{name}/{versions[-1]}")
        if schema is None:
            raise StoreNotInitialised(f"no table {name} in {self.root}")
        return self.spark.createDataFrame([], schema)

    def _replace(self, name: str, df: DataFrame) -> None:
        """Writes the next version, then drops those before the last."""
        versions = self._versions(name)
        number = int(versions[-1]) + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{number:06}")
        for old in versions[:-1]:
            there, path = file_system(self.spark, f"{self.root}/{name}/{old}")
            there.delete(path, True)

    def exists(self) -> bool:
        return bool(self._versions("leaves"))

    def initialize(self, force: bool = False) -> None:
        """An empty store, or with `force` on an existing one: leaves stay, without parents; what is derived goes."""
        self.config.save(self.spark, self.root)
        if not self.exists():
            self._replace("leaves", self.spark.createDataFrame([], _LEAF))
        elif force:
            self._replace("leaves", tree.detached(self._table("leaves")))
            there, path = file_system(self.spark, f"{self.root}/nodes")
            there.delete(path, True)

    # ------------------------------------------------------------ ingestion
    def build_leaves(self, documents: DataFrame, now: str) -> DataFrame:
        """Leaves of documents (source, text, and where there are mtime, timestamp, data_type, domain, tags): classified, cut
        by type, packed, with keywords, entities, tags and a timestamp.

        Order of timestamps: the document's own `timestamp`, the date the leaf opens with (not in code), its blocks' date,
        `mtime`, `now`. A document without a source has one made of its content; of rows of one source the latest counts."""
        given = set(documents.columns)
        none = F.lit(None).cast("string")
        empty = F.array().cast("array<string>")
        own = F.coalesce(F.nullif(text.trimmed(F.col("source")), F.lit("")), F.concat(F.lit("text://"), text.short_hash(F.col("text"), 16)))
        docs = documents.where("text is not null").select(own.alias("source"), "text", *[(F.col(c) if c in given else none).alias(f"given_{c}") for c in ("timestamp", "data_type", "domain")], (F.col("tags") if "tags" in given else empty).alias("given_tags"), (F.col("mtime") if "mtime" in given else F.lit(None).cast("timestamp")).alias("mtime"))
        docs = docs.groupBy("source").agg(F.max(F.struct("mtime", "text", "given_timestamp", "given_data_type", "given_domain", "given_tags")).alias("d")).select(F.xxhash64("source").alias("doc_id"), "source", "d.*")
        found = self.detector(docs.select("doc_id", "source", "text")).select("doc_id", F.col("data_type").alias("_type"), F.col("domain").alias("_domain"))
        typed = written(docs.join(found, "doc_id"), "typed").withColumns({"data_type": F.coalesce("given_data_type", "_type"), "domain": text.slug(F.coalesce("given_domain", "_domain"))})
        blocks = chunking.blocks_by_type(typed.select("doc_id", "source", "text", "data_type"), self.config.target_tokens, self.config.max_tokens, self.config.symbols, self.chunkers)
        blocks = blocks.join(typed.select("doc_id", "source", "data_type"), "doc_id").withColumn("block_id", F.xxhash64("doc_id", "ord"))
        blocks = written(blocks, "blocks")
        limits = self.config.target_tokens, self.config.max_tokens
        if self.config.symbols:
            chunks = chunking.pack(blocks.where("data_type <> 'CODE'"), *limits, self.config.min_tokens).unionByName(chunking.pack_each(blocks.where("data_type = 'CODE'"), *limits))
        else:
            chunks = chunking.pack(blocks, *limits, self.config.min_tokens)
        rows = chunking.fused(blocks, chunks).where(F.col("text").rlike(r"\S")).join(typed.select("source", "data_type", "domain", "given_timestamp", "given_tags", "mtime"), "source")
        index = F.col("chunk").cast("string")
        key = F.concat(F.lit("L-"), text.slug(F.col("domain"), max_length=24), F.lit("-"), F.lpad(index, 4, "0"), F.lit("-"), text.short_hash(F.concat_ws("|", "source", index, "text"), 10))
        when = F.coalesce("given_timestamp", F.when(F.col("data_type") != "CODE", leading_date(F.col("text"))), "timestamp", utc_text(F.unix_seconds("mtime")), F.lit(now))
        stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]*$", "")
        tags = F.slice(F.array_distinct(F.concat(F.array(F.concat(F.lit("domain:"), "domain"), F.concat(F.lit("type:"), F.lower("data_type"))), F.coalesce("given_tags", empty), "tags")), 1, 16)
        leaves = rows.select(
            key.alias("leaf_id"), when.alias("timestamp"), F.lit(now).alias("ingested_at"), "data_type", "domain", "source", F.col("chunk").cast("int").alias("order_index"), text.truncate(F.concat(stem, F.lit(" · "), "title"), 110).alias("title"), tags.alias("tags"),
            "start_line", "end_line", none.alias("parent_id"), F.lit("ACTIVE").alias("status"), none.alias("superseded_by"), "oversized", text.estimate_tokens(F.col("text")).alias("token_estimate"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("checksum"), "context", F.col("text").alias("content"),
        )
        leaves = written(leaves, "leaves")
        words = terms.keywords(leaves, ["leaf_id"], "content", 14, boost="title").select("leaf_id", F.split("keywords", " ").alias("keywords"))
        named = terms.ordered_distinct(terms.entities(leaves, ["leaf_id"], "content", 10), ["leaf_id"], "entity", ["rank"]).withColumnRenamed("items", "entities")
        full = leaves.join(words, "leaf_id", "left").join(named, "leaf_id", "left").withColumns({"keywords": F.coalesce("keywords", empty), "entities": F.coalesce("entities", empty)})
        return full.select(*[c.split()[0] for c in _LEAF.split(", ")])

    def ingest(self, documents: DataFrame, now: str, replace_previous: bool = True) -> DataFrame:
        """Adds documents and returns one row of totals. Leaves of a source that its new version no longer has become
        historical, unless `replace_previous` is off; an unchanged leaf keeps its parent."""
        new = written(self.build_leaves(documents, now), "new-leaves")
        if self.exists():
            old = self._table("leaves")
            kept = old.select(F.col("leaf_id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("status").alias("_status"), F.col("superseded_by").alias("_by"))
            merged = new.join(kept, F.col("leaf_id") == F.col("_id"), "left").withColumns({"parent_id": F.col("_parent"), **({} if replace_previous else {"status": F.coalesce("_status", "status"), "superseded_by": F.col("_by")})})
            merged = merged.select(*new.columns)
            if replace_previous:
                marked = store.demote_previous(old.select("leaf_id", "source", "status"), new.select("source", "leaf_id")).select("leaf_id", F.col("status").alias("_new"), F.col("superseded_by").alias("_by"))
                rest = old.join(marked, "leaf_id").withColumns({"status": F.col("_new"), "superseded_by": F.coalesce("_by", "superseded_by")})
            else:
                rest = old
            new = rest.join(new.select("leaf_id"), "leaf_id", "left_anti").select(*new.columns).unionByName(merged)
        self._replace("leaves", new)
        mine = self._table("leaves").where(F.col("ingested_at") == now)
        return mine.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"), F.count_if("oversized").alias("oversized"))

    def ingest_text(self, content: str, now: str, source: str | None = None, **given) -> DataFrame:
        """One text, as from a pipe; `given` may have domain, data_type, timestamp."""
        columns = {"source": source, "text": content, **{k: v for k, v in given.items() if k in ("domain", "data_type", "timestamp")}}
        return self.ingest(self.spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)), now, replace_previous=source is not None and given.get("replace_previous", False))

    def ingest_file(self, path: str, now: str) -> DataFrame:
        return self.ingest(files.read_file(self.spark, path), now)

    def ingest_directory(self, folder: str, now: str) -> DataFrame:
        return self.ingest(files.read_documents(self.spark, folder), now)

    # ------------------------------------------------------------ leaves and tree
    def leaves(self, historical: bool = False) -> DataFrame:
        rows = self._table("leaves")
        return rows if historical else rows.where("status = 'ACTIVE'")

    def get_leaf(self, leaf_id: str) -> DataFrame:
        found = self._table("leaves").where(F.col("leaf_id") == leaf_id)
        if found.isEmpty():
            raise NotFound(leaf_id)
        return found

    def leaves_by_source(self, source: str) -> DataFrame:
        return self._table("leaves").where(F.col("source") == source).orderBy("order_index")

    def delete_leaf(self, leaf_id: str) -> None:
        self._replace("leaves", self._table("leaves").where(F.col("leaf_id") != leaf_id))

    def _tree_rows(self) -> DataFrame:
        return self._table("leaves").select(F.col("leaf_id").alias("id"), "domain", "timestamp", F.lit(1).alias("leaf_count"), "title", F.col("content").alias("text"), "keywords", "entities", "tags", "source", "status")

    def consolidate(self, flush: bool = False) -> DataFrame:
        """Builds the nodes anew, stores them, gives leaves their parents, and returns the nodes."""
        nodes = tree.build_tree(self._tree_rows(), self.config.branch_factor, flush, self.summarizer)
        self._replace("nodes", nodes)
        held = self._table("nodes")
        rows = self._table("leaves")
        parents = tree.edges(held).select(F.col("child_id").alias("leaf_id"), F.col("parent_id").alias("_node"))
        self._replace("leaves", rows.drop("parent_id").join(parents, "leaf_id", "left").withColumnRenamed("_node", "parent_id").select(*rows.columns))
        return held

    def nodes(self) -> DataFrame:
        return self._table("nodes") if self._versions("nodes") else self.consolidate(True)

    def get_node(self, node_id: str) -> DataFrame:
        found = self.nodes().where(F.col("id") == node_id)
        if found.isEmpty():
            raise NotFound(node_id)
        return found

    def catalog(self) -> DataFrame:
        """Leaves and nodes as one table (id, kind, layer, domain, title, parent_id, timestamp, leaf_count, status, source)."""
        nodes = self.nodes()
        parents = tree.edges(nodes).select(F.col("child_id").alias("id"), "parent_id")
        none = F.lit(None).cast("string")
        upper = nodes.join(parents, "id", "left").select("id", F.lit("node").alias("kind"), "layer", "domain", "title", "parent_id", "timestamp", "leaf_count", F.lit("ACTIVE").alias("status"), none.alias("source"))
        lower = self._table("leaves").select(F.col("leaf_id").alias("id"), F.lit("leaf").alias("kind"), F.lit(0).alias("layer"), "domain", "title", "parent_id", "timestamp", F.lit(1).cast("bigint").alias("leaf_count"), "status", "source")
        return lower.unionByName(upper)

    def root_summary(self) -> DataFrame:
        return summaries.global_summary(self.nodes().groupBy("domain").agg(F.sum(F.when(F.col("layer") == 1, F.col("leaf_count"))).alias("leaf_count"), F.max_by("keywords", F.struct("layer", "id")).alias("keywords")))

    def outline(self, depth: int = 3) -> DataFrame:
        from tessera.operators.hierarchy import hierarchy

        rows = self.catalog()
        paths = hierarchy(rows.select("id", F.col("parent_id").alias("parent")), paths=True)
        return summaries.outline(rows, paths.select("id", "path"), depth)

    def entries_at(self, layer: int) -> DataFrame:
        return self.catalog().where(F.col("layer") == layer).orderBy("timestamp", "id")

    def pending(self) -> DataFrame:
        """Leaves that wait for a full batch, by domain."""
        waiting = tree.unreached(self._tree_rows(), self.nodes())
        return self._tree_rows().join(waiting, "id", "left_semi").groupBy("domain").agg(F.count("*").alias("pending"))

    # ------------------------------------------------------------ search
    def _index(self) -> search.SearchIndex:
        flat = self._tree_rows().withColumns({c: F.array_join(c, " ") for c in ("keywords", "tags")})
        return search.build_search_index(flat, self.nodes())

    def search(self, question: str, k: int = 5, clue: str | None = None, **filters) -> DataFrame:
        """The best leaves with title, source, content and notices, the newest correction of the best one first."""
        found = search.search(self._index(), question, clue, self.config.beam_width, k, **filters)
        ordered = search.current_first(found.withColumn("item_id", F.lit(1)), facts.successors(self.supersessions()))
        about = self._table("leaves").select(F.col("leaf_id").alias("id"), "title", "source", "content")
        told = self.notices().groupBy(F.col("leaf_id").alias("id")).agg(F.array_sort(F.collect_list("notice")).alias("notices"))
        return ordered.drop("item_id").join(about, "id").join(told, "id", "left").orderBy("rank")

    def ask(self, question: str, provider: Callable, rounds: int = 3, k: int = 5) -> DataFrame:
        return search.search_interactive(self._index(), question, provider, rounds, beam=self.config.beam_width, k=k)

    # ------------------------------------------------------------ facts
    def facts(self) -> DataFrame:
        """Facts that leaves state by the rules, and those recorded by hand."""
        rows = self.leaves(historical=True)
        dated = rows.select(F.col("leaf_id").alias("source_leaf_id"), "timestamp")
        found = facts.extract(rows, self.rules).withColumnRenamed("leaf_id", "source_leaf_id").join(dated, "source_leaf_id")
        return written(found, "stated").unionByName(self._table("facts", "fact_id string, subject string, attribute string, value string, timestamp string, source_leaf_id string"), allowMissingColumns=True)

    def record_fact(self, subject: str, attribute: str, value: str, timestamp: str, source_leaf_id: str | None = None) -> None:
        """A fact by hand; the same one twice counts once."""
        one = self.spark.createDataFrame([(subject, attribute, value, timestamp, source_leaf_id)], "subject string, attribute string, value string, timestamp string, source_leaf_id string")
        one = one.withColumn("value", text.truncate(F.col("value"), 120))
        one = one.withColumn("fact_id", F.concat(F.lit("F-"), text.short_hash(F.concat_ws("|", facts.key_of(), text.normalize(F.col("value")), "timestamp"), 10)))
        old = self._table("facts", "fact_id string, subject string, attribute string, value string, timestamp string, source_leaf_id string")
        self._replace("facts", old.unionByName(one).dropDuplicates(["fact_id"]))

    def timeline(self) -> DataFrame:
        return facts.timeline(self.facts())

    def conflicts(self) -> DataFrame:
        return facts.conflicts(self.facts()).orderBy("key")

    def report(self) -> DataFrame:
        return facts.report(self.facts())

    def supersessions(self) -> DataFrame:
        return self._table("supersessions", "old string, new string")

    def supersede(self, old: str, new: str) -> None:
        """Says that leaf `new` corrects leaf `old`; both must exist."""
        self.get_leaf(old), self.get_leaf(new)
        self._replace("supersessions", facts.supersede(self.supersessions(), old, new))

    def correct(self, leaf_id: str, least: float = 0.5) -> DataFrame:
        """Finds what a leaf corrects, the one whose terms it shares most, and supersedes it; returns (new_id, old_id, held)."""
        rows = self.leaves().select("leaf_id", F.concat_ws(" ", "title", "content").alias("text"))
        found = ranking.held_overlap(rows.where(F.col("leaf_id") == leaf_id).withColumnRenamed("leaf_id", "new_id"), rows.where(F.col("leaf_id") != leaf_id).withColumnRenamed("leaf_id", "old_id"), least)
        for r in found.collect():  # one row at most
            self.supersede(r.old_id, r.new_id)
        return found

    def notices(self) -> DataFrame:
        rows = self._table("leaves")
        stamped = self.spark.createDataFrame([], "leaf_id string, notice string")
        return facts.notices_for_leaves(self.facts(), self.supersessions(), rows.select("leaf_id", "title", "timestamp"), stamped)

    def stats(self) -> DataFrame:
        """Counts by domain and status, and in all, with facts and conflicts."""
        rows = self._table("leaves").groupingSets([["domain", "status"], []], "domain", "status").agg(F.count("*").alias("leaves"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))
        n_facts, n_conflicts = self.facts().count(), self.conflicts().count()
        return rows.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("status", F.lit("*")).alias("status"), "leaves", "tokens", F.when(F.col("domain").isNull(), n_facts).alias("facts"), F.when(F.col("domain").isNull(), n_conflicts).alias("conflicts"))

    def rebuild(self) -> DataFrame:
        """Everything derived anew from the leaves."""
        self.initialize(force=True)
        return self.consolidate(True)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init")
    init.add_argument("--force", action="store_true")
    commands.add_parser("ingest", help="a file, a folder, or - for a text from the pipe").add_argument("path")
    consolidate = commands.add_parser("consolidate")
    consolidate.add_argument("--flush", action="store_true")
    for name in ("search", "ask"):
        asked = commands.add_parser(name)
        asked.add_argument("question")
        asked.add_argument("--clue")
    capture = commands.add_parser("capture", help="transcripts below a folder")
    capture.add_argument("path")
    capture.add_argument("--dialect", default="a", choices=("a", "b"))
    for name in ("tree", "stats", "facts", "conflicts", "rebuild", "demo"):
        commands.add_parser(name)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    memory = Memory(spark, given.store)
    now = spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    show = lambda df: df.show(50, truncate=False)
    if given.command == "init":
        memory.initialize(given.force)
    elif given.command == "ingest":
        if given.path == "-":
            show(memory.ingest_text(sys.stdin.read(), now))
        else:
            there, path = file_system(spark, given.path)
            show((memory.ingest_file if there.getFileStatus(path).isFile() else memory.ingest_directory)(given.path, now))
    elif given.command == "consolidate":
        show(memory.consolidate(given.flush).groupBy("layer").count())
    elif given.command == "search":
        show(memory.search(given.question, clue=given.clue).drop("content"))
    elif given.command == "ask":
        show(memory.ask(given.question, lambda question, rows: given.clue))
    elif given.command == "capture":
        from tessera.streaming.capture import capture_stream

        capture_stream(spark, given.path, f"{memory.root}/turns", f"{memory.root}/turns-seen", given.dialect)
        show(spark.read.parquet(f"{memory.root}/turns").groupBy("session_id").count())
    elif given.command == "tree":
        show(memory.outline())
    elif given.command == "rebuild":
        show(memory.rebuild().groupBy("layer").count())
    elif given.command == "demo":
        demo(memory, now, show)
    else:
        show(getattr(memory, given.command)())


def demo(memory: Memory, now: str, show: Callable) -> None:
    """Notes in, tree, search, a conflict of facts and the state before it."""
    notes = [("notes/a.md", "2024-03-01: I live in Oslo, near the port.\n"), ("notes/b.md", "2025-05-01: I live in Bergen now.\n"), ("notes/c.md", "# Bread\n\n1. Mix the flour.\n2. Bake it.\n")]
    show(memory.ingest(memory.spark.createDataFrame(notes, "source string, text string"), now))
    show(memory.consolidate(True).select("id", "title", "leaf_count"))
    show(memory.search("where do I live").drop("content"))
    show(memory.conflicts())
    show(facts.state_at(memory.facts(), 1735689599))


if __name__ == "__main__":
    main()
