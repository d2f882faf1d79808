"""Extractive summaries and outlines of the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.terms import STOP_CODE, entities, ordered_distinct, term_rows
from tessera.functions.text import trimmed, truncate

#: Where a sentence ends: behind its mark, before a capital or digit.
SENTENCE = r"(?<=[.!?;:])\s+(?=[\"'¿¡(\[]?[A-ZÀ-Ü0-9])"


def summarize(documents: DataFrame, sentences: int = 3, chars: int = 600, key: str = "doc_id") -> DataFrame:
    """(key, summary): the sentences whose terms are the most frequent in their text, in their order, cut to `chars`.

    A sentence scores the sum of its terms' frequencies over the root of their number, the first one 1.15 times; ties
    by position. Texts of few sentences stay whole; blank ones give an empty summary."""
    rows = documents.where(F.col("text").isNotNull()).select(key, F.posexplode(F.split(trimmed(F.col("text")), SENTENCE)).alias("pos", "text"))
    rows = rows.withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    counts = term_rows(rows, [key, "pos"]).groupBy(key, "pos", "term").agg(F.count("*").alias("n"))
    freq = counts.groupBy(key, "term").agg(F.sum("n").alias("f"))
    scored = counts.join(freq, [key, "term"]).groupBy(key, "pos").agg((F.sum(F.col("n") * F.col("f")) / F.sqrt(F.sum("n"))).alias("score"))
    weight = F.when(F.col("pos") == 0, 1.15).otherwise(1.0)
    many = rows.groupBy(key).agg(F.count("*").alias("of"))
    ranked = rows.join(scored, [key, "pos"], "left").join(many, key).withColumn("score", F.col("score") * weight)
    by = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "pos")
    kept = ranked.withColumn("r", F.row_number().over(by)).where((F.col("of") <= sentences) | (F.col("r") <= sentences) & F.col("score").isNotNull())
    text = F.left(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " "), F.lit(chars))
    made = kept.groupBy(key).agg(text.alias("summary"))
    return documents.where(F.col("text").isNotNull()).select(key).distinct().join(made, key, "left").select(key, F.coalesce("summary", F.lit("")).alias("summary"))


def outline(tree: DataFrame, paths: DataFrame, depth: int = 3) -> DataFrame:
    """Lines (path, line) of the upper levels in order: entries (id, title, leaf_count) with paths (id, path array)."""
    rows = tree.select("id", "title", "leaf_count").join(paths.where("path is not null").select("id", "path"), "id").where(F.size("path") <= depth)
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.col("title"), F.lit(" ("), F.col("leaf_count").cast("string"), F.lit(")"))
    return rows.select(F.array_join("path", "/").alias("path"), line.alias("line"))


#: How many keywords, entities and tags a node has, and how many of its children's titles its summary names.
KEYWORDS, ENTITIES, TAGS, TOPICS = 14, 12, 12, 6


def summarize_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """nodes (id, layer, domain, children) with title, summary, keywords, entities and tags made from their children.

    refs (id, title, text, keywords, entities, tags, timestamp; arrays of string in the middle). Keywords and entities are
    those of the children in order, then the most frequent ones of their texts, titles counting twice more; each once.
    A node whose children have no text gets an empty body. The children of a node are as many as the branch factor."""
    child = nodes.select(F.col("id").alias("parent"), "domain", F.posexplode("children").alias("pos", "id")).join(refs, "id").withColumnRenamed("domain", "_domain")
    said = child.select("parent", "pos", "_domain", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "keywords", "entities", "tags", "timestamp")
    corpus = said.select("parent", "_domain", F.concat("title", F.lit(". "), "text").alias("text"), "title")
    counts = term_rows(corpus, ["parent", "_domain"]).withColumn("n", F.lit(1)).unionByName(term_rows(corpus, ["parent", "_domain"], "title").withColumn("n", F.lit(2)))
    counts = counts.where(~(F.col("_domain").startswith("software") & F.col("term").isin(*STOP_CODE.split()))).groupBy("parent", "term").agg(F.sum("n").alias("n"))
    top = counts.withColumn("p", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "term"))).where("p <= 18").select("parent", F.lit(1).alias("a"), F.lit(0).alias("pos"), "p", F.col("term").alias("item"))
    carried = lambda c: said.select("parent", F.lit(0).alias("a"), "pos", F.posexplode(c).alias("p", "item"))
    found = entities(corpus, ["parent"], "text", 14).select("parent", F.lit(1).alias("a"), F.lit(0).alias("pos"), F.col("rank").alias("p"), F.col("entity").alias("item"))
    order = ["a", "pos", "p"]
    keywords = ordered_distinct(carried("keywords").unionByName(top), ["parent"], "item", order, KEYWORDS).withColumnRenamed("items", "keywords")
    persons = ordered_distinct(carried("entities").unionByName(found), ["parent"], "item", order, ENTITIES).withColumnRenamed("items", "entities")
    tags = ordered_distinct(carried("tags"), ["parent"], "item", order, TAGS).withColumnRenamed("items", "tags")
    topics = ordered_distinct(said, ["parent"], "title", ["pos"], TOPICS).select("parent", F.array_join("items", ", ").alias("topics"))
    day = F.left("timestamp", F.lit(10))
    told = said.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", F.concat("title", F.lit(": "), truncate(F.col("text"), 300)).alias("t"))))["t"], " ").alias("text"), F.min(F.nullif(day, F.lit(""))).alias("since"), F.max(F.nullif(day, F.lit(""))).alias("until"), F.count("*").alias("n"))
    body = summarize(told.select("parent", "text"), 4, 700, "parent").select("parent", F.col("summary").alias("body"))
    rows = nodes.join(told.select(F.col("parent").alias("id"), "since", "until", "n"), "id", "left")
    for part in (keywords, persons, tags, topics, body):
        rows = rows.join(part.withColumnRenamed("parent", "id"), "id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("keywords", "entities", "tags")})
    period = F.when(F.col("since") == F.col("until"), F.col("since")).otherwise(F.concat("since", F.lit(".."), "until"))
    focus = F.coalesce(F.nullif(F.array_join(F.slice("entities", 1, 2), ", "), F.lit("")), F.nullif(F.array_join(F.slice("keywords", 1, 3), ", "), F.lit("")), F.lit("misc"))
    layer = F.col("layer").cast("string")
    title = truncate(F.concat(F.lit("L"), layer, F.lit(" "), F.coalesce("domain", F.lit("?")), F.lit(" · "), focus, F.coalesce(F.concat(F.lit(" ["), period, F.lit("]")), F.lit(""))), 90)
    head = F.concat(F.lit("["), F.coalesce("domain", F.lit("?")), F.lit(" · layer "), layer, F.lit(" · "), F.coalesce(F.col("n").cast("string"), F.lit("0")), F.lit(" children"), F.coalesce(F.concat(F.lit(" · "), period), F.lit("")), F.lit("] "))
    summary = truncate(F.concat(head, F.lit("Covers: "), F.coalesce("topics", F.lit("")), F.lit(". "), F.coalesce("body", F.lit(""))), 900)
    return rows.withColumns({"title": title, "summary": summary}).drop("since", "until", "n", "topics", "body")


def global_summary(roots: DataFrame, topics: int = 24) -> DataFrame:
    """One row (topics, domains, leaves): of the trunk's domains (domain, leaf_count, keywords array) each name with five
    keywords, each once."""
    rows = roots.select("domain", F.posexplode(F.concat(F.array("domain"), F.slice("keywords", 1, 5))).alias("p", "item")).withColumn("all", F.lit(1))
    named = ordered_distinct(rows, ["all"], "item", ["domain", "p"], topics)
    counts = roots.agg(F.count("*").alias("domains"), F.coalesce(F.sum("leaf_count"), F.lit(0)).alias("leaves"))
    both = counts.withColumn("all", F.lit(1)).join(named, "all", "left")
    return both.select(F.coalesce("items", F.array().cast("array<string>")).alias("topics"), "domains", "leaves")
