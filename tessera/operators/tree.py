"""The bottom-up tree of summaries: batches, nodes, roll-ups, trunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import short_hash, slug, trimmed
from tessera.operators.ranking import rank_in_groups
from tessera.session import written

BRANCH = 8


def latest_entries(entries: DataFrame) -> DataFrame:
    """One row for each id of a catalog: the latest timestamp, ties by the larger of the other columns."""
    keep = [c for c in entries.columns if c not in ("id", "timestamp")]
    rows = entries.withColumn("id", trimmed(F.col("id"))).where("id <> ''")
    return rows.groupBy("id").agg(F.max(F.struct("timestamp", *keep)).alias("r")).select("id", "r.*")


def batches(entries: DataFrame, branch: int = BRANCH, flush: bool = False) -> DataFrame:
    """Adds `batch` to entries (id, domain, timestamp, ...), in groups of `branch` by (timestamp, id) in each domain.

    Only full batches stay, or with `flush` also a rest of two or more. A null timestamp sorts first."""
    ranked = rank_in_groups(entries.withColumn("timestamp", F.coalesce("timestamp", F.lit(""))), ["domain"], ["timestamp", "id"])
    grouped = ranked.withColumn("batch", F.floor(F.col("rank") / branch))
    sizes = grouped.groupBy("domain", "batch").agg(F.count("*").alias("n")).where(F.col("n") >= (2 if flush else branch))
    return grouped.join(sizes.select(F.col("domain").alias("_d"), F.col("batch").alias("_b")), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("batch") == F.col("_b"))).drop("_d", "_b")


def build_layer(entries: DataFrame, layer: int, branch: int = BRANCH, flush: bool = False) -> DataFrame:
    """Nodes (id, layer, domain, timestamp, ts_start, leaf_count, children) over entries (id, domain, timestamp, ts_start, leaf_count)."""
    grouped = batches(entries, branch, flush)
    node = grouped.groupBy("domain", "batch").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"),
        F.max(F.nullif("timestamp", F.lit(""))).alias("timestamp"),
        F.min(F.nullif("ts_start", F.lit(""))).alias("ts_start"),
        F.sum("leaf_count").alias("leaf_count"),
    )
    children = F.col("c")["id"]
    name = F.concat(F.lit(f"N{layer}-"), slug(F.col("domain"), max_length=24), F.lit("-"), short_hash(F.array_join(children, "|"), 10))
    return node.select(name.alias("id"), F.lit(layer).alias("layer"), "domain", "timestamp", "ts_start", "leaf_count", children.alias("children"))


def build_tree(leaves: DataFrame, branch: int = BRANCH, flush: bool = False, summarizer=None) -> DataFrame:
    """All nodes over leaves (id, domain, timestamp, leaf_count): layer upon layer, one job each, until none can be built.

    Each layer has at most half of the nodes below it, so the layers are few. A `summarizer` gets the nodes of a layer and
    the rows of their children (id, title, text, keywords, entities, tags, timestamp) and returns the nodes with more
    columns, title, summary, keywords, entities and tags among them, as `summaries.summarize_nodes` does; the leaves must
    then have these columns."""
    fields = ["id", "title", "text", "keywords", "entities", "tags", "timestamp"]
    level = leaves.select("id", "domain", "timestamp", F.col("timestamp").alias("ts_start"), F.col("leaf_count").cast("bigint").alias("leaf_count"))
    refs = leaves.select(*fields) if summarizer else None
    tree, layer = None, 1
    while True:
        nodes = build_layer(level, layer, branch, flush)
        nodes = written(summarizer(nodes, refs) if summarizer else nodes, f"layer{layer}")
        if tree is not None and nodes.isEmpty():
            return tree
        tree = nodes if tree is None else tree.unionByName(nodes)
        level = nodes.select("id", "domain", "timestamp", "ts_start", "leaf_count")
        if summarizer:
            refs = nodes.select("id", "title", F.col("summary").alias("text"), F.slice("keywords", 1, 10).alias("keywords"), F.slice("entities", 1, 8).alias("entities"), F.slice("tags", 1, 8).alias("tags"), "timestamp")
        layer += 1


def leaves_below(tree: DataFrame) -> DataFrame:
    """(id, leaf) for each node and each leaf below it, layer by layer from the lowest; a leaf's own row is not among them."""
    top = tree.agg(F.max("layer")).first()[0] or 0
    out = None
    for layer in range(1, top + 1):
        step = tree.where(F.col("layer") == layer).select("id", F.explode("children").alias("child"))
        reached = step.select("id", F.col("child").alias("leaf")) if out is None else step.join(out.select(F.col("id").alias("child"), "leaf"), "child", "left").select("id", F.coalesce("leaf", "child").alias("leaf"))
        reached = written(reached, "reached")
        out = reached if out is None else out.unionByName(reached)
    return out if out is not None else tree.select("id", F.lit(None).cast("string").alias("leaf")).limit(0)


def unreachable(leaves: DataFrame, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves (id) that are neither a root nor below one: none, in a sound tree; roots (id) are all entries without a parent."""
    reached = leaves_below(tree).join(roots.select("id"), "id", "left_semi").select(F.col("leaf").alias("id"))
    return leaves.select("id").join(reached.unionByName(roots.select("id")).distinct(), "id", "left_anti")


def trunk(entries: DataFrame) -> DataFrame:
    """(domain, top_nodes, leaf_count, first, last) of the entries (id, domain, parent_id, timestamp, leaf_count) without a
    parent that exists. None is left out."""
    parents = entries.select(F.col("id").alias("_p"))
    top = entries.withColumn("_up", F.nullif(trimmed(F.col("parent_id")), F.lit(""))).join(parents, F.col("_up") == F.col("_p"), "left_anti")
    return top.groupBy("domain").agg(F.count("*").alias("top_nodes"), F.sum("leaf_count").alias("leaf_count"), F.min(F.nullif("timestamp", F.lit(""))).alias("first"), F.max(F.nullif("timestamp", F.lit(""))).alias("last"))


def set_parents(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """entries (id, parent_id, ...) with the node of `tree` that holds each as its parent; the others keep theirs."""
    held = edges(tree).select(F.col("child_id").alias("id"), F.col("parent_id").alias("_node"))
    rows = entries.join(held, "id", "left")
    return rows.select(*[F.coalesce("_node", "parent_id").alias("parent_id") if c == "parent_id" else c for c in entries.columns])


def detached(leaves: DataFrame) -> DataFrame:
    """Leaves as they are before any tree: without a parent. What is derived from them is built anew."""
    return leaves.withColumn("parent_id", F.lit(None).cast("string"))


def edges(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("id").alias("parent_id"), F.posexplode("children").alias("ord", "child_id"))


def unreached(leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """Leaves that no node holds, those still waiting for a full batch."""
    return leaves.select("id").join(edges(tree).select(F.col("child_id").alias("id")), "id", "left_anti")


def statistics(entries: DataFrame) -> DataFrame:
    """Counts of the catalog by domain, by layer and in all."""
    rows = entries.groupingSets([["domain"], ["layer"], []], "domain", "layer")
    return rows.agg(F.count("*").alias("entries"), F.sum("leaf_count").alias("leaves"), F.count_if(F.col("status") == "HISTORICAL").alias("historical"), F.min(F.nullif("timestamp", F.lit(""))).alias("first"), F.max(F.nullif("timestamp", F.lit(""))).alias("last"))
