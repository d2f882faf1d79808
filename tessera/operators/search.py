"""Beam descent over the tree of summaries.

A search index has, for leaves and nodes alike, rows (entry, term): of a leaf the weighted terms of its fields, of a node
the terms of all leaves below it, with their counts and the greatest contribution that any of these leaves can make to a
score. No row grows with the tree. The driver loops over levels; of a level it holds the frontier, which the beam and the
branch factor bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.terms import term_counts, term_rows
from tessera.operators.ranking import B, K1, idf, top_k
from tessera.operators.store import admissible, looks_like_code, looks_like_test
from tessera.session import small, written

#: Weights of a leaf's fields, by repetition of their terms.
WEIGHTS = {"title": 3, "keywords": 3, "tags": 2, "text": 1}
_ROW = ["id", "term", "tf", "len", "impact"]


@dataclass(frozen=True)
class SearchIndex:
    """postings (id, term, tf, len, impact) and freq (term, df) of leaves; edges (parent, id); entries (id, leaf, len, domain, ...)."""

    postings: DataFrame
    freq: DataFrame
    edges: DataFrame
    entries: DataFrame
    n_leaves: int
    depth: int


def _weighted_counts(leaves: DataFrame) -> DataFrame:
    rows = None
    for name, weight in WEIGHTS.items():
        if name not in leaves.columns:
            continue
        text = F.replace(F.col(name), F.lit(":"), F.lit(" ")) if name == "tags" else F.col(name)
        one = term_counts(leaves.select("id", text.alias("text")), ["id"]).withColumn("tf", F.col("tf") * weight)
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def build_search_index(leaves: DataFrame, tree: DataFrame) -> SearchIndex:
    """The index over leaves (id, text, and where there are domain, title, keywords and tags as text, source, status,
    timestamp) and tree (id, layer, children[, domain]). Nodes are filled layer by layer, one job each, from their children."""
    tf = written(_weighted_counts(leaves), "leaf-terms")
    size = tf.groupBy("id").agg(F.sum("tf").alias("len"))
    n = leaves.count()
    mean = max(1.0, (tf.agg(F.sum("tf")).first()[0] or 0) / max(1, n))
    freq = written(tf.groupBy("term").agg(F.count("*").alias("df")), "leaf-freq")
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    level = written(tf.join(size, "id").withColumn("impact", impact).select(*_ROW), "leaf-postings")
    all_rows, below, sizes = level, level, size
    edges = written(tree.select(F.col("id").alias("parent"), "layer", F.explode("children").alias("id")), "edges")
    depth = edges.agg(F.max("layer")).first()[0] or 0
    for layer in range(1, depth + 1):
        joined = below.join(edges.where(F.col("layer") == layer).select("parent", "id"), "id")
        terms = joined.groupBy("parent", "term").agg(F.sum("tf").alias("tf"), F.max("impact").alias("impact"))
        lengths = terms.groupBy("parent").agg(F.sum("tf").alias("len"))
        sizes = sizes.unionByName(lengths.withColumnRenamed("parent", "id"))
        nodes = written(terms.join(lengths, "parent").select(F.col("parent").alias("id"), "term", "tf", "len", "impact"), "node-postings")
        all_rows = all_rows.unionByName(nodes)
        below = below.unionByName(nodes)
    fields = [c for c in ("domain", "source", "status", "timestamp", "title") if c in leaves.columns]
    known = leaves.select("id", F.lit(True).alias("leaf"), *[F.col(c).cast("string").alias(c) for c in fields])
    nodes = tree.select("id", F.lit(False).alias("leaf"), *[F.col(c).cast("string").alias(c) for c in ("domain",) if c in fields and c in tree.columns])
    entries = known.unionByName(nodes, allowMissingColumns=True).join(sizes, "id", "left").fillna({"len": 0})
    return SearchIndex(written(all_rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "search"), freq, edges.select("parent", "id"), written(entries, "entries"), n, depth)


def select_domains(index: SearchIndex, terms: list[str], beam: int) -> list[str] | None:
    """The best max(beam, 2) domains for the terms among those that match at all; None, for all, where none does."""
    hits = index.postings.where(F.col("term").isin(terms)).join(index.entries.where("leaf and domain is not null").select("id", "domain"), "id")
    best = hits.groupBy("domain", "term").agg(F.max("impact").alias("impact")).join(index.freq, "term")
    named = index.entries.where("domain is not null").select("domain").distinct().select("domain", F.lower(F.replace("domain", F.lit("."), F.lit(" "))).alias("text"))
    name_hits = term_rows(named, ["domain"]).where(F.col("term").isin(terms)).groupBy("domain").agg(F.count("*").alias("named"))
    scored = best.groupBy("domain").agg(F.sum(idf(F.lit(index.n_leaves), F.col("df")) * F.col("impact")).alias("score")).join(name_hits, "domain", "full")
    ranked = scored.select("domain", (F.coalesce("score", F.lit(0.0)) + F.coalesce("named", F.lit(0))).alias("score")).where("score > 0").orderBy(F.desc("score"), "domain")
    return [r.domain for r in ranked.limit(max(beam, 2)).collect()] or None


def code_factor(source, title, terms: list[str], scope: str):
    """The weight of a leaf of source code: the share of the query that its file's name explains, less for tests that the
    query does not ask for and for runs of imports. Other leaves keep their score."""
    stem = F.regexp_replace(F.element_at(F.split(F.regexp_replace(source, r"\\", "/"), "/"), -1), r"\.[^.]*$", "")
    pieces = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(stem, F.lit("[A-Z]?[a-z0-9]+|[A-Z]{2,}(?![a-z])"), F.lit(0)), F.lower), lambda x: F.char_length(x) >= 2))
    known = F.array_distinct(F.concat(pieces, F.array(F.lower(stem))))
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    factor = 1 + 0.8 * F.size(F.array_intersect(known, asked)) / F.greatest(F.size(known), F.lit(len(terms)), F.lit(1))
    if scope == "all" and not {"test", "tests"} & set(terms):
        factor = factor * F.when(looks_like_test(source), 0.6).otherwise(1.0)
    factor = factor * F.when(F.coalesce(title, F.lit("")).rlike(r"· imports( →|$)"), 0.3).otherwise(1.0)
    return F.when(looks_like_code(source), factor).otherwise(1.0)


def search(
    index: SearchIndex, query: str, clue: str | None = None, beam: int = 3, k: int = 10, scope: str = "all", prefix: str | None = None, since: str | None = None, historical: bool = False, by_domain: bool = True, siblings: bool = True
) -> DataFrame:
    """The k best leaves (id, score, coverage, level, rank) for a query, found by descending the best `beam` nodes of a level.

    Domains are chosen first, then nodes by the greatest score that a leaf below them can have, so that a leaf is passed
    over only for others that may score more. Leaves score by BM25 among the `siblings` of their level, weighed by their
    coverage, or among all leaves. With a clue its terms are a second group: scores add up, times 1.6 where both match,
    0.7 where one does. Filters hold before leaves are kept; leaves scoring 0 never return; nodes scoring 0 are opened
    while the beam has room. An empty query gives no row."""
    spark = index.postings.sparkSession
    given = spark.createDataFrame([(1, query or ""), (2, clue or "")], "group_no int, text string")
    asked = {(r.group_no, r.term) for r in term_rows(given, ["group_no"]).distinct().collect()}  # the terms of one query
    terms = sorted({t for _, t in asked})
    pool = spark.createDataFrame([], "id string, score double, coverage double, level int")
    if not terms:
        return pool.withColumn("rank", F.lit(None).cast("bigint"))
    groups = spark.createDataFrame(sorted(asked), "group_no int, term string")
    two = len({g for g, _ in asked}) > 1
    chosen = select_domains(index, terms, beam) if by_domain and "domain" in index.entries.columns else None
    mine = written(index.postings.where(F.col("term").isin(terms)).join(small(index.freq.where(F.col("term").isin(terms))), "term"), "mine")
    frontier = index.entries.join(index.edges.select("id").distinct(), "id", "left_anti")
    if chosen is not None:
        frontier = frontier.where(F.col("domain").isin(chosen))
    columns = index.entries.columns
    allowed = {c: F.col(c) if c in columns else F.lit(None).cast("string") for c in ("status", "timestamp", "source", "title")}
    for level in range(index.depth + 1):
        frontier = written(frontier.select("id", "leaf", "len", *[c.alias(n) for n, c in allowed.items()]), "frontier")
        local = mine.join(small(frontier.select("id")), "id", "left_semi")
        if siblings:
            total, chars = frontier.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            mean = max(1.0, chars / max(1, total))
            among = local.groupBy("term").agg(F.count("*").alias("_among"))
            local = local.join(F.broadcast(among), "term")  # a row for each term of the query
            gain = idf(F.lit(total), F.col("_among")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        else:
            gain = idf(F.lit(index.n_leaves), F.col("df")) * F.col("impact")
        bound = idf(F.lit(index.n_leaves), F.col("df")) * F.col("impact")
        by_group = local.join(F.broadcast(groups), "term").groupBy("id", "group_no").agg(F.sum(gain).alias("gain"), F.sum(bound).alias("bound"))
        held = local.groupBy("id").agg((F.count_distinct("term") / len(terms)).alias("coverage"))
        factor = F.when(F.count("*") > 1, 1.6).otherwise(0.7) if two else F.lit(1.0)
        scored = by_group.groupBy("id").agg((F.sum("gain") * factor).alias("score"), F.sum("bound").alias("bound")).join(held, "id")
        ranked = written(frontier.join(scored, "id", "left").fillna({"score": 0.0, "bound": 0.0, "coverage": 0.0}), "level")
        fit = admissible(ranked.where("leaf and score > 0"), scope, prefix, since, historical)
        fit = fit.withColumn("score", F.round(F.col("score") * code_factor(F.col("source"), F.col("title"), terms, scope), 6))
        best = fit.orderBy(F.desc("score"), "id").limit(max(beam, k))
        pool = pool.unionByName(best.select("id", "score", F.round("coverage", 6).alias("coverage"), F.lit(level).alias("level")))
        nodes = [r.id for r in ranked.where("not leaf").orderBy(F.desc("bound"), "id").limit(beam).collect()]
        if not nodes:
            break
        frontier = index.entries.join(F.broadcast(index.edges.where(F.col("parent").isin(nodes)).select("id").distinct()), "id")
    final = pool.groupBy("id").agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.min("level").alias("level"))
    if siblings:
        final = final.withColumn("score", F.round(F.col("score") * (0.05 + F.col("coverage") * F.col("coverage")), 6))
    return top_k(final.withColumn("item_id", F.lit(1)), k, "item_id", "id").drop("item_id")


def beam_search(leaves: DataFrame, tree: DataFrame, query: str, beam: int = 3, k: int = 10) -> DataFrame:
    """`search` over an index built for one query, without choice of domains."""
    return search(build_search_index(leaves, tree), query, beam=beam, k=k, by_domain=False)


def current_first(ranked: DataFrame, successors: DataFrame, query: str = "item_id", doc: str = "id") -> DataFrame:
    """(query, doc, score, coverage, rank, replaces) of ranked rows (query, doc, score, coverage, rank): while the best row has a
    successor (old, current), that goes in front, with the greater score and coverage of the two; the others keep their order.

    `successors` comes from facts.successors, which follows each chain to its end."""
    best = ranked.where("rank = 1").join(successors.select(F.col("id").alias("_old"), F.col("current").alias("_new")), F.col(doc) == F.col("_old")).select(F.col(query).alias("_q"), "_old", "_new", F.col("score").alias("_score"), F.col("coverage").alias("_cov"))
    rest = ranked.join(best.select(F.col("_q").alias(query), F.col("_new").alias(doc), F.lit(True).alias("_moved")), [query, doc], "left")
    there = rest.where("_moved").select(F.col(query).alias("_q"), F.col("score").alias("_s"), F.col("coverage").alias("_c"))
    front = best.join(there, "_q", "left").select(F.col("_q").alias(query), F.col("_new").alias(doc), F.greatest("_score", F.coalesce("_s", "_score")).alias("score"), F.greatest("_cov", F.coalesce("_c", "_cov")).alias("coverage"), F.lit(0).cast("bigint").alias("rank"), F.col("_old").alias("replaces"))
    kept = rest.where("_moved is null").select(query, doc, "score", "coverage", F.col("rank").cast("bigint").alias("rank"), F.lit(None).cast("string").alias("replaces"))
    both = front.unionByName(kept)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")).cast("bigint"))


def search_interactive(index: SearchIndex, query: str, ask, rounds: int = 3, **options) -> DataFrame:
    """`search`, asking for a clue while the answer is unsure: `ask` gets the query and the rows found and returns a clue,
    or None to decline; it ends with a sure answer, a declined or repeated clue, or after `rounds`."""
    clue, seen = None, set()
    found = search(index, query, **options)
    for _ in range(rounds):
        rows = found.orderBy("rank").limit(4).collect()  # what the asked one chooses from
        sure = not rows or 0.6 * rows[0].coverage + 0.4 * ((rows[0].score - rows[1].score) / rows[0].score if len(rows) > 1 and rows[0].score else 1.0) >= 0.45
        if sure or (clue := ask(query, rows)) is None or clue in seen:
            break
        seen.add(clue)
        found = search(index, query, clue, **options)
    return found
