"""Rank retrieval: BM25, coverage, confidence; and ranks within groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.terms import term_rows
from tessera.operators.index import Index, build_index
from tessera.session import small, written

K1, B = 1.5, 0.75


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds a 0-based rank in each group. Range partitions cut large groups; their sizes give each cut its offset."""
    cut = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, same).withColumn(out, (F.col("_base") + F.col("_row")).cast("bigint")).drop("_part", "_row", "_p", "_base", *[f"_k{i}" for i in range(len(keys))])


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


#: Distinct query terms up to which they are pushed into the scan of the index as literals.
PUSHED_TERMS = 1000


def asked_terms(queries: DataFrame, query: str = "item_id") -> DataFrame:
    """(query, term, n_terms) of rows (query, text), each term once, written."""
    asked = written(term_rows(queries, [query]).distinct(), "asked")
    sizes = asked.groupBy(query).agg(F.count("*").alias("n_terms"))
    return written(asked.join(sizes, query), "asked")


def saturated(n_docs: Column | int, avg_len: Column | float) -> Column:
    """The contribution of one term to a document, from columns tf, len and df."""
    n, mean = (F.lit(x) if not isinstance(x, Column) else x for x in (n_docs, avg_len))
    return idf(n, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))


def bm25(docs: DataFrame | Index, queries: DataFrame, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score, coverage) of every document that shares a term with a query (query, text).

    The terms of a query count once; coverage is the share of them that the document holds. A document's length
    counts repeated terms. Only the postings of queried terms are read; those of few terms are found by the scan."""
    index = docs if isinstance(docs, Index) else build_index(docs, doc)
    asked = asked_terms(queries, query)
    few = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    hit = index.postings.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else index.postings
    part = saturated(index.n_docs, index.avg_len)
    scored = hit.join(small(asked), "term").groupBy(query, index.doc).agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"))
    return scored.select(query, F.col(index.doc).alias(doc), F.round("score", 6).alias("score"), F.round(F.col("matched") / F.col("n_terms"), 6).alias("coverage"))


def rescaled(scored: DataFrame) -> DataFrame:
    """Scores of different levels made comparable: a low coverage of the query weighs a score down."""
    return scored.withColumn("score", F.round(F.col("score") * (0.05 + F.col("coverage") * F.col("coverage")), 6))


def top_k(scored: DataFrame, k: int, query: str = "item_id", doc: str = "doc_id") -> DataFrame:
    by = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= k)


def confidence(scored: DataFrame, margin: float = 0.18, query: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """(query, best_score, confidence, near_ties, weak): how sure the best answer of each query is.

    confidence = 0.6 coverage + 0.4 margin over the runner-up; near ties lie within `margin` of the best; a best
    coverage under 0.3 is weak. Only the two best of each query leave their task; ties are counted against the best."""
    scored = written(scored, "scored")
    by = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))
    two = scored.withColumn("rn", F.row_number().over(by)).where("rn <= 2")
    first = F.max(F.when(F.col("rn") == 1, F.struct("score", "coverage")))
    best = two.groupBy(query).agg(first.alias("a"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("next"))
    gap = F.when(F.col("next").isNull(), 1.0).otherwise((F.col("a.score") - F.col("next")) / F.nullif(F.col("a.score"), F.lit(0.0)))
    best = written(best.select(query, F.col("a.score").alias("best_score"), F.round(F.least(F.lit(1.0), 0.6 * F.col("a.coverage") + 0.4 * gap), 4).alias("confidence"), (F.col("a.coverage") < 0.3).alias("weak")), "best")
    ties = scored.join(small(best.select(query, "best_score")), query).where(F.col("score") >= F.col("best_score") * (1 - margin)).groupBy(query).agg(F.count("*").alias("near_ties"))
    return best.join(ties, query)


def weighted_text(df: DataFrame, fields: dict[str, int]) -> Column:
    """Fields joined into one text, each repeated by its weight, as a ranking by weighted fields reads them.

    A repeated field lengthens the document as well; null fields are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.repeat(F.concat(F.col(c), F.lit(" ")), F.lit(n))) for c, n in fields.items()]
    return F.concat_ws(" ", *parts)


def two_groups(docs: DataFrame | Index, first: DataFrame, second: DataFrame, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score, coverage): a query with a clue as second group of terms. The groups' scores add up; a document
    that matches both groups counts 1.6 times, one that matches a single group 0.7 times. A query without clue keeps its
    score. Coverage is over the distinct terms of both groups. One index serves both."""
    index = docs if isinstance(docs, Index) else build_index(docs, doc)
    a = bm25(index, first, doc, query).select(query, doc, F.col("score").alias("a"))
    b = bm25(index, second, doc, query).select(query, doc, F.col("score").alias("b"))
    whole = bm25(index, first.select(query, "text").unionByName(second.select(query, "text")), doc, query).select(query, doc, "coverage")
    clued = term_rows(second, [query]).select(query).distinct().withColumn("_clue", F.lit(True))
    both = a.join(b, [query, doc], "full").join(whole, [query, doc]).join(clued, query, "left")
    total = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    factor = F.when(F.col("_clue").isNull(), 1.0).when((F.col("a") > 0) & (F.col("b") > 0), 1.6).otherwise(0.7)
    return both.select(query, doc, F.round(total * factor, 6).alias("score"), "coverage")


def best_formulation(outcomes: DataFrame) -> DataFrame:
    """Of several phrasings (question, pos, outcome, confidence) of a question the best: by outcome, then confidence, then position."""
    by = Window.partitionBy("question").orderBy(F.desc("outcome"), F.desc("confidence"), "pos")
    return outcomes.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def held_overlap(new: DataFrame, old: DataFrame, least: float = 0.5, key: str = "new_id", other: str = "old_id") -> DataFrame:
    """(new_id, old_id, held): what a correction (new_id, text) corrects: the one of old (old_id, text) that shares the
    largest part of its terms, at least `least` of them; a tie between two is no answer.

    A text that holds that much of a correction's n terms lacks too few of them to lack all of its n - ceil(least n) + 1
    rarest: candidates meet on these alone, and the rest of their terms is looked up for candidates only."""
    b = written(term_rows(old, [other]).distinct(), "held")
    a = written(term_rows(new, [key]).distinct(), "asked")
    sizes = a.groupBy(key).agg(F.count("*").alias("n"))
    freq = b.join(small(a.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = a.join(freq, "term", "left").join(sizes, key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "term")))
    rare = rare.where(F.col("_r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select(key, "term")
    met = written(rare.join(b, "term").select(key, other).distinct(), "met")
    common = met.join(a, key).join(b, [other, "term"]).groupBy(key, other).agg(F.count("*").alias("m")).join(sizes, key)
    rows = common.withColumn("held", F.round(F.col("m") / F.col("n"), 6)).where(F.col("held") >= least)
    by = Window.partitionBy(key).orderBy(F.desc("held"), other)
    ranked = rows.withColumns({"_r": F.row_number().over(by), "_next": F.lead("held").over(by)})
    return ranked.where("_r = 1 and (_next is null or _next < held)").select(key, other, "held")


def near_ties(scored: DataFrame, branches: DataFrame, margin: float = 0.18, query: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """(query, ties, n_branches): the documents within `margin` of each query's best, it included, and the distinct
    branches (doc, branch) they lie in; a document without a branch lies in none."""
    scored = written(scored, "scored")
    best = written(scored.groupBy(query).agg(F.max("score").alias("_best")), "best")
    tied = scored.join(small(best), query).where(F.col("score") >= F.col("_best") * (1 - margin))
    return tied.join(branches.select(doc, "branch"), doc, "left").groupBy(query).agg(F.count("*").alias("ties"), F.count_distinct("branch").alias("n_branches"))


def clue_needed(judged: DataFrame, terms: DataFrame, query: str = "item_id", threshold: float = 0.45) -> DataFrame:
    """(query, reason) of answers too unsure to give: weak ones ask nothing; low confidence, near ties in several branches
    (a column n_branches, if there), or else near ties of a query of one or two terms, ask for a clue; reasons add up.
    `judged` comes from confidence(); `terms` has (query, n_terms)."""
    tied = F.col("near_ties") > 1
    apart = tied & (F.col("n_branches") > 1) if "n_branches" in judged.columns else F.lit(False)
    second = F.when(apart, "several branches").when(tied & (F.col("n_terms") <= 2), "underspecified")
    reason = F.when(~F.col("weak"), F.nullif(F.concat_ws("; ", F.when(F.col("confidence") < threshold, "low confidence"), second), F.lit("")))
    return judged.join(terms, query).select(query, reason.alias("reason")).where("reason is not null")
