"""Tokens of text and source code, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize

#: The function words and language keywords that ranking leaves out.
STOP_EN = """
    a about above after again against all am an and any are aren as at be because been before being
    below between both but by can cannot could did do does doing don down during each few for from
    further had has have having he her here hers him his how i if in into is it its itself just me
    more most my no nor not of off on once only or other our out over own same she should so some
    such than that the their them then there these they this those through to too under until up
    very was we were what when where which while who whom why will with would you your
"""
STOP_ES = """
    a al algo algunas algunos ante antes como con contra cual cuando de del desde donde dos el ella
    ellas ellos en entre era erais eran eres es esa esas ese eso esos esta estaba estas este esto
    estos fue fui ha habia han hasta hay la las le les lo los mas me mi mis mucho muy nada ni no nos
    nosotros o os otra otro para pero poco por porque que quien se sea segun ser si sin sobre solo
    son su sus tambien tanto te tiene tienen todo todos tu tus un una uno unos vosotros y ya yo
"""
STOP_CODE = """
    public private protected static final void return new class interface extends implements import
    package this super null true false int long float double boolean char string var let const
    function def self none elif else if for while try catch except finally throw throws raise with
    as from lambda pass break continue struct namespace using include template typename auto def
"""
STOP = sorted({*STOP_EN.split(), *STOP_ES.split()})
WORD = "[0-9A-Za-z_À-ɏ]+"
CAMEL = "[A-Z][a-z0-9]+|[A-Z]{2,}(?![a-z])|[a-z0-9]+"


def word_terms(w: Column) -> Column:
    """The terms of one word: itself, the parts of CamelCase (two or more) and the pieces between underscores."""
    norm = normalize(w)
    none = F.array().cast("array<string>")
    long = lambda x: F.char_length(x) >= 2
    parts = F.regexp_extract_all(w, F.lit(CAMEL), F.lit(0))
    camel = F.when(F.size(parts) > 1, F.filter(F.transform(parts, F.lower), long)).otherwise(none)
    pieces = F.when(w.contains("_"), F.filter(F.transform(F.split(w, "_"), normalize), lambda x: long(x) & (x != norm))).otherwise(none)
    return F.concat(F.when(long(norm), F.array(norm)).otherwise(none), camel, pieces)


def term_rows(df: DataFrame, ids: list[str], text: str = "text", content: bool = True, code: bool = False) -> DataFrame:
    """(ids..., term) for each token; `content` leaves out stop words and plain digits. Null text gives no row."""
    words = df.select(*ids, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("_w"))
    rows = words.select(*ids, F.explode(word_terms(F.col("_w"))).alias("term"))
    if not content:
        return rows
    stop = STOP + STOP_CODE.split() if code else STOP
    return rows.where(~F.col("term").isin(*stop) & ~F.col("term").rlike("^[0-9]+$"))


def term_counts(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., term, tf) of the content terms. Words are counted before they are taken apart, which is the costly step."""
    words = df.select(*ids, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("_w")).groupBy(*ids, "_w").agg(F.count("*").alias("_n"))
    rows = words.select(*ids, "_n", F.explode(word_terms(F.col("_w"))).alias("term"))
    kept = rows.where(~F.col("term").isin(*STOP) & ~F.col("term").rlike("^[0-9]+$"))
    return kept.groupBy(*ids, "term").agg(F.sum("_n").alias("tf"))


def top_terms(counts: DataFrame, ids: list[str], top_k: int) -> DataFrame:
    """(ids..., keywords): of rows (ids..., term, n) the most frequent terms, ties in alphabetical order, joined by spaces.

    All but the first `top_k` of a group are dropped before it is gathered, however large its vocabulary."""
    by = Window.partitionBy(*ids).orderBy(F.desc("n"), "term")
    kept = counts.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= top_k)
    return kept.groupBy(*ids).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_r", "term")))["term"], " ").alias("keywords"))


def keywords(df: DataFrame, ids: list[str], text: str = "text", top_k: int = 12, code: bool = False, boost: str | None = None) -> DataFrame:
    """(ids..., keywords): the most frequent content terms of each text. Terms of the column `boost` count twice more each."""
    counts = term_rows(df, ids, text, code=code).groupBy(*ids, "term").agg(F.count("*").alias("n"))
    if boost:
        more = term_rows(df, ids, boost, code=code).groupBy(*ids, "term").agg((2 * F.count("*")).alias("n"))
        counts = counts.unionByName(more).groupBy(*ids, "term").agg(F.sum("n").alias("n"))
    return top_terms(counts, ids, top_k)


#: Words with a capital, and identifiers with an inner one.
CAPITALS, INNER = r"(?U)\b[A-ZÀ-Ü][\wÀ-ɏ]{2,}\b", r"\b[A-Za-z_][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*\b"


def entity_rows(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., entity): capital words that are no stop words, and identifiers; a word of both kinds comes twice."""
    words = F.regexp_extract_all(F.col(text), F.lit(CAPITALS), F.lit(0))
    kept = F.filter(words, lambda w: ~normalize(w).isin(*STOP))
    return df.select(*ids, F.explode(F.concat(kept, F.regexp_extract_all(F.col(text), F.lit(INNER), F.lit(0)))).alias("entity"))


def entities(df: DataFrame, ids: list[str], text: str = "text", limit: int = 12) -> DataFrame:
    """(ids..., entity, n, rank): the most frequent entities of each text, ties in alphabetical order."""
    counts = entity_rows(df, ids, text).groupBy(*ids, "entity").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*ids).orderBy(F.desc("n"), "entity")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def ordered_distinct(rows: DataFrame, ids: list[str], item: str, order: list[str], limit: int | None = None) -> DataFrame:
    """(ids..., items): the items of each group in order, the first of those that are equal when normalised; blanks drop."""
    bare = rows.where(F.col(item).isNotNull() & (F.trim(item) != ""))
    first = bare.groupBy(*ids, normalize(F.col(item)).alias("_n")).agg(F.min(F.struct(*order, F.col(item).alias("_item"))).alias("_f"))
    if limit is not None:
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*ids).orderBy("_f"))).where(F.col("_r") <= limit)
    return first.groupBy(*ids).agg(F.array_sort(F.collect_list("_f"))["_item"].alias("items"))
