"""Search over an index whose nodes know every leaf below them."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import facts, index, ranking, search, tree
from tessera.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_tree(spark):
    leaves = spark.createDataFrame(
        [(f"L{i:02}", "software.java" if i % 2 else "travel", "filler " * 60 + f"aa{i:02} " + "x" * 3000 + f" zz{i:02}", f"src/Stock{i}.java" if i % 2 else f"notes/{i}.md", "ACTIVE" if i != 5 else "HISTORICAL", "2024-01-01T00:00:00Z") for i in range(64)] + [("L99", "travel", None, None, None, None)],
        "id string, domain string, text string, source string, status string, timestamp string",
    )
    rows = leaves.withColumn("leaf_count", F.lit(1))
    return leaves, search.build_search_index(leaves, tree.build_tree(rows, 8, True))


def test_a_word_in_the_last_leaf_is_found(spark, small_tree):
    """However deep, late or long: the only leaf with a word is the answer."""
    _, found = small_tree
    for word, leaf in (("zz61", "L61"), ("aa00", "L00"), ("zz62", "L62")):
        assert [r.id for r in search.search(found, word).collect()] == [leaf]
        assert [r.id for r in search.search(found, word, siblings=False).collect()] == [leaf]
    assert search.search(found, "").count() == 0 and search.search(found, "nowhere").count() == 0


def test_filters_hold_inside_the_descent(spark, small_tree):
    _, found = small_tree
    ids = lambda **o: [r.id for r in search.search(found, "zz05 zz06", **o).collect()]
    assert ids() == ["L06"] and set(ids(historical=True)) == {"L05", "L06"}
    assert ids(prefix="src/", historical=True) == ["L05"] and ids(since="2025-01-01") == []
    with pytest.raises(ValueError):
        ids(scope="some")


def test_clues_and_code(spark, small_tree):
    _, found = small_tree
    best = search.search(found, "filler", "zz11").orderBy("rank").first()
    assert best.id == "L11" and best.coverage == 1.0
    names = spark.createDataFrame([("src/Stock7.java", "a"), ("src/StockTest.java", "b"), ("src/Stock.java", "Stock.java · imports"), ("notes/stock7.md", None), (None, None)], "source string, title string")
    factors = [round(r[0], 3) for r in names.select(search.code_factor(F.col("source"), F.col("title"), ["stock7", "filler"], "all")).collect()]
    assert factors == [1.4, 0.6, 0.3, 1.0, 1.0]
    asked = []
    told = search.search_interactive(found, "filler", lambda q, rows: asked.append(len(rows)) or ("zz12" if len(asked) == 1 else None))
    assert asked and told.orderBy("rank").first().id == "L12"


@pytest.mark.xfail(reason="measured 0.73 at a beam of 3; 0.9 is the aim", strict=False)
def test_recall_against_all_documents(spark):
    """Of the five best documents by exhaustive BM25 the descent should find nine in ten, over every 25th evaluation item."""
    docs = table(spark, DATA, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("domain", F.lit("general")).alias("domain"), F.lit("2024").alias("timestamp"), F.lit(1).alias("leaf_count"))
    found = search.build_search_index(docs, tree.build_tree(docs, 8, True))
    exhaustive = ranking.top_k(ranking.bm25(index.build_index(docs, "id"), table(spark, DATA, "eval_items"), "id"), 5, doc="id")
    want = {}
    for r in exhaustive.collect():
        want.setdefault(r.item_id, set()).add(r.id)
    items = [r for r in table(spark, DATA, "eval_items").orderBy("item_id").collect() if r.item_id in want][::25]
    hit = total = 0
    for r in items:
        got = {x.id for x in search.search(found, r.text, k=5, siblings=False, by_domain=False).collect()}
        hit, total = hit + len(got & want[r.item_id]), total + len(want[r.item_id])
    assert hit / total >= 0.9, hit / total


def test_newest_correction_goes_first(spark):
    ranked = spark.createDataFrame([(1, "a", 3.0, 0.5, 1), (1, "b", 2.0, 0.9, 2), (1, "c", 1.0, 0.1, 3), (2, "b", 1.0, 1.0, 1), (3, "x", 2.0, 1.0, 1)], "item_id int, id string, score double, coverage double, rank bigint")
    replaced = facts.successors(spark.createDataFrame([("a", "b"), ("x", "y"), ("p", "q"), ("q", "p"), ("s", "s"), (None, "z")], "old string, new string"))
    assert {(r.id, r.current, r.hops) for r in replaced.collect()} == {("a", "b", 1), ("x", "y", 1), ("p", "p", -1), ("q", "p", -1)}
    got = sorted((r.item_id, r["rank"], r.id, r.score, r.coverage, r.replaces) for r in search.current_first(ranked, replaced).collect())
    assert got == [(1, 1, "b", 3.0, 0.9, "a"), (1, 2, "a", 3.0, 0.5, None), (1, 3, "c", 1.0, 0.1, None), (2, 1, "b", 1.0, 1.0, None), (3, 1, "y", 2.0, 1.0, "x"), (3, 2, "x", 2.0, 1.0, None)]


def test_the_index_of_a_table_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None)], "doc_id bigint, text string")
    rows.write.parquet(str(tmp_path / "notes.parquet"))
    asked = spark.createDataFrame([(7, "alpha")], "item_id bigint, text string")
    first = index.table_index(spark, str(tmp_path), "notes")
    assert first.n_docs == 3 and index.table_index(spark, str(tmp_path), "notes").postings.inputFiles() == first.postings.inputFiles()
    assert [r.doc_id for r in ranking.bm25(first, asked).collect()] == [1]
    rows.write.mode("append").parquet(str(tmp_path / "notes.parquet"))
    assert index.table_index(spark, str(tmp_path), "notes").n_docs == 6
    assert index.build_index(rows.limit(0)).n_docs == 0
