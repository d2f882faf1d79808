"""Capture marks, chunking by type, project lookups, corrections, stored versions."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.api import Config, Memory
from tessera.errors import NotFound, StoreNotInitialised
from tessera.functions import notes
from tessera.operators import capture, chunking, facts, ranking, store, summaries, tree
from tessera.sources import files
from tessera.streaming.capture import resolve_late

JAVA = "package a;\nimport java.util.List;\n\npublic class Stock {\n    private int held = 0;\n    static final String BRACE = \"}\";\n\n    /** Reserves { some. */\n    public int reserve(int n) {\n        return n; // }\n    }\n\n    public int free() { return held; }\n}\n\nenum Kind { A, B }\n"
PYTHON = 'import os\nimport sys\n\n\nclass Price:\n    """Money."""\n\n    rate = 1\n\n    def net(self):\n        return 1\n\n    @property\n    def gross(self):\n        return 2\n\n\ndef main():\n    pass\n\n\nif __name__ == "__main__":\n    main()\n'


# ---------------------------------------------------------------- capture
def test_marks_go_by_instant(spark):
    schema = "session_id string, id string, instant bigint"
    read = spark.createDataFrame([("s", "m9", 5), ("s", "m1", 9), (None, "x", 1), ("t", "a", None)], schema)
    marks = capture.high_water(read)
    assert [(r.session_id, r.last_instant, r.last_id, r.messages) for r in marks.collect()] == [("s", 9, "m1", 2)]
    later = spark.createDataFrame([("s", "m10", 10), ("s", "m2", 9), ("s", "m0", 9), ("s", "m8", 3), ("u", "z", 1), ("s", "q", None)], schema)
    assert {r.id for r in capture.unread(later, marks).collect()} == {"m10", "m2", "z", "q"}
    assert capture.high_water(read.limit(0)).count() == 0


def test_late_facts_find_their_key(spark):
    schema = "fact_id string, subject string, attribute string, value string, timestamp string, source_leaf_id string"
    old = spark.createDataFrame([("F1", "User", "City", "Oslo", "2024-01-01", None), ("F2", "other", "city", "Rome", "2024-01-01", None)], schema)
    late = spark.createDataFrame([("F3", "user ", "cIty", "Bergen", "2024-02-01", None)], schema)
    assert {(r.fact_id, r.status) for r in resolve_late(old, late).collect()} == {("F1", "HISTORICAL"), ("F3", "ACTIVE")}


def test_times_are_carried_forward(spark, monkeypatch):
    monkeypatch.setattr(capture, "SLOT", 3)
    rows = spark.createDataFrame([("s", i, "t%d" % i if i in (1, 4) else None) for i in range(12)] + [("r", 0, None)], "session_id string, ord int, timestamp string")
    got = {(r.session_id, r.ord): r.last_seen for r in capture.filled_times(rows).collect()}
    assert [got["s", i] for i in range(12)] == [None] + ["t1"] * 3 + ["t4"] * 8 and got["r", 0] is None


# ---------------------------------------------------------------- chunking
def test_classes_are_divided_into_members():
    for text, units in ((JAVA, chunking.brace_units(JAVA, 10)), (PYTHON, chunking.python_units(PYTHON, 10))):
        lines = text.splitlines(keepends=True)
        assert "".join("".join(lines[a - 1 : b]) for _, _, a, b, _ in units) == text
    assert [n for k, n, *_ in chunking.brace_units(JAVA, 10) if k == "method"] == ["Stock.reserve", "Stock.free"]
    assert [(k, n) for k, n, *_ in chunking.python_units(PYTHON, 10)] == [("imports", ""), ("class-header", "Price"), ("method", "Price.net"), ("method", "Price.gross"), ("function", "main"), ("module", "")]
    assert all("class Price" in c for k, *_, c in chunking.python_units(PYTHON, 10) if k == "method")
    assert [k for k, *_ in chunking.python_units(PYTHON)] == ["imports", "class", "function", "module"]
    script = "#define OPEN {\nconst a = `x ${ {b: 1}.b } }`;\nfunction f() {\n  return 1;\n}\n"
    assert [(n, a, b) for k, n, a, b, _ in chunking.brace_units(script) if k == "function"] == [("f", 3, 5)]


def test_blocks_follow_the_type(spark):
    long = "One sentence is here. " * 400 + "\n"
    docs = spark.createDataFrame(
        [(1, "a.java", JAVA, "CODE"), (2, "d.md", "2024-01-02\nfirst\n\n2024-02-03\nlater\n", "PERSONAL"), (3, "r.md", "# Bread\n1. Mix.\n## Oven\nBake.\n", "PROCESS"), (4, "x", long, None), (5, "y", None, "CODE"), (6, "z", "", "GENERIC")],
        "doc_id bigint, source string, text string, data_type string",
    )
    got = chunking.blocks_by_type(docs, symbols=True).orderBy("doc_id", "ord").collect()
    own = lambda i: [r for r in got if r.doc_id == i]
    for r in docs.where("text <> ''").collect():
        assert "".join(x.text for x in own(r.doc_id)) == r.text
    assert [r.timestamp[:10] for r in own(2)] == ["2024-01-02", "2024-02-03"] and own(2)[1].hard_boundary and own(2)[0].tags == ["date:2024-01-02"]
    assert len(own(3)) == 2 and len(own(4)) > 3 and all(len(r.text) // 4 <= 400 for r in own(4))
    custom = chunking.blocks_by_type(docs, custom={"PROCESS": chunking.paragraphs}).where("doc_id = 3").collect()
    assert [r.kind for r in custom] == ["process"]


def test_small_units_are_grouped(spark):
    schema = "block_id bigint, source string, ord int, text string, title string, start_line int, end_line int, kind string, tags array<string>, timestamp string, context string"
    row = lambda i, text, kind, title=None, tags=(), when=None: (i, "s", i, text, title, i + 1, i + 1, kind, list(tags), when, "")
    big = "x" * 4000
    rows = [row(0, "\n", "blank"), row(1, "a\n", "imports", "a", ["p"]), row(2, "b\n", "imports", "b", ["p", "q"], "2024"), row(3, "\n", "blank"), row(4, "c\n", "method", "c"), row(5, big, "method", "big"), row(5, big, "method", "big"), (None, "s", 6, "lost", None, 1, 1, "x", None, None, None)]
    blocks = spark.createDataFrame(rows, schema)
    chunks = chunking.pack_each(blocks)
    assert [(r.first_block_id, r.last_block_id, r.oversized) for r in chunks.orderBy("chunk").collect()] == [(0, 3, False), (4, 4, False), (5, 5, True)]
    told = chunking.fused(blocks, chunks).orderBy("chunk").collect()
    assert (told[0].title, told[0].kind, told[0].tags, told[0].timestamp, told[0].text, told[0].end_line) == ("a → b", "imports", ["p", "q"], "2024", "\na\nb\n\n", 4)
    assert chunking.pack_each(blocks.limit(0)).count() == 0


# ---------------------------------------------------------------- project
def test_find(spark):
    symbols = spark.createDataFrame([("v1/a.py", "def run", 90), ("src/a.py", "def run", 10), ("src/b.py", "class Base → Base.run", 50), ("tests/test_a.py", "def run", 99), (None, None, 1)], "path string, title string, size int")
    queries = spark.createDataFrame([("q1", "where is Base.run?"), ("q2", "the run_all thing"), ("q3", "a b c"), ("q4", "legacy run")], "query string, text string")
    got = {r["query"]: r.path for r in store.find_exact(symbols, queries.where("query = 'q1'")).collect()}
    assert got == {"q1": "src/b.py"}
    only = spark.createDataFrame([("q", "runs"), ("p", "Base")], "query string, text string")
    assert {r["query"]: r.path for r in store.find_exact(symbols, only).collect()} == {"p": "src/b.py"}
    ranked = spark.createDataFrame([("q2", "x.py", "t", 1), ("q2", "y.py", "u", 2), ("q4", "z.py", "w", 1)], "query string, path string, title string, rank int")
    judged = spark.createDataFrame([("q2", "low confidence")], "query string, reason string")
    found = {r["query"]: (r.status, r.path) for r in store.find(symbols, queries, ranked, judged).collect()}
    assert found == {"q1": ("found", "src/b.py"), "q2": ("ambiguous", None), "q3": ("none", None), "q4": ("found", "z.py")}


def test_map_keeps_to_its_budget(spark):
    paths = [f"big/f{i}.py" for i in range(50)] + [f"small/g{i}.py" for i in range(3)] + ["top.py"]
    rows = spark.createDataFrame([(p, 10) for p in paths], "path string, tokens int")
    got = store.budgeted_map(rows, max_lines=12).collect()
    assert len(got) == 5 and {r.path for r in got if r.shown} == {"small/g0.py", "small/g1.py", "small/g2.py", "top.py"}
    assert sum(r.tokens for r in got) == 540
    assert all(r.shown for r in store.budgeted_map(rows, max_lines=400).collect())
    assert not any(r.shown for r in store.budgeted_map(rows, max_tokens=0).collect())
    tests = spark.createDataFrame([("tests/test_a.py",), ("a.py",)], "path string")
    assert [store.hidden_by_scope(tests, s).first().hidden for s in ("all", "main", "test")] == [0, 1, 1]


def test_changed_files(spark):
    text = "".join(f"line {i}\n" for i in range(50))
    before = spark.createDataFrame([("a", text), ("b", "same"), ("c", "short")], "source string, text string")
    now = spark.createDataFrame([("a", text.replace("line 20", "new 20")), ("b", "same"), ("c", "other"), ("d", "fresh"), ("e", None)], "source string, text string")
    got = {r.source: r for r in files.read_changes(now, before).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "diff", "b": "unchanged", "c": "changed", "d": "new", "e": "new"}
    assert "+new 20" in got["a"].text and "line 40" not in got["a"].text and got["b"].text is None and got["c"].text == "other"


def test_node_files(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"id": "N1", "layer": 2, "children": ["a"]}))
    (tmp_path / "bad.json").write_text("{")
    assert [(r.id, r.malformed) for r in files.read_nodes(spark, str(tmp_path)).orderBy("path").collect()] == [(None, True), ("N1", False)]
    assert files.read_nodes(spark, str(tmp_path), 1).count() == 0


def test_lines_and_symbols(spark):
    rows = spark.createDataFrame([("\n  \n  First  line \nx",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(notes.first_meaningful_line(F.col("t"))).collect()] == ["First line", "", None]
    names = spark.createDataFrame([("a.py · async def run",), ("class Base",), (None,)], "t string")
    assert [r[0] for r in names.select(notes.short_symbol(F.col("t"))).collect()] == ["run", "Base", None]


# ---------------------------------------------------------------- tree
def test_node_summaries(spark):
    schema = "id string, domain string, timestamp string, leaf_count int, title string, text string, keywords array<string>, entities array<string>, tags array<string>"
    leaves = spark.createDataFrame([(f"L{i}", "travel", f"2024-0{i + 1}-01T00:00:00Z", 1, f"Trip {i}", f"We saw Bergen harbour number {i}. It rained.", ["harbour"], ["Bergen"], ["domain:travel"]) for i in range(4)] + [("L9", "travel", None, 1, None, None, None, None, None)], schema)
    nodes = tree.build_tree(leaves, 2, True, summaries.summarize_nodes).collect()
    assert {n.layer for n in nodes} == {1, 2}
    first = min((n for n in nodes if n.layer == 1), key=lambda n: n.timestamp or "")
    assert "Bergen" in first.entities and first.keywords[0] == "harbour" and first.tags == ["domain:travel"] and first.summary.startswith("[travel · layer 1 · 2 children")
    assert len(first.summary) <= 900 and len(first.title) <= 90
    total = summaries.global_summary(spark.createDataFrame([("travel", 5, ["harbour", "travel"])], "domain string, leaf_count bigint, keywords array<string>")).first()
    assert total.topics == ["travel", "harbour"] and total.leaves == 5


def test_unreachable_leaves(spark):
    leaves = spark.createDataFrame([("a",), ("b",), ("lost",)], "id string")
    built = spark.createDataFrame([("N", 1, ["a", "b"])], "id string, layer int, children array<string>")
    roots = spark.createDataFrame([("N",)], "id string")
    assert [r.id for r in tree.unreachable(leaves, built, roots).collect()] == ["lost"]


# ---------------------------------------------------------------- corrections and the store
def test_explicit_notices(spark):
    pairs = spark.createDataFrame([], "old string, new string")
    with pytest.raises(ValueError):
        facts.supersede(pairs, "a", "a")
    twice = facts.supersede(facts.supersede(pairs, "a", "b"), "a", "b")
    leaves = spark.createDataFrame([("b", "New", "2024-05-01T00:00:00Z")], "leaf_id string, title string, timestamp string")
    assert [tuple(r) for r in facts.explicit_notices(twice, leaves).collect()] == [("a", "outdated: corrected by b (New) on 2024-05-01")]
    seen = spark.createDataFrame([("k", "x")], "key string, new_value string")
    assert facts.new_conflicts(spark.createDataFrame([("k", "x"), ("k", "y")], "key string, new_value string"), seen).count() == 1


def test_store_life(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(StoreNotInitialised):
        Memory(spark, root).leaves()
    memory = Memory(spark, root, Config(branch_factor=2))
    memory.initialize()
    assert Config.load(spark, root).branch_factor == 2 and memory.leaves().count() == 0
    memory.ingest_text("The harbour of Oslo is frozen in winter.", "2026-01-01T00:00:00Z")
    memory.ingest_text("The harbour of Oslo is never frozen now.", "2026-01-02T00:00:00Z")
    assert memory.leaves().count() == 2  # without a source, each text is its own
    old, new = [r.leaf_id for r in memory.leaves().orderBy("ingested_at").collect()]
    with pytest.raises(NotFound):
        memory.supersede(old, "nobody")
    assert [r.held >= 0.5 for r in memory.correct(new).collect()] == [True]
    found = memory.search("harbour frozen winter").collect()
    assert found[0].id == new and found[0].replaces == old and found[1].notices[0].startswith("outdated: corrected by")
    memory.record_fact("user", "city", "Oslo", "2024-01-01")
    memory.record_fact("User", "city", "Oslo", "2024-01-01")
    memory.record_fact("user", "city", "Rome", "2025-01-01")
    assert [(r.new_value, r.old_value) for r in memory.conflicts().collect()] == [("Rome", "Oslo")]
    assert memory.stats().where("domain = '*'").first().facts == 2
    assert memory.leaves().where("parent_id is not null").count() == 2 and memory.outline().count() >= 1
    memory.initialize(force=True)
    assert memory.leaves().where("parent_id is not null").count() == 0 and len(memory._versions("leaves")) <= 2


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = session.written(spark.range(10).select(F.expr("sequence(1, 1000)").alias("a")), "sized")
    hinted = lambda df: "hint" in df._jdf.queryExecution().analyzed().toString().lower() or "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(session.small(rows)) and not hinted(session.small(rows, size=1000)) and not hinted(session.small(rows, rows=5))


def test_overlap_finds_what_is_held_in_part(spark):
    new = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, None)], "new_id int, text string")
    old = spark.createDataFrame([(10, "alpha beta other words"), (11, "gamma alpha beta extra"), (12, "nothing here")], "old_id int, text string")
    assert {tuple(r) for r in ranking.held_overlap(new, old).collect()} == {(1, 11, 0.75)}
