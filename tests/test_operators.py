"""Operators that SQL cannot express, and edge cases of the others."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.api import Config, Memory
from tessera.functions import notes
from tessera.operators import capture, chunking, classify, facts, ranking, search, store, tree
from tessera.sources import files, transcripts
from tessera.streaming.capture import capture_stream

NOTES = [
    ("notes/a.md", "2024-03-01: I live in Oslo, near the port.\n\n# Trip\n\nWe booked a hotel and a flight.\n"),
    ("notes/b.md", "2025-05-01: I live in Bergen now.\n\nThe recipe needs ingredients, an oven and a pan.\n"),
    ("src/Stock.java", "package a;\n\nimport java.util.List;\n\npublic class Stock {\n    public int reserve(int n) {\n        return n; // { not a brace\n    }\n}\n"),
    ("src/pricing.py", "import os\nimport sys\n\ndef price(x):\n    return x\n\n\nclass Tax:\n    rate = 1\n"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(NOTES)], "doc_id bigint, source string, text string")


def test_code_units_are_lossless(spark, documents):
    units = chunking.code_units(documents.where("source like 'src/%'")).orderBy("doc_id", "unit").collect()
    for i, (_, text) in enumerate(NOTES):
        if i >= 2:
            assert "".join(u.text for u in units if u.doc_id == i) == text
    assert {"Stock", "price", "Tax"} <= {u.name for u in units}


def test_types(spark, documents):
    got = {r.doc_id: r for r in classify.detect(documents).collect()}
    assert got[2].data_type == "CODE" and got[2].domain == "software.java" and got[3].domain == "software.python"
    assert len(got) == 4
    empty = spark.createDataFrame([(1, None, None), (2, "x", "")], "doc_id bigint, source string, text string")
    assert {r.data_type for r in classify.detect(empty).collect()} == {"GENERIC"}


def test_packing_rules(spark):
    schema = "block_id bigint, source string, ord int, text string, hard_boundary boolean"
    word = "abcd" * 100
    rows = [(1, "s", 0, word, None), (2, "s", 1, "\n\n", False), (3, "s", 2, word, True), (4, "s", 3, word * 10, False), (5, "s", 4, word * 3, False), (6, "s", 5, word * 2, False), (6, "s", 5, word * 2, False), (None, "s", 6, "x", None), (7, "t", 0, None, None)]
    got = [(r.source, r.first_block_id, r.last_block_id, r.oversized) for r in chunking.pack(spark.createDataFrame(rows, schema)).orderBy("source", "chunk").collect()]
    assert got == [("s", 1, 2, False), ("s", 3, 3, False), ("s", 4, 4, True), ("s", 5, 5, False), ("s", 6, 6, False), ("t", 7, 7, False)]
    assert chunking.pack(spark.createDataFrame([], schema)).count() == 0


def test_dated_entries_carry_their_date(spark):
    text = "2024-01-02\nfirst\n\n## More\nstill\n\n2024-02-03\nlater\n"
    got = chunking.entries(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("part").collect()
    assert [r.date for r in got] == ["2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z", "2024-02-03T00:00:00Z"]
    assert [r.hard for r in got] == [False, False, True] and "".join(r.text for r in got) == text


def test_fragments_cut_before_users(spark):
    schema = "session_id string, message_id string, ord int, role string, text string, timestamp string"
    rows = [("s", f"m{i}", i, role, "x" * n, None) for i, (role, n) in enumerate([("user", 400), ("assistant", 4000), ("assistant", 40), ("User ", 40), ("assistant", 40)])]
    got = capture.fragments(spark.createDataFrame(rows, schema)).orderBy("fragment").collect()
    assert [(r.first_ord, r.last_ord) for r in got] == [(0, 2), (3, 4)]


def test_rank_in_groups(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(300)], "k string, v int")
    got = ranking.rank_in_groups(df, ["k"], ["v"]).collect()
    for key in ("a", None):
        assert [r.rank for r in sorted((r for r in got if r.k == key), key=lambda r: r.v)] == list(range(sum(r.k == key for r in got)))


def test_search_finds_the_leaf(spark):
    rows = [(f"L{i:02}", "d", f"2024-01-{i + 1:02}T00:00:00Z", f"note {i} about topic{i % 5} and garden{i}", 1) for i in range(25)]
    leaves = spark.createDataFrame(rows, "id string, domain string, timestamp string, text string, leaf_count int")
    built = tree.build_tree(leaves, 4, True)
    assert search.beam_search(leaves, built, "garden17", 8, 3).first().id == "L17"
    assert search.beam_search(leaves, built, "nothing known", 3, 3).count() == 0
    assert tree.unreached(leaves, built).count() <= 1


def test_facts(spark):
    schema = "fact_id string, subject string, attribute string, value string, timestamp string, source_leaf_id string"
    rows = [("F2", "user", "city", "Bergen", "2025-01-01", "L2"), ("F1", "user", "city", "Oslo", "2024-01-01", "L1"), ("F3", "User", "City", "bergen", "2025-02-01", "L3"), ("F4", "user", "job", "x", None, None), ("F5", None, "job", "x", "2024-01-01", None)]
    df = spark.createDataFrame(rows, schema)
    assert {(r.fact_id, r.superseded_by) for r in facts.timeline(df).collect()} == {("F1", "F2"), ("F2", "F3"), ("F3", None), ("F4", None)}
    assert [(r.new_id, r.old_id) for r in facts.conflicts(df).collect()] == [("F3", "F1")]
    assert {r.fact_id for r in facts.state_at(df, 1719792000).collect()} == {"F1"}
    assert [r.source_leaf_id for r in facts.notices(df).collect()] == ["L1"]
    assert facts.timeline(df.limit(0)).count() == 0


def test_extraction(spark):
    text = "I live in Madrid, Spain. Trabajo en Acme; mi stack es Go\nPaciente: Ana Ruiz\nDiagnóstico: gripe leve."
    got = facts.extract(spark.createDataFrame([("L", "2024-01-01", text), ("M", None, None)], "leaf_id string, timestamp string, content string")).collect()
    assert {(r.subject, r.attribute, r.value) for r in got} == {("user", "location", "Madrid"), ("user", "employer", "Acme"), ("user", "stack", "Go"), ("Ana Ruiz", "diagnosis", "gripe leve")}


@pytest.mark.parametrize("text, kept", [("token = abcdef123", "token = [REDACTED]"), ("max_tokens=3000", "max_tokens=3000"), ("use sk-abcdefghijklmnop1234", "use [REDACTED]")])
def test_secrets(spark, text, kept):
    assert spark.createDataFrame([(text,)], "t string").select(notes.redact_secrets(F.col("t"))).first()[0] == kept


def test_sync(spark):
    schema = "path string, size bigint, digest string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], schema)
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "x")], schema)
    assert {(r.path, r.change) for r in store.sync_diff(old, new).collect()} == {("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added")}


def test_leaf_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    header = json.dumps({"leaf_id": "L1", "domain": "d", "tags": ["x"], "unknown": 1})
    (tmp_path / "d" / "a.txt").write_text(f"<<<LEAF-META\n{header}\nLEAF-META>>>\nbody LEAF-META>>> end\n")
    (tmp_path / "d" / "b.txt").write_text("no header")
    got = {r.path: r for r in files.read_leaves(spark, str(tmp_path)).collect()}
    assert got["d/a.txt"].content == "body LEAF-META>>> end\n" and got["d/a.txt"].tags == ["x"] and got["d/b.txt"].malformed


def test_project_scan(spark, tmp_path):
    for path in ("a/Main.java", "build/Gen.java", "out/X.java", "a/out/Y.java", "a/pic.png", ".hidden/Z.java"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("class X {}")
    assert {r.path for r in files.scan_project(spark, str(tmp_path)).collect()} == {"a/Main.java", "a/out/Y.java"}
    assert {r.source for r in files.read_documents(spark, str(tmp_path)).collect()} == {"a/Main.java", "a/out/Y.java"}


LINES = [
    {"type": "user", "timestamp": "t1", "sessionId": "s", "message": {"role": "user", "content": "<system-reminder>no</system-reminder>Fix it, password=hunter22"}},
    {"type": "assistant", "timestamp": "t2", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "Done"}, {"type": "tool_use", "name": "x__Edit", "input": {"file_path": "a.py"}}, {"type": "tool_use", "name": "Read", "input": {}}]}},
    {"type": "user", "timestamp": "t3", "sessionId": "s", "isSidechain": True, "message": {"role": "user", "content": "aside"}},
]


def test_transcripts_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.jsonl").write_text("\n".join(map(json.dumps, LINES)) + '\n{"type": "user", "unfinis')
    got = transcripts.read_transcripts(spark, [str(folder)]).orderBy("timestamp").collect()
    assert [(r.role, r.text, r.actions) for r in got] == [("user", "Fix it, password=[REDACTED]", []), ("assistant", "Done", ["Edit: a.py"])]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    capture_stream(spark, str(folder), out, mark)
    capture_stream(spark, str(folder), out, mark)
    assert spark.read.parquet(out).count() == 2
    (folder / "two.jsonl").write_text(json.dumps(LINES[0] | {"timestamp": "t9"}) + "\n")
    capture_stream(spark, str(folder), out, mark)
    assert spark.read.parquet(out).count() == 3


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("create table message (id text, n integer)")
        db.executemany("insert into message values (?, ?)", [(f"m{i}", i) for i in range(10)])
    got = transcripts.read_sqlite(spark, path, "message", "id string, n bigint")
    assert got.count() == 10 and got.agg(F.sum("n")).first()[0] == 45


def test_memory_end_to_end(spark, documents, tmp_path):
    memory = Memory(spark, str(tmp_path / "store"), Config.of({"branch_factor": 2, "unknown": 1}))
    memory.ingest(documents, "2026-01-01T00:00:00Z")
    leaves = memory.leaves().collect()
    for source, text in NOTES:
        assert "".join(r.content for r in sorted((r for r in leaves if r.source == source), key=lambda r: r.order_index)) == text
    assert "b.md" in memory.search("recipe ingredients oven").first().source
    assert [(r.new_value, r.old_value) for r in memory.conflicts().collect()] == [("Bergen now", "Oslo")]
    memory.ingest(spark.createDataFrame([(0, "notes/a.md", "Another text altogether.\n")], "doc_id bigint, source string, text string"), "2026-02-01T00:00:00Z")
    assert memory.leaves(historical=True).where("status = 'HISTORICAL'").count() == 2
    with pytest.raises(ValueError):
        Config(branch_factor=1)
