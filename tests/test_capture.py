"""Capture of transcripts that grow between sweeps."""

import json
import os

from tessera.sources.transcripts import parse_dialect_a, parse_dialect_b
from tessera.streaming.capture import capture_stream

SAID = lambda n, text: json.dumps({"type": "user", "timestamp": f"t{n}", "sessionId": "s", "message": {"role": "user", "content": text}})
TOLD = json.dumps({"type": "event_msg", "timestamp": "t1", "payload": {"type": "user_message", "message": "hi {there}"}})


def test_grown_transcripts_are_read_on(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    (folder / "deep [1] {a,b}").mkdir(parents=True)
    one, two = folder / "deep [1] {a,b}" / "one.jsonl", folder / "two.jsonl"
    last = SAID(2, "second")
    taken = lambda: sorted((r.timestamp, r.text) for r in spark.read.parquet(out).collect())
    one.write_text(SAID(1, "first") + "\n" + last[:-9])
    two.write_text(SAID(5, "other") + "\n")
    capture_stream(spark, str(folder), out, mark)
    assert taken() == [("t1", "first"), ("t5", "other")]
    one.write_text(SAID(1, "first") + "\n" + last + "\n" + SAID(3, "third"))
    capture_stream(spark, str(folder), out, mark)
    assert taken() == [("t1", "first"), ("t2", "second"), ("t3", "third"), ("t5", "other")]
    capture_stream(spark, str(folder), out, mark)
    with one.open("a") as more:
        more.write("\n")  # grows, with no turn
    capture_stream(spark, str(folder), out, mark)
    with one.open("a") as more:
        more.write(SAID(4, "fourth") + "\n")
    capture_stream(spark, str(folder), out, mark)
    one.write_text(SAID(9, "rewritten") + "\n")  # shrinks: what was taken stays
    capture_stream(spark, str(folder), out, mark)
    assert [t for t, _ in taken()] == ["t1", "t2", "t3", "t4", "t5", "t9"]


def test_a_run_that_fails_before_its_record_is_made_good(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    folder.mkdir()
    (folder / "one.jsonl").write_text(SAID(1, "first") + "\n")
    capture_stream(spark, str(folder), out, str(mark))
    os.rename(mark, tmp_path / "lost")
    (folder / "one.jsonl").write_text(SAID(1, "first") + "\n" + SAID(2, "second") + "\n")
    capture_stream(spark, str(folder), out, str(mark))
    assert sorted(r.timestamp for r in spark.read.parquet(out).collect()) == ["t1", "t2"]


def test_unfinished_lines_give_no_turn(spark):
    for line, parse in ((SAID(1, "first"), parse_dialect_a), (TOLD, parse_dialect_b)):
        assert parse(spark.createDataFrame([(line[:n],) for n in range(len(line))], "value string")).count() == 0
        assert parse(spark.createDataFrame([(line,)], "value string")).count() == 1
