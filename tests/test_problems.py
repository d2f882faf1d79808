import random
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest

from tessera.operators.hierarchy import descendants, hierarchy, latest_links
from tessera.operators.history import fact_history, merge_versions
from tessera.operators.timestamps import normalize_instants, update_dictionary, utc_text
from tessera.plans import problems
from tests import brute

DATA = "/root/testdata/sf0.001"
FACT = "fact_id string, subject string, attribute string, value string, timestamp string, status string, entity string"


def rows(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns) or None).to_pylist()


def test_history_against_brute_force(spark):
    found = {tuple(r) for r in problems.p2_found(spark, DATA).collect()}
    assert found == brute.versions(rows("facts"))


def test_history_of_random_updates_with_a_hot_entity(spark):
    pick = random.Random(7)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    facts = []
    for i in range(3000):
        when = start + timedelta(hours=pick.randrange(4000))
        subject = "hot" if pick.random() < 0.5 else f"s{pick.randrange(40)}"
        facts.append(dict(fact_id=f"F{i:05}", subject=subject, attribute="a", value=f"v{pick.randrange(3)}", timestamp=when.strftime("%Y-%m-%dT%H:%M:%SZ"), status="x", entity="clash"))
    got = fact_history(spark.createDataFrame(facts, FACT)).collect()
    assert {(r.subject, r.attribute, r.valid_from) for r in got} == brute.versions(facts)
    by_subject = {}
    for r in sorted(got, key=lambda r: (r.subject, r.valid_from)):
        before = by_subject.get(r.subject)
        assert before is None or before.valid_to == r.valid_from and before.value != r.value
        by_subject[r.subject] = r
    assert all(r.valid_to is None for r in by_subject.values())


def test_history_edges(spark):
    facts = [
        ("F1", "Ána  B", "Stack", "go", "2024-01-01", None, None),
        ("F2", "ana b", " stack ", "GO", "2024-01-02T00:00:00+00:00", None, None),
        ("F3", "ana b", "stack", "rust", "2024-01-02T02:00:00+02:00", None, None),
        ("F3", "ana b", "stack", "rust", "2024-01-02T02:00:00+02:00", None, None),
        ("F4", None, "stack", "x", "2024-01-01", None, None),
        ("F5", "ana b", "stack", None, "2024-01-01", None, None),
        ("F6", "ana b", "stack", "  ", "2024-01-01", None, None),
        ("F7", "ana b", "stack", "c", "not a date", None, None),
        (None, "ana b", "stack", "zig", "2024-01-03", None, None),
    ]
    got = sorted(tuple(r) for r in fact_history(spark.createDataFrame(facts, FACT)).collect())
    assert got == [
        ("ana b", "stack", "go", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"),
        ("ana b", "stack", "rust", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z"),
        ("ana b", "stack", "zig", "2024-01-03T00:00:00Z", None),
    ]
    assert fact_history(spark.createDataFrame([], FACT)).count() == 0


def test_several_snapshots_merge(spark):
    schema = "entity string, instant bigint, payload string, tie string, extra int"
    first = spark.createDataFrame([("e", 1, "a", "1", 0), ("e", 5, "c", "1", 0), ("f", 2, "x", "1", 0)], schema)
    second = spark.createDataFrame([("e", 3, "b", "1", 0), ("e", 5, "d", "2", 0), ("f", 3, "x", "1", 0)], schema)
    got = sorted((r.entity, r.payload, r.valid_from, r.valid_to) for r in merge_versions([first, second]).collect())
    assert got == [("e", "a", 1, 3), ("e", "b", 3, 5), ("e", "d", 5, None), ("f", "x", 2, None)]


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_versions_over_many_bounds(spark, parts):
    """Bounds inside entities, inside instants and inside repeated rows change nothing."""
    pick = random.Random(11)
    rows = [("hot" if pick.random() < 0.6 else f"e{pick.randrange(30)}", pick.randrange(25), f"p{pick.randrange(2)}", pick.choice([None, "1", "2", "3"])) for _ in range(2000)]
    rows += [("hot", 7, "p9", "9")] * 700 + [("e5", 9, "only", "1")] * 300
    best = {}
    for e, i, p, t in rows:
        best[e, i] = max(best.get((e, i), ("", "")), (t or "", p))
    expected, last = [], None
    for (e, i), (_, p) in sorted(best.items()):
        if last and last[0] == e and last[1] == p:
            continue
        if last and last[0] == e:
            expected[-1][3] = i
        expected.append([e, p, i, None])
        last = e, p
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "entity string, instant bigint, payload string, tie string").repartition(5)
        got = [[r.entity, r.payload, r.valid_from, r.valid_to] for r in merge_versions([frame]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=lambda x: x[:3]) == sorted(expected, key=lambda x: x[:3])


def test_timestamps_against_brute_force(spark):
    found = {tuple(r) for r in problems.p3_found(spark, DATA).collect()}
    zones = {s["id"]: s["tz"] for s in rows("sessions") if s["tz"]}
    expected = {("message", m["id"], brute.instant(m["time_created"], zones.get(m["session_id"]))) for m in rows("messages")}
    expected |= {("turn", str(t["turn_id"]), brute.instant(t["timestamp"], zones.get(t["session_id"]))) for t in rows("turns")}
    expected |= {("leaf", x["leaf_id"], brute.instant(x["timestamp"], None)) for x in rows("leaves", "leaf_id", "timestamp")}
    assert found == {e for e in expected if e[2]}


@pytest.mark.parametrize(
    "raw, zone, expected",
    [
        ("2023-11-05 01:30:00", "America/New_York", "2023-11-05T05:30:00Z"),  # occurs twice: the earlier
        ("2023-03-12 02:30:00", "America/New_York", "2023-03-12T07:30:00Z"),  # skipped: the offset before
        ("2023-03-26 02:30", "Europe/Madrid", "2023-03-26T01:30:00Z"),
        ("2023-01-02 03:04:05", "Mars/Base", "2023-01-02T03:04:05Z"),
        ("2023-01-02 03:04:05 EST", "Asia/Tokyo", "2023-01-02T08:04:05Z"),
        ("2023-07-02 03:04:05 Asia/Kolkata", None, "2023-07-01T21:34:05Z"),
        ("2023-07-02T03:04:05[Asia/Tokyo]", None, "2023-07-01T18:04:05Z"),
        ("1672535566209", "Asia/Tokyo", "2023-01-01T01:12:46Z"),
        ("1672535566", None, "2023-01-01T01:12:46Z"),
        ("1672535566209123", None, "2023-01-01T01:12:46Z"),
        ("1672535566209123456", None, "2023-01-01T01:12:46Z"),
        ("03/04/23 05:06", None, "2023-04-03T05:06:00Z"),
        ("31/31/2025 10:00", None, None),
        ("29/02/2023 10:00", None, None),
        ("0000-00-00 00:00:00", None, None),
        ("2023-01-02 25:00:00", None, None),
        ("March 2, 2023 12:05 AM", None, "2023-03-02T00:05:00Z"),
        ("March 2, 2023 12:05 PM", None, "2023-03-02T12:05:00Z"),
        ("9 de septiembre de 2023, 07:05", "Europe/Madrid", "2023-09-09T05:05:00Z"),
        ("Tue, 03 Jan 2023 04:05:06 +0530", None, "2023-01-02T22:35:06Z"),
        ("20230102T030405Z", None, "2023-01-02T03:04:05Z"),
        ("2024-02-29", "Asia/Tokyo", "2024-02-28T15:00:00Z"),
        (" 2024-02-29T00:00:00,123Z ", None, "2024-02-29T00:00:00Z"),
        ("yesterday", None, None),
        ("", None, None),
        (None, None, None),
        ("9" * 5000, None, None),
        ("1" * 30, None, None),
    ],
)
def test_timestamp_forms(spark, raw, zone, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(raw, zone, "kept", 1)], "raw string, zone string, _row string, epoch int")
    got = normalize_instants(df, "raw", "zone", out="seconds").select("_row", "epoch", utc_text(F.col("seconds")).alias("utc")).collect()
    assert [tuple(r) for r in got] == [("kept", 1, expected)]


def test_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    one = spark.createDataFrame([("2024-01-01", ""), ("pending", "")], "raw string, zone string")
    assert update_dictionary(one, path).count() == 2
    two = spark.createDataFrame([("2024-01-01", ""), ("2024-01-02", ""), (None, None)], "raw string, zone string")
    assert {r.raw for r in update_dictionary(two, path).collect()} == {"2024-01-01", "pending", "2024-01-02"}
    spark.read.parquet(path).limit(3).write.mode("append").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(path)  # as after a repeated append
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), (None, 3), ("", 3)], "raw string, n int")
    assert sorted((r.n, r.epoch) for r in normalize_instants(rows, "raw", path=path).collect() if r.n < 3) == [(1, 1704067200), (2, 1704067200)]
    assert normalize_instants(rows, "raw", path=path, source="n").count() == 4


def test_hierarchy_against_brute_force(spark):
    found = {tuple(r) for r in problems.p4_found(spark, DATA).collect()}
    assert found == brute.tree(rows("catalog_entries"))


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_of_random_graphs(spark, seed):
    pick = random.Random(seed)
    n = 400
    entries = [dict(id=f"n{i:03}", parent_id=f"n{max(0, i - pick.choice([1, 1, 1, 7])):03}" if i % 50 else None, timestamp="t") for i in range(n)]
    for _ in range(6):  # some loops, with and without splitters, and a self-parent
        a = pick.randrange(n)
        entries[a]["parent_id"] = f"n{min(n - 1, a + pick.choice([0, 1, 2, 30])):03}"
    links = latest_links(spark.createDataFrame(entries, "id string, parent_id string, timestamp string"))
    got = hierarchy(links, paths=True).collect()
    assert {(r.id, r.root_id, r.depth) for r in got} == brute.tree(entries)
    for r in got:
        if r.depth >= 0:
            assert r.path[0] == r.root_id and r.path[-1] == r.id and len(r.path) == r.depth + 1
        else:
            assert r.path is None


def test_hierarchy_edges(spark):
    schema = "id string, parent_id string, timestamp string, at string, path int"
    entries = [(" a ", None, "1", "x", 0), ("a", "zz", "0", "x", 0), ("b", " a", "1", "x", 0), (None, "a", "1", "x", 0), ("  ", "a", "1", "x", 0), ("c", "c", "1", "x", 0), ("d", "c", None, "x", 0)]
    got = {tuple(r) for r in hierarchy(latest_links(spark.createDataFrame(entries, schema))).collect()}
    assert got == {("a", "a", 0), ("b", "a", 1), ("c", "c", -1), ("d", "c", -1)}
    assert hierarchy(latest_links(spark.createDataFrame([], schema))).count() == 0
    tree = hierarchy(latest_links(spark.createDataFrame(entries, schema)), paths=True)
    assert [tuple(r) for r in descendants(tree).collect()] == [("a", "b", 1)]
