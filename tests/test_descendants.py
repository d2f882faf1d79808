"""Descendants of every id, those on or below loops too, against plain Python."""

import random

import pyarrow.parquet as pq
import pytest

from tessera.operators.hierarchy import all_descendants, latest_links
from tessera.plans import problems

DATA = "/root/testdata/sf0.001"


def below(entries):
    """({id: mark}, {(id, descendant, distance)})"""
    top = {}
    for e in entries:
        i = (e["id"] or "").strip()
        if i:
            top[i] = max(top.get(i, ("", "")), (e["timestamp"] or "", (e["parent_id"] or "").strip()))
    up = {i: p for i, (_, p) in top.items() if p in top}
    marks, pairs = {}, set()
    for i in top:
        met, x, n = {}, i, 0
        while x in up and x not in met:
            met[x] = n
            x, n = up[x], n + 1
        looped = x in met
        met.setdefault(x, n)
        marks[i] = None if not looped else "on" if x == i else "below"
        pairs |= {(a, i, d) for a, d in met.items() if a != i}
    return marks, pairs


def check(spark, entries):
    marks, pairs = all_descendants(latest_links(spark.createDataFrame(entries, "id string, parent_id string, timestamp string")))
    want_marks, want_pairs = below(entries)
    assert sorted((r.id, str(r.loop)) for r in marks.collect()) == sorted((i, str(m)) for i, m in want_marks.items())
    got = [tuple(r) for r in pairs.select("id", "descendant", "distance", "loop").collect()]
    assert len(got) == len(want_pairs) and {g[:3] for g in got} == want_pairs and all(want_marks[g[0]] == g[3] for g in got)


def test_small_loops(spark):
    entries = [("r", None), ("x", "r"), ("a", "c"), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("s", "s"), ("t", "s")]
    check(spark, [dict(id=i, parent_id=p, timestamp="t") for i, p in entries])


@pytest.mark.parametrize("seed", [3])
def test_random_graphs(spark, seed):
    pick = random.Random(seed)
    n = 200
    entries = [dict(id=f"n{i:03}", parent_id=f"n{max(0, i - pick.choice([1, 1, 1, 7])):03}" if i % 50 else None, timestamp="t") for i in range(n)]
    for a, far in ((20, 12), (70, 0), (120, 30), (160, 1)):
        entries[a]["parent_id"] = f"n{min(n - 1, a + far):03}"
    check(spark, entries)


def test_no_loops_and_no_rows(spark):
    check(spark, [dict(id="a", parent_id=None, timestamp="t"), dict(id="b", parent_id="a", timestamp="t")])
    check(spark, [])


def test_query_has_every_id(spark):
    marks, pairs = below(pq.read_table(f"{DATA}/catalog_entries.parquet", columns=["id", "parent_id", "timestamp"]).to_pylist())
    got = {r.id: (r.n_descendants, r.height, r.loop) for r in problems.p4_descendants(spark, DATA).collect()}
    want = {i: (len(d := [x for a, _, x in pairs if a == i]), max(d, default=0), m) for i, m in marks.items()}
    assert got == want
