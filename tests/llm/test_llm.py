import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.conversations import conversations, dropped_sessions
from tessera.llm.leakage import leaked_items, myers, words_of
from tessera.llm.packing import best_filling, byte_pair_counter, fillings, pack
from tessera.llm.pii import Finder, find_pii, placeholder, pseudonym, redact_pii
from tessera.llm.spans import candidate_starts, code_points, cuts, shared_characters, shared_spans
from tessera.llm.split import natural_boundary, refreshed_chunks, split_oversized, split_text
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def rows(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns) or None).to_pylist()


# ---------------------------------------------------------------- splitting
def test_boundaries_against_brute_force(spark):
    found = {tuple(r) for r in queries.p1_found(spark, DATA).collect()}
    assert found == {(b["block_id"], x) for b in rows("blocks") if (x := brute.boundary(b["text"], 3603))}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t\"é…\u0301", max_size=400), st.integers(20, 60), st.integers(0, 8))
def test_pieces_tile_the_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[body:end] for _, body, end, _ in pieces) == text
    for i, (start, body, end, _) in enumerate(pieces):
        assert end - start <= limit and (min(overlap, body) <= body - start < max(1, 2 * overlap) if i else body == 0)
        if i and start and any(a.isspace() and not b.isspace() for a, b in zip(text[body - 2 * overlap : body - overlap], text[body - 2 * overlap + 1 : body - overlap + 1])):
            assert text[start - 1].isspace() and not text[start].isspace()
    if len(text) > limit:
        assert natural_boundary(text, limit) == brute.boundary(text, limit)


def test_split_edges(spark):
    schema = "block_id bigint, source string, ord int, text string, start_line int, hard_boundary boolean, piece string"
    long = "One sentence here. " * 400
    made = [(1, "s", 0, long, 5, True, "clash"), (1, "s", 0, long, 5, True, "clash"), (2, "s", 1, None, 1, None, None), (3, "s", 2, "", 1, None, None), (None, "s", 3, "x" * 5000, None, None, None), (4, "s", 4, "line\n" * 2000, 10, None, None)]
    got = split_oversized(spark.createDataFrame(made, schema)).orderBy("block_id", "piece").collect()
    assert {r.block_id for r in got} == {None, 1, 4}
    for block, text in ((1, long), (4, "line\n" * 2000), (None, "x" * 5000)):
        own = [r for r in got if r.block_id == block]
        assert "".join(r.text[r.overlap_chars :] for r in own) == text and all(len(r.text) // 4 <= 900 for r in own)
        assert all(160 <= r.overlap_chars < 320 for r in own[1:]) and own[0].overlap_chars == 0
        assert all(block is None or r.text[0] in "Oshl" for r in own[1:])  # whole words
    assert [r.boundary for r in got if r.piece == 0] == ["none", "sentence", "line"]
    second = [r for r in got if r.block_id == 4][1]
    assert second.start_line == 10 + (second.body_offset - second.overlap_chars) // 5
    assert split_oversized(spark.createDataFrame([], schema)).count() == 0


def test_chunks_follow_their_text(spark):
    blocks = spark.createDataFrame([(1, "s", 0, "x" * 3000), (2, "s", 1, "y" * 604), (3, "s", 2, None)], "block_id bigint, source string, ord int, text string")
    chunks = spark.createDataFrame([(1, 1, 2, False), (2, 3, 3, True), (3, 9, 9, True), (1, 1, 2, False)], "chunk_id bigint, first_block_id bigint, last_block_id bigint, oversized boolean")
    assert {(r.chunk_id, r.oversized) for r in refreshed_chunks(chunks, blocks).collect()} == {(1, True), (2, False), (3, None)}


# ---------------------------------------------------------------- personal information
NAMES = [("Hadrel", "given"), ("Ulrika", "given"), ("Tarbeck", "family"), ("Peñarrubia", "family")]
CASES = [
    ("Regards, Hadrel Nordvik\nthe Tarbeck release", [("name", "Hadrel Nordvik")]),
    ("Ask Dr. penarrubia about it. It was Tarbeck, Hadrel who broke it", [("name", "Tarbeck, Hadrel")]),
    ("Voir avec Mme U. Peñarrubia. Project Tarbeck slipped", [("name", "U. Peñarrubia")]),
    ("hadrel tarbeck reviewed this; ULRIKA TARBECK too", [("name", "hadrel tarbeck"), ("name", "ULRIKA TARBECK")]),
    ("Regards, Corvin Zubel", [("name", "Corvin Zubel")]),
    ("mail <a.b@post.example.org>, x(at)team.test or x [at] post [dot] test.", [("email", "a.b@post.example.org"), ("email", "x(at)team.test"), ("email", "x [at] post [dot] test")]),
    ("pkg jelma@7.0.8 and @Override on Umber", []),
    ("Call (743) 555-0162 ext. 93, +49 30 23125-723 or 01.99.00.53.82.", [("phone", "(743) 555-0162 ext. 93"), ("phone", "+49 30 23125-723"), ("phone", "01.99.00.53.82")]),
    ("epoch 1752736110858, 192.0.2.247:9787, v3.15.0-rc3 on 28.02.2025, order 9738-9950, total 3,260,905", []),
    ("DNI 99.361.750-W, passport XZ5101558, QQ 76 99 16 C, 942-09-5785", [("id", "99.361.750-W"), ("id", "XZ5101558"), ("id", "QQ 76 99 16 C"), ("id", "942-09-5785")]),
    ("I live at Flat 17, 79 Ravensen Street, Tollhaven 38795, second door.", [("address", "Flat 17, 79 Ravensen Street, Tollhaven 38795")]),
    ("Vivo en Avda. de Hollin, 238B, 12915 Montecino. room 12, Road map 2024", [("address", "Avda. de Hollin, 238B, 12915 Montecino")]),
    ("J'habite 162, rue Hollin, 94274 Saint-Elvin. Ich wohne Am Larksenufer 27.", [("address", "162, rue Hollin, 94274 Saint-Elvin"), ("address", "Am Larksenufer 27")]),
    ("", []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_finding(text, expected):
    assert [(k, text[a:b]) for a, b, k in Finder(NAMES).find(text)] == expected


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"[+(]?[0-9A-Za-z][0-9A-Za-z .\-]{3,24}", fullmatch=True))
def test_pseudonyms_keep_their_format(value):
    made = pseudonym(value, b"k")
    assert len(made) == len(value) and pseudonym(made, b"k", backwards=True) == value
    assert all(a == b or a.isalnum() and b.isalnum() and a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(value, made))


def test_pseudonyms_are_a_permutation():
    assert len({pseudonym(f"{i:03}", b"k") for i in range(1000)}) == 1000
    assert placeholder("Ana Díaz", "name", b"k") == placeholder("DÍAZ, Ana", "name", b"k") != placeholder("Ana Díaz", "name", b"j")


def test_redaction(spark):
    schema = "kind string, rec_key string, text string, pii_type string"
    made = [("turn", "1", "Call 617-555-0176, Hadrel Tarbeck", "clash"), ("turn", "1", "Call 617-555-0176, Hadrel Tarbeck", "clash"), ("turn", "2", None, None), (None, None, "617-555-0176" + " word" * 50000, None)]
    names = spark.createDataFrame(NAMES + [(None, None)], "name string, kind string")
    texts = spark.createDataFrame(made, schema)
    clean = redact_pii(texts, names, b"key").collect()
    assert len(clean) == 4 and clean[2].text is None and "617-555-0176" not in clean[0].text and "Hadrel" not in clean[0].text
    assert clean[0].text[5 : 5 + 20] == clean[3].text[:20]  # equal values stay linked
    assert find_pii(texts, names).where("pii_type = 'phone'").count() == 3
    assert find_pii(texts.limit(0), names.limit(0)).count() == 0


# ---------------------------------------------------------------- conversations
def test_conversations_against_brute_force(spark):
    messages, turns, sessions = rows("messages"), rows("turns"), rows("sessions")
    found = {tuple(r) for r in queries.p6_found(spark, DATA).collect()}
    assert found == brute.verdicts(messages, turns, sessions)
    told = queries.p6_conversations(spark, DATA).collect()
    dropped = {s for s, _ in found}
    assert told and not {r.session_id for r in told} & dropped
    for session in {r.session_id for r in told}:
        own = sorted((r for r in told if r.session_id == session), key=lambda r: r.position)
        assert own[0].role == "user" and own[-1].role == "assistant"


def test_conversation_edges(spark):
    m = "id string, session_id string, time_created string, data string, symbol int"
    t = "message_id string, session_id string, role string, text string, part int"
    s = "id string, tz string, listed int"
    messages = [("a1", "A", "2024-01-01T00:00:02Z", None, 0), ("a0", "A", "2024-01-01T00:00:01Z", None, 0), ("a0", "A", "1704067201", None, 0), ("b1", "B", "2024-01-01", None, 0), ("c1", "C", "never", None, 0), ("d1", "D", "2024-01-01", None, 0), ("e1", None, "2024-01-01", None, 0), ("f1", "F", "2024-01-01", None, 0), ("f2", "F", "2024-01-01", None, 0)]
    turns = [("a0", "A", " USER ", "hi", 0), ("a0", "A", " USER ", "hi", 0), ("a1", "A", "assistant", "yes", 0), ("b1", "B", "user", "...", 0), ("c1", "C", "user", "x", 0), ("d1", "D", "user", "x", 0), ("f1", "F", "assistant", "x", 0), ("f2", "F", "user", "x", 0), (None, "F", None, None, 0)]
    sessions = [("A", "UTC", 0), ("A", None, 0), ("B", None, 0), ("C", None, 0), ("E", None, 0), ("F", "UTC", 0), (None, None, 0)]
    frames = spark.createDataFrame(messages, m), spark.createDataFrame(turns, t), spark.createDataFrame(sessions, s)
    assert {tuple(r) for r in dropped_sessions(*frames).collect()} == {("B", "empty"), ("C", "broken"), ("D", "broken"), ("E", "empty"), ("F", "broken")}
    assert [(r.session_id, r.role, r.text) for r in conversations(*frames).orderBy("position").collect()] == [("A", "user", "hi"), ("A", "assistant", "yes")]
    assert dropped_sessions(*(f.limit(0) for f in frames)).count() == 0


# ---------------------------------------------------------------- containers
@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8))
def test_best_filling_is_best(counts):
    filling = best_filling(counts, 40)
    assert max(counts) in filling and all(filling[x] <= counts[x] for x in filling)
    sums = {max(counts)}
    for x, c in counts.items():
        for _ in range(c - (x == max(counts))):
            sums |= {s + x for s in sums if s + x <= 40}
    assert sum(x * k for x, k in filling.items()) == max(sums)


def test_fillings_use_every_item():
    counts = {x: x % 7 + 1 for x in range(1, 300)}
    used = dict.fromkeys(counts, 0)
    for times, filling in fillings(counts, 512):
        assert sum(x * k for x, k in filling.items()) <= 512
        for x, k in filling.items():
            used[x] += k * times
    assert used == counts


def test_packing(spark):
    texts = ["word " * n for n in range(1, 200)] + ["", None, "many words " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, "lost", "x")], "doc_id bigint, text string, piece string")
    got = pack(docs, byte_pair_counter(queries.VOCABULARY), 512).collect()
    count = byte_pair_counter(queries.VOCABULARY)()
    size = {}
    for r in got:
        if r.container is not None:
            size[r.container] = size.get(r.container, 0) + r.n_tokens
    assert max(size.values()) <= 512 and sorted(size) == list(range(len(size)))
    assert len(size) <= -(-sum(size.values()) // 512) + 2
    for i, t in enumerate(texts):
        own = [r for r in got if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == count([t])[0] * (2 if i == 5 else 1)
        assert i == 5 or len({(r.piece, r.container) for r in own}) == len(own)
    assert len([r for r in got if r.doc_id == 10]) == 1 and len([r for r in got if r.doc_id == 201]) > 5
    assert pack(docs.limit(0), byte_pair_counter(queries.VOCABULARY)).count() == 0


def test_a_missing_vocabulary_is_named():
    with pytest.raises(FileNotFoundError, match="/no/such/file"):
        byte_pair_counter("/no/such/file")()


# ---------------------------------------------------------------- leaked items
def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    best = len(a)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if a else 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=14), st.lists(st.sampled_from("abcd"), max_size=30))
def test_myers(pattern, text):
    assert myers(pattern, text) == edit_distance(pattern, text)


def test_leaks_against_brute_force(spark):
    found = {tuple(r) for r in queries.p8_found(spark, DATA).collect()}
    assert found == brute.leaks(rows("documents"), rows("eval_items"))


def test_near_leaks(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(pick.choices(words, k=20)), "x") for i in range(10)]
    docs = []
    for k in range(40):
        own = items[k % 10][1].split()
        at = pick.randrange(8)
        passage = own[at : at + 12]
        for _ in range(k % 4):
            j = pick.randrange(len(passage))
            passage[j : j + 1] = pick.choice([[], ["new"], [passage[j], "ins"]])
        docs.append((k, " ".join(pick.choices(["Ära", "x-y", "zz"], k=9) + passage + ["tail"] * 5), 0))
    docs += [(100, None, 0), (None, items[0][1], 0), (101, "", 0), (0, docs[0][1], 0)]
    got = {(r.doc_id, r.item_id): r.distance for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string, words int"), spark.createDataFrame(items + [(99, "too short", "x"), (None, "x", "x"), (98, None, "x")], "item_id bigint, text string, distance string")).collect()}
    for k, text, _ in docs[:40]:
        for i, item, _ in items:
            own, said = words_of(item), words_of(text)
            true = min(edit_distance(own[j : j + 12], said) for j in range(len(own) - 11))
            assert got.get((k, i)) == (true if true <= 2 else None)


# ---------------------------------------------------------------- shared spans
def test_shared_against_brute_force(spark):
    found = {tuple(r) for r in queries.p9_found(spark, DATA).collect()}
    assert found == brute.shared(rows("documents", "doc_id", "text"), 200)


def test_shared_spans_planted(spark):
    pick = random.Random(5)
    text = lambda n: "".join(pick.choices("abcdefghij klmnop\nß€😀", k=n))
    shared = [text(n) for n in (199, 200, 201, 350, 900)]
    docs = [(i, text(pick.randrange(300)) + pick.choice(shared)[pick.randrange(3) :] + text(pick.randrange(300)), 0) for i in range(60)]
    docs += [(100, shared[4] * 2, 0), (101, "z" * 700, 0), (102, "z" * 300 + "y" * 300, 0), (103, docs[0][1], 0), (104, docs[0][1], 0), (104, docs[0][1], 0), (105, "", 0)]
    frame = spark.createDataFrame(docs + [(106, None, 0), (None, docs[0][1], 0)], "doc_id bigint, text string, start int")
    expected = brute.shared([dict(doc_id=i, text=t) for i, t, _ in {d[0]: d for d in docs}.values()], 200)
    assert {tuple(r) for r in shared_characters(frame).collect()} == expected
    spans = shared_spans(frame).groupBy("doc_id").sum("length").collect()
    assert {tuple(r) for r in spans} == expected
    assert shared_characters(frame.limit(0)).count() == 0


def test_nothing_is_broadcast_beyond_its_bound(spark, monkeypatch):
    import tessera.llm.spans as spans
    import tessera.session as session

    want = {tuple(r) for r in queries.p9_found(spark, DATA).collect()}
    monkeypatch.setattr(spans, "NARROW_ROWS", 0)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        result = queries.p9_found(spark, DATA)
        assert {tuple(r) for r in result.collect()} == want
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_items_in_several_passes(spark, monkeypatch):
    import tessera.llm.leakage as leakage

    want = {tuple(r) for r in queries.p8_found(spark, DATA).collect()}
    monkeypatch.setattr(leakage, "CHARS_A_PASS", 6000)
    assert {tuple(r) for r in queries.p8_found(spark, DATA).collect()} == want


def test_every_shared_window_is_a_candidate():
    pick = np.random.default_rng(1)
    common = pick.integers(97, 105, 260)
    a, b = (np.concatenate([pick.integers(97, 105, n), common, pick.integers(97, 105, 500)]).astype(np.uint32) for n in (333, 71))
    own = set(map(bytes, np.lib.stride_tricks.sliding_window_view(b, 200)[71 : 71 + 61]))
    places = cuts(a)
    flagged = np.flatnonzero([333 <= p - 31 and q < 333 + 260 for p, q in zip(places, places[1:])])
    starts = set(candidate_starts(a, flagged, 200))
    assert {i for i in range(len(a) - 199) if bytes(a[i : i + 200]) in own} <= starts


def test_cuts_do_not_depend_on_slabs():
    import tessera.llm.spans as spans

    codes = code_points("".join(random.Random(2).choices("abcdefgh ", k=30_000)))
    whole, slab = cuts(codes), spans._SLAB
    try:
        spans._SLAB = 1000
        assert (cuts(codes) == whole).all()
    finally:
        spans._SLAB = slab
