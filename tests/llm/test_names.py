"""Names that no list has, in sentences of other frames than those the model is fitted on."""

import pandas as pd
import pytest

from tessera.llm.names import bare, capital, learn
from tessera.llm.pii import Finder
from tests.llm.heldout import NAMED, NAMELESS

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def finder():
    texts = pd.concat([pd.read_parquet(f"{DATA}/turns.parquet", columns=["text"]).text, pd.read_parquet(f"{DATA}/leaves.parquet", columns=["content"]).content]).dropna()
    names = pd.read_parquet(f"{DATA}/known_names.parquet").values.tolist()
    model = learn([t for t in texts if len(t) <= 4000], {bare(n) for n, k in names if k == "given"}, {bare(n) for n, k in names if k != "given"})
    return Finder(names, model)


def test_held_out_frames(finder):
    true = found = both = 0
    for line in NAMED + NAMELESS:
        parts = line.split("*")
        text, want, at = "".join(parts), set(), 0
        for i, part in enumerate(parts):
            if i % 2:
                want.add((at, at + len(part)))
            at += len(part)
        got = {(a, b) for a, b, kind in finder.find(text) if kind == "name"}
        true, found, both = true + len(want), found + len(got), both + len(want & got)
        if want != got:
            print(text, [text[a:b] for a, b in got ^ want])
    print("recall", both / true, "precision", both / found)
    assert both / true >= 0.9 and both / found >= 0.9


def test_parts_are_learned_from_known_partners():
    texts = ["We saw Ana Velmora.", "Velmora, Ana came.", "Then Berta Velmora left.", "with berta velmora", "Project Zuloaga and Project Ibarra", "Zuloaga, Ana"] * 3
    model = learn(texts, {"ana", "berta"}, {"zuloaga", "ibarra"})
    assert model.family == {"velmora"} and not model.given
    finder = Finder([("Ana", "given"), ("Berta", "given"), ("Zuloaga", "family")], model)
    assert [t for t in ("K. Velmora", "KIRA VELMORA", "Kira Velmora", "Velmora, Ana") if finder.find(t) != [(0, len(t), "name")]] == []
    assert finder.find("Project Velmora") == []
    assert not learn([], {"ana"}, set()).family


def test_shapes():
    assert [w for w in ("Ana", "O'Brien", "McAdam", "LÜDENHOFF", "Jean-Luc", "DeVries") if not capital(w)] == []
    assert [w for w in ("ana", "A", "AnchorQuill", "iPhone", "XR") if capital(w)] == []


def test_long_texts_take_linear_time(finder):
    import time

    for text in ("00" + "1" * 50_000, "00 " + "12 " * 20_000, "a@b.example " * 8_000, "Ana Bo " * 10_000, "x" * 200_000):
        began = time.time()
        finder.find(text)
        assert time.time() - began < 5
