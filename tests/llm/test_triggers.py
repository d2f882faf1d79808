"""The gate lets every text through in which a pattern matches."""

import pytest

from tessera.llm.pii import Finder

FINDER = Finder([("Hadrel", "given"), ("Am", "given"), ("At", "family")])
CASES = [
    ("Regards,\nCorvin Zubel", "name"), ("Cheers,\tCorvin Zubel", "name"), ("Dra Corvin Zubel", "name"), ("x\nMs Corvin Zubel", "name"), ("(Sr Corvin Zubel)", "name"),
    ("12 Oak St\nnext", "address"), ("(12 Oak St)", "address"), ("12 Oak St: here", "address"), ("(Am Markt 5)", "address"), ("Av.Markt 5", "address"), ("x\tIm Winkel 5", "address"),
    ("x\nat\nteam dot test", "email"), ("x(at\n)team.test", "email"),
]


@pytest.mark.parametrize("text, kind", CASES)
def test_found(text, kind):
    assert kind in [k for _, _, k in FINDER.find(text)]


@pytest.mark.parametrize("text", [t for t, _ in CASES])
def test_same_as_without_the_gate(text, monkeypatch):
    found = FINDER.find(text)
    monkeypatch.setattr(FINDER, "hints", lambda text: 31)
    assert FINDER.find(text) == found
