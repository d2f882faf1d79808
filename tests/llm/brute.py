"""Plain-Python versions of the llm operators, for comparison on small inputs."""

from __future__ import annotations

import re

from tests.brute import instant


def boundary(text: str, size: int) -> str | None:
    if len(text) <= size:
        return None
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + [lines[-1]]
    groups, current = [], ""
    for line in lines:
        current += line
        if not line.strip() and line.endswith("\n"):
            groups.append(current)
            current = ""
    sentences = []
    for m in re.finditer(r".*?(?:\n|[.!?…][\"'”’»›)\]}“‘]*\s+|\Z)", text, re.S):
        sentences += re.split(r"(?<=\n)", m[0])
    for name, parts in (("paragraph", [*groups, current]), ("line", lines), ("sentence", sentences)):
        if max(map(len, parts)) <= size:
            return name
    return "none"


def verdicts(messages: list[dict], turns: list[dict], sessions: list[dict]) -> set[tuple]:
    zone = {}
    for s in sessions:
        zone[s["id"]] = zone.get(s["id"]) or s["tz"]
    said = {t["message_id"]: t for t in turns}
    rows: dict = {s["id"]: {} for s in sessions}
    for m in messages:
        if m["session_id"] is not None:
            rows.setdefault(m["session_id"], {})[m["id"]] = instant(m["time_created"], zone.get(m["session_id"]))
    out = set()
    for session, own in rows.items():
        roles, bad = [], session not in zone
        for when, i in sorted((w or "", i) for i, w in own.items()):
            turn = said.get(i)
            role = (turn["role"] or "").strip().lower() if turn else ""
            bad |= not when or role not in ("user", "assistant", "system")
            if role in ("user", "assistant") and any(c.isalnum() for c in turn["text"] or ""):
                roles.append(role)
        if bad:
            out.add((session, "broken"))
        elif not roles:
            out.add((session, "empty"))
        elif roles[0] != "user":
            out.add((session, "broken"))
        elif roles[-1] != "assistant":
            out.add((session, "unanswered"))
    return out


def plain_words(text: str) -> list[str]:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W_]+", bare)


def leaks(documents: list[dict], items: list[dict], n: int = 12) -> set[tuple]:
    grams: dict = {}
    for item in items:
        words = plain_words(item["text"])
        for k in range(len(words) - n + 1):
            grams.setdefault(tuple(words[k : k + n]), set()).add(item["item_id"])
    out = set()
    for d in documents:
        words = plain_words(d["text"])
        for k in range(len(words) - n + 1):
            for i in grams.get(tuple(words[k : k + n]), ()):
                out.add((d["doc_id"], i))
    return out


def shared(documents: list[dict], span: int) -> set[tuple]:
    owners: dict = {}
    for d in documents:
        for k in range(len(d["text"]) - span + 1):
            w = hash(d["text"][k : k + span])
            if owners.setdefault(w, d["doc_id"]) != d["doc_id"]:
                owners[w] = None
    out = set()
    for d in documents:
        covered = upto = 0
        for k in range(len(d["text"]) - span + 1):
            if owners[hash(d["text"][k : k + span])] is None:
                covered += k + span - max(k, upto)
                upto = k + span
        if covered:
            out.add((d["doc_id"], covered))
    return out
