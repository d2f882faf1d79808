"""Plain-Python versions of the general operators, for comparison on small inputs."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

MONTHS = {m[:3]: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
MONTHS_ES = {m: i + 1 for i, m in enumerate("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())}
LETTERS = {"UTC": 0, "GMT": 0, "Z": 0, "BST": 1, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "JST": 9}
ZONES = available_timezones()


def local(text: str) -> tuple[datetime, str] | None:
    for pattern, names in (
        (r"(\d{4})-?(\d\d)-?(\d\d)(?:[T ](\d\d):?(\d\d):?(\d\d)(?:[.,]\d+)?)? ?(.*)", "ymdHMSz"),
        (r"(?:[A-Z][a-z]+, )(\d+) ([A-Z][a-z]+) (\d{4}) (\d+):(\d+):(\d+) ?(.*)", "dbyHMSz"),
        (r"(\d\d)/(\d\d)/(\d\d(?:\d\d)?) (\d+):(\d+)(?::(\d+))?()", "dmyHMSz"),
        (r"(\d+) de (\w+) de (\d{4}), (\d+):(\d+)()()", "dbyHMSz"),
        (r"(\w+) (\d+), (\d{4}) (\d+):(\d+)() ([AP]M)", "bdyHMSz"),
    ):
        if found := re.fullmatch(pattern, text):
            x = dict(zip(names, found.groups()))
            try:
                month = int(x["m"]) if "m" in x else MONTHS_ES.get(x["b"].lower()) or MONTHS[x["b"].lower()[:3]]
                hour = int(x["H"] or 0)
                if x["z"] in ("AM", "PM"):
                    hour = hour % 12 + 12 * (x["z"] == "PM")
                    x["z"] = ""
                year = int(x["y"])
                return datetime(year + 2000 * (year < 100), month, int(x["d"]), hour, int(x["M"] or 0), int(x["S"] or 0)), x["z"]
            except (ValueError, KeyError):
                return None
    return None


def instant(raw: str | None, zone: str | None) -> str | None:
    if raw is None or not raw.strip():
        return None
    raw = raw.strip()
    if raw.isdigit():
        when = datetime(1970, 1, 1) + timedelta(seconds=int(raw) // {10: 1, 13: 10**3, 16: 10**6}[len(raw)])
    else:
        got = local(raw)
        if not got:
            return None
        when, z = got
        if found := re.match(r"([+-])(\d\d):?(\d\d)", z):
            when -= timedelta(minutes=int(found[1] + "1") * (int(found[2]) * 60 + int(found[3])))
        elif z in LETTERS:
            when -= timedelta(hours=LETTERS[z])
        else:
            name = z.strip("[]") or (zone if zone in ZONES else "UTC")
            if name not in ZONES:
                return None
            when = when.replace(tzinfo=ZoneInfo(name), fold=0).astimezone(timezone.utc)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ") if when.year > 999 else None


def key(text: str) -> str:
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower().split())


def versions(facts: list[dict]) -> set[tuple]:
    top: dict = {}
    for f in facts:
        when = instant(f["timestamp"], None)
        if when and f["value"] and f["value"].strip():
            k = (key(f["subject"]), key(f["attribute"]), when)
            top[k] = max(top.get(k, ("", "")), (f["fact_id"], key(f["value"])))
    out, before = set(), None
    for (s, a, when), (_, value) in sorted(top.items()):
        if before != (s, a, value):
            out.add((s, a, when))
        before = (s, a, value)
    return out


def tree(entries: list[dict]) -> set[tuple]:
    top: dict = {}
    for e in entries:
        i = (e["id"] or "").strip()
        if i:
            top[i] = max(top.get(i, ("", "")), (e["timestamp"] or "", (e["parent_id"] or "").strip()))
    up = {i: p for i, (_, p) in top.items() if p in top}
    out = set()
    for i in top:
        seen, x = [], i
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        out.add((i, min(seen[seen.index(x):]), -1) if x in seen else (i, x, len(seen)))
    return out
