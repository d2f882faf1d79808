"""Keyed pseudonyms of numbers and dates: permuted within their format, the same for every spelling of a value.

A value is first brought to one form: a phone number to its national digits, an identity number to its letters and
digits, a date to its day in the calendar. That form is permuted among the values of its class, which keeps what can be
tested (a right check letter, key or digit, a real month, a real date), and is written back the way the value was.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator, Sequence
from datetime import date

_DIGITS, _CAPITALS = string.digits, string.ascii_uppercase
_MONTHS12 = tuple(f"{m:02}" for m in range(1, 13))


def _round(key: bytes, tweak: str, turn: int, half: int, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}:{turn}:{half}".encode(), key=key, digest_size=16).digest()) % modulus


def _feistel(numbers: list[int], radix: list[int], key: bytes, tweak: str, backwards: bool = False) -> list[int]:
    """A bijection on the numbers in mixed radix: a Feistel network over two halves."""
    middle = len(numbers) // 2
    sides, moduli = [0, 0], [1, 1]
    for k, (n, r) in enumerate(zip(numbers, radix)):
        side = k >= middle
        sides[side], moduli[side] = sides[side] * r + n, moduli[side] * r
    turns = range(10)
    for turn in reversed(turns) if backwards else turns:
        side = turn % 2
        shift = _round(key, tweak, turn, sides[1 - side], moduli[side])
        sides[side] = (sides[side] + (-shift if backwards else shift)) % moduli[side]
    out = list(numbers)
    for k in reversed(range(len(numbers))):
        side = k >= middle
        sides[side], out[k] = divmod(sides[side], radix[k])
    return out


def pseudonym(value: str, key: bytes, backwards: bool = False) -> str:
    """`value` with its digits and ASCII letters permuted within their format; other characters stay.

    Ten places for digits and twenty-six for letters; case stays. The map is a bijection on the values of one format,
    undone by `backwards`."""
    places = [i for i, c in enumerate(value) if c in string.ascii_letters or c in string.digits]
    if not places:
        return value
    radix = [10 if value[i] in string.digits else 26 for i in places]
    numbers = [int(value[i]) if value[i] in string.digits else ord(value[i].lower()) - 97 for i in places]
    tweak = "".join("9" if c in string.digits else "a" if c in string.ascii_letters else c for c in value)
    out = list(value)
    for i, r, n in zip(places, radix, _feistel(numbers, radix, key, tweak, backwards)):
        out[i] = str(n) if r == 10 else chr(n + (97 if value[i].islower() else 65))
    return "".join(out)


def _walk(fields: list[str], alphabets: list[Sequence[str]], key: bytes, tweak: str, same: Callable[[str], object]) -> str:
    """The fields permuted over their alphabets until the result has the class `same` of what went in: a bijection on the class."""
    numbers, radix = [a.index(f) for f, a in zip(fields, alphabets)], [len(a) for a in alphabets]
    wanted = same("".join(fields))
    while True:
        numbers = _feistel(numbers, radix, key, tweak)
        made = "".join(a[n] for a, n in zip(alphabets, numbers))
        if same(made) == wanted:
            return made


def _compact(value: str) -> str:
    """Letters and digits alone, in capitals, digits of any script as ASCII."""
    return "".join(str(int(c)) if c.isdecimal() else c.upper() for c in value if c.isdecimal() or c in string.ascii_letters)


def _written(value: str, compact: str) -> str:
    """`compact` in the places of the letters and digits of `value`, in their case and script."""
    rest = iter(compact)
    out = []
    for c in value:
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + int(next(rest))))
        elif c in string.ascii_letters:
            out.append(next(rest).lower() if c.islower() else next(rest))
        else:
            out.append(c)
    return "".join(out)


# ---------------------------------------------------------------- phones
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_OUTSIDE = re.compile(r"[A-Za-z#]")


def _prefix(number: str, digits: str) -> int:
    """How many digits stand before the national number: exit code, country, trunk 0 or 1."""
    at = 0
    if number.startswith("+") or digits.startswith("00"):
        at = 0 if number.startswith("+") else 2
        at += 1 if digits[at : at + 1] in ("1", "7") else 2 if digits[at : at + 2] in _TWO else 3
    elif len(digits) == 11 and digits[0] == "1":
        at = 1
    at += digits[at : at + 1] == "0"
    return at if at < len(digits) - 3 else 0


def phone(value: str, key: bytes) -> str:
    """The national number is permuted; exit code, country, trunk prefix and the word for an extension stay.

    So a number is linked in all its spellings, with a country or without. One without a country is taken for any
    country's. The first digit stays other than 0, and where they are so, area and exchange begin with 2 to 9."""
    cut = m.start() if (m := _OUTSIDE.search(value)) else len(value)
    number, extension = value[:cut], value[cut:]
    digits = _compact(number)
    at = _prefix(number, digits)
    core = digits[at:]
    same = lambda d: (d[0] == "0", d[0] in "01", len(d) == 10 and d[3] in "01")
    made = _walk(list(core), [_DIGITS] * len(core), key, f"phone {len(core)}", same) if core else ""
    inner = "".join(str(int(c)) for c in extension if c.isdecimal())
    added = iter(_walk(list(inner), [_DIGITS] * len(inner), key, f"extension {core}", len) if inner else "")
    return _written(number, digits[:at] + made) + "".join(chr(ord(c) - int(c) + int(next(added))) if c.isdecimal() else c for c in extension)


# ---------------------------------------------------------------- identity numbers
_DNI, _GERMAN = "TRWAGMYFPDXBNJZSQVHLCKE", "CFGHJKLMNPRTVWXYZ"
_SCHEMES = {
    "dni": re.compile(rf"\d{{7,8}}[{_DNI}]"),
    "nie": re.compile(rf"[XYZ]\d{{7}}[{_DNI}]"),
    "nino": re.compile(r"[A-Z]{2}\d{6}[A-D]"),
    "nir": re.compile(r"\d{15}"),
    "tax": re.compile(r"\d{11}"),
    "ssn": re.compile(r"\d{9}"),
    "passport": re.compile(rf"[{_GERMAN}][\d{_GERMAN}]{{8}}\d"),
}


def scheme(compact: str) -> str:
    return next((name for name, form in _SCHEMES.items() if form.fullmatch(compact)), "")


def _tax_digit(ten: str) -> int:
    """ISO 7064, MOD 11,10."""
    product = 10
    for c in ten:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10


def _mrz_digit(text: str) -> int:
    return sum((int(c) if c.isdigit() else ord(c) - 55) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10


def _check(kind: str, body: str) -> tuple[int, int] | None:
    """(right check value, modulus) of a number without its check characters; None if the scheme has none."""
    if kind in ("dni", "nie"):
        return int(body.translate(str.maketrans("XYZ", "012"))) % 23, 23
    if kind == "nir":
        return 97 - int(body) % 97, 97
    if kind == "tax":
        return _tax_digit(body), 10
    return (_mrz_digit(body), 10) if kind == "passport" else None


def _split(kind: str, compact: str) -> tuple[str, str]:
    n = {"dni": 1, "nie": 1, "nir": 2, "tax": 1, "passport": 1}.get(kind, 0)
    return (compact[:-n], compact[-n:]) if n else (compact, "")


def valid(compact: str) -> bool | None:
    """Whether a number is right by the rules of its scheme; None where no scheme is known."""
    kind = scheme(compact)
    body, last = _split(kind, compact)
    if found := _check(kind, body):
        return (_DNI.index(last) if kind in ("dni", "nie") else int(last)) == found[0] and _sound(kind, body)
    return _sound(kind, body) if kind else None


def _sound(kind: str, body: str) -> bool:
    """The rules besides the check characters."""
    if kind == "ssn":
        return body[:3] not in ("000", "666") and body[0] != "9" and body[3:5] != "00" and body[5:] != "0000"
    if kind == "nino":
        return body[0] not in "DFIQUV" and body[1] not in "DFIOQUV" and body[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
    if kind == "nir":
        return body[0] in "12" and body[3:5] in _MONTHS12
    if kind == "tax":
        times = sorted(body.count(d) for d in set(body))
        return body[0] != "0" and times[-1] in (2, 3) and times[:-1] == [1] * (len(times) - 1)
    return True


def identity(value: str, key: bytes) -> str:
    """An identity number permuted among those of its scheme, or of its format where no scheme is known.

    Check characters are set anew, as far from the right ones as they were, so that right numbers stay right and wrong
    ones wrong. Spaces, marks and case do not matter and stay."""
    compact = _compact(value)
    kind = scheme(compact)
    body, last = _split(kind, compact)
    short = kind == "dni" and len(body) == 7  # written without its leading 0
    body = "0" + body if short else body
    shape = "".join("9" if c.isdigit() else "a" for c in compact)
    fields, alphabets = list(body), [_DIGITS if c.isdigit() else _GERMAN if kind == "passport" else _CAPITALS for c in body]
    same: Callable[[str], object] = lambda b: _sound(kind, b)
    if kind == "dni":
        same = lambda b: b[0] == "0"
    elif kind == "nie":
        alphabets[0] = "XYZ"
    elif kind == "nino":
        alphabets[-1] = "ABCD"
    elif kind == "nir" and _sound(kind, body):
        fields, alphabets = [body[0], *body[1:3], body[3:5], *body[5:]], ["12", _DIGITS, _DIGITS, _MONTHS12, *[_DIGITS] * 8]
    elif not kind:
        same = scheme
    tweak = f"id {kind or shape}"
    made = _walk(fields, alphabets, key, tweak, same)
    found, after = _check(kind, body), _check(kind, made)
    if found and kind in ("dni", "nie"):
        last = _DNI[(_DNI.index(last) - found[0] + after[0]) % 23]
    elif kind == "nir" and 1 <= int(last) <= 97:
        last = f"{(int(last) - found[0] + after[0] - 1) % 97 + 1:02}"
    elif found and kind != "nir":
        last = str((int(last) - found[0] + after[0]) % 10)
    return _written(value, made[short:] + last)


# ---------------------------------------------------------------- dates
_NAMES = {
    "en": "January February March April May June July August September October November December",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "en short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "es short": "ene feb mar abr may jun jul ago sep oct nov dic",
    "de short": "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez",
    "fr short": "janv févr mars avr mai juin juil août sept oct nov déc",
}
_TABLES = {k: v.split() for k, v in _NAMES.items()}
_MONTH = "|".join(sorted({n for names in _TABLES.values() for n in names}, key=lambda n: (-len(n), n)))
_DATE = re.compile(
    r"(?<![\w./:@+-])(?:"
    r"(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2})(?=T\d\d:|(?!\w|[./-]\d))"
    r"|(?P<a2>\d{1,2})(?P<s2>[-/.])(?P<b2>\d{1,2})(?P=s2)(?P<y2>\d{4}|\d\d(?!\d))(?!\w|[./-]\d)"
    rf"|(?P<d3>\d{{1,2}})(?P<o3>st|nd|rd|th|er)?(?:\.? |-| de | of )(?P<n3>{_MONTH})\b\.?(?:,? |-| de | del )(?P<y3>\d{{4}})(?!\w|[./-]\d)"
    rf"|(?P<n4>{_MONTH})\b\.? (?P<d4>\d{{1,2}})(?P<o4>st|nd|rd|th)?,? (?P<y4>\d{{4}})(?!\w|[./-]\d)"
    r")",
    re.IGNORECASE,
)
#: Stands in every date.
DATED = re.compile(r"\d\d[-/.]\d|\d[-/.]\d\d|(?i:[a-z]\.?(?:,? |-)\d{4}|\d,? \d{4})")


def _month(name: str, value: str) -> tuple[str, int]:
    """(table, number) of a month's name; of languages that share it, the one whose way of writing dates is `value`'s."""
    language = "de" if re.search(r"\d\. ", value) else "es" if " de " in value.lower() else "fr" if name.islower() else "en"
    known = [(t, i + 1) for t, names in _TABLES.items() for i, n in enumerate(names) if n.lower() == name.lower()]
    return next((k for k in known if k[0].startswith(language)), known[0])


def _real(year: str, month: int, day: str) -> date | None:
    try:
        return date(2000 + int(year) if len(year) == 2 else int(year), month, int(day))
    except ValueError:
        return None


def _read(m: re.Match) -> tuple[date | None, bool]:
    """(the date, whether its month stands first); slashed dates are day first unless only the other way is real."""
    if m["y1"]:
        return _real(m["y1"], int(m["m1"]), m["d1"]), False
    if m["y2"]:
        day_first = _real(m["y2"], int(m["b2"]), m["a2"])
        return (day_first, False) if day_first or m["s2"] != "/" else (_real(m["y2"], int(m["a2"]), m["b2"]), True)
    return _real(m["y3"] or m["y4"], _month(m["n3"] or m["n4"], m[0])[1], m["d3"] or m["d4"]), False


def find_dates(text: str) -> Iterator[tuple[int, int]]:
    """Spans that name a real date, with day, month and year."""
    if DATED.search(text):
        for m in _DATE.finditer(text):
            if _read(m)[0]:
                yield m.span()


def permuted_date(day: date, key: bytes) -> date:
    """A date of the same century, after the 12th of its month if `day` is: a bijection on those."""
    century = day.year // 100
    first = date(max(century * 100, 1), 1, 1).toordinal()
    count = (date(century * 100 + 99, 12, 31).toordinal() - first) + 1
    at = day.toordinal() - first
    while True:
        at = _feistel([at // 192, at % 192], [-(-count // 192), 192], key, f"date {century}")
        at = at[0] * 192 + at[1]
        if at < count and (date.fromordinal(first + at).day > 12) == (day.day > 12):
            return date.fromordinal(first + at)


def calendar_date(value: str, key: bytes) -> str:
    """A date as found by find_dates, permuted and written the way it was, in its language."""
    m = _DATE.fullmatch(value)
    day, month_first = _read(m)
    new = permuted_date(day, key)
    put: list[tuple[str, str]] = []
    sized = lambda group, n: put.append((group, f"{n:0{len(m[group])}}"))
    if m["y1"]:
        sized("y1", new.year), sized("m1", new.month), sized("d1", new.day)
    elif m["y2"]:
        sized("a2", new.month if month_first else new.day), sized("b2", new.day if month_first else new.month)
        sized("y2", new.year % 100 if len(m["y2"]) == 2 else new.year)
    else:
        k = "3" if m["y3"] else "4"
        name = _TABLES[_month(m[f"n{k}"], value)[0]][new.month - 1]
        put.append((f"n{k}", name.upper() if m[f"n{k}"].isupper() else name.lower() if m[f"n{k}"].islower() else name.capitalize()))
        sized(f"d{k}", new.day), sized(f"y{k}", new.year)
        if m[f"o{k}"]:
            english = "th" if 11 <= new.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
            put.append((f"o{k}", ("er" if new.day == 1 else "") if m[f"o{k}"].lower() == "er" else english))
    out, at = [], 0
    for (a, b), written in sorted((m.span(g), w) for g, w in put):
        out += [value[at:a], written]
        at = b
    return "".join([*out, value[at:]])
