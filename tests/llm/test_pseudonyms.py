"""Pseudonyms of numbers and dates: linked across spellings, right numbers stay right, distinct values stay distinct."""

import random
import re
from datetime import date, timedelta

import pytest

from tessera.llm.pii import Finder, placeholder, redact, with_dates
from tessera.llm.pseudonyms import _DNI, _tax_digit, calendar_date, find_dates, identity, permuted_date, phone, scheme, valid

KEY = b"k"


def digits(text):
    return re.sub(r"\D", "", text)


@pytest.mark.parametrize(
    "one, other, n",
    [
        ("+44 20 7946 0353", "(020) 7946-0353", 10),
        ("0049 (0)30 23125043", "+49 30 23125-043", 10),
        ("01.99.00.95.57", "+33 1 99 00 95 57", 9),
        ("16125550104", "612-555-0104", 10),
        ("+34 612 345 678", "612345678", 9),
    ],
)
def test_phones_are_linked(one, other, n):
    made = phone(one, KEY), phone(other, KEY)
    assert digits(made[0])[-n:] == digits(made[1])[-n:] != digits(one)[-n:]
    assert [re.sub(r"\d", "9", x) for x in made] == [re.sub(r"\d", "9", x) for x in (one, other)]


def test_phones_keep_prefix_and_words():
    assert phone("+44 20 7946 0353", KEY).startswith("+44 ")
    with_extension = phone("525 555 0180 ext. 54", KEY)
    assert re.fullmatch(r"\d{3} \d{3} \d{4} ext\. \d\d", with_extension) and with_extension.startswith(phone("525-555-0180", KEY).replace("-", " "))
    assert len({phone(f"20 7946 {i:04}", KEY) for i in range(2000)}) == 2000
    assert phone("٠٢٠ ٧٩٤٦ ٠٣٥٣", KEY) != "٠٢٠ ٧٩٤٦ ٠٣٥٣"


def numbers(kind, n=300):
    pick = random.Random(kind)
    for _ in range(n):
        d = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
        if kind == "dni":
            yield (b := d(8)) + _DNI[int(b) % 23]
        elif kind == "nie":
            yield (b := pick.choice("XYZ") + d(7)) + _DNI[int(b.translate(str.maketrans("XYZ", "012"))) % 23]
        elif kind == "nir":
            yield (b := pick.choice("12") + d(2) + f"{pick.randint(1, 12):02}" + d(8)) + f"{97 - int(b) % 97:02}"
        elif kind == "tax":
            b = "".join(pick.sample("123456789", 9))
            yield (b := b + pick.choice(b)) + str(_tax_digit(b))
        elif kind == "ssn":
            yield f"{pick.randint(1, 665):03}{pick.randint(1, 99):02}{pick.randint(1, 9999):04}"
        else:
            yield "AB" + d(6) + pick.choice("ABCD")


@pytest.mark.parametrize("kind", ["dni", "nie", "nir", "tax", "ssn", "nino"])
def test_right_numbers_stay_right(kind):
    given = set(numbers(kind))
    assert all(valid(x) for x in given) and {scheme(x) for x in given} == {kind}
    made = {identity(x, KEY) for x in given}
    assert len(made) == len(given) and all(valid(x) for x in made) and {scheme(x) for x in made} == {kind}
    if kind in ("dni", "tax", "nir"):  # a wrong check character stays wrong
        wrong = {x[:-1] + (_DNI[(_DNI.index(x[-1]) + 1) % 23] if kind == "dni" else str((int(x[-1]) + 1) % 10)) for x in given}
        made = {identity(x, KEY) for x in wrong}
        assert len(made) == len(wrong) and not any(valid(x) for x in made)


def test_known_check_characters():
    assert valid("12345678Z") and not valid("12345678A") and valid("X1234567L") and valid("86095742719") and not valid("86095742718") and valid("255081416802538") and not valid("255081416802537")
    assert valid("123456789") and not valid("942095785") and not valid("QQ123456C") and valid("AB123456C") and valid("XZ5101558") is None
    assert valid("T220001293") and not valid("T220001294")


def test_identity_numbers_are_linked():
    for one, other in (("99.361.750-W", "99361750w"), ("QQ 76 99 16 C", "QQ769916C"), ("905 16 2370", "905-16-2370"), ("9 30 11 99 498 492 96", "930119949849296"), ("09.361.750-W", "9.361.750-W")):
        a, b = (re.sub(r"\W", "", identity(x, KEY)).upper() for x in (one, other))
        assert a.lstrip("0") == b.lstrip("0") and a != re.sub(r"\W", "", one).upper()
    assert {valid(re.sub(r"\W", "", identity(f"9{i:02}-58-9090", KEY))) for i in range(50)} == {False}


SPELLINGS = ["2024-03-21", "21.03.2024", "21/03/2024", "21/03/24", "March 21, 2024", "21st March 2024", "21. März 2024", "21 de marzo de 2024", "21 mars 2024", "03/21/2024"]


def test_dates_are_linked_and_real():
    new = permuted_date(date(2024, 3, 21), KEY)
    assert new != date(2024, 3, 21)
    made = [calendar_date(x, KEY) for x in SPELLINGS]
    assert made[0] == new.isoformat() and made[1] == f"{new:%d.%m.%Y}" and made[2] == f"{new:%d/%m/%Y}" and made[3] == f"{new:%d/%m/%y}"
    assert made[4] == f"{new:%B} {new.day}, {new.year}" and made[9] == f"{new:%m/%d/%Y}"
    for x in made:
        assert list(find_dates(x)) == [(0, len(x))]
    days = [date(1999, 6, 1) + timedelta(i) for i in range(500)]
    assert len({permuted_date(d, KEY) for d in days}) == 500 and all(permuted_date(d, KEY).year // 100 == d.year // 100 for d in days)
    assert [list(find_dates(x)) for x in ("31.02.2024", "v1.2.2024.5", "3.15.0-rc3", "192.0.2.247", "")] == [[]] * 5


def test_redaction_links_and_takes_dates():
    finder = Finder([])
    clean = lambda t: redact(t, with_dates(t, finder.find(t)), KEY)
    assert clean("Seen on 2024-03-21.") == f"Seen on [DATE {calendar_date('2024-03-21', KEY)}]."
    assert clean("On 2024-03-21T10:00:00Z") == f"On [DATE {calendar_date('2024-03-21', KEY)}]T10:00:00Z"
    assert clean("x@team.test") == clean("x(at)team.test") == clean("X [at] team [dot] test") == clean("x at team dot test")
    assert placeholder("Plaza Larksen, 88", "address", KEY) == placeholder("plaza Larksen 88", "address", KEY)
