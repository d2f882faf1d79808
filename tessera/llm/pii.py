"""Personal information inside free text: found, and replaced by typed placeholders.

Formats find emails, phone and identity numbers and addresses; persons are found by a lexicon of names, by what the
texts teach beside it (see `names` and `fitting`), and behind titles, closings and labels. Numbers, and dates where a text is redacted, are permuted by a keyed Feistel network within their
format (see `pseudonyms`), so the pseudonym of a value has its shape and is the same in every document and spelling;
other values get a keyed digest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.fitting import fit
from tessera.llm.names import LOW as _LOW
from tessera.llm.names import NO_NAME, PAIR, TITLES, TOKEN, NameModel, bare, capital
from tessera.llm.names import UP as _UP
from tessera.llm.pseudonyms import calendar_date, find_dates, identity, phone, pseudonym  # noqa: F401

TYPES = ("email", "phone", "id", "address", "name")
_WORD = rf"[{_UP}][{_UP}{_LOW}'’]*(?:-[{_UP}{_LOW}][{_UP}{_LOW}'’]*)*"

# ---------------------------------------------------------------- email
_AT = r"(?:@|＠|\s?[\[({<]\s?(?:at|AT|At|arroba|@)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punto|punkt|point|\.)\s?[\])}>]\s?)"
_LOCAL = rf"[{_UP}{_LOW}0-9](?:[{_UP}{_LOW}0-9._%+-]*[{_UP}{_LOW}0-9_])?(?:\s?[\[({{]\s?(?:dot|punto)\s?[\])}}]\s?[{_UP}{_LOW}0-9_-]+)*"
_EMAIL = re.compile(
    rf"(?<![\w.%+@-])(?:({_LOCAL}){_AT}(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,}}|{_LOCAL}\s(?:at|AT|arroba)\s(?:[A-Za-z0-9-]+\s(?:dot|DOT|punto)\s)+[A-Za-z]{{2,}})(?![\w@-])"
)

#: One of these, in lower case, stands in every email; and so as a word of its own.
_ATS, _AT_WORDS = ("@", "＠", "arroba"), ("at",)

# ---------------------------------------------------------------- identity numbers
_ID_CUE = re.compile(
    r"(?:Steuernummer|Steuer-?ID|IdNr|Ausweis|Personalausweis|Reisepass|Pass|passport|pasaporte|passeport|pièce d'identité|s[ée]cu|sécurité sociale|SSN|NINO|NIF|NIE|DNI|documento|ID no|ID)[\w-]*\.?"
    r"(?:\s+(?:laut|nr|no|number|número|num|es|est|is|lautet)\.?(?:\s+Bescheid)?)?(?:/ID)?\s?[:#]?\s?"
    r"((?:[A-Z]{1,3}[ -]?)?\d[A-Z0-9]*(?:[ .-]\d[A-Z0-9]*){0,7}(?:[.-]?[A-Za-z])?|[A-Z]\d\d[A-Z0-9]\d{5}[A-Z0-9]?|[A-Z]{1,3}\d[A-Z0-9]{5,10})(?![\w])",
)
_ID = re.compile(
    r"(?<![\w.+/:@=-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"  # social security
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # national insurance
    r"|[A-Z]{2}\d{7}|[A-Z]\d{2}[A-Z]\d{5}"  # passports
    r"|\d{8}-?[A-HJ-NP-TV-Za-hj-np-tv-z]|\d{1,2}\.\d{3}\.\d{3}-?[A-HJ-NP-TV-Za-hj-np-tv-z]|[XYZ]-?\d{7}-?[A-Z]"  # Spanish
    r"|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{15}"  # French
    r"|\d{2} \d{3} \d{3} \d{3}"  # German
    r")(?![\w@]|[-.:/,]\d| \d{3}\b)"
)

# ---------------------------------------------------------------- phones
_EXT = r"(?:[ ,;]{0,2}(?:\bext\.?|\bx|\bextension|\bDurchwahl|\bDW|\bposte|\bApdo\.?|#)\s?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+/:@=,-])(?:"
    r"(?:\+|00)\d{1,15}+(?:[ ./-]?\(0\)\d{0,11}+)?(?:(?:[ ./-]\(?|\()\d{1,11}+\)?){0,6}"  # international; groups are whole runs of digits
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}|1[2-9]\d{9}"  # North America
    r"|\(0\d{1,4}\)[ /-]?\d{3,8}(?:[ -]\d{2,8}){0,3}|0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,8}){0,4}"  # with an area code
    r"|0\d(?:\.\d{2}){4}|0[1-9]\d{8,9}|[6789]\d{2}[ .]?\d{3}[ .]?\d{3}(?=\D|$)"
    r")" + _EXT + r"(?![\w@]|[.:/]\d|,\d)"
)

# ---------------------------------------------------------------- addresses
_TOWN = rf"(?:(?:Bad|San|Santa|St\.|Las?|Los|Les?|El|New|Old|Port|Puerto|Villa) )?{_WORD}"
_NO = r"\d{1,4}(?: ?[a-zA-Z]\b)?"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    rf"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite) \d+[A-Za-z]?,? )?{_NO},? (?:{_WORD} ){{1,4}}(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Close|Court|Way|Square|Terrace|Crescent|Gardens|Boulevard|Blvd)\b(?:\.(?=,))?(?:,? (?:Flat|Apartment|Apt\.?|Unit|Suite) \d+[A-Za-z]?)?(?:,? {_TOWN},? (?:\d{{5}}\b|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}\b))?"
    rf"|(?:[Cc]alle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Ronda|Travesía|Carretera) ?(?:de la |de los |de las |de |del )?(?:{_WORD} ){{0,2}}{_WORD},? (?:n[º°.] ?)?{_NO}(?:, (?:\d+º? ?[A-Za-z]?|piso \d+\w*|bajo|puerta \w+))*?(?:,? \d{{5}} {_TOWN})?"
    rf"|{_NO}(?: bis| ter)?,? (?:rue|bd|boulevard|avenue|av\.|impasse|place|allée|chemin|quai|cours|square|passage) (?:de la |de l['’]|des |du |de |d['’])?(?:{_WORD} ){{0,2}}{_WORD}(?:,? \d{{5}} {_TOWN})?"
    rf"|(?:{_WORD}[{_LOW}-]*(?<=[a-zßäöü])(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm|ring)|{_WORD}(?:-| )(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ufer|Damm|Ring)|(?:Am|Im|An der|Auf der|Auf dem|Zum|Zur|Unter den|Unter der) {_WORD}) {_NO}(?:,? (?:D-)?\d{{5}} {_TOWN})?"
    rf")(?!\w)"
)
#: One of these, in lower case, stands in every address; or one at the end, or the start, of a word.
_STREETS = tuple(
    " street| avenue| ave| lane| ln| road| rd| drive| close| court| way| square| terrace| crescent| gardens| boulevard| blvd| rue | bd | av.| impasse | place | allée | chemin | quai | cours | passage |calle|c/|avda|avenida|av.|plaza|pza|paseo|pº|camino|ronda|travesía|carretera|straße|strasse|str.|weg |platz |gasse |allee |ufer |damm |ring ".split("|")
)
_STREET_ENDS, _STREET_STARTS = (" st",), ("am ", "im ", "an der ", "auf de", "zum ", "zur ", "unter de")

# ---------------------------------------------------------------- names
#: What stands before a name in any text: closings of letters, labels and titles.
_PREFIX = re.compile(
    r"(?:\b(?:[Rr]egards|[Tt]hanks|[Bb]est|[Cc]heers|[Ss]incerely|Gruß|Grüße|Gruss|[Ss]aludos?|Atentamente|Cordialement|[Yy]ours),\s"
    r"|\b(?:[Pp]atient(?:in)?|[Pp]aciente|[Nn]ame|[Nn]ombre|[Nn]om|[Cc]ontact|[Ss]igned|[Aa]uthor): "
    r"|\b(?:Mr|Mrs|Ms|Dr|Dra|Prof|Sr|Sra|Srta)\.? |\b(?:Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Doctora?) )"
)
_FRAMED = re.compile(
    rf"([{_UP}{_LOW}]{{2,}}(?:[-'’][{_UP}{_LOW}]+)*)(?:, ([{_UP}{_LOW}]{{2,}}(?:[-'’][{_UP}{_LOW}]+)*)| ([{_UP}]\. )?([{_UP}{_LOW}]{{2,}}(?:[-'’][{_UP}{_LOW}]+)*))|([{_UP}]\. [{_UP}{_LOW}]{{2,}}(?:[-'’][{_UP}{_LOW}]+)*)"
)
#: One of these, in lower case, stands in every such frame.
_FRAMES = tuple("egards,|hanks,|best,|heers,|incerely,|gruß,|grüße,|gruss,|aludo,|aludos,|tentamente,|ordialement,|yours,|atient: |atientin: |aciente: |name: |nombre: |nom: |contact: |igned: |uthor: |mr.|mr |mrs.|mrs |ms.|ms |dr.|dr |dra.|dra |prof.|prof |sr.|sr |sra.|sra |srta.|srta |herr |herrn |frau |mme |mlle |monsieur |madame |señor|doctor".split("|"))
#: Words before bare numbers that are codes of versions and records, not phones.
_CODES = re.compile(r"\b(?:commit|sha|hash|rev|revision|build|version|ticket|order|invoice|issue|uuid|port)[ :#]*$", re.IGNORECASE)
_MAIL, _PLACE, _FRAME, _NAME = 1, 2, 4, 16
#: Triggers that count only at the end, or the start, of a word; the length stands above the bits.
_PLACE_END, _PLACE_START, _MAIL_WORD, _LENGTH = 32, 64, 128, 8


class Finder:
    """Finds typed spans in texts, given the lexicon of known names and what the texts taught beside it."""

    def __init__(self, names: list[tuple[str, str]], model: NameModel | None = None) -> None:
        self.model = model or NameModel()
        self.given = {bare(n) for n, kind in names if kind == "given"} | self.model.given
        self.family = {bare(n) for n, kind in names if kind != "given"} | self.model.family
        spelled = {n for name, _ in names for n in (name.lower(), bare(name))} | self.model.given | self.model.family | self.model.spelled
        self.triggers = ahocorasick.Automaton()
        kinds = ((_ATS, _MAIL), (_STREETS, _PLACE), (_FRAMES, _FRAME), (spelled, _NAME), (_AT_WORDS, _MAIL_WORD), (_STREET_ENDS, _PLACE_END), (_STREET_STARTS, _PLACE_START))
        for words, bit in kinds:
            for word in words:
                self.triggers.add_word(word, self.triggers.get(word, 0) | bit | (len(word) << _LENGTH if bit > _NAME else 0))
        self.triggers.make_automaton()

    def hints(self, text: str) -> int:
        """What kinds of span the text can hold, from one pass over it for all trigger words."""
        seen, low = 0, f" {text.lower()} "
        inside = lambda i: low[i].isalnum() or low[i] == "_"
        for end, bit in self.triggers.iter(low):
            if bit > 31:
                before = inside(end - (bit >> _LENGTH)) if bit & (_PLACE_START | _MAIL_WORD) else False
                after = inside(end + 1) if bit & (_PLACE_END | _MAIL_WORD) else False
                if not before and not after:
                    seen |= _MAIL if bit & _MAIL_WORD else _PLACE
                bit &= 31
            seen |= bit
        return seen

    def is_given(self, word: str) -> bool:
        return bare(word) in self.given

    def is_family(self, word: str) -> bool:
        return any(bare(p) in self.family for p in word.split("-"))

    def known_names(self, text: str) -> Iterator[tuple[int, int]]:
        """Names of which the lexicon has a part: given family, given initial family, initial family, family comma given."""
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        i, n = 0, len(tokens)
        while i < n:
            start, end, word = tokens[i]
            step = 1
            if i + 1 < n and (i == 0 or text[start - 1] not in "@+._-/\\" and not text[start - 1].isdigit() or text[start - 1 : start] == " "):
                b_start, b_end, second = tokens[i + 1]
                gap = text[end:b_start]
                after = text[b_end : b_end + 1]
                joined = after in ("@", "_", "+", "/") or after == "." and text[b_end + 1 : b_end + 2].isalnum()
                if joined:
                    pass
                elif gap == " " and len(second) == 1 and second.isupper() and after == "." and i + 2 < n and text[b_end : tokens[i + 2][0]] == ". ":
                    third = tokens[i + 2]
                    if self.is_given(word) and (self.is_family(third[2]) or capital(third[2]) and bare(third[2]) not in NO_NAME) or self.is_family(third[2]) and capital(word) and word.lower() not in NO_NAME:
                        yield start, third[1]
                        step = 3
                elif gap == ". " and len(word) == 1 and word.isupper() and self.is_family(second):
                    yield start, b_end
                    step = 2
                elif gap == " ":
                    given, family = self.is_given(word), self.is_family(second)
                    shaped = capital(word) and word.lower() not in NO_NAME
                    other = capital(second) and second.lower() not in NO_NAME and not self.is_given(second)
                    small = (given or family) and word.islower() and second.islower() and not {bare(word), bare(second)} & self.model.common
                    if given and family or family and shaped and not self.is_family(word) or given and word[0].isupper() and other or small and self.model.beside(text, start, b_end) > 1:
                        yield start, b_end
                        step = 2
                elif gap == ", ":
                    if self.is_given(second) and len(word) > 1 and (self.is_family(word) or capital(word) and word.lower() not in NO_NAME) or self.is_family(word) and capital(second) and not self.is_family(second) and self.model.plausible(second) and self.model.beside(text, start, b_end) > 0:
                        yield start, b_end
                        step = 2
            i += step

    def framed_names(self, text: str) -> Iterator[tuple[int, int]]:
        """Names behind titles, closings and labels, whatever the lexicon has."""
        for m in _PREFIX.finditer(text):
            found = _FRAMED.match(text, m.end())
            if not found or found[1] and found[1].lower() in TITLES and text[found.end(1) : found.end(1) + 2] in (". ", " "):
                continue
            words = [w for w in (found[1], found[2] or found[4]) if w]
            if found[5]:
                if capital(found[5][3:]):
                    yield found.span()
            elif any(w.lower() in NO_NAME for w in words):
                continue
            elif all(capital(w) for w in words) or all(w.islower() for w in words) and self._whole(text, found):
                yield found.span()

    def shaped_names(self, text: str) -> Iterator[tuple[int, int]]:
        """Names of which nothing is known, by their shape and what stands beside them."""
        at = 0
        while m := PAIR.search(text, at):
            words = [w for w in (m[1], m[4], m[6], m[7], m[8]) if w]
            span = None
            if not any(self.is_given(w) or self.is_family(w) for w in words):
                span = self.model.by_shape(text, m)
            if span:
                yield span
            at = span[1] if span else m.start(4) if m[4] else m.start(8) if m[8] else m.end()

    def _whole(self, text: str, found: re.Match) -> bool:
        """Whether two words in lower case fill a frame: one is known, or the frame ends behind them."""
        if self.is_given(found[1]) or self.is_family(found[2] or found[4] or ""):
            return True
        rest = text[found.end() : found.end() + 14]
        ends = rest[:1] in ("", "\n", ".", ",", ";") or rest[:1] == " " and rest[1:2].isalnum() and not rest[1:2].islower()
        return ends or self.model.beside(text, *found.span()) > 0

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, type), in order and apart. Of spans that meet, the type named first above wins."""
        taken: list[tuple[int, int, str]] = []  # in order and apart, so the neighbours of a place decide

        def add(start: int, end: int, kind: str) -> None:
            i = bisect_left(taken, (start, end, kind))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, kind))

        hints = self.hints(text)
        if hints & _MAIL:
            for m in _EMAIL.finditer(text):
                add(m.start(), m.end(), "email")
        if hints & _PLACE:
            for m in _ADDRESS.finditer(text):
                add(m.start(), m.end(), "address")
        if _LONG_NUMBER.search(text):
            for m in _ID.finditer(text):
                add(m.start(), m.end(), "id")
            for m in _ID_CUE.finditer(text):
                if sum(c.isdigit() for c in m[1]) >= 6 and len(m[1]) >= 7:
                    add(*m.span(1), "id")
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 20 and not (m[0].isdigit() and _CODES.search(text, max(0, m.start() - 12), m.start())):
                    end = m.end()
                    while text[end - 1] in " .-/(" or text[end - 1] == ")" and m[0].count(")") > m[0].count("("):
                        end -= 1
                    add(m.start(), end, "phone")
        if hints & _NAME:
            for span in self.known_names(text):
                add(*span, "name")
        if hints & _FRAME:
            for span in self.framed_names(text):
                add(*span, "name")
        for span in self.shaped_names(text):
            add(*span, "name")
        return taken


_LETTERS = re.compile(r"[^\W\d_]+")
#: Stands in every phone and identity number.
_LONG_NUMBER = re.compile(r"\d[\d().+/ -]{4,}\d|[A-Z]\d\d")


def _undisguised(email: str) -> str:
    """An email in lower case with @ and dots, however they were written."""
    return "@".join(re.sub(r"\s(?:dot|DOT|punto)\s", ".", re.sub(_DOT, ".", part)) for part in re.split(rf"{_AT}|\s(?:at|AT|arroba)\s", email, maxsplit=1)).lower()


def placeholder(value: str, kind: str, key: bytes) -> str:
    """Numbers and dates keep their format; other values get a keyed digest of their bare spelling."""
    if kind in _PERMUTED:
        return f"[{kind.upper()} {_PERMUTED[kind](value, key)}]"
    if kind == "email":
        spelled = bare(_undisguised(value))
    elif kind == "name":
        spelled = " ".join(sorted(_LETTERS.findall(bare(value))))
    else:
        spelled = " ".join(re.findall(r"\w+", bare(value)))
    return f"[{kind.upper()} {hashlib.blake2b(spelled.encode(), key=key, digest_size=16).hexdigest()}]"


_PERMUTED = {"phone": phone, "id": identity, "date": calendar_date}


def with_dates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans and, apart from them, the text's dates."""
    dates = [(a, b, "date") for a, b in find_dates(text) if all(b <= x or y <= a for x, y, _ in spans)]
    return sorted(spans + dates) if dates else spans


def redact(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], placeholder(text[start:end], kind, key)]
        at = end
    return "".join([*out, text[at:]])


_SPANS = "kind string, rec_key string, pii_type string, found string, start int"
_CLEAN = "kind string, rec_key string, text string"


def _lexicon(names: DataFrame, bound: int = 1_000_000) -> list[tuple[str, str]]:
    """The lexicon, on the driver: it is a fixed table of names, refused beyond `bound` of them."""
    rows = names.where("name is not null").select("name", F.coalesce("kind", F.lit("family")).alias("kind")).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("the lexicon is too large to hand to every task")
    return [(r.name, r.kind) for r in rows]


def _spans(names: list[tuple[str, str]], model: NameModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names, model)
        for batch in batches:
            out = []
            for kind, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                out += [(kind, key, t, text[a:b], a) for a, b, t in finder.find(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 4 else pa.string()) for i, c in enumerate(zip(*out))], ["kind", "rec_key", "pii_type", "found", "start"])

    return run


def _redactor(names: list[tuple[str, str]], model: NameModel, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names, model)
        for batch in batches:
            texts = [None if t is None else redact(t, with_dates(t, finder.find(t)), key) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["kind", "rec_key", "text"])

    return run


def fitted(texts: DataFrame, names: list[tuple[str, str]]) -> NameModel:
    """The name model, fitted on every text, whole. A lexicon without names teaches nothing."""
    if not names:
        return NameModel()
    return fit(texts, {bare(n) for n, kind in names if kind == "given"}, {bare(n) for n, kind in names if kind != "given"})


def find_pii(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, rec_key, pii_type, found, start) for every span found in rows (kind, rec_key, text).

    One pass without a shuffle, after the fit of the name model on all of the texts, which is a pass of its own. Null texts give no row; repeated
    rows repeat theirs; an empty lexicon leaves names to titles, closings, labels and their shape; extra columns are ignored.
    """
    known = _lexicon(names)
    return texts.select("kind", "rec_key", "text").where("text is not null").mapInArrow(_spans(known, fitted(texts, known)), _SPANS)


def redact_pii(texts: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """The rows (kind, rec_key, text) with every span and every date replaced by its typed placeholder; null texts stay null."""
    known = _lexicon(names)
    return texts.select("kind", "rec_key", "text").mapInArrow(_redactor(known, fitted(texts, known), key), _CLEAN)
