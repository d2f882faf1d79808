"""Names of persons: what a lexicon and texts teach about further names.

The lexicon labels the texts: a capital pair with a known part in its place is a name. From these labels a name model
learns further parts of names, from their partners and the forms they stand in; common words and pieces of product
names, which are none; and, by naive Bayes, the words that stand beside names. A pair that no list knows is judged by
its shape, its place in the sentence and that context.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

#: The capital and small letters of the Latin blocks, as they stand in character classes.
UP, LOW = ("".join(c for c in map(chr, range(0x41, 0x250)) if unicodedata.category(c) == kind) for kind in ("Lu", "Ll"))
TOKEN = re.compile(rf"[{UP}{LOW}]+(?:['’][{UP}{LOW}]+)*(?:-[{UP}{LOW}]+(?:['’][{UP}{LOW}]+)*)*")
_NAME = rf"[{UP}][{UP}{LOW}]*(?:['’-][{UP}{LOW}]+)*"
_PARTICLE = r"(?:(?:van|von|de|del|di|da|dos|du|le|la|bin|al|ter)(?: (?:der|den|la|los))? )?"
#: Pairs that have the shape of a name, in any order of given and family name.
PAIR = re.compile(rf"(?<![\w@./+\-'’])(?:({_NAME})(?: ([{UP}])\.)? ({_PARTICLE})({_NAME})|([{UP}])\. (?:[{UP}]\. )?({_NAME})|({_NAME}), ({_NAME}))(?![\w@+/'’-]|\.\w)")
#: A word of prose, no piece of an address, a path or a code.
WHOLE = re.compile(rf"(?<![\w@.+=/<'’-])[{UP}{LOW}]+(?:['’-][{UP}{LOW}]+)*(?![\w@+(=/-]|\.\w)")
CAMEL = re.compile(rf"(?:[{UP}][{LOW}]+){{2,}}")
PIECE = re.compile(rf"[{UP}][{LOW}]+")
LOWER_PAIR = re.compile(rf"(?<![\w@./+-])([{LOW}]{{3,}}(?:-[{LOW}]+)*) ([{LOW}]{{3,}}(?:-[{LOW}]+)*)(?![\w@])")
SCOTTISH = re.compile(rf"(?:Mc|Mac|De|Di|La|Le|Van|Von)(?=[{UP}][{LOW}])")

#: Words that are no part of a name even with a capital, by kind.
CLOSINGS = frozenset("regards thanks best cheers sincerely dear hello hi hola danke merci gracias saludo saludos atentamente gruß grüße gruss cordialement bonjour hallo liebe lieber yours".split())
TITLES = frozenset("mr mrs ms miss dr dra prof sir madam sr sra srta don doña herr herrn frau mme mlle monsieur madame doctor doctora señor señora".split())
FUNCTION_WORDS = frozenset(
    "a an the this that these those it its i we you he she they my our your his her their is are was were be been am do does did has have had will would can could should may might must not no yes only even never always nobody everybody somebody someone everyone anyone "
    "and or but if then than so as at by for from in into of off on onto out over to under up with without about after before between during through why how what when where which who whom whose "
    "please also just there here all any each every some none one two three let now today tomorrow yesterday "
    "el la los las lo un una unos unas y o e ni que de del al en con por para sin sobre entre hasta desde su sus mi mis tu tus es son fue era ser hay hoy ayer mañana como cuando donde quién qué cuál no sí se le les muy más "
    "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren wird werden hat haben auf aus bei bis durch für gegen im in ins mit nach ohne seit über um unter von vom vor zu zum zur an am ich du er sie es wir ihr wer was wann wo wie warum heute gestern morgen "
    "le la les l un une des du de et ou mais ne pas est sont était être a ont avec dans en par pour sans sur sous chez vers ce cette ces son sa ses mon ma mes il elle ils elles nous vous je tu qui que quoi quand où comment pourquoi hier demain aujourd".split()
)
CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember "
    "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
)
THINGS = frozenset(
    "project projekt proyecto projet operation team equipo équipe release job class build order ticket issue version chapter section figure table appendix room floor street road avenue lane square park bridge river lake mount "
    "city town county state republic kingdom university college school institute hospital bank hotel museum church airport station company corporation inc ltd llc gmbh ag sa corp group labs systems software services cloud server "
    "database engine framework library studio code machine windows linux office north south east west new old great upper lower san santa saint bad port los las united national international royal central federal european american "
    "api json html http sql index cache name nom nombre patient paciente contact kontakt call ask write reach address subject re fwd note notes warning error todo".split()
)
NO_NAME = CLOSINGS | TITLES | FUNCTION_WORDS | CALENDAR | THINGS
#: Words before a place or thing rather than a person.
_BEFORE_PLACES = frozenset("in near toward towards across throughout nach aus en à au aux vers hacia desde the der die das el la le les los las".split())
#: Words that take a person beside them in ordinary prose.
_BEFORE_PERSONS = frozenset("ask tell told met meet meets with by thank thanks call called email cc invite invited signed author reviewer assignee owner and contact pregunta habla con por mit von frag kontaktieren avec par voir".split())
_AFTER_PERSONS = frozenset("said says wrote writes asked asks told called calls reviewed approved joined left will has was is and dijo escribió llamó revisó tiene sagte schrieb fragte hat ist a est dit écrit".split())


@lru_cache(1 << 16)
def bare(word: str) -> str:
    """A word without accents, in lower case."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn").lower()


def capital(word: str) -> bool:
    """Whether a word is written the way a name is: a capital and small letters, or capitals alone, in each part."""
    parts = re.split(r"[-'’]", SCOTTISH.sub("", word) if word[:2] in ("Mc", "Ma", "De", "Di", "La", "Le", "Va", "Vo") else word)
    return len(word) > 1 and all(p and p[0].isupper() and (p[1:].islower() or len(p) > 2 and p.isupper() or len(p) == 1 and len(parts) > 1) for p in parts)


@dataclass
class NameModel:
    """What texts teach. Words are without accents, in lower case. An untaught model knows only the lists above."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    spelled: frozenset[str] = frozenset()  # given and family as they are written with accents, in lower case
    common: frozenset[str] = frozenset()
    pieces: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)

    def plausible(self, word: str) -> bool:
        """Whether a word may be part of a name of which nothing is known."""
        low = word.lower()
        return capital(word) and low not in NO_NAME and not any(bare(p) in self.common or bare(p) in self.pieces for p in word.split("-"))

    def beside(self, text: str, start: int, end: int) -> float:
        """How far the words beside a span speak for a name, in log odds."""
        left, right = beside(text, start, end)
        learned = self.context.get(f"<{left}", 0.0) + self.context.get(f">{right}", 0.0)
        return max(-4.0, min(4.0, learned))

    def by_shape(self, text: str, m: re.Match) -> tuple[int, int] | None:
        """The span of a pair of which no part is known, if shape, place and context make it a name.

        A further plausible word belongs to it; one that is not, such as Street or Inc, makes the whole no person's."""
        words = [w for w in (m[1], m[4], m[6], m[7], m[8]) if w]
        if not all(self.plausible(w) for w in words):
            return None
        start, end = m.span()
        score = 0.5
        left, right = beside(text, start, end)
        run = re.search(rf"({_NAME}) $", text[max(0, start - 32) : start])
        if run and len(run[1]) > 1 and run[1].lower() not in NO_NAME:
            return None  # the end of a longer run of capitals
        if m[7]:
            score -= 2.5  # commas part list items more often than names
        if m[5]:
            score -= 0.25
        further = re.match(rf" ({_NAME})(?![\w@+/'’-])", text[end : end + 40])
        if further and not m[7]:
            if self.plausible(further[1]):
                end += further.end()
                left, right = beside(text, start, end)
            elif further[1].lower() in THINGS:
                return None
        if left in _BEFORE_PLACES:
            score -= 1.5
        if left in _BEFORE_PERSONS:
            score += 1
        if right in _AFTER_PERSONS:
            score += 1
        if left == "^" and not m[2]:
            score -= 0.25  # the first word of a sentence has its capital anyway
        return (start, end) if score + self.beside(text, start, end) > 0 else None


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words beside a span, in lower case; ^ or $ where a sentence, line or text ends."""
    before, after = text[max(0, start - 32) : start], text[end : end + 32]
    left = re.search(rf"([{UP}{LOW}]+)[ :,(\"“'‘]*$", before)
    right = re.match(rf"[ ,)\"”'’]*([{UP}{LOW}]+)", after)
    return left[1].lower() if left else "^", right[1].lower() if right else "$"


def pairs(text: str) -> Iterator[re.Match]:
    at = 0
    while m := PAIR.search(text, at):
        yield m
        at = m.start(4) if m[4] else m.start(8) if m[8] else m.end()  # the second word may open the next pair


def learn(texts: Iterable[str], given: set[str], family: set[str], rounds: int = 3) -> NameModel:
    """A model from texts in memory, labelled by the lexicon's given and family names (without accents, in lower case); `fitting.fit` has the same from a table.

    A word becomes a part of names if two known partners at least stand beside it, in two forms at least of: plain,
    comma, middle initial, small letters, capitals. Common words are those that are often seen in small letters."""
    texts = list(texts)
    small, large, pieces = Counter(), Counter(), set()
    for text in texts:
        words = WHOLE.findall(text)
        lows = [bare(w) for w in words]
        for i, (w, low) in enumerate(zip(words, lows)):
            if w[0].islower():
                near = (i and (lows[i - 1] in given)) or (i + 1 < len(lows) and lows[i + 1] in family)
                if not near:
                    small[low] += 1
            else:
                large[low] += 1
                if CAMEL.fullmatch(w) and not SCOTTISH.match(w):
                    pieces.update(bare(p) for p in PIECE.findall(w))
    pieces -= given | family
    seen: list[tuple[str, str, str]] = []  # (form, given place, family place)
    for text in texts:
        for m in pairs(text):
            if m[4]:
                a, b, form = m[1], m[4], "middle" if m[2] else "capitals" if m[4].isupper() or m[1].isupper() else "plain"
            elif m[7]:
                a, b, form = m[8], m[7], "comma"
            else:
                continue
            if capital(a) and capital(b) and a.lower() not in NO_NAME and b.lower() not in NO_NAME:
                seen.append((form, bare(a), bare(b)))
        if any(low in text for low in given) or any(low in text for low in family):
            seen += [("small", bare(a), bare(b)) for a, b in LOWER_PAIR.findall(text) if a not in NO_NAME and b not in NO_NAME]
    more_given, more_family = set(), set()
    for _ in range(rounds):
        known_given, known_family = given | more_given, family | more_family
        partners, forms = defaultdict(set), defaultdict(set)
        for form, g, f in seen:
            parts = f.split("-")
            if g in known_given:
                for p in parts:
                    if p not in known_family:
                        partners["f", p].add(g), forms["f", p].add(form)
            elif any(p in known_family for p in parts):
                partners["g", g].add(f), forms["g", g].add(form)
        grown = False
        for (kind, word), with_whom in partners.items():
            if len(with_whom) < 2 or len(forms[kind, word]) < 2 or word in pieces or word in NO_NAME or len(word) < 3:
                continue
            if large[word] < 2 or small[word] > large[word]:
                continue
            (more_given if kind == "g" else more_family).add(word)
            grown = True
        if not grown:
            break
    for word in more_given & more_family:  # the place it is more often in decides
        as_given, as_family = sum(g == word for _, g, _ in seen), sum(word in f.split("-") for _, _, f in seen)
        (more_family if as_given > as_family else more_given).discard(word)
    spelled = {w.lower() for text in texts for w in TOKEN.findall(text) for w in (w, *w.split("-")) if bare(w) != w.lower() and (bare(w) in more_given or bare(w) in more_family)}
    names = given | family | more_given | more_family
    common = {w for w, n in small.items() if w not in names and len(w) > 1 and n > large[w] / 4}
    known_given, known_family = given | more_given, family | more_family
    # Context: what stands beside pairs of two known parts, against what stands beside other capital pairs.
    good, bad = Counter(), Counter()
    for text in texts:
        for m in pairs(text):
            a, b = (m[1], m[4]) if m[4] else (m[8], m[7]) if m[7] else (m[6], m[6])
            is_name = (bare(a) in known_given or m[6] is not None) and any(bare(p) in known_family for p in b.split("-"))
            if not is_name and not all(capital(w) and w.lower() not in NO_NAME for w in (a, b)):
                continue  # what has not the shape of a name teaches nothing about names
            side = good if is_name else bad
            left, right = beside(text, *m.span())
            side[f"<{left}"] += 1
            side[f">{right}"] += 1
            side["n"] += 1
    context = {}
    if good["n"] and bad["n"]:
        for feature in set(good) | set(bad):
            if feature != "n" and good[feature] + bad[feature] >= 5:
                context[feature] = math.log((good[feature] + 0.5) / (good["n"] + 1)) - math.log((bad[feature] + 0.5) / (bad["n"] + 1))
    return NameModel(frozenset(more_given), frozenset(more_family), frozenset(spelled), frozenset(common), frozenset(pieces), context)
