"""Dates inside text, credentials, and the wording of captured turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.calendar import MONTHS
from tessera.functions.text import collapsed, trimmed, truncate

#: Month words, English and Spanish, as they stand in dates inside prose.
_MONTHS = {word: str(number) for number, words in enumerate(MONTHS, 1) for word in words.split() if word not in ("ene", "abr", "ago", "dic")}
#: The shapes of dates in prose.
ISO = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
DMY = r"(?iU)\b(\d{1,2})\s*(?:de\s+|\.|\s)\s*([A-Za-zÀ-ÿ]{3,12})\.?\s*(?:de\s+|,\s*|\s)\s*(\d{4})\b"
MDY = r"(?iU)\b([A-Za-zÀ-ÿ]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
NUMERIC = r"(?U)\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\b"
LEADING = r"(?U)^\s*[#*\[(]*\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})\b"

#: Shapes of credentials; then assignments, of which the name stays.
SECRETS = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"\bsk-[A-Za-z0-9_-]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bAIza[A-Za-z0-9_-]{30,}",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}",
)
ASSIGNMENT = r"""(?i)\b((?:[a-z0-9]+[_-])*(?:password|passwd|contrase[ñn]a|secret|token|api[_-]?key|access[_-]?key)(?:[_-][a-z0-9]+)*)(\s*[:=]\s*)("[^"\n]{4,}"|'[^'\n]{4,}'|[^\s"',;]{6,})"""
#: What a host program puts into a user's turn.
INJECTED = "system-reminder local-command-caveat local-command-stdout local-command-stderr command-message command-args".split()
READ_ONLY = "read grep glob toolsearch todowrite todoread ls list listagents wait update_plan view_image".split()
ACTION_FIELDS = "description file_path filePath command cmd path url query prompt skill content".split()


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column, pattern: str) -> Column:
    """The three groups of the first match; null without one."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, pattern, "$1|$2|$3"), r"\|"))


def _built(y: Column, m: Column, d: Column) -> Column:
    ok = y.between(1000, 9999) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%04d-%02d-%02dT00:00:00Z", y, m, d))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def extract_date(text: Column, day_first: bool = True) -> Column:
    """The first date in a text as an ISO string; the first kind that occurs decides, even if it names no date.

    The kinds are ISO, day-month-year in words, month-day-year in words, and digits; a kind in words is passed over
    only if its month word is unknown. No check of days in the month beyond 31."""
    months = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])
    word = lambda parts, i: _int(F.try_element_at(months, F.lower(parts[i])))

    def numeric(p: Column) -> Column:
        a, b = _int(p[0]), _int(p[1])
        year = F.when(F.length(p[2]) == 4, _int(p[2])).otherwise(_int(p[2]) + 2000)
        first = F.lit(True) if day_first else a > 12
        day, mon = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
        swap = (mon > 12) & (day <= 12)
        return _built(year, F.when(swap, day).otherwise(mon), F.when(swap, mon).otherwise(day))

    def decide(k: Column) -> Column:
        iso, dmy, mdy, digits = k["iso"], k["dmy"], k["mdy"], k["digits"]
        return (
            F.when(iso.isNotNull(), _built(_int(iso[0]), _int(iso[1]), _int(iso[2])))
            .when(word(dmy, 1).isNotNull(), _built(_int(dmy[2]), word(dmy, 1), _int(dmy[0])))
            .when(word(mdy, 0).isNotNull(), _built(_int(mdy[2]), word(mdy, 0), _int(mdy[1])))
            .when(digits.isNotNull(), numeric(digits))
        )

    kinds = F.struct(_parts(text, ISO).alias("iso"), _parts(text, DMY).alias("dmy"), _parts(text, MDY).alias("mdy"), _parts(text, NUMERIC).alias("digits"))
    return _let(kinds, decide)


def leading_date(text: Column) -> Column:
    """The date a text opens with, behind heading or bracket marks; else null."""
    return extract_date(F.regexp_extract(text, LEADING, 1))


def redact_secrets(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return F.regexp_replace(text, ASSIGNMENT, "$1$2[REDACTED]")


def clean_user_text(text: Column) -> Column:
    """What the user typed: injected blocks dropped, command names unwrapped."""
    for tag in INJECTED:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    return trimmed(F.regexp_replace(text, r"(?s)<command-name>\s*(.*?)\s*</command-name>", "$1"))


def describe_action(name: Column, values: Column) -> Column:
    """One line for a tool call with a map of its input; null for tools that only look."""
    fields = [F.nullif(trimmed(F.try_element_at(values, F.lit(f))), F.lit("")) for f in ACTION_FIELDS]
    detail = collapsed(F.coalesce(*fields))
    cut = F.when(F.char_length(detail) > 140, F.concat(F.left(detail, F.lit(139)), F.lit("…"))).otherwise(detail)
    short = F.element_at(F.split(name, "__"), -1)
    return F.when((name != "") & ~F.lower(name).isin(*READ_ONLY), F.concat(short, F.coalesce(F.concat(F.lit(": "), cut), F.lit(""))))


def render_turn(label: Column, text: Column, actions: Column) -> Column:
    head = F.concat(label, F.lit(": "), F.coalesce(text, F.lit("")))
    return F.concat_ws("\n", head, F.transform(F.coalesce(actions, F.array().cast("array<string>")), lambda a: F.concat(F.lit("  · "), a)))


def gist(content: Column, limit: int = 90) -> Column:
    """The first line without its leading date, shortened."""
    first = F.split(trimmed(content), r"\r\n|[\n\r]")[0]
    bare = F.regexp_replace(first, r"(?U)^\s*\d{4}-\d{1,2}-\d{1,2}(?:\s*\([^)]*\))?\s*[:\-–—]?\s*", "")
    return F.regexp_replace(truncate(F.regexp_replace(bare, r"[ .]+$", ""), limit), "'", "’")


def project_of(directory: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(directory, "/+$", ""), "/"), -1)


def first_meaningful_line(text: Column, limit: int = 70) -> Column:
    """The first line with anything in it, trimmed and shortened; empty where there is none, null for null."""
    full = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: x.rlike(r"\S"))
    return F.when(text.isNotNull(), F.coalesce(truncate(F.try_element_at(full, F.lit(1)), limit), F.lit("")))


def short_symbol(title: Column) -> Column:
    """A title without the file before its dot and without the word that says what kind of symbol it names."""
    return F.regexp_replace(F.element_at(F.split(title, " · "), -1), r"^(?:async\s+)?(?:def|function|class|method|record|interface|enum)\s+", "")


#: What makes a line of a tool's output worth keeping.
DIGEST = "(?i)error|fail|exception|traceback|caused by|warn|panic|fatal|build (?:success|failure)|tests? run|passed|skipped|assert|expected|✗|✘"


def digest_lines(documents: DataFrame, key: str = "doc_id", first: int = 3, last: int = 5) -> DataFrame:
    """(key, pos, line): of the lines with content the first and last few and those that DIGEST knows; of lines that repeat
    the first. Null texts give no row. How many characters are shown in the end is the reader's affair."""
    rows = documents.select(key, F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("pos", "line")).where(F.col("line").rlike(r"[^\s]"))
    up, down = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key).orderBy(F.desc("pos"))
    marked = rows.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)})
    kept = marked.where((F.col("a") <= first) | (F.col("b") <= last) | F.col("line").rlike(DIGEST))
    return kept.groupBy(key, "line").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))
