"""Documents to lines, paragraphs, entries, sections and packed chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.notes import extract_date, first_meaningful_line
from tessera.functions.text import truncate

#: Lines that open a scene, an entry or a section.
SCENE = r"(?iU)^\s*(?:(?:\*\s*){3,}|[-–—=~_]{3,})\s*$|^\s*#{1,3}\s+\S|^\s*(?:chapter|cap[ií]tulo|part|parte|scene|escena|act|acto)\b.{0,60}$|^\s*(?:prologue|pr[oó]logo|epilogue|ep[ií]logo)\b.{0,40}$"
ENTRY = r"(?iU)^\s*#{1,4}\s+\S|^\s*\[?\d{4}-\d{1,2}-\d{1,2}|^\s*\[?\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|^\s*(?:sesi[oó]n|session|entrada|entry|consulta|visita|visit|encounter|d[ií]a|day|nota|note)\b[^\n]{0,60}$|^\s*[-=*]{3,}\s*$"
CLINICAL = r"(?iU)^\s*(paciente|patient|motivo de consulta|chief complaint|anamnesis|antecedentes|history|exploraci[oó]n|examination|diagn[oó]stico|diagnosis|tratamiento|treatment|plan|evoluci[oó]n|follow[- ]?up|alergias|allergies|medicaci[oó]n|medication)\s*:"
HEADING = r"(?U)^\s*#{1,6}\s+\S|^\s*[A-ZÀ-Ü][^:\n]{2,58}:\s*$|(?iU)^\s*(?:paso|step|fase|phase|etapa|stage)\s*\d+"
LIST_ITEM = r"(?U)^\s*(?:[-*•]|\d{1,3}[.)])\s+\S"
SENTENCE = r"(?<=[.!?…])(?<![\s])(?=\s+[\"'“¿¡(\[]?[A-ZÀ-Ü0-9])"
TARGET, MAXIMUM, MINIMUM = 400, 900, 120


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text) with terminators kept: concatenated in order they are the document. Lines end at LF."""
    rows = documents.where("text is not null and text <> ''").select("doc_id", F.posexplode(F.split("text", r"(?<=\n)")).alias("line", "text"))
    return rows.where("text <> ''").withColumn("line", F.col("line") + 1)


def _grouped(rows: DataFrame, starts: Column) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("line")
    return rows.withColumn("part", F.sum(starts.cast("int")).over(by))


def _merged(rows: DataFrame, *more: Column) -> DataFrame:
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "")
    return rows.groupBy("doc_id", "part").agg(text.alias("text"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), *more)


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, part, text, start_line, end_line, hard): blank lines lead the paragraph behind them, the last ones end
    the last; a scene marker makes its paragraph hard. Windows here never span more than one document."""
    by = Window.partitionBy("doc_id").orderBy("line")
    rows = lines(documents).withColumn("blank", F.col("text").rlike(r"(?U)^\s*$"))
    later = F.max((~F.col("blank")).cast("int")).over(by.rowsBetween(0, Window.unboundedFollowing)) == 1
    starts = F.lag("blank").over(by).isNull() | F.col("blank") & ~F.lag("blank").over(by) & later
    flagged = rows.withColumns({"_start": starts, "_scene": ~F.col("blank") & F.regexp_replace("text", r"[\r\n]+$", "").rlike(SCENE)})
    return _merged(_grouped(flagged, F.col("_start")), F.max("_scene").alias("hard"))


def entries(documents: DataFrame, clinical: bool = False) -> DataFrame:
    """Dated entries: a part begins at each entry marker; `date` is its own (first two lines), else the one before it;
    a part with another date than the one before is hard."""
    bare = F.regexp_replace("text", r"[\r\n]+$", "")
    marks = bare.rlike(ENTRY) | (bare.rlike(CLINICAL) if clinical else F.lit(False))
    rows = _grouped(lines(documents), marks)
    parts = _merged(rows)
    own = extract_date(F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n"))
    by = Window.partitionBy("doc_id").orderBy("part")
    dated = parts.withColumn("date", F.last(own, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("date").over(by)
    return dated.withColumn("hard", F.coalesce(F.col("date") != before, F.col("date").isNotNull() & F.lag("part").over(by).isNotNull()))


def sections(documents: DataFrame) -> DataFrame:
    """Parts that begin at headings, labels and numbered steps, never at list items; first-level headings are hard."""
    bare = F.regexp_replace("text", r"[\r\n]+$", "")
    rows = lines(documents).withColumns({"_start": bare.rlike(HEADING) & ~bare.rlike(LIST_ITEM), "_top": bare.rlike(r"^\s*#{1,2}\s")})
    return _merged(_grouped(rows, F.col("_start")), F.max("_top").alias("hard"))


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, text): sentences with the white space before them; concatenated they are the document."""
    return documents.where("text is not null and text <> ''").select("doc_id", F.posexplode(F.split("text", SENTENCE)).alias("pos", "text"))


_PACKED = "source string, chunk bigint, first_block_id bigint, last_block_id bigint, blocks int, chars bigint, oversized boolean"


def _packer(target: int, maximum: int, minimum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PACKED.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        source, number, tokens, current, out = None, 0, 0, None, []

        def flush(oversized: bool = False) -> None:
            nonlocal current, tokens, number
            if current:
                out.append((source, number, *current, oversized))
                number += 1
            current, tokens = None, 0

        def add(block: int, chars: int) -> None:
            nonlocal current
            current = (current[0], block, current[2] + 1, current[3] + chars) if current else (block, block, 1, chars)

        for batch in batches:
            for s, block, chars, blank, hard in zip(*(c.to_pylist() for c in batch.columns)):
                if s != source:
                    flush()
                    source, number = s, 0
                size = max(1, chars // 4) if chars else 0
                if blank:
                    add(block, chars)
                elif size > maximum:
                    flush()
                    add(block, chars)
                    flush(True)
                else:
                    if current and (hard or tokens + size > target and tokens >= minimum):
                        flush()
                    add(block, chars)
                    tokens += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def pack(blocks: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, minimum: int = MINIMUM) -> DataFrame:
    """Chunks of consecutive blocks of each source, packed greedily: a block over `maximum` tokens alone and oversized,
    a hard boundary or a full chunk of at least `minimum` opens the next, blank blocks ride along.

    Redelivered block ids count once. Only sizes are shuffled, not texts; a source is read as a stream in order, so
    memory doesn't follow its length. A null hard_boundary is none; a null text is blank."""
    flat = _sizes(blocks, "hard_boundary").withColumnRenamed("hard_boundary", "hard")
    return flat.repartition("source").sortWithinPartitions("source", "ord", "block_id").select("source", "block_id", "chars", "blank", "hard").mapInArrow(_packer(target, maximum, minimum), _PACKED)


def split_long(parts: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Parts (doc_id, part, text, start_line, end_line, hard) with those over `maximum` tokens cut at sentences into pieces
    of at most `target` tokens, a longer sentence alone. Adds `piece`; the others, and parts of one sentence, are piece 0.

    Only large parts leave the JVM. Pieces in order are the part; the first keeps its hard boundary."""
    large = F.floor(F.char_length("text") / 4) > maximum
    rest = parts.where(~large).withColumn("piece", F.lit(0))
    columns = ["doc_id", "part", "text", "start_line", "end_line", "hard"]
    schema = "doc_id bigint, part bigint, text string, start_line int, end_line int, hard boolean, piece int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces, size = [], 0
                for sentence in re.split(_SENTENCE_PY, row["text"]):
                    if pieces and (size + len(sentence)) // 4 <= target:
                        pieces[-1].append(sentence)
                    else:
                        pieces.append([sentence])
                        size = 0
                    size += len(sentence)
                line = row["start_line"]
                for k, piece in enumerate(map("".join, pieces)):
                    breaks = piece.count("\n")
                    last = line + breaks - (piece.endswith("\n") and breaks > 0)
                    out.append(row | dict(text=piece, start_line=line, end_line=last, hard=row["hard"] and k == 0, piece=k))
                    line += breaks
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("hard", pa.bool_()), ("piece", pa.int32())]))

    cut = parts.where(large).select(*columns).mapInArrow(run, schema)
    return rest.select(*columns, "piece").unionByName(cut)


#: `SENTENCE` for Python, whose patterns have the same meaning here.
_SENTENCE_PY = re.compile(SENTENCE)


def _grouper(target: int, maximum: int):
    little = max(24, target // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PACKED.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        source, number, group, last, total, out = None, 0, None, None, 0, []

        def flush() -> None:
            nonlocal group, number
            if group:
                out.append((source, number, *group))
                number += 1
            group = None

        for batch in batches:
            for s, block, chars, blank, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if s != source:
                    flush()
                    source, number, last = s, 0, None
                size = max(1, chars // 4) if chars else 0
                joins = blank or last is None or size < little and last[1] < little and last[0] == kind and total + size <= target
                if group and not joins:
                    flush()
                if group:
                    group = [group[0], block, group[2] + 1, group[3] + chars, group[4] or not blank and size > maximum]
                else:
                    group, total, last = [block, block, 1, chars, not blank and size > maximum], 0, None
                if not blank:
                    last, total = (kind, size), total + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _sizes(blocks: DataFrame, *more: str) -> DataFrame:
    extra = [F.coalesce(F.col(c), F.lit("" if c == "kind" else False)).alias(c) for c in more]
    sizes = blocks.where("block_id is not null").groupBy("block_id").agg(F.max(F.struct("source", "ord", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"), (~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))).alias("blank"), *extra)).alias("b"))
    return sizes.select("block_id", "b.*")


def pack_each(blocks: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Chunks of one block each (block_id, source, ord, text, kind), with runs of small blocks of one kind grouped up to
    `target` tokens; small are those under a quarter of it, and under 24 tokens at least. Blank blocks ride along with the
    block before, those at a source's start with the first. A block over `maximum` makes its chunk oversized.

    Columns and limits as in `pack`: redelivered ids count once, only sizes are shuffled, a source is a stream."""
    flat = _sizes(blocks, "kind")
    return flat.repartition("source").sortWithinPartitions("source", "ord", "block_id").select("source", "block_id", "chars", "blank", "kind").mapInArrow(_grouper(target, maximum), _PACKED)


def fused(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (source, chunk, text, title, start_line, end_line, kind, tags, timestamp, context, blocks, oversized) of the blocks
    they range over (block_id, source, ord, text, title, start_line, end_line, kind, tags, timestamp, context).

    The title is that of the first and last titled block that is not blank, of all if none is; tags are each once, in
    order; timestamp and context the first there is; the kind that of all blocks, or mixed."""
    once = blocks.where("block_id is not null").dropDuplicates(["block_id"])
    at = once.select("block_id", "ord")
    spans = chunks.join(at.select(F.col("block_id").alias("first_block_id"), F.col("ord").alias("_a")), "first_block_id").join(at.select(F.col("block_id").alias("last_block_id"), F.col("ord").alias("_b")), "last_block_id")
    rows = spans.select("source", "chunk", "oversized", F.explode(F.sequence("_a", "_b")).alias("ord")).join(once, ["source", "ord"])
    solid = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    named = solid & (F.coalesce("title", F.lit("")) != "")
    ends = lambda of: (F.min(F.when(of, F.struct("ord", "title"))), F.max(F.when(of, F.struct("ord", "title"))))
    (a, b), (x, y) = ends(named), ends(F.lit(True))
    groups = rows.groupBy("source", "chunk", "oversized").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "").alias("text"), a.alias("_a"), b.alias("_b"), x.alias("_x"), y.alias("_y"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.collect_set(F.when(solid, F.col("kind"))).alias("_kinds"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("tags", F.array().cast("array<string>")).alias("t"))))["t"])).alias("tags"),
        F.min(F.when(F.col("timestamp").isNotNull(), F.struct("ord", "timestamp")))["timestamp"].alias("timestamp"), F.min(F.when(F.col("context") != "", F.struct("ord", "context")))["context"].alias("context"), F.count("*").cast("int").alias("blocks"),
    )
    first, last = F.coalesce("_a", "_x"), F.coalesce("_b", "_y")
    title = F.when(first["ord"] == last["ord"], first["title"]).otherwise(truncate(F.concat(F.coalesce(first["title"], F.lit("")), F.lit(" → "), F.coalesce(last["title"], F.lit(""))), 90))
    kind = F.when(F.size("_kinds") == 1, F.col("_kinds")[0]).otherwise("mixed")
    return groups.select("source", "chunk", "text", F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")).alias("title"), "start_line", "end_line", kind.alias("kind"), "tags", "timestamp", F.coalesce("context", F.lit("")).alias("context"), "blocks", "oversized")


# ---------------------------------------------------------------- source code
_UNITS = "doc_id bigint, unit int, kind string, name string, start_line int, end_line int, context string, text string"
_DECLARED = re.compile(r"\b(class|interface|enum|record|struct|trait|namespace|impl|object)\s+(\w+)|(\w+)\s*\([^;{]*\)[^;{]*(?:\{|$)")
_CONTAINERS = frozenset("class interface enum record struct trait namespace impl object".split())
#: How a nameless piece of code is recognised, in this order.
SNIFFED = (
    ("python", r"(?md)^\s*(?:def|class)\s+\w+.*:\s*$"),
    ("java", r"(?md)\bpublic\s+(?:final\s+|abstract\s+)?class\b|^\s*package\s+[\w.]+;"),
    ("cpp", r"#include\s*[<\"]"),
    ("javascript", r"\b(?:function|const|let)\b|=>"),
)


def sniffed(text: Column) -> Column:
    """The language of code without a telling file name; null where none is recognised."""
    out = F.lit(None).cast("string")
    for language, pattern in reversed(SNIFFED):
        braced = F.left(text, F.lit(200)).contains("{") if language == "python" else F.lit(False)
        out = F.when(text.rlike(pattern) & ~braced, language).otherwise(out)
    return out


def _start(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def python_units(text: str, threshold: int | None = None) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, context) of the statements of a module, its imports and plain statements in runs.

    A class of more than `threshold` tokens is divided into its head and one unit for each member; these know the head."""
    rows: list[list] = []
    own = text.splitlines(keepends=True)
    at, total = 1, len(own) or 1
    chars = lambda a, b: sum(map(len, own[a - 1 : b]))
    body = ast.parse(text).body
    for position, node in enumerate(body):
        kind = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class", "Import": "imports", "ImportFrom": "imports"}.get(type(node).__name__, "module")
        end = max(node.end_lineno or at, at)
        if position == len(body) - 1:
            end = total
        members = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if kind == "class" else []
        members = [m for m in members if _start(m) > at]
        if rows and kind in ("imports", "module") and rows[-1][0] == kind:
            rows[-1][3] = end
        elif members and threshold is not None and chars(at, end) // 4 > threshold:
            head = "".join(own[node.lineno - 1 : min(node.lineno + 2, _start(members[0]) - 1)])
            rows.append(["class-header", node.name, at, _start(members[0]) - 1, ""])
            for member, following in zip(members, [*members[1:], None]):
                until = max(member.end_lineno or 0, rows[-1][3] + 1) if following else end
                rows.append(["method", f"{node.name}.{member.name}", rows[-1][3] + 1, until, " ".join(head.split())[:200]])
        else:
            rows.append([kind, getattr(node, "name", ""), at, end, ""])
        at = end + 1
    return [tuple(r) for r in rows] or [("module", "", 1, total, "")]


def line_states(lines: list[str]) -> list[tuple[int, int, str]]:
    """(depth of braces at the line's end, least depth in it, last sign of code) for each line; strings, templates with the
    code inside them, comments and preprocessor lines are passed over."""
    out, depth = [], 0
    quote, block, directive = "", False, False
    templates: list[int] = []  # the depth at which the code in each open template ends
    for line in lines:
        least, last, i = depth, "", 0
        directive = (directive or not quote and not block and line.lstrip().startswith("#")) and not line.lstrip().startswith("#[")
        if directive:
            directive = line.rstrip("\r\n").endswith("\\")
            out.append((depth, depth, ""))
            continue
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if block:
                if two == "*/":
                    block, i = False, i + 1
            elif quote:
                if c == "\\":
                    i += 1
                elif quote == "`" and two == "${":
                    templates.append(depth)
                    quote, i = "", i + 1
                elif c == quote:
                    quote = ""
            elif two == "/*":
                block, i = True, i + 1
            elif two == "//":
                break
            elif c in "\"'`":
                quote = c
                last = c
            elif c == "}" and templates and depth == templates[-1]:
                templates.pop()
                quote = "`"
            elif c in "{}":
                depth += 1 if c == "{" else -1
                least, last = min(least, depth), c
            elif not c.isspace():
                last = c
            i += 1
        if quote in ("'", '"'):
            quote = ""
        out.append((depth, least, last))
    return out


def _named(lines: list[str]) -> tuple[str, str]:
    """Kind and name of what a unit declares, from its first telling line."""
    for line in lines:
        bare = line.strip()
        if bare and not bare.startswith(("//", "/*", "*", "@", "#")):
            found = _DECLARED.search(line)
            return (found[1] or "function", found[2] or found[3] or "") if found else ("statement", "")
    return "statement", ""


def _brace_cuts(own: list[str], states: list[tuple[int, int, str]], a: int, b: int, base: int) -> Iterator[tuple[int, int]]:
    """Stretches of lines a..b (from 1) that end where the depth is back at `base` behind a brace or semicolon."""
    first = a
    for n in range(a, b + 1):
        depth, _, last = states[n - 1]
        if depth <= base and last in ("}", ";"):
            yield first, n
            first = n + 1
    if first <= b:
        yield first, b


def brace_units(text: str, threshold: int | None = None) -> list[tuple[str, str, int, int, str]]:
    """Units (kind, name, first line, last line, context) of a language with braces; plain statements in runs.

    A class or the like of more than `threshold` tokens is divided into the lines up to its brace and one unit for each
    member, which know the first of them."""
    own = text.splitlines(keepends=True)
    states = line_states(own)
    rows: list[list] = []
    for a, b in _brace_cuts(own, states, 1, len(own), 0):
        kind, name = _named(own[a - 1 : b])
        if kind == "statement" and rows and rows[-1][0] == "statement":
            rows[-1][3] = b
            continue
        opens = next((n for n in range(a, b + 1) if states[n - 1][0] > 0), None)
        if threshold is None or kind not in _CONTAINERS or opens is None or opens >= b or sum(map(len, own[a - 1 : b])) // 4 <= threshold:
            rows.append([kind, name, a, b, ""])
            continue
        head = " ".join("".join(own[a - 1 : opens]).split())[:200]
        rows.append([f"{kind}-header", name, a, opens, ""])
        inner = list(_brace_cuts(own, states, opens + 1, b - 1, 1))
        for p, q in inner:
            its, called = _named(own[p - 1 : q])
            if its == "statement" and rows[-1][0] == "fields":
                rows[-1][3] = q
            else:
                rows.append(["fields" if its == "statement" else "method", f"{name}.{called}" if called else name, p, q, head])
        rows[-1][3] = b  # the closing brace goes with the last member
    return [tuple(r) for r in rows] or [("module", "", 1, len(own) or 1, "")]


def symbol_threshold(target: int) -> int:
    """Tokens beyond which a class is divided when each symbol is to be a chunk of its own."""
    return max(60, 2 * max(24, target // 4))


def _coder(threshold: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _UNITS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for doc, text, path, language in zip(*(batch.column(i).to_pylist() for i in range(4))):
                units = None
                if (path or "").endswith((".py", ".pyi")) or language == "python":
                    try:
                        units = python_units(text, threshold)
                    except (SyntaxError, ValueError, RecursionError):
                        pass
                own = text.splitlines(keepends=True)
                for i, (kind, name, a, b, context) in enumerate(units or brace_units(text, threshold)):
                    out.append((doc, i, kind, name, a, b, context, "".join(own[a - 1 : b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def code_units(documents: DataFrame, threshold: int | None = None) -> DataFrame:
    """Units of source code; concatenated in order they are the document. A parser is needed, so this runs in Python,
    batch by batch, on code only. Python that doesn't parse is read by its braces. Classes of more than `threshold`
    tokens are divided into members; without it they stay whole. The language of a nameless document is sniffed."""
    rows = documents.where("doc_id is not null and text is not null and text <> ''")
    known = F.when(F.coalesce("source", F.lit("")).rlike(r"\.[A-Za-z]+$"), None).otherwise(sniffed(F.col("text")))
    return rows.select("doc_id", "text", "source", known.alias("language")).mapInArrow(_coder(threshold), _UNITS)


# ---------------------------------------------------------------- dispatch
_BLOCK = ["doc_id", "ord", "text", "title", "start_line", "end_line", "kind", "tags", "timestamp", "hard_boundary", "context"]


def blocks_by_type(documents: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, symbols: bool = False, custom: dict | None = None) -> DataFrame:
    """Blocks of documents (doc_id, source, text, data_type), each cut the way its type asks for: code at its units, journals
    and clinical notes at dated entries, procedures at sections, anything else at paragraphs, too long ones at sentences.

    `symbols` divides classes into members. `custom` has functions by data type that take documents and return parts
    (doc_id, part, text, start_line, end_line, hard), in the place of these. Blocks in order are the document."""
    custom = custom or {}
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    title = first_meaningful_line(F.col("text"))

    def of(*types: str) -> DataFrame:
        return documents.where(F.col("data_type").isin(*types))

    def shaped(parts: DataFrame, kind: str, tags: Column = empty, when: Column = none, piece: bool = False) -> DataFrame:
        place = F.struct("part", "piece") if piece else F.col("part")
        rank = (F.row_number().over(Window.partitionBy("doc_id").orderBy(place)) - 1).cast("int")
        return parts.select("doc_id", rank.alias("ord"), "text", title.alias("title"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.lit(kind).alias("kind"), tags.alias("tags"), when.alias("timestamp"), F.col("hard").alias("hard_boundary"), F.lit("").alias("context"))

    made = [shaped(cut(of(name)), name.lower()) for name, cut in custom.items()]
    open_types = [t for t in ("CODE", "PERSONAL", "CLINICAL", "PROCESS") if t not in custom]
    if "CODE" in open_types:
        units = code_units(of("CODE"), symbol_threshold(target) if symbols else maximum)
        tags = F.when(F.col("name") != "", F.array(F.concat("kind", F.lit(":"), "name"))).otherwise(F.array("kind"))
        label = F.when(F.col("name") == "", F.col("kind")).when(F.col("kind") == "method", F.col("name")).otherwise(F.concat("kind", F.lit(" "), "name"))
        made.append(units.select("doc_id", F.col("unit").alias("ord"), "text", label.alias("title"), "start_line", "end_line", "kind", tags.alias("tags"), none.alias("timestamp"), F.lit(False).alias("hard_boundary"), "context"))
    for name in ("PERSONAL", "CLINICAL"):
        if name in open_types:
            dated = F.when(F.col("date").isNotNull(), F.array(F.concat(F.lit("date:"), F.left("date", F.lit(10))))).otherwise(empty)
            made.append(shaped(entries(of(name), name == "CLINICAL"), "entry", dated, F.col("date")))
    if "PROCESS" in open_types:
        made.append(shaped(sections(of("PROCESS")), "section"))
    rest = documents.where(~F.coalesce(F.col("data_type"), F.lit("")).isin(*custom, *open_types) if custom or open_types else F.lit(True))
    made.append(shaped(split_long(paragraphs(rest), target, maximum), "paragraph", piece=True))
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out.select(*_BLOCK)
