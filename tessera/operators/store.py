"""Upserts, demotions and synchronisation as joins of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_in_groups

#: What makes a path one of tests, or of source code.
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs)(/|$)|(Test|Tests|IT|Spec)\.(java|kt|scala|groovy|cs|swift)$|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]sx?$"
CODE_PATH = r"\.(py|pyi|java|js|mjs|jsx|ts|tsx|c|h|cc|cpp|cxx|hpp|hh|cs|go|rs|kt|swift|php|scala)$"


def looks_like_test(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\\", "/").rlike(TEST_PATH), F.lit(False))


def looks_like_code(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(CODE_PATH), F.lit(False))


def admissible(entries: DataFrame, scope: str = "all", prefix: str | None = None, since: str | None = None, historical: bool = False) -> DataFrame:
    """Catalog rows that a search may return; the scope narrows source code only. All four predicates reach the scan.

    A row without catalog columns, all null, passes only while scope is all and neither prefix nor since is given."""
    if scope not in ("all", "main", "test"):
        raise ValueError(f"unknown scope {scope}")
    rows = entries if historical else entries.where("status is null or status <> 'HISTORICAL'")
    if since:
        rows = rows.where(F.left("timestamp", F.lit(10)) >= since[:10])
    if prefix:
        rows = rows.where(F.col("source").startswith(prefix))
    if scope != "all":
        test = looks_like_test(F.col("source"))
        rows = rows.where(~looks_like_code(F.col("source")) | (test if scope == "test" else ~test))
    return rows


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Old and new rows, of each key the one with the largest version, ties by the larger of the other columns."""
    keep = [c for c in old.columns if c not in (key, version)]
    both = old.select(key, version, *keep).unionByName(new.select(key, version, *keep))
    return both.groupBy(key).agg(F.max(F.struct(version, *keep)).alias("_r")).select(key, "_r.*")


def demote_previous(existing: DataFrame, current: DataFrame) -> DataFrame:
    """existing (source, leaf_id, status) after `current` (source, leaf_id) replaces the leaves of its sources: ids not
    produced again become historical, superseded by the least current id of the source."""
    first = current.groupBy("source").agg(F.min("leaf_id").alias("_new"))
    again = current.select("leaf_id", F.lit(True).alias("_kept")).distinct()
    rows = existing.join(first, "source", "left").join(again, "leaf_id", "left")
    gone = F.col("_new").isNotNull() & F.col("_kept").isNull()
    return rows.select("leaf_id", "source", F.when(gone, "HISTORICAL").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("_new")).alias("superseded_by"))


def preserving_parent(new: DataFrame, old: DataFrame, parents: DataFrame) -> DataFrame:
    """new (leaf_id, ...) with parent, status and successor of the old row of the id, the parent if it still exists."""
    kept = old.select("leaf_id", F.col("parent_id").alias("_parent"), F.col("status").alias("_status"), F.col("superseded_by").alias("_by"))
    there = parents.select(F.col("id").alias("_parent"), F.lit(True).alias("_there")).distinct()
    rows = new.join(kept, "leaf_id", "left").join(there, "_parent", "left")
    base = [c for c in new.columns if c not in ("parent_id", "status", "superseded_by")]
    return rows.select(*base, F.when(F.col("_there"), F.col("_parent")).alias("parent_id"), F.coalesce("_status", F.lit("ACTIVE")).alias("status"), F.col("_by").alias("superseded_by"))


def sync_diff(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change) between manifests (path, size, digest): added, removed, changed or same.

    The digest counts only where the sizes agree, as a scan computes it only then."""
    a = known.select("path", F.col("size").alias("_size"), F.col("digest").alias("_digest"), F.lit(True).alias("_a"))
    b = scanned.select("path", "size", "digest", F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when((F.col("_size") != F.col("size")) | (F.col("_digest") != F.col("digest")), "changed").otherwise("same")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def project_map(files: DataFrame) -> DataFrame:
    """Files and tokens under every directory of paths (path, tokens), each file counted in all directories above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.where("path is not null").select(F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit(".")))).alias("directory"), "tokens")
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


#: Folders of copies that a symbol is taken from only if it stands nowhere else.
LEGACY = r"(v1|deprecated|compat|legacy)/"
#: Names in a question that may be symbols: of four characters or more, dots inside.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_]"


def query_symbols(queries: DataFrame) -> DataFrame:
    """(query, name) of the identifiers of four characters or more in questions (query, text)."""
    found = F.filter(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), lambda x: F.char_length(x) >= 4)
    return queries.select("query", F.explode(F.array_distinct(found)).alias("name"))


def find_exact(symbols: DataFrame, queries: DataFrame, scope: str = "main", prefix: str = "") -> DataFrame:
    """(query, path, title, size): for questions (query, text) that name a symbol, its definition among symbols (path, title,
    size): a full name before a last segment, legacy copies last, then the largest, then the first path and title.

    Titles of several symbols, joined by arrows, count for each. Two equi joins, never one on either."""
    rows = symbols.where("path is not null and title is not null")
    if prefix:
        rows = rows.where(F.col("path").startswith(prefix))
    if scope != "all":
        rows = rows.where(looks_like_test(F.col("path")) if scope == "test" else ~looks_like_test(F.col("path")))
    part = F.regexp_replace(F.trim(F.col("_part")), r"^(?:async\s+)?(?:def|function|class|method|record|interface|enum)\s+", "")
    rows = rows.withColumn("_part", F.explode(F.split("title", "→"))).withColumn("_name", F.trim(F.split(part, r" \(")[0])).where("_name <> ''")
    rows = rows.withColumn("_last", F.element_at(F.split("_name", r"\."), -1))
    names = query_symbols(queries).withColumn("_seg", F.element_at(F.split("name", r"\."), -1))
    full = rows.join(names.where(F.col("name").contains(".")).select("query", F.col("name").alias("_name")).distinct(), "_name").withColumn("full", F.lit(1))
    last = rows.join(names.select("query", F.col("_seg").alias("_last")).distinct(), "_last").withColumn("full", F.lit(0))
    hits = full.unionByName(last)
    best = hits.groupBy("query").agg(F.min(F.struct((-F.col("full")).alias("f"), F.col("path").rlike(LEGACY).cast("int").alias("l"), (-F.col("size")).alias("s"), "path", "title", "size")).alias("b"))
    return best.select("query", "b.path", "b.title", "b.size")


def find(symbols: DataFrame, queries: DataFrame, ranked: DataFrame, judged: DataFrame, scope: str = "main", prefix: str = "") -> DataFrame:
    """(query, status, path, title): where a question's symbol is defined, else the best search hit, or that it is unclear.

    ranked (query, path, title, rank) and judged (query, reason) come from a search with the same filters. found: by name,
    or a sure hit; ambiguous: a clue is needed and the three best lie in several files; none: no hit at all."""
    exact = find_exact(symbols, queries, scope, prefix).select("query", F.col("path").alias("_p"), F.col("title").alias("_t"))
    top = ranked.where("rank <= 3").groupBy("query").agg(F.count_distinct("path").alias("_files"), F.min(F.struct("rank", "path", "title")).alias("_b"))
    rows = queries.select("query").distinct().join(exact, "query", "left").join(top, "query", "left").join(judged.select("query", "reason"), "query", "left")
    unsure = F.col("reason").isNotNull() & (F.col("_files") > 1)
    status = F.when(F.col("_p").isNotNull(), "found").when(F.col("_b").isNull(), "none").when(unsure, "ambiguous").otherwise("found")
    shown = status == "found"
    return rows.select("query", status.alias("status"), F.when(shown, F.coalesce("_p", "_b.path")).alias("path"), F.when(shown, F.coalesce("_t", "_b.title")).alias("title"))


def render_hit(path: Column, title: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), title, F.lit("\n"), content)


def budgeted_map(files: DataFrame, max_lines: int = 400, max_tokens: int | None = None, scope: str = "all", prefix: str = "") -> DataFrame:
    """(directory, path, line, tokens, shown): a line for each file (path, tokens) below `prefix` and within `scope`, grouped by
    directory, and for directories that do not fit a single line with their totals.

    Directories are shown in full from the smallest on, as long as lines and tokens of the map allow: so many fit as can.
    What is shown is cut, not what is counted; the sum of tokens over all lines is that of all files."""
    rows = files.where("path is not null")
    if prefix:
        rows = rows.where(F.col("path").startswith(prefix))
    if scope != "all":
        rows = rows.where(looks_like_test(F.col("path")) if scope == "test" else ~looks_like_test(F.col("path")))
    rows = rows.withColumn("directory", F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))
    sizes = rows.groupBy("directory").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.sum(F.char_length("path")).alias("chars"))
    ranked = rank_in_groups(sizes.withColumn("_all", F.lit(1)), ["_all"], ["n", "directory"])
    by = Window.partitionBy("_all").orderBy("rank")  # directories, not files
    spent = ranked.withColumns({"_lines": F.sum(F.col("n") + 1).over(by), "_tokens": F.sum(F.col("chars") / 4 + 4).over(by)})
    left = F.count("*").over(Window.partitionBy("_all")) - F.col("rank") - 1  # a line for each directory still to come
    fits = F.col("_lines") + left <= max_lines
    if max_tokens is not None:
        fits = fits & (F.col("_tokens") <= max_tokens)
    chosen = spent.select("directory", "n", "total", fits.alias("shown"))
    whole = rows.join(chosen.where("shown").select("directory"), "directory", "left_semi").select("directory", "path", F.concat(F.lit("  "), "path", F.lit(" "), F.col("tokens").cast("string")).alias("line"), "tokens", F.lit(True).alias("shown"))
    short = chosen.where("not shown").select("directory", F.lit(None).cast("string").alias("path"), F.concat("directory", F.lit("/ "), F.col("n").cast("string"), F.lit(" files "), F.col("total").cast("string")).alias("line"), F.col("total").alias("tokens"), F.lit(False).alias("shown"))
    return whole.unionByName(short)


def hidden_by_scope(files: DataFrame, scope: str) -> DataFrame:
    """One row: how many files (path) a scope hides."""
    test = looks_like_test(F.col("path"))
    hidden = F.lit(False) if scope == "all" else (~test if scope == "test" else test)
    return files.agg(F.count_if(hidden).alias("hidden"))


def find_symbol(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """symbols (path, title, size) that match a query (query, name) by their full title or its last segment: two equi
    joins, never a join on either; of each query the largest that is no legacy code, ties by path and title."""
    last = F.element_at(F.split(F.col("title"), r"[.\s]+"), -1)
    rows = symbols.withColumn("_last", last)
    full = rows.join(names, F.lower("title") == F.lower("name"))
    segment = rows.where("lower(title) <> lower(_last)").join(names, F.lower("_last") == F.lower("name"))
    hits = full.withColumn("exact", F.lit(1)).unionByName(segment.withColumn("exact", F.lit(0)))
    legacy = F.lower("path").contains("legacy").cast("int")
    best = hits.groupBy("query").agg(F.min(F.struct(-F.col("exact"), legacy, -F.col("size"), "path", "title")).alias("b"), F.count("*").alias("matches"))
    return best.select("query", "b.path", "b.title", "matches")
