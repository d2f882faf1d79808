"""The general data problems as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import all_descendants, hierarchy, latest_links
from tessera.operators.history import fact_history
from tessera.operators.timestamps import normalize_instants, utc_text, with_session_zone
from tessera.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_history(table(spark, sf_dir, "facts")).select("subject", "attribute", "valid_from")


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_history(table(spark, sf_dir, "facts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda name, kind, key, session, raw: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("rec_key"), session.alias("session_id"), F.col(raw).alias("raw"))
    records = rows("messages", "message", "id", F.col("session_id"), "time_created")
    records = records.unionByName(rows("turns", "turn", "turn_id", F.col("session_id"), "timestamp"))
    records = records.unionByName(rows("leaves", "leaf", "leaf_id", F.lit(None).cast("string"), "timestamp"))
    zoned = with_session_zone(records.where("rec_key is not null and raw is not null"), table(spark, sf_dir, "sessions"))
    utc = utc_text(F.col("epoch"))
    return normalize_instants(zoned.drop("session_id"), "raw", "_zone", source="kind").select("kind", "rec_key", utc.alias("utc")).where("utc is not null").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(latest_links(table(spark, sf_dir, "catalog_entries")))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(latest_links(table(spark, sf_dir, "catalog_entries")), paths=True)
    return tree.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with each node below it and their distance; `loop` tells nodes on or below a loop."""
    return all_descendants(latest_links(table(spark, sf_dir, "catalog_entries")))[1]


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with the number of its descendants and the deepest one's distance; leaves have 0; `loop` as in p4_pairs."""
    marks, pairs = all_descendants(latest_links(table(spark, sf_dir, "catalog_entries")))
    below = pairs.groupBy("id").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))
    return marks.join(below, "id", "left").select("id", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce("height", F.lit(0)).alias("height"), "loop")


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _bare(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '{_WS}+', ' ', 'g'))"


_EPOCH = r"cast(floor(case when regexp_matches(t, '(Z|[+-]\d\d:\d\d)$') then epoch(try_cast(t as timestamptz)) else epoch(try_cast(t as timestamp)) end) as bigint)"
_ISO = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_VERSIONS = f"""f as (select *, {_EPOCH} as epoch from (select {_bare("subject")} as subject, {_bare("attribute")} as attribute, {_bare("value")} as value, trim(timestamp) as t, fact_id from facts)),
    d as (select *, row_number() over (partition by subject, attribute, epoch order by fact_id desc nulls last, value desc) as r from f where epoch is not null and value <> '' and subject is not null and attribute is not null),
    g as (select *, lag(value) over (partition by subject, attribute order by epoch) as before from d where r = 1),
    v as (select *, lead(epoch) over (partition by subject, attribute order by epoch) as until from g where before is null or before <> value)"""
_LINKS = f"select id, nullif(r.parent, '') as parent from (select {_trim('id')} as id, max(struct_pack(timestamp := timestamp, parent := {_trim('parent_id')})) as r from catalog_entries where {_trim('id')} <> '' group by 1)"
#: links (id, parent); down (id, root, depth, path) of ids with a root; stuck (id, loop) of the others, with the ids of their loop.
LINKS_SQL = f"""links as ({_LINKS}), ups as (select l.id, p.id as parent from links l left join links p on p.id = l.parent),
    down as (select id, id as root, 0 as depth, [id] as path from ups where parent is null union all select u.id, d.root, d.depth + 1, list_append(d.path, u.id) from down d join ups u on u.parent = d.id),
    walk as (select id, parent as nx, [id] as path from ups where id not in (select id from down) union all select w.id, u.parent, list_append(w.path, w.nx) from walk w join ups u on u.id = w.nx where not list_contains(w.path, w.nx)),
    stuck as (select id, path[list_position(path, nx):] as loop from (select id, arg_max(nx, len(path)) as nx, arg_max(path, len(path)) as path from walk group by id))"""
_BELOW = """below as (select id as top, id, 0 as distance, [id] as path from ups union all select b.top, u.id, b.distance + 1, list_append(b.path, u.id) from below b join ups u on u.parent = b.id where not list_contains(b.path, u.id)),
    pairs as (select top as id, id as descendant, cast(min(distance) as integer) as distance from below where top <> id group by top, below.id),
    marks as (select ups.id, case when list_contains(loop, ups.id) then 'on' when loop is not null then 'below' end as loop from ups left join stuck using (id))"""

QUERIES = {f.__name__: f for f in (p2_found, p2_history, p3_found, p4_found, p4_paths, p4_pairs, p4_descendants)}
ORACLE: dict[str, str] = {
    "p2_found": f"with {_VERSIONS} select subject, attribute, {_ISO.format('epoch')} as valid_from from v",
    "p2_history": f"with {_VERSIONS} select subject, attribute, value, {_ISO.format('epoch')} as valid_from, {_ISO.format('until')} as valid_to from v",
    "p4_found": f"with recursive {LINKS_SQL} select id, root as root_id, depth from down union all select id, list_min(loop), -1 from stuck",
    "p4_paths": f"with recursive {LINKS_SQL} select id, root as root_id, depth, array_to_string(path, '/') as path from down union all select id, list_min(loop), -1, null from stuck",
    "p4_pairs": f"with recursive {LINKS_SQL}, {_BELOW} select pairs.id, descendant, distance, loop from pairs join marks on marks.id = pairs.id",
    "p4_descendants": f"with recursive {LINKS_SQL}, {_BELOW} select marks.id, count(descendant) as n_descendants, cast(coalesce(max(distance), 0) as integer) as height, any_value(loop) as loop from marks left join pairs on pairs.id = marks.id group by marks.id",
}
