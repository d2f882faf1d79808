"""Queries over the test tables, one for each operator, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import notes, terms, text
from tessera.operators import capture, chunking, classify, facts, index, ranking, search, store, summaries, tree
from tessera.operators.hierarchy import hierarchy, latest_links
from tessera.operators.timestamps import utc_text
from tessera.plans import problems
from tessera.session import shared_dir, table, written
from tessera.streaming.capture import streamed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_index(spark: SparkSession, d: str) -> index.Index:
    return index.table_index(spark, d, "documents")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NORM = "lower(strip_accents({}))"
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _terms_sql(source: str, ids: str, stop: bool = True) -> str:
    keep = f"where term not in ({_list(terms.STOP)}) and not regexp_matches(term, '^[0-9]+$')" if stop else ""
    return f"""
        select {ids}, term from (
            select {ids}, unnest(list_concat(
                case when length(n) >= 2 then [n] else []::varchar[] end,
                case when len(parts) > 1 then list_filter(list_transform(parts, lambda x: lower(x)), lambda x: length(x) >= 2) else []::varchar[] end,
                case when contains(w, '_') then list_filter(list_transform(string_split(w, '_'), lambda x: lower(strip_accents(x))), lambda x: length(x) >= 2 and x <> n) else []::varchar[] end)) as term
            from (select *, lower(strip_accents(w)) as n, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z0-9]+|[A-Z]{{2,}}|[a-z0-9]+') as parts
                  from (select {ids}, unnest(regexp_extract_all(text, '[0-9A-Za-z_À-ɏ]+')) as w from {source}))
        ) {keep}"""


def _slug_sql(c: str, size: int = 48) -> str:
    return f"coalesce(nullif(left(regexp_replace(trim(regexp_replace(trim(lower(strip_accents({c}))), '[^a-z0-9._-]+', '-', 'g'), '-._'), '-{{2,}}', '-', 'g'), {size}), ''), 'general')"


# ---------------------------------------------------------------- text
@query("select doc_id, md5(lower(strip_accents(text))) as norm_md5 from documents")
def norm_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm_md5"))


@query(f"select distinct source, {_slug_sql('source')} as slug from documents")
def slug_sources(spark, d):
    return docs(spark, d).select("source", text.slug(F.col("source")).alias("slug")).distinct()


@query("select doc_id, cast(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as integer) as tokens from documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select doc_id, count(*) as n_terms, count(distinct term) as n_distinct from ({_terms_sql('documents', 'doc_id', False)}) group by doc_id")
def tokenize_counts(spark, d):
    counts = terms.term_rows(docs(spark, d), ["doc_id"], content=False).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.count("*").alias("n_distinct"))


@query(f"select term, count(*) as n, count(distinct doc_id) as df from ({_terms_sql('documents', 'doc_id')}) group by term order by n desc, term limit 50")
def content_terms_topk(spark, d):
    counts = terms.term_rows(docs(spark, d), ["doc_id"]).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "term").limit(50)


@query(f"""select doc_id, string_agg(term, ' ' order by n desc, term) as keywords from (
    select *, row_number() over (partition by doc_id order by n desc, term) as r from (select doc_id, term, count(*) as n from ({_terms_sql('documents', 'doc_id')}) group by doc_id, term)) where r <= 12 group by doc_id""")
def keywords_per_doc(spark, d):
    return terms.keywords(docs(spark, d), ["doc_id"])


@query(rf"""with e as (
      select doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda x: regexp_matches(x, '^[A-ZÀ-Ü]') and length(x) >= 3 and lower(strip_accents(x)) not in ({_list(terms.STOP)}))) as entity from documents
      union all select doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*'))) from documents)
    select doc_id, entity, n, rank from (select *, row_number() over (partition by doc_id order by n desc, entity) as rank from (select doc_id, entity, count(*) as n from e group by doc_id, entity)) where rank <= 12""")
def entities_per_doc(spark, d):
    return terms.entities(docs(spark, d), ["doc_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(r"""select doc_id, case when length(t) <= 320 then t else rtrim(left(t, 319)) || '…' end as excerpt from (select doc_id, trim(regexp_replace(text, '%s+', ' ', 'g')) as t from documents)""" % WS)
def truncate_excerpt(spark, d):
    return docs(spark, d).select("doc_id", text.truncate(F.col("text"), 320).alias("excerpt"))


@query(f"""select distinct 'L-' || {_slug_sql('domain', 24)} || '-' || lpad(cast(order_index as varchar), 4, '0') || '-' || left(sha256(source || '|' || cast(order_index as varchar) || '|' || content), 10) as leaf_key from leaves where source is not null and content is not null""")
def leaf_ids(spark, d):
    index = F.col("order_index").cast("string")
    body = F.concat_ws("|", "source", index, "content")
    rows = table(spark, d, "leaves").where("source is not null and content is not null")
    return rows.select(F.concat(F.lit("L-"), text.slug(F.col("domain"), max_length=24), F.lit("-"), F.lpad(index, 4, "0"), F.lit("-"), text.short_hash(body, 10)).alias("leaf_key")).distinct()


@query("select sha256(text) as checksum, count(*) as copies, min(doc_id) as first_id from documents group by sha256(text) having count(*) > 1")
def checksum_dups(spark, d):
    rows = docs(spark, d).select(F.sha2("text", 256).alias("checksum"), "doc_id")
    return rows.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _redact_sql() -> str:
    expr = "text"
    for p in notes.SECRETS:
        expr = f"regexp_replace({expr}, '{p}', '[REDACTED]', 'g')"
    assignment = notes.ASSIGNMENT.replace("'", "''")
    return f"select doc_id, md5(regexp_replace({expr}, '{assignment}', '\\1\\2[REDACTED]', 'g')) as redacted from documents"


@query(_redact_sql())
def redact_documents(spark, d):
    return docs(spark, d).select("doc_id", F.md5(notes.redact_secrets(F.col("text"))).alias("redacted"))


@query(rf"""with l as (select doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) as pos from documents),
    k as (select *, row_number() over (partition by doc_id order by pos) as a, row_number() over (partition by doc_id order by pos desc) as b from l where regexp_matches(line, '[^\s]'))
    select doc_id, count(*) as kept, count(distinct line) as kept_distinct from k where a <= 3 or b <= 5 or regexp_matches(line, '{notes.DIGEST}') group by doc_id""")
def digest_lines(spark, d):
    return notes.digest_lines(docs(spark, d)).groupBy("doc_id").agg(F.sum("times").alias("kept"), F.count("*").alias("kept_distinct"))


@query(f"""select doc_id, string_agg(t, chr(10) order by p) as kept from (select doc_id, lower(strip_accents(t)) as n, arg_min(t, p) as t, min(p) as p from (
    select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as p from documents) where trim(t, ' ') <> '' group by 1, 2) group by doc_id""")
def dedupe_lines(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    return terms.ordered_distinct(rows, ["doc_id"], "t", ["p"]).select("doc_id", F.array_join("items", "\n").alias("kept"))


@query("""select leaf_id, string_agg(t, ' ' order by p) as tags from (
    select leaf_id, lower(strip_accents(t)) as n, arg_min(t, p) as t, min(p) as p from (
        select leaf_id, unnest(v) as t, generate_subscripts(v, 1) as p from (select leaf_id, list_concat(max(tags), max(keywords)) as v from leaves group by leaf_id)) where t <> '' group by leaf_id, lower(strip_accents(t))) group by leaf_id""")
def dedupe_tags(spark, d):
    once = table(spark, d, "leaves").groupBy("leaf_id").agg(F.concat(F.max("tags"), F.max("keywords")).alias("v"))
    rows = once.select("leaf_id", F.posexplode("v").alias("p", "t"))
    return terms.ordered_distinct(rows, ["leaf_id"], "t", ["p"]).select("leaf_id", F.array_join("items", " ").alias("tags"))


# ---------------------------------------------------------------- dates
@query("""select distinct o_orderdate, s.style, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' as parsed from orders, (values ('iso'), ('dmy'), ('mdy'), ('numeric')) s(style)""")
def extract_date_styles(spark, d):
    day = F.col("o_orderdate")
    f = lambda pattern: F.date_format(day, pattern)
    styles = {"iso": f("yyyy-MM-dd"), "dmy": F.concat(f("d"), F.lit(" de "), F.lower(f("MMMM")), F.lit(" de "), f("yyyy")), "mdy": f("MMMM d, yyyy"), "numeric": f("d/M/yyyy")}
    shown = F.explode(F.array(*[F.struct(F.lit(k).alias("style"), F.concat(F.lit("seen "), v, F.lit(" then")).alias("shown")) for k, v in styles.items()]))
    rows = table(spark, d, "orders").select("o_orderdate").distinct().select("o_orderdate", shown.alias("s")).select("o_orderdate", "s.*")
    return rows.select("o_orderdate", "style", notes.extract_date(F.col("shown")).alias("parsed"))


_LEAD = r"^\s*[#*\[(]*\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})\b"


@query(rf"""select doc_id, case when d like '____-%' then printf('%04d-%02d-%02dT00:00:00Z', cast(string_split(d, '-')[1] as int), cast(string_split(d, '-')[2] as int), cast(string_split(d, '-')[3] as int))
      when n[2] > 12 and n[1] <= 12 then printf('%04d-%02d-%02dT00:00:00Z', case when n[3] < 100 then n[3] + 2000 else n[3] end, n[1], n[2])
      else printf('%04d-%02d-%02dT00:00:00Z', case when n[3] < 100 then n[3] + 2000 else n[3] end, n[2], n[1]) end as opened
    from (select doc_id, d, list_transform(regexp_split_to_array(d, '[/.-]'), lambda x: cast(x as int)) as n from (select doc_id, regexp_extract(text, '{_LEAD}', 1) as d from documents) where d <> '')""")
def leading_dates(spark, d):
    return docs(spark, d).select("doc_id", notes.leading_date(F.col("text")).alias("opened")).where("opened is not null")


@query("select id, timestamp from catalog_entries where left(timestamp, 10) >= '2025-01-01'")
def since_filter(spark, d):
    return table(spark, d, "catalog_entries").where(F.left("timestamp", F.lit(10)) >= "2025-01-01").select("id", "timestamp")


@query("select id, strftime(make_timestamp(time_created * 1000), '%Y-%m-%dT%H:%M:%SZ') as created from sessions where time_created is not null")
def epoch_ms_iso(spark, d):
    return table(spark, d, "sessions").where("time_created is not null").select("id", utc_text(F.floor(F.col("time_created") / 1000)).alias("created"))


@query("select path, strftime(timestamp '2000-01-01' + to_seconds(cast(row_number() over (order by path) - 1 as bigint)), '%Y-%m-%dT%H:%M:%SZ') as stamp from (select distinct source as path from blocks)")
def path_order_timestamp(spark, d):
    paths = table(spark, d, "blocks").select(F.lit(1).alias("k"), F.col("source").alias("path")).distinct()
    return ranking.rank_in_groups(paths, ["k"], ["path"]).select("path", utc_text(F.col("rank") + 946684800).alias("stamp"))


# ---------------------------------------------------------------- ranking
ASKED = "cache index backup pipeline meeting kettle"


def _bm25_sql(queries: str) -> str:
    return f"""
      t as ({_terms_sql('documents', 'doc_id')}),
      tf as (select doc_id, term, count(*) as tf from t group by doc_id, term),
      dl as (select doc_id, sum(tf) as len from tf group by doc_id),
      st as (select (select count(*) from documents) as n, greatest(1.0, coalesce((select sum(len) from dl), 0) / greatest(1, (select count(*) from documents))) as avg_len),
      q as (select distinct item_id, term from ({_terms_sql(queries, 'item_id')})),
      qs as (select item_id, count(*) as n_terms from q group by item_id),
      df as (select term, count(*) as df from tf group by term),
      s as (select q.item_id, tf.doc_id, sum(greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * cast(len as double) / cast(avg_len as double)))) as score, count(*) as matched
            from q join tf using (term) join df using (term) join dl using (doc_id), st group by q.item_id, tf.doc_id),
      scored as (select item_id, doc_id, round(score, 6) as score, round(cast(matched as double) / n_terms, 6) as coverage from s join qs using (item_id))"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ASKED)], "item_id bigint, text string")


_ONE = f"(select cast(1 as bigint) as item_id, '{ASKED}' as text)"


@query(f"with {_bm25_sql(_ONE)} select doc_id, score, coverage from scored order by score desc, doc_id limit 20")
def bm25_topk(spark, d):
    return ranking.bm25(doc_index(spark, d), _asked(spark)).select("doc_id", "score", "coverage").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"with {_bm25_sql('eval_items')} select item_id, doc_id, score, coverage, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 3")
def bm25_batch_queries(spark, d):
    return ranking.top_k(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items")), 3)


@query(f"with {_bm25_sql('eval_items')}, x as (select item_id, doc_id, round(score * (0.05 + coverage * coverage), 6) as score from scored) select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x) where rank <= 3")
def coverage_rescale(spark, d):
    return ranking.top_k(ranking.rescaled(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items"))).drop("coverage"), 3)


@query(f"""with {_bm25_sql('eval_items')}, w as (select *, row_number() over o as rn, lead(score) over o as nxt, first_value(score) over o as best from scored window o as (partition by item_id order by score desc, doc_id)),
    tt as (select item_id, count(*) filter (score >= best * 0.82) as near_ties from w group by item_id)
    select item_id, score as best_score, round(least(1.0, 0.6 * coverage + 0.4 * (case when nxt is null then 1.0 else (score - nxt) / nullif(score, 0) end)), 4) as confidence, coverage < 0.3 as weak, near_ties from w join tt using (item_id) where rn = 1""")
def confidence_margin(spark, d):
    return ranking.confidence(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items")))


_SPLIT_ITEMS = "(select item_id, left(text, length(text) // 2) as text from eval_items)", "(select item_id, substr(text, length(text) // 2 + 1) as text from eval_items)"


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    items = table(spark, d, "eval_items")
    half = F.floor(F.char_length("text") / 2).cast("int")
    return [items.select("item_id", F.left("text", half).alias("text")), items.select("item_id", F.substr("text", half + 1).alias("text"))]


@query(f"""select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from (
    select coalesce(x.item_id, y.item_id) as item_id, coalesce(x.doc_id, y.doc_id) as doc_id, round((coalesce(x.score, 0.0) + coalesce(y.score, 0.0)) * case when x.score > 0 and y.score > 0 then 1.6 else 0.7 end, 6) as score
    from (with {_bm25_sql(_SPLIT_ITEMS[0])} select * from scored) x full join (with {_bm25_sql(_SPLIT_ITEMS[1])} select * from scored) y on x.item_id = y.item_id and x.doc_id = y.doc_id)) where rank <= 3""")
def bm25_two_groups(spark, d):
    return ranking.top_k(ranking.two_groups(doc_index(spark, d), *_halves(spark, d)).drop("coverage"), 3)


_LEAF_TEXT = "(select leaf_id as doc_id, repeat(title || ' ', 3) || ' ' || repeat(array_to_string(keywords, ' ') || ' ', 3) || ' ' || repeat(replace(array_to_string(tags, ' '), ':', ' ') || ' ', 2) || ' ' || content as text from (select leaf_id, max(title) as title, max(keywords) as keywords, max(tags) as tags, max(content) as content from leaves group by leaf_id))"
_FIELDS = f"with {_bm25_sql(_ONE)} select doc_id, score, coverage from scored order by score desc, doc_id limit 20".replace("from documents", f"from {_LEAF_TEXT}")


@query(_FIELDS)
def bm25_field_weighted(spark, d):
    leaves = table(spark, d, "leaves").groupBy(F.col("leaf_id").alias("doc_id")).agg(F.max("title").alias("title"), F.array_join(F.max("keywords"), " ").alias("keywords"), F.replace(F.array_join(F.max("tags"), " "), F.lit(":"), F.lit(" ")).alias("tags"), F.max("content").alias("content"))
    text_column = ranking.weighted_text(leaves, {"title": 3, "keywords": 3, "tags": 2, "content": 1})
    return ranking.bm25(leaves.select("doc_id", text_column.alias("text")), _asked(spark)).select("doc_id", "score", "coverage").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""with a as (select distinct item_id as new_id, term from ({_terms_sql('eval_items', 'item_id')})), b as (select distinct doc_id as old_id, term from ({_terms_sql('documents', 'doc_id')})),
    n as (select new_id, count(*) as n from a group by new_id), m as (select new_id, old_id, round(cast(count(*) as double) / any_value(n), 6) as held from a join b using (term) join n using (new_id) group by new_id, old_id)
    select new_id, old_id, held from (select *, row_number() over w as r, lead(held) over w as nxt from m where held >= 0.5 window w as (partition by new_id order by held desc, old_id)) where r = 1 and (nxt is null or nxt < held)""")
def held_overlap(spark, d):
    items = table(spark, d, "eval_items").withColumnRenamed("item_id", "new_id")
    return ranking.held_overlap(items, docs(spark, d).withColumnRenamed("doc_id", "old_id"))


@query("""select question, pos, outcome, confidence from (select *, row_number() over (partition by question order by outcome desc, confidence desc, pos) as r from (
    select session_id as question, ord as pos, case when role = 'assistant' then 3 else 1 end as outcome, length(coalesce(text, '')) as confidence from (select distinct session_id, ord, role, text from turns where session_id is not null))) where r = 1""")
def best_formulation(spark, d):
    rows = table(spark, d, "turns").where("session_id is not null").select("session_id", "ord", "role", "text").distinct()
    asked = rows.select(F.col("session_id").alias("question"), F.col("ord").alias("pos"), F.when(F.col("role") == "assistant", 3).otherwise(1).alias("outcome"), F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("confidence"))
    return ranking.best_formulation(asked)


_JUDGED_SQL = """w as (select *, row_number() over o as rn, lead(score) over o as nxt, first_value(score) over o as best from scored window o as (partition by item_id order by score desc, doc_id)),
    tt as (select item_id, count(*) filter (score >= best * 0.82) as near_ties from w group by item_id),
    judged as (select item_id, score as best_score, round(least(1.0, 0.6 * coverage + 0.4 * (case when nxt is null then 1.0 else (score - nxt) / nullif(score, 0) end)), 4) as confidence, coverage < 0.3 as weak, near_ties from w join tt using (item_id) where rn = 1)"""


@query(f"with {_bm25_sql('eval_items')}, {_JUDGED_SQL} select item_id, reason from (select item_id, case when not weak then nullif(concat_ws('; ', case when confidence < 0.45 then 'low confidence' end, case when near_ties > 1 and n_terms <= 2 then 'underspecified' end), '') end as reason from judged join qs using (item_id)) where reason is not null")
def clue_requests(spark, d):
    items = table(spark, d, "eval_items")
    sizes = terms.term_rows(items, ["item_id"]).groupBy("item_id").agg(F.count_distinct("term").alias("n_terms"))
    return ranking.clue_needed(ranking.confidence(ranking.bm25(doc_index(spark, d), items)), sizes)


@query(f"with {_bm25_sql('eval_items')}, b as (select item_id, max(score) as best from scored group by item_id) select s.item_id, count(*) as ties, count(distinct source) as n_branches from scored s join b on b.item_id = s.item_id and s.score >= b.best * 0.82 join documents using (doc_id) group by s.item_id")
def near_ties(spark, d):
    branches = docs(spark, d).select("doc_id", F.col("source").alias("branch"))
    return ranking.near_ties(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items")), branches)


@query(f"with {_bm25_sql('eval_items')}, {_JUDGED_SQL} select item_id, best_score from judged where weak")
def weak_matches(spark, d):
    return ranking.confidence(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items"))).where("weak").select("item_id", "best_score")


@query(f"""with {_bm25_sql('eval_items')}, t5 as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 5),
    c as (select d.doc_id as old, max(e.doc_id) as new from documents d join documents e on e.text = d.text and e.doc_id > d.doc_id group by d.doc_id),
    b as (select item_id, doc_id as old, new, score, coverage from t5 join c on c.old = t5.doc_id where rank = 1),
    f as (select b.item_id, b.new as doc_id, greatest(b.score, coalesce(x.score, b.score)) as score, greatest(b.coverage, coalesce(x.coverage, b.coverage)) as coverage, 0 as rank, b.old as replaces from b left join t5 x on x.item_id = b.item_id and x.doc_id = b.new),
    u as (select item_id, doc_id, score, coverage, rank, cast(null as bigint) as replaces from t5 where not exists (select 1 from b where b.item_id = t5.item_id and b.new = t5.doc_id) union all select * from f)
    select item_id, cast(doc_id as varchar) as id, score, coverage, row_number() over (partition by item_id order by rank) as rank, cast(replaces as varchar) as replaces from u""")
def current_first(spark, d):
    """Copies of a text stand for corrections of it here: the newest of them goes first."""
    best = ranking.top_k(ranking.bm25(doc_index(spark, d), table(spark, d, "eval_items")), 5).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    texts = docs(spark, d).select(F.sha2("text", 256).alias("t"), "doc_id")
    newest = texts.groupBy("t").agg(F.max("doc_id").alias("new"), F.count("*").alias("n")).where("n > 1")
    pairs = texts.join(newest, "t").where("doc_id < new").select(F.col("doc_id").cast("string").alias("old"), F.col("new").cast("string").alias("new"))
    return search.current_first(best, facts.successors(pairs))


@query()
def summaries_per_doc(spark, d):
    return summaries.summarize(docs(spark, d))


# ---------------------------------------------------------------- facts
_EPOCH_SQL = r"""cast(floor(case when regexp_matches(trim(timestamp), '(Z|[+-]\d\d:\d\d)$') then epoch(try_cast(trim(timestamp) as timestamptz)) else epoch(try_cast(trim(timestamp) as timestamp)) end) as bigint)"""
_KEYED_SQL = f"""k as (select fact_id, value, source_leaf_id, lower(strip_accents(trim(subject, ' ' || chr(9) || chr(10)))) || '::' || lower(strip_accents(trim(attribute, ' ' || chr(9) || chr(10)))) as key, lower(strip_accents(trim(value, ' ' || chr(9) || chr(10)))) as nv, {_EPOCH_SQL} as epoch
    from (select fact_id, unnest(f) from (select fact_id, max(struct_pack(timestamp := timestamp, value := value, subject := subject, attribute := attribute, source_leaf_id := source_leaf_id)) as f from facts where fact_id is not null and subject is not null and attribute is not null and value is not null group by fact_id)))"""
_ISO_SQL = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_KEYED_SQL = _KEYED_SQL.replace("select fact_id, unnest(f) from", "select fact_id, f.timestamp as timestamp, f.value as value, f.subject as subject, f.attribute as attribute, f.source_leaf_id as source_leaf_id from")
_NEWEST = "n as (select key, fact_id, value, nv, epoch from (select *, row_number() over (partition by key order by epoch desc nulls last, fact_id desc) as r from k) where r = 1)"


def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts")


@query(f"with {_KEYED_SQL} select fact_id, key, value, {_ISO_SQL.format('epoch')} as valid_from, {_ISO_SQL.format('nx')} as valid_to, ni as superseded_by, case when ni is null then 'ACTIVE' else 'HISTORICAL' end as status from (select *, lead(fact_id) over o as ni, lead(epoch) over o as nx from k window o as (partition by key order by epoch nulls first, fact_id))")
def facts_timeline(spark, d):
    return facts.timeline(fact_rows(spark, d))


@query(f"with {_KEYED_SQL}, {_NEWEST} select key, fact_id, value, {_ISO_SQL.format('epoch')} as since from n")
def facts_active(spark, d):
    return facts.active(fact_rows(spark, d))


@query(f"with {_KEYED_SQL} select key, fact_id, value from (select *, row_number() over (partition by key order by epoch desc, fact_id desc) as r from k where epoch <= 1735689599) where r = 1")
def facts_as_of(spark, d):
    return facts.state_at(fact_rows(spark, d), 1735689599)


@query(f"with {_KEYED_SQL}, p as (select distinct key, moment from k, (values (1704067200), (1735689600), (1767225600)) v(moment)) select key, cast(moment as bigint) as moment, fact_id, value from (select p.key, moment, fact_id, value, row_number() over (partition by p.key, moment order by epoch desc, fact_id desc) as r from p join k on k.key = p.key and epoch <= moment) where r = 1")
def facts_asof_join_many(spark, d):
    rows = facts.keyed(fact_rows(spark, d)).select("key").distinct()
    probes = rows.select("key", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1704067200, 1735689600, 1767225600)])).alias("moment"))
    return facts.as_of_join(fact_rows(spark, d), probes)


@query(f"with {_KEYED_SQL}, {_NEWEST} select key, new_id, new_value, fact_id as old_id, value as old_value from (select k.key, n.fact_id as new_id, n.value as new_value, k.fact_id, k.value, row_number() over (partition by k.key order by k.epoch desc nulls last, k.fact_id desc) as r from k join n on n.key = k.key where k.nv <> n.nv) where r = 1")
def facts_conflicts(spark, d):
    return facts.conflicts(fact_rows(spark, d))


@query(f"with {_KEYED_SQL}, {_NEWEST} select distinct source_leaf_id, 'outdated: ' || k.key || ' was ' || k.value || ', now ' || n.value || ' since ' || coalesce(left({_ISO_SQL.format('n.epoch')}, 10), '?') as notice from k join n on n.key = k.key where k.nv <> n.nv and source_leaf_id is not null")
def facts_notices(spark, d):
    return facts.notices(fact_rows(spark, d))


def _rules_sql() -> str:
    """Each rule's pattern in the other engine's dialect, where U would mean something else; flags m as in both."""
    plain = lambda p: p.replace("(?iUmd)", "(?im)").replace("(?iU)", "(?i)").replace("'", "''")
    found = " union all ".join(f"select leaf_id, timestamp, content, '{a}' as attribute, unnest(regexp_extract_all(content, '{plain(p)}', 1)) as value from src" for a, p in facts.RULES)
    patient = f"coalesce(nullif({_trim_sql(chr(39).join(['regexp_extract(content, ', plain(facts.PATIENT), ', 1)']))}, ''), 'patient')"
    flat = f"trim(regexp_replace({_trim_sql('value')}, '{WS}+', ' ', 'g'))"
    cut = f"case when length({flat}) <= 120 then {flat} else rtrim(left({flat}, 119)) || '…' end"
    key = f"concat_ws('|', concat_ws('::', {NORM.format('subject')}, attribute), {NORM.format('value')}, coalesce(timestamp, ''))"
    return f"""with src as (select leaf_id, timestamp, content from leaves union all select cast(turn_id as varchar), timestamp, text from turns), f as ({found}),
        r as (select leaf_id, timestamp, attribute, case when attribute in ({_list(facts.CLINICAL)}) then {patient} else 'user' end as subject, {cut} as value from f where {_trim_sql('value')} <> '')
        select distinct leaf_id, subject, attribute, value, 'F-' || left(sha256({key}), 10) as fact_id from r"""


@query(_rules_sql())
def facts_extract_rules(spark, d):
    said = table(spark, d, "turns").select(F.col("turn_id").cast("string").alias("leaf_id"), "timestamp", F.col("text").alias("content"))
    return facts.extract(table(spark, d, "leaves").select("leaf_id", "timestamp", "content").unionByName(said))


@query(f"with {_KEYED_SQL} select fact_id, key, value, epoch from k")
def facts_dedup(spark, d):
    return facts.keyed(fact_rows(spark, d)).select("fact_id", "key", "value", "epoch")


@query(f"with {_KEYED_SQL} select key, fact_id, nx - epoch as seconds from (select *, lead(epoch) over (partition by key order by epoch nulls first, fact_id) as nx from k) where epoch is not null and nx is not null")
def facts_interval_join(spark, d):
    rows = facts.next_in_key(facts.keyed(fact_rows(spark, d)), ["epoch"])
    return rows.where("epoch is not null and next_epoch is not null").select("key", "fact_id", (F.col("next_epoch") - F.col("epoch")).alias("seconds"))


@query(f"with {_KEYED_SQL} select key, fact_id, row_number() over (partition by key order by epoch nulls first, fact_id) - 1 as rank from k")
def ts_sort_nulls_first(spark, d):
    rows = facts.keyed(fact_rows(spark, d)).select("key", "fact_id", "epoch")
    return ranking.rank_in_groups(rows, ["key"], ["epoch", "fact_id"]).select("key", "fact_id", "rank")


@query(f"with {_KEYED_SQL} select key, count(*) as n, string_agg(fact_id, ' ' order by epoch nulls first, fact_id) as ids from k group by key")
def facts_history_grouped(spark, d):
    return facts.timelines(fact_rows(spark, d)).select("key", F.size("values").cast("bigint").alias("n"), F.array_join(F.transform("values", lambda x: x["fact_id"]), " ").alias("ids"))


@query("""with recursive e as (select leaf_id as old, max(superseded_by) as new from leaves where superseded_by is not null and leaf_id is not null and leaf_id <> superseded_by group by leaf_id),
    w as (select old as id, new as nx, [old] as path from e union all select w.id, e.new, list_append(w.path, w.nx) from w join e on e.old = w.nx where not list_contains(w.path, w.nx)),
    ends as (select id, arg_max(nx, len(path)) as nx, arg_max(path, len(path)) as path from w group by id)
    select id, case when list_contains(path, nx) then list_min(path[list_position(path, nx):]) else nx end as current, cast(case when list_contains(path, nx) then -1 else len(path) end as integer) as hops from ends""")
def successor_chain(spark, d):
    return facts.successors(table(spark, d, "leaves").select(F.col("leaf_id").alias("old"), F.col("superseded_by").alias("new")))


# ---------------------------------------------------------------- tree
_LATEST_SQL = f"""c as (select id, r.timestamp as timestamp, r.kind as kind, r.layer as layer, r.domain as domain, r.path as path, r.parent_id as parent_id, r.title as title, r.leaf_count as leaf_count, r.status as status, r.source as source from (
    select {_trim_sql('id')} as id, max(struct_pack(timestamp := timestamp, kind := kind, layer := layer, domain := domain, path := path, parent_id := parent_id, title := title, leaf_count := leaf_count, status := status, source := source)) as r from catalog_entries where {_trim_sql('id')} <> '' group by 1))"""
_BATCH_SQL = "b{k} as (select * from (select *, count(*) over (partition by domain, g) as n from (select *, cast((row_number() over (partition by domain order by coalesce(timestamp, ''), id) - 1) // 8 as bigint) as g from l{j})) where n >= 8)"
_LAYER_SQL = (
    _BATCH_SQL + ", l{k} as (select 'N{k}-' || {slug} || '-' || left(sha256(string_agg(id, '|' order by coalesce(timestamp, ''), id)), 10) as id, domain, max(nullif(timestamp, '')) as timestamp, min(nullif(ts_start, '')) as ts_start, cast(sum(leaf_count) as bigint) as leaf_count, count(*) as children, cast({k} as integer) as layer from b{k} group by domain, g)"
)


def _layers_sql(n: int) -> str:
    start = f"{_LATEST_SQL}, l0 as (select id, domain, timestamp, timestamp as ts_start, leaf_count from c where layer = 0)"
    return ", ".join([start, *(_LAYER_SQL.format(k=k, j=k - 1, slug=_slug_sql("domain", 24)) for k in range(1, n + 1))])


def entries(spark: SparkSession, d: str) -> DataFrame:
    return tree.latest_entries(table(spark, d, "catalog_entries"))


@query(f"with {_layers_sql(1)} select id, domain, g as batch from b1")
def pending_batches(spark, d):
    return tree.batches(entries(spark, d).where("layer = 0")).select("id", "domain", "batch")


@query(f"with {_layers_sql(6)} " + " union all ".join(f"select id, layer, domain, timestamp, ts_start, leaf_count, children from l{k}" for k in range(1, 7)))
def build_all_layers(spark, d):
    built = tree.build_tree(entries(spark, d).where("layer = 0"))
    return built.select("id", "layer", "domain", "timestamp", "ts_start", "leaf_count", F.size("children").cast("bigint").alias("children"))


@query(f"with {_layers_sql(1)} select id, layer, domain, timestamp, ts_start, leaf_count, children from l1")
def build_layer1(spark, d):
    leaves = entries(spark, d).where("layer = 0")
    built = tree.build_layer(leaves.select("id", "domain", "timestamp", F.col("timestamp").alias("ts_start"), "leaf_count"), 1)
    return built.select("id", "layer", "domain", "timestamp", "ts_start", "leaf_count", F.size("children").cast("bigint").alias("children"))


_ALL_LAYERS = " union all ".join(f"select id, layer, domain, timestamp, ts_start, leaf_count from l{k}" for k in range(1, 7))


@query(f"with {_layers_sql(6)} select domain, layer, count(*) as nodes, cast(sum(leaf_count) as bigint) as leaves from ({_ALL_LAYERS}) group by domain, layer")
def tree_rollup_counts(spark, d):
    return tree.build_tree(entries(spark, d).where("layer = 0")).groupBy("domain", "layer").agg(F.count("*").alias("nodes"), F.sum("leaf_count").alias("leaves"))


@query(f"with {_layers_sql(6)} select domain, layer, min(ts_start) as first, max(timestamp) as last from ({_ALL_LAYERS}) group by domain, layer")
def tree_time_range(spark, d):
    return tree.build_tree(entries(spark, d).where("layer = 0")).groupBy("domain", "layer").agg(F.min("ts_start").alias("first"), F.max("timestamp").alias("last"))


@query(f"""with recursive {_layers_sql(6)}, m as (select b.id as child, n.id as parent, n.layer from ({" union all ".join(f"select id, domain, g, coalesce(timestamp, '') as ts, {k} as layer from b{k}" for k in range(1, 7))}) b
      join ({" union all ".join(f"select distinct domain, g, {k} as layer, 'N{k}-' || {_slug_sql('domain', 24)} || '-' || left(sha256(string_agg(id, '|' order by coalesce(timestamp, ''), id) over (partition by domain, g order by coalesce(timestamp, ''), id rows between unbounded preceding and unbounded following)), 10) as id from b{k}" for k in range(1, 7))}) n using (domain, g, layer)),
    r as (select parent as id, child as leaf from m where layer = 1 union all select m.parent, r.leaf from r join m on m.child = r.id)
    select id, count(*) as leaves, count(distinct leaf) as distinct_leaves from r group by id""")
def reachable_leaves(spark, d):
    below = tree.leaves_below(tree.build_tree(entries(spark, d).where("layer = 0")))
    return below.groupBy("id").agg(F.count("*").alias("leaves"), F.count_distinct("leaf").alias("distinct_leaves"))


@query(f"with {_layers_sql(1)} select id, domain from l0 where id not in (select id from b1)")
def unreached_leaves(spark, d):
    leaves = entries(spark, d).where("layer = 0")
    built = tree.build_layer(leaves.select("id", "domain", "timestamp", F.col("timestamp").alias("ts_start"), "leaf_count"), 1)
    return leaves.select("id", "domain").join(tree.unreached(leaves, built), "id", "left_semi")


@query(f"with {_LATEST_SQL} select coalesce(domain, '*') as domain, coalesce(cast(layer as varchar), '*') as layer, count(*) as entries, cast(sum(leaf_count) as bigint) as leaves, count(*) filter (status = 'HISTORICAL') as historical, min(nullif(timestamp, '')) as first, max(nullif(timestamp, '')) as last from c group by grouping sets ((domain), (layer), ())")
def stats_grouping_sets(spark, d):
    rows = tree.statistics(entries(spark, d))
    return rows.withColumns({"domain": F.coalesce("domain", F.lit("*")), "layer": F.coalesce(F.col("layer").cast("string"), F.lit("*"))})


@query(f"with {_LATEST_SQL} select a.domain, count(*) as top_nodes, cast(sum(a.leaf_count) as bigint) as leaf_count, min(nullif(a.timestamp, '')) as first, max(nullif(a.timestamp, '')) as last from c a left join c p on p.id = nullif({_trim_sql('a.parent_id')}, '') where p.id is null group by a.domain")
def trunk_domains(spark, d):
    return tree.trunk(entries(spark, d))


@query(f"""select domain, string_agg(term, ' ' order by n desc, term) as topics from (select *, row_number() over (partition by domain order by n desc, term) as r from (
    select domain, term, count(*) as n from ({_terms_sql("(select coalesce(domain, '') as domain, text from documents)", 'domain')}) group by domain, term)) where r <= 5 group by domain""")
def topics_per_domain(spark, d):
    return terms.keywords(docs(spark, d).select(F.coalesce("domain", F.lit("")).alias("domain"), "text"), ["domain"], top_k=5).withColumnRenamed("keywords", "topics")


_TREE_SQL = f"""{_LATEST_SQL}, """ + problems.LINKS_SQL


@query(f"with recursive {_TREE_SQL} select array_to_string(down.path, '/') as path, repeat('  ', len(down.path) - 1) || title || ' (' || cast(leaf_count as varchar) || ')' as line from down join c using (id) where len(down.path) <= 3")
def tree_outline(spark, d):
    rows = table(spark, d, "catalog_entries")
    paths = hierarchy(latest_links(rows), paths=True)
    return summaries.outline(tree.latest_entries(rows), paths.select("id", "path"))


@query(f"with recursive {_TREE_SQL} select id, array_to_string(list_append(list_reverse(path), 'root'), '/') as path from down")
def path_to_root(spark, d):
    """Of each id that has a root the way up to it."""
    paths = hierarchy(latest_links(table(spark, d, "catalog_entries")), paths=True).where("path is not null")
    return paths.select("id", F.array_join(F.concat(F.reverse("path"), F.array(F.lit("root"))), "/").alias("path"))


@query(f"with recursive {_TREE_SQL} select c.id from c where layer = 0 and id not in (select id from down)")
def reachability_violations(spark, d):
    """Leaves that no way leads to from a root, as they are on or below a loop of parents."""
    lost = hierarchy(latest_links(table(spark, d, "catalog_entries"))).where("depth < 0").select("id")
    return entries(spark, d).where("layer = 0").select("id").join(lost, "id", "left_semi")


# ---------------------------------------------------------------- store
@query(f"with {_LATEST_SQL} select id, source from c where (status is null or status <> 'HISTORICAL') and left(timestamp, 10) >= '2024-06-01' and (not regexp_matches(lower(coalesce(source, '')), '{store.CODE_PATH}') or not regexp_matches(coalesce(source, ''), '{store.TEST_PATH}'))")
def admissible_main(spark, d):
    return store.admissible(entries(spark, d), "main", since="2024-06-01").select("id", "source")


@query(f"with {_LATEST_SQL} select id, regexp_matches(lower(coalesce(source, '')), '{store.CODE_PATH}') as code, regexp_matches(coalesce(source, ''), '{store.TEST_PATH}') as test from c")
def scope_test_main(spark, d):
    return entries(spark, d).select("id", store.looks_like_code(F.col("source")).alias("code"), store.looks_like_test(F.col("source")).alias("test"))


@query(f"with {_LATEST_SQL} select id, timestamp, status, parent_id from c")
def upsert_latest(spark, d):
    rows = table(spark, d, "catalog_entries").withColumn("id", text.trimmed(F.col("id"))).where("id <> ''")
    columns = ["kind", "layer", "domain", "path", "parent_id", "title", "leaf_count", "status", "source"]
    rows = rows.select("id", "timestamp", *columns)
    return store.upsert_latest(rows.where("kind = 'node'"), rows.where("kind <> 'node'"), "id", "timestamp").select("id", "timestamp", "status", "parent_id")


@query("""with cur as (select source, leaf_id from leaves where status = 'ACTIVE'), f as (select source, min(leaf_id) as m from cur group by source)
    select distinct l.leaf_id, l.source, case when f.m is not null and k.leaf_id is null then 'HISTORICAL' else l.status end as status, case when f.m is not null and k.leaf_id is null then f.m end as superseded_by
    from leaves l left join f on f.source = l.source left join (select distinct leaf_id from cur) k on k.leaf_id = l.leaf_id""")
def demote_previous(spark, d):
    rows = table(spark, d, "leaves")
    return store.demote_previous(rows.select("leaf_id", "source", "status"), rows.where("status = 'ACTIVE'").select("source", "leaf_id")).distinct()


@query(f"""with n as (select leaf_id, max(title) as title from leaves group by leaf_id), o as (select {_trim_sql('id')} as leaf_id, arg_max({_trim_sql('parent_id')}, timestamp) as parent_id, arg_max(status, timestamp) as status from catalog_entries group by 1), p as (select distinct {_trim_sql('id')} as id from catalog_entries)
    select n.leaf_id, n.title, p.id as parent_id, coalesce(o.status, 'ACTIVE') as status from n left join o on o.leaf_id = n.leaf_id left join p on p.id = o.parent_id""")
def save_preserving_parent(spark, d):
    new = table(spark, d, "leaves").groupBy("leaf_id").agg(F.max("title").alias("title"))
    rows = table(spark, d, "catalog_entries").select(text.trimmed(F.col("id")).alias("leaf_id"), text.trimmed(F.col("parent_id")).alias("parent_id"), "status", "timestamp")
    old = rows.groupBy("leaf_id").agg(F.max_by("parent_id", "timestamp").alias("parent_id"), F.max_by("status", "timestamp").alias("status")).withColumn("superseded_by", F.lit(None).cast("string"))
    return store.preserving_parent(new, old, rows.select(F.col("leaf_id").alias("id"))).drop("superseded_by")


@query("""with a as (select source as path, count(*) as size, max(ord) as m from blocks group by source), b as (select source as path, cast(sum(meta.blocks) as bigint) as size, max(ord) as m from (select distinct source, ord, meta from chunks) group by source)
    select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' when a.size <> b.size or a.m <> b.m then 'changed' else 'same' end as change from a full join b on a.path = b.path""")
def sync_diff(spark, d):
    scanned = table(spark, d, "blocks").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("size"), F.max("ord").alias("digest"))
    known = table(spark, d, "chunks").select("source", "ord", "meta").distinct().groupBy(F.col("source").alias("path")).agg(F.sum("meta.blocks").alias("size"), F.max("ord").alias("digest"))
    return store.sync_diff(known, scanned)


@query("select source from (select distinct source from blocks) b where source not in (select source from documents where source is not null)")
def anti_removed(spark, d):
    return table(spark, d, "blocks").select("source").distinct().join(docs(spark, d).select("source"), "source", "left_anti")


@query("""with f as (select source as path, sum(length(text)) // 4 as tokens from documents where source is not null group by source),
    p as (select path, tokens, string_split(path, '/') as s from f)
    select directory, count(*) as files, cast(sum(tokens) as bigint) as tokens from (select tokens, unnest(case when len(s) > 1 then list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/')) else ['.'] end) as directory from p) group by directory""")
def project_map(spark, d):
    files = docs(spark, d).where("source is not null").groupBy(F.col("source").alias("path")).agg(F.floor(F.sum(F.char_length("text")) / 4).alias("tokens"))
    return store.project_map(files)


@query("""with s as (select distinct source as path, title, length(title) as size, list_last(regexp_split_to_array(title, '[.\\s]+')) as l from chunks where title is not null), q as (select distinct title as query from blocks where title <> ''),
    h as (select query, path, title, size, 1 as exact from s join q on lower(title) = lower(query) union all select query, path, title, size, 0 from s join q on lower(l) = lower(query) where lower(title) <> lower(l))
    select query, path, title, matches from (select *, count(*) over (partition by query) as matches, row_number() over (partition by query order by exact desc, contains(lower(path), 'legacy'), size desc, path, title) as r from h) where r = 1""")
def symbol_lookup(spark, d):
    symbols = table(spark, d, "chunks").where("title is not null").select(F.col("source").alias("path"), "title", F.char_length("title").alias("size")).distinct()
    names = table(spark, d, "blocks").where("title <> ''").select(F.col("title").alias("query"), F.col("title").alias("name")).distinct()
    return store.find_symbol(symbols, names)


@query("select leaf_id as id, 'leaf' as kind, domain, title from (select distinct leaf_id, domain, title from leaves) union all select id, 'node', domain, title from (select distinct trim(id) as id, domain, title from catalog_entries where kind = 'node')")
def catalog_union(spark, d):
    leaves = table(spark, d, "leaves").select(F.col("leaf_id").alias("id"), F.lit("leaf").alias("kind"), "domain", "title").distinct()
    nodes = table(spark, d, "catalog_entries").where("kind = 'node'").select(text.trimmed(F.col("id")).alias("id"), "kind", "domain", "title").distinct()
    return leaves.unionByName(nodes)


# ---------------------------------------------------------------- chunks
@query("select doc_id, len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end as lines from documents where text <> ''")
def line_counts(spark, d):
    return chunking.lines(docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("lines"))


_LINES_SQL = "l as (select doc_id, u as line, case when u < len(s) then s[u] || chr(10) else s[u] end as text from (select doc_id, string_split(text, chr(10)) as s, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u from documents where text <> '') where u < len(s) or s[u] <> '')"


@query(rf"""with {_LINES_SQL}, f as (select *, not regexp_matches(text, '[^\s\x0b]') as blank from l),
    g as (select *, lag(blank) over o as before, max(case when blank then 0 else 1 end) over (partition by doc_id order by line rows between current row and unbounded following) as later from f window o as (partition by doc_id order by line)),
    p as (select *, sum(case when before is null or (blank and not before and later = 1) then 1 else 0 end) over (partition by doc_id order by line) as part from g)
    select doc_id, cast(part as bigint) as part, md5(string_agg(text, '' order by line)) as text_md5, cast(min(line) as bigint) as start_line, cast(max(line) as bigint) as end_line from p group by doc_id, part""")
def paragraphs(spark, d):
    rows = chunking.paragraphs(docs(spark, d))
    return rows.select("doc_id", "part", F.md5("text").alias("text_md5"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def _parts_sql(starts: str, more: str = "") -> str:
    return f"""with {_LINES_SQL}, f as (select *, regexp_replace(text, '[\r\n]+$', '') as bare from l), g as (select *, sum(case when {starts} then 1 else 0 end) over (partition by doc_id order by line) as part{more} from f)"""


_ENTRY_RE, _CLINICAL_RE = (p.replace("(?iU)", "(?i)").replace("'", "''") for p in (chunking.ENTRY, chunking.CLINICAL))
_HEADING_RE = r"^\s*#{1,6}\s+\S|^\s*[A-ZÀ-Ü][^:\n]{2,58}:\s*$|(?i:^\s*(?:paso|step|fase|phase|etapa|stage)\s*\d+)"


@query(_parts_sql(f"regexp_matches(bare, '{_ENTRY_RE}') or regexp_matches(bare, '{_CLINICAL_RE}')") + " select doc_id, cast(part as bigint) as part, md5(string_agg(text, '' order by line)) as text_md5, cast(min(line) as bigint) as start_line, cast(max(line) as bigint) as end_line from g group by doc_id, part")
def temporal_entries(spark, d):
    rows = chunking.entries(docs(spark, d), clinical=True)
    return rows.select("doc_id", "part", F.md5("text").alias("text_md5"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query()
def dated_entries(spark, d):
    return chunking.entries(docs(spark, d).where("data_type in ('PERSONAL', 'CLINICAL')"), clinical=True)


@query(_parts_sql(f"regexp_matches(bare, '{_HEADING_RE}') and not regexp_matches(bare, '" + r"^\s*(?:[-*•]|\d{1,3}[.)])\s+\S" + "')", r", regexp_matches(bare, '^\s*#{1,2}\s') as top") + " select doc_id, cast(part as bigint) as part, md5(string_agg(text, '' order by line)) as text_md5, cast(min(line) as bigint) as start_line, cast(max(line) as bigint) as end_line, bool_or(top) as hard from g group by doc_id, part")
def sections(spark, d):
    rows = chunking.sections(docs(spark, d))
    return rows.select("doc_id", "part", F.md5("text").alias("text_md5"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "hard")


@query(r"""select doc_id, len(string_split(t, chr(1))) as sentences, md5(t) as cut_md5 from (select doc_id, regexp_replace(text, '([.!?…])([\s\x0b]+["''“¿¡(\[]?[A-ZÀ-Ü0-9])', '\1' || chr(1) || '\2', 'g') as t from documents where text <> '')""")
def sentences_exact(spark, d):
    rows = chunking.sentences(docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\x01").alias("t"))
    return rows.select("doc_id", "sentences", F.md5("t").alias("cut_md5"))


def _whole(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct(*order, "text")))["text"], "")).alias("text_md5"))


_CUTTERS = "paragraphs sections entries sentences long_paragraphs code_units symbols typed_blocks chunks".split()


@query("select doc_id, cutter, md5(text) as text_md5 from documents, (values " + ", ".join(f"('{c}')" for c in _CUTTERS) + ") v(cutter) where text <> '' and regexp_matches(text, '[^\\s]')")
def lossless_violations(spark, d):
    """What each way of cutting gives when its parts are put together again: the text."""
    base = docs(spark, d).where(F.col("text").rlike(r"\S"))
    typed = chunking.blocks_by_type(base, symbols=True)
    blocks = typed.select(F.xxhash64("doc_id", "ord").alias("block_id"), F.col("doc_id").cast("string").alias("source"), "ord", "text", "title", "start_line", "end_line", "kind", "tags", "timestamp", "hard_boundary", "context")
    blocks = written(blocks, "blocks")
    chunks = chunking.fused(blocks, chunking.pack_each(blocks)).select(F.col("source").cast("bigint").alias("doc_id"), "chunk", "text")
    made = {
        "paragraphs": (chunking.paragraphs(base), ["part"]), "sections": (chunking.sections(base), ["part"]), "entries": (chunking.entries(base), ["part"]), "sentences": (chunking.sentences(base), ["pos"]),
        "long_paragraphs": (chunking.split_long(chunking.paragraphs(base), 60, 100), ["part", "piece"]), "code_units": (chunking.code_units(base), ["unit"]), "symbols": (chunking.code_units(base, 60), ["unit"]),
        "typed_blocks": (typed, ["ord"]), "chunks": (chunks, ["chunk"]),
    }
    out = None
    for name, (rows, order) in made.items():
        one = _whole(rows, order).select("doc_id", F.lit(name).alias("cutter"), "text_md5")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def pack_greedy(spark, d):
    return chunking.pack(table(spark, d, "blocks"))


@query()
def code_units(spark, d):
    return chunking.code_units(docs(spark, d).where("data_type = 'CODE'"))


# ---------------------------------------------------------------- classification
def _lexicon_sql() -> str:
    rows = ", ".join(f"('{kind}', '{name}', '{term}')" for kind, lists in (("type", classify.TYPES), ("topic", classify.TOPICS)) for name, words in lists.items() for term in sorted(set(words.split())))
    return f"""with x(kind, name, term) as (values {rows}), w as (select doc_id, unnest(regexp_extract_all(lower(strip_accents(left(text, 20000))), '[\\p{{L}}\\p{{N}}_''-]+')) as term from documents)
        select doc_id, kind, name, count(*) as hits, count(distinct term) as distinct_hits from w join x using (term) group by doc_id, kind, name"""


@query(_lexicon_sql())
def detect_lexicon(spark, d):
    return classify.lexicon_hits(docs(spark, d), sample=20000)


_CODE_RE = [(p.replace("(?md)", "(?m)").replace("(?U)", "").replace("'", "''"), w) for p, w in classify.CODE_SIGNS]
_CODE_SQL = " + ".join(f"{w} * len(regexp_extract_all(text, '{p}'))" for p, w in _CODE_RE)
_STRONG, _WEAK = ("|".join(f"(?:{p})" for p, w in _CODE_RE if (w >= 2) is strong) for strong in (True, False))


@query(f"select doc_id, round(({_CODE_SQL}) * 100.0 / greatest(1, length(text) - length(replace(text, chr(10), ''))), 6) as code from documents")
def detect_scores(spark, d):
    return docs(spark, d).select("doc_id", F.round(classify.code_score(F.col("text")), 6).alias("code"))


@query(rf"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) as line from documents), c as (select doc_id, line from l where regexp_matches(line, '[^\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]')),
    s as (select doc_id, count(*) as n, count(*) filter (regexp_matches(line, '{_STRONG}') or regexp_matches(line, '{_WEAK}') and len(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) <= 8) as k from c group by doc_id)
    select doc_id, round(coalesce(cast(k as double) / n, 0), 6) as share from documents left join s using (doc_id)""")
def code_line_share(spark, d):
    return docs(spark, d).select("doc_id", F.round(classify.code_line_share(F.col("text")), 6).alias("share"))


_TOPIC_ORDER = "case name " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(classify.TOPICS)) + " end"


@query(f"select doc_id, topic, n from (select doc_id, name as topic, hits as n, row_number() over (partition by doc_id order by hits desc, {_TOPIC_ORDER}) as r from ({_lexicon_sql().replace('left(text, 20000)', 'text')}) where kind = 'topic') where r = 1 and n >= 3")
def detect_domain(spark, d):
    return classify.best_topics(docs(spark, d))


@query()
def detect_type(spark, d):
    return classify.detect(docs(spark, d))


@query("select doc_id, case regexp_extract(lower(source), '(\\.[a-z]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in classify.LANGUAGES.items()) + " end as language from documents")
def language_by_ext(spark, d):
    return docs(spark, d).select("doc_id", classify.language(F.col("source")).alias("language"))


# ---------------------------------------------------------------- capture
_TURNS_SQL = r"""c as (select session_id, message_id, t.ord as ord, case when t.role in ('user', 'assistant', 'system') then t.role else 'other' end as role, t.text as text from (
    select session_id, message_id, max(struct_pack(ord := ord, role := lower(trim(coalesce(role, ''))), text := coalesce(text, ''), timestamp := timestamp)) as t from turns where message_id is not null and session_id is not null group by session_id, message_id))"""


@query(f"""with {_TURNS_SQL}, s as (select *, case when role = 'assistant' and lag(role) over o = 'assistant' then null else ord end as st from c window o as (partition by session_id order by ord, message_id)),
    r as (select *, max(st) over (partition by session_id order by ord, message_id) as first_ord from s)
    select session_id, first_ord, max(role) as role, count(*) as records, cast(sum(length(text)) as bigint) as chars from r group by session_id, first_ord""")
def merge_turns(spark, d):
    return capture.merge_turns(table(spark, d, "turns"))


@query()
def fragments(spark, d):
    return capture.fragments(table(spark, d, "turns"))


@query("select distinct turn_id, md5(coalesce(role, '') || ': ' || coalesce(text, '') || coalesce(array_to_string(list_transform(actions, lambda a: chr(10) || '  · ' || a), ''), '')) as rendered from turns")
def turn_render(spark, d):
    rows = table(spark, d, "turns")
    return rows.select("turn_id", F.md5(notes.render_turn(F.coalesce("role", F.lit("")), F.col("text"), F.col("actions"))).alias("rendered")).distinct()


@query("select directory, max(time_created) as last_instant, arg_max(id, struct_pack(t := time_created, i := id)) as last_id, count(distinct id) as messages from sessions where directory is not null and id is not null and time_created is not null group by directory")
def session_high_water(spark, d):
    """How far the sessions of each directory have been read, by instant, then id."""
    return capture.high_water(table(spark, d, "sessions").withColumn("instant", F.col("time_created")), "directory")


@query("select session_id, count(*) as turns, count(text) as with_text from turns where session_id is not null group by session_id")
def stream_capture_counts(spark, d):
    return streamed_counts(spark, f"{d}/turns.parquet", ["session_id"], {"turns": F.count("*"), "with_text": F.count("text")})


@query("with o as (select distinct session_id, turn_id, ord, timestamp from turns where session_id is not null), x as (select *, max(case when timestamp is not null then ord end) over (partition by session_id order by ord, turn_id rows between unbounded preceding and current row) as k from o) select session_id, count(*) as turns, count(k) as dated, count(distinct k) as sources from x group by session_id")
def forward_filled_times(spark, d):
    once = table(spark, d, "turns").where("session_id is not null").select("session_id", "turn_id", "ord", "timestamp").distinct()
    marked = once.withColumn("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("ord")))
    return capture.filled_times(marked).groupBy("session_id").agg(F.count("*").alias("turns"), F.count("last_seen").alias("dated"), F.count_distinct("last_seen").alias("sources"))


@query("select distinct id, list_last(string_split(rtrim(directory, '/'), '/')) as project from sessions")
def project_of_session(spark, d):
    return table(spark, d, "sessions").select("id", notes.project_of(F.col("directory")).alias("project")).distinct()


@query()
def beam_search(spark, d):
    rows = entries(spark, d).where("layer = 0").select("id", "domain", "timestamp", "leaf_count", "title", "source", "status", F.concat_ws(" ", "title", "domain").alias("text"))
    found = search.build_search_index(rows, tree.build_tree(rows))
    return search.search(found, "shared dashboard backup")


@query()
def node_summaries(spark, d):
    """The tree over whole documents, each node with its title, summary, keywords and entities."""
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("general")).alias("domain"), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(1).alias("leaf_count"), notes.first_meaningful_line(F.col("text")).alias("title"), "text")
    words = terms.keywords(rows, ["id"], "text", 10).select("id", F.split("keywords", " ").alias("keywords"))
    named = terms.ordered_distinct(terms.entities(rows, ["id"], "text", 8), ["id"], "entity", ["rank"]).withColumnRenamed("items", "entities")
    none = F.array().cast("array<string>")
    leaves = rows.join(words, "id", "left").join(named, "id", "left").withColumns({"keywords": F.coalesce("keywords", none), "entities": F.coalesce("entities", none), "tags": none})
    return tree.build_tree(leaves, summarizer=summaries.summarize_nodes).select("id", "layer", "domain", "leaf_count", "title", "summary", F.array_join("keywords", " ").alias("keywords"), F.array_join("entities", " ").alias("entities"))
