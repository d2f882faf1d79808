"""The timeline of dated facts: current values, values as of a date, contradictions and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize, short_hash, trimmed, truncate
from tessera.operators.hierarchy import hierarchy
from tessera.operators.timestamps import parse_distinct, utc_text
from tessera.session import written

#: Fixed values: (attribute, pattern); the value is the first group. For English and Spanish notes.
_VALUE = r"([^.,;:\n!?]{2,80})"
RULES = (
    ("location", rf"(?iU)\b(?:vivo|resido|estoy viviendo)\s+en\s+{_VALUE}"),
    ("location", rf"(?iU)\bme\s+(?:he\s+)?mudad[oa]\s+a\s+{_VALUE}"),
    ("location", rf"(?iU)\bI\s+(?:now\s+)?live\s+in\s+{_VALUE}"),
    ("location", rf"(?iU)\bI\s+moved\s+to\s+{_VALUE}"),
    ("employer", rf"(?iU)\btrabajo\s+en\s+{_VALUE}"),
    ("employer", rf"(?iU)\bI\s+work\s+(?:at|for)\s+{_VALUE}"),
    ("stack", rf"(?iU)\b(?:mi|nuestro)\s+stack\s+(?:es|ser[aá])\s+{_VALUE}"),
    ("stack", rf"(?iU)\b(?:our|my)\s+stack\s+is\s+{_VALUE}"),
    ("stack", rf"(?iU)\bmigra(?:mos|do)\s+(?:el\s+backend\s+)?a\s+{_VALUE}"),
    ("stack", rf"(?iU)\bwe\s+migrated\s+to\s+{_VALUE}"),
    ("diagnosis", rf"(?iUmd)^\s*(?:diagn[oó]stico|diagnosis)\s*:\s*{_VALUE}"),
    ("treatment", rf"(?iUmd)^\s*(?:tratamiento|treatment)\s*:\s*{_VALUE}"),
    ("medication", rf"(?iUmd)^\s*(?:medicaci[oó]n|medication)\s*:\s*{_VALUE}"),
)
PATIENT = r"(?iUmd)^\s*(?:paciente|patient)\s*:\s*([^\n,;(]{2,60})"
CLINICAL = ("diagnosis", "treatment", "medication")


def key_of() -> Column:
    """The key of a row's subject and attribute: white space trimmed, accents and capitals gone."""
    return F.concat_ws("::", normalize(trimmed(F.col("subject"))), normalize(trimmed(F.col("attribute"))))


def keyed(facts: DataFrame) -> DataFrame:
    """Each fact id once, with its key, instant (null sorts first) and normal value; null keys and values do not count."""
    key = key_of()
    rows = facts.where("fact_id is not null and subject is not null and attribute is not null and value is not null")
    parsed = parse_distinct(rows.select("fact_id", "timestamp", "value", "subject", "attribute", "source_leaf_id", F.lit(None).cast("string").alias("_none")), "timestamp", "_none")
    # The aggregate also keeps filters on the instant from repeating the parser.
    dated = parsed.groupBy("fact_id").agg(F.max(F.struct("timestamp", "value", "subject", "attribute", "source_leaf_id", "epoch")).alias("f")).select("fact_id", "f.*")
    return dated.withColumns({"key": key, "norm_value": normalize(trimmed(F.col("value")))})


def in_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `_slot`: the place of a row's range partition in (key, order...). A key with a large share of all rows gets many
    slots, cut by their number of rows and not by time; undated rows are cut like others."""
    return written(rows.repartitionByRange("key", *order).withColumn("_slot", F.spark_partition_id()), "slots")


def next_in_key(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `next_<field>` of the following row of the key, in order of (epoch, fact_id); nulls first.

    A lead runs within a slot only; the slots of a key are linked by their first rows."""
    rows = in_slots(rows, ["epoch", "fact_id"])
    by = Window.partitionBy("key", "_slot").orderBy(F.asc_nulls_first("epoch"), "fact_id")
    first = rows.groupBy("key", "_slot").agg(F.min(F.struct("epoch", "fact_id", *[f for f in fields if f not in ("epoch", "fact_id")])).alias("_first"))
    linked = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("key").orderBy("_slot"))).drop("_first")
    inner = rows.withColumn("_last", F.lead("fact_id").over(by).isNull()).withColumns({f"_n_{f}": F.lead(f).over(by) for f in fields})
    joined = inner.join(linked, ["key", "_slot"])
    return joined.withColumns({f"next_{f}": F.when(F.col("_last"), F.col(f"_after.{f}")).otherwise(F.col(f"_n_{f}")) for f in fields}).drop("_slot", "_after", "_last", *[f"_n_{f}" for f in fields])


def timeline(facts: DataFrame) -> DataFrame:
    """Every fact with its status, successor and end of validity; all but the newest of a key are historical."""
    rows = next_in_key(keyed(facts), ["fact_id", "epoch"])
    current = F.col("next_fact_id").isNull()
    return rows.select("fact_id", "key", "value", utc_text(F.col("epoch")).alias("valid_from"), utc_text(F.col("next_epoch")).alias("valid_to"), F.col("next_fact_id").alias("superseded_by"), F.when(current, "ACTIVE").otherwise("HISTORICAL").alias("status"))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max(F.struct("epoch", "fact_id", "value", "norm_value")).alias("n")).select("key", "n.*")


def active(facts: DataFrame) -> DataFrame:
    return _newest(keyed(facts)).select("key", "fact_id", "value", utc_text(F.col("epoch")).alias("since"))


def state_at(facts: DataFrame, when: int) -> DataFrame:
    """The value of each key as of an instant, both inclusive; ties by the larger fact id."""
    return _newest(keyed(facts).where(F.col("epoch") <= when)).select("key", "fact_id", "value")


def as_of_join(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, moment, fact_id, value) for probe rows (key, moment): the fact valid at that instant, inclusive; none, no row.

    Facts and probes are merged in order of (key, instant), facts first, in slots; each probe takes the last fact before
    it in its slot or, where it has none, the last of the slots before: no pair of fact and probe is made."""
    none = F.lit(None).cast("string")
    dated = keyed(facts).where("epoch is not null").select("key", "epoch", F.lit(0).alias("probe"), "fact_id", "value")
    asked = probes.where("key is not null and moment is not null").select("key", F.col("moment").alias("epoch"), F.lit(1).alias("probe"), none.alias("fact_id"), none.alias("value"))
    rows = in_slots(dated.unionByName(asked), ["epoch", "probe", "fact_id"])
    fact = F.when(F.col("probe") == 0, F.struct("fact_id", "value"))
    inner = F.last(fact, ignorenulls=True).over(Window.partitionBy("key", "_slot").orderBy("epoch", "probe", "fact_id").rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.where("probe = 0").groupBy("key", "_slot").agg(F.max(F.struct("epoch", "fact_id", "value")).alias("_top"))
    slots = rows.select("key", "_slot").distinct().join(tops, ["key", "_slot"], "left")
    carried = slots.select("key", "_slot", F.last("_top", ignorenulls=True).over(Window.partitionBy("key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    found = rows.withColumn("_in", inner).where("probe = 1").join(carried, ["key", "_slot"], "left")
    found = found.select("key", F.col("epoch").alias("moment"), F.coalesce("_in.fact_id", "_carry.fact_id").alias("fact_id"), F.when(F.col("_in").isNotNull(), F.col("_in.value")).otherwise(F.col("_carry.value")).alias("value"))
    return found.where("fact_id is not null")


def conflicts(facts: DataFrame) -> DataFrame:
    """Newest value of each key against the latest different one before it; confirmations are no conflict."""
    rows = keyed(facts)
    new = _newest(rows).select("key", F.col("fact_id").alias("new_id"), F.col("value").alias("new_value"), F.col("norm_value").alias("_new"))
    differs = rows.join(new, "key").where("norm_value <> _new").groupBy("key", "new_id", "new_value").agg(F.max(F.struct("epoch", "fact_id", "value")).alias("o"))
    return differs.select("key", "new_id", "new_value", F.col("o.fact_id").alias("old_id"), F.col("o.value").alias("old_value"))


def notices(facts: DataFrame) -> DataFrame:
    """For each source leaf: what a later fact says instead of one it holds. Leaves without a source give none."""
    rows = keyed(facts)
    new = _newest(rows).select("key", F.col("value").alias("now"), F.col("norm_value").alias("_new"), F.col("epoch").alias("_at"))
    outdated = rows.where("source_leaf_id is not null").join(new, "key").where("norm_value <> _new")
    since = F.coalesce(F.left(utc_text(F.col("_at")), F.lit(10)), F.lit("?"))
    text = F.concat(F.lit("outdated: "), F.col("key"), F.lit(" was "), F.col("value"), F.lit(", now "), F.col("now"), F.lit(" since "), since)
    return outdated.select("source_leaf_id", text.alias("notice")).distinct()


def _as(attribute: str):
    return lambda value: F.struct(F.lit(attribute).alias("attribute"), trimmed(value).alias("value"))


def extract(leaves: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(leaf_id, subject, attribute, value, fact_id) found in leaf texts by rules; clinical ones are about the patient."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _as(a)) for a, p in rules]))
    patient = F.coalesce(F.nullif(trimmed(F.regexp_extract("content", PATIENT, 1)), F.lit("")), F.lit("patient"))
    rows = leaves.select("leaf_id", "timestamp", patient.alias("_patient"), F.explode(found).alias("f")).where("f.value <> ''")
    subject = F.when(F.col("f.attribute").isin(*CLINICAL), F.col("_patient")).otherwise("user")
    rows = rows.select("leaf_id", subject.alias("subject"), "f.attribute", truncate(F.col("f.value"), 120).alias("value"), "timestamp")
    key = F.concat_ws("|", F.concat_ws("::", normalize(F.col("subject")), normalize(F.col("attribute"))), normalize(F.col("value")), F.coalesce("timestamp", F.lit("")))
    return rows.withColumn("fact_id", F.concat(F.lit("F-"), short_hash(key, 10))).drop("timestamp").distinct()


def successors(supersessions: DataFrame) -> DataFrame:
    """(id, current, hops): the end of each chain of replacements (old, new), however long.

    Of several replacements of one id the largest counts. Ids on a loop of replacements, or leading to one, have the
    smallest id of the loop as current and -1 hops."""
    edges = supersessions.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.max("new").alias("new"))
    ends = edges.select(F.col("new").alias("id")).distinct().join(edges.select(F.col("old").alias("id")), "id", "left_anti")
    links = edges.select(F.col("old").alias("id"), F.col("new").alias("parent")).unionByName(ends.select("id", F.lit(None).cast("string").alias("parent")))
    chains = hierarchy(links)
    return chains.where("depth <> 0").select("id", F.col("root_id").alias("current"), F.col("depth").alias("hops"))


def supersede(supersessions: DataFrame, old: str, new: str) -> DataFrame:
    """The replacements (old, new) with one more; a leaf cannot replace itself; saying it twice changes nothing."""
    if old == new:
        raise ValueError("a leaf cannot supersede itself")
    one = supersessions.sparkSession.createDataFrame([(old, new)], "old string, new string")
    return supersessions.select("old", "new").unionByName(one).distinct()


def explicit_notices(supersessions: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf_id, notice) for each leaf that another one (leaf_id, title, timestamp) replaces by an explicit replacement."""
    new = leaves.select(F.col("leaf_id").alias("new"), F.coalesce("title", F.lit("untitled")).alias("_title"), F.coalesce(F.left("timestamp", F.lit(10)), F.lit("?")).alias("_day")).distinct()
    text = F.concat(F.lit("outdated: corrected by "), F.col("new"), F.lit(" ("), F.col("_title"), F.lit(") on "), F.col("_day"))
    return supersessions.join(new, "new").select(F.col("old").alias("leaf_id"), text.alias("notice")).distinct()


def notices_for_leaves(facts: DataFrame, supersessions: DataFrame, leaves: DataFrame, stamped: DataFrame) -> DataFrame:
    """(leaf_id, pos, notice): of each leaf the notices that its facts give now, then the explicit ones, then those stamped
    on it (leaf_id, notice) earlier, each once."""
    live = notices(facts).select(F.col("source_leaf_id").alias("leaf_id"), F.lit(0).alias("kind"), "notice")
    rows = live.unionByName(explicit_notices(supersessions, leaves).select("leaf_id", F.lit(1).alias("kind"), "notice")).unionByName(stamped.select("leaf_id", F.lit(2).alias("kind"), "notice"))
    first = rows.groupBy("leaf_id", "notice").agg(F.min("kind").alias("kind"))
    return first.select("leaf_id", F.row_number().over(Window.partitionBy("leaf_id").orderBy("kind", "notice")).alias("pos"), "notice")


def timelines(facts: DataFrame) -> DataFrame:
    """(key, values): the history of each key as one array of (valid_from, fact_id, value), in order."""
    rows = keyed(facts)
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("epoch", F.lit(-(1 << 62))).alias("epoch"), "fact_id", "value"))).alias("v")).select("key", F.transform("v", lambda x: F.struct(utc_text(x["epoch"]).alias("valid_from"), x["fact_id"].alias("fact_id"), x["value"].alias("value"))).alias("values"))


def report(facts: DataFrame) -> DataFrame:
    """(key, value, since, old_value): each key's current value and the different one before it, if any, in order of the keys."""
    old = conflicts(facts).select("key", "old_value")
    return active(facts).join(old, "key", "left").select("key", "value", "since", "old_value").orderBy("key")


def new_conflicts(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Conflicts (key, new_value, ...) that were not there before, by key and new value."""
    return now.join(seen.select("key", "new_value").distinct(), ["key", "new_value"], "left_anti")
