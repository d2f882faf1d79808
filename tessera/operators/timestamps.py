"""Timestamps in many formats, precisions and zones, brought to one UTC form.

Distinct (source, raw string, zone) entries form a dictionary that is parsed once, may be kept on disk and extended by
later batches, and is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.calendar import MONTHS
from tessera.functions.text import trimmed
from tessera.session import written

#: Zone letters and their offsets in minutes.
LETTERS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120,
    "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300,
    "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

#: Code points beyond which no known form goes; a longer string names no time.
LONGEST = 100
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"((?:[+-]\d{2}:?(?:\d{2})?)?\[[A-Za-z_/+-]+\d*\]|[+-]\d{2}:?(?:\d{2})?|[A-Za-z]+(?:/[A-Za-z_+-]+\d*)*)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
#: Each pattern with the order of its groups: year, month, day, hour, minute, second, half of the day, zone.
_FORMATS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]\s*{_CLOCK})?\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,]\d+)?)?\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,?[Tt ]\s*{_CLOCK})?\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,?[Tt ]\s*{_CLOCK}{_HALF})?\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})\.?\s+(?:de\s+)?(\p{{L}}+)\.?,?\s+(?:del?\s+)?(\d{{4}}|\d{{2}})(?:,?\s+(?:a\s+las\s+|at\s+)?{_CLOCK}{_HALF})?\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:\p{{L}}+,\s+)?(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_HALF})?\s*{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
)
#: The commonest form, which the engine's own parser reads: ISO with seconds and an offset.
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-5][0-9](?:\.[0-9]{1,9})?(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])$"
_ALONE = r"^[0-9]+$"
_HAS_ZONE = r"(?i)^[0-9]+$|[+-]\d{2}:?\d{2}(?:\[[^\]]+\])?$|[+-]\d{2}$|\]$|\d\s*Z$|[\dm.]\s+(?:[a-z]+/[a-z_/+-]+\d*)$|[\dm.]\s*(?:%s)$" % "|".join(LETTERS)


def zone_ids(spark: SparkSession) -> list[str]:
    """All region names that the JVM knows, some hundreds, fetched in one call."""
    return sorted(spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))


def names_zone(raw: Column) -> Column:
    """Whether a raw timestamp carries its own zone or is an epoch, so that the row's zone cannot matter."""
    return trimmed(raw).rlike(_HAS_ZONE) & ~trimmed(raw).rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4}$")


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parse_distinct(pairs: DataFrame, raw: str = "raw", zone: str = "zone") -> DataFrame:
    """Adds `epoch` (bigint seconds, null if unreadable) to rows of raw strings and fallback zones.

    Digits alone are an epoch in s, ms, us or ns by their length; slashed dates are day first; two-digit years are
    20yy; a bare date is midnight; fractions are dropped. A fallback zone that is null or unknown is UTC. A clock
    time that occurs twice is the earlier instant; a skipped one is read with the offset before the change.
    """
    zones = ", ".join(f"'{z}'" for z in zone_ids(pairs.sparkSession))
    known_zone = lambda c: F.expr(f"{c} in ({zones})")  # noqa: E731  # parsed in one call, looked up in a hash set
    known = set(pairs.columns)
    pairs = pairs.withColumn("_text", trimmed(F.col(raw)))
    text = F.col("_text")
    plain = F.when(text.rlike(_PLAIN), F.unix_seconds(text.try_cast("timestamp")))
    digits = F.when(text.rlike(_ALONE), text)
    size = F.length(digits)
    unit = F.when(size <= 11, 1).when(size <= 14, 1_000).when(size <= 17, 1_000_000).otherwise(1_000_000_000)
    epoch = F.coalesce(plain, F.floor(digits.try_cast("decimal(38,0)") / unit).try_cast("bigint"))
    df = pairs.withColumn("_epoch", epoch)
    form = F.when(F.col("_epoch").isNull() & (F.length(text) <= LONGEST), text)
    for pattern, order in _FORMATS:
        form = F.regexp_replace(form, pattern, order)
    df = df.withColumn("_p", F.split(form, r"\|"))
    df = df.withColumn("_p", F.when(F.size("_p") == 8, F.col("_p")))
    part = lambda i: F.col("_p")[i]
    month_words = _map({w: str(i + 1) for i, words in enumerate(MONTHS) for w in words.split()})
    zoned = part(7)
    inner = F.nullif(F.regexp_extract(zoned, r"\[([^\]]+)\]", 1), F.lit(""))
    sign = F.nullif(F.regexp_extract(zoned, r"^([+-])\d{2}", 1), F.lit(""))
    letters = F.try_element_at(_map(LETTERS), F.lower(F.coalesce(inner, zoned)))
    named = F.coalesce(inner, F.nullif(zoned, F.lit("")))
    df = df.withColumns(
        {
            "_y": F.when(F.length(part(0)) == 2, _int(part(0)) + 2000).otherwise(_int(part(0))),
            "_mo": F.coalesce(_int(part(1)), _int(F.try_element_at(month_words, F.lower(part(1))))),
            "_d": _int(part(2)),
            "_h": F.coalesce(_int(part(3)), F.lit(0)),
            "_mi": F.coalesce(_int(part(4)), F.lit(0)),
            "_s": F.coalesce(_int(part(5)), F.lit(0)),
            "_half": F.lower(part(6)),
            "_offset": F.when(
                sign.isNotNull(),
                F.when(sign == "-", -1).otherwise(1)
                * (F.coalesce(_int(F.regexp_extract(zoned, r"^[+-](\d{2})", 1)), F.lit(0)) * 60 + F.coalesce(_int(F.regexp_extract(zoned, r"^[+-]\d{2}:?(\d{2})", 1)), F.lit(0))),
            ).otherwise(letters),
            "_named": named,
        }
    )
    hour = (
        F.when(F.col("_half") == "", F.col("_h"))
        .when((F.col("_h") < 1) | (F.col("_h") > 12), None)
        .when(F.col("_half") == "p", F.pmod(F.col("_h"), F.lit(12)) + 12)
        .otherwise(F.pmod(F.col("_h"), F.lit(12)))
    )
    clock = F.try_make_timestamp_ntz(F.col("_y"), F.col("_mo"), F.col("_d"), hour, F.col("_mi"), F.col("_s").cast("decimal(16,6)"))
    df = df.withColumn("_local", F.unix_date(clock.cast("date")).cast("bigint") * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock))
    df = df.withColumn("_given", trimmed(F.col(zone)))
    region = F.when(known_zone("_named"), F.col("_named")).when(F.col("_named").isNull() & known_zone("_given"), F.col("_given")).when(F.col("_named").isNull(), "UTC")
    local = F.col("_local")
    at_region = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), region))
    df = df.withColumn("epoch", F.coalesce("_epoch", F.when(F.col("_offset").isNotNull(), local - F.col("_offset") * 60).otherwise(at_region)))
    return df.select(*known, "epoch") if raw in known else df


def utc_text(epoch: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of epoch seconds, whatever the session's zone; null outside the years 1 to 9999."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    second = F.pmod(epoch, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    text = F.concat(day.cast("string"), F.lit("T"), two(second / 3600), F.lit(":"), two(F.pmod(second, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(second, F.lit(60))), F.lit("Z"))
    return F.when(epoch.between(-62135596800, 253402300799), text)


def update_dictionary(pairs: DataFrame, path: str | None = None) -> DataFrame:
    """Parses the distinct (source, raw, zone) entries that the dictionary at `path` lacks, appends them and returns it all.

    `source` tells where a string comes from and may be left out. Without a path the dictionary lives in the session's
    shared folder for this call. Null and blank raw strings are no entries; unreadable ones are, with a null epoch, so
    that no later batch parses them again. An entry that a repeated or concurrent append has stored twice comes out once.
    """
    spark, keys = pairs.sparkSession, ["source", "raw", "zone"]
    source = F.coalesce("source", F.lit("")) if "source" in pairs.columns else F.lit("")
    distinct = pairs.select(source.alias("source"), "raw", F.coalesce("zone", F.lit("")).alias("zone")).where(F.col("raw").isNotNull() & (trimmed(F.col("raw")) != "")).distinct()
    if path is None:
        return written(parse_distinct(distinct), "instants")
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        distinct = distinct.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    parse_distinct(distinct).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy(*keys).agg(F.max("epoch").alias("epoch"))


#: Join keys that rows without a readable string are spread over, as all of them are alike.
_SPREAD = 1024


def normalize_instants(rows: DataFrame, raw: str, zone: str | None = None, out: str = "epoch", path: str | None = None, source: str | None = None) -> DataFrame:
    """`rows` with `out`: epoch seconds of column `raw` read in the fallback zone of column `zone`, or null.

    Every row stays, repeated ones too; other columns are untouched whatever their names. An empty table gives an
    empty table. The zone is part of the dictionary's key only for strings that name none themselves; the column
    `source`, if given, always is.
    """
    fallback = F.coalesce(trimmed(F.col(zone)), F.lit("")) if zone else F.lit("")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    origin = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    keyed = rows.select(whole.alias("_row"), F.col(raw).alias("raw"), F.when(F.col(raw).isNull() | names_zone(F.col(raw)), "").otherwise(fallback).alias("zone"), origin.alias("source"))
    entries = update_dictionary(keyed.select("source", "raw", "zone"), path).where(F.col("epoch").isNotNull())
    void = F.col("raw").isNull() | (F.trim("raw") == "")
    spread = keyed.withColumn("zone", F.when(void, F.concat(F.lit("\0"), F.pmod(F.xxhash64("_row"), F.lit(_SPREAD)).cast("string"))).otherwise(F.col("zone"))).withColumn("raw", F.coalesce("raw", F.lit("")))
    joined = spread.join(entries, ["source", "raw", "zone"], "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in rows.columns if c != out], F.col("epoch").alias(out))


def with_session_zone(rows: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Adds `_zone`, the zone of the row's session; of repeated sessions the largest non-null zone holds.

    One session may own a large share of the rows: sessions are unique on the right, so a hot key is split by AQE's
    skew join (or the side is broadcast if its size allows).
    """
    zones = sessions.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_sid")).agg(F.max("tz").alias("_zone"))
    return rows.join(zones, F.col(key) == F.col("_sid"), "left").drop("_sid")
