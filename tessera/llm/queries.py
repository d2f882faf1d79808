"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.conversations import conversations, dropped_sessions
from tessera.llm.leakage import leaked_items
from tessera.llm.packing import byte_pair_counter, pack
from tessera.llm.pii import find_pii, redact_pii
from tessera.llm.spans import shared_characters, shared_spans
from tessera.llm.split import refreshed_chunks, split_oversized
from tessera.session import table

#: Where this machine has the vocabulary; a cluster passes its own path, as an environment variable.
VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "blocks")).select("block_id", "boundary").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "blocks"))


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refreshed_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "blocks")).select("chunk_id", "oversized")


def _private(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "turns").select(F.lit("turn").alias("kind"), F.col("turn_id").cast("string").alias("rec_key"), "text")
    return turns.unionByName(table(spark, sf_dir, "leaves").select(F.lit("leaf").alias("kind"), F.col("leaf_id").alias("rec_key"), F.col("content").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_private(spark, sf_dir), table(spark, sf_dir, "known_names"))
    return found.select("kind", "rec_key", "pii_type", "found").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders; a real deployment takes the key from its own secret store."""
    return redact_pii(_private(spark, sf_dir), table(spark, sf_dir, "known_names"), b"tessera-demonstration-key")


def _talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "messages"), table(spark, sf_dir, "turns"), table(spark, sf_dir, "sessions")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_sessions(*_talk(spark, sf_dir))


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(*_talk(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_pair_counter(VOCABULARY))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where("distance = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_characters(table(spark, sf_dir, "documents")).select("doc_id", F.col("shared_chars").cast("bigint").alias("shared_chars"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_chunks, p5_found, p5_redacted, p6_found, p6_conversations, p7_containers, p8_found, p8_near, p9_found, p9_spans)}
ORACLE = {
    "p8_found": """
        with w as (select doc_id, item_id, list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') as words from (select doc_id, null as item_id, text from documents union all select null, item_id, text from eval_items)),
        s as (select doc_id, item_id, unnest(list_transform(range(1, greatest(0, len(words) - 11) + 1), lambda i: array_to_string(words[i:i + 11], ' '))) as shingle from w)
        select distinct d.doc_id, i.item_id from s d join s i on i.shingle = d.shingle and i.item_id is not null and d.doc_id is not null
    """,
    "p1_chunks": """
        with sizes as (select block_id, max(source) as source, max(ord) as ord, max(length(text)) as n from blocks group by block_id),
        spans as (select c.chunk_id, f.source, f.ord as a, l.ord as b from chunks c join sizes f on f.block_id = c.first_block_id join sizes l on l.block_id = c.last_block_id)
        select s.chunk_id, sum(z.n) > 3603 as oversized from spans s join sizes z on z.source = s.source and z.ord between s.a and s.b group by s.chunk_id
    """,
}
