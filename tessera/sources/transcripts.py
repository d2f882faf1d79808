"""Transcripts of coding sessions: two JSON-lines dialects and a SQLite database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.notes import clean_user_text, describe_action, redact_secrets
from tessera.functions.text import trimmed

#: A cheap test of the raw line, before any JSON is parsed.
WANTED = r'"type":\s?"(?:user|assistant|ai-title|session_meta|user_message|agent_message|function_call|custom_tool_call|local_shell_call)"'
_PART = "struct<type:string,text:string,name:string,input:map<string,string>>"
_A = "type string, timestamp string, sessionId string, cwd string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, message struct<role:string,content:string>"
_B = "type string, timestamp string, payload struct<type:string,message:string,name:string,arguments:string,id:string,cwd:string>"


def parse_dialect_a(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path..., session_id, timestamp, role, text, actions) of records user and assistant.

    Side chains, injected and summary records are dropped; content is a string or a list of parts; a line that is no
    whole JSON object, such as an unfinished last one, gives no row."""
    keep = [c for c in lines.columns if c != value]
    rows = lines.where(F.col(value).rlike(WANTED)).select(*keep, F.from_json(value, _A).alias("r"))
    flag = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(False))
    rows = rows.where(F.col("r.type").isin("user", "assistant") & ~flag("isSidechain") & ~flag("isMeta") & ~flag("isCompactSummary"))
    content = F.col("r.message.content")
    parts = F.from_json(F.when(F.ltrim(content).startswith("["), content), f"array<{_PART}>")
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    said = F.when(parts.isNull(), content).otherwise(texts)
    calls = F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{_PART}>")), lambda p: p["type"] == "tool_use"), lambda p: describe_action(p["name"], p["input"]))
    cleaned = redact_secrets(F.when(F.col("r.type") == "user", clean_user_text(said)).otherwise(trimmed(said)))
    actions = F.transform(F.filter(calls, lambda a: a.isNotNull()), redact_secrets)
    turns = rows.select(*keep, F.col("r.sessionId").alias("session_id"), F.col("r.timestamp").alias("timestamp"), F.col("r.type").alias("role"), F.coalesce(cleaned, F.lit("")).alias("text"), actions.alias("actions"))
    return turns.where((F.col("text") != "") | (F.size("actions") > 0))


def parse_dialect_b(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same of the other dialect: messages from events, actions from calls in response items."""
    keep = [c for c in lines.columns if c != value]
    rows = lines.where(F.col(value).rlike(WANTED)).select(*keep, F.from_json(value, _B).alias("r"))
    kind = F.col("r.payload.type")
    message = (F.col("r.type") == "event_msg") & kind.isin("user_message", "agent_message")
    call = (F.col("r.type") == "response_item") & kind.isin("function_call", "custom_tool_call", "local_shell_call")
    given = F.from_json("r.payload.arguments", "map<string,string>")
    action = describe_action(F.col("r.payload.name"), F.coalesce(given, F.create_map().cast("map<string,string>")))
    role = F.when(message & (kind == "user_message"), "user").otherwise("assistant")
    text = F.when(message, redact_secrets(F.when(kind == "user_message", clean_user_text(F.col("r.payload.message"))).otherwise(trimmed(F.col("r.payload.message")))))
    turns = rows.where(message | call).select(*keep, F.lit(None).cast("string").alias("session_id"), F.col("r.timestamp").alias("timestamp"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.when(call & action.isNotNull(), F.array(redact_secrets(action))).otherwise(F.array().cast("array<string>")).alias("actions"))
    return turns.where((F.col("text") != "") | (F.size("actions") > 0))


def read_transcripts(spark: SparkSession, globs: list[str], dialect: str = "a") -> DataFrame:
    lines = spark.read.text(globs).select(F.col("_metadata.file_path").alias("path"), "value")
    return {"a": parse_dialect_a, "b": parse_dialect_b}[dialect](lines)


class SqliteSource(DataSource):
    """format("tessera_sqlite"), options path, query and schema: the rows of a query, read by ranges of rowid of `table`."""

    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.table, self.columns = options["path"], options["table"], options["columns"]
        self.step = int(options.get("rows", "100000"))

    def partitions(self) -> list[InputPartition]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [_Range(a, min(high, a + self.step - 1)) for a in range(low, high + 1, self.step)] if low is not None else []

    def read(self, partition):
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select {self.columns} from "{self.table}" where rowid between ? and ?', (partition.low, partition.high))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of a SQLite file that all executors can read; `schema` in DDL names the columns to take."""
    spark.dataSource.register(SqliteSource)
    columns = ", ".join('"' + c.split()[0] + '"' for c in schema.split(","))
    return spark.read.format("tessera_sqlite").options(path=path, table=table, columns=columns, schema=schema).load()


def database_turns(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns of a session database: sessions without a parent, finished messages, their text parts in order."""
    info = "role string, time struct<completed:bigint>, finish string"
    own = sessions.where("parent_id is null").select(F.col("id").alias("session_id"), "title", "directory")
    said = messages.select("id", "session_id", "time_created", F.from_json("data", info).alias("m")).where("m.role = 'user' or m.finish is not null or m.time.completed is not null")
    body = parts.select("message_id", "time_created", "id", F.from_json("data", "type string, text string, synthetic boolean").alias("p")).where("p.type = 'text' and not coalesce(p.synthetic, false)")
    text = body.groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("time_created", "id", F.col("p.text").alias("text"))))["text"], "\n").alias("text"))
    return said.join(own, "session_id").join(text, said["id"] == text["message_id"]).select("session_id", "message_id", F.col("m.role").alias("role"), "time_created", redact_secrets(F.col("text")).alias("text"))


def discovered(roots: list[str], patterns: list[str]) -> list[str]:
    return [f"{r.rstrip('/')}/{p}" for r in roots for p in patterns]


