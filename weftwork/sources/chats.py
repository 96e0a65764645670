"""Chat and message exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHATSAPP = r"(?m)^\[?(\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?)\]?\s*-?\s*([^:\n]+):\s*(.+)$"
GENERIC = r"(?m)^\[?(\d{4}-\d{2}-\d{2}\s*\d{2}:\d{2}(?::\d{2})?)\]?\s*([^:\n]+):\s*(.+)$"
#: Day first is tried before month first.
STAMPS = ["d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d/M/yy H:mm", "d/M/yy H:mm:ss", "d/M/yyyy h:mm a", "d/M/yy h:mm a", "M/d/yyyy H:mm", "M/d/yy H:mm", "M/d/yyyy h:mm a", "M/d/yy h:mm a"]


def format_of(content: Column) -> Column:
    """sms_xml, json, whatsapp, generic or null, of a message file's text."""
    return (
        F.when(content.rlike(r"<smses\b|SMS Backup & Restore"), "sms_xml")
        .when(F.trim(content).rlike(r"^[\[{]") & F.try_parse_json(content).isNotNull(), "json")
        .when(content.rlike(WHATSAPP), "whatsapp").when(content.rlike(GENERIC), "generic")
        .when(content.contains("Messages and calls are end-to-end encrypted") | content.contains("Media omitted") | content.contains("<attached:"), "whatsapp")
    )


def _lines(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """(path, ordinal, stamp, sender, text): lines that open a message; lines after it belong to it."""
    rows = files.select("path", F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("line_no")
    opens = F.col("line").rlike(pattern)
    numbered = rows.withColumn("ordinal", F.sum(opens.cast("int")).over(order)).where("ordinal > 0")
    joined = numbered.groupBy("path", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("m"))
    one = pattern.replace("(.+)$", r"((?s:.*))\z")
    return joined.select("path", "ordinal", F.trim(F.regexp_extract("m", one, 1)).alias("stamp"), F.trim(F.regexp_extract("m", one, 2)).alias("sender"), F.trim(F.regexp_extract("m", one, 3)).alias("text"))


def parse_whatsapp(files: DataFrame, text: str = "text") -> DataFrame:
    """Messages of files (path, text) with their time; messages of several lines are kept whole."""
    rows = _lines(files, text, WHATSAPP)
    clean = F.upper(F.regexp_replace(F.regexp_replace("stamp", ",", " "), r"[\s  ]+", " "))
    at = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in STAMPS])
    return rows.withColumn("at", at)


def parse_generic(files: DataFrame, text: str = "text") -> DataFrame:
    rows = _lines(files, text, GENERIC)
    return rows.withColumn("at", F.coalesce(*[F.try_to_timestamp("stamp", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")]))


def parse_json(files: DataFrame, text: str = "text") -> DataFrame:
    """Messages of JSON files: a list, or an object with messages or data; the usual names of the fields are tried in order."""
    item = "sender string, `from` string, author string, text string, message string, content string, body string, timestamp string, date string, time string"
    listed, inside = F.from_json(text, f"array<struct<{item.replace(' string', ': string')}>>"), F.from_json(text, f"messages array<struct<{item.replace(' string', ': string')}>>, data array<struct<{item.replace(' string', ': string')}>>")
    is_list = F.trim(text).startswith("[")
    rows = files.select("path", F.posexplode(F.when(is_list, listed).otherwise(F.coalesce(inside["messages"], inside["data"]))).alias("ordinal", "i"))
    first = lambda names: F.coalesce(*[F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names])
    return rows.select("path", "ordinal", first(["timestamp", "date", "time"]).alias("stamp"), F.coalesce(first(["sender", "from", "author"]), F.lit("")).alias("sender"), first(["text", "message", "content", "body"]).alias("text")).where("text is not null")


def read_sms(spark: SparkSession, path: str) -> DataFrame:
    """(at, sender, text) of an SMS backup: type 2 was sent, empty bodies are left out, in order of time."""
    rows = spark.read.format("xml").option("rowTag", "sms").schema("_address string, _contact_name string, _date string, _type string, _body string").load(path)
    at = F.timestamp_millis(F.col("_date").try_cast("long"))
    sender = F.when(F.col("_type") == "2", "Me").otherwise(F.coalesce(F.nullif(F.nullif("_contact_name", F.lit("(Unknown)")), F.lit("null")), "_address"))
    return rows.where("_body is not null and trim(_body) not in ('', 'null')").select(at.alias("at"), sender.alias("sender"), F.col("_body").alias("text"))


CONVERSATION = (
    "title string, create_time double, mapping map<string, struct<message: struct<author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>, text: string>, metadata: struct<model_slug: string>>>>"
)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conversation, title, ordinal, role, text, at, model) of an assistant export: the messages of each tree in order of time, without system ones."""
    rows = spark.read.schema(CONVERSATION).option("multiLine", True).json(path)
    rows = rows.withColumn("conversation", F.substring(F.sha2(F.concat_ws("|", "title", F.col("create_time").cast("string")), 256), 1, 12))
    nodes = rows.select("conversation", "title", F.explode(F.map_values("mapping")).alias("n")).select("conversation", "title", "n.message.*").where("author.role is not null and author.role <> 'system'")
    text = F.when(F.col("content.content_type").isin("code", "execution_output"), F.col("content.text")).otherwise(F.array_join(F.filter("content.parts", lambda p: p.isNotNull()), "\n"))
    from pyspark.sql import Window

    order = Window.partitionBy("conversation").orderBy("create_time", "text")
    out = nodes.select("conversation", "title", F.col("author.role").alias("role"), F.coalesce(text, F.lit("")).alias("text"), "create_time", F.col("metadata.model_slug").alias("model")).where("trim(text) <> ''")
    return out.select("conversation", "title", F.row_number().over(order).alias("ordinal"), "role", "text", F.timestamp_seconds("create_time").alias("at"), "model")


def as_documents(messages: DataFrame, key: list[str], role: str, text: str, order: str, user_roles: tuple[str, ...] = ("user", "human")) -> DataFrame:
    """One text a conversation: its messages in order, in tags that say who wrote them."""
    tag = F.when(F.lower(role).isin(*user_roles), "USER_MESSAGE").otherwise("ASSISTANT_MESSAGE")
    block = F.concat(F.lit("<"), tag, F.lit(">\n"), F.coalesce(text, F.lit("")), F.lit("\n</"), tag, F.lit(">"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))), lambda x: x["b"])
    return messages.groupBy(*key).agg(F.array_join(blocks, "\n\n").alias("text"), F.count("*").alias("messages"))
