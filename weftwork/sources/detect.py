"""What a file is: by extension, by content, and which platform an archive was exported from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# extension -> format
FORMATS = {
    ".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".text": "text", ".json": "json", ".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel",
    ".zip": "archive", ".tar": "archive", ".tar.gz": "archive", ".tgz": "archive", ".ics": "calendar", ".ical": "calendar", ".vcf": "contacts", ".eml": "eml", ".msg": "msg", ".mbox": "mbox", ".xml": "messages",
}
# extension -> what to do instead
UNSUPPORTED = {
    ".doc": "save as .docx or PDF", ".pptx": "export as PDF", ".rtf": "save as plain text", ".html": "save as plain text", ".htm": "save as plain text", ".epub": "convert to plain text", ".odt": "export as text",
    ".pages": "export as PDF", ".7z": "unpack first", ".rar": "unpack first",
}
MEDIA = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".ico", ".mp3", ".wav", ".ogg", ".m4a", ".flac", ".aac", ".mp4", ".avi", ".mov", ".mkv", ".webm", ".wmv"]
# leading bytes -> what they say; zip also holds office files
MAGIC = {"25504446": "pdf", "504B0304": "zip", "1F8B": "gzip", "D0CF11E0": "ole", "FFD8FF": "media", "89504E47": "media"}


def files(spark, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of files; content is read only where a plan uses it. Spark's reader leaves out files without a byte."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extension(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    """The format, ``media``, or null if unsupported."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    ext = extension(path)
    return F.when(ext.isin(MEDIA), "media").otherwise(table[ext])


def suggestion(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in UNSUPPORTED.items() for x in pair])
    return table[extension(path)]


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for prefix, name in MAGIC.items():
        out = F.when(head.startswith(prefix), name).otherwise(out)
    return out


def validated(files: DataFrame, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """``files`` with format, problem (null if there is none) and hash; a format that its first bytes contradict is a problem."""
    kind, head = format_of(F.col("path")), magic(F.col("content"))
    expected = F.create_map(*[F.lit(x) for x in ("pdf", "pdf", "docx", "zip", "excel", "zip")])
    problem = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(kind.isNull(), F.coalesce(F.concat(F.lit("unsupported: "), suggestion(F.col("path"))), F.lit("unsupported")))
        .when(kind == "media", "media").when(expected[kind].isNotNull() & (F.coalesce(head, F.lit("")) != expected[kind]) & ~F.col("path").endswith(".xls"), "content does not match extension")
        .when((kind == "json") & F.try_parse_json(F.decode("content", "UTF-8")).isNull(), "not JSON")
    )
    return files.select("path", "length", kind.alias("format"), problem.alias("problem"), F.sha2("content", 256).alias("hash"))


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose content hash is not in ``seen`` (hash), the first by path of each content."""
    fresh = files.join(seen.select("hash"), "hash", "left_anti")
    return fresh.join(fresh.groupBy("hash").agg(F.min("path").alias("path")), ["hash", "path"], "left_semi")


def platform(members: Column) -> Column:
    """Which platform an archive with these member names was exported from; the first signature that holds."""
    any_of = lambda test: F.exists(members, test)
    low = lambda m: F.lower(m)
    rules = [
        ("facebook", any_of(lambda m: m.contains("messages/inbox/") | m.contains("posts/your_posts_1.json") | m.contains("your_facebook_activity"))),
        ("instagram", any_of(lambda m: low(m).contains("instagram_") | m.contains("media/posts/") | m.endswith("content/posts_1.json"))),
        ("twitter", any_of(lambda m: m.endswith("tweet.js") | m.endswith("tweets.js"))), ("google_takeout", any_of(lambda m: m.startswith("Takeout/"))),
        ("notion", any_of(lambda m: m.rlike(r"[a-f0-9]{32}\.(md|csv)$"))), ("chatgpt", any_of(lambda m: m == "conversations.json")), ("linkedin", any_of(lambda m: low(m).contains("connections.csv"))),
        ("whatsapp", any_of(lambda m: m.contains("_chat.txt") | low(m).contains("whatsapp chat"))), ("spotify", any_of(lambda m: low(m).contains("streaminghistory") | low(m).contains("endsong"))),
        ("apple_health", any_of(lambda m: m.contains("apple_health_export"))),
    ]
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out
