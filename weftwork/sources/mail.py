"""Mail files, by the standard library's parser: single messages and boxes."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import text as T

MESSAGE = "path string, ordinal int, text string, html string, author string, recipients array<string>, subject string, date string, message_id string, in_reply_to string, attachments array<string>"


def message_row(path: str, ordinal: int, m) -> tuple:
    plain, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename() or part.get_content_disposition() == "attachment":
            files.append(part.get_filename() or "unnamed")
            continue
        payload = part.get_payload(decode=True) or b""
        body = payload.decode(part.get_content_charset() or "utf-8", "replace") if isinstance(payload, bytes) else str(payload)
        (html if part.get_content_type() == "text/html" else plain).append(body)
    people = [a for h in ("to", "cc") for _, a in email.utils.getaddresses(m.get_all(h, []))]
    head = lambda h: None if m.get(h) is None else str(m.get(h))
    return path, ordinal, "\n".join(plain) or None, "\n".join(html) or None, head("from"), people, head("subject"), head("date"), head("message-id"), head("in-reply-to"), files


#: A line that opens a message of a box: at its start or after an empty line.
_OPENS = re.compile(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n")
_SHIELDED = re.compile(rb"(?m)^>(>*From )")


def messages_in(path: str, content: bytes) -> Iterator[tuple]:
    """The messages of a file; a box is cut at its "From " lines, in memory, and lines that its writer shielded get their form back."""
    parts = [content]
    if path.lower().endswith(".mbox"):
        starts = [m.span() for m in _OPENS.finditer(content)]
        ends = [a for a, _ in starts[1:]] + [len(content)]
        parts = (_SHIELDED.sub(rb"\1", content[b:z]) for (_, b), z in zip(starts, ends))
    for k, part in enumerate(parts):
        yield message_row(path, k, email.message_from_bytes(part, policy=email.policy.default))


def read_mail(files: DataFrame) -> DataFrame:
    """A row a message of .eml and .mbox files (path, content). text is the plain body, else the HTML one without markup."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MESSAGE.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in messages_in(path, bytes(content)):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    out = files.select("path", "content").mapInPandas(parse, MESSAGE)
    return out.withColumn("text", F.coalesce("text", T.strip_html(F.col("html")))).drop("html")


def box_summary(messages: DataFrame) -> DataFrame:
    """(path, messages, attachments, senders, recipients) of each box."""
    people = messages.select("path", F.explode("recipients").alias("r")).groupBy("path").agg(F.count_distinct("r").alias("recipients"))
    counts = messages.groupBy("path").agg(F.count("*").alias("messages"), F.sum(F.size("attachments")).alias("attachments"), F.count_distinct("author").alias("senders"))
    return counts.join(people, "path", "left").withColumn("recipients", F.coalesce("recipients", F.lit(0)))
