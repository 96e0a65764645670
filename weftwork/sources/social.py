"""HTML exports of a social network: conversations, followers, comments."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW = "path string, kind string, ordinal int, sender string, text string, stamp string"


class _Blocks(HTMLParser):
    """The texts of leaf blocks, message by message: an export page is a list of boxes of sender, text and time."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.boxes, self.open_at, self.now = 0, [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.depth += 1
            classes = dict(attrs).get("class") or ""
            if self.open_at is None and ("uiBoxWhite" in classes or "message" in classes.split()):
                self.open_at, self.now = self.depth, []

    def handle_endtag(self, tag):
        if tag == "div":
            if self.open_at == self.depth:
                self.boxes.append(self.now)
                self.open_at = None
            self.depth -= 1

    def handle_data(self, data):
        if self.open_at is not None and data.strip():
            self.now.append(data.strip())


def kind_of(path: str) -> str:
    low = path.lower()
    return "message" if "/messages/" in low or "message_" in low else "follower" if "follow" in low else "comment" if "comment" in low else "reaction" if "like" in low or "reaction" in low else "profile"


def read_pages(files: DataFrame) -> DataFrame:
    """A row a box of HTML pages (path, content): sender first, time last, text between."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                parser = _Blocks()
                parser.feed(bytes(content).decode("utf-8", "replace"))
                rows = [(path, kind_of(path), k, b[0], "\n".join(b[1:-1]) if len(b) > 2 else None, b[-1] if len(b) > 1 else None) for k, b in enumerate(parser.boxes) if b]
                yield pd.DataFrame(rows, columns=["path", "kind", "ordinal", "sender", "text", "stamp"])

    out = files.select("path", "content").mapInPandas(parse, ROW)
    return out.withColumn("deleted_account", F.col("sender").rlike(r"(?i)^(instagram user|deleted account|user_?\d{8,})$"))


def summary(rows: DataFrame) -> DataFrame:
    """(kind, files, rows, people)."""
    return rows.groupBy("kind").agg(F.count_distinct("path").alias("files"), F.count("*").alias("rows"), F.count_distinct("sender").alias("people"))


def latest_messages(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` messages of each conversation; how many to show is the feature."""
    order = Window.partitionBy("path").orderBy(F.desc("ordinal"))
    return rows.where("kind = 'message'").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
