"""Archives as rows of members, with limits against hostile ones; nested archives are opened too."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.sources import detect

MEMBER = "path string, member string, size long, content binary, error string"


@dataclass(frozen=True)
class Limits:
    total_bytes: int = 500 * 1024 * 1024
    ratio: int = 100
    files: int = 10_000
    depth: int = 3


def safe_name(name: str) -> str | None:
    """The name inside the archive, or null if it would lead out of it."""
    plain = posixpath.normpath(name.replace("\\", "/"))
    return None if plain.startswith(("/", "..")) or (len(plain) > 1 and plain[1] == ":") or "\0" in plain else plain


def members(path: str, content: bytes, limits: Limits, depth: int = 0, prefix: str = "") -> Iterator[tuple]:
    """(path, member, size, content, error); a breach of a limit is a row with an error and ends this archive."""
    if depth > limits.depth:
        yield path, prefix, len(content), None, "nested too deep"
        return
    try:
        if zipfile.is_zipfile(io.BytesIO(content)):
            archive = zipfile.ZipFile(io.BytesIO(content))
            entries = [(i.filename, i.file_size, lambda i=i: archive.read(i)) for i in archive.infolist() if not i.is_dir()]
            packed = sum(i.compress_size for i in archive.infolist())
        else:
            archive = tarfile.open(fileobj=io.BytesIO(content))
            entries = [(i.name, i.size, lambda i=i: archive.extractfile(i).read()) for i in archive.getmembers() if i.isfile()]
            packed = len(content)
    except (zipfile.BadZipFile, tarfile.TarError, OSError) as e:
        yield path, prefix, len(content), None, f"not readable: {e}"
        return
    total = sum(size for _, size, _ in entries)
    if len(entries) > limits.files or total > limits.total_bytes or (packed and total / packed > limits.ratio):
        yield path, prefix, total, None, "too many files" if len(entries) > limits.files else "too large" if total > limits.total_bytes else "suspicious compression ratio"
        return
    for name, size, read in entries:
        plain = safe_name(name)
        if plain is None:
            yield path, prefix + name, size, None, "leads out of the archive"
            continue
        data = read()
        if plain.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz")):
            yield from members(path, data, limits, depth + 1, f"{prefix}{plain}!")
        else:
            yield path, prefix + plain, size, data, None


def read_archives(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row a member of zip and tar files (path, content); media members come without content."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in members(path, bytes(content), limits):
                    name = row[1].lower()
                    media = any(name.endswith(m) for m in detect.MEDIA)
                    yield pd.DataFrame([(*row[:3], None if media else row[3], row[4])], columns=["path", "member", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(parse, MEMBER)


def member_texts(rows: DataFrame) -> DataFrame:
    """(path, member, format, text) of the members that are plain text."""
    kind = detect.format_of(F.col("member"))
    return rows.where(kind.isin("text", "markdown", "json", "csv", "calendar", "contacts", "messages") & F.col("content").isNotNull()).select("path", "member", kind.alias("format"), F.decode("content", "UTF-8").alias("text"))


def platforms(rows: DataFrame) -> DataFrame:
    """(path, platform, members) of each archive."""
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("member")).alias("names"), F.count("*").alias("members")).select("path", detect.platform(F.col("names")).alias("platform"), "members")


def services(rows: DataFrame) -> DataFrame:
    """(path, service, files): files by the first folder under Takeout/."""
    inside = rows.where(F.col("member").startswith("Takeout/"))
    return inside.groupBy("path", F.split("member", "/")[1].alias("service")).agg(F.count("*").alias("files"))
