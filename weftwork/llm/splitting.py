"""Splitting oversized items at natural boundaries, content-defined.

Rolling-hash landmarks are snapped to the nearest natural boundary (the best
class there is in reach: paragraph, sentence, line, word) between a least and
a greatest size. The landmark of a piece depends on the text near it, so an
edit alters the pieces around it only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import gear

_SPACE = re.compile(r"\s+")
_RUN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…。！？]['\")\]»”’]*$")

PIECE = (
    "piece_index int, content string, start_char long, end_char long, body_start long, preceding_context string, cut string"
)


@dataclass(frozen=True)
class Limits:
    """max_chars: of a piece with its overlap. min_chars: of new text, where a boundary allows. width: of the landmark windows."""

    max_chars: int = 2000
    min_chars: int = 600
    overlap: int = 200
    context: int = 200
    width: int = 256


def _boundaries(text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of words, starts of what follows, and classes: 0 paragraph, 1 sentence, 2 line, 3 word."""
    ends, nexts, classes = [], [], []
    for m in _SPACE.finditer(text, lo, hi):
        gap = m.group()
        ends.append(m.start())
        nexts.append(m.end())
        if gap.count("\n") >= 2:
            classes.append(0)
        elif _SENTENCE_END.search(text[max(lo, m.start() - 6) : m.start()]):
            classes.append(1)
        else:
            classes.append(2 if "\n" in gap or "\r" in gap else 3)
    return np.array(ends, dtype=np.int64), np.array(nexts, dtype=np.int64), np.array(classes, dtype=np.int8)


def split_text(text: str, limits: Limits = Limits()) -> list[dict]:
    """The pieces of one text; none if it has at most max_chars without white space at both ends."""
    body = text.strip()
    if len(body) <= limits.max_chars:
        return []
    lo = text.index(body[0])
    hi = lo + len(body)
    ends, nexts, classes = _boundaries(text, lo, hi)
    hashes = gear.rolling(gear.gear(gear.code_points(text)))
    marks = gear.landmarks(hashes, limits.width)
    room = limits.max_chars - limits.overlap  # for new text, beside a whole overlap
    pieces: list[dict] = []
    start, prior_start = lo, lo
    while start < hi:
        k = len(pieces)
        reach = start + (limits.max_chars if k == 0 else room)
        if hi <= reach:
            cut, resume, kind = hi, hi, "end"
        else:
            least = start + limits.min_chars
            near = marks[np.searchsorted(marks, least) : np.searchsorted(marks, reach, "right")]
            aim = int(near[np.argmin(hashes[near])]) + 1 if len(near) else reach
            a, b = np.searchsorted(ends, least), np.searchsorted(ends, reach, "right")
            if a < b:
                best = classes[a:b].min()
                among = np.flatnonzero(classes[a:b] == best) + a
            else:  # none in reach: the last one before, else the first one beyond, at the cost of overlap
                a0, b0 = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + limits.max_chars, "right")
                among = np.array([a - 1]) if a > a0 else np.array([a0]) if a0 < b0 else np.zeros(0, dtype=np.int64)
            if len(among):
                at = int(among[np.argmin(np.abs(ends[among] - aim))])
                cut, resume = int(ends[at]), int(nexts[at])
                kind = ("paragraph", "sentence", "line", "word")[classes[at]]
            elif hi - start <= limits.max_chars:
                cut, resume, kind = hi, hi, "end"
            else:
                # more than max_chars without white space: cut at the landmark, as there is no boundary
                cut = resume = aim
                kind = "forced"
        begin = start if k == 0 else max(prior_start, start - limits.overlap, cut - limits.max_chars)
        if k and begin < start:  # let the overlap begin with a word
            m = _SPACE.search(text, begin, start)
            if begin > lo and not text[begin - 1].isspace() and m and m.end() < start:
                begin = m.end()
        end = min(resume, begin + limits.max_chars)  # the gap stays with the piece before it, if there is room
        pieces.append(
            {
                "piece_index": k, "content": text[begin:end], "start_char": begin, "end_char": end, "body_start": start,
                "preceding_context": text[max(0, begin - limits.context) : begin], "cut": kind,
            }
        )
        prior_start, start = start, resume
    return pieces


def split_oversized(items: DataFrame, content: str = "content", limits: Limits = Limits()) -> DataFrame:
    """One row a piece of each oversized item, with the item's other columns.

    An item is oversized if its content, without white space at both ends, is
    longer than ``max_chars`` code points; other items, null and blank content
    give no rows. A piece is at most ``max_chars`` long. Its columns:
    piece_index, content, start_char and end_char (relative to the item's
    content as stored), body_start (where its new text begins; from start_char
    to there it repeats the end of its predecessor, up to ``overlap``),
    preceding_context (up to ``context`` characters before start_char) and cut,
    why it ends there: paragraph, sentence, line, word, end, or forced (no
    white space in ``max_chars``). Bodies lie gapless side by side, but for
    white space that no piece has room for. Whole rows that are repeated are
    split once. Columns of the item with a clashing name give way to the
    piece's. Items are split one by one: a very long one costs time and memory
    in proportion to itself, and none is cut short.
    """
    made = [c.split()[0] for c in PIECE.split(", ")]
    keep = [c for c in items.columns if c not in made or c == content]
    others = [c for c in keep if c != content]
    long = items.where(F.length(content) > limits.max_chars).select(*keep).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64].reset_index(drop=True)
                rows = [(i, p) for i, text in enumerate(part["__text"]) for p in split_text(text, limits)]
                out = part.iloc[[i for i, _ in rows]].drop(columns="__text").reset_index(drop=True)
                for c in made:
                    out[c] = [p[c] for _, p in rows]
                yield out

    import pyspark.sql.types as T

    renamed = long.select(*others, F.col(content).alias("__text"))
    schema = T.StructType([f for f in renamed.schema if f.name != "__text"] + list(T._parse_datatype_string(PIECE)))
    return renamed.mapInPandas(cut, schema)
