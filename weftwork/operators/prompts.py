"""Prompts from templates, and the call of a language model behind a small protocol."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What a language model must offer: replies to prompts, in order."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class Echo:
    """A deterministic stand-in: replies with an insight whose summary is the prompt's last line."""

    def generate(self, prompts: list[str]) -> list[str]:
        import json

        return [json.dumps({"insights": [{"summary": p.rstrip("\n").rpartition("\n")[2], "significance": 0.5, "confidence": 0.5}]}) for p in prompts]


def render(template: str, fields: dict[str, Column]) -> Column:
    """The template with {name} in place of each field's text; null fields are empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def ask(df: DataFrame, prompt: str, provider: Provider, out: str = "reply", batch: int = 64) -> DataFrame:
    """``df`` with a provider's replies; equal prompts are asked once."""
    unique = df.select(F.col(prompt).alias("_p")).where("_p is not null").distinct()

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({"_p": part["_p"], out: provider.generate(part["_p"].tolist())})

    return df.join(unique.mapInPandas(call, f"_p string, `{out}` string"), F.col(prompt) == F.col("_p"), "left").drop("_p")


def refine(df: DataFrame, judge, improve, rounds: int = 2) -> DataFrame:
    """Rows judged, and those that do not pass improved and judged again, at most ``rounds`` times. judge adds accepted, improve changes rows."""
    from weftwork.session import durable

    done, open_rows = None, df.withColumn("round", F.lit(0))
    for k in range(rounds + 1):
        judged = durable(judge(open_rows), "refine")
        passed = judged if k == rounds else judged.where("accepted")
        done = passed if done is None else done.unionByName(passed)
        if k < rounds:
            open_rows = improve(judged.where("not accepted").drop("accepted")).withColumn("round", F.lit(k + 1))
    return done
