"""Models behind an interface: called in batches where the rows are, every call on record; the default needs no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    name: str

    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class RuleProvider:
    """Answers by a function of the prompt: the offline default."""

    name = "rules"

    def __init__(self, answer: Callable[[str], str] = lambda prompt: ""):
        self.answer = answer

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


def completed(df: DataFrame, key: str, prompt: str, provider: Provider, stage: str, batch: int = 20, attempts: int = 3) -> DataFrame:
    """``key``, answer, and per call stage, provider, attempts, input_tokens, output_tokens and error.

    Prompts go in batches of ``batch``; those left unanswered are asked again, ``attempts`` times in all.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                keys, prompts = part[key].tolist(), [p or "" for p in part[prompt].tolist()]
                answers: list[str | None] = [None] * len(prompts)
                tries, error = [0] * len(prompts), [None] * len(prompts)
                for _ in range(attempts):
                    open_ = [i for i, a in enumerate(answers) if a is None]
                    if not open_:
                        break
                    try:
                        got = provider.complete([prompts[i] for i in open_])
                    except Exception as e:  # noqa: BLE001 - a failed call is tried again and then reported
                        got = [None] * len(open_)
                        for i in open_:
                            error[i] = str(e)[:300]
                    for i, a in zip(open_, got):
                        tries[i] += 1
                        answers[i] = a
                tokens = lambda t: -(-len(t or "") // 4)
                yield pd.DataFrame({key: keys, "answer": answers, "stage": stage, "provider": provider.name, "attempts": tries, "input_tokens": [tokens(p) * t for p, t in zip(prompts, tries)], "output_tokens": [tokens(a) for a in answers], "error": [e if a is None else None for e, a in zip(error, answers)]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, answer string, stage string, provider string, attempts int, input_tokens bigint, output_tokens bigint, error string")


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def costs(calls: DataFrame, prices: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Per stage the cost of calls (stage, provider, model, input_tokens, output_tokens) by prices a million tokens.

    Names are compared in lower case; ``aliases`` (model, known_as) lead to priced models. Calls are rounded to 8 digits
    before they are summed. A call without a price is an error, told in missing.
    """
    rows = calls.withColumns({"provider": F.lower(F.trim("provider")), "model": F.lower(F.trim("model"))})
    if aliases is not None:
        rows = rows.join(aliases.select(F.lower("model").alias("model"), F.lower("known_as").alias("known_as")), "model", "left").withColumn("model", F.coalesce("known_as", "model")).drop("known_as")
    priced = rows.join(prices.withColumns({"provider": F.lower("provider"), "model": F.lower("model"), "priced": F.lit(True)}), ["provider", "model"], "left")
    cost = F.round((F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1e6, 8)
    return priced.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"), F.count_if(F.col("priced").isNull()).alias("missing"))
