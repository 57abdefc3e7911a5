"""Keyed record stores and the response cache, as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: an aggregate, so that each task first reduces its own rows."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *(F.col("_r")[c].alias(c) for c in rest)).select(records.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``, which replace rows of the same key.

    Of rows of ``new`` that share a key the last stays, by ``order`` or, without one, as the rows come.
    """
    last = keep_last(new, keys, order) if order else keep_last(new.withColumn("_at", F.monotonically_increasing_id()), keys, ["_at"]).drop("_at")
    return old.join(last, keys, "left_anti").unionByName(last)


def delete(records: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return records.join(gone, keys, "left_anti")


def existing(records: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    return records.join(files, keys, "left_semi")


def misses(prompts: DataFrame, responses: DataFrame, key: str = "prompt_key", response: str = "response") -> DataFrame:
    """Prompts without an answer; an empty answer is none."""
    return prompts.join(responses.where(F.coalesce(F.length(response), F.lit(0)) > 0), key, "left_anti")


def respond(prompts: DataFrame, model: Callable[[str], str | None], prompt: str = "prompt", key: str = "prompt_key") -> DataFrame:
    """prompt_key, response of a model that is called from the executors, a batch at a time; a failure is a null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[prompt]:
                try:
                    out.append(model(text))
                except Exception:  # noqa: BLE001  a model may fail in any way; the prompt stays a miss
                    out.append(None)
            yield pd.DataFrame({"prompt_key": batch[key], "response": out})

    return prompts.select(key, prompt).mapInPandas(run, "prompt_key string, response string")


def answered(prompts: DataFrame, responses: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """The cache with the answers to all prompts that it lacked."""
    new = respond(misses(prompts, responses), model).where("response is not null")
    return upsert(responses.select("prompt_key", "response"), new, ["prompt_key"])


def provider(model: str) -> str | None:
    """Who serves a model, by its name; None for one that nobody is known to."""
    return next((who for word, who in (("gemini", "gemini"), ("gpt", "openai")) if word in model), None)


def routed(model: str, callables: dict[str, Callable[[str], str | None]]) -> Callable[[str], str | None]:
    """The callable of a model's provider; a model without one answers nothing."""
    return callables.get(provider(model) or "", lambda prompt: None)


def offline(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The default responder: prompts are answered from a table of responses, and from nowhere else."""
    known = responses.where(F.coalesce(F.length("response"), F.lit(0)) > 0).select("prompt_key", "response")
    return lambda prompts: prompts.select("prompt_key").join(known, "prompt_key").select("prompt_key", "response")


def overlay(base: str, over: str):
    """The union of two maps; the second wins."""
    b, o = F.col(base), F.col(over)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(o, k)), o)
