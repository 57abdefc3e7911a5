"""Binned summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
#: Fixed bins: label, lower and upper bound, whether the lower bound is left out. Some overlap, some leave gaps, on purpose.
BINS: dict[str, list[tuple[str, float, float, bool]]] = {
    "cells": [("20-100", 20, 100, False), ("101-250", 101, 250, False), ("251-500", 251, 500, False), ("501-1000", 501, 1000, False), ("1001+", 1001, INF, False)],
    "numeric_ratio": [("0.0", 0, 0, False), ("(0.0,0.67]", 0, 0.67, True), ("(0.67,1.0]", 0.67, 1.0, True), ("1.0", 1.0, 1.0, False)],
    "popularity": [("0-100", 0, 100, False), ("101-1000", 101, 1000, False), ("1001-10000", 1001, 10000, False), ("10001+", 10001, INF, False)],
    "rows": [("0-10", 0, 10, False), ("11-50", 11, 50, False), ("51-100", 51, 100, False), ("101-500", 101, 500, False), ("501+", 501, INF, False)],
    "columns": [("0-3", 0, 3, False), ("4-6", 4, 6, False), ("7-10", 7, 10, False), ("11-15", 11, 15, False), ("16+", 16, INF, False)],
}


def in_bin(x: Column, low: float, high: float, open_low: bool) -> Column:
    lower = x > low if open_low else x >= low
    return lower if high == INF else lower & (x <= high)


def binned(df: DataFrame, measure: str, value: str, score: str, digits: int = 4) -> DataFrame:
    """label, n, mean, std (of the population) of ``score`` in each bin of ``measure``; empty bins have zeros.

    A row may be in two bins. All bins are conditional aggregates of one pass, so no row is copied and the
    result is one row, which is then unfolded.
    """
    aggs = []
    for i, (_, low, high, open_low) in enumerate(BINS[measure]):
        hit = F.when(in_bin(F.col(value), low, high, open_low), F.col(score))
        aggs += [F.count(hit).alias(f"n{i}"), F.coalesce(F.avg(hit), F.lit(0.0)).alias(f"m{i}"), F.coalesce(F.stddev_pop(hit), F.lit(0.0)).alias(f"s{i}")]
    rows = [F.struct(F.lit(b[0]).alias("label"), F.col(f"n{i}").alias("n"), F.round(f"m{i}", digits).alias("mean"), F.round(f"s{i}", digits).alias("std")) for i, b in enumerate(BINS[measure])]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def error_bars(scores: DataFrame, by: str, score: str, digits: int = 4) -> DataFrame:
    """by, mean, upper and lower error: the lower one doesn't go below zero."""
    out = scores.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("upper"))
    return out.select(by, F.round("mean", digits).alias("mean"), F.round("upper", digits).alias("upper"), F.round(F.least("mean", "upper"), digits).alias("lower"))


def histogram(df: DataFrame, value: str, limit: float, bins: int = 10) -> DataFrame:
    """bin (from 0), n: equal bins between the least and largest value after clipping; empty bins are left out."""
    clipped = df.where(F.col(value).isNotNull()).select(F.least(F.col(value), F.lit(limit).cast("double")).alias("x"))
    span = clipped.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return clipped.join(F.broadcast(span)).select(place.cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # span is one row


def first_bin(df: DataFrame, measure: str, value: str) -> DataFrame:
    """The rows of a measure's first bin."""
    _, low, high, open_low = BINS[measure][0]
    return df.where(in_bin(F.col(value), low, high, open_low))


def summary(scores: DataFrame, table: str) -> str:
    """The row of means as text, a metric a line, as it is printed at the end of a run."""
    row = scores.where(F.col(table) == "All").first()
    return "\n".join(f"{name}: {value}" for name, value in row.asDict().items()) if row else ""
