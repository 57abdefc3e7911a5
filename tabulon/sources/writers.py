"""Sinks: Parquet stores, CSV exports of results, one CSV a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.store import upsert

# Fixed column names of the exported results.
EXTREME = ["URL", "Key", "Response", "actual_result", "correct", "Rephrased correct", "With keys", "Prompt", "Rephrased Question", "Rephrased Response", "Context Response", "Context Correct"]
SINGLE = ["URL", "Key", "Column", "Real Value", "Response", "Correct", "Prompt", "Rephrased_question", "Rephased_response", "Context Response", "Context Correct"]
COMPARISON = ["URL", "Key", "Column", "Response", "Actual Result", "Correct", "Rephrased Correct", "Prompt", "Rephrased Question", "Rephrased Response", "Context Response", "Context Correct"]
RAW_METRICS = ["article", "url", "dates", "rows", "columns", "cells", "numeric_ratio", "popularity", "f1_score"]


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A result as CSV with a header; arrays and maps as JSON."""
    df = df.select(*columns) if columns else df
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def table_csvs(cells: DataFrame, path: str) -> None:
    """One folder of CSV lines a table: header first. Rows are built from cells, so tables may differ in shape."""
    quoted = lambda c: F.coalesce(F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", c.alias("t")))), lambda s: s["t"]), ",")
    body = cells.groupBy("table_id", "row_idx").agg(line(quoted(F.col("raw"))).alias("line"))
    head = cells.select("table_id", "col_idx", "col_name").distinct().groupBy("table_id").agg(line(quoted(F.col("col_name"))).alias("line")).select("table_id", F.lit(-1).alias("row_idx"), "line")
    lines = head.unionByName(body).repartition("table_id").sortWithinPartitions("table_id", "row_idx")
    lines.select("table_id", "line").write.mode("overwrite").partitionBy("table_id").text(path)


def save_records(new: DataFrame, old_path: str | None, path: str, keys: list[str]) -> None:
    """Upsert into a store that is kept as Parquet: the merged rows go to a new path, as files are never changed in place."""
    spark = new.sparkSession
    merged = upsert(spark.read.parquet(old_path), new, keys) if old_path else new
    merged.write.mode("errorifexists").parquet(path)


def as_record(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
