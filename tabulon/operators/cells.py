"""Tables of any shape in long form: one row a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import number, typed

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def cell(df: DataFrame, column: str) -> Column:
    """The typed value of a column of any type: numbers as they are, all else by its text."""
    kind = df.schema[column].dataType.simpleString()
    if kind.split("(")[0] in NUMERIC:
        return number(F.col(column), "int" if kind in NUMERIC[:4] else "float")
    return typed(F.col(column).cast("string"))


def unpivot(df: DataFrame, table: str | Column, row: str | Column, columns: list[str]) -> DataFrame:
    """table_id, row_idx, col_idx, col_name, v (struct<kind, num, txt>): a cell a row, in one pass without a shuffle."""
    each = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"), cell(df, c).alias("v")) for i, c in enumerate(columns)))
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(col(table).alias("table_id"), col(row).alias("row_idx"), F.explode(each).alias("c")).select("table_id", "row_idx", "c.*")


def pivot(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Back to one row a table row, values as text or number; the columns are named, so no pass is spent on finding them."""
    text = F.coalesce(F.col("v.txt"), F.col("v.num").cast("string"))
    return cells.groupBy("table_id", "row_idx").agg(*(F.max(F.when(F.col("col_name") == c, text)).alias(c) for c in columns))


def shapes(cells: DataFrame) -> DataFrame:
    """table_id, n_rows, n_cols, cells: from the cells, by one aggregation."""
    by_row = cells.groupBy("table_id", "row_idx").agg(F.max("col_idx").alias("last"))
    return by_row.groupBy("table_id").agg(F.count("*").alias("n_rows"), (F.max("last") + 1).cast("bigint").alias("n_cols")).withColumn("cells", F.col("n_rows") * F.col("n_cols"))
