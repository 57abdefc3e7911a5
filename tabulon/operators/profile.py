"""Column profiles, uniqueness, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(cells: DataFrame) -> DataFrame:
    """table_id, col_name, max_value, min_value, n_distinct over the values of the column's commonest kind (number or text).

    Cells are first reduced to different values by a hash aggregation. Beside the least and largest text two distinct
    counts would send every cell thrice through a sort, whose memory grows with a task's cells.
    """
    values = cells.where("v is not null").groupBy("table_id", "col_name", F.col("v.num").alias("num"), F.col("v.txt").alias("txt")).agg(F.count("*").alias("n"))
    by = values.groupBy("table_id", "col_name").agg(
        F.sum(F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.sum(F.when(F.col("num").isNull(), F.col("n")).otherwise(0)).alias("texts"),
        F.max("num").alias("max_n"), F.min("num").alias("min_n"), F.count("num").alias("d_n"),
        F.max("txt").alias("max_t"), F.min("txt").alias("min_t"), F.count("txt").alias("d_t"),
    )
    as_number = F.col("numbers") >= F.col("texts")
    digits = lambda n: F.coalesce(F.round(n, 4).try_cast("decimal(30,4)").cast("string"), F.col(n).cast("string"))  # noqa: E731  a number too large has its own digits
    text = lambda n, t: F.when(as_number, digits(n)).otherwise(F.col(t))
    return by.select("table_id", "col_name", text("max_n", "max_t").alias("max_value"), text("min_n", "min_t").alias("min_value"), F.when(as_number, F.col("d_n")).otherwise(F.col("d_t")).alias("n_distinct"))


def uniqueness(cells: DataFrame) -> DataFrame:
    """table_id, col_name, label: unique if no value (null included) repeats."""
    value = F.struct("v.num", "v.txt")
    by = cells.groupBy("table_id", "col_name").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("v").isNotNull(), value)).alias("d"), F.count_if(F.col("v").isNull()).alias("nulls"))
    return by.select("table_id", "col_name", F.when(F.col("n") == F.col("d") + F.least("nulls", F.lit(1)), "unique").otherwise("not-unique").alias("label"))


def seeded(df: DataFrame, by: list[str], order: Column, n: int | Column) -> DataFrame:
    """The first n rows of each group in a repeatable order, with their place."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return ranked.where(F.col("place") <= n)


def sample_size(rows: Column) -> Column:
    """Rows that a profile shows of a table: a third of them, five at most."""
    return F.least(F.floor(rows / 3), F.lit(5))


def profile_line(column: Column, largest: Column, least: Column, distinct: Column, sample: Column) -> Column:
    return F.format_string("`%s` - max value: %s, min value: %s, number of distinct values: %s, random sample data: [%s]. ", column, largest, least, distinct.cast("string"), F.array_join(sample, ", "))
