"""Tests that a whole table must pass, and the order in which the tables of a page are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.config import Rules
from tabulon.functions.values import is_ascii

# ``header`` below is an array of names.


def too_small(rules: Rules = Rules()) -> Column:
    return (F.col("n_rows") < rules.min_rows) | (F.col("n_cols") < rules.min_columns)


def default_header(header: Column) -> Column:
    """Names that are just 0, 1, 2, ..."""
    return (F.size(header) > 0) & F.forall(F.zip_with(header, F.sequence(F.lit(0), F.size(header) - 1), lambda h, i: h == i.cast("string")), lambda x: F.coalesce(x, F.lit(False)))


def mangled_header(header: Column) -> Column:
    """A name such as ``Score.1``, or a name that occurs twice."""
    return F.exists(header, lambda h: h.rlike(r"(?U)^\w+\.\d")) | (F.size(F.array_distinct(header)) < F.size(header))


def foreign_header(header: Column) -> Column:
    return ~F.forall(header, lambda h: is_ascii(h))


def empty_header(header: Column) -> Column:
    return F.exists(header, lambda h: h.isNull() | h.contains("Unnamed:"))


def foreign_tables(cells: DataFrame) -> DataFrame:
    """table_id of tables with a cell that isn't ASCII. ``cells`` has table_id and raw."""
    return cells.where(~is_ascii(F.col("raw"))).select("table_id").distinct()


def first_reason(tables: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``tables`` (n_rows, n_cols, header_depth, header, ascii_data) with the first reason to reject each, or null."""
    h = F.col("header")
    reason = (
        F.when(too_small(rules), "size").when(F.col("header_depth") > 1, "multi-level header").when(default_header(h), "default header").when(mangled_header(h), "mangled header")
    )
    if rules.only_ascii:
        reason = reason.when(foreign_header(h), "header not ASCII").when(~F.col("ascii_data"), "data not ASCII")
    return tables.withColumn("reason", reason)


def ranked(tables: DataFrame, page: str, size: str, order: str) -> DataFrame:
    """size_rank of each table of its page: most non-null cells first, then document order."""
    return tables.withColumn("size_rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(size), order)))


def first_survivor(tables: DataFrame, page: str, size: str, order: str, passes: Column) -> DataFrame:
    """The best-ranked table of each page that passes; ranks are those among all its tables."""
    kept = ranked(tables, page, size, order).where(passes)
    least = kept.groupBy(page).agg(F.min("size_rank").alias("size_rank"))
    return kept.join(least, [page, "size_rank"], "left_semi")


def picked(tables: DataFrame, order: str, index: int) -> DataFrame:
    """The table of a 1-based place in its page."""
    return tables.where(F.col(order) == index - 1)
