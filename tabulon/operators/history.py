"""Revisions, snapshots and article statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(revisions: DataFrame, key: str, ts: str, value: str, at: Column) -> DataFrame:
    """The newest value of each key that isn't newer than ``at``; keys without one have null. Ties go to the larger value."""
    old = F.when(F.col(ts) <= at, F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))
    return revisions.groupBy(key).agg(F.max(old).alias("_m")).select(key, F.col("_m.value").alias(value), F.col("_m.ts").alias(ts))


def snapshot_diff(old: DataFrame, new: DataFrame, table: str, row: str, columns: list[str]) -> DataFrame:
    """table, status, row, column: the first place where a snapshot's row differs, or ``match``.

    Rows meet by place; rows that only one side has are ignored. Two nulls are equal. One comparison a row
    and one aggregation a table.
    """
    pick = lambda df, side: df.select(table, row, F.struct(*columns).alias(side))
    both = pick(old, "o").join(pick(new, "n"), [table, row])
    first = reduce(lambda rest, i: F.when(~F.col("o")[columns[i]].eqNullSafe(F.col("n")[columns[i]]), F.lit(i)).otherwise(rest), range(len(columns) - 1, -1, -1), F.lit(None).cast("int"))
    at = F.when(first.isNotNull(), F.struct(F.col(row).alias("row"), first.alias("col")))
    found = both.groupBy(table).agg(F.min(at).alias("at"))
    name = F.get(F.array(*map(F.lit, columns)), F.col("at.col"))
    status = F.when(F.col("at").isNull(), "match").otherwise(F.concat_ws("-", F.lit("misMatchValues"), name, F.col("at.row").cast("string")))
    return found.select(table, status.alias("status"), F.col("at.row").alias("row"), name.alias("column"))


def consistency(old_headers: DataFrame, new_headers: DataFrame, diff: DataFrame, table: str) -> DataFrame:
    """table, status of new tables: noOldPage without an old one, misMatchHeaders if names differ, else the diff's."""
    met = new_headers.join(old_headers.withColumnRenamed("header", "_old"), table, "left").join(diff.select(table, "status"), table, "left")
    status = F.when(F.col("_old").isNull(), "noOldPage").when(F.col("_old") != F.col("header"), "misMatchHeaders").otherwise(F.coalesce("status", F.lit("match")))
    return met.select(table, status.alias("status"))


def consistent(statuses: DataFrame, table: str) -> DataFrame:
    """The tables whose old and new snapshot match."""
    return statuses.where("status = 'match'").select(table)


def article_details(revisions: DataFrame, views: DataFrame, page: str) -> DataFrame:
    """page, first_changed (a date), num_of_changes, popularity (mean views, cut to an integer; exact where views have ten decimals at most)."""
    changes = revisions.groupBy(page).agg(F.substring(F.min("ts").cast("string"), 1, 10).alias("first_changed"), F.count("*").alias("num_of_changes"))
    exact = F.col("views").try_cast("decimal(28,10)")  # summed as doubles, a whole mean may fall short of itself, as the rows come
    sums = views.groupBy(page).agg(F.avg("views").alias("mean"), F.sum(exact).alias("total"), F.count_if(exact.cast("double") == F.col("views")).alias("fit"), F.count("views").alias("n"))
    n = F.nullif("n", F.lit(0))
    whole = F.when(F.col("fit") == n, ((F.col("total") - F.pmod("total", n)) / n).cast("bigint")).otherwise(F.floor("mean"))
    seen = sums.select(page, whole.alias("popularity"))
    return changes.join(seen, page, "left")
