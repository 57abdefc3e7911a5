"""Keyed alignment of a fetched table to a reference, and its scores, for many tables at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.values import f1, normalize_key, number, same, typed, within
from tabulon.operators.cells import NUMERIC

SEPARATOR = "\x1f"


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = [normalize_key(F.col(k).cast("string")) for k in keys]
    return df.withColumn("_key", F.concat_ws(SEPARATOR, *parts))


def first_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group in ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def align(fetched: DataFrame, reference: DataFrame, table: str, row: str, keys: list[str], columns: list[str], tolerant: list[str], absolute: bool = False) -> DataFrame:
    """One row a (table, normalised key) of either side: its rows there (fetched_rows, ref_rows; null on one side only) and a match flag a column.

    Fetched rows that repeat a raw key count once, rows with a null key don't. Every remaining fetched row with a key
    of the reference counts, but values are always those of the first row of that normalised key on either side. Key
    cells count as matches. Fetched rows are reduced by raw key, then by normalised key, each with partial aggregates
    before the shuffle, and the reference once; the sides meet as they are then partitioned. Cells are compared as
    they stand and typed only where they differ.
    """
    not_null = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    values = lambda names: F.struct(*(F.col(c) for c in names))
    rest = [c for c in columns if c not in keys]
    raw = fetched.where(not_null).groupBy(table, *keys).agg(F.min(row).alias("_row"), F.min_by(values(rest), row).alias("f"))
    f0 = _keyed(raw, keys).groupBy(table, "_key").agg(F.min_by("f", "_row").alias("f"), F.count("*").alias("fetched_rows"))
    r0 = _keyed(reference, keys).groupBy(table, "_key").agg(F.min_by(values(rest), row).alias("r"), F.count("*").alias("ref_rows"))
    met = f0.join(r0, [table, "_key"], "full")

    def cell(df: DataFrame, side: str, c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        v = F.col(side)[c]
        return number(v, "int" if kind in NUMERIC[:4] else "float") if kind.split("(")[0] in NUMERIC else typed(v.cast("string"))

    def match(c: str) -> Column:
        both = F.col("fetched_rows").isNotNull() & F.col("ref_rows").isNotNull()
        if c in keys:
            return both.cast("int")
        a, b = cell(fetched, "f", c), cell(reference, "r", c)
        ok = same(a, b)
        if c in tolerant:
            ok = ok | F.coalesce(within(b["num"], a["num"], absolute), F.lit(False))
        if fetched.schema[c].dataType == reference.schema[c].dataType:
            ok = F.col("f")[c].eqNullSafe(F.col("r")[c]) | ok
        return F.when(both, ok).otherwise(False).cast("int")

    return met.select(table, "_key", "fetched_rows", "ref_rows", *(match(c).alias(c) for c in columns))


def column_matches(fetched: DataFrame, reference: DataFrame, table: str, row: str, keys: list[str], columns: list[str], tolerant: list[str], absolute: bool = False) -> DataFrame:
    """A row a table of the reference: key_matches, the matches of each column (m_<column>), and both row counts."""
    pairs = align(fetched, reference, table, row, keys, columns, tolerant, absolute)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    weight = F.when(F.col("ref_rows").isNotNull(), F.col("fetched_rows"))
    out = pairs.groupBy(table).agg(
        total("ref_rows").alias("ref_rows"), total("fetched_rows").alias("fetched_rows"), total(weight).alias("key_matches"), *(total(F.col(c) * F.col("fetched_rows")).alias(f"m_{c}") for c in columns)
    )
    return out.where("ref_rows > 0")


def metrics(ref: Column, got: Column, key: Column, total: Column, nk: Column | int, nc: Column | int) -> dict[str, Column]:
    """The ten metrics from a table's rows, fetched rows, key matches and all matches, key columns and columns. A ratio with nothing below it is null."""
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    rest = total - key * nk
    out = {
        "key_recall": div(key, ref), "key_precision": div(key, got), "non_key_recall": div(rest, ref * (nc - nk)), "non_key_precision": div(rest, got * (nc - nk)),
        "recall": div(total, ref * nc), "precision": div(total, got * nc), "relative_non_key_accuracy": div(rest, key * (nc - nk)),
    }
    return {**out, **{f"{k}f1_score": f1(out[f"{k}precision"], out[f"{k}recall"]) for k in ("key_", "non_key_", "")}}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def table_scores(matches: DataFrame, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The ten metrics of each table. A ratio with nothing below it is null; the table stays."""
    total = reduce(lambda a, b: a + b, (F.col(f"m_{c}") for c in columns))
    return matches.select(table, *_named(metrics(F.col("ref_rows"), F.col("fetched_rows"), F.col("key_matches"), total, len(keys), len(columns))))


def cell_matches(fetched: DataFrame, reference: DataFrame, columns: DataFrame, absolute: bool = False) -> DataFrame:
    """table_id, col_name, dtype, is_key, hits, ref_rows, fetched_rows, key_matches: ``column_matches`` for cells of tables of any shape.

    ``columns`` is table_id, col_name, dtype, is_key (one column a table), tolerant. Only the first row of each key on
    either side meets the other's cells; each join is by table and row, or table and key.
    """
    text = F.coalesce("v.txt", F.col("v.num").cast("string"))
    key = columns.where("is_key").select("table_id", "col_name")
    keys = lambda cells: cells.join(key, ["table_id", "col_name"]).where("v is not null").select("table_id", "row_idx", text.alias("raw"))
    normal = normalize_key(F.col("raw")).alias("_key")
    got = keys(fetched).groupBy("table_id", "raw").agg(F.min("row_idx").alias("row")).groupBy("table_id", normal).agg(F.min("row").alias("f_row"), F.count("*").alias("weight"))
    ref = keys(reference).groupBy("table_id", normal).agg(F.min("row_idx").alias("r_row"))
    met = got.join(ref, ["table_id", "_key"])
    cell = lambda cells, row, name: cells.select("table_id", F.col("row_idx").alias(row), "col_name", F.col("v").alias(name))
    pairs = met.join(cell(reference, "r_row", "r"), ["table_id", "r_row"]).join(cell(fetched, "f_row", "f"), ["table_id", "f_row", "col_name"], "left").join(columns, ["table_id", "col_name"])
    close = F.col("tolerant") & F.coalesce(within(F.col("r.num"), F.col("f.num"), absolute), F.lit(False))
    hit = F.col("is_key") | same(F.col("f"), F.col("r")) | close
    hits = pairs.groupBy("table_id", "col_name").agg(F.sum(F.when(hit, F.col("weight")).otherwise(0)).alias("hits"))
    rows = reference.groupBy("table_id").agg(F.count_distinct("row_idx").alias("ref_rows"))
    sides = got.groupBy("table_id").agg(F.sum("weight").alias("fetched_rows")).join(met.groupBy("table_id").agg(F.sum("weight").alias("key_matches")), "table_id", "left")
    out = columns.drop("tolerant").join(rows, "table_id").join(sides, "table_id", "left").join(hits, ["table_id", "col_name"], "left")
    return out.fillna(0, ["hits", "fetched_rows", "key_matches"])


def record_scores(matches: DataFrame) -> DataFrame:
    """The ten metrics of each table from ``cell_matches``."""
    by = matches.groupBy("table_id").agg(F.first("ref_rows").alias("r"), F.first("fetched_rows").alias("g"), F.first("key_matches").alias("k"), F.sum("hits").alias("t"), F.count("*").alias("nc"))
    return by.select("table_id", *_named(metrics(F.col("r"), F.col("g"), F.col("k"), F.col("t"), 1, F.col("nc"))))


def record_column_scores(matches: DataFrame) -> DataFrame:
    """table_id, col_name, dtype, recall, precision, f1_score from ``cell_matches``."""
    rows = matches.select("table_id", "col_name", "dtype", F.try_divide(F.col("hits").cast("double"), "ref_rows").alias("recall"), F.try_divide(F.col("hits").cast("double"), "fetched_rows").alias("precision"))
    return rows.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def column_scores(matches: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """table, col_name, dtype, recall, precision, f1_score: a row a column. ``columns`` maps names to types."""
    each = F.array(*(F.struct(F.lit(c).alias("col_name"), F.lit(t).alias("dtype"), F.col(f"m_{c}").cast("double").alias("m")) for c, t in columns.items()))
    rows = matches.select(table, "ref_rows", "fetched_rows", F.explode(each).alias("c")).select(table, "c.col_name", "c.dtype", F.try_divide(F.col("c.m"), F.col("ref_rows")).alias("recall"), F.try_divide(F.col("c.m"), F.col("fetched_rows")).alias("precision"))
    return rows.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def dtype_scores(scores: DataFrame, table: str) -> DataFrame:
    """table, dtype, and the sorted lists of the scores of its columns."""
    return scores.groupBy(table, "dtype").agg(*(F.array_sort(F.collect_list(m)).alias(m) for m in ("recall", "precision", "f1_score")))


def with_grand_mean(scores: DataFrame, table: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Rounded scores and a row ``All`` with their means over tables that have every metric; no rows without such a table.

    One pass: the mean of a single table's score is that score.
    """
    rounded = scores.dropna(subset=metrics).select(F.col(table).cast("string").alias(table), *(F.round(m, digits).alias(m) for m in metrics))
    means = rounded.rollup(table).agg(F.grouping(table).alias("_all"), *(F.round(F.avg(m), digits).alias(m) for m in metrics))
    return means.withColumn(table, F.when(F.col("_all") == 1, "All").otherwise(F.col(table))).drop("_all")
