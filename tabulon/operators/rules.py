"""Row, column and cell rules over the cells of many tables.

``cells`` has table_id, row_idx, col_idx, col_name and raw. Each rule takes and returns cells, or names
the rows, columns or tables that go, so that rules chain without leaving the cluster. A rule's statistics
are one aggregation on (table_id, ...); their join back is by the same table_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.config import STYLE_MARK, Rules
from tabulon.functions.values import let, plain_number, tidy, typed


def blacklisted(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """table_id, col_idx of the columns to drop: all listed ones, where the first of them is at an edge of the table."""
    listed = (F.col("col_name") == "") | F.col("col_name").isin(*rules.blacklist)
    stats = cells.groupBy("table_id").agg(F.min(F.when(listed, F.col("col_idx"))).alias("first"), F.max("col_idx").alias("last"))
    edge = stats.where((F.col("first") == 0) | (F.col("first") == F.col("last"))).select("table_id")
    return cells.where(listed).select("table_id", "col_idx").distinct().join(edge, "table_id", "left_semi")


def drop_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells without the named columns; the rest keep their places."""
    return cells.join(columns, ["table_id", "col_idx"], "left_anti")


def noise_rows(cells: DataFrame) -> DataFrame:
    """table_id, row_idx of rows that repeat the header, or hold one value in every cell (rows of nulls stay)."""
    by = cells.groupBy("table_id", "row_idx").agg(
        F.bool_and(F.coalesce(F.col("raw") == F.col("col_name"), F.lit(False))).alias("header"),
        ((F.count("raw") == F.count("*")) & (F.min("raw") == F.max("raw"))).alias("divider"),
    )
    return by.where("header or divider").select("table_id", "row_idx")


def drop_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    return cells.join(rows, ["table_id", "row_idx"], "left_anti")


def without_parentheses(c: Column) -> Column:
    return F.when(c.rlike(r"\(.+\)"), F.trim(F.regexp_replace(c, r"\(.+?\)", ""))).otherwise(c)


def without_brackets(c: Column) -> Column:
    """From the first bracket to the last one."""
    return F.when(c.rlike(r"\[.+?\]"), F.trim(F.regexp_replace(c, r"\[.+\]", ""))).otherwise(c)


def header_text(c: Column, rules: Rules = Rules()) -> Column:
    """A column's name without style marks' text and bracketed notes, as the settings say."""
    if rules.strip_header_style:
        c = F.when(c.rlike(f"^{STYLE_MARK}.+{STYLE_MARK}$"), c).otherwise(F.regexp_replace(c, f"{STYLE_MARK}.+{STYLE_MARK}", ""))
    c = tidy(c)
    if rules.strip_header_brackets:
        c = F.trim(F.regexp_replace(c, r"\[.*?\]", ""))
    if rules.strip_header_parentheses:
        c = F.trim(F.regexp_replace(c, r"\(.*?\)", ""))
    return c


def clean(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Cells with v, their typed value after notes in parentheses and brackets are gone."""
    steps = [without_parentheses] * rules.strip_cell_parentheses + [without_brackets] * rules.strip_cell_brackets

    def cleaned(c: Column, rest: list) -> Column:
        return let(rest[0](c), lambda x: cleaned(x, rest[1:])) if rest else typed(c, rules.null_tokens, rules.date_formats)

    # null tokens count before trimming as well as after cleaning
    v = F.when(F.col("raw").isin(*rules.null_tokens), F.lit(None)).otherwise(plain_number(F.col("raw"), let(tidy(F.col("raw")), lambda x: cleaned(x, steps))))
    return cells.withColumn("v", v)


def is_number(v: Column) -> Column:
    return v["num"].isNotNull()


def type_counts(cells: DataFrame) -> DataFrame:
    """table_id, col_idx, numbers, texts of every column."""
    return cells.groupBy("table_id", "col_idx").agg(F.count_if(is_number(F.col("v"))).alias("numbers"), F.count_if(F.col("v").isNotNull() & ~is_number(F.col("v"))).alias("texts"))


def is_mixed(numbers: Column, texts: Column, mode: str = "abs", value: float = 3) -> Column:
    """Whether a column mixes numbers and texts. percent: fewer over more, where none counts as one."""
    fewer, more = F.least(numbers, texts), F.greatest(numbers, texts)
    return fewer >= value if mode == "abs" else F.coalesce(F.try_divide(F.greatest(fewer, F.lit(1)), more) >= value, F.lit(False))


def mixed_columns(cells: DataFrame, mode: str = "abs", value: float = 3) -> DataFrame:
    """table_id, col_idx, numbers, texts of columns that mix both."""
    return type_counts(cells).where(is_mixed(F.col("numbers"), F.col("texts"), mode, value))


def drop_bad_columns(cells: DataFrame, bad: DataFrame, rules: Rules = Rules(), mode: str = "percent") -> DataFrame:
    """The whole table goes with a bad column, if the settings say so and the rule isn't an absolute null rule."""
    if rules.drop_table_with_column and mode != "abs null":
        return cells.join(bad.select("table_id").distinct(), "table_id", "left_anti")
    return drop_columns(cells, bad.select("table_id", "col_idx"))


def null_columns(cells: DataFrame, mode: str = "percent", value: float = 0.4) -> DataFrame:
    """table_id, col_idx of columns with too many nulls (strictly more than the value)."""
    by = cells.groupBy("table_id", "col_idx").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count("*").alias("n"))
    return by.where(F.col("nulls") > (F.lit(value) if mode == "abs" else F.col("n") * value)).select("table_id", "col_idx")


def null_rows(cells: DataFrame, mode: str = "percent", value: float = 0.8) -> DataFrame:
    by = cells.groupBy("table_id", "row_idx").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count("*").alias("n"))
    return by.where(F.col("nulls") > (F.lit(value) if mode == "abs" else F.col("n") * value)).select("table_id", "row_idx")


def aggregate_rows(cells: DataFrame) -> DataFrame:
    """table_id, row_idx of last rows that hold a text or nothing where, in the first or the last column, all rows before hold numbers.

    Cells are reduced to columns, columns to tables; a table needs its outer columns and its last row only.
    """
    number, text = is_number(F.col("v")), F.col("v").isNotNull() & ~is_number(F.col("v"))
    flags = F.when(number, 1).when(text, 2).otherwise(0)
    by = cells.groupBy("table_id", "col_idx").agg(
        F.count("*").alias("n"), F.count_if(number).alias("numbers"), F.count_if(text).alias("texts"), F.max("row_idx").alias("row"), F.max_by(flags, "row_idx").alias("end")
    )
    column = F.struct("n", "numbers", "texts", "row", "end")
    table = by.groupBy("table_id").agg(F.max("row").alias("row_idx"), F.min_by(column, "col_idx").alias("a"), F.max_by(column, "col_idx").alias("z"))

    def total(c: Column) -> Column:
        here = (c["row"] == F.col("row_idx")).cast("int")  # a column may have no cell in the last row
        number, text = here * (c["end"] == 1).cast("int"), here * (c["end"] == 2).cast("int")
        return (c["n"] - here > 0) & (c["numbers"] - number > 0) & (c["texts"] - text == 0) & (number == 0)

    return table.where(total(F.col("a")) | total(F.col("z"))).select("table_id", "row_idx")


def year_columns(cells: DataFrame) -> DataFrame:
    """table_id of tables whose nameless first column holds years only."""
    first = cells.where((F.col("col_idx") == 0) & (F.col("col_name") == "Unnamed: 0"))
    year = F.regexp_replace("raw", r"\[.*?\]", "").try_cast("double")
    return first.groupBy("table_id").agg(F.bool_and(F.coalesce(year.between(1000, 3000), F.lit(False))).alias("years")).where("years").select("table_id")


def name_years(cells: DataFrame) -> DataFrame:
    found = year_columns(cells).withColumn("_year", F.lit(True))
    name = F.when((F.col("col_idx") == 0) & F.col("_year"), "Year").otherwise(F.col("col_name"))
    return cells.join(found, "table_id", "left").withColumn("col_name", name).drop("_year")


def curate(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All rules in order. Cells of rejected tables, dropped rows and columns are gone; the rest have v.

    The same rules as above, but as windows over the cells instead of joins with their own aggregates:
    cells are shuffled once, by table, and typed once. Every window's keys begin with the table. A task sorts
    its cells three times, so their number of parts goes with the input, not with the session's cores.
    """
    table = Window.partitionBy("table_id")
    row, column = Window.partitionBy("table_id", "row_idx"), Window.partitionBy("table_id", "col_idx")
    yes = lambda c, w: F.coalesce(F.bool_or(c).over(w), F.lit(False))
    name, v = F.col("col_name"), F.col("v")

    year = F.regexp_replace("raw", r"\[.*?\]", "").try_cast("double").between(1000, 3000)
    nameless_first = (F.col("col_idx") == 0) & F.coalesce(name == "Unnamed: 0", F.lit(False))
    cells = cells.repartition(_parts(cells), "table_id").sortWithinPartitions("table_id", "row_idx")  # one order for the tables' and the rows' windows
    cells = cells.withColumn("_other", yes(nameless_first & ~F.coalesce(year, F.lit(False)), table))
    cells = cells.withColumn("col_name", F.when(nameless_first & ~F.col("_other"), "Year").otherwise(name))
    listed = F.coalesce((name == "") | name.isin(*rules.blacklist), F.lit(False))
    cells = cells.withColumns(
        {
            "_nameless": yes(name.isNull() | name.contains("Unnamed:"), table),
            "_listed": listed,
            "_first": F.min(F.when(listed, F.col("col_idx"))).over(table),
            "_last": F.max("col_idx").over(table),
        }
    )
    cells = cells.where(~F.col("_nameless") & ~(F.col("_listed") & ((F.col("_first") == 0) | (F.col("_first") == F.col("_last")))))

    cells = cells.withColumns(
        {
            "_header": F.bool_and(F.coalesce(F.col("raw") == name, F.lit(False))).over(row),
            "_divider": (F.count("raw").over(row) == F.count("*").over(row)) & (F.min("raw").over(row) == F.max("raw").over(row)),
        }
    ).where("not _header and not coalesce(_divider, false)")

    cells = clean(cells, rules)
    number, text = F.count_if(is_number(v)).over(column), F.count_if(v.isNotNull() & ~is_number(v)).over(column)
    cells = cells.withColumns({"_n": number, "_t": text})
    mixed = is_mixed(F.col("_n"), F.col("_t"), rules.mixed_mode, rules.mixed_value)
    cells = _without(cells.withColumn("_bad", mixed), rules.drop_table_with_column, table)

    cells = cells.withColumn("col_name", header_text(name, rules))
    if rules.drop_last_aggregate_row:
        cells = cells.withColumns({"_end": F.max("row_idx").over(table), "_left": F.min("col_idx").over(table), "_right": F.max("col_idx").over(table)})
        before = F.col("row_idx") < F.col("_end")
        cells = cells.withColumns(
            {
                "_n": F.count_if(before & is_number(v)).over(column),
                "_t": F.count_if(before & v.isNotNull() & ~is_number(v)).over(column),
                "_e": F.count_if(~before & is_number(v)).over(column),
            }
        )
        total = F.col("col_idx").isin(F.col("_left"), F.col("_right")) & (F.col("_n") > 0) & (F.col("_t") == 0) & (F.col("_e") == 0)
        cells = cells.withColumn("_total", yes(total, table)).where(~(F.col("_total") & (F.col("row_idx") == F.col("_end"))))

    limit = lambda mode, value, w: F.lit(value) if mode == "abs" else F.count("*").over(w) * value
    cells = cells.withColumn("_bad", F.count_if(v.isNull()).over(column) > limit(rules.column_null_mode, rules.column_null_value, column))
    cells = _without(cells, rules.drop_table_with_column and rules.column_null_mode != "abs", table)
    cells = cells.withColumn("_bad", F.count_if(v.isNull()).over(row) > limit(rules.row_null_mode, rules.row_null_value, row)).where("not _bad")
    return cells.select("table_id", "row_idx", "col_idx", "col_name", "raw", "v")


#: Bytes of input (files, as they are read) in a part of ``curate``; its sorts took up to 126 MB for that of a compressed table.
PART_BYTES = 256 << 10
#: A shuffle to more parts than these holds its cells in memory and spills, so parts grow to LARGE_PART_BYTES first.
FREE_PARTS, LARGE_PART_BYTES = 200, 4 << 20


def _parts(cells: DataFrame) -> int:
    """So many parts that each has PART_BYTES of the plan's input; of over FREE_PARTS so many that each has LARGE_PART_BYTES.

    Sixteen times the session's shuffle partitions at most; those themselves where the size isn't known.
    """
    spark = cells.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(cells._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # a frame without files, or a product of joined sizes
        return usual
    parts = min(-(-size // PART_BYTES), max(FREE_PARTS, -(-size // LARGE_PART_BYTES)))
    return max(min(usual, spark.sparkContext.defaultParallelism), min(parts, 16 * usual))


def _without(cells: DataFrame, whole_table: bool, table) -> DataFrame:
    """Cells without bad columns, or without the tables that hold one."""
    if whole_table:
        cells = cells.withColumn("_bad", F.bool_or("_bad").over(table))
    return cells.where("not _bad")


def rejections(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """table_id, reason, columns (sorted names): the first rule for which ``curate`` drops each table that it drops whole."""
    named = name_years(cells)
    nameless = named.where(F.col("col_name").isNull() | F.col("col_name").contains("Unnamed:"))
    named = drop_columns(named, blacklisted(named, rules))
    typed_cells = clean(drop_rows(named, noise_rows(named)), rules)
    found = nameless.select("table_id", F.lit(1).alias("step"), F.lit("nameless column").alias("reason"), F.coalesce("col_name", F.lit("")).alias("col_name"))
    heads = typed_cells.select("table_id", "col_idx", "col_name").distinct()
    if rules.drop_table_with_column:
        mixed = mixed_columns(typed_cells, rules.mixed_mode, rules.mixed_value).join(heads, ["table_id", "col_idx"])
        found = found.unionByName(mixed.select("table_id", F.lit(2).alias("step"), F.lit("mixed types").alias("reason"), "col_name"))
        if rules.column_null_mode != "abs":
            rows = drop_rows(typed_cells, aggregate_rows(typed_cells)) if rules.drop_last_aggregate_row else typed_cells
            nulls = null_columns(rows, rules.column_null_mode, rules.column_null_value).join(heads, ["table_id", "col_idx"])
            found = found.unionByName(nulls.select("table_id", F.lit(3).alias("step"), F.lit("too many nulls").alias("reason"), "col_name"))
    by = found.groupBy("table_id", "step", "reason").agg(F.array_sort(F.collect_set("col_name")).alias("columns"))
    first = by.groupBy("table_id").agg(F.min_by(F.struct("reason", "columns"), "step").alias("r"))
    return first.select("table_id", "r.reason", "r.columns")


def dates_of(cells: DataFrame) -> DataFrame:
    """table_id, col_name and the date format of its last date cell."""
    from tabulon.functions.values import date_format_of

    found = cells.where(F.col("v.kind") == "date").withColumn("format", date_format_of(F.col("v.txt")))
    return found.groupBy("table_id", "col_name").agg(F.max_by("format", "row_idx").alias("format"))


def row_places(cells: DataFrame) -> DataFrame:
    """Cells with the place of their row among the rows that are left."""
    return cells.withColumn("place", F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_idx")))
