"""Questions about single cells, triples and extremes, and the scoring of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The slots are part of the interface; the wording is a parameter.
TEMPLATES = {
    "value": "In the row whose '{key_column}' is '{key}', what is '{column}'?",
    "max_of": "Of '{a}', '{b}' and '{c}', which '{key_column}' has the largest '{column}'?",
    "min_of": "Of '{a}', '{b}' and '{c}', which '{key_column}' has the smallest '{column}'?",
    "max": "Over the whole table, which '{key_column}' has the largest '{column}' {provided_keys}?",
    "min": "Over the whole table, which '{key_column}' has the smallest '{column}' {provided_keys}?",
    "wrapper": "About the table '{table_title}': {question} Answer with the value only.",
    "context": "About the table '{table_title}' on {url}: {question} Answer with the value only.",
    "title": "An article is named '{article}'. Its table has these columns:\n{data_sample}\nDescribe the table in one sentence that doesn't list the columns.",
    "key": "An article is named '{article}', its table: {table_title}. Some rows: {data_sample}. Of these columns ({columns}) which names the row? Answer as Key: 'column'.",
    "table": "List {table_title}: every row that you know, {n_fields} fields each: {columns}. Answer with lines of this form only:\n{response_format}",
    "table_example": "List {table_title}: every row that you know, {n_fields} fields each: {columns}. The first row is {example_row}. Answer with lines of this form only:\n{response_format}",
    "rephrased": "{rephrase}\nAnswer with the value only.",
    "rephrase": "About the table '{table_title}' on {url}: say in other words, with the same meaning: {question} The answer is '{answer}'.",
}


def fill(template: str, **slots: Column | str) -> Column:
    """A prompt: the template with its slots replaced by column values (null counts as empty)."""
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        value = slots[name]
        out.append(F.coalesce((F.lit(value) if isinstance(value, str) else value).cast("string"), F.lit("")))
    return F.concat(*out)


def load_templates(path: str, names: dict[str, str] | None = None) -> dict[str, str]:
    """TEMPLATES with those of a YAML mapping of text by name; ``names`` says which of ours a file's name stands for."""
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f) or {}
    return {**TEMPLATES, **{(names or {}).get(k, k): v.strip() for k, v in found.items()}}


def response_format(names: Column) -> Column:
    """How a line of a reply looks: each column's name in its place."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit('"<'), n, F.lit('>"'))), "|")


def provided_keys(keys: Column) -> Column:
    """The keys of a table as a prompt lists them."""
    return F.concat(F.lit("("), F.array_join(keys, ", "), F.lit(")"))


def known_columns(columns: Column, known: Column, key: Column) -> Column:
    """The columns but the key and Total that a table shares with what is known of it; a table without one isn't asked about."""
    return F.array_intersect(F.array_except(columns, F.array(key, F.lit("Total"))), known)


def index_set(*lists: Column) -> Column:
    """The rows of several lists, each once, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def capped(tables: DataFrame, order: str, n: int = 350) -> DataFrame:
    """The tables that a run looks at: the first n, before any test of them."""
    return tables.orderBy(order).limit(n)


def usable_name(name: Column) -> Column:
    return (F.length(name) > 1) & ~name.rlike(r"^\d+$")


def first_column(cells: DataFrame, allowed: Column) -> DataFrame:
    """The cells of each table's first allowed column."""
    first = cells.where(allowed).groupBy("table_id").agg(F.min("col_idx").alias("col_idx"))
    return cells.join(first, ["table_id", "col_idx"], "left_semi")


def triples(rows: DataFrame, table: str, key: str, value: str, order: Column) -> DataFrame:
    """table, keys (three, in sample order), max_key, min_key: tables with fewer than three rows with a value are left out."""
    w = Window.partitionBy(table).orderBy(order)
    three = rows.where(F.col(value).isNotNull()).withColumn("_p", F.row_number().over(w)).where("_p <= 3")
    out = three.groupBy(table).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", key))), lambda s: s[key]).alias("keys"),
        F.max_by(key, F.struct(F.col(value), -F.col("_p"))).alias("max_key"),
        F.min_by(key, F.struct(F.col(value), F.col("_p"))).alias("min_key"),
    )
    return out.where(F.size("keys") == 3)


def extremes(rows: DataFrame, table: str, key: str, value: str) -> DataFrame:
    """table, max_keys, min_keys: sorted keys of all rows that hold the largest and the smallest value."""
    by = rows.groupBy(table).agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    met = rows.join(by, table).where((F.col(value) == F.col("hi")) | (F.col(value) == F.col("lo")))
    return met.groupBy(table).agg(
        F.array_sort(F.collect_set(F.when(F.col(value) == F.col("hi"), F.col(key)))).alias("max_keys"), F.array_sort(F.collect_set(F.when(F.col(value) == F.col("lo"), F.col(key)))).alias("min_keys")
    )


def verdict(answers: DataFrame, keys: DataFrame, table: str, key: str, answer: str, hits: str) -> DataFrame:
    """``answers`` with verdict: -1 if the answer is no key of its table, 1 if it is among ``hits``, else 0."""
    known = keys.select(table, F.col(key).alias(answer)).distinct().withColumn("_known", F.lit(True))
    out = answers.join(known, [table, answer], "left")
    return out.withColumn("verdict", F.when(F.col("_known").isNull(), -1).when(F.array_contains(hits, F.col(answer)), 1).otherwise(0)).drop("_known")


def outcomes(scored: DataFrame, family: str) -> DataFrame:
    """family, right, wrong, unknown, asked."""
    v = F.col("verdict")
    return scored.groupBy(family).agg(F.count_if(v == 1).alias("right"), F.count_if(v == 0).alias("wrong"), F.count_if(v == -1).alias("unknown"), F.count("*").alias("asked"))


def prompt_key(model: str, prompt: Column, context: bool = False) -> Column:
    return F.concat_ws("_", F.lit("Context" if context else "NoContext"), F.lit(model), prompt)
