"""The two stages that put questions to a model, from tables to scored records.

``generate``: a table is profiled, titled, given a key column, asked for as a whole, and the reply is scored
against it. ``lookups``, ``comparisons`` and ``extremes``: questions about cells, triples and whole columns, each
asked plainly, in other words, and with the page as context.

A responder takes (prompt_key, prompt) and gives (prompt_key, response) for what it can answer, such as
``store.offline(responses)`` or ``lambda p: store.respond(p, model)``. Tables may have any shape: ``cells`` is
(table_id, row_idx, col_idx, col_name, v), ``columns`` is (table_id, col_name, dtype).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.values import quoted_key, same, typed
from tabulon.operators import evaluate, profile
from tabulon.operators import questions as Q
from tabulon.sources.readers import reply_rows
from tabulon.sources.scratch import settled

Responder = Callable[[DataFrame], DataFrame]
NUMERIC = ("int64", "float64")


def text_of(v: Column) -> Column:
    """A value as it stands in a prompt: whole numbers without a fraction."""
    whole = (v["num"] == F.floor(v["num"])) & (F.abs(v["num"]) < 1e15)
    return F.coalesce(v["txt"], F.when(whole, v["num"].cast("decimal(20,0)").cast("string")).otherwise(v["num"].cast("string")))


def order_of(seed: int) -> Column:
    """The place of a row in a table's sample: arithmetic, so that every engine takes the same rows."""
    return (F.col("row_idx").cast("bigint") * seed) % 100003


def ask(rows: DataFrame, prompt: str, response: str, model: str, responder: Responder, context: bool = False) -> DataFrame:
    """``rows`` with the response to each prompt; null where there is none or an empty one. Equal prompts are asked once.

    Rows are written before they are asked about: a chain of questions would else repeat all before it at each step.
    """
    keyed = settled(rows.withColumn("_key", Q.prompt_key(model, F.trim(prompt), context)))
    prompts = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("_key").alias("prompt_key")).agg(F.first(F.trim(prompt)).alias("prompt"))
    found = responder(prompts).select(F.col("prompt_key").alias("_key"), F.nullif(F.trim("response"), F.lit("")).alias(response))
    return keyed.join(found, "_key", "left").drop("_key")


def descriptions(cells: DataFrame, seed: int = 7919) -> DataFrame:
    """table_id, data_sample (a profile line a column, with a sample of its values), uniqueness, rows, example rows as text."""
    shown = text_of(F.col("v"))
    rows = cells.groupBy("table_id").agg(F.count_distinct("row_idx").alias("rows"))
    place = F.row_number().over(Window.partitionBy("table_id", "col_idx").orderBy(order_of(seed), "row_idx"))
    some = cells.withColumn("place", place).where("place <= 5").join(rows, "table_id")
    some = some.withColumn("t", F.when(F.col("place") <= profile.sample_size(F.col("rows")), F.coalesce(shown, F.lit("nan"))))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("t")))), lambda s: s["t"])
    samples = some.groupBy("table_id", "col_idx", "col_name").agg(listed(F.col("t")).alias("sample"), listed(F.when(F.col("place") <= 3, F.coalesce(shown, F.lit("nan")))).alias("three"))
    about = samples.join(profile.profile(cells), ["table_id", "col_name"], "left").join(profile.uniqueness(cells), ["table_id", "col_name"])
    known = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    line = profile.profile_line(F.col("col_name"), known("max_value"), known("min_value"), F.coalesce("n_distinct", F.lit(0)), F.col("sample"))
    each = F.struct("col_idx", line.alias("line"), F.concat("col_name", F.lit(" ("), "label", F.lit(")")).alias("unique"), F.concat(F.lit("'"), "col_name", F.lit("': ["), F.array_join("three", ", "), F.lit("]")).alias("three"))
    by = about.groupBy("table_id").agg(F.array_sort(F.collect_list(each)).alias("c"))
    joined = lambda field, by: F.array_join(F.transform("c", lambda s: s[field]), by)
    return by.join(rows, "table_id").select("table_id", "rows", joined("line", "\n").alias("data_sample"), joined("unique", ", ").alias("uniqueness"), joined("three", ", ").alias("example"))


def generate(tables: DataFrame, cells: DataFrame, columns: DataFrame, model: str, responder: Responder, templates: dict[str, str] = Q.TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(records, column scores) of ``tables`` (table_id, article): title, key, shape and the ten metrics of what the model made.

    A table leaves the chain where the model names no key of it, gives no table, or a reply with a line too long.
    """
    heads = columns.join(cells.select("table_id", "col_idx", "col_name").distinct(), ["table_id", "col_name"])
    names = heads.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "dtype"))), lambda s: F.struct(s["col_name"].alias("col_name"), s["dtype"].alias("dtype"))).alias("columns"))
    rows = tables.select("table_id", "article").join(descriptions(cells), "table_id").join(names, "table_id")
    rows = rows.withColumn("prompt", Q.fill(templates["title"], article=F.col("article"), data_sample=F.col("data_sample")))
    rows = ask(rows, "prompt", "title", model, responder)
    rows = rows.withColumn("prompt", Q.fill(templates["key"], article=F.col("article"), table_title=F.col("title"), data_sample=F.col("example"), columns=F.col("uniqueness")))
    rows = ask(rows, "prompt", "key_reply", model, responder).withColumn("key", quoted_key(F.col("key_reply")))
    rows = rows.where(F.array_contains("columns.col_name", F.col("key")))
    described = F.array_join(F.transform("columns", lambda c: F.concat_ws(": ", c["col_name"], c["dtype"])), ", ")
    rows = rows.withColumn("prompt", Q.fill(templates["table"], table_title=F.col("title"), n_fields=F.size("columns"), columns=described, response_format=Q.response_format(F.col("columns.col_name"))))
    rows = ask(rows, "prompt", "reply", model, responder)
    rows = settled(rows.where("reply is not null").withColumn("n_fields", F.size("columns")))
    got = reply_rows(rows, "table_id", "reply", "n_fields").join(rows.select("table_id", F.col("columns.col_name").alias("names")), "table_id")
    fetched = got.select("table_id", "row_idx", F.posexplode(F.arrays_zip("names", "values")).alias("col_idx", "c")).select("table_id", "row_idx", "col_idx", F.col("c.names").alias("col_name"), typed(F.nullif("c.values", F.lit(""))).alias("v"))
    keyed = columns.join(rows.select("table_id", "key"), "table_id").withColumn("is_key", F.col("col_name") == F.col("key"))
    matches = evaluate.cell_matches(settled(fetched), cells, keyed.select("table_id", "col_name", "dtype", "is_key", F.col("dtype").isin(*NUMERIC).alias("tolerant")))
    shape = got.groupBy("table_id").agg(F.count("*").alias("got_rows"))
    records = rows.select("table_id", "article", "title", "key", "rows", F.col("n_fields").alias("cols")).join(shape, "table_id").join(evaluate.record_scores(matches), "table_id")
    return records, evaluate.record_column_scores(matches)


def _asked(rows: DataFrame, model: str, responder: Responder, templates: dict[str, str]) -> DataFrame:
    """``rows`` (url, title, question, answer) with response, rephrased_question, rephrased_response and context_response."""
    slots = {"table_title": F.col("title"), "url": F.col("url"), "question": F.col("question"), "answer": F.col("answer")}
    rows = ask(rows.withColumn("_p", Q.fill(templates["wrapper"], **slots)), "_p", "response", model, responder)
    rows = ask(rows.withColumn("_p", Q.fill(templates["rephrase"], **slots)), "_p", "rephrased_question", model, responder)
    again = F.when(F.col("rephrased_question").isNotNull(), Q.fill(templates["rephrased"], rephrase=F.col("rephrased_question")))
    rows = ask(rows.withColumn("_p", again), "_p", "rephrased_response", model, responder)
    rows = ask(rows.withColumn("_p", Q.fill(templates["context"], **slots)), "_p", "context_response", model, responder, True)
    return rows.drop("_p").where("response is not null and rephrased_response is not null")


def questionable(cells: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with url, title and key, key values): of ``tables`` (table_id, url, title, key) with a usable key name; columns of usable names but the key and Total."""
    good = tables.where(Q.usable_name(F.col("key")))
    every = cells.join(good, "table_id")
    keys = every.where(F.col("col_name") == F.col("key")).select("table_id", "row_idx", text_of(F.col("v")).alias("key_value"))
    return every.where((F.col("col_name") != F.col("key")) & (F.col("col_name") != "Total") & Q.usable_name(F.col("col_name"))), keys.where("key_value is not null")


def lookups(cells: DataFrame, tables: DataFrame, model: str, responder: Responder, seed: int = 7919, templates: dict[str, str] = Q.TEMPLATES) -> DataFrame:
    """One question a table about a cell: the first sampled row's first column with a value. Columns as ``writers.SINGLE``, and Rephrased correct."""
    rest, keys = questionable(cells, tables)
    first = keys.groupBy("table_id").agg(F.min_by(F.struct("row_idx", "key_value"), F.struct(order_of(seed), F.col("row_idx"))).alias("k")).select("table_id", "k.row_idx", "k.key_value")
    asked = rest.where(F.col("v").isNotNull()).join(first, ["table_id", "row_idx"])
    asked = asked.groupBy("table_id", "url", "title", "key", "key_value").agg(F.min_by(F.struct("col_name", "v"), "col_idx").alias("c")).select("*", "c.col_name", "c.v").drop("c")
    asked = asked.withColumns({"question": Q.fill(templates["value"], key_column=F.col("key"), key=F.col("key_value"), column=F.col("col_name")), "answer": text_of(F.col("v"))})
    right = lambda c: same(typed(F.col(c)), F.col("v")).cast("int")
    return _asked(asked, model, responder, templates).select(
        F.col("url").alias("URL"), F.col("key_value").alias("Key"), F.col("col_name").alias("Column"), F.col("answer").alias("Real Value"), F.col("response").alias("Response"), right("response").alias("Correct"),
        F.col("question").alias("Prompt"), F.col("rephrased_question").alias("Rephrased_question"), F.col("rephrased_response").alias("Rephased_response"), F.col("context_response").alias("Context Response"),
        F.when(F.col("context_response").isNotNull(), right("context_response")).alias("Context Correct"), right("rephrased_response").alias("Rephrased correct"),
    )


def measures(cells: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The rows of each table's first numeric column: table_id, url, title, key, col_name, row_idx, key_value, num."""
    rest, keys = questionable(cells, tables)
    numeric = rest.join(columns.where(F.col("dtype").isin(*NUMERIC)).select("table_id", "col_name"), ["table_id", "col_name"])
    first = numeric.groupBy("table_id").agg(F.min("col_idx").alias("col_idx"))
    return numeric.join(first, ["table_id", "col_idx"]).join(keys, ["table_id", "row_idx"]).select("table_id", "url", "title", "key", "col_name", "row_idx", "key_value", F.col("v.num").alias("num"))


def comparisons(cells: DataFrame, tables: DataFrame, columns: DataFrame, model: str, responder: Responder, largest: bool = True, seed: int = 7919, templates: dict[str, str] = Q.TEMPLATES) -> DataFrame:
    """One question a table about the largest, or smallest, of three sampled rows with a value. Columns as ``writers.COMPARISON``."""
    rows = measures(cells, tables, columns)
    about = rows.select("table_id", "url", "title", "key", "col_name").distinct()
    three = Q.triples(rows, "table_id", "key_value", "num", F.struct(order_of(seed), F.col("row_idx")))
    asked = three.join(about, "table_id").withColumn("answer", F.col("max_key" if largest else "min_key"))
    k = F.col("keys")
    asked = asked.withColumn("question", Q.fill(templates["max_of" if largest else "min_of"], a=k[0], b=k[1], c=k[2], key_column=F.col("key"), column=F.col("col_name")))
    right = lambda c: F.coalesce((F.col(c) == F.col("answer")).cast("int"), F.lit(0))
    return _asked(asked, model, responder, templates).select(
        F.col("url").alias("URL"), F.array_join("keys", ", ").alias("Key"), F.col("col_name").alias("Column"), F.col("response").alias("Response"), F.col("answer").alias("Actual Result"), right("response").alias("Correct"),
        right("rephrased_response").alias("Rephrased Correct"), F.col("question").alias("Prompt"), F.col("rephrased_question").alias("Rephrased Question"), F.col("rephrased_response").alias("Rephrased Response"),
        F.col("context_response").alias("Context Response"), F.when(F.col("context_response").isNotNull(), right("context_response")).alias("Context Correct"),
    )


def extremes(cells: DataFrame, tables: DataFrame, columns: DataFrame, model: str, responder: Responder, largest: bool = True, templates: dict[str, str] = Q.TEMPLATES) -> DataFrame:
    """One question a table about the largest, or smallest, value of a column, also with all keys provided. Columns as ``writers.EXTREME``.

    A response is 1 if a row of that key has the value, 0 if it is another key, -1 if it is none.
    """
    rows = measures(cells, tables, columns).where("num is not null")
    by = rows.groupBy("table_id", "url", "title", "key", "col_name").agg(F.max("num").alias("hi"), F.min("num").alias("lo"), F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "key_value"))), lambda s: s["key_value"]).alias("all_keys"))
    hits = rows.join(by.select("table_id", F.col("hi" if largest else "lo").alias("num")), ["table_id", "num"]).groupBy("table_id").agg(F.array_sort(F.collect_set("key_value")).alias("hits"))
    template = templates["max" if largest else "min"]
    slots = {"key_column": F.col("key"), "column": F.col("col_name")}
    asked = by.join(hits, "table_id").withColumns({"answer": F.array_join("hits", ", "), "question": Q.fill(template, **slots, provided_keys=""), "_q": Q.fill(template, **slots, provided_keys=Q.provided_keys(F.col("all_keys")))})
    asked = asked.withColumn("_w", Q.fill(templates["wrapper"], table_title=F.col("title"), question=F.col("_q")))
    asked = ask(asked, "_w", "with_keys", model, responder)
    verdict = lambda c: F.when(~F.array_contains("all_keys", F.coalesce(F.col(c), F.lit(""))), -1).when(F.array_contains("hits", F.col(c)), 1).otherwise(0)
    return _asked(asked, model, responder, templates).select(
        F.col("url").alias("URL"), F.col("key").alias("Key"), F.col("response").alias("Response"), F.col("answer").alias("actual_result"), verdict("response").alias("correct"), verdict("rephrased_response").alias("Rephrased correct"),
        verdict("with_keys").alias("With keys"), F.col("question").alias("Prompt"), F.col("rephrased_question").alias("Rephrased Question"), F.col("rephrased_response").alias("Rephrased Response"),
        F.col("context_response").alias("Context Response"), F.when(F.col("context_response").isNotNull(), verdict("context_response")).alias("Context Correct"),
    )


def tally(results: DataFrame, correct: str, rephrased: str, context: str, with_keys: str | None = None) -> DataFrame:
    """One row: asked, right, wrong, unknown, and the right ones in other words, with context and with keys, of an export."""
    is_ = lambda c, n: F.count_if(F.col(f"`{c}`") == n)
    keys = is_(with_keys, 1) if with_keys else F.lit(None).cast("bigint")
    return results.agg(F.count("*").alias("asked"), is_(correct, 1).alias("right"), is_(correct, 0).alias("wrong"), is_(correct, -1).alias("unknown"), is_(rephrased, 1).alias("rephrased_right"), is_(context, 1).alias("context_right"), keys.alias("with_keys_right"))


def raw_metrics(records: DataFrame) -> DataFrame:
    """A row a scored record (article, url, dates, columns as map of name to dtype, shape as (rows, cols), popularity, f1_score): ``writers.RAW_METRICS``.

    Records without scores are left out. The numeric ratio is the share of columns of a numeric type.
    """
    numeric = F.size(F.filter(F.map_values("columns"), lambda t: t.isin(*NUMERIC)))
    n = lambda c: F.col("shape")[c].cast("bigint")
    return records.where("f1_score is not null").select(
        "article", "url", "dates", n("rows").alias("rows"), n("cols").alias("columns"), (n("rows") * n("cols")).alias("cells"), F.try_divide(numeric.cast("double"), F.size("columns")).alias("numeric_ratio"), "popularity", "f1_score"
    )
