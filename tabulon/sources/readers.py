"""Scans of landed dumps: revisions, page views, search hits, delimited replies, CSV tables, record stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIONS = "query struct<pages: map<string, struct<pageid: bigint, title: string, revisions: array<struct<revid: bigint, timestamp: string, size: bigint>>>>>"
VIEWS = "items array<struct<article: string, timestamp: string, views: bigint>>"
SEARCH = "query struct<search: array<struct<title: string, pageid: bigint>>>"
INFO = "query struct<pages: map<string, struct<pageid: bigint, title: string, editurl: string, missing: string>>>"
ARTICLE = "first_changed string, num_of_changes int, popularity int"


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, revid, ts, size from dumped answers of the history interface; any number of parts a page."""
    pages = spark.read.schema(REVISIONS).json(path).select(F.explode(F.map_values("query.pages")).alias("p"))
    rows = pages.select(F.col("p.pageid").alias("page_id"), F.col("p.title").alias("title"), F.explode("p.revisions").alias("r"))
    return rows.select("page_id", "title", "r.revid", F.try_to_timestamp("r.timestamp").alias("ts"), "r.size")


def page_views(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEWS).json(path).select(F.explode("items").alias("i")).select(F.col("i.article").alias("page"), F.col("i.timestamp").alias("month"), "i.views")


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Titles and page ids; only ASCII titles go on."""
    hits = spark.read.schema(SEARCH).json(path).select(F.explode("query.search").alias("h")).select("h.title", F.col("h.pageid").alias("page_id"))
    return hits.where(F.col("title").rlike(r"^[\x00-\x7F]*$"))


def article_metadata(records: DataFrame, column: str = "article_metadata") -> DataFrame:
    return records.withColumn(column, F.from_json(column, ARTICLE))


#: A record of a delimited text: line breaks may stand in quotes. No part of it is tried again.
RECORD = r'((?:[^"\r\n]++|"(?:[^"]++|"")*+"?+)++)(?:\r?\n|\r|\z)'


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of many CSV tables of any shape: table_id is the file's name. A file is read whole; quoted fields may hold line breaks."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1).alias("table_id"), F.regexp_extract_all("value", F.lit(RECORD), F.lit(1)).alias("l"))
    rows = lines.select("table_id", F.get("l", F.lit(0)).alias("h"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("row_idx", "line"))
    rows = rows.select("table_id", "row_idx", fields("h", ",").alias("header"), fields("line", ",").alias("values"))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("header") - 1), lambda i: F.struct(i.alias("col_idx"), F.get("header", i).alias("col_name"), F.nullif(F.get("values", i), F.lit("")).alias("raw"))))
    return rows.select("table_id", "row_idx", each.alias("c")).select("table_id", "row_idx", "c.*")


def column_types(cells: DataFrame) -> DataFrame:
    """table_id, col_name, dtype of columns of texts (raw): int64 if all are whole numbers, float64 if all are numbers or missing, else object."""
    whole, number = F.col("raw").rlike(r"^\s*[+-]?\d+\s*$"), F.col("raw").try_cast("double").isNotNull() & F.col("raw").rlike(r"[0-9]")
    by = cells.groupBy("table_id", "col_name").agg(F.count("*").alias("n"), F.count("raw").alias("present"), F.count_if(whole).alias("whole"), F.count_if(number).alias("numbers"))
    dtype = F.when((F.col("n") == F.col("whole")), "int64").when(F.col("numbers") == F.col("present"), "float64").otherwise("object")
    return by.select("table_id", "col_name", dtype.alias("dtype"))


def fields(line, separator: str):
    """The fields of a delimited line; double quotes may enclose a field (a doubled one stands for itself)."""
    sep = "\\" + separator
    parts = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(rf'{sep}("(?:[^"]++|"")*+"|[^{sep}]*+)'), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(p))


def reply_rows(replies: DataFrame, key: str, reply: str, n_fields: str) -> DataFrame:
    """key, row_idx, values of the ``|`` fields of a reply's lines. A short line is filled up with nulls; a reply with a line that is too long gives none."""
    lines = replies.select(key, n_fields, F.filter(F.split(reply, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0).alias("l"))
    parsed = lines.select(key, n_fields, F.transform("l", lambda x: F.transform(fields(x, "|"), lambda v: F.trim(v))).alias("rows"))
    even = parsed.where(F.forall("rows", lambda r: F.size(r) <= F.col(n_fields)))
    full = lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), F.col(n_fields) - F.size(r)))
    return even.select(key, F.posexplode(F.transform("rows", full)).alias("row_idx", "values"))


def search_draws(spark: SparkSession, n: int = 1000, most_offset: int = 9500, seed: int = 7919) -> DataFrame:
    """draw, prefix (a capital and a small letter), offset: what a search run asks for, repeatable by its seed."""
    k = F.col("id") * seed + 104729
    letter = lambda base, x: F.char(F.lit(base) + F.pmod(x, F.lit(26)).cast("int"))
    return spark.range(n).select(F.col("id").alias("draw"), F.concat(letter(65, k), letter(97, F.floor(k / 26))).alias("prefix"), F.pmod(k * 31, F.lit(most_offset + 1)).alias("offset"))


def page_info(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, edit_url from dumped answers; a missing page has neither."""
    pages = spark.read.schema(INFO).json(path).select(F.explode("query.pages").alias("k", "p"))
    here = lambda c: F.when(F.col("p.missing").isNull(), F.col(c))
    return pages.select(F.col("k").cast("bigint").alias("page_id"), here("p.title").alias("title"), here("p.editurl").alias("edit_url"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record store: key, and the record decoded from its JSON."""
    return spark.read.parquet(path).select("key", F.from_json("value", schema).alias("record"))
