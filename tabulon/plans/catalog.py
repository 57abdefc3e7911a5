"""Every query of the table operators, with the DuckDB SQL that gives the same rows.

The driver's tables hold no web tables, so most queries apply an operator to a derivation of one: a
deterministic copy with changed keys, notes in brackets, nulls, and so on. Both sides state the derivation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.operators import cells as C
from tabulon.operators import evaluate as E
from tabulon.operators import gates as G
from tabulon.operators import history as H
from tabulon.operators import profile as P
from tabulon.operators import questions as Q
from tabulon.operators import report as R
from tabulon.operators import rules as U
from tabulon.operators import stages as T
from tabulon.operators import store as S
from tabulon.sources import html_tables, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- keyed evaluation -------------------------------------------------------------------------------

EVAL_COLUMNS = {"k": "object", "total": "float64", "status": "object", "placed": "date"}
EVAL_NAMES = list(EVAL_COLUMNS)


def eval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fetched, reference): orders as tables by priority, and a copy with lost, changed and repeated rows."""
    n = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    ref = o.select(
        F.col("o_orderpriority").alias("table_id"), n.alias("row_idx"), F.concat(F.lit("Order "), n.cast("string")).alias("k"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "dd MMM yyyy").alias("placed"),
    )
    kept = ref.where(F.col("row_idx") % 7 != 0)
    m = F.col("row_idx")
    copy = kept.select(
        "table_id", "row_idx",
        F.when(m % 17 == 0, None).when(m % 3 == 0, F.concat(F.lit(" order "), m.cast("string"), F.lit(" "))).otherwise(F.col("k")).alias("k"),
        F.when(m % 11 == 0, None).when(m % 5 == 0, F.col("total") * 1.0005).when(m % 5 == 1, F.col("total") * 1.01).otherwise(F.col("total")).alias("total"),
        F.when(m % 19 == 0, "X").otherwise(F.col("status")).alias("status"),
        F.when(m % 2 == 0, F.regexp_replace("placed", "^0", "")).otherwise(F.col("placed")).alias("placed"),
    )
    again = kept.where(m % 13 == 0).select("table_id", (m + 1_000_000_000_000).alias("row_idx"), F.upper("k").alias("k"), (F.col("total") * 2).alias("total"), "status", "placed")
    return copy.unionByName(again), ref


def eval_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, ref = eval_inputs(spark, sf_dir)
    return E.column_matches(fetched, ref, "table_id", "row_idx", ["k"], EVAL_NAMES, ["total"])


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_scores(eval_matches(spark, sf_dir), "table_id", ["k"], EVAL_NAMES)


def rounded(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keep, *(F.round(m, 4).alias(m) for m in metrics))


def nk_sql(x: str) -> str:
    s = f"replace(lower(trim({x})), '&', 'and')"
    return f"CASE WHEN {x} IS NULL OR {s} IN ('none', 'n/a', 'nan', '-', '--', 'unknown') THEN '' WHEN {s} = 'united states' THEN 'usa' WHEN {s} = 'united kingdom' THEN 'uk' ELSE regexp_replace(strip_accents(replace({s}, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g') END"


EVAL_SQL = f"""
WITH ref AS (SELECT o_orderpriority AS table_id, o_orderkey AS row_idx, 'Order ' || o_orderkey AS k, o_totalprice AS total, o_orderstatus AS status,
  strftime(o_orderdate, '%d %b %Y') AS placed FROM orders),
kept AS (SELECT * FROM ref WHERE row_idx % 7 <> 0),
fetched AS (SELECT table_id, row_idx, CASE WHEN row_idx % 17 = 0 THEN NULL WHEN row_idx % 3 = 0 THEN ' order ' || row_idx || ' ' ELSE k END AS k,
    CASE WHEN row_idx % 11 = 0 THEN NULL WHEN row_idx % 5 = 0 THEN total * 1.0005 WHEN row_idx % 5 = 1 THEN total * 1.01 ELSE total END AS total,
    CASE WHEN row_idx % 19 = 0 THEN 'X' ELSE status END AS status,
    CASE WHEN row_idx % 2 = 0 THEN regexp_replace(placed, '^0', '') ELSE placed END AS placed FROM kept
  UNION ALL SELECT table_id, row_idx + 1000000000000, upper(k), total * 2, status, placed FROM kept WHERE row_idx % 13 = 0),
counted AS (SELECT *, {nk_sql("k")} AS key FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY row_idx) AS rn FROM fetched) WHERE rn = 1 AND k IS NOT NULL),
f0 AS (SELECT *, count(*) OVER (PARTITION BY table_id, key) AS weight, row_number() OVER (PARTITION BY table_id, key ORDER BY row_idx) AS first FROM counted),
r0 AS (SELECT *, row_number() OVER (PARTITION BY table_id, key ORDER BY row_idx) AS first FROM (SELECT *, {nk_sql("k")} AS key FROM ref)),
pairs AS (SELECT f.table_id, f.weight, 1 AS k,
    (f.total IS NULL AND r.total IS NULL OR coalesce(f.total = r.total OR (r.total * 0.999 < f.total AND f.total < r.total * 1.001), false))::INT AS total,
    (f.status = r.status)::INT AS status,
    (strftime(strptime(f.placed, '%d %b %Y'), '%d %b %Y') = r.placed)::INT AS placed
  FROM f0 f JOIN r0 r ON f.table_id = r.table_id AND f.key = r.key AND f.first = 1 AND r.first = 1),
hits AS (SELECT table_id, sum(weight) AS km, sum(k * weight) AS m_k, sum(total * weight) AS m_total, sum(status * weight) AS m_status, sum(placed * weight) AS m_placed FROM pairs GROUP BY 1),
m AS (SELECT r.table_id, r.n AS rr, coalesce(f.n, 0) AS fr, coalesce(km, 0) AS km, coalesce(m_k, 0) AS m_k, coalesce(m_total, 0) AS m_total, coalesce(m_status, 0) AS m_status, coalesce(m_placed, 0) AS m_placed
  FROM (SELECT table_id, count(*) AS n FROM ref GROUP BY 1) r LEFT JOIN (SELECT table_id, count(*) AS n FROM counted GROUP BY 1) f USING (table_id) LEFT JOIN hits USING (table_id)),
t AS (SELECT *, m_k + m_total + m_status + m_placed AS tot FROM m),
p AS (SELECT table_id, km::DOUBLE / rr AS key_recall, km::DOUBLE / nullif(fr, 0) AS key_precision, (tot - km)::DOUBLE / (rr * 3) AS non_key_recall,
  (tot - km)::DOUBLE / nullif(fr * 3, 0) AS non_key_precision, tot::DOUBLE / (rr * 4) AS recall, tot::DOUBLE / nullif(fr * 4, 0) AS precision,
  (tot - km)::DOUBLE / nullif(km * 3, 0) AS relative_non_key_accuracy FROM t),
s AS (SELECT *, CASE WHEN key_precision + key_recall > 0 THEN 2 * key_precision * key_recall / (key_precision + key_recall) ELSE 0.0 END AS key_f1_score,
  CASE WHEN non_key_precision + non_key_recall > 0 THEN 2 * non_key_precision * non_key_recall / (non_key_precision + non_key_recall) ELSE 0.0 END AS non_key_f1_score,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM p),
u AS (UNPIVOT (SELECT table_id, rr, fr, m_k AS k, m_total AS total, m_status AS status, m_placed AS placed FROM m) ON k, total, status, placed INTO NAME col_name VALUE hit),
c AS (SELECT table_id, col_name, CASE col_name WHEN 'total' THEN 'float64' WHEN 'placed' THEN 'date' ELSE 'object' END AS dtype, hit::DOUBLE / rr AS recall, hit::DOUBLE / nullif(fr, 0) AS precision FROM u),
cs AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM c)
"""
METRICS = ["key_recall", "key_precision", "key_f1_score", "non_key_recall", "non_key_precision", "non_key_f1_score", "recall", "precision", "f1_score", "relative_non_key_accuracy"]
r4 = lambda names: ", ".join(f"round({m}, 4) AS {m}" for m in names)


def _scores_query(name: str, metrics: list[str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(eval_scores(spark, sf_dir), ["table_id"], metrics)
    ORACLES[name] = EVAL_SQL + f"SELECT table_id, {r4(metrics)} FROM s"


_scores_query("eval_keys", METRICS[:3])
_scores_query("eval_nonkeys", METRICS[3:6])
_scores_query("eval_cells", METRICS[6:9])
_scores_query("eval_relative", METRICS[9:])


@query(EVAL_SQL + f"SELECT table_id, col_name, dtype, {r4(['recall', 'precision', 'f1_score'])} FROM cs")
def eval_columns(spark, sf_dir):
    return rounded(E.column_scores(eval_matches(spark, sf_dir), "table_id", EVAL_COLUMNS), ["table_id", "col_name", "dtype"], ["recall", "precision", "f1_score"])


@query(EVAL_SQL + "SELECT table_id, dtype, list_sort(list(round(recall, 4))) AS recall, list_sort(list(round(precision, 4))) AS precision, list_sort(list(round(f1_score, 4))) AS f1_score FROM cs GROUP BY ALL")
def eval_by_dtype(spark, sf_dir):
    return E.dtype_scores(eval_columns(spark, sf_dir), "table_id")


@query(EVAL_SQL + f", q AS (SELECT table_id, {r4(METRICS)} FROM s) SELECT * FROM q UNION ALL BY NAME SELECT 'All' AS table_id, {', '.join(f'round(avg({m}), 4) AS {m}' for m in METRICS)} FROM q")
def grand_mean(spark, sf_dir):
    return E.with_grand_mean(eval_scores(spark, sf_dir), "table_id", METRICS)


@query(EVAL_SQL + "SELECT dtype, round(avg(f1_score), 4) AS mean, round(stddev_pop(f1_score), 4) AS upper, round(least(avg(f1_score), stddev_pop(f1_score)), 4) AS lower FROM cs GROUP BY 1")
def dtype_error_bars(spark, sf_dir):
    return R.error_bars(E.column_scores(eval_matches(spark, sf_dir), "table_id", EVAL_COLUMNS), "dtype", "f1_score")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def eval_first_match_dedupe(spark, sf_dir):
    return E.first_by(read(spark, sf_dir, "documents"), ["source", "text"], "doc_id").select("source", "doc_id")


# --- cells ------------------------------------------------------------------------------------------


@query("""SELECT 'customer' AS table_id, c_custkey AS row_idx, col_idx, col_name, num, txt FROM (
  SELECT c_custkey, 0 AS col_idx, 'c_name' AS col_name, NULL::DOUBLE AS num, c_name AS txt FROM customer UNION ALL
  SELECT c_custkey, 1, 'c_acctbal', c_acctbal, NULL FROM customer UNION ALL SELECT c_custkey, 2, 'c_mktsegment', NULL, c_mktsegment FROM customer)""")
def cells_unpivot(spark, sf_dir):
    cells = C.unpivot(read(spark, sf_dir, "customer"), F.lit("customer"), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])
    return cells.select("table_id", "row_idx", "col_idx", "col_name", "v.num", "v.txt")


@query("SELECT 'nation' AS table_id, n_nationkey AS row_idx, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def cells_pivot(spark, sf_dir):
    cells = C.unpivot(read(spark, sf_dir, "nation"), F.lit("nation"), "n_nationkey", ["n_name", "n_regionkey"])
    return C.pivot(cells, ["n_name", "n_regionkey"]).withColumn("n_regionkey", F.col("n_regionkey").cast("double"))


@query("SELECT l_orderkey AS table_id, count(DISTINCT l_linenumber) AS n_rows, 3::BIGINT AS n_cols, 3 * count(DISTINCT l_linenumber) AS cells FROM lineitem GROUP BY 1")
def table_shapes(spark, sf_dir):
    return C.shapes(C.unpivot(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey", "l_quantity", "l_returnflag"]))


# --- gates ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS table_id, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) >= 4")
def gate_min_size(spark, sf_dir):
    from tabulon.config import Rules

    sizes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(11))
    return sizes.where(~G.too_small(Rules(min_rows=4))).select("table_id", "n_rows")


@query(r"SELECT doc_id FROM documents WHERE text IS NULL OR regexp_full_match(text, '[\x00-\x7F∫]*', 's')")
def gate_ascii_rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(V.is_ascii(F.col("text"))).select("doc_id")


@query(r"SELECT DISTINCT lang || '/' || source AS table_id FROM documents WHERE NOT regexp_full_match(text, '[\x00-\x7F∫]*', 's')")
def gate_ascii_groups(spark, sf_dir):
    return G.foreign_tables(read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("table_id"), F.col("text").alias("raw")))


HEADERS = [["0", "1"], ["Name", "Score"], ["Name", "Score.1"], ["Name", "Name"], ["Unnamed: 0", "b"], ["Año", "x"], ["No.1", "x"]]
HEADERS_SQL = ", ".join("[" + ", ".join(f"'{n}'" for n in h) + "]" for h in HEADERS)


@query(f"""WITH h AS (SELECT n_nationkey, ([{HEADERS_SQL}])[n_nationkey % {len(HEADERS)} + 1] AS header FROM nation)
SELECT n_nationkey, array_to_string(header, '|') AS header, CASE WHEN header = ['0', '1'] THEN 'default header'
  WHEN len(list_filter(header, lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]+\\.[0-9]'))) > 0 OR len(list_distinct(header)) < len(header) THEN 'mangled header'
  WHEN len(list_filter(header, lambda x: NOT regexp_full_match(x, '[\\x00-\\x7F]*'))) > 0 THEN 'header not ASCII' END AS reason,
  len(list_filter(header, lambda x: contains(x, 'Unnamed:'))) > 0 AS nameless FROM h""")
def gate_header_rules(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    headers = F.array(*(F.array(*map(F.lit, h)) for h in HEADERS))
    t = n.select("n_nationkey", F.get(headers, F.col("n_nationkey") % len(HEADERS)).alias("header"), F.lit(9).alias("n_rows"), F.lit(2).alias("n_cols"), F.lit(1).alias("header_depth"), F.lit(True).alias("ascii_data"))
    return G.first_reason(t).select("n_nationkey", F.array_join("header", "|").alias("header"), "reason", G.empty_header(F.col("header")).alias("nameless"))


SIZES_SQL = "SELECT lang, source, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2"


def page_sizes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT lang, source, docs, row_number() OVER (PARTITION BY lang ORDER BY docs DESC, first_doc)::INT AS size_rank FROM ({SIZES_SQL})")
def rank_by_size(spark, sf_dir):
    return G.ranked(page_sizes(spark, sf_dir), "lang", "docs", "first_doc").select("lang", "source", "docs", "size_rank")


@query(f"""SELECT lang, source, size_rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size_rank) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY docs DESC, first_doc)::INT AS size_rank FROM ({SIZES_SQL})) WHERE first_doc % 3 = 1) WHERE rn = 1""")
def first_survivor(spark, sf_dir):
    return G.first_survivor(page_sizes(spark, sf_dir), "lang", "docs", "first_doc", F.col("first_doc") % 3 == 1).select("lang", "source", "size_rank")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 2")
def explicit_pick(spark, sf_dir):
    tables = read(spark, sf_dir, "lineitem").withColumn("dom_idx", F.col("l_linenumber") - 1)
    return G.picked(tables, "dom_idx", 2).select("l_orderkey", "l_partkey")


# --- rules ------------------------------------------------------------------------------------------

PART_LONG_SQL = """SELECT p_partkey AS table_id, 1 AS row_idx, unnest([0, 1, 2, 3]) AS col_idx,
  unnest(CASE p_partkey % 4 WHEN 0 THEN ['Notes', 'name', 'Ref.', 'size'] WHEN 1 THEN ['name', 'Notes', 'brand', 'Ref'] WHEN 2 THEN ['name', 'brand', 'size', 'Note'] ELSE ['name', 'brand', 'type', 'size'] END) AS col_name,
  unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS raw FROM part"""


def part_long(spark, sf_dir) -> DataFrame:
    names = lambda *x: F.array(*map(F.lit, x))
    m = F.col("p_partkey") % 4
    header = F.when(m == 0, names("Notes", "name", "Ref.", "size")).when(m == 1, names("name", "Notes", "brand", "Ref")).when(m == 2, names("name", "brand", "size", "Note")).otherwise(names("name", "brand", "type", "size"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.lit(1).alias("row_idx"), F.posexplode(F.arrays_zip(header.alias("n"), F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("v"))).alias("col_idx", "c"))
    return rows.select("table_id", "row_idx", "col_idx", F.col("c.n").alias("col_name"), F.col("c.v").alias("raw"))


@query(f"""WITH c AS ({PART_LONG_SQL}), l AS (SELECT *, col_name IN ('', 'Notes', 'Reference', 'References', 'Ref', 'Ref.', 'Note', 'Remarks', 'Remarks/Notes', 'Remarks/Note', 'Remarks/Ref.', 'Reference/Note', 'No.') AS bl FROM c),
s AS (SELECT table_id, min(col_idx) FILTER (bl) AS f, max(col_idx) AS x FROM l GROUP BY 1)
SELECT table_id, col_idx, col_name FROM l JOIN s USING (table_id) WHERE NOT (bl AND coalesce(f = 0 OR f = x, false))""")
def rule_blacklist_columns(spark, sf_dir):
    c = part_long(spark, sf_dir)
    return U.drop_columns(c, U.blacklisted(c)).select("table_id", "col_idx", "col_name")


@query("""SELECT 'nation' AS table_id, n_nationkey AS row_idx FROM nation WHERE NOT (n_nationkey % 6 = 0 OR n_nationkey % 9 = 4)""")
def rule_header_and_divider_rows(spark, sf_dir):
    k = F.col("n_nationkey")
    value = lambda own, name: F.when(k % 6 == 0, name).when(k % 9 == 4, "Group").when(k % 7 == 3, None).otherwise(own)
    rows = read(spark, sf_dir, "nation").select(k, F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("name").alias("n"), value(F.col("n_name"), "name").alias("v")), F.struct(F.lit(1).alias("i"), F.lit("region").alias("n"), value(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "region").alias("v")))).alias("c"))
    cells = rows.select(F.lit("nation").alias("table_id"), k.alias("row_idx"), F.col("c.i").alias("col_idx"), F.col("c.n").alias("col_name"), F.col("c.v").alias("raw"))
    return U.drop_rows(cells, U.noise_rows(cells)).select("table_id", "row_idx").distinct()


@query(r"""WITH d AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' [1] (x)' WHEN 1 THEN ' (NOR) (b)' WHEN 2 THEN ' [a] mid [2] end' ELSE '' END AS raw FROM part),
p AS (SELECT p_partkey, raw, CASE WHEN regexp_matches(raw, '\(.+\)') THEN trim(regexp_replace(raw, '\(.+?\)', '', 'g')) ELSE raw END AS a FROM d)
SELECT p_partkey, CASE WHEN regexp_matches(a, '\[.+?\]') THEN trim(regexp_replace(a, '\[.+\]', '', 'g')) ELSE a END AS cleaned, trim(regexp_replace(trim(raw), '\[.*?\]', '', 'g')) AS header FROM p""")
def rule_brackets(spark, sf_dir):
    m = F.col("p_partkey") % 4
    raw = F.concat("p_name", F.when(m == 0, " [1] (x)").when(m == 1, " (NOR) (b)").when(m == 2, " [a] mid [2] end").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", U.without_brackets(U.without_parentheses(raw)).alias("cleaned"), U.header_text(raw).alias("header"))


MIXED_SQL = "SELECT o_custkey AS table_id, CASE WHEN o_orderkey % 4 = 0 THEN 'about ' || o_orderstatus WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS raw, o_orderkey % 4 = 0 AS txt FROM orders"


def mixed_cells(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("about "), F.col("o_orderstatus"))).when(k % 9 == 0, None).otherwise(k.cast("string"))
    return U.clean(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), k.alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("value").alias("col_name"), raw.alias("raw")))


@query(f"""WITH s AS (SELECT table_id, count(*) FILTER (raw IS NOT NULL AND NOT txt) AS numbers, count(*) FILTER (txt) AS texts FROM ({MIXED_SQL}) GROUP BY 1)
SELECT table_id, numbers, texts, least(numbers, texts) >= 3 AS by_count, coalesce(greatest(least(numbers, texts), 1)::DOUBLE / nullif(greatest(numbers, texts), 0) >= 0.5, false) AS by_share FROM s
WHERE least(numbers, texts) >= 3 OR coalesce(greatest(least(numbers, texts), 1)::DOUBLE / nullif(greatest(numbers, texts), 0) >= 0.5, false)""")
def rule_mixed_types(spark, sf_dir):
    c, pair = U.type_counts(mixed_cells(spark, sf_dir)), (F.col("numbers"), F.col("texts"))
    return c.select("table_id", *pair, U.is_mixed(*pair, "abs", 3).alias("by_count"), U.is_mixed(*pair, "percent", 0.5).alias("by_share")).where("by_count or by_share")


NULLS_SQL = "SELECT l_orderkey AS t, l_linenumber AS r, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS c FROM lineitem"


def null_cells(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")).alias("c"))
    return C.unpivot(li, "l_orderkey", "l_linenumber", ["a", "b", "c"])


@query(f"""SELECT t AS table_id, i::INT AS col_idx FROM (SELECT t, unnest([0, 1, 2]) AS i, unnest([a, b, c]) AS v FROM ({NULLS_SQL})) GROUP BY ALL HAVING count(*) FILTER (v IS NULL) > 0.4 * count(*)""")
def rule_column_nulls(spark, sf_dir):
    return U.null_columns(null_cells(spark, sf_dir))


@query(f"SELECT t AS table_id, r AS row_idx FROM ({NULLS_SQL}) GROUP BY ALL HAVING sum((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) > 0.5 * 3 * count(*)")
def rule_row_nulls(spark, sf_dir):
    return U.null_rows(null_cells(spark, sf_dir), "percent", 0.5)


@query("SELECT l_orderkey AS table_id, max(l_linenumber) + 1 AS row_idx FROM lineitem GROUP BY 1 HAVING l_orderkey % 2 = 0")
def rule_last_row(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    pair = lambda a, b: F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), a.alias("raw")), F.struct(F.lit(1).alias("col_idx"), b.alias("raw")))).alias("c")
    rows = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_idx"), pair(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")))
    last = li.groupBy(F.col("l_orderkey").alias("table_id")).agg((F.max("l_linenumber") + 1).alias("row_idx"), F.sum("l_quantity").cast("string").alias("q"))
    total = last.select("table_id", "row_idx", pair(F.when(F.col("table_id") % 2 == 0, "Total").otherwise("77"), F.col("q")))
    cells = U.clean(rows.unionByName(total).select("table_id", "row_idx", "c.col_idx", F.lit("x").alias("col_name"), "c.raw"))
    return U.aggregate_rows(cells)


@query("SELECT DISTINCT o_custkey AS table_id, CASE WHEN o_custkey % 3 = 0 THEN 'Unnamed: 0' ELSE 'Year' END AS col_name FROM orders")
def rule_year_column(spark, sf_dir):
    k = F.col("o_custkey")
    raw = F.concat(F.year("o_orderdate").cast("string"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "[n 1]").otherwise(""))
    cells = read(spark, sf_dir, "orders").select(k.alias("table_id"), F.col("o_orderkey").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Unnamed: 0").alias("col_name"), raw.alias("raw"))
    return U.name_years(cells).select("table_id", "col_name").distinct()


@query("""WITH g AS (SELECT o_custkey AS t, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey AS table_id, o_orderkey AS row_idx, col_name, num, txt FROM (
  SELECT o_custkey, o_orderkey, 'Order' AS col_name, o_orderkey::DOUBLE AS num, NULL AS txt FROM orders UNION ALL
  SELECT o_custkey, o_orderkey, 'Price', o_totalprice, NULL FROM orders UNION ALL
  SELECT o_custkey, o_orderkey, 'Placed', NULL, strftime(o_orderdate, '%d %b %Y') FROM orders)""")
def curate_tables(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    e = lambda i, n, v: F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), v.alias("raw"))
    price = F.format_string("%.2f", F.col("o_totalprice"))
    rows = o.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_idx"), F.explode(F.array(e(0, "Order[1]", F.concat(F.col("o_orderkey").cast("string"), F.lit(" (n)"))), e(1, "Price", F.concat(price, F.lit("[2]"))), e(2, "Placed", F.date_format("o_orderdate", "d MMM yyyy")), e(3, "Notes", F.lit("x")))).alias("c"))
    return U.curate(rows.select("table_id", "row_idx", "c.*")).select("table_id", "row_idx", "col_name", "v.num", "v.txt")


# --- values -----------------------------------------------------------------------------------------

TYPED_SQL = """SELECT event_id, CASE event_id % 12 WHEN 0 THEN '1,234' WHEN 1 THEN '1 234' WHEN 2 THEN '−' || event_id WHEN 3 THEN '"7"' WHEN 4 THEN '1e5' WHEN 5 THEN '5d'
  WHEN 6 THEN 'none' WHEN 7 THEN '12:30 h' WHEN 8 THEN 'a-b' WHEN 9 THEN event_type WHEN 10 THEN json_extract_string(props, '$.k') ELSE '7 May 2025' END AS raw FROM events"""


@query(rf"""WITH d AS ({TYPED_SQL}), s AS (SELECT *, trim(replace(translate(raw, '−–—', '---'), '"', '')) AS s FROM d), n AS (SELECT *, replace(replace(s, ',', ''), ' ', '') AS d FROM s)
SELECT event_id, CASE WHEN raw IS NULL OR raw IN ('—', '-', 'none', '–') THEN NULL WHEN regexp_matches(d, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(d, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float'
  WHEN s = '7 May 2025' THEN 'date' ELSE 'str' END AS kind,
  CASE WHEN raw = 'none' THEN NULL WHEN regexp_matches(d, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN d::DOUBLE END AS num,
  CASE WHEN raw = 'none' OR regexp_matches(d, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN NULL WHEN s = '7 May 2025' THEN '07 May 2025' ELSE s END AS txt FROM n""")
def typed_cast(spark, sf_dir):
    m = F.col("event_id") % 12
    fixed = {0: "1,234", 1: "1 234", 3: '"7"', 4: "1e5", 5: "5d", 6: "none", 7: "12:30 h", 8: "a-b", 11: "7 May 2025"}
    raw = F.when(m == 2, F.concat(F.lit("−"), F.col("event_id").cast("string"))).when(m == 9, F.col("event_type")).when(m == 10, F.get_json_object("props", "$.k"))
    for k, v in fixed.items():
        raw = raw.when(m == k, v)
    return read(spark, sf_dir, "events").select("event_id", V.typed(raw).alias("v")).select("event_id", "v.kind", "v.num", "v.txt")


PRINTS = [("%-d %b", "d MMM"), ("%-d/%-m/%Y", "d/M/yyyy"), ("%Y-%m-%d", "yyyy-MM-dd"), ("%b %-d %Y", "MMM d yyyy"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%B %Y", "MMMM yyyy"), ("%-d %B %Y", "d MMMM yyyy"), ("week %d", "'week' dd")]
_DUCK_FORMATS = [("^[0-9]{1,2} [A-Za-z]{3}$", "%d %b"), ("^[0-9]{1,2} [A-Za-z]+$", "%d %B"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%d/%m/%Y"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%Y-%m-%d"), ("^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}$", "%b %d %Y"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "%d-%m-%Y"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "%d %b %Y"), ("^[A-Za-z]{3} [0-9]{4}$", "%b %Y"), ("^[A-Za-z]+ [0-9]{4}$", "%B %Y"), ("^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", "%d %B %Y")]
_DUCK_CASE = lambda what: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(raw, '{s}') AND try_strptime(raw, '{f}') IS NOT NULL THEN {what(f)} END" for s, f in _DUCK_FORMATS) + ")"


@query(f"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % {len(PRINTS)} {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{d}')" for i, (d, _) in enumerate(PRINTS))} END AS raw FROM orders)
SELECT o_orderkey, raw, {_DUCK_CASE(lambda f: f"'{f}'")} AS format, {_DUCK_CASE(lambda f: f"strftime(strptime(raw, '{f}'), '{f}')")} AS canonical FROM d""")
def date_detect_canonical(spark, sf_dir):
    m = F.col("o_orderkey") % len(PRINTS)
    raw = F.lit(None).cast("string")
    for i, (_, p) in enumerate(PRINTS):
        raw = F.when(m == i, F.date_format("o_orderdate", p)).otherwise(raw)
    return read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), V.date_format_of(raw).alias("format"), V.canonical_date(raw).alias("canonical"))


KEYS_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' United States ' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL WHEN 3 THEN 'A & B-' || source ELSE regexp_extract(text, '^[^.\\n]*') END AS raw FROM documents"""


@query(f"WITH d AS ({KEYS_SQL}) SELECT doc_id, {nk_sql('raw')} AS key FROM d")
def normalize_key(spark, sf_dir):
    m = F.col("doc_id") % 6
    raw = F.when(m == 0, " United States ").when(m == 1, "N/A").when(m == 2, None).when(m == 3, F.concat(F.lit("A & B-"), F.col("source"))).otherwise(F.regexp_extract("text", r"^[^.\n]*", 0))
    return read(spark, sf_dir, "documents").select("doc_id", V.normalize_key(raw).alias("key"))


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '-' || p_size || '.5' WHEN 2 THEN p_brand ELSE 'nan' END AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN replace(raw, ',', '')::DOUBLE END AS num, CASE WHEN p_partkey % 4 = 2 THEN regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') WHEN p_partkey % 4 = 3 THEN '' END AS txt FROM d""")
def normalize_value(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5"))).when(k % 4 == 2, F.col("p_brand")).otherwise("nan")
    return read(spark, sf_dir, "part").select("p_partkey", V.normalize_value(raw).alias("v")).select("p_partkey", "v.num", "v.txt")


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS segment, 'w?title=P' || page_id || '&oldid=' || (page_id * 3) AS revision, 'P' || page_id AS title, 'k' || page_id AS key, (1990 + page_id % 30)::VARCHAR AS year FROM pages""")
def reference_parts(spark, sf_dir):
    i = F.col("page_id").cast("string")
    edit = F.concat(F.lit("w?title=P"), i, F.lit("&action=edit"))
    year = F.concat(((F.col("page_id") % 30) + 1990).cast("string"), F.lit(".0"))
    return read(spark, sf_dir, "pages").select("page_id", V.last_segment(F.col("url")).alias("segment"), V.revision_url(edit, F.col("page_id") * 3).alias("revision"), V.title_of(edit).alias("title"), V.quoted_key(F.concat(F.lit("Key: 'k"), i, F.lit("'"))).alias("key"), V.year_key(year).alias("year"))


# --- html -------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(x)), chr(10)) AS paragraphs FROM pages""")
def paragraph_extract(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(found, lambda x: F.trim(x)), "\n").alias("paragraphs"))


def region_pages(spark, sf_dir) -> DataFrame:
    """A page a region with one table of its nations: a caption column that spans all rows, hidden and styled text."""
    n = read(spark, sf_dir, "nation")
    by = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("n").cast("string"), F.lit(">all</td>"))).otherwise(""), F.lit("<td>"), x["n_name"], F.lit("<span style='display:none'>x</span></td><td>"), x["n_nationkey"].cast("string"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<div><p>intro</p><p>Nations</p><table class='wikitable sortable'><tr><th>Group</th><th>Name</th><th>Key</th></tr>"), F.array_join(F.transform("n", row), ""), F.lit("</table><table><tr><td>no</td></tr></table></div>"))
    return by.select(F.col("n_regionkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))


@query("""SELECT n_regionkey || '_0' AS table_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_idx, 'intro' || chr(10) || 'Nations' AS paragraph, 'Group|Name|Key' AS header, 'all|' || n_name || '|' || n_nationkey AS row FROM nation""")
def html_table_rows(spark, sf_dir):
    rows = html_tables.table_rows(region_pages(spark, sf_dir))
    return rows.select(F.concat_ws("_", F.col("page_id").cast("string"), F.col("dom_idx").cast("string")).alias("table_id"), "row_idx", "paragraph", F.array_join("header", "|").alias("header"), F.array_join("values", "|").alias("row"))


@query("""SELECT n_regionkey || '_0' AS table_id, count(*) AS n_rows, 3::BIGINT AS n_cols, 3 * count(*) AS filled FROM nation GROUP BY n_regionkey""")
def html_table_shapes(spark, sf_dir):
    return html_tables.tables(html_tables.table_rows(region_pages(spark, sf_dir))).select("table_id", "n_rows", "n_cols", "filled")


# --- history ----------------------------------------------------------------------------------------


@query("SELECT user_id, max(event_id) FILTER (ts = m) AS event_id, m AS ts FROM (SELECT user_id, event_id, ts, max(ts) FILTER (ts <= TIMESTAMP '2024-01-15') OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id, m")
def asof_latest(spark, sf_dir):
    return H.as_of(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.lit("2024-01-15").cast("timestamp"))


SNAP_SQL = """WITH o AS (SELECT o_custkey AS t, o_orderkey AS r, o_totalprice AS a, o_orderstatus AS b, nullif(o_orderpriority, '1-URGENT') AS c FROM orders),
n AS (SELECT t, r, CASE WHEN r % 50 = 7 THEN a + 1 ELSE a END AS a, CASE WHEN r % 70 = 3 THEN 'Z' ELSE b END AS b, c FROM o WHERE r % 90 <> 1),
d AS (SELECT o.t, o.r, CASE WHEN o.a IS DISTINCT FROM n.a THEN 0 WHEN o.b IS DISTINCT FROM n.b THEN 1 WHEN o.c IS DISTINCT FROM n.c THEN 2 END AS col FROM o JOIN n USING (t, r)),
f AS (SELECT t, min(r) FILTER (col IS NOT NULL) AS r, arg_min(col, r) FILTER (col IS NOT NULL) AS col FROM d GROUP BY t)
"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    old = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("r"), F.col("o_totalprice").alias("a"), F.col("o_orderstatus").alias("b"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("c"))
    r = F.col("r")
    new = old.where(r % 90 != 1).withColumns({"a": F.when(r % 50 == 7, F.col("a") + 1).otherwise(F.col("a")), "b": F.when(r % 70 == 3, "Z").otherwise(F.col("b"))})
    return old, new


@query(SNAP_SQL + "SELECT t, CASE WHEN r IS NULL THEN 'match' ELSE 'misMatchValues-' || (['a', 'b', 'c'])[col + 1] || '-' || r END AS status, r AS row, (['a', 'b', 'c'])[col + 1] AS \"column\" FROM f")
def snapshot_diff(spark, sf_dir):
    return H.snapshot_diff(*snapshots(spark, sf_dir), "t", "r", ["a", "b", "c"])


@query(SNAP_SQL + "SELECT t, CASE WHEN t % 11 = 0 THEN 'noOldPage' WHEN t % 7 = 0 THEN 'misMatchHeaders' WHEN r IS NULL THEN 'match' ELSE 'misMatchValues-' || (['a', 'b', 'c'])[col + 1] || '-' || r END AS status FROM f")
def consistency(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    heads = lambda df, last: df.select("t").distinct().withColumn("header", F.array(F.lit("a"), F.lit("b"), last))
    diff = H.snapshot_diff(old, new, "t", "r", ["a", "b", "c"])
    return H.consistency(heads(old, F.lit("c")).where("t % 11 <> 0"), heads(new, F.when(F.col("t") % 7 == 0, "x").otherwise("c")), diff, "t")


@query("SELECT user_id, left(min(ts)::VARCHAR, 10) AS first_changed, count(*) AS num_of_changes, floor(avg(value))::BIGINT AS popularity FROM events GROUP BY 1")
def page_details(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return H.article_details(e.select("user_id", "ts"), e.select("user_id", F.col("value").alias("views")), "user_id")


# --- profile ----------------------------------------------------------------------------------------


@query("""SELECT c_nationkey AS table_id, 'c_acctbal' AS col_name, max(c_acctbal)::DECIMAL(30,4)::VARCHAR AS max_value, min(c_acctbal)::DECIMAL(30,4)::VARCHAR AS min_value, count(DISTINCT c_acctbal) AS n_distinct FROM customer GROUP BY 1
UNION ALL SELECT c_nationkey, 'c_mktsegment', max(c_mktsegment), min(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer GROUP BY 1""")
def column_profile(spark, sf_dir):
    return P.profile(C.unpivot(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", ["c_acctbal", "c_mktsegment"]))


@query("""SELECT o_custkey AS table_id, 'o_orderkey' AS col_name, 'unique' AS label FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, 'p', CASE WHEN count(*) = count(DISTINCT coalesce(p, '~')) THEN 'unique' ELSE 'not-unique' END FROM (SELECT o_custkey, nullif(o_orderpriority, '2-HIGH') AS p FROM orders) GROUP BY 1""")
def column_uniqueness(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("2-HIGH")))
    return P.uniqueness(C.unpivot(o, "o_custkey", "o_orderkey", ["o_orderkey", "p"]))


@query("SELECT n_regionkey, n_name, place FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey * 7919) % 1009)::INT AS place FROM nation) WHERE place <= 3")
def seeded_sample(spark, sf_dir):
    return P.seeded(read(spark, sf_dir, "nation"), ["n_regionkey"], (F.col("n_nationkey") * 7919) % 1009, 3).select("n_regionkey", "n_name", "place")


# --- report -----------------------------------------------------------------------------------------


def _bins_query(name: str, measure: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    def cond(low, high, open_low):
        return f"x {'>' if open_low else '>='} {low}" + ("" if high == R.INF else f" AND x <= {high}")

    QUERIES[name] = lambda spark, sf_dir: R.binned(make(spark, sf_dir), measure, "x", "y")
    ORACLES[name] = f"WITH d AS MATERIALIZED ({sql}) " + " UNION ALL ".join(f"SELECT '{label}' AS label, count(y) AS n, round(coalesce(avg(y), 0.0), 4) AS mean, round(coalesce(stddev_pop(y), 0.0), 4) AS std FROM d WHERE {cond(a, b, o)}" for label, a, b, o in R.BINS[measure])


def _orders_of(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("y"))


_bins_query("cells_bins", "cells", lambda s, d: _orders_of(s, d).select((F.col("n") * 7).alias("x"), (F.col("y") / 1e6).alias("y")), "SELECT 7 * count(*) AS x, avg(o_totalprice) / 1e6 AS y FROM orders GROUP BY o_custkey")
_bins_query("rows_bins", "rows", lambda s, d: _orders_of(s, d).select((F.col("n") * 3).alias("x"), (F.col("y") / 1e6).alias("y")), "SELECT 3 * count(*) AS x, avg(o_totalprice) / 1e6 AS y FROM orders GROUP BY o_custkey")
_bins_query("columns_bins", "columns", lambda s, d: _orders_of(s, d).select(F.col("n").alias("x"), (F.col("y") / 1e6).alias("y")), "SELECT count(*) AS x, avg(o_totalprice) / 1e6 AS y FROM orders GROUP BY o_custkey")
_bins_query("popularity_bins", "popularity", lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.floor(F.sum("value")).cast("bigint").alias("x"), (F.avg("value") / 1000).alias("y")), "SELECT floor(sum(value))::BIGINT AS x, avg(value) / 1000 AS y FROM events GROUP BY user_id")


@query("""WITH c AS (SELECT least(value, 100.0) AS x FROM events WHERE value IS NOT NULL), s AS (SELECT min(x) AS lo, max(x) AS hi FROM c)
SELECT CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 10)), 9) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM c, s GROUP BY 1""")
def histogram_clip(spark, sf_dir):
    return R.histogram(read(spark, sf_dir, "events"), "value", 100.0)


# --- questions --------------------------------------------------------------------------------------


def _ask(name: str, biggest: bool) -> None:
    word, key = ("largest", "max_key") if biggest else ("smallest", "min_key")

    def run(spark, sf_dir):
        s = read(spark, sf_dir, "supplier")
        t = Q.triples(s, "s_nationkey", "s_name", "s_acctbal", (F.col("s_suppkey") * 7919) % 100003)
        text = Q.fill(Q.TEMPLATES["max_of" if biggest else "min_of"], a=F.col("keys")[0], b=F.col("keys")[1], c=F.col("keys")[2], key_column="s_name", column="s_acctbal")
        return t.select("s_nationkey", text.alias("question"), F.col(key).alias("answer"))

    QUERIES[name] = run
    pick = "arg_max(s_name, s_acctbal)" if biggest else "arg_min(s_name, s_acctbal)"
    ORACLES[name] = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7919) % 100003) AS p FROM supplier)
SELECT s_nationkey, 'Of ''' || max(s_name) FILTER (p = 1) || ''', ''' || max(s_name) FILTER (p = 2) || ''' and ''' || max(s_name) FILTER (p = 3) || ''', which ''s_name'' has the {word} ''s_acctbal''?' AS question, {pick} AS answer
FROM t WHERE p <= 3 GROUP BY 1 HAVING count(*) = 3"""


_ask("qa_triple_max", True)
_ask("qa_triple_min", False)


@query("""SELECT n_nationkey, 'About the table ''Nations'': In the row whose ''n_name'' is ''' || n_name || ''', what is ''n_regionkey''? Answer with the value only.' AS prompt,
  (CASE WHEN n_nationkey % 4 = 0 THEN 9 ELSE n_regionkey END = n_regionkey)::INT AS correct FROM nation""")
def qa_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    question = Q.fill(Q.TEMPLATES["value"], key_column="n_name", key=F.col("n_name"), column="n_regionkey")
    answer = F.when(F.col("n_nationkey") % 4 == 0, "9").otherwise(F.col("n_regionkey").cast("string"))
    right = V.same(V.typed(answer), V.number(F.col("n_regionkey"), "int"))
    return n.select("n_nationkey", Q.fill(Q.TEMPLATES["wrapper"], table_title="Nations", question=question).alias("prompt"), right.cast("int").alias("correct"))


def _extreme(name: str, column: str, f: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Q.extremes(read(spark, sf_dir, "part"), "p_brand", "p_name", "p_size").select("p_brand", column)
    ORACLES[name] = f"SELECT p_brand, list_sort(list(DISTINCT p_name)) AS {column} FROM (SELECT *, {f}(p_size) OVER (PARTITION BY p_brand) AS x FROM part) WHERE p_size = x GROUP BY 1"


_extreme("qa_max", "max_keys", "max")
_extreme("qa_min", "min_keys", "min")

ANSWERS_SQL = """WITH e AS (SELECT p_brand, list(DISTINCT p_name) AS hits FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS x FROM part) WHERE p_size = x GROUP BY 1),
a AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 5 = 0 THEN 'nobody' ELSE p_name END AS answer FROM part),
v AS (SELECT a.*, CASE WHEN NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = a.p_brand AND p.p_name = a.answer) THEN -1 WHEN list_contains(hits, answer) THEN 1 ELSE 0 END AS verdict FROM a JOIN e USING (p_brand))
"""


def qa_answers(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    hits = Q.extremes(part, "p_brand", "p_name", "p_size")
    answers = part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 5 == 0, "nobody").otherwise(F.col("p_name")).alias("answer")).join(hits, "p_brand")
    return Q.verdict(answers, part, "p_brand", "p_name", "answer", "max_keys")


@query(ANSWERS_SQL + "SELECT p_partkey, verdict::INT AS verdict FROM v")
def qa_verdicts(spark, sf_dir):
    return qa_answers(spark, sf_dir).select("p_partkey", "verdict")


@query(ANSWERS_SQL + "SELECT p_type, count(*) FILTER (verdict = 1) AS \"right\", count(*) FILTER (verdict = 0) AS wrong, count(*) FILTER (verdict = -1) AS unknown, count(*) AS asked FROM v GROUP BY 1")
def qa_outcomes(spark, sf_dir):
    return Q.outcomes(qa_answers(spark, sf_dir), "p_type")


@query("""SELECT r_regionkey, 'NoContext_m1_About the table ''' || r_name || ''' on u: Over the whole table, which ''n_name'' has the largest ''n_nationkey'' (' || keys || ')? Answer with the value only.' AS prompt_key
FROM region JOIN (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1) ON r_regionkey = n_regionkey""")
def prompt_build(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("keys"))
    r = read(spark, sf_dir, "region").join(keys, F.col("r_regionkey") == F.col("n_regionkey"))
    question = Q.fill(Q.TEMPLATES["max"], key_column="n_name", column="n_nationkey", provided_keys=Q.provided_keys(F.col("keys")))
    return r.select("r_regionkey", Q.prompt_key("m1", Q.fill(Q.TEMPLATES["context"], table_title=F.col("r_name"), url="u", question=question)).alias("prompt_key"))


@query("SELECT n_regionkey, array_to_string(list_transform(list(n_name ORDER BY n_nationkey), lambda x: '\"<' || x || '>\"'), '|') AS format FROM nation GROUP BY 1")
def response_format(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(Q.response_format(names).alias("format"))


# --- stores -----------------------------------------------------------------------------------------


@query("SELECT DISTINCT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND length(a.text) > 0)")
def cache_miss(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    prompts = c.select("conv_id", "turn", key(F.col("turn")).alias("prompt_key"))
    return S.misses(prompts, c.select(key(F.col("turn") - 1).alias("prompt_key"), F.col("text").alias("response"))).select("conv_id", "turn").distinct()


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def keep_last_upsert(spark, sf_dir):
    return S.keep_last(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 10 = 3""")
def upsert_records(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.upsert(o, o.where("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def existing_records(spark, sf_dir):
    return S.existing(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def delete_missing(spark, sf_dir):
    return S.delete(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k, event_type FROM events")
def json_roundtrip(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"), "event_type")
    text = e.select(F.to_json(F.struct("event_id", "p", "event_type")).alias("t"))
    return text.select(F.from_json("t", "event_id bigint, p struct<k: int>, event_type string").alias("r")).select("r.event_id", "r.p.k", "r.event_type")


@query("""SELECT c_custkey, 'object' AS name_type, CASE WHEN c_custkey % 2 = 0 THEN 'date' ELSE 'float64' END AS balance_type FROM customer""")
def map_overlay(spark, sf_dir):
    base = F.create_map(F.lit("name"), F.lit("object"), F.lit("balance"), F.lit("float64"))
    over = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("balance"), F.lit("date"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = read(spark, sf_dir, "customer").select("c_custkey", base.alias("b"), over.alias("o")).select("c_custkey", S.overlay("b", "o").alias("m"))
    return merged.select("c_custkey", F.col("m")["name"].alias("name_type"), F.col("m")["balance"].alias("balance_type"))


@query("""SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_idx, n_name || ';' || CASE WHEN n_nationkey % 7 = 1 THEN '?' ELSE n_nationkey::VARCHAR END AS row
FROM nation WHERE n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 9)""")
def delimited_parse(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    line = F.concat(F.lit('"'), F.col("n_name"), F.lit('"'), F.when(k % 7 == 1, "").otherwise(F.concat(F.lit("|"), k.cast("string"))), F.when(k == 9, "|extra|more").otherwise(""))
    by = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\n").alias("reply"), F.lit(2).alias("n"))
    return readers.reply_rows(by, "n_regionkey", "reply", "n").select("n_regionkey", "row_idx", F.array_join("values", ";", "?").alias("row"))


# --- whole stages -----------------------------------------------------------------------------------


def customer_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, columns): the customers of each nation as a table."""
    c = read(spark, sf_dir, "customer")
    names = ["c_name", "c_custkey", "c_mktsegment"]
    cells = C.unpivot(c, "c_nationkey", "c_custkey", names)
    tables = c.select(F.col("c_nationkey").alias("table_id")).distinct().withColumn("article", F.concat(F.lit("Customers of nation "), F.col("table_id").cast("string")))
    dtypes = F.array(*(F.struct(F.lit(n).alias("col_name"), F.lit(t).alias("dtype")) for n, t in zip(names, ("object", "int64", "object"))))
    return tables, cells, tables.select("table_id", F.explode(dtypes).alias("c")).select("table_id", "c.*")


def customer_responder(spark, sf_dir):
    """A model's replies as a table would hold them: titles, keys, and tables with lost, changed and short lines."""
    k = F.col("c_custkey")
    number = F.when(k % 5 == 1, k + 1_000_000).otherwise(k).cast("string")
    line = F.concat(F.lit('"'), F.col("c_name"), F.lit('"|'), number, F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("|"), F.when(k % 3 == 0, "X").otherwise(F.col("c_mktsegment")))))
    lines = read(spark, sf_dir, "customer").where(k % 7 != 0).groupBy(F.col("c_nationkey").cast("string").alias("nation"))
    replies = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("l")))), lambda s: s["l"]), "\n").alias("table"))

    def respond(prompts: DataFrame) -> DataFrame:
        p = prompts.withColumn("nation", F.regexp_extract("prompt", r"[cC]ustomers of nation (\d+)", 1))
        p = p.join(replies, "nation", "left")
        text = F.when(F.col("prompt").startswith("List "), F.col("table")).when(F.col("prompt").contains("which names the row"), "It is Key: 'c_name'").otherwise(F.concat(F.lit(" the customers of nation "), F.col("nation")))
        return p.select("prompt_key", text.alias("response"))

    return respond


GENERATED_SQL = """WITH t AS (SELECT c_nationkey AS table_id, count(*) AS rr, count(*) FILTER (c_custkey % 7 <> 0) AS fr, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 5 <> 1) AS m1,
  count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 11 <> 0) AS m2 FROM customer GROUP BY 1 HAVING count(*) FILTER (c_custkey % 7 <> 0) > 0),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (SELECT *, (fr + m1 + m2)::DOUBLE / (3 * rr) AS r, (fr + m1 + m2)::DOUBLE / (3 * fr) AS p, fr::DOUBLE / rr AS kr, (m1 + m2)::DOUBLE / (2 * fr) AS rel FROM t))
"""


@query(GENERATED_SQL + "SELECT table_id, 'the customers of nation ' || table_id AS title, 'c_name' AS key, rr AS rows, fr AS got_rows, round(kr, 4) AS key_recall, round(r, 4) AS recall, round(p, 4) AS precision, round(f1, 4) AS f1_score, round(rel, 4) AS relative_non_key_accuracy FROM f")
def generate_scores(spark, sf_dir):
    records, _ = T.generate(*customer_tables(spark, sf_dir), "m1", customer_responder(spark, sf_dir))
    return records.select("table_id", "title", "key", "rows", "got_rows", *(F.round(m, 4).alias(m) for m in ("key_recall", "recall", "precision", "f1_score", "relative_non_key_accuracy")))


@query(GENERATED_SQL + """SELECT table_id, col_name, dtype, round(hit::DOUBLE / rr, 4) AS recall, round(hit::DOUBLE / fr, 4) AS precision FROM (
  SELECT table_id, rr, fr, unnest(['c_name', 'c_custkey', 'c_mktsegment']) AS col_name, unnest(['object', 'int64', 'object']) AS dtype, unnest([fr, m1, m2]) AS hit FROM f)""")
def generate_columns(spark, sf_dir):
    _, scores = T.generate(*customer_tables(spark, sf_dir), "m1", customer_responder(spark, sf_dir))
    return scores.select("table_id", "col_name", "dtype", *(F.round(m, 4).alias(m) for m in ("recall", "precision")))


def supplier_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, columns): the suppliers of each nation as a table."""
    s = read(spark, sf_dir, "supplier")
    cells = C.unpivot(s, "s_nationkey", "s_suppkey", ["s_name", "s_suppkey"])
    t = F.col("table_id").cast("string")
    tables = s.select(F.col("s_nationkey").alias("table_id")).distinct().select("table_id", F.concat(F.lit("u"), t).alias("url"), F.concat(F.lit("Suppliers of nation "), t).alias("title"), F.lit("s_name").alias("key"))
    return tables, cells, tables.select("table_id", F.lit("s_suppkey").alias("col_name"), F.lit("int64").alias("dtype"))


def name_responder(prompts: DataFrame) -> DataFrame:
    """Answers with the last name in a prompt, or its number where a value is asked for; says in other words with the first name."""
    p = F.col("prompt")
    names = F.regexp_extract_all(p, F.lit(r"Supplier#[0-9]+"), F.lit(0))
    first, last = F.coalesce(F.get(names, F.lit(0)), F.lit("")), F.coalesce(F.get(names, F.size(names) - 1), F.lit("nobody"))
    number = F.regexp_extract(last, "([0-9]+)", 1).try_cast("bigint")
    value = F.when(number % 3 == 0, "0").otherwise(number.cast("string"))
    return prompts.select("prompt_key", F.when(p.contains("say in other words"), F.concat(F.lit("Tell me of '"), first, F.lit("'"))).when(p.contains("what is"), value).otherwise(last).alias("response"))


SUPPLIERS_SQL = """WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7919) % 100003, s_suppkey) AS p,
  max(s_suppkey) OVER (PARTITION BY s_nationkey) AS hi, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS lo FROM supplier)
"""


@query(SUPPLIERS_SQL + """SELECT 'u' || n AS "URL", name AS "Key", 's_suppkey' AS "Column", k::VARCHAR AS "Real Value", CASE WHEN k % 3 = 0 THEN '0' ELSE k::VARCHAR END AS "Response", (k % 3 <> 0 OR k = 0)::INT AS "Correct",
  'In the row whose ''s_name'' is ''' || name || ''', what is ''s_suppkey''?' AS "Prompt", 'Tell me of ''' || name || '''' AS "Rephrased_question", name AS "Rephased_response",
  CASE WHEN k % 3 = 0 THEN '0' ELSE k::VARCHAR END AS "Context Response", (k % 3 <> 0 OR k = 0)::INT AS "Context Correct" FROM s WHERE p = 1""")
def qa_export_single(spark, sf_dir):
    tables, cells, _ = supplier_tables(spark, sf_dir)
    return T.lookups(cells, tables, "m1", name_responder).select(writers.SINGLE)


def _comparison(name: str, largest: bool) -> None:
    def run(spark, sf_dir):
        tables, cells, columns = supplier_tables(spark, sf_dir)
        return T.comparisons(cells, tables, columns, "m1", name_responder, largest).select(writers.COMPARISON)

    word, pick = ("largest", "max") if largest else ("smallest", "min")
    QUERIES[name] = run
    ORACLES[name] = SUPPLIERS_SQL + f"""SELECT 'u' || n AS "URL", a || ', ' || b || ', ' || c AS "Key", 's_suppkey' AS "Column", c AS "Response", w AS "Actual Result", (c = w)::INT AS "Correct", (a = w)::INT AS "Rephrased Correct",
  'Of ''' || a || ''', ''' || b || ''' and ''' || c || ''', which ''s_name'' has the {word} ''s_suppkey''?' AS "Prompt", 'Tell me of ''' || a || '''' AS "Rephrased Question", a AS "Rephrased Response", c AS "Context Response", (c = w)::INT AS "Context Correct"
FROM (SELECT n, max(name) FILTER (p = 1) AS a, max(name) FILTER (p = 2) AS b, max(name) FILTER (p = 3) AS c, arg_{pick}(name, k) AS w FROM s WHERE p <= 3 GROUP BY n HAVING count(*) = 3)"""


_comparison("qa_export_max_comparison", True)
_comparison("qa_export_min_comparison", False)


def _extremes(name: str, largest: bool) -> None:
    def run(spark, sf_dir):
        tables, cells, columns = supplier_tables(spark, sf_dir)
        return T.extremes(cells, tables, columns, "m1", name_responder, largest).select(writers.EXTREME)

    word, at = ("largest", "hi") if largest else ("smallest", "lo")
    QUERIES[name] = run
    ORACLES[name] = SUPPLIERS_SQL + f"""SELECT 'u' || n AS "URL", 's_name' AS "Key", 'nobody' AS "Response", w AS actual_result, -1 AS correct, 1 AS "Rephrased correct", (last = w)::INT AS "With keys",
  'Over the whole table, which ''s_name'' has the {word} ''s_suppkey'' ?' AS "Prompt", 'Tell me of ''' || w || '''' AS "Rephrased Question", w AS "Rephrased Response", 'nobody' AS "Context Response", -1 AS "Context Correct"
FROM (SELECT n, arg_max(name, k) AS last, max(name) FILTER (k = {at}) AS w FROM s GROUP BY n)"""


_extremes("qa_export_max", True)
_extremes("qa_export_min", False)


@query(SUPPLIERS_SQL + """SELECT 'single' AS family, count(*) AS asked, count(*) FILTER (k % 3 <> 0 OR k = 0) AS "right", count(*) FILTER (k % 3 = 0 AND k <> 0) AS wrong, 0::BIGINT AS unknown, 0::BIGINT AS rephrased_right, count(*) FILTER (k % 3 <> 0 OR k = 0) AS context_right, NULL::BIGINT AS with_keys_right FROM s WHERE p = 1
UNION ALL SELECT 'max', count(DISTINCT n), 0, 0, count(DISTINCT n), count(DISTINCT n), 0, count(DISTINCT n) FROM s
UNION ALL SELECT 'min', count(DISTINCT n), 0, 0, count(DISTINCT n), count(DISTINCT n), 0, count(*) FILTER (hi = lo) FROM s""")
def qa_tally(spark, sf_dir):
    tables, cells, columns = supplier_tables(spark, sf_dir)
    family = lambda name, df: df.withColumn("family", F.lit(name))
    most = lambda largest: T.tally(T.extremes(cells, tables, columns, "m1", name_responder, largest), "correct", "Rephrased correct", "Context Correct", "With keys")
    single = T.tally(T.lookups(cells, tables, "m1", name_responder), "Correct", "Rephrased correct", "Context Correct")
    return family("single", single).unionByName(family("max", most(True))).unionByName(family("min", most(False)))


def scored_records(spark, sf_dir) -> DataFrame:
    """A record an order: the types of its columns, its shape, its article's popularity; every ninth has no scores."""
    k = F.col("l_orderkey")
    m = lambda *kinds: F.create_map(*(F.lit(x) for i, t in enumerate(kinds) for x in (f"c{i}", t)))
    types = F.when(k % 4 == 0, m("object")).when(k % 4 == 1, m("object", "int64")).when(k % 4 == 2, m("int64", "float64", "object", "float64")).otherwise(m("int64", "float64"))
    by = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("views"), F.avg("l_discount").alias("d"))
    shape = F.struct((F.col("n") * 7).alias("rows"), F.size(types).alias("cols"))
    return by.select(F.concat(F.lit("A"), k.cast("string")).alias("article"), F.concat(F.lit("u"), k.cast("string")).alias("url"), m("date").alias("dates"), types.alias("columns"), shape.alias("shape"), F.col("views").alias("popularity"), F.when(k % 9 != 0, F.col("d") * 8).alias("f1_score"))


RECORDS_SQL = """SELECT 'A' || l_orderkey AS article, 'u' || l_orderkey AS url, 7 * count(*) AS rows, [1, 2, 4, 2][l_orderkey % 4 + 1]::BIGINT AS columns, 7 * count(*) * [1, 2, 4, 2][l_orderkey % 4 + 1] AS cells,
  [0.0, 0.5, 0.75, 1.0][l_orderkey % 4 + 1]::DOUBLE AS numeric_ratio, sum(l_suppkey)::BIGINT AS popularity, avg(l_discount) * 8 AS f1_score FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY l_orderkey"""


@query(f"SELECT article, url, rows, columns, cells, numeric_ratio, popularity, round(f1_score, 4) AS f1_score FROM ({RECORDS_SQL})")
def raw_metrics(spark, sf_dir):
    return T.raw_metrics(scored_records(spark, sf_dir)).drop("dates").withColumn("f1_score", F.round("f1_score", 4))


_bins_query("numeric_ratio_bins", "numeric_ratio", lambda s, d: T.raw_metrics(scored_records(s, d)).select(F.col("numeric_ratio").alias("x"), F.col("f1_score").alias("y")), f"SELECT numeric_ratio AS x, f1_score AS y FROM ({RECORDS_SQL})")

MEASURES = {"numeric_ratio": R.INF, "popularity": 300.0, "cells": 60.0, "rows": R.INF, "columns": R.INF}
_histogram_sql = lambda source, limit: f"WITH c AS (SELECT least(x::DOUBLE, {limit}) AS x FROM ({source}) WHERE x IS NOT NULL), s AS (SELECT min(x) AS lo, max(x) AS hi FROM c) SELECT CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 10)), 9) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM c, s GROUP BY 1"


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, * FROM ({_histogram_sql(f'SELECT {m} AS x FROM ({RECORDS_SQL})', 1e300 if limit == R.INF else limit)})" for m, limit in MEASURES.items()))
def measure_histograms(spark, sf_dir):
    rows = T.raw_metrics(scored_records(spark, sf_dir))
    each = [R.histogram(rows.select(F.col(m).cast("double").alias("x")), "x", limit).withColumn("measure", F.lit(m)) for m, limit in MEASURES.items()]
    return reduce(DataFrame.unionByName, each)


@query(_histogram_sql(f"SELECT f1_score AS x FROM ({RECORDS_SQL}) WHERE cells BETWEEN 20 AND 100", 1e300))
def first_bin_histogram(spark, sf_dir):
    return R.histogram(R.first_bin(T.raw_metrics(scored_records(spark, sf_dir)), "cells", "cells"), "f1_score", R.INF)


# --- smaller operators of the stages ----------------------------------------------------------------


@query("""SELECT o_custkey AS table_id, CASE WHEN o_custkey % 4 = 0 THEN 'mixed types' ELSE 'too many nulls' END AS reason, 'State' AS columns FROM orders WHERE o_custkey % 4 < 2 GROUP BY 1 HAVING count(*) >= 10""")
def curate_rejections(spark, sf_dir):
    """Every customer of ten orders: a column that mixes types, one of nulls, or neither."""
    from tabulon.config import Rules

    o, k = read(spark, sf_dir, "orders"), F.col("o_custkey")
    many = o.groupBy("o_custkey").count().where("count >= 10").select("o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.join(many, "o_custkey", "left_semi").withColumn("p", place)
    state = F.when((k % 4 == 0) & (F.col("p") <= 5), F.col("p").cast("string")).when((k % 4 == 1) & (F.col("p") % 2 == 1), "-").otherwise(F.concat(F.lit("is "), F.col("o_orderstatus")))
    e = lambda i, n, v: F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), v.alias("raw"))
    cells = rows.select(k.alias("table_id"), F.col("p").alias("row_idx"), F.explode(F.array(e(0, "Order", F.col("o_orderkey").cast("string")), e(1, "State", state), e(2, "By", F.concat(F.lit("c "), k.cast("string"))))).alias("c"))
    found = U.rejections(cells.select("table_id", "row_idx", "c.*"), Rules(drop_last_aggregate_row=False))
    return found.select("table_id", "reason", F.array_join("columns", ",").alias("columns"))


@query("SELECT o_custkey AS table_id, o_orderkey AS row_idx, 'Price' AS col_name, o_totalprice AS num FROM orders WHERE o_custkey % 3 <> 0")
def drop_bad_columns(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_custkey")
    cells = C.unpivot(o.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("Price")), "o_custkey", "o_orderkey", ["Price"])
    bad = o.where(k % 3 == 0).select(k.alias("table_id"), F.lit(0).alias("col_idx")).distinct()
    return U.drop_bad_columns(cells, bad).select("table_id", "row_idx", "col_name", "v.num")


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '∫' || p_brand || '∫' END AS header, p_partkey % 3 = 0 AS multi FROM part""")
def header_styles(spark, sf_dir):
    """Styled text goes from names but where it is all of the name; a header of two rows is a reason to reject."""
    from tabulon.config import Rules

    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.col("p_brand"), F.lit("∫note∫"))).otherwise(F.concat(F.lit("∫"), F.col("p_brand"), F.lit("∫")))
    kept = F.when(name.rlike("^∫.+∫$"), name).otherwise(U.header_text(name, Rules(strip_header_style=True)))
    t = read(spark, sf_dir, "part").select("p_partkey", kept.alias("header_name"), F.lit(9).alias("n_rows"), F.lit(2).alias("n_cols"), F.when(k % 3 == 0, 2).otherwise(1).alias("header_depth"), F.array(F.lit("a"), F.lit("b")).alias("header"), F.lit(True).alias("ascii_data"))
    return G.first_reason(t).select("p_partkey", F.col("header_name").alias("header"), F.coalesce(F.col("reason") == "multi-level header", F.lit(False)).alias("multi"))


@query("SELECT o_custkey AS table_id, 'd' AS col_name, CASE WHEN max(o_orderkey) % 2 = 0 THEN '%Y-%m-%d' ELSE '%d %b %Y' END AS format FROM orders GROUP BY 1")
def date_columns(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return U.dates_of(o.select(F.col("o_custkey").alias("table_id"), k.alias("row_idx"), F.lit("d").alias("col_name"), V.typed(raw).alias("v")))


@query("SELECT l_orderkey AS table_id, l_linenumber AS row_idx, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS place FROM lineitem WHERE l_linenumber % 2 = 0")
def row_places(spark, sf_dir):
    return U.row_places(read(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_idx")))


@query("SELECT user_id, min(left(ts::VARCHAR, 10)) AS first_changed, count(*)::INT AS num_of_changes, floor(avg(value))::INT AS popularity FROM events GROUP BY 1")
def attach_metadata(spark, sf_dir):
    """Records get their article's metadata as it is stored, decoded."""
    e = read(spark, sf_dir, "events")
    details = H.article_details(e.select("user_id", "ts"), e.select("user_id", F.col("value").alias("views")), "user_id")
    stored = details.select("user_id", F.to_json(F.struct("first_changed", "num_of_changes", "popularity")).alias("article_metadata"))
    return readers.article_metadata(e.select("user_id").distinct().join(stored, "user_id", "left")).select("user_id", "article_metadata.*")


@query(SNAP_SQL + "SELECT t FROM f WHERE r IS NULL")
def consistent_tables(spark, sf_dir):
    return H.consistent(H.snapshot_diff(*snapshots(spark, sf_dir), "t", "r", ["a", "b", "c"]), "t")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'brand,size' ELSE '' END AS shared FROM part""")
def known_columns(spark, sf_dir):
    k = F.col("p_partkey")
    names = lambda *x: F.array(*map(F.lit, x))
    columns = F.when(k % 3 == 0, names("name", "size", "Total")).when(k % 3 == 1, names("name", "brand", "size")).otherwise(names("name", "Total"))
    shared = Q.known_columns(columns, names("size", "brand", "name", "Total"), F.lit("name"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(shared), ",").alias("shared"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS places FROM lineitem GROUP BY 1")
def index_sets(spark, sf_dir):
    by = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber"))).alias("b"))
    return by.select("l_orderkey", F.array_join(Q.index_set(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("places"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 350")
def capped_tables(spark, sf_dir):
    return Q.capped(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")


@query("SELECT n_regionkey, n_name, place FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey * 7919) % 1009)::INT AS place, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) WHERE place <= least(n // 3, 5)")
def profile_sample(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("rows", F.count("*").over(Window.partitionBy("n_regionkey")))
    return P.seeded(n, ["n_regionkey"], (F.col("n_nationkey") * 7919) % 1009, P.sample_size(F.col("rows"))).select("n_regionkey", "n_name", "place")


@query("""SELECT i::BIGINT AS draw, chr((65 + k % 26)::INT) || chr((97 + (k // 26) % 26)::INT) AS prefix, (k * 31) % 9501 AS "offset" FROM (SELECT i, i * 7919 + 104729 AS k FROM range(1000) t(i))""")
def search_draws(spark, sf_dir):
    return readers.search_draws(spark)


@query("""SELECT o_custkey AS table_id, 'a' AS col_name, CASE WHEN o_custkey % 3 = 0 THEN 'int64' WHEN o_custkey % 3 = 1 THEN 'float64' ELSE 'object' END AS dtype FROM orders WHERE o_custkey % 3 <> 1 OR o_orderkey % 5 <> 0 GROUP BY o_custkey""")
def column_dtypes(spark, sf_dir):
    k, price = F.col("o_custkey"), F.format_string("%.2f", F.col("o_totalprice"))
    raw = F.when(k % 3 == 0, F.col("o_orderkey").cast("string")).when(k % 3 == 1, F.when(F.col("o_orderkey") % 5 != 0, price)).otherwise(F.concat(F.lit("x"), price))
    cells = read(spark, sf_dir, "orders").select(k.alias("table_id"), F.lit("a").alias("col_name"), raw.alias("raw"))
    some = cells.where("raw is not null").select("table_id").distinct()
    return readers.column_types(cells.join(some, "table_id", "left_semi"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' END AS provider FROM nation")
def provider_route(spark, sf_dir):
    models = ("gpt-4.1-2025-04-14", "gemini-2.5-pro", "other")
    who = F.array(*(F.lit(S.provider(m)).cast("string") for m in models))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.get(who, (F.col("n_nationkey") % 3).cast("int")).alias("provider"))
