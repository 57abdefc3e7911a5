"""Operators against worked examples."""

import pytest
from pyspark.sql import functions as F

from tabulon.config import Rules
from tabulon.operators import cells as C
from tabulon.operators import evaluate as E
from tabulon.operators import gates as G
from tabulon.operators import history as H
from tabulon.operators import questions as Q
from tabulon.operators import report as R
from tabulon.operators import rules as U
from tabulon.operators import store as S


def table(spark, rows, columns="k string, a double, b double"):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], f"table_id string, row_idx long, {columns}")


def scores(spark, fetched, ref, **options):
    m = E.column_matches(table(spark, fetched), table(spark, ref), "table_id", "row_idx", ["k"], ["k", "a", "b"], ["a", "b"], **options)
    return E.table_scores(m, "table_id", ["k"], ["k", "a", "b"]).first(), E.column_scores(m, "table_id", {"k": "object", "a": "int64", "b": "int64"}).collect()


REF = [("X", 1.0, 10.0), ("Y", 2.0, 20.0), ("Z", 3.0, 30.0)]


def test_worked_example(spark):
    s, c = scores(spark, [(" x ", 1.0, 10.005), ("Y", 2.0, 25.0), ("W", 9.0, 9.0)], REF)
    assert [round(s[m], 4) for m in ("recall", "precision", "f1_score", "key_recall", "key_f1_score", "non_key_recall", "non_key_f1_score", "relative_non_key_accuracy")] == [0.5556, 0.5556, 0.5556, 0.6667, 0.6667, 0.5, 0.5, 0.75]
    assert {r["col_name"]: round(r["f1_score"], 4) for r in c} == {"k": 0.6667, "a": 0.6667, "b": 0.3333}


def test_a_table_matches_itself(spark):
    s, _ = scores(spark, REF, REF)
    assert {s[m] for m in ("recall", "precision", "f1_score", "key_f1_score", "non_key_f1_score", "relative_non_key_accuracy")} == {1.0}


def test_no_common_key_keeps_the_table(spark):
    s, _ = scores(spark, [("q", 1.0, 1.0)], REF)
    assert s["f1_score"] == 0.0 and s["relative_non_key_accuracy"] is None


def test_duplicates_and_null_keys(spark):
    # the second raw X goes, " x" stays and counts again with the values of the first X, the null key goes
    s, _ = scores(spark, [("X", 1.0, 10.0), ("X", 5.0, 5.0), (" x", 7.0, 7.0), (None, 2.0, 20.0)], REF)
    assert s["key_precision"] == 1.0 and round(s["key_recall"], 4) == 0.6667 and s["precision"] == 1.0


def test_negative_reference_never_tolerant(spark):
    assert scores(spark, [("X", -1.0001, 0.0)], [("X", -1.0, 0.0)])[0]["non_key_recall"] == 0.5
    assert scores(spark, [("X", -1.0001, 0.0)], [("X", -1.0, 0.0)], absolute=True)[0]["non_key_recall"] == 1.0


def cells(spark, rows, header, name="t"):
    return spark.createDataFrame([(name, i, j, header[j], v) for i, r in enumerate(rows) for j, v in enumerate(r)], "table_id string, row_idx int, col_idx int, col_name string, raw string")


def grid(df):
    out = {}
    for r in df.collect():
        v = r["v"]
        out.setdefault(r["row_idx"], {})[r["col_name"]] = None if v is None else v["txt"] if v["num"] is None else v["num"]
    return [out[i] for i in sorted(out)]


def test_curate_follows_the_order_of_the_rules(spark):
    header = ["Unnamed: 0", "Name[1]", "Points", "Notes"]
    rows = [[str(1990 + i), f"P{i} (NOR)", str(i), "x"] for i in range(9)]
    rows += [header, ["same"] * 4, ["1999[a]", "Last", "—", "x"], ["Total", "all", "9", "x"]]
    got = grid(U.curate(cells(spark, rows, header)))
    # the name column stays nameless, as not all of its values are years: the table is rejected
    assert got == []
    rows = [r for r in rows if r[0].startswith("19")]
    got = grid(U.curate(cells(spark, rows, header)))
    # the last row goes: its last column (notes are gone by then) is empty under numbers only
    assert got[0] == {"Year": 1990.0, "Name": "P0", "Points": 0.0} and len(got) == 9 and got[-1] == {"Year": 1998.0, "Name": "P8", "Points": 8.0}


def test_curate_drops_the_total_and_noise(spark):
    header = ["Rank", "Name"]
    rows = [[str(i), f"P{i}"] for i in range(6)] + [header, ["g", "g"], ["Total", "6"]]
    got = grid(U.curate(cells(spark, rows, header)))
    assert [r["Rank"] for r in got] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize(("listed", "gone"), [(["Notes", "a", "Ref"], [0, 2]), (["a", "Notes", "b"], []), (["a", "Notes", "Ref"], []), (["a", "b", "Ref"], [2])])
def test_blacklist_needs_its_first_hit_at_an_edge(spark, listed, gone):
    assert sorted(r["col_idx"] for r in U.blacklisted(cells(spark, [["1"] * 3], listed)).collect()) == gone


def test_mixed_and_null_limits(spark):
    c = U.clean(cells(spark, [["1", None]] * 3 + [["x", None]] * 2 + [["2", "5"]] * 5, ["a", "b"]))
    assert U.mixed_columns(c).count() == 0 and U.mixed_columns(c, "abs", 2).count() == 1
    assert [r["col_idx"] for r in U.null_columns(c, "percent", 0.4).collect()] == [1]
    assert U.null_columns(c, "percent", 0.5).count() == 0
    assert U.null_rows(c, "percent", 0.5).count() == 0 and U.null_rows(c, "percent", 0.49).count() == 5


def test_brackets(spark):
    got = spark.createDataFrame([("a[1] b [2] c",), ("Emil (NOR)",), ("(x)",), ("plain",)], "t string").select(U.without_brackets(F.col("t")), U.without_parentheses(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a c", "a[1] b [2] c"), ("Emil (NOR)", "Emil"), ("(x)", ""), ("plain", "plain")]


def test_gates_name_the_first_reason(spark):
    rows = [(7, 2, 1, ["a", "b"]), (8, 2, 2, ["0", "1"]), (8, 2, 1, ["0", "1"]), (8, 2, 1, ["a", "a"]), (8, 2, 1, ["é", "b"]), (8, 2, 1, ["a", "b"])]
    t = spark.createDataFrame([(*r, i != 5) for i, r in enumerate(rows)], "n_rows int, n_cols int, header_depth int, header array<string>, ascii_data boolean")
    assert [r["reason"] for r in G.first_reason(t, Rules()).collect()] == ["size", "multi-level header", "default header", "mangled header", "header not ASCII", "data not ASCII"]


def test_as_of(spark):
    r = spark.createDataFrame([(1, 10, "2024-01-01"), (1, 11, "2024-01-03"), (2, 20, "2024-02-01")], "p int, rev int, d string").withColumn("ts", F.to_timestamp("d"))
    got = H.as_of(r, "p", "ts", "rev", F.to_timestamp(F.lit("2024-01-03"))).orderBy("p").collect()
    assert [(x["p"], x["rev"]) for x in got] == [(1, 11), (2, None)]


def test_snapshot_diff_ignores_tails(spark):
    old = table(spark, [("a", 1.0, 2.0), ("b", None, 2.0), ("c", 1.0, 1.0)])
    new = table(spark, [("a", 1.0, 2.0), ("b", None, 3.0)])
    assert H.snapshot_diff(old, new, "table_id", "row_idx", ["k", "a", "b"]).first()["status"] == "misMatchValues-b-1"


def test_bins_overlap_and_leave_gaps(spark):
    got = {r["label"]: r["n"] for r in R.binned(spark.createDataFrame([(1.0, 1.0), (0.5, 1.0), (0.0, 0.0)], "x double, y double"), "numeric_ratio", "x", "y").collect()}
    assert got == {"0.0": 1, "(0.0,0.67]": 1, "(0.67,1.0]": 1, "1.0": 1}
    got = {r["label"]: r["n"] for r in R.binned(spark.createDataFrame([(19.0, 1.0), (20.0, 1.0), (100.0, 1.0), (101.0, 1.0)], "x double, y double"), "cells", "x", "y").collect()}
    assert got["20-100"] == 2 and got["101-250"] == 1 and got["1001+"] == 0


def test_verdicts(spark):
    t = spark.createDataFrame([("t", "a", 1), ("t", "b", 3), ("t", "c", 3)], "t string, k string, v int")
    hits = Q.extremes(t, "t", "k", "v")
    answers = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "zz")], "t string, answer string").join(hits, "t")
    assert {r["answer"]: r["verdict"] for r in Q.verdict(answers, t, "t", "k", "answer", "max_keys").collect()} == {"a": 0, "b": 1, "zz": -1}


def test_cache_answers_only_misses(spark):
    prompts = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "p3")], "prompt_key string, prompt string")
    cache = spark.createDataFrame([("k1", "known"), ("k2", "")], "prompt_key string, response string")

    def model(text):
        if text == "p3":
            raise ValueError
        return text.upper()

    assert {r[0]: r[1] for r in S.answered(prompts, cache, model).collect()} == {"k1": "known", "k2": "P2"}


def test_pivot_returns_what_unpivot_took(spark):
    t = table(spark, [("x", 1.5, 2.0), ("y", None, 3.0)])
    back = C.pivot(C.unpivot(t, "table_id", "row_idx", ["k", "a"]), ["k", "a"]).orderBy("row_idx").collect()
    assert [(r["k"], r["a"]) for r in back] == [("x", "1.5"), ("y", None)]


def test_a_profile_of_large_numbers(spark):
    from tabulon.operators import profile as P

    got = P.profile(C.unpivot(table(spark, [("x", 1e30, 2.0), ("y", 1.0, 3.0)]), "table_id", "row_idx", ["a", "b"])).collect()
    assert {r["col_name"]: (r["max_value"], r["min_value"]) for r in got} == {"a": ("1.0E30", "1.0000"), "b": ("3.0000", "2.0000")}


def test_the_last_of_repeated_new_records_stays(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "key string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 9), ("c", 4)], "key string, v int").coalesce(1)
    assert sorted(map(tuple, S.upsert(old, new, ["key"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, S.upsert(old, new, ["key"], ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 9)]


def test_models_are_routed_by_name(spark):
    assert [S.provider(m) for m in ("gpt-4.1", "gemini-2.5-pro", "other")] == ["openai", "gemini", None]
    assert S.routed("gpt-x", {"openai": str.upper})("a") == "A" and S.routed("other", {"openai": str.upper})("a") is None


def test_rejections_name_the_rule_and_its_columns(spark):
    mixed = cells(spark, [[str(i), f"t{i}" if i % 2 else str(100 + i)] for i in range(9)], ["a", "b"], "mixed")
    nulls = cells(spark, [[str(i), "-" if i % 2 else "x"] for i in range(9)], ["a", "b"], "nulls")
    nameless = cells(spark, [["x", "y"]] * 2 + [["z", "w"]], ["Unnamed: 0", "b"], "nameless")
    good = cells(spark, [[str(i), f"t{i}"] for i in range(9)], ["a", "b"], "good")
    every = mixed.union(nulls).union(nameless).union(good)
    got = {r["table_id"]: (r["reason"], r["columns"]) for r in U.rejections(every).collect()}
    assert got == {"mixed": ("mixed types", ["b"]), "nulls": ("too many nulls", ["b"]), "nameless": ("nameless column", ["Unnamed: 0"])}
    assert {r["table_id"] for r in U.curate(every).select("table_id").distinct().collect()} == {"good"}


def test_a_whole_mean_is_not_cut_below_itself(spark):
    whole = [39.23, 8.09, 7.51, 145.17]
    rows = [("a", v) for v in whole] + [("b", -0.5), ("b", -1.0), ("c", None), ("d", 1e15), ("d", 2e18), ("e", 0.99999999999999), ("f", 2.0), ("f", None)]
    e = spark.createDataFrame(rows, "p string, views double").coalesce(1)
    got = H.article_details(e.select("p", F.lit("2024-01-01").alias("ts")), e, "p").collect()
    assert {r["p"]: r["popularity"] for r in got} == {"a": 50, "b": -1, "c": None, "d": 1000500000000000000, "e": 0, "f": 2}


def test_popularity_is_the_same_however_views_are_dealt(spark):
    views = spark.createDataFrame([(p, v) for p in range(50) for v in (39.23, 8.09, 7.51, 145.17)], "p int, views double")
    ts = views.select("p", F.lit("2024-01-01").alias("ts"))
    for order in ("views", "-views", "hash(views)", "hash(p, views)"):
        dealt = views.repartitionByRange(7, F.expr(order))
        assert {r["popularity"] for r in H.article_details(ts, dealt, "p").collect()} == {50}


def test_a_profile_counts_kinds_by_cells_and_sorts_none(spark):
    from tabulon.operators import profile as P

    rows = [("1",), ("1",), ("2",), ("x",), ("y",), (None,)]
    c = U.clean(cells(spark, rows, ["a"]).union(cells(spark, [("1",), ("x",), ("x",), ("b",)], ["b"])))
    df = P.profile(c)
    assert {r["col_name"]: (r["max_value"], r["min_value"], r["n_distinct"]) for r in df.collect()} == {"a": ("2.0000", "1.0000", 2), "b": ("x", "b", 2)}
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_curate_go_with_the_input(spark, tmp_path):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, n in (("small", 3_000), ("large", 300_000)):
        text = F.sha2(F.col("id").cast("string"), 256)
        spark.range(n).select((F.col("id") % 100).alias("table_id"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("a").alias("col_name"), text.alias("raw")).write.parquet(str(tmp_path / name))
    small, large = (spark.read.parquet(str(tmp_path / name)) for name in ("small", "large"))
    assert U._parts(small) == usual < U._parts(large) <= 16 * usual
    assert U._parts(cells(spark, [["1"]], ["a"]).rdd.toDF()) == usual  # a size that isn't known
    plan = U.curate(large)._jdf.queryExecution().executedPlan().toString()
    assert f", {U._parts(large)}), REPARTITION_BY_NUM" in plan and plan.count("Sort [") == 3
