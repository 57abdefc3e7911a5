"""HTML tables, dumps, delimited replies, exports and the answering stream."""

import json

from pyspark.sql import functions as F

from tabulon.sources import html_tables as T
from tabulon.sources import readers, writers
from tabulon.streaming.loop import answer_stream

PAGE = """<html><body><p>far</p><div>x</div><p>one</p><p>two <b>b</b></p>
<table class="infobox"><tr><td>no</td></tr></table>
<table class="wikitable sortable"><thead><tr><th>Name</th><th>Score</th><th>Score</th></tr></thead>
<tr><td rowspan=2>A</td><td colspan=2>1</td></tr><tr><td>2<span style="display:none">9</span></td><td><span style="color:red">3</span></td></tr>
<tr><td>B<table class="wikitable"><tr><td>in</td></tr></table></td><td>4<td>5</table></body></html>"""


def rows(spark, html):
    return T.table_rows(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).orderBy("dom_idx", "row_idx").collect()


def test_spans_headers_hidden_text_and_nesting(spark):
    got = rows(spark, PAGE)
    assert [r["values"] for r in got if r["dom_idx"] == 0] == [["A", "1", "1"], ["A", "2", "∫3∫"], ["B", "4", "5"]]
    assert got[0]["header"] == ["Name", "Score", "Score.1"] and got[0]["paragraph"] == "one\ntwo b"
    assert [(r["header"], r["values"]) for r in got if r["dom_idx"] == 1] == [(["0"], ["in"])]


def test_odd_pages(spark):
    assert rows(spark, "") == [] and rows(spark, None) == [] and rows(spark, "<p>no table") == []
    assert rows(spark, "<table class=wikitable></table>")[0]["row_idx"] is None


def test_cells_and_shapes(spark):
    r = T.table_rows(spark.createDataFrame([(1, "u", PAGE)], "page_id int, url string, html string"))
    assert T.cells(r).where("table_id = '1_0'").count() == 9
    assert T.tables(r).where("table_id = '1_0'").select("n_rows", "n_cols", "filled").first() == (3, 3, 9)


def test_dumps(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"query": {"pages": {"7": {"pageid": 7, "title": "T", "revisions": [{"revid": 3, "timestamp": "2024-01-02T03:04:05Z", "size": 9}]}}}}))
    got = readers.revisions(spark, str(tmp_path / "r.json")).first()
    assert (got["page_id"], got["revid"], got["ts"].year) == (7, 3, 2024)
    (tmp_path / "v.json").write_text(json.dumps({"items": [{"article": "T", "timestamp": "2024010100", "views": 5}]}))
    assert readers.page_views(spark, str(tmp_path / "v.json")).first()["views"] == 5
    (tmp_path / "s.json").write_text(json.dumps({"query": {"search": [{"title": "T", "pageid": 1}, {"title": "É", "pageid": 2}]}}))
    assert [r["page_id"] for r in readers.search_hits(spark, str(tmp_path / "s.json")).collect()] == [1]


def test_csv_tables_of_different_shape(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, "x", "1"), ("a", 0, 1, "y", 'q"u,o'), ("b", 0, 0, "z", None)], "table_id string, row_idx int, col_idx int, col_name string, raw string")
    writers.table_csvs(cells, str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    for name in "ab":
        text = "".join(p.read_text() for p in (tmp_path / "out" / f"table_id={name}").glob("*.txt"))
        (tmp_path / "in" / f"{name}.csv").write_text(text)
    back = readers.csv_cells(spark, str(tmp_path / "in"))
    assert sorted(tuple(r) for r in back.collect() if r["table_id"] == "a") == [("a", 0, 0, "x", "1"), ("a", 0, 1, "y", 'q"u,o')]


def test_short_lines_are_filled_and_long_ones_void_a_reply(spark):
    d = spark.createDataFrame([("a", '"x"|1\ny|"2"', 2), ("b", "x|1|z\ny", 2), ("c", "x", 2)], "k string, reply string, n int")
    got = readers.reply_rows(d, "k", "reply", "n").orderBy("k", "row_idx").collect()
    assert [(r["k"], r["values"]) for r in got] == [("a", ["x", "1"]), ("a", ["y", "2"]), ("c", ["x", None])]


def test_csv_keeps_line_breaks_and_quoted_names(spark, tmp_path):
    rows = [("a", 0, 0, "x,1", "one\ntwo"), ("a", 0, 1, 'y"q', "p" * 20000), ("a", 1, 0, "x,1", None), ("a", 1, 1, 'y"q', "3")]
    writers.table_csvs(spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, col_name string, raw string"), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("".join(p.read_text() for p in (tmp_path / "out" / "table_id=a").glob("*.txt")))
    back = readers.csv_cells(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert {(r["col_name"], r["dtype"]) for r in readers.column_types(back).collect()} == {("x,1", "object"), ('y"q', "object")}


def test_column_types(spark):
    rows = [("t", i, j, "abc"[j], v) for i, r in enumerate([("1", "1.5", "x"), ("-2", None, "3"), ("+3", "2", None)]) for j, v in enumerate(r)]
    got = readers.column_types(spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, col_name string, raw string")).collect()
    assert {r["col_name"]: r["dtype"] for r in got} == {"a": "int64", "b": "float64", "c": "object"}


def test_page_info_has_nulls_for_missing_pages(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"query": {"pages": {"7": {"pageid": 7, "title": "T", "editurl": "u?title=T&action=edit"}, "-1": {"title": "gone", "missing": ""}}}}))
    got = {r["page_id"]: (r["title"], r["edit_url"]) for r in readers.page_info(spark, str(tmp_path / "i.json")).collect()}
    assert got == {7: ("T", "u?title=T&action=edit"), -1: (None, None)}


def test_long_row_spans_reach_the_last_row(spark):
    html = "<table class=wikitable><tr><th>a<th>b</tr><tr><td rowspan=5000>x<td>0</tr>" + "".join(f"<tr><td>{i}</tr>" for i in range(1, 1500)) + "</table>"
    got = rows(spark, html)
    assert len(got) == 1500 and all(r["values"] == ["x", str(r["row_idx"])] for r in got)
    assert T.table_rows(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string"), "o'x").count() == 0


def test_upserted_records(spark, tmp_path):
    a = writers.as_record(spark.createDataFrame([("u1", 1), ("u2", 2)], "url string, n int"), "url")
    writers.save_records(a, None, str(tmp_path / "one"), ["key"])
    b = writers.as_record(spark.createDataFrame([("u2", 5)], "url string, n int"), "url")
    writers.save_records(b, str(tmp_path / "one"), str(tmp_path / "two"), ["key"])
    got = readers.records(spark, str(tmp_path / "two"), "url string, n int").select("key", "record.n").collect()
    assert sorted(tuple(r) for r in got) == [("u1", 1), ("u2", 5)]


def test_export_has_json_for_nested_values(spark, tmp_path):
    writers.export_csv(spark.range(1).select(F.array(F.lit(1)).alias("a"), F.lit("x").alias("b")), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).first() == ("[1]", "x")


def test_stream_answers_each_prompt_once(spark, tmp_path):
    spark.createDataFrame([("k1", "p"), ("k1", "p"), ("k2", "q")], "prompt_key string, prompt string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("prompt_key string, prompt string").parquet(str(tmp_path / "in"))
    running = answer_stream(stream, lambda text: text.upper(), str(tmp_path / "store"), str(tmp_path / "ckpt"), "1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    stored = lambda: sorted((r["prompt_key"], r["response"]) for r in spark.read.parquet(str(tmp_path / "store")).collect())
    assert stored() == [("k1", "P"), ("k2", "Q")]
    spark.createDataFrame([("k1", "other"), ("k3", "r")], "prompt_key string, prompt string").write.mode("append").parquet(str(tmp_path / "in"))
    running = answer_stream(stream, lambda text: text.upper(), str(tmp_path / "store"), str(tmp_path / "ckpt"), "1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert stored() == [("k1", "P"), ("k2", "Q"), ("k3", "R")]
