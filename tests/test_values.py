"""Cell values against expectations derived by hand, and against Python's own date parsing."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.config import DATE_FORMATS, Rules
from tabulon.functions import values as V


def one(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", make(F.col("t")).alias("v")).orderBy("i").collect()
    return [r[1] for r in rows]


TYPED = [
    ("1,234", ("int", 1234.0, None)), ("1 234", ("int", 1234.0, None)), ("−5", ("int", -5.0, None)), ("–5", ("int", -5.0, None)), ('"7"', ("int", 7.0, None)), ("1e5", ("float", 1e5, None)),
    ("5d", ("str", None, "5d")), ("1f", ("str", None, "1f")), ("nan", None), ("none", None), ("None", ("str", None, "None")), ("—", None), (" — ", ("str", None, "-")), ("", ("str", None, "")),
    ("12:30", ("str", None, "12:30")), ("a-b", ("str", None, "a-b")), ("7 May 2025", ("date", None, "07 May 2025")), ("7  May 2025", ("date", None, "07 May 2025")), ("May 7, 2025", ("str", None, "May 7, 2025")),
    ("31 Feb 2025", ("str", None, "31 Feb 2025")), ("1_000", ("int", 1000.0, None)), (".5", ("float", 0.5, None)), ("5.", ("float", 5.0, None)), ("inf", ("float", float("inf"), None)), (None, None),
]


def test_typed(spark):
    got = one(spark, [t for t, _ in TYPED], V.typed)
    assert [tuple(g) if g else None for g in got] == [w for _, w in TYPED]


def test_plain_numbers_skip_the_other_steps(spark):
    never = F.raise_error(F.lit("not plain")).cast("struct<kind: string, num: double, txt: string>")
    texts = ["0", "-7", "0012", "12.50", "-0.5", "9" * 30]
    got = one(spark, texts, lambda c: V.plain_number(c, never))
    assert [tuple(g) for g in got] == [("float" if "." in t else "int", float(t), None) for t in texts]
    odd = ["", "-", "+5", "5.", ".5", "1_0", "1e5", "5\n", " 5", "٣", "--5", "1.2.3", "5d", None]
    assert one(spark, odd, lambda c: V.plain_number(c, F.lit(None))) == [None] * len(odd)


def test_number_that_is_a_null_token_is_null(spark):
    got = one(spark, ["0", "00", "5"], lambda c: V.typed(c, ("0",)))
    assert [tuple(g) if g else None for g in got] == [None, ("int", 0.0, None), ("int", 5.0, None)]


def test_dates_agree_with_strptime(spark):
    texts = [datetime(2024, m, d).strftime(f) for f in DATE_FORMATS for m, d in ((1, 2), (5, 7), (9, 30), (12, 13))] + ["13/05/2025", "05/13/2025", "31/02/2025", "29 Feb", "week 7", "7 Sept 2025"]

    def python(text):
        for f in DATE_FORMATS:
            try:
                return f, datetime.strptime(text, f).strftime(f)
            except ValueError:
                continue
        return None, None

    want = [(None, None) if t == "29 Feb" else python(t) for t in texts]
    assert list(zip(one(spark, texts, V.date_format_of), one(spark, texts, V.canonical_date))) == want


def test_normalize_key(spark):
    pairs = {" United States ": "usa", "United Kingdom": "uk", "N/A": "", "--": "", "A & B": "aandb", "Émile Müller-Straße": "emilemullerstrasse", "X (2)": "x2", "": ""}
    assert one(spark, list(pairs), V.normalize_key) == list(pairs.values())
    assert one(spark, [None], V.normalize_key) == [""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aBé&- 1/nN", max_size=8), min_size=1, max_size=20))
def test_normalize_key_is_idempotent(spark, texts):
    once = one(spark, texts, V.normalize_key)
    assert one(spark, once, V.normalize_key) == once


@pytest.mark.parametrize(("ref", "got", "plain", "absolute"), [(10.0, 10.005, True, True), (10.0, 10.02, False, False), (0.0, 0.0, False, False), (-1.0, -1.0, False, True)])
def test_tolerance(spark, ref, got, plain, absolute):
    row = spark.range(1).select(V.within(F.lit(ref), F.lit(got)), V.within(F.lit(ref), F.lit(got), True)).first()
    assert tuple(row) == (plain, absolute)


def test_ascii(spark):
    assert one(spark, ["abc", "a∫b", "é", "—", "∫", "a—", "line\nbreak"], V.is_ascii) == [True, True, False, True, True, False, True]


def test_settings_from_yaml(tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text("min_rows: 3\nnull_tokens: [x, y]\n")
    assert Rules.from_yaml(str(path)).min_rows == 3 and Rules.from_yaml(str(path)).null_tokens == ("x", "y")
    path.write_text("minimum_table_size:\n  rows: 4\n  columns: 3\nnull_chars: ['-', '-', x]\nmaximum_mixed_types:\n  type: percent\n  value: 0.2\nspecial_chars:\n  link_char: 'x'\ncell_manipulations:\n  remove_data_inside_parentheses: false\n")
    got = Rules.from_yaml(str(path))
    assert (got.min_rows, got.min_columns, got.null_tokens, got.mixed_mode, got.mixed_value, got.strip_cell_parentheses) == (4, 3, ("-", "x"), "percent", 0.2, False)
    path.write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        Rules.from_yaml(str(path))
