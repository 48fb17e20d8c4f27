"""Text expressions against plain Python, on awkward values."""

import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from studylens.functions import text as t


def evaluate(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, x STRING").coalesce(1)
    return [r.y for r in df.selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


def python_date(x):
    if x is None or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
        return None
    try:
        return datetime.date.fromisoformat(x)
    except ValueError:
        return None


VALUES = [
    None, "", " ", "\t\n", " ", " 　", "​", "a", " a", "!", "~", "\x7f", "é", " x", "0", "x" * 300,
    "2024-02-29", "2023-02-29", "2024-2-9", " 2024-02-09", "2024-02-09 ", "2024-02-09\n", "2024-02-09T", "2024", "+2024-02-9",
    "2024-13-01", "2024-00-10", "2024-01-1T", "2024-01-1 ", "20240101", "٢٠٢٤-٠١-٠١",
    "1", "-1.5", "+.5", "5.", ".", "1e3", "1E-3", "1e", "1d", "1f", "0x1p3", "NaN", "Infinity", " 1", "1 ", "1,5", "1_0", "--1",
]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        (t.null_or_blank("x"), lambda x: x is None or x.strip() == ""),
        (t.iso_date("x"), python_date),
        (
            t.decimal_number("x"),
            lambda x: float(x) if x is not None and re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", x) else None,
        ),
        (t.whole_number("x"), lambda x: int(x) if x is not None and re.fullmatch(r"[+-]?[0-9]+", x) else None),
        (t.outside("x", ["a", "1"]), lambda x: None if x is None else x not in ("a", "1")),
        (t.decimal_comma("x"), lambda x: None if x is None else x.replace(",", ".")),
    ],
)
def test_fixed_values(spark, expression, expected):
    assert evaluate(spark, expression, VALUES) == [expected(x) for x in VALUES]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0129-T: +.\t", min_size=8, max_size=11), min_size=30, max_size=60))
def test_dates(spark, values):
    assert evaluate(spark, t.iso_date("x"), values) == [python_date(x) for x in values]


@pytest.mark.parametrize("value", ["plain", "it's", 'dou"ble', "back\\slash", "\\'", "tab\t", "%s", "é"])
def test_quoted(spark, value):
    assert spark.range(1).selectExpr(f"{t.quoted(value)} AS v").first().v == value


def test_joined_is_null_with_any_null(spark):
    assert evaluate(spark, t.joined("x", "' > '", "'z'"), [None, "a"]) == [None, "a > z"]
