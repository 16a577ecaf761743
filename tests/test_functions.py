"""Scalar expressions against their Python counterparts."""

import pytest
from pyspark.sql import functions as F


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clean_text_and_blank(spark):
    from wideprep.functions.text import clean_text, is_blank

    vals = [None, "  a  b ", "N/A", " na ", "-", "nan", "None", "x \ty", " ", "Namibia", "NA"]
    assert _eval(spark, vals, clean_text) == ["", "a b", "", "", "", "", "", "x y", "", "Namibia", ""]
    assert _eval(spark, vals, is_blank) == [True, False, True, True, True, True, True, False, True, False, True]


def test_title_matches_python(spark):
    from wideprep.functions.text import py_title

    vals = ["e-commerce 500ml o'neil", "MODERN TRADE", "brand#2", "nation_3 city 2", "hello  world", "ab1cd", "", "x"]
    assert _eval(spark, vals, py_title) == [v.title() for v in vals]


def test_sku_text(spark):
    from wideprep.functions.text import sku_text

    assert _eval(spark, ["small ring / 0", " acm-cola_500 ", None], sku_text) == ["SMALLRING0", "ACM-COLA_500", ""]


def test_number_readers(spark):
    from wideprep.functions.numbers import is_float_text, num_comma, num_filter

    vals = ["12,450", "-64", "$1,234", "(12)", "12%", "1e5", "1_000", "abc", None, " 7 ", "1e400", "-.5"]
    assert _eval(spark, vals, num_comma) == [12450.0, -64.0, None, None, None, 100000.0, None, None, None, 7.0,
                                             None, -0.5]
    assert _eval(spark, vals, num_filter) == [12450.0, -64.0, 1234.0, 12.0, 12.0, 15.0, 1000.0, None, None, 7.0,
                                              1400.0, -0.5]
    floats = ["-10.5", "+5", "-1e5", "-inf", "-5.", "-.5", "-1,200", "-1_000", "-5d", "-", "--5", "- 5", "nan"]
    expect = []
    for v in floats:
        try:
            float(v.replace(",", ""))
            expect.append(True)
        except ValueError:
            expect.append(False)
    assert _eval(spark, floats, is_float_text) == expect


def test_formula_guard_fixture(spark):
    """FIXTURES.md F3."""
    from wideprep.operators.deliver import sanitize

    text = ["=cmd|' /C calc'!A0", "@SUM(A1:A10)", "-payload", "+test", "\tattack", "Normal Text", "-10.5", "-5d",
            None]
    df = spark.createDataFrame([(t, n) for t, n in zip(text, [-12.5, 42.0, 100.0, -0.05, 0.0, 999.9, 1.0, 2.0, 3.0])],
                               "Text string, Numbers double")
    out = sanitize(df).collect()
    assert [r.Text for r in out] == ["'=cmd|' /C calc'!A0", "'@SUM(A1:A10)", "'-payload", "'+test", "'\tattack",
                                     "Normal Text", "-10.5", "'-5d", None]
    assert [r.Numbers for r in out][:2] == [-12.5, 42.0]


def test_dates_fixture(spark):
    """FIXTURES.md F1 dates, day first, ISO output."""
    from wideprep.functions.dates import standardize_date

    vals = ["01/01/2026", "20260101", "45658", "2026-03-01", "13/01/2026", "Delhi", None, "2026"]
    out = _eval(spark, vals, lambda c: standardize_date(c, "YYYY-MM-DD", True))
    assert out == ["2026-01-01", "2026-01-01", "2025-01-01", "2026-03-01", "2026-01-13", "Delhi", None, "1905-07-18"]
    assert _eval(spark, ["05/01/2026"], lambda c: standardize_date(c, "Long date", False)) == ["01 May 2026"]
    assert _eval(spark, ["05/01/2026"], lambda c: standardize_date(c, "Month text", True)) == ["Jan 2026"]


def test_redaction_fixture(spark):
    """FIXTURES.md F4."""
    from wideprep.functions.redact import redact

    msg = "Error 401: Unauthorized request with key super_secret_token_12345 and Bearer eyJhbGciOi..."
    out = _eval(spark, [msg, "api-key: abcdefgh123", "api_key=short"],
                lambda c: redact(c, secrets=("super_secret_token_12345",)))
    assert "super_secret_token_12345" not in out[0] and "[REDACTED_KEY]" in out[0] and "[REDACTED_TOKEN]" in out[0]
    assert out[1] == "api-key: [REDACTED_KEY]" and out[2] == "api_key=short"


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0]
        for j in range(1, len(b) + 1):
            cur.append(prev[j - 1] + 1 if ch == b[j - 1] else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("a,b", [("chanel", "channel"), ("itm code", "item code"), ("prd grp", "prod group"),
                                 ("brnd nm", "brand name"), ("c mktsegment", "segment"), ("", "x"), ("abc", "abc")])
def test_indel_ratio(spark, a, b):
    from wideprep.functions.similarity import fixed_text, indel_ratio

    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(indel_ratio(F.col("a"), fixed_text(b))).first()[0]
    want = 1.0 if not a and not b else 2.0 * _lcs(a, b) / (len(a) + len(b))
    assert abs(got - want) < 1e-12


def test_dates_by_shape(spark):
    """Spellings of one day, and near misses that are no date."""
    from wideprep.functions.dates import standardize_date

    same = ["05/01/26", "5-Jan-26", "05/01/2026 3:04 PM", "2026.01.05", "20260105 10:00", "2026-01-05T10:00:00Z",
            "2026-01-05 23:59:59.123+05:30", "5 January 2026", "Jan 5, 2026", "january 5 2026", "5.1.2026", "2026/1/5"]
    assert _eval(spark, same, lambda c: standardize_date(c, "YYYY-MM-DD", True)) == ["2026-01-05"] * len(same)
    assert _eval(spark, ["01/05/70", "5-Jan-69", "Feb 2026", "2026-02", "31/12/2026"], lambda c: standardize_date(c)) == [
        "1970-01-05", "1969-01-05", "2026-02-01", "2026-02-01", "2026-12-31"]
    other = ["2026-13-01", "32/13/2026", "5 Foo 2026", "Jan 26", "5 Jan 5 2026", "2026-01-05 25:00", "1/2-2026", "31/02/2026", "May", ""]
    assert _eval(spark, other, lambda c: standardize_date(c)) == other


def test_number_reader_over_array(spark):
    from wideprep.functions.numbers import num_comma, num_comma_array_sql

    vals = ["12,450", "-64", "$1,234", "1e400", "-inf", " 7 ", "1d", "nan", None, ""]
    cells = spark.createDataFrame([(vals,)], "x array<string>")
    assert cells.select(F.expr(num_comma_array_sql("x"))).first()[0] == _eval(spark, vals, num_comma)
