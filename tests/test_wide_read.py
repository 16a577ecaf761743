"""Queries pay for the columns of the wide table that they read."""

import pytest
from pyspark.sql import functions as F

from test_wide_build import driver_tables
from wideprep.functions import text as X
from wideprep.functions.numbers import filled_cells
from wideprep.operators import reconcile as R
from wideprep.operators.ordinal import ROW_ID
from wideprep.plans import pipeline as P
from wideprep.plans import queries as Q
from wideprep.sources.fixtures import HEADERS


def stored_columns(df):
    files = df.inputFiles()
    return set(df.sparkSession.read.parquet(*files).columns)


def test_wide_rows_are_made_where_they_are_read(spark, tmp_path):
    wide = P.source(spark, driver_tables(spark, tmp_path))
    assert not stored_columns(wide) & set(HEADERS)
    assert wide.columns == [ROW_ID, *HEADERS]


def test_narrow_queries_store_no_periods(spark, tmp_path):
    folder = driver_tables(spark, tmp_path)
    counts = Q.status_counts(spark, folder)
    assert counts.first()["total_rows"] == 6
    assert stored_columns(counts) & set(HEADERS) == {P.MEASURE}
    whole = P.output_stored(spark, folder)
    narrow = P.output_narrow(spark, folder)
    assert sorted(narrow.collect()) == sorted(whole.select(*narrow.columns).collect())
    assert stored_columns(Q.delivery_manifest(spark, folder)).isdisjoint(HEADERS)
    assert Q.delivery_manifest(spark, folder).first()["columns"] == len(whole.columns) - 1


@pytest.mark.parametrize("rows", [[("a", None, "c"), (None, None, None), (None, "b", None)], []])
def test_filled_cells_are_found_by_place(spark, rows):
    df = spark.createDataFrame(rows, "x string, y string, z string").withColumn("k", F.concat_ws("", "x", "y", "z"))
    found = filled_cells(df, ["''", "x", "y", "z"], [F.col("k")])
    expected = [("".join(v or "" for v in r), i, v) for r in rows for i, v in enumerate(["", *r]) if v is not None]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no cell is met by an interpreted lambda


def test_no_wide_row_is_shuffled_to_find_its_group(spark):
    src = spark.createDataFrame([(1, "1", None), (2, None, "2"), (3, "4", "5"), (4, None, None)], "_row_id long, p string, q string")
    out = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", None, 2.0), (3, None, 4.0, 6.0)], "_row_id long, g string, p double, q double")
    found = R.reconcile_periods(src, out, ["p", "q"], groups=["g"])
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project [" in x and "_sid" in x]
    assert not any("p#" in x and "q#" in x and "get(" not in x and "_cells" not in x for x in joins)
    assert sorted((r["g"] or "", r["period"], r["input_total"], r["output_total"], r["match"]) for r in found.collect()) == [
        ("", "p", 4.0, 4.0, True), ("", "q", 5.0, 6.0, False), ("a", "p", 1.0, 1.0, True), ("a", "q", 2.0, 2.0, True)]


def test_plain_text_is_told_by_ascii_classes(spark):
    cells = ["", "plain", "two words", "UPPER case", "a1", "a1b", "1a", "x-y", "x - y", "o'neil", "brand#12", "é", "éa", "aé", "1é", "ab é", "ß x", "a\tb", "(a)", "a_b",
             "tin 5", "~a", "a~", "\x7fa", "a\n", "a\nb"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    plain, split = F.col("c").rlike(X._PLAIN), F.col("c").rlike(X._NEEDS_SPLIT)
    for r in df.select("c", plain.alias("plain"), split.alias("split"), X.py_title("c").alias("title")).collect():
        assert not (r["plain"] and r["split"]), r
        if r["c"].isascii():
            assert r["title"] == r["c"].title()
    assert not df.where(plain).isEmpty()
