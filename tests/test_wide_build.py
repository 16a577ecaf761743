"""The wide table is built, and read, without steps that grow faster than its rows."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.text import _BLANK_RE, WS_CHARS, clean_text, collapse_ws, strip_ws
from wideprep.operators.ordinal import ROW_ID
from wideprep.session import COMPILED_METHOD
from wideprep.sources import fixtures as X


def driver_tables(spark, folder):
    day = datetime.datetime(1998, 1, 5)
    lines = [(o, 1, 1, n, 1.0, 10.0 * o + n, 0.0, 0.0, "R" if n == 2 else "N", "O", day) for o in (3, 1, 2) for n in (2, 1)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, " \
            "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    tables = {
        "lineitem": (lines, kinds), "orders": ([(1, 7), (2, 8), (3, 8)], "o_orderkey long, o_custkey long"),
        "customer": ([(7, 0, "AUTOMOBILE"), (8, 1, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "ALGERIA", 0), (1, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"),
        "part": ([(1, "red cup", "Brand#1", "TIN")], "p_partkey long, p_name string, p_brand string, p_type string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_narrow_rows_are_sorted_and_numbered_rows_are_wide(spark, tmp_path):
    folder = driver_tables(spark, tmp_path)
    narrow = X.joined_lines(spark, folder)
    assert not set(narrow.columns) & set(X.HEADERS)
    wide = X.shipments(spark, folder)
    assert wide.columns == [ROW_ID, *X.HEADERS]
    assert all(isinstance(f.dataType, T.StringType) for f in wide.schema.fields[1:])
    rows = wide.orderBy(ROW_ID).collect()
    assert [(r[ROW_ID], r["ORDER_NO"], r["LINE_NO"]) for r in rows] == [
        (1, "1", "1"), (2, "1", "2"), (3, "2", "1"), (4, "2", "2"), (5, "3", "1"), (6, "3", "2")]
    assert [r["JAN_1998"] for r in rows] == ["11.00", "-12.00", "21.00", "-22.00", "31.00", "-32.00"]
    assert all(r[c] is None for r in rows for c in X.PERIOD_COLUMNS if c != "JAN_1998")
    assert [r["COUNTRY_NAME"] for r in rows][::2] == ["IND", "usa", "usa"]


def test_wide_steps_run_in_methods_the_jvm_compiles(spark, tmp_path):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    X.shipments(spark, driver_tables(spark, tmp_path))
    assert int(spark.conf.get(limit)) == COMPILED_METHOD


def test_slice_sizes_looks_at_filled_cells_only(spark, monkeypatch):
    from wideprep.plans import queries as Q

    out = spark.createDataFrame([(1, "a", "x", 1.0, None), (2, "a", None, 2.0, None), (3, "b", "", 1.0, None)],
                                "_row_id long, country string, region string, JAN_1998 double, FEB_1998 double")
    monkeypatch.setattr(Q.P, "source", lambda *_: out)
    monkeypatch.setattr(Q.P, "output_stored", lambda *_: out)
    found = Q.slice_sizes(spark, "")
    assert "filter(" in found._jdf.queryExecution().optimizedPlan().toString().lower().split("generate")[-1]
    assert sorted(map(tuple, found.collect())) == [(1, "country", 2), (2, "region", 2), (3, "JAN_1998", 2), (4, "FEB_1998", 0)]
    monkeypatch.setattr(Q.P, "output_stored", lambda *_: out.where("false"))
    assert Q.slice_sizes(spark, "").collect() == []


def test_clean_cells_are_taken_as_they_are(spark):
    cells = [None, "", " ", "-", "na", "N/A", " n/a ", "none", "Nones", "nan  ", "plain", "two words", "two  words", " lead", "trail ", "trail\n",
             "a\tb", "tab\t", "é", "café au lait", " x", "x　y", "non e", "null\n", "a b c d", "-----", "x\x7f", "ends~", "!starts"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    before = F.coalesce(F.regexp_replace(collapse_ws(strip_ws("c")), _BLANK_RE, ""), F.lit(""))
    for r in df.select("c", clean_text("c").alias("now"), before.alias("before")).collect():
        assert r["now"] == r["before"], r
    blanks = {"", "nan", "none", "null", "n/a", "na", "-"}
    for c, now in df.select("c", clean_text("c")).collect():
        words = "" if c is None else c.strip(WS_CHARS)
        assert (now == "") == (words.lower() in blanks)
