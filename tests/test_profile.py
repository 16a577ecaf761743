"""Profile figures, duplicate rows and negative actions on small tables."""

from pyspark.sql import functions as F


def test_profile_of_a_dense_table(spark):
    from wideprep.operators.profile import profile_columns, profile_table

    rows = [(i, f"{-i if i % 2 else i}", "n/a" if i == 3 else "x", f"{i + 1:02d}/01/2026" if i else "?") for i in range(10)]
    df = spark.createDataFrame(rows + [(10, *rows[9][1:])], "_row_id long, amount string, note string, day_text string")
    got = {r["column_name"]: r.asDict() for r in profile_columns(df).collect()}
    assert got["amount"]["is_numeric"] and got["amount"]["negatives"] == 6 and got["amount"]["parsed"] == 11
    assert got["note"]["missing"] == 1 and not got["note"]["is_date"]
    assert got["day_text"]["is_date"]  # 10 of 11 cells, wherever the others stand
    table = profile_table(df).first().asDict()
    assert table == {"rows": 11, "columns": 3, "exact_duplicates": 1, "missing_cells": 1, "numeric_columns": 1,
                     "negative_values": 6, "date_columns": 1, "health_score": int(100 - (100 / 33 * 2 + 100 / 11 * 1.5 + 5))}


def test_profile_of_empty_tables(spark):
    from wideprep.operators.profile import profile_columns, profile_table

    df = spark.createDataFrame([], "_row_id long, a string, b double")
    assert [(r["column_name"], r["missing"], r["is_numeric"]) for r in profile_columns(df).orderBy("col_ordinal").collect()] == [
        ("a", 0, False), ("b", 0, False)]
    assert profile_table(df).first()["rows"] == 0
    assert profile_table(df.select("_row_id")).first()["columns"] == 0


def test_duplicate_rows_with_nulls_and_a_hot_key(spark):
    from wideprep.operators.cleanup import duplicate_report
    from wideprep.operators.profile import exact_duplicates

    rows = [(i, None if i % 3 == 0 else str(i), "v") for i in range(300)] + [(300, "v", None), (301, None, "v")]
    df = spark.createDataFrame(rows, "_row_id long, k string, v string")
    assert exact_duplicates(df).first()[0] == 100
    found = {r["_row_id"] for r in duplicate_report(df, ["k"]).collect()}
    assert found == {i for i, k, _ in rows if k is None}


def test_negative_actions(spark):
    from wideprep.operators.cleanup import apply_negative_actions

    df = spark.createDataFrame([("-1,000", "-2", -3.0, "-4", "t"), ("inf", "x", None, None, "u")],
                               "a string, b string, c double, d string, t string")
    out = apply_negative_actions(df, {"a": "abs", "b": "zero", "c": "null", "d": "none", "gone": "abs"})
    assert out.columns == df.columns and dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["t"] == "string"
    assert [tuple(r) for r in out.collect()] == [(1000.0, 0.0, None, -4.0, "t"), (float("inf"), None, None, None, "u")]
    assert out.filter(F.col("a") > 2000).count() == 1


def test_heavy_keys_are_split_by_their_counts(spark):
    from wideprep.operators.cleanup import duplicate_report, rows_with

    rows = [(i, None if i % 3 == 0 else f"k{i // 4}", i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "_row_id long, k string, _part int")
    counts = {}
    for _, k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    keys = spark.createDataFrame([(k, n) for k, n in counts.items() if n > 1], "_k0 string, _n long")
    for key_rows in (10, 10_000):
        met = rows_with(df, keys, [(F.col("k"), "_k0")], F.col("_row_id"), key_rows)
        assert met.columns == df.columns
        assert sorted(r["_row_id"] for r in met.collect()) == [i for i, k, _ in rows if counts[k] > 1]
    assert duplicate_report(df, ["k"]).count() == sum(n for n in counts.values() if n > 1)


def test_ids_are_stored_and_filters_on_them_pushed_down(spark):
    from wideprep.operators.ordinal import with_ordinal

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"), F.lit("x").alias("a`b"))
    out = with_ordinal(df, ["n"])
    assert [(r["_row_id"], r["n"]) for r in out.orderBy("_row_id").collect()] == [(i + 1, i) for i in range(1000)]
    plan = out.where("_row_id between 10 and 20")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_row_id), GreaterThanOrEqual(_row_id,10), LessThanOrEqual(_row_id,20)]" in plan and "Join" not in plan
    spans = out.groupBy(F.input_file_name()).agg(F.min("_row_id").alias("lo"), F.max("_row_id").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r["hi"] - r["lo"] + 1 == r["n"] for r in spans)


def test_samples_are_the_first_distinct_values(spark):
    from wideprep.operators.classify import unresolved_samples

    rows = [(i, ("  " if i < 3 else f"v{i // 4}"), "same", None) for i in range(100)]
    df = spark.createDataFrame(rows, "_row_id long, many string, one string, none string")
    mapping = spark.createDataFrame([("d", i, c, "Ignore", 0.0, "m", False) for i, c in enumerate(("many", "one", "none", "gone"))],
                                    "dataset string, col_ordinal int, source_column string, target_field string, confidence double, method string, user_confirmed boolean")
    got = sorted(map(tuple, unresolved_samples(df, mapping, "d").collect()))
    assert got == [("many", 1, "v0"), ("many", 2, "v1"), ("many", 3, "v2"), ("many", 4, "v3"), ("one", 1, "same")]


def test_period_totals(spark):
    from wideprep.operators.reconcile import reconcile_periods

    src = spark.createDataFrame([(1, "a", "1.5", "2"), (2, "b", None, "1,000"), (3, "b", "x", "inf")], "_row_id long, g string, p1 string, p2 string")
    out = spark.createDataFrame([(1, "a", 1.5, 2.0), (2, "b", None, 1000.0)], "_row_id long, g string, p1 double, p2 double")
    got = {(r["line"], r["g"], r["period"]): (r["input_total"], r["output_total"], r["match"]) for r in
           reconcile_periods(src, out, ["p1", "p2"], ["g"], totals=True).collect()}
    assert got[("cell", "b", "p2")] == (1000.0, 1000.0, True) and got[("cell", None, "p2")][0] == float("inf")
    assert got[("period total", None, "p1")] == (1.5, 1.5, True) and got[("group total", "a", None)] == (3.5, 3.5, True)
    assert got[("grand total", None, None)][0] == float("inf") and got[("grand total", None, None)][2] is False
