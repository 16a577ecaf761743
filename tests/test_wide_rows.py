"""Queries pay for the steps whose results they read: no sort, no number and no stored output where none is needed."""

from pyspark.sql import functions as F

from test_wide_build import driver_tables
from wideprep.functions import text as X
from wideprep.operators import ordinal as O
from wideprep.operators import quality as Q
from wideprep.operators.standardize import record_id
from wideprep.plans import pipeline as P
from wideprep.plans import queries
from wideprep.sources import fixtures


def refuse(*_, **__):
    raise AssertionError("stored")


AGGREGATES = ("reconcile_total", "reconcile_differences", "shipments_by_channel_brand", "profile_columns", "delivery_manifest")
READ_ONCE = ("quality_report", "quality_report_empty", "quality_preview", "reconcile_periods", "reconcile_slice_differences")


def test_steps_that_no_result_needs_are_left_out(spark, tmp_path, monkeypatch):
    folder = driver_tables(spark, tmp_path)

    def rows(name):
        return sorted(map(str, getattr(queries, name)(spark, folder).collect()))

    with monkeypatch.context() as m:
        m.setattr(P, "output_stored", refuse)
        with monkeypatch.context() as n:
            n.setattr(fixtures, "store_sorted", refuse)
            n.setattr(P, "output_narrow", refuse)
            found = {q: rows(q) for q in AGGREGATES}
        with monkeypatch.context() as n:
            n.setattr(P, "output_narrow", refuse)
            found |= {q: rows(q) for q in READ_ONCE}
        assert queries.apply_edits(spark, folder).count() == 6
        assert P.version(spark, folder).count() == 6
    P.output_stored(spark, folder)  # from now on, the numbered rows and the stored output are read
    assert {q: rows(q) for q in found} == found


def test_rows_are_numbered_where_they_are_read(spark, monkeypatch):
    df = spark.range(1000, numPartitions=5).select((F.col("id") * 7919 % 1000).alias("k"))
    stored = O.store_sorted(df, ["k"])
    monkeypatch.setattr(O, "new_table_path", refuse)  # nothing is written again
    rows = O.numbered(stored).orderBy("k").collect()
    assert [r["_row_id"] for r in rows] == [r["k"] + 1 for r in rows] == list(range(1, 1001))
    assert O.numbered(stored.where("false")).collect() == []
    scan = O.numbered(stored).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "_mid" not in scan  # a reader that leaves the ordinal out does not read it


def test_cheap_forms_agree_with_the_plain_ones(spark):
    cells = [None, "", " ", "-", "--", "-x", "n", "N/A", "n/a ", " nan", "Nones", "none\n", "x", "!", "\x7f", "é", "　", "　na", "null", "NULLS", "a b", "A-1_b", "a\n"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    plain = F.coalesce(X.strip_ws("c").rlike(X._BLANK_RE), F.lit(True))
    sku = F.upper(F.regexp_replace("c", r"[^A-Za-z0-9_\-]", ""))
    for r in df.select("c", plain.alias("p"), X.is_blank("c").alias("b"), sku.alias("s"), X.sku_form("c").alias("t")).collect():
        assert (r["p"], r["s"]) == (r["b"], r["t"]), r
    ids = spark.createDataFrame([(i,) for i in (None, -5, 0, 1, 9_999_999, 10_000_000, 1 << 40)], "i long")
    assert ids.where(~record_id(F.col("i")).eqNullSafe(F.format_string("REC-%07d", "i"))).isEmpty()


def test_records_that_lack_nothing_are_told_before_any_array(spark):
    dims = ["country", "region", "channel", "city_state", "category", "brand", "sku", "fact"]
    out = spark.createDataFrame([(1, "REC-1", *"abcdefgh"), (2, "REC-2", *"abcdefg", None), (3, "REC-3", "a", "n/a", *"cdefgh")],
                                "_row_id long, record_id string, " + ", ".join(f"{d} string" for d in dims))
    found = Q.quality_report(out)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    condition = next(x for x in plan.split("\n") if "Filter" in x)
    assert "ascii" in condition.split("filter(")[0]
    assert sorted((r["record_id"], r["field"]) for r in found.collect()) == [("REC-2", "Fact"), ("REC-3", "Region")]
