"""FIXTURES.md F1/F2 goldens on the 5-row sample table."""

from pyspark.sql import functions as F

from sample_table import SAMPLE_HEADER


def _mapping(spark, cols, name="sample"):
    from wideprep.operators.classify import classify_columns, header_catalogue

    return classify_columns(header_catalogue(spark, {name: cols}))


def test_profile(spark, sample):
    from wideprep.operators.profile import profile_columns, profile_table, suggested_keys

    t = profile_table(sample).first()
    assert (t.rows, t.columns, t.exact_duplicates, t.missing_cells, t.negative_values) == (5, 12, 1, 0, 2)
    assert t.health_score == 65
    cols = {r.column_name: r for r in profile_columns(sample).collect()}
    assert [c for c in SAMPLE_HEADER if cols[c].is_numeric] == ["JAN_2026", "FEB_2026", "MAR_2026"]
    assert [c for c in SAMPLE_HEADER if cols[c].is_date] == ["SHIP_DATE"]
    assert {c: r.negatives for c, r in cols.items() if r.negatives} == {"JAN_2026": 2}
    from wideprep.operators.classify import header_catalogue

    keys = suggested_keys(header_catalogue(spark, {"sample": list(SAMPLE_HEADER)})).orderBy("key_rank").collect()
    assert [r["source_column"] for r in keys] == ["COUNTRY_NAME", "ITEM_CODE", "SHIP_DATE"]


def test_duplicates(sample):
    from wideprep.operators.cleanup import duplicate_report, remove_duplicates

    assert duplicate_report(sample, []).count() == 2
    assert duplicate_report(sample, ["NOT_THERE"]).count() == 2
    first = sorted(r._row_id for r in remove_duplicates(sample, None, "Keep first").collect())
    last = sorted(r._row_id for r in remove_duplicates(sample, None, "Keep last").collect())
    assert first == [1, 2, 3, 4] and last == [1, 2, 3, 5]
    assert remove_duplicates(sample, None, "Delete all duplicates").count() == 3


def test_negatives(sample):
    from wideprep.operators.cleanup import apply_negative_action

    pos = apply_negative_action(sample, "JAN_2026", "Convert to positive")
    assert pos.agg(F.sum("JAN_2026")).first()[0] == 20938.0
    zero = apply_negative_action(sample, "JAN_2026", "Replace with zero")
    assert zero.agg(F.min("JAN_2026")).first()[0] == 0.0
    blank = apply_negative_action(sample, "JAN_2026", "Replace with blank")
    assert blank.where(F.col("JAN_2026").isNull()).count() == 2
    assert apply_negative_action(sample, "NOPE", "Convert to positive").columns == sample.columns


def test_classification(spark):
    m = {r.source_column: r for r in _mapping(spark, SAMPLE_HEADER).collect()}
    want = ["Country", "Region", "Channel", "City/State", "Category", "Brand", "SKU", "Fact"]
    for col, field in zip(SAMPLE_HEADER[:8], want):
        assert (m[col].target_field, m[col].confidence, m[col].method, m[col].user_confirmed) == (
            field, 1.0, "Rule/Dictionary", True)
    assert (m["SHIP_DATE"].target_field, m["SHIP_DATE"].confidence, m["SHIP_DATE"].method) == ("Ignore", 0.0, "AI review")
    for c in ("JAN_2026", "FEB_2026", "MAR_2026"):
        assert (m[c].target_field, m[c].method) == ("Time Period", "Time rule")


def test_time_patterns(spark):
    cols = ["WEEK_01", "week_12", "WEEK_01_2026", "2026_WK12", "W01-2026", "Q1_2026", "JAN_2026", "202601"]
    assert {r.target_field for r in _mapping(spark, cols).collect()} == {"Time Period"}
    m = {r.source_column: r for r in _mapping(spark, ["january 2026", "chanel", "qty", "p brand"]).collect()}
    assert m["january 2026"].target_field != "Time Period"
    assert (m["chanel"].target_field, m["chanel"].confidence) == ("Channel", 0.923)
    assert m["qty"].target_field == "Ignore"
    assert (m["p brand"].target_field, m["p brand"].confidence) == ("Brand", 0.95)


def test_standardize_quality_reconcile(spark, sample):
    from wideprep.operators.quality import quality_report, status_counts
    from wideprep.operators.reconcile import reconcile_groups, reconcile_total
    from wideprep.operators.standardize import standardize

    out = standardize(sample, _mapping(spark, SAMPLE_HEADER), dataset="sample")
    rows = out.orderBy("_row_id").collect()
    r1 = rows[0]
    assert (r1.record_id, r1.country, r1.region, r1.channel, r1.city_state, r1.category, r1.brand, r1.sku, r1.fact,
            r1.JAN_2026, r1.FEB_2026, r1.MAR_2026, r1.confidence, r1.status, r1.recommendation_source,
            r1.analyst_comment) == ("REC-0000001", "India", "North", "E-commerce", "Delhi", "Beverages", "Acme",
                                   "ACM-COLA-500", "Value", 12450.0, 13180.0, 12960.0, 100, "Approved",
                                   "Rules and Standards", "")
    assert [r.country for r in rows] == ["India"] * 5
    assert [r.channel for r in rows] == ["E-commerce", "E-commerce", "Modern Trade", "Traditional Trade",
                                         "Traditional Trade"]
    assert quality_report(out).count() == 0
    assert status_counts(out).first().approved == 5
    for m, total in (("JAN_2026", 20682.0), ("FEB_2026", 22361.0), ("MAR_2026", 22340.0)):
        s = reconcile_total(sample, out, m, m).first()
        assert (s.input_total, s.output_total, s.difference, s.match) == (total, total, 0.0, True)
    d = {(r.channel, r.brand): r for r in reconcile_groups(sample, out, "JAN_2026", "JAN_2026", ["channel", "brand"]).collect()}
    assert {k: v.input_total for k, v in d.items()} == {("E-commerce", "Acme"): 12570.0, ("Modern Trade", "Nova"): 8240.0,
                                                       ("Traditional Trade", "Purex"): -128.0}
    assert all(v.match for v in d.values())
    miss = reconcile_total(sample, out, "NOPE", "JAN_2026").first()
    assert (miss.input_total, miss.match) == (0.0, False)


def test_edits_and_audit(spark, sample):
    from wideprep.operators.audit import apply_edits, change_log, edit_log
    from wideprep.operators.standardize import standardize

    out = standardize(sample, _mapping(spark, SAMPLE_HEADER), dataset="sample").drop("_row_id")
    edits = spark.createDataFrame([("REC-0000002", "status", "Rejected"), ("REC-0000003", "brand", " Nova "),
                                   ("REC-0000004", "record_id", "X")], "record_id string, field string, value string")
    after = apply_edits(out, edits)
    assert after.where("status = 'Rejected'").count() == 1
    assert after.where("record_id = 'X'").count() == 0  # locked
    log = sorted((r.record_id, r.field, r.final_value) for r in change_log(out, after).collect())
    assert log == [("REC-0000002", "status", "Rejected")]  # ' Nova ' cleans to the same text
    assert sorted((r.record_id, r.field) for r in edit_log(out, edits).collect()) == [("REC-0000002", "status")]


def test_ordinal_dense(spark):
    from wideprep.operators.ordinal import with_ordinal

    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7919) % 1000)
    ids = [r._row_id for r in with_ordinal(df, ["k"]).orderBy("k").collect()]
    assert ids == list(range(1, 1001))
