"""Edits, overrides, output measures, renumbering and delivery read back."""

import os
import tempfile

import pytest


def _out(spark):
    return spark.createDataFrame([("R1", "a", 1.0, "Approved"), ("R2", "b", 2.0, "Incomplete")],
                                 "record_id string, city string, jan double, status string")


def test_edits_clear_order_and_reject(spark):
    from wideprep.operators.audit import apply_edits, edit_log, rejected_edits

    edits = spark.createDataFrame(
        [("R1", "city", "Z", 1), ("R1", "city", "B", 2), ("R2", "city", None, 1), ("R1", "jan", "abc", 1), ("R2", "jan", "7", 1),
         ("R1", "status", "Bogus", 1), ("R2", "status", "Rejected", 1), ("R1", "record_id", "X", 1), ("R1", "none", "X", 1)],
        "record_id string, field string, value string, edit_no int")
    got = sorted(tuple(r) for r in apply_edits(_out(spark), edits).collect())
    assert got == [("R1", "B", 1.0, "Approved"), ("R2", None, 7.0, "Rejected")]
    assert sorted((r["record_id"], r["field"]) for r in rejected_edits(_out(spark), edits).collect()) == [
        ("R1", "jan"), ("R1", "none"), ("R1", "record_id"), ("R1", "status")]
    assert {(r["record_id"], r["field"]) for r in edit_log(_out(spark), edits).collect()} >= {("R1", "city"), ("R2", "jan"), ("R2", "status")}


def test_locked_changes_statuses_and_appended_log(spark):
    from pyspark.sql import functions as F

    from wideprep.operators.audit import append_log, change_log, locked_changes, read_log, status_allowed

    before = _out(spark).withColumn("confidence", F.lit(90))
    after = before.withColumn("confidence", F.when(F.col("record_id") == "R1", 10).otherwise(90)).withColumn("city", F.lit("a"))
    assert [tuple(r) for r in locked_changes(before, after).collect()] == [("R1", "confidence", "90", "10")]
    assert after.filter(~status_allowed()).count() == 0
    path = os.path.join(tempfile.mkdtemp(prefix="wideprep-log-"), "log")
    log = change_log(before, after)
    for save in ("007", "8", "8", "007"):  # tried again, as after a failure
        append_log(log, path, save)
    found = read_log(spark, path)
    assert found.count() == 2 * log.count() == 4
    assert sorted({r["save_id"] for r in found.collect()}) == ["007", "8"]
    lost = log.withColumn("save_id", F.lit("save-9"))
    lost.write.mode("append").partitionBy("save_id").parquet(path + "/saves")  # a save that failed before its commit
    assert read_log(spark, path).count() == 4


def test_override_is_per_dataset_and_unique(spark):
    from wideprep.operators.classify import override_mapping

    mapping = spark.createDataFrame([("d1", 1, "text", "Ignore", 0.0, "m", False), ("d2", 1, "text", "Ignore", 0.0, "m", False)],
                                    "dataset string, col_ordinal int, source_column string, target_field string, "
                                    "confidence double, method string, user_confirmed boolean")
    schema = "dataset string, source_column string, target_field string, user_confirmed boolean"
    one = spark.createDataFrame([("d1", "text", "Brand", True)], schema)
    got = {r["dataset"]: r["target_field"] for r in override_mapping(mapping, one).collect()}
    assert got == {"d1": "Brand", "d2": "Ignore"}
    with pytest.raises(ValueError):
        override_mapping(mapping, one.unionAll(one))


def test_output_measures_read_plain_numbers_only(spark):
    from wideprep.operators.reconcile import output_measures

    df = spark.createDataFrame([("1d", "nan", "1.5", " 2 ", "1,000"), ("2f", "nan", "-3e2", "4", "2,000")],
                               "a string, b string, c string, d string, e string")
    assert output_measures(df) == ["c", "d"]


def test_renumbered_plan_is_dense_and_keeps_order(spark):
    from wideprep.operators.cleanup import CleanupPlan, apply_plan

    df = spark.createDataFrame([(i, None if i % 3 == 0 else str(i % 5), str(i)) for i in range(1, 31)], "_row_id long, k string, v string")
    out = apply_plan(df, CleanupPlan(duplicate_keys=["k"], duplicate_policy="first"), renumber=True)
    assert [(r["_row_id"], r["v"]) for r in out.orderBy("_row_id").collect()] == [(1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5"), (6, "8")]
    assert out.columns == ["_row_id", "k", "v"]


def test_bundle_reads_back(spark):
    from wideprep.operators.deliver import read_csv_member, size_gate, write_bundle

    path = tempfile.mkdtemp(prefix="wideprep-bundle-")
    df = spark.createDataFrame([("=1+1", '\tq"x', 1.5), (None, " padded ", -2.0)], "a string, b string, n double")
    assert write_bundle(path, {"standardized_output": df, "duplicate_report": None}, {"run_manifest": size_gate(df)}) == [
        "standardized_output", "run_manifest"]
    got = sorted(map(str, (tuple(r) for r in read_csv_member(spark, path + "/standardized_output").collect())))
    assert got == sorted(map(str, [("'=1+1", "'\tq\"x", "1.5"), (None, " padded ", "-2.0")]))
    assert spark.read.json(path + "/run_manifest").first()["rows_checked"] == 2


def test_empty_and_ordered_quality_report(spark):
    from wideprep.operators.quality import quality_report

    schema = ("_row_id long, record_id string, country string, region string, channel string, category string, brand string, "
              "sku string, fact string")
    rows = [(2, "REC-2", "", "", "x", "x", "x", "x", "x"), (1, "REC-1", "x", "", "x", "x", "-", "x", "x")]
    got = [tuple(r)[:2] for r in quality_report(spark.createDataFrame(rows, schema), ordered=True).collect()]
    assert got == [("REC-1", "Error"), ("REC-1", "Warning"), ("REC-2", "Error"), ("REC-2", "Warning")]
    assert quality_report(spark.createDataFrame([], schema)).count() == 0


def test_edits_to_numbers_are_read_strictly(spark):
    from wideprep.operators.audit import apply_edits, rejected_edits

    out = spark.createDataFrame([(f"R{i}", 1.0, 5) for i in range(9)], "record_id string, jan double, confidence int")
    values = ["5f", "1d", "NaN", "1,234.5", " 7 ", "1e400", None, "x", "-2e3"]
    edits = spark.createDataFrame([(f"R{i}", "jan", v) for i, v in enumerate(values)] + [
        ("R0", "confidence", "7.5"), ("R1", "confidence", "7d"), ("R2", "confidence", "1,000")], "record_id string, field string, value string")
    got = {r["record_id"]: (r["jan"], r["confidence"]) for r in apply_edits(out, edits, allow_locked=True).collect()}
    assert [got[f"R{i}"][0] for i in range(9)] == [1.0, 1.0, 1.0, 1234.5, 7.0, 1.0, None, 1.0, -2000.0]
    assert [got[f"R{i}"][1] for i in range(3)] == [5, 5, 1000]
    assert {(r["record_id"], r["field"]) for r in rejected_edits(out, edits, allow_locked=True).collect()} == {
        ("R0", "jan"), ("R1", "jan"), ("R2", "jan"), ("R5", "jan"), ("R7", "jan"), ("R0", "confidence"), ("R1", "confidence")}


def test_versions_meet_without_a_shuffle_and_log_records_on_one_side(spark):
    from wideprep.operators.audit import apply_edits, change_log, store_version

    rows = [(f"R{i}", f"city {i}", float(i), "Approved") for i in range(50)]
    first = store_version(spark.createDataFrame(rows, "record_id string, city string, jan double, status string"), buckets=4)
    edits = spark.createDataFrame([("R1", "city", "B"), ("R2", "jan", "9"), ("R3", "city", " city  3 ")], "record_id string, field string, value string")
    edited = apply_edits(first, edits).where("record_id <> 'R4'").unionByName(first.limit(1).selectExpr("'NEW' as record_id", "city", "jan", "status"))
    second = store_version(edited, buckets=4)
    log = change_log(first, second)
    assert sorted(map(tuple, log.collect()), key=str) == sorted([
        ("R1", "city", "city 1", "B"), ("R2", "jan", "2.0", "9.0"), ("R4", "(record)", "present", None), ("NEW", "(record)", None, "present")], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = change_log(first, second)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "FullOuter" in plan


def _members(spark, out):
    from wideprep.operators.deliver import MEMBERS

    return {name: out.withColumn("member", out.a) for name in MEMBERS}


def test_a_bundle_is_published_whole_or_not_at_all(spark):
    from wideprep.operators.deliver import BundleRefused, MEMBERS, publish_bundle, published_manifest, read_member

    path = os.path.join(tempfile.mkdtemp(prefix="wideprep-bundle-"), "b")
    out = spark.createDataFrame([(1, "=1+1", 'two\nlines "q"', 1.5), (2, None, " padded ", None)], "_row_id long, a string, b string, n double")
    fine = spark.createDataFrame([(True,), (True,)], "match boolean")
    wrong = spark.createDataFrame([(True,), (None,)], "match boolean")
    with pytest.raises(BundleRefused, match="reconcile"):
        publish_bundle(path, _members(spark, out), wrong)
    with pytest.raises(BundleRefused, match="duplicate_report"):
        publish_bundle(path, _members(spark, out) | {"duplicate_report": None}, fine)
    assert not os.path.exists(path)
    assert publish_bundle(path, _members(spark, out), fine, "upload.csv") == [*MEMBERS, "run_manifest"]
    got = read_member(spark, path, "standardized_output").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("'=1+1", 'two\nlines "q"', "1.5", "'=1+1"), (None, " padded ", None, None)], key=str)
    about = published_manifest(spark, path).first()
    assert about["rows"] == 2 and {m["member"]: m["rows"] for m in about["members"]} == {name: 2 for name in MEMBERS}
    publish_bundle(path, _members(spark, out.limit(1)), fine)
    assert published_manifest(spark, path).first()["rows"] == 1
    with pytest.raises(BundleRefused):
        publish_bundle(path, _members(spark, out), wrong)
    assert published_manifest(spark, path).first()["rows"] == 1


def test_plans_are_kept_reset_and_replayed(spark):
    from wideprep.operators.cleanup import CleanupPlan, apply_plan, load_plan, replay, save_plan

    path = os.path.join(tempfile.mkdtemp(prefix="wideprep-plans-"), "p")
    raw = spark.createDataFrame([(1, "a", "-1"), (2, "a", "2"), (3, "b", "x")], "_row_id long, k string, v string")
    plan = CleanupPlan(negatives={"v": "Convert to positive"}, duplicate_keys=["k"], duplicate_policy="Keep last", rename={"k": "key"})
    for version, p in ((1, plan), (2, None), (1, plan)):
        save_plan(spark, path, version, p)
    assert load_plan(spark, path, 1) == plan and load_plan(spark, path) is None
    assert replay(raw, spark, path).collect() == raw.collect()
    want = sorted(map(tuple, apply_plan(raw, plan).collect()))
    assert sorted(map(tuple, replay(raw, spark, path, 1).collect())) == want == [(2, "a", 2.0), (3, "b", None)]
    with pytest.raises(KeyError):
        load_plan(spark, path, 9)


def test_unknown_policies_and_actions_raise(spark):
    from wideprep.operators.cleanup import CleanupPlan, apply_plan, remove_duplicates

    df = spark.createDataFrame([(1, "a")], "_row_id long, k string")
    with pytest.raises(ValueError):
        remove_duplicates(df, ["k"], "Keep frist")
    with pytest.raises(ValueError):
        apply_plan(df, CleanupPlan(duplicate_policy="Keep frist"))
    with pytest.raises(ValueError):
        apply_plan(df, CleanupPlan(negatives={"k": "Convert"}))
