"""Large tables are built, stored and joined without whole-table shuffle files lying on disk."""

import os

import pytest
from pyspark.sql import functions as F

from test_wide_build import driver_tables
from wideprep.operators.ordinal import ROW_ID, numbered, store_sorted_slices
from wideprep.session import freed_shuffles
from wideprep.sources import fixtures as X


def test_slices_are_numbered_one_after_the_other(spark):
    kind = "k long, v string"
    slices = [spark.createDataFrame(rows, kind) for rows in ([(3, "c"), (1, "a"), (2, "b")], [], [(9, "e"), (7, "d")])]
    stored = store_sorted_slices(iter(slices), ["k"])
    assert sorted(map(tuple, numbered(stored).collect())) == [(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, 7, "d"), (5, 9, "e")]


@pytest.mark.parametrize("lines", [1, 2, 4, 100])
def test_the_wide_table_is_the_same_in_slices(spark, tmp_path, monkeypatch, lines):
    folder = driver_tables(spark, tmp_path)
    extra = spark.read.parquet(f"{folder}/lineitem.parquet").limit(1).withColumn("l_orderkey", F.lit(None).cast("long"))
    extra.write.mode("append").parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(X, "LINES_A_SLICE", lines)
    ranges = X.order_ranges(spark.read.parquet(f"{folder}/lineitem.parquet"))
    assert (len(ranges) > 1) == (lines < 7)
    rows = X.shipments(spark, folder).orderBy(ROW_ID).collect()
    assert [(r[ROW_ID], r["ORDER_NO"], r["LINE_NO"], r["JAN_1998"]) for r in rows] == [
        (1, "1", "1", "11.00"), (2, "1", "2", "-12.00"), (3, "2", "1", "21.00"), (4, "2", "2", "-22.00"), (5, "3", "1", "31.00"),
        (6, "3", "2", "-32.00")]


def shuffle_files(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_of_a_stored_table_go_with_its_action(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(name, None), shuffle_files(spark)
    with pytest.raises(KeyError), freed_shuffles(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "t"))
        raise KeyError
    assert spark.conf.get(name, None) == set_before
    assert not shuffle_files(spark) - before
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7


def test_the_log_of_two_saves_is_worked_out_once(spark, tmp_path, monkeypatch):
    from wideprep.operators import audit
    from wideprep.plans import queries as Q

    plans, append = [], audit.append_log

    def watched(log, path, save_id):
        plans.append(log._jdf.queryExecution().optimizedPlan().toString())
        append(log, path, save_id)

    monkeypatch.setattr(audit, "append_log", watched)
    folder = driver_tables(spark, tmp_path)
    saved = Q.appended_log(spark, folder)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    columns = ["record_id", "field", "original_value", "final_value"]
    assert sorted(saved.select(columns).collect()) == sorted(Q.audit_log(spark, folder).select(columns).collect())


@pytest.mark.parametrize("blocks", [0, 10])
@pytest.mark.parametrize("kept", [range(1, 3001), [1], [], [63, 64, 65, 1023, 1024, 1025, 2047, 2048, 2_999], range(7, 3001, 5)])
def test_kept_rows_are_numbered_anew(spark, kept, blocks):
    from wideprep.operators.ordinal import renumbered

    df = spark.range(1, 3001).select(F.concat(F.lit("r"), "id").alias("a"), F.col("id").alias(ROW_ID))
    found = renumbered(df, spark.createDataFrame([(i,) for i in kept], f"{ROW_ID} long"), blocks=blocks)
    assert found.columns == [ROW_ID, "a"] and dict(found.dtypes)[ROW_ID] == "bigint"
    assert sorted(map(tuple, found.collect())) == [(n, f"r{i}") for n, i in enumerate(kept, 1)]


def test_far_ordinals_are_numbered_anew(spark):
    from wideprep.operators.ordinal import renumbered

    ids = [1, 2**20 - 1, 2**20, 2**20 + 1, 5 * 2**20 + 77, 2**40 + 63]
    df = spark.createDataFrame([(i, str(i)) for i in [*ids, 3, 2**41]], f"{ROW_ID} long, a string")
    kept = spark.createDataFrame([(i,) for i in reversed(ids)], f"{ROW_ID} long")
    assert sorted(map(tuple, renumbered(df, kept).collect())) == [(n, str(i)) for n, i in enumerate(ids, 1)]


def test_a_plan_shuffles_no_wide_row(spark):
    from wideprep.operators.cleanup import CleanupPlan, apply_plan

    raw = spark.createDataFrame([(1, "a", "-1"), (2, "a", "2"), (3, "b", "x"), (4, None, "4"), (5, None, "5")], f"{ROW_ID} long, k string, v string")
    plan = CleanupPlan(negatives={"v": "Convert to positive"}, duplicate_keys=["k"], duplicate_policy="Keep last", rename={"k": "key"})
    out = apply_plan(raw, plan, renumber=True)
    assert sorted(map(tuple, out.collect())) == [(1, "a", 2.0), (2, "b", None), (3, None, 5.0)]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_changed_cells_are_found_by_place(spark):
    from wideprep.operators.audit import change_log, edit_log

    kind = "record_id string, city string, jan double, n int"
    before = spark.createDataFrame([("R1", "a", 1.0, 1), ("R2", None, None, 2), ("R3", " x", 3.0, 3), ("R4", "d", 4.0, 4)], kind)
    after = spark.createDataFrame([("R1", "b", None, 1), ("R2", "c", 0.5, 2), ("R3", "x ", 3.0, 3), ("R5", "d", 4.0, 4)], kind)
    log = change_log(before, after)
    assert sorted(map(tuple, log.collect()), key=str) == sorted([
        ("R1", "city", "a", "b"), ("R1", "jan", "1.0", None), ("R2", "city", None, "c"), ("R2", "jan", None, "0.5"),
        ("R4", "(record)", "present", None), ("R5", "(record)", None, "present")], key=str)
    edits = spark.createDataFrame([("R1", "city", "z"), ("R1", "jan", "1"), ("R2", "city", "q"), ("R3", "city", "x")],
                                  "record_id string, field string, value string")
    edited = edit_log(before, edits)
    assert sorted(map(tuple, edited.collect()), key=str) == sorted([("R1", "city", "a", "z"), ("R2", "city", None, "q")], key=str)
    for found in (log, edited):  # no cell is met by an interpreted lambda
        assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_members_of_a_bundle_are_compressed(spark, tmp_path):
    from wideprep.operators.deliver import MEMBERS, publish_bundle, read_member

    out = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("the same words").alias("member"))
    publish_bundle(str(tmp_path), dict.fromkeys(MEMBERS, out), spark.createDataFrame([(True,)], "match boolean"))
    files = [f for f in tmp_path.glob("run-*/standardized_output/part-*")]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert read_member(spark, str(tmp_path), "standardized_output").count() == 1000
