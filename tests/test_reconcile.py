"""Totals with infinite, huge and tiny cells; candidates for measures and slices."""

import math

import pytest


def _tables(spark, cells):
    src = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "_row_id long, jan string")
    out = spark.createDataFrame([(i, "a" if i % 2 else "b", None) for i in range(len(cells))], "_row_id long, channel string, jan double")
    return src, out


@pytest.mark.parametrize("cells, total, match", [
    (["inf", "1"], math.inf, False), (["1e35", "-5"], 1e35, False), (["0.0000004"] * 10, 4e-6, False),
    (["9" * 14] * 20, 20 * (10**14 - 1), False), (["x", None], 0.0, True)])
def test_totals_of_unusual_cells(spark, cells, total, match):
    from wideprep.operators.reconcile import reconcile_groups, reconcile_periods, reconcile_total

    src, out = _tables(spark, cells)
    row = reconcile_total(src, out, "jan", "jan", tolerance=1e-7).first()
    assert row["input_total"] == pytest.approx(total) and row["match"] is match
    period = reconcile_periods(src, out, ["jan"], ["channel"], tolerance=1e-7).collect()
    assert sum(r["input_total"] for r in period) == pytest.approx(total)
    assert all(r["match"] for r in reconcile_groups(src, out, "jan", "jan", ["channel"], 1e-7).collect()) is match


def test_both_sides_infinite_do_not_match(spark):
    from wideprep.operators.reconcile import reconcile_total

    df = spark.createDataFrame([(1, math.inf), (2, math.nan)], "_row_id long, jan double")
    row = reconcile_total(df, df, "jan", "jan").first()
    assert row["input_total"] == math.inf and math.isnan(row["difference"]) and row["match"] is False


def test_candidates(spark):
    from wideprep.operators.reconcile import output_measures, slice_candidates

    out = spark.createDataFrame([("b", "x", "1d", "nan", "2", "k")] * 3, "brand string, channel string, a string, n string, m string, own string")
    src = spark.createDataFrame([(1, "k", "x")], "_row_id long, own string, channel string")
    assert output_measures(out) == ["m"]
    assert slice_candidates(src, out) == ["channel", "brand", "own"]
