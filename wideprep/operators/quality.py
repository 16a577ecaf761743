"""Row-level exception report and status counts over a canonical output.

All checks of a row are built as one array of optional structs and
exploded once: a single narrow pass, no union of per-field scans.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideprep.constants import (
    DIM_COLUMNS,
    ISSUE_REGION,
    ISSUE_REQUIRED,
    RECOMMEND_REGION,
    REQUIRED_DIMS,
    SEVERITY_ERROR,
    SEVERITY_WARNING,
    STATUS_APPROVED,
    STATUS_INCOMPLETE,
    STATUS_REVIEW,
)
from wideprep.functions.text import is_blank
from wideprep.operators.ordinal import ROW_ID

REPORT_SCHEMA = "record_id string, severity string, field string, issue string, recommendation string"


def _check(df: DataFrame, dim: str, severity: str, issue: str, recommendation: str, ordinal: int) -> Column:
    col = DIM_COLUMNS[dim]
    bad = is_blank(F.col(col)) if col in df.columns else F.lit(True)
    return F.when(bad, F.struct(
        F.lit(severity).alias("severity"), F.lit(dim).alias("field"), F.lit(issue).alias("issue"),
        F.lit(recommendation).alias("recommendation"), F.lit(ordinal).alias("field_ordinal")))


def quality_report(out: DataFrame, ordered: bool = False, keep_order_columns: bool = False) -> DataFrame:
    """(record_id, severity, field, issue, recommendation) for every blank
    required dimension (Error) and blank region (Warning).

    ``ordered=True`` sorts by row ordinal, severity, field order (a global
    sort: use it for a presented report, not in a pipeline).
    """
    spark = out.sparkSession
    if "record_id" not in out.columns:
        return spark.createDataFrame([], REPORT_SCHEMA)
    checks = [_check(out, d, SEVERITY_ERROR, ISSUE_REQUIRED, f"Provide or approve {d}.", i)
              for i, d in enumerate(REQUIRED_DIMS)]
    checks.append(_check(out, "Region", SEVERITY_WARNING, ISSUE_REGION, RECOMMEND_REGION, len(REQUIRED_DIMS)))
    # most records lack nothing: they are told first, without an array of checks
    lacking = [is_blank(F.col(DIM_COLUMNS[d])) if DIM_COLUMNS[d] in out.columns else F.lit(True) for d in (*REQUIRED_DIMS, "Region")]
    out = out.where(reduce(or_, lacking))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    has_ord = ROW_ID in out.columns
    rows = out.select(*([F.col(ROW_ID)] if has_ord else []), "record_id", F.explode(found).alias("x"))
    rep = rows.select(
        *([F.col(ROW_ID)] if has_ord else []), "record_id", "x.severity", "x.field", "x.issue", "x.recommendation",
        "x.field_ordinal")
    if ordered:
        rep = rep.orderBy(*([F.col(ROW_ID)] if has_ord else [F.col("record_id")]), "severity", "field_ordinal")
    if keep_order_columns:
        return rep
    return rep.select("record_id", "severity", "field", "issue", "recommendation")


def status_counts(out: DataFrame) -> DataFrame:
    """One row: total_rows, approved, needs_review, incomplete, rejected."""
    s = F.col("status")
    return out.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(s == STATUS_APPROVED, 1)).alias("approved"),
        F.count(F.when(s == STATUS_REVIEW, 1)).alias("needs_review"),
        F.count(F.when(s == STATUS_INCOMPLETE, 1)).alias("incomplete"),
        F.count(F.when(s == "Rejected", 1)).alias("rejected"),
    )
