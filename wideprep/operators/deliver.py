"""Delivery: formula-injection guard, size gate, manifest, file sinks, published bundle.

Tables go out as directories of part files written in parallel by the
executors (never gathered on the driver); the small summary members
(profile, reconciliation summary, manifest) are written as JSON.

A bundle is written under a staging folder of its own, read back and compared
with what was written (rows and a checksum, observed during the write),
and becomes visible by one marker that names the folder. A run that fails
before leaves the bundle published last in place.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wideprep.constants import EXCEL_COLS, EXCEL_ROWS
from wideprep.functions.numbers import is_float_text, ref
from wideprep.session import freed_shuffles

# --- FIXED VALUES: characters that start a spreadsheet formula ------------------
FORMULA_START = r"^[=+\-@\t\r]"
APPLICATION = "wideprep"


def guard_cell(c: Column) -> Column:
    """Prefix ``'`` to text that starts like a formula and is not a number."""
    t = c.cast("string")
    return F.when(t.rlike(FORMULA_START) & ~is_float_text(t), F.concat(F.lit("'"), t)).otherwise(c)


def sanitize(df: DataFrame) -> DataFrame:
    """Guard every text column; numeric columns and NULLs untouched."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*[guard_cell(F.col(ref(c))).alias(c) if c in text else F.col(ref(c)) for c in df.columns])


def size_gate(df: DataFrame) -> DataFrame:
    """One row: all rows, columns, allowed."""
    cols = len([c for c in df.columns if c != "_row_id"])
    return df.agg(F.count(F.lit(1)).alias("rows_checked")).select(
        "rows_checked", F.lit(cols).alias("columns"),
        ((F.col("rows_checked") <= EXCEL_ROWS) & F.lit(cols <= EXCEL_COLS)).alias("excel_allowed"))


def manifest(output: DataFrame, source_name: str | None, stamp: bool = True) -> DataFrame:
    """One-row run manifest (source, rows, columns, gate, time)."""
    cols = [c for c in output.columns if c != "_row_id"]
    agg = output.agg(F.count(F.lit(1)).alias("rows"))
    m = agg.select(
        F.lit(APPLICATION).alias("application"),
        F.lit(source_name).alias("source"),
        F.col("rows"),
        F.lit(len(cols)).alias("columns"),
        ((F.col("rows") <= EXCEL_ROWS) & F.lit(len(cols) <= EXCEL_COLS)).alias("excel_allowed"),
        F.lit(True).alias("time_periods_preserved_as_columns"),
    )
    if stamp:
        m = m.withColumn("generated_at_utc", F.lit(datetime.now(timezone.utc).isoformat()))
    return m


# --- sinks -------------------------------------------------------------------------
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "encoding": "UTF-8",
}


# the members of a bundle are compressed, as in the reference; a part file is one task's work when it is read back, so its rows are bounded
BUNDLE_FILES = {"compression": "gzip", "maxRecordsPerFile": str(EXCEL_ROWS - 1)}


def write_csv(df: DataFrame, path: str, guard: bool = True, mode: str = "overwrite", **options: str) -> None:
    """CSV with header, doubled quotes, cells kept as they are, formula guard."""
    out = sanitize(df) if guard else df
    out.drop("_row_id").write.mode(mode).options(**CSV_OPTIONS, **options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# --- FIXED VALUES: member names, as receivers of a bundle know them ----------------
BUNDLE_TABLES = ("standardized_output", "data_quality_report", "column_classification", "duplicate_report",
                 "reconciliation_detail", "user_change_audit")
BUNDLE_SUMMARIES = ("profiling_report", "reconciliation_summary", "run_manifest")


def write_bundle(path: str, tables: dict[str, DataFrame], summaries: dict[str, DataFrame]) -> list[str]:
    """One directory per member; tables as CSV, summaries as JSON. Returns
    the member names written."""
    written = []
    for name, df in tables.items():
        if df is not None:
            write_csv(df, os.path.join(path, name))
            written.append(name)
    for name, df in summaries.items():
        if df is not None:
            write_json(df, os.path.join(path, name))
            written.append(name)
    return written


def read_csv_member(spark: SparkSession, path: str, line_ends: bool = False) -> DataFrame:
    """A member as text. ``line_ends``: some cell holds one, so a part file is one task's work."""
    return spark.read.options(**CSV_OPTIONS).option("multiLine", line_ends).csv(path)


class BundleRefused(ValueError):
    """The bundle was not published."""


#: The bundle's members, tables and summaries; the manifest is made while publishing.
MEMBERS = (*BUNDLE_TABLES, "profiling_report", "reconciliation_summary")
_MARKER = "_PUBLISHED"


def _figures(columns: list[str]) -> list[Column]:
    """rows, checksum (a sum of row hashes: in any order the same; NULL and empty text are one in a CSV), line ends in cells."""
    texts = [F.coalesce(F.col(ref(c)).cast("string"), F.lit("")) for c in columns]
    row = F.xxhash64(*texts) if texts else F.lit(0)
    ends = reduce(or_, (F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\r")) for t in texts), F.lit(False))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"),
            F.coalesce(F.max(ends), F.lit(False)).alias("line_ends")]


def _write_member(df: DataFrame, path: str, table: bool) -> dict:
    """Write one member, read it back, and return its figures; they must agree."""
    spark = df.sparkSession
    shown = (sanitize(df) if table else df).drop("_row_id")
    seen = Observation()
    observed = shown.observe(seen, *_figures(shown.columns))
    with freed_shuffles(spark):
        if table:
            write_csv(observed, path, guard=False, **BUNDLE_FILES)
        else:
            write_json(observed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path)
    wrote = seen.get
    if table:
        back = read_csv_member(spark, path, wrote["line_ends"])
    else:
        back = spark.read.json(path).select(F.from_json("value", shown.schema).alias("m")).select("m.*")
    read = back.agg(*_figures(back.columns)).first().asDict()
    if (read["rows"], read["checksum"]) != (wrote["rows"], wrote["checksum"]):
        raise BundleRefused(f"{os.path.basename(path)}: {wrote} written, {read} read back")
    return wrote


def publish_bundle(path: str, members: dict[str, DataFrame], reconciliation: DataFrame, source_name: str | None = None,
                   stamp: bool = True) -> list[str]:
    """Publish all members (``MEMBERS``) and their manifest at ``path``; returns the names. ``reconciliation`` has a column ``match``: a
    row that does not match refuses the bundle, as does a member that is missing or reads back differently."""
    missing = [m for m in MEMBERS if members.get(m) is None]
    if missing:
        raise BundleRefused(f"members missing: {missing}")
    if not reconciliation.where(~F.coalesce("match", F.lit(False))).isEmpty():
        raise BundleRefused("source and output do not reconcile")
    spark = reconciliation.sparkSession
    staged = f"run-{uuid.uuid4().hex}"
    figures = []
    for name in MEMBERS:
        wrote = _write_member(members[name], f"{path}/{staged}/{name}", name in BUNDLE_TABLES)
        figures.append(F.struct(F.lit(name).alias("member"), F.lit(wrote["rows"]).cast("long").alias("rows"),
                                F.lit(wrote["checksum"]).alias("checksum"), F.lit(bool(wrote["line_ends"])).alias("line_ends")))
    about = manifest(members["standardized_output"], source_name, stamp).withColumn("members", F.array(*figures))
    write_json(about, f"{path}/{staged}/run_manifest")
    # the one step that makes the run visible
    spark.range(1).select(F.lit(staged).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{_MARKER}")
    return [*MEMBERS, "run_manifest"]


def published_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/{_published(spark, path)}/run_manifest")


def _published(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{_MARKER}").first()["value"]


def read_member(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A member of the bundle published last: a table as text, a summary as JSON text by the column ``value``."""
    folder = f"{path}/{_published(spark, path)}"
    if name not in BUNDLE_TABLES:
        return spark.read.json(f"{folder}/{name}")
    listed = spark.read.json(f"{folder}/run_manifest").select(F.inline("members")).where(F.col("member") == name).first()
    return read_csv_member(spark, f"{folder}/{name}", listed["line_ends"])
