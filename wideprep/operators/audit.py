"""Review: apply analyst edits, log cell changes between two versions.

Both are joins on the unique ``record_id`` (evenly spread, no hot key).
Versions stored by :func:`store_version` are bucketed by it, so two of them
meet without a shuffle. Whole rows are compared first, as they are typed;
only rows that differ go on to the per-cell comparison, of which the places
of changed cells are unpivoted.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from wideprep.constants import LOCKED_COLUMNS, STATUSES
from wideprep.functions.numbers import num_comma, ref
from wideprep.functions.text import WS, WS_CHARS, clean_text
from wideprep.session import STORED, freed_shuffles, new_table_path

AUDIT_SCHEMA = "record_id string, field string, original_value string, final_value string"
# in the log, the field of a record that only one version has
RECORD_FIELD, PRESENT = "(record)", "present"
KEY = "record_id"
WHOLE_NUMBER = rf"^{WS}*[+-]?\d{{1,18}}{WS}*$"


def _text(c: Column) -> Column:
    return c.cast("string")


def _edit_join(out: DataFrame, edits: DataFrame, key: str, allow_locked: bool):
    """out LEFT JOIN pivoted edits; returns (joined, editable columns)."""
    allowed = _allowed(out, key, allow_locked)
    e = edits.where(_accepted(out, allowed))
    edited = {r["field"] for r in e.select("field").distinct().collect()}  # column names
    editable = [c for c in allowed if c in edited]
    if not editable:
        return None, []
    # of several edits of a cell the last (edit_no) wins; a struct keeps an edit to NULL apart from no edit
    number = F.col("edit_no") if "edit_no" in edits.columns else F.lit(0)
    last = F.max(F.struct(number.alias("n"), F.col("value").alias("v")))
    wide = e.groupBy(F.col(key).alias("_ek")).pivot("field", editable).agg(last)
    wide = wide.select("_ek", *[F.col(ref(c)).alias(f"_e_{i}") for i, c in enumerate(editable)])
    return out.join(wide, out[key] == F.col("_ek"), "left"), editable


def _allowed(out: DataFrame, key: str, allow_locked: bool) -> list[str]:
    return [c for c in out.columns if c != key and (allow_locked or c not in LOCKED_COLUMNS) and c != "_row_id"]


def _accepted(out: DataFrame, allowed: list[str]) -> Column:
    """An edit of a field that may change, to a value of its kind and, for the status, an allowed one."""
    numeric = [f.name for f in out.schema.fields if f.name in allowed and isinstance(f.dataType, NumericType)]
    field, value = F.col("field"), F.col("value")
    whole = [f.name for f in out.schema.fields if f.name in numeric and isinstance(f.dataType, IntegralType)]
    reads = F.when(field.isin(*whole), F.replace(value, F.lit(","), F.lit("")).rlike(WHOLE_NUMBER)).otherwise(num_comma(value).isNotNull())
    fits = F.when(field.isin(*numeric), value.isNull() | reads).when(
        field == "status", F.coalesce(value.isin(*STATUSES), F.lit(False))).otherwise(True)
    return F.coalesce(field.isin(*allowed), F.lit(False)) & fits


def rejected_edits(out: DataFrame, edits: DataFrame, key: str = KEY, allow_locked: bool = False) -> DataFrame:
    """Edits that :func:`apply_edits` does not take."""
    return edits.where(~_accepted(out, _allowed(out, key, allow_locked)))


def _edited_value(out: DataFrame, c: str, i: int) -> Column:
    kind, new = out.schema[c].dataType, F.col(f"_e_{i}.v")
    if isinstance(kind, NumericType):  # commas as in every other number; `5f` and `NaN` have been refused
        new = F.btrim(F.replace(new, F.lit(","), F.lit("")), F.lit(WS_CHARS))
    new = new.try_cast(kind)
    return F.when(F.col(f"_e_{i}").isNotNull(), new).otherwise(F.col(ref(c)))


def apply_edits(out: DataFrame, edits: DataFrame, key: str = KEY, allow_locked: bool = False) -> DataFrame:
    """Overlay long edits ``(record_id, field, value)`` on an output.

    Edits are pivoted over the fields that were edited (explicit value list)
    and left-joined on the record id. A NULL value clears a cell; of several
    edits of a cell the one with the largest ``edit_no`` wins. Edits of locked
    columns, of other kinds than the column's, and to unknown statuses are not
    applied (see :func:`rejected_edits`).
    """
    j, editable = _edit_join(out, edits, key, allow_locked)
    if j is None:
        return out
    return j.select(*[_edited_value(out, c, editable.index(c)).alias(c) if c in editable else F.col(ref(c))
                      for c in out.columns])


def _logged(rows: DataFrame, record_id: Column, cells: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    """One log row for each cell (changed, field, original, final) that changed. The places of changed cells are found in compiled code and
    only they become rows, which look their texts up; an explode of the cells themselves is interpreted, cell by cell."""
    places = F.array(*[F.when(changed, F.lit(i)) for i, (changed, *_) in enumerate(cells)])
    packed = rows.select(record_id.alias("record_id"), F.array_except(places, F.array(F.lit(None).cast("int"))).alias("_places"),
                         F.array(*[old for *_, old, _ in cells]).alias("_old"), F.array(*[new for *_, new in cells]).alias("_new"))
    # outer: Spark would else test the places before the unpivot, and work them out twice
    long = packed.select("record_id", "_old", "_new", F.explode_outer("_places").alias("_i")).where(F.col("_i").isNotNull())
    field = F.get(F.array(*[F.lit(f) for _, f, *_ in cells]), F.col("_i"))
    return long.select("record_id", field.alias("field"), F.get("_old", F.col("_i")).alias("original_value"),
                       F.get("_new", F.col("_i")).alias("final_value"))


def edit_log(out: DataFrame, edits: DataFrame, key: str = KEY, allow_locked: bool = False,
             stamp: bool = False) -> DataFrame:
    """The change log of :func:`apply_edits` from the same join: only edited
    fields can change, so only they are compared (no second wide join)."""
    j, editable = _edit_join(out, edits, key, allow_locked)
    if j is None:
        return out.sparkSession.createDataFrame([], AUDIT_SCHEMA)
    cells = []
    for i, c in enumerate(editable):
        bo, af = F.col(ref(c)), _edited_value(out, c, i)
        changed = ~bo.eqNullSafe(af) & (clean_text(_text(bo)) != clean_text(_text(af)))
        cells.append((changed, c, _text(bo), _text(af)))
    log = _logged(j.where(F.col("_ek").isNotNull()), F.col(key), cells)
    if stamp:
        log = log.withColumn("changed_at", F.lit(datetime.now(timezone.utc)).cast("timestamp"))
    return log


def store_version(df: DataFrame, key: str = KEY, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """``df`` stored as a version: a table bucketed and sorted by ``key`` under the shared storage folder. ``placed``: the rows already lie
    by ``key`` (an edited version of a stored one), so they are not shuffled again."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_table_path(spark, "version")
    name = "wideprep_version_" + path.rsplit("-", 1)[1]
    rows = df if placed else df.repartition(n, F.col(ref(key)))
    with freed_shuffles(spark):
        rows.write.bucketBy(n, key).sortBy(key).options(path=path, **STORED).saveAsTable(name)
    return spark.table(name)


def change_log(before: DataFrame, after: DataFrame, key: str = KEY, stamp: bool = False) -> DataFrame:
    """(record_id, field, original_value, final_value[, changed_at]) for every
    cell that differs (NULL-safe) and, if text, still differs after cleaning. A
    record that one version lacks is one row: field ``(record)``, with ``present`` on the side that has it."""
    common = [c for c in after.columns if c in before.columns and c not in (key, "_row_id")]
    kinds = {c: before.schema[c].dataType for c in common}
    same_kind = {c: kinds[c] == after.schema[c].dataType for c in common}

    def packed(df: DataFrame, key_name: str, name: str) -> DataFrame:
        cells = [F.col(ref(c)).alias(f"c{i}") if same_kind[c] else _text(F.col(ref(c))).alias(f"c{i}") for i, c in enumerate(common)]
        return df.select(F.col(ref(key)).alias(key_name), F.struct(F.lit(0).alias("_"), *cells).alias(name))

    j = packed(before, "_bk", "_b").join(packed(after, "_ak", "_a"), F.col("_bk") == F.col("_ak"), "full_outer")
    differing = j.where(~F.col("_b").eqNullSafe(F.col("_a")))
    here, there = F.col("_b").isNotNull(), F.col("_a").isNotNull()

    present = F.lit(PRESENT)
    cells = [(~(here & there), RECORD_FIELD, F.when(here, present), F.when(there, present))]
    for i, c in enumerate(common):
        bo, af = F.col(f"_b.c{i}"), F.col(f"_a.c{i}")
        changed = here & there & ~bo.eqNullSafe(af)
        if not (same_kind[c] and isinstance(kinds[c], NumericType)):
            changed = changed & (clean_text(_text(bo)) != clean_text(_text(af)))
        cells.append((changed, c, _text(bo), _text(af)))
    log = _logged(differing, F.coalesce("_ak", "_bk"), cells)
    if stamp:
        log = log.withColumn("changed_at", F.lit(datetime.now(timezone.utc)).cast("timestamp"))
    return log


def locked_changes(before: DataFrame, after: DataFrame, key: str = KEY) -> DataFrame:
    """Changes to locked columns (must be empty)."""
    return change_log(before.select(key, *[c for c in LOCKED_COLUMNS if c in before.columns and c != key]),
                      after.select(key, *[c for c in LOCKED_COLUMNS if c in after.columns and c != key]), key)


def status_allowed(c: Column | None = None) -> Column:
    return (F.col("status") if c is None else c).isin(*STATUSES)


def append_log(log: DataFrame, path: str, save_id: str) -> None:
    """Add one save to the audit trail at ``path``, exactly once: its rows are the partition ``save_id``, which a repeated try replaces,
    and it counts from the moment its commit is written."""
    def put(df: DataFrame, folder: str) -> None:
        rows = df.withColumn("save_id", F.lit(f"save-{save_id}"))  # never taken for a number
        with freed_shuffles(df.sparkSession):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("save_id").parquet(f"{path}/{folder}")

    put(log, "saves")
    put(log.sparkSession.range(1).select(F.current_timestamp().alias("committed_at")), "commits")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed saves, with their ``save_id``."""
    def partitioned(folder: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{folder}")
        return df.withColumn("save_id", F.substr("save_id", F.lit(len("save-") + 1)))

    return partitioned("saves").join(partitioned("commits").select("save_id"), "save_id", "left_semi")
