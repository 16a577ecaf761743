"""Cleanup steps: negatives, duplicates, dates, column management, plans.

Duplicate handling never sorts a key group inside one task: each key is
reduced by a partial aggregate (row count, first/last ordinal) that
combines map-side, so a key holding a third of the table costs one row per
map task in the shuffle. The chosen rows are then picked with a join on
the unique ordinal ``_row_id``, which spreads evenly.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wideprep.functions.dates import standardize_date
from wideprep.functions.numbers import num_comma, num_comma_array_sql, ref
from wideprep.operators.ordinal import ROW_ID, renumbered
from wideprep.session import stored_table

# --- FIXED VALUES: action labels as offered to the analyst -----------------------
NEGATIVE_ACTIONS = {
    "Convert to positive": "abs",
    "Replace with zero": "zero",
    "Replace with blank": "null",
    "Do nothing": "none",
}
KEEP_POLICIES = {"Keep first": "first", "Keep last": "last", "Delete all duplicates": "none"}

# parts a header shared by many uploads, or a dictionary entry, is split into
SALTS = 16
# rows of one key that a task takes whole, at least
KEY_ROWS = 50_000


def negative_value(c: Column, action: str, dtype=None) -> Column:
    """The numeric reading of a cell after a negative-value action."""
    a = NEGATIVE_ACTIONS.get(action, action)
    v = num_comma(c, dtype)
    if a == "abs":
        return F.abs(v)
    if a == "zero":
        return F.when(v < 0, F.lit(0.0)).otherwise(v)
    if a == "null":
        return F.when(v < 0, F.lit(None).cast("double")).otherwise(v)
    if a == "none":
        return v
    raise ValueError(f"unknown negative action {action!r}")


def apply_negative_action(df: DataFrame, column: str, action: str) -> DataFrame:
    """Column converted to numbers with the action applied; a column that is
    not in the table leaves it unchanged."""
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    return df.withColumn(column, negative_value(F.col(ref(column)), action, dtype))


def _action_sql(value: str, action: str) -> str:
    """SQL-text form of the action on a value that is read once or is cheap."""
    a = NEGATIVE_ACTIONS.get(action, action)
    if a not in ("abs", "zero", "null", "none"):
        raise ValueError(f"unknown negative action {action!r}")
    return {"abs": f"abs({value})", "zero": f"if({value} < 0, 0D, {value})",
            "null": f"if({value} < 0, CAST(NULL AS DOUBLE), {value})", "none": value}[a]


def apply_negative_actions(df: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Several columns at once; absent columns are ignored. The text columns
    are read as one array by one reader, so neither plan nor generated code
    grows with the number of columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    todo = {c: a for c, a in actions.items() if c in types}
    for a in todo.values():
        _action_sql("v", a)
    texts = [c for c in todo if not isinstance(types[c], NumericType)]
    place = {c: i for i, c in enumerate(texts)}
    if not todo:
        return df
    values = "_values"
    while values in types:
        values += "_"
    if texts:
        cells = ", ".join(f"CAST({ref(c)} AS STRING)" for c in texts)
        df = df.select("*", F.expr(num_comma_array_sql(f"array({cells})")).alias(values))

    def final(c):
        if c not in todo:
            return F.col(ref(c))
        read = f"{values}[{place[c]}]" if c in place else f"CAST({ref(c)} AS DOUBLE)"
        return F.expr(_action_sql(read, todo[c])).alias(c)

    return df.select(*[final(c) for c in types])


def _keys(df: DataFrame, keys: list[str] | None, row_id: str) -> list[str]:
    valid = [k for k in (keys or []) if k in df.columns]
    return valid or [c for c in df.columns if c != row_id]


def _key_stats(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Per key (NULLs group together): rows, first and last ordinal."""
    return df.groupBy(*[F.col(ref(k)) for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.min(row_id).alias("_first"), F.max(row_id).alias("_last"))


def duplicate_report(df: DataFrame, keys: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """Every row of every key group with more than one row. Keys absent from
    the table are ignored; no usable key -> whole-row duplicates."""
    k = _keys(df, keys, row_id)
    dup = _key_stats(df, k, row_id).where(F.col("_n") > 1).select(*[F.col(ref(c)).alias(f"_k{i}") for i, c in enumerate(k)], "_n")
    return rows_with(df, dup, [(F.col(ref(c)), f"_k{i}") for i, c in enumerate(k)], F.col(ref(row_id)))


def rows_with(df: DataFrame, keys: DataFrame, pairs: list[tuple[Column, str]], spread: Column, key_rows: int = KEY_ROWS) -> DataFrame:
    """Rows of ``df`` whose values equal a row of the distinct ``keys``
    (NULLs equal). ``keys`` holds ``_n``, the rows of each key, counted by an
    aggregate that combines map-side; it is stored, so its size is known when
    the join is planned. A key with more rows than a task's share of them
    (``key_rows`` at least) is heavy: there are at most two for each shuffle
    partition, which are broadcast to deal their rows over as many parts as
    needed. All other keys are met once, without copies."""
    spark = df.sparkSession
    keys = stored_table(keys, "repeated-keys")
    total, most = keys.agg(F.sum("_n"), F.max("_n")).first()
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(key_rows, -(-(total or 0) // parts))
    same = [value.eqNullSafe(F.col(name)) for value, name in pairs]
    if (most or 0) <= share:
        return df.join(keys, same, "left_semi")
    split = F.ceil(F.col("_n") / share).cast("int")
    heavy = keys.where(F.col("_n") > share).select(*[F.col(name).alias(f"_h{name}") for _, name in pairs], split.alias("_parts"))
    of = [value.eqNullSafe(F.col(f"_h{name}")) for value, name in pairs]
    dealt = df.join(F.broadcast(heavy), of, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int"))
    copies = keys.select("*", F.explode(F.sequence(F.lit(0), split - 1)).alias("_key_part"))
    rows = dealt.join(copies, [*same, F.col("_part") == F.col("_key_part")], "left_semi")
    return rows.select(*[F.col(ref(c)) for c in df.columns])


def remove_duplicates(df: DataFrame, keys: list[str] | None = None, keep: str = "first",
                      row_id: str = ROW_ID) -> DataFrame:
    """Keep the first / last row of each key group, or drop whole groups
    that have more than one row (``keep='none'``)."""
    policy = KEEP_POLICIES.get(keep, keep)
    if policy not in ("first", "last", "none"):
        raise ValueError(f"unknown duplicate policy {keep!r}")
    k = _keys(df, keys, row_id)
    stats = _key_stats(df, k, row_id)
    if policy == "first":
        chosen = stats.select(F.col("_first").alias("_keep"))
    elif policy == "last":
        chosen = stats.select(F.col("_last").alias("_keep"))
    else:
        chosen = stats.where(F.col("_n") == 1).select(F.col("_first").alias("_keep"))
    return df.join(chosen, df[row_id] == chosen["_keep"], "left_semi")


def standardize_dates(df: DataFrame, columns: list[str], fmt: str = "YYYY-MM-DD", dayfirst: bool = False) -> DataFrame:
    """Re-render date cells of the given columns; unknown columns skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: standardize_date(F.col(ref(c)), fmt, dayfirst) for c in present})


def manage_columns(df: DataFrame, delete: list[str] | None = None, rename: dict[str, str] | None = None,
                   order: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """Drop (missing names ignored), rename, then put ``order`` first and the
    rest after it in their current order. The ordinal stays in front."""
    out = df.drop(*[c for c in (delete or []) if c != row_id])
    if rename:
        out = out.withColumnsRenamed({k: v for k, v in rename.items() if k in out.columns and k != row_id})
    valid = [c for c in (order or []) if c in out.columns and c != row_id]
    rest = [c for c in out.columns if c not in valid and c != row_id]
    lead = [row_id] if row_id in out.columns else []
    return out.select(*[F.col(ref(c)) for c in lead + valid + rest])


@dataclass
class CleanupPlan:
    """Steps applied in the fixed order negatives -> duplicates -> dates ->
    columns; the raw table is never changed, so re-running the plan on it is
    the reset."""

    negatives: dict[str, str] = field(default_factory=dict)
    duplicate_keys: list[str] | None = None
    duplicate_policy: str | None = None
    date_columns: list[str] = field(default_factory=list)
    date_format: str = "YYYY-MM-DD"
    dayfirst: bool = False
    delete: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)


PLAN_SCHEMA = "version int, step_no int, setting string, value string"


def save_plan(spark: SparkSession, path: str, version: int, plan: CleanupPlan | None) -> None:
    """Keep a plan as rows, one a setting; no plan is the reset to the raw table, a version of one row without a setting. A version is
    written once: a repeated try replaces it."""
    settings = asdict(plan) if plan else {}
    rows = [(version, i + 1, name, json.dumps(value)) for i, (name, value) in enumerate(settings.items())] or [(version, 0, None, None)]
    out = spark.createDataFrame(rows, PLAN_SCHEMA)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_plan(spark: SparkSession, path: str, version: int | None = None) -> CleanupPlan | None:
    """A kept plan, by default the last version; None for a reset. An unknown version raises."""
    kept = spark.read.parquet(path)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    rows = kept.where(F.col("version") == version).collect()  # a row a setting
    if not rows:
        raise KeyError(f"no plan version {version}")
    settings = {r["setting"]: json.loads(r["value"]) for r in rows if r["setting"] is not None}
    return CleanupPlan(**settings) if settings else None


def replay(raw: DataFrame, spark: SparkSession, path: str, version: int | None = None, row_id: str = ROW_ID, renumber: bool = False) -> DataFrame:
    """The immutable raw table under a kept plan; as it is after a reset."""
    plan = load_plan(spark, path, version)
    return raw if plan is None else apply_plan(raw, plan, row_id, renumber)


def apply_plan(df: DataFrame, plan: CleanupPlan, row_id: str = ROW_ID, renumber: bool = False) -> DataFrame:
    """Run a cleanup plan. ``renumber=True`` gives the surviving rows a dense
    ordinal again, in the order of the old one."""
    out = apply_negative_actions(df, {c: a for c, a in plan.negatives.items()
                                      if NEGATIVE_ACTIONS.get(a, a) != "none"})
    if plan.duplicate_policy:  # an unknown one raises
        kept = remove_duplicates(out, plan.duplicate_keys, plan.duplicate_policy, row_id)
        # with new ordinals, the wide rows meet the kept ordinals and their places in one step without a shuffle
        out = renumbered(out, kept.select(F.col(ref(row_id))), row_id) if renumber else kept
    if plan.date_columns:
        out = standardize_dates(out, plan.date_columns, plan.date_format, plan.dayfirst)
    if plan.delete or plan.rename or plan.order:
        out = manage_columns(out, plan.delete, plan.rename, plan.order, row_id)
    return out
