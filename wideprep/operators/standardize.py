"""Standardising transform: raw wide table + mapping -> canonical output.

One projection over the source: the mapping (bounded by the number of
columns) is read on the driver to decide which source column feeds which
dimension. A dictionary given as a nested dict becomes literal maps inside
the projection, so no join and no shuffle happen. One given as a DataFrame
(dimension, alias, canonical) may have any size: it is joined, salted, and
Spark broadcasts it only where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wideprep.constants import (
    APPROVE_FROM,
    DIM_COLUMNS,
    DIMS,
    HISTORY_FROM,
    METHOD_MODEL,
    REQUIRED_DIMS,
    SOURCE_HISTORY,
    SOURCE_MANUAL,
    SOURCE_RULES,
    STANDARDS,
    STATUS_APPROVED,
    STATUS_INCOMPLETE,
    STATUS_REVIEW,
    TIME_FIELD,
)
from pyspark.sql.types import NumericType

from wideprep.functions.numbers import num_filter_sql, ref
from wideprep.functions.text import clean_text, py_title, sku_form
from wideprep.operators.cleanup import SALTS
from wideprep.operators.ordinal import ROW_ID

DICTIONARY_DIMS = (("Country", "country"), ("Region", "region"), ("Channel", "channel"))
TITLE_DIMS = ("City/State", "Category", "Brand", "Fact")
OUTPUT_TAIL = ("confidence", "status", "recommendation_source", "analyst_comment")


def resolve_mapping(mapping: DataFrame, dataset: str | None = None) -> tuple[dict[str, str], list[str], bool]:
    """(dimension -> source column, time-period columns, model used?).

    For each dimension the highest-confidence column wins, ties by column
    ordinal. The rows read on the driver are at most one per source column.
    """
    m = mapping if dataset is None else mapping.where(F.col("dataset") == dataset)
    w = Window.partitionBy("target_field").orderBy(F.col("confidence").desc(), F.col("col_ordinal"))
    dims = (
        m.where(F.col("target_field").isin(*DIMS))
        .select("target_field", "source_column", F.row_number().over(w).alias("_rk"))
        .where("_rk = 1")
        .collect()
    )
    lookup = {r["target_field"]: r["source_column"] for r in dims}
    times = [r["source_column"] for r in m.where(F.col("target_field") == TIME_FIELD).orderBy("col_ordinal").collect()]
    has_model = m.where(F.col("method") == METHOD_MODEL).limit(1).count() > 0
    return lookup, times, has_model


def _map_literal(d: dict[str, str]) -> Column | None:
    if not d:
        return None
    kv = []
    for k, v in d.items():
        kv += [F.lit(str(k).lower()), F.lit(v)]
    return F.create_map(*kv)


def standardize_with(c: Column, dictionary: dict[str, str]) -> Column:
    """Lookup of the lower-cased text, else its title case. ``c`` should be
    a column of already cleaned text (it is read several times)."""
    fallback = py_title(c)
    m = _map_literal(dictionary)
    if m is None:
        return fallback
    return F.coalesce(F.try_element_at(m, F.lower(c)), fallback)


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, alias, canonical) of text files that hold one block a dimension: its name and a colon, then indented lines
    ``alias: canonical``, either side in quotes or not. Comment lines and other lines give no rows."""
    def pairs(text: str, pattern: str):
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
        return F.explode(F.arrays_zip(found[0].alias("a"), found[1].alias("b")))

    def plain(c: str) -> Column:
        return F.regexp_replace(F.trim(c), "^(['\"])(.*)\\1$", "$2")

    blocks = spark.read.text(path, wholetext=True).select(
        F.regexp_replace("value", "\r\n?", "\n").alias("value")).select(
        pairs("value", r"(?m)^([^\s#:][^:\n]*):[ \t]*\n((?:[ \t]+[^\n]*(?:\n|$)|[ \t]*\n)*)").alias("x"))
    entries = blocks.select(plain("x.a").alias("dimension"), F.col("x.b").alias("body")).select(
        "dimension", pairs("body", r"(?m)^[ \t]+([^\s#][^\n]*?)[ \t]*:[ \t]+([^\n]*?)[ \t]*$").alias("x"))
    return entries.select("dimension", plain("x.a").alias("alias"), plain("x.b").alias("canonical"))


def _looked_up(cleaned: DataFrame, standards: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """``cleaned`` plus ``_s{i}``: the canonical spelling of dictionary dimension i, NULL if it has none.

    Of several spellings of one alias the smallest counts. A value may fill
    a third of the rows, so rows are dealt over ``salts`` and the dictionary,
    one row an alias, is repeated for each.
    """
    out = cleaned.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    for dim, key in DICTIONARY_DIMS:
        i = DIMS.index(dim)
        entries = standards.where((F.col("dimension") == key) & F.col("alias").isNotNull()).groupBy(
            F.lower("alias").alias("_alias")).agg(F.min("canonical").alias(f"_s{i}"))
        entries = entries.select("_alias", f"_s{i}", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_at"))
        out = out.join(entries, (F.lower(F.col(f"_c{i}")) == F.col("_alias")) & (F.col("_salt") == F.col("_at")), "left").drop(
            "_alias", "_at")
    return out


def standardize(source: DataFrame, mapping: DataFrame, standards=STANDARDS, dataset: str | None = None,
                row_id: str = ROW_ID, keep_row_id: bool = True) -> DataFrame:
    """Canonical output: record_id, 8 dimensions, period columns (double),
    confidence, status, recommendation_source, analyst_comment (+ ``_row_id``).
    ``standards``: nested dict, DataFrame (dimension, alias, canonical) or None.
    """
    lookup, times, has_model = resolve_mapping(mapping, dataset)
    joined = isinstance(standards, DataFrame)
    cols = set(source.columns)

    def src(dim: str) -> Column:
        c = lookup.get(dim)
        return F.col(ref(c)).cast("string") if c and c in cols else F.lit("")

    rid = [F.col(row_id)] if row_id in cols else []
    period_names = [c for c in times if c in cols]
    # stage 1: cleaned text per dimension, numeric periods
    cleaned = source.select(
        *rid,
        *[clean_text(src(d)).alias(f"_c{i}") for i, d in enumerate(DIMS)],
        *[_period_value(source, c).alias(c) for c in period_names],
    )
    c = {d: F.col(f"_c{i}") for i, d in enumerate(DIMS)}
    if joined:
        cleaned = _looked_up(cleaned, standards, rid[0] if rid else F.struct(*c.values()))
    # stage 2: dictionary lookups, title case, SKU form (each reads a column)
    dims: dict[str, Column] = {}
    for dim, key in DICTIONARY_DIMS:
        if joined:
            dims[dim] = F.coalesce(F.col(f"_s{DIMS.index(dim)}"), py_title(c[dim]))
        else:
            dims[dim] = standardize_with(c[dim], (standards or {}).get(key, {}))
    for dim in TITLE_DIMS:
        dims[dim] = py_title(c[dim])
    dims["SKU"] = sku_form(c["SKU"])
    named = cleaned.select(*rid, *[dims[d].alias(DIM_COLUMNS[d]) for d in DIMS], *[F.col(ref(p)) for p in period_names])
    # stage 3: record scores from the finished dimensions
    filled = sum((F.col(DIM_COLUMNS[d]) != "").cast("int") for d in DIMS)
    complete = F.lit(True)
    for d in REQUIRED_DIMS:
        complete = complete & (F.col(DIM_COLUMNS[d]) != "")
    scored = named.select("*", F.bround(filled * 100.0 / len(DIMS), 0).cast("int").alias("confidence"),
                          complete.alias("_complete"))
    top = METHOD_MODEL if has_model else SOURCE_RULES
    conf = F.col("confidence")
    status = F.when(~F.col("_complete"), F.lit(STATUS_INCOMPLETE)).when(conf >= APPROVE_FROM, F.lit(STATUS_APPROVED)).otherwise(
        F.lit(STATUS_REVIEW))
    rec = F.when(conf >= APPROVE_FROM, F.lit(top)).when(conf >= HISTORY_FROM, F.lit(SOURCE_HISTORY)).otherwise(F.lit(SOURCE_MANUAL))
    return scored.select(
        *([F.col(row_id)] if rid and keep_row_id else []),
        record_id(F.col(row_id)).alias("record_id") if rid else F.lit(None).cast("string").alias("record_id"),
        *[F.col(DIM_COLUMNS[d]) for d in DIMS],
        *[F.col(ref(p)) for p in period_names],
        conf,
        status.alias("status"),
        rec.alias("recommendation_source"),
        F.lit("").alias("analyst_comment"),
    )


def _period_value(df: DataFrame, name: str) -> Column:
    """Numeric period cell: numeric columns cast, text through the digit filter."""
    if isinstance(df.schema[name].dataType, NumericType):
        return F.col(ref(name)).cast("double")
    return F.expr(num_filter_sql(ref(name)))


def record_id(ordinal: Column) -> Column:
    """``REC-`` + ordinal zero-padded to at least 7 digits (never truncated)."""
    short = F.concat(F.lit("REC-"), F.lpad(ordinal.cast("string"), 7, "0"))
    return F.when(ordinal.between(0, 9_999_999), short).otherwise(F.format_string("REC-%07d", ordinal))
