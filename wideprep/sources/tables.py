"""Reading the driver's parquet tables, table cleanup, append with lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideprep.constants import SOURCE_COLUMN

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_text_table(df: DataFrame) -> DataFrame:
    """Every column as text, the way a raw upload is read (no inference)."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def drop_empty(df: DataFrame, keep: tuple[str, ...] = ("_row_id",)) -> DataFrame:
    """Drop rows whose cells are all NULL, then columns that are all NULL.

    One aggregate pass counts non-NULL cells per column (partial aggregation,
    one row per task through the shuffle); the column list is metadata.
    """
    data_cols = [c for c in df.columns if c not in keep]
    if not data_cols:
        return df
    any_value = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in data_cols])
    rows = df.where(any_value)
    counts = rows.agg(*[F.count(f"`{c}`").alias(c) for c in data_cols]).first()
    alive = [c for c in data_cols if counts[c] > 0]
    return rows.select(*[c for c in df.columns if c in keep or c in alive])


def add_lineage(df: DataFrame, name: str, column: str = SOURCE_COLUMN) -> DataFrame:
    """Source name as the first column, unless the table already has one."""
    if column in df.columns:
        return df
    return df.select(F.lit(name).alias(column), *[F.col(f"`{c}`") for c in df.columns])


def append_tables(tables: dict[str, DataFrame], selected: list[str] | None = None,
                  mode: str = "append", add_source: bool = True) -> DataFrame:
    """Append named tables by column name (missing columns -> NULL).

    ``selected`` defaults to all tables in the given order; a selected name
    that is missing raises instead of mislabelling lineage. ``mode='first'``
    returns the first selected table unchanged.
    """
    names = list(selected) if selected else list(tables)
    missing = [n for n in names if n not in tables]
    if missing:
        raise KeyError(f"tables not found: {missing}")
    if not names:
        raise ValueError("select at least one table")
    if mode == "first":
        return tables[names[0]]
    frames = [add_lineage(tables[n], n) if add_source else tables[n] for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def largest_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, ordinal) of every table, largest first (first on a tie).
    One union of per-table counts: each count is a partial aggregate."""
    names = list(tables)
    counts = [
        tables[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows",
                                                                F.lit(i).alias("table_ordinal"))
        for i, n in enumerate(names)
    ]
    allc = reduce(lambda a, b: a.unionByName(b), counts)
    return allc.orderBy(F.col("rows").desc(), F.col("table_ordinal"))
