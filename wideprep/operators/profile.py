"""Profiling: per-column and whole-table quality figures in few passes.

* per-column counts (missing, parsed as number, negative, parsed as date) -
  filled cells unpivoted, each read once and only as what its first
  character allows, one small hash aggregate by column index;
* exact duplicate rows - a 64-bit row hash is counted first; only rows whose
  hash occurs twice are compared whole. The hashes that occur twice are
  stored first (the one eager job), so the join with the wide rows is
  planned by their true size.

Nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from wideprep.constants import BLANK_TOKENS, DATE_NAME_HINTS, DATE_SHARE, DUP_KEY_HINTS, DUP_KEY_MAX, NUMERIC_SHARE
from wideprep.functions.dates import parse_date
from wideprep.functions.numbers import filled_cells, num_comma, ref
from wideprep.functions.text import is_blank, strip_ws
from wideprep.operators.cleanup import rows_with
from wideprep.operators.ordinal import ROW_ID

COLUMN_FIGURES = ("column_name", "col_ordinal", "missing", "parsed", "is_numeric", "negatives", "is_date")


def _data_columns(df: DataFrame, row_id: str) -> list[str]:
    return [c for c in df.columns if c != row_id]


def _column_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``found``, a map from column index to its counts (index -1
    counts the rows).

    Cells are unpivoted to (column index, text); a marker cell stands for the
    row itself. Only non-NULL cells become rows (wide tables are mostly
    empty). A cell is stripped once; its length and first character tell
    whether it can spell a missing value, a number or a date, and only then
    is it read as one. The hash group by column index combines map-side to
    one row per column per task, so the map has at most one entry per column.
    """
    long = filled_cells(df, ["''"] + [f"CAST({ref(c)} AS STRING)" for c in cols])
    long = long.select((F.col("i") - 1).alias("i"), strip_ws(F.col("v")).alias("t")).select("i", "t", F.ascii("t").alias("first"))
    cell = F.col("i") >= 0
    digit = F.col("first").between(48, 57)
    number = digit | F.col("first").isin(*map(ord, "+,-.iI"))
    dated = digit | F.col("first").isin(*map(ord, "JFMASONDjfmasond"))
    short = F.length("t") <= max(map(len, BLANK_TOKENS))
    read = long.select("i", (cell & short & is_blank(F.col("t"))).alias("blank"), F.when(cell & number, num_comma(F.col("t"))).alias("num"),
                       F.when(cell & dated, parse_date(F.col("t"))).alias("day"))
    groups = read.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("blank"),
                                   F.count("num").alias("parsed"), F.count_if(F.col("num") < 0).alias("negative"),
                                   F.count("day").alias("days"))
    counts = F.struct("n", "blank", "parsed", "negative", "days")
    return groups.agg(F.map_from_entries(F.collect_list(F.struct("i", counts))).alias("found"))


def _figures(df: DataFrame, row_id: str) -> DataFrame:
    """COLUMN_FIGURES and ``rows`` for every data column."""
    cols = _data_columns(df, row_id)
    types = {f.name: f.dataType for f in df.schema.fields}

    def known(c):
        text = isinstance(types[c], StringType)
        dated = isinstance(types[c], (DateType, TimestampType, TimestampNTZType)) or any(h in c.lower() for h in DATE_NAME_HINTS)
        return F.struct(F.lit(c).alias("column_name"), F.lit(cols.index(c) + 1).alias("col_ordinal"),
                        F.lit(text).alias("text"), F.lit(dated).alias("dated"))

    counts = _column_counts(df, cols)
    if not cols:
        return counts.where("false").selectExpr("'' AS column_name", "0 AS col_ordinal", "0L AS missing", "0L AS parsed",
                                                "false AS is_numeric", "0L AS negatives", "false AS is_date", "0L AS rows")
    listed = counts.select("found", F.explode(F.array(*[known(c) for c in cols])).alias("c")).select(
        "c.*", F.coalesce(F.expr("try_element_at(found, -1).n"), F.lit(0)).alias("rows"),
        F.expr("try_element_at(found, c.col_ordinal - 1)").alias("x"))
    n, blank, parsed, negative, days = (F.coalesce(F.col(f"x.{f}"), F.lit(0)) for f in ("n", "blank", "parsed", "negative", "days"))
    numeric = F.coalesce(F.try_divide(parsed, "rows") >= NUMERIC_SHARE, F.lit(False))
    # the share is over all filled cells of the column; numeric-typed columns are never sniffed
    dates = F.col("dated") | (F.col("text") & F.coalesce(F.try_divide(days, n) >= DATE_SHARE, F.lit(False)))
    return listed.select(
        "column_name", "col_ordinal", (F.col("rows") - n + F.when(F.col("text"), blank).otherwise(0)).alias("missing"),
        parsed.alias("parsed"), numeric.alias("is_numeric"), F.when(numeric, negative).otherwise(F.lit(0)).alias("negatives"),
        dates.alias("is_date"), "rows")


def profile_columns(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row per column: missing cells, parsed numbers, numeric flag
    (parsed share of all rows >= 0.7), negatives (numeric columns only), date
    flag (date type, name hint, or a text column whose filled cells mostly
    parse). An empty table gives zeros."""
    return _figures(df, row_id).select(*COLUMN_FIGURES)


def date_candidates(df: DataFrame, row_id: str = ROW_ID) -> list[str]:
    """Names of the columns flagged as dates, in table order."""
    found = profile_columns(df, row_id).where("is_date").orderBy("col_ordinal")
    return [r["column_name"] for r in found.select("column_name").collect()]


def exact_duplicates(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row: rows beyond the first of each group of identical rows
    (NULLs equal), over the data columns; 0 without data columns."""
    cols = [F.col(ref(c)) for c in _data_columns(df, row_id)]
    if not cols:
        return df.agg(F.lit(0).cast("bigint").alias("exact_duplicates"))
    # position and NULLs count: a value moved to the next column is another row
    hashed = df.select(*cols, F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]).alias("_hash"),
                       (F.col(ref(row_id)) if row_id in df.columns else F.monotonically_increasing_id()).alias("_spread"))
    twice = hashed.groupBy(F.col("_hash").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # stored there, so its size is known: a short list is broadcast, and wide rows stay where they are
    groups = rows_with(hashed, twice, [(F.col("_hash"), "_twice")], F.col("_spread")).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("exact_duplicates"))


def profile_table(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row: rows, columns, exact_duplicates, missing_cells,
    numeric_columns, negative_values, date_columns, health_score."""
    summary = _figures(df, row_id).agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).cast("int").alias("columns"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.count(F.when(F.col("is_numeric"), 1)).cast("int").alias("numeric_columns"),
        F.coalesce(F.sum("negatives"), F.lit(0)).cast("bigint").alias("negative_values"),
        F.count(F.when(F.col("is_date"), 1)).cast("int").alias("date_columns"),
    )
    both = summary.unionByName(exact_duplicates(df, row_id), allowMissingColumns=True)  # two rows
    figures = ("rows", "columns", "exact_duplicates", "missing_cells", "numeric_columns", "negative_values", "date_columns")
    return both.agg(*[F.max(c).alias(c) for c in figures]).select(*figures, health_score().alias("health_score"))


def health_score():
    """clamp(20, 100, trunc(100 - 2*missing% - 1.5*dup% - 5 if any negative))."""
    cells = F.when((F.col("rows") > 0) & (F.col("columns") > 0), F.col("rows") * F.col("columns")).otherwise(F.lit(1))
    missing_pct = F.col("missing_cells") * 100.0 / cells
    dup_pct = F.when(F.col("rows") > 0, F.col("exact_duplicates") * 100.0 / F.col("rows")).otherwise(F.lit(0.0))
    penalty = F.when(F.col("negative_values") > 0, F.lit(5)).otherwise(F.lit(0))
    raw = F.lit(100) - (missing_pct * 2 + dup_pct * 1.5 + penalty)
    return F.greatest(F.lit(20), F.least(F.lit(100), raw.cast("int")))


def suggested_keys(catalogue: DataFrame) -> DataFrame:
    """Default duplicate keys of every dataset of a header catalogue: its first columns whose name hints at an identity."""
    hinted = catalogue.filter(F.col("source_column").rlike("(?i)" + "|".join(DUP_KEY_HINTS)))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy("col_ordinal"))
    return hinted.select("dataset", "col_ordinal", "source_column", rank.alias("key_rank")).filter(F.col("key_rank") <= DUP_KEY_MAX)
