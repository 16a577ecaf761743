"""Reconciliation: do source and output carry the same totals?

Cells below ``EXACT_BELOW`` are summed as ``decimal(38,18)``, so totals do not
depend on the order in which partitions are added (a double sum does);
larger and infinite cells, and totals beyond that type, are summed as
double. An infinite side never matches. Every form is one aggregate over a tagged union or over a lineage
join on the row ordinal; no per-group loops, no driver-side arithmetic.

Group values for the source side come from the output row with the same
``_row_id`` (``source_groups='lineage'``, the default): a row keeps its
slice through renaming and standardisation. ``'raw'`` takes a group from
the source when the source has a column of that name (rows whose spelling
changed then show up as differences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideprep.constants import DIM_COLUMNS, OUTPUT_NUMERIC_SHARE, TOLERANCE
from pyspark.sql.types import NumericType

from wideprep.functions.numbers import PANDAS_NUMBER, filled_cells, num_comma, ref
from wideprep.functions.text import WS_CHARS
from wideprep.operators.ordinal import ROW_ID

EXACT = "decimal(38,18)"
EXACT_BELOW = 1e15
LINE_CELL, LINE_PERIOD, LINE_GROUP, LINE_GRAND = "cell", "period total", "group total", "grand total"
SUMMARY_SCHEMA = ("source_measure string, output_measure string, input_total double, output_total double, "
                  "difference double, tolerance double, match boolean")


def measure_value(df: DataFrame, name: str) -> Column:
    """Comma-tolerant numeric value of a measure column; NULL (adds nothing) where unparseable or NaN."""
    v = num_comma(F.col(ref(name)), df.schema[name].dataType)
    return F.when(~F.isnan(v), v)


def _sums(cell: str, side: str) -> list[Column]:
    """Partial sums of the cells of one side, read back by :func:`_result`."""
    v = F.col(cell)
    small = F.abs(v) < EXACT_BELOW
    return [F.try_sum(F.when(small, v).cast(EXACT)).alias(f"_{side}_exact"), F.count_if(small).alias(f"_{side}_n"),
            F.sum(F.when(~small, v)).alias(f"_{side}_rough"), F.sum(v).alias(f"_{side}_all")]


def _added(side: str) -> list[Column]:
    """:func:`_sums` of lines that hold such sums; an exact sum that a line could not hold is not held by its total either."""
    exact, n = F.col(f"_{side}_exact"), F.col(f"_{side}_n")
    held = F.bool_and(exact.isNotNull() | (n == 0))
    return [F.when(held, F.try_sum(exact)).alias(f"_{side}_exact"), F.sum(n).alias(f"_{side}_n"),
            F.sum(f"_{side}_rough").alias(f"_{side}_rough"), F.sum(f"_{side}_all").alias(f"_{side}_all")]


def _result(tolerance: float) -> list[Column]:
    """input_total, output_total, difference, match of aggregated :func:`_sums`."""
    def exact(s):
        return F.when(F.col(f"_{s}_n") == 0, F.lit(0).cast(EXACT)).otherwise(F.col(f"_{s}_exact"))

    def rough(s):
        return F.coalesce(F.col(f"_{s}_rough"), F.lit(0.0))

    def total(s):
        return F.coalesce(exact(s).cast("double") + rough(s), F.col(f"_{s}_all"))

    diff = F.coalesce(F.try_subtract(exact("out"), exact("in")).cast("double") + (rough("out") - rough("in")),
                      total("out") - total("in"))
    return [total("in").alias("input_total"), total("out").alias("output_total"), diff.alias("difference"),
            (F.abs(diff) <= F.lit(float(tolerance))).alias("match")]


def reconcile_total(source: DataFrame, output: DataFrame, source_measure: str, output_measure: str,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """One row: source_measure, output_measure, input_total, output_total,
    difference (output - input), tolerance, match (|difference| <= tolerance).
    Missing measure -> zeros and ``match = false``."""
    spark = source.sparkSession
    if source_measure not in source.columns or output_measure not in output.columns:
        return spark.createDataFrame([(source_measure, output_measure, 0.0, 0.0, 0.0, float(tolerance), False)],
                                     SUMMARY_SCHEMA)
    tagged = source.select(F.lit(0).alias("_side"), measure_value(source, source_measure).alias("_v")).unionByName(
        output.select(F.lit(1).alias("_side"), measure_value(output, output_measure).alias("_v")))
    sides = tagged.select(F.when(F.col("_side") == 0, F.col("_v")).alias("_i"), F.when(F.col("_side") == 1, F.col("_v")).alias("_o"))
    totals = sides.agg(*_sums("_i", "in"), *_sums("_o", "out"))
    total_in, total_out, difference, match = _result(tolerance)
    return totals.select(F.lit(source_measure).alias("source_measure"), F.lit(output_measure).alias("output_measure"),
                         total_in, total_out, difference, F.lit(float(tolerance)).alias("tolerance"), match)


def valid_groups(output: DataFrame, groups: list[str] | None) -> list[str]:
    """Group columns present in the output, unique, order kept."""
    return list(dict.fromkeys(g for g in (groups or []) if g in output.columns))


def _paired(source: DataFrame, output: DataFrame, groups: list[str], src_vals: list[Column], out_vals: list[Column],
            row_id: str, source_groups: str) -> DataFrame:
    """Rows with (groups..., _in_i..., _out_i...) for aggregation."""
    n = len(src_vals)
    raw_ok = source_groups == "raw" and all(g in source.columns for g in groups)
    zero = F.lit(None).cast("double")
    if raw_ok or not groups:
        # no lineage needed: tagged union, one aggregate, no join
        s = source.select(*[F.col(f"`{g}`").cast("string").alias(g) for g in groups],
                          *[v.alias(f"_in{i}") for i, v in enumerate(src_vals)],
                          *[zero.alias(f"_out{i}") for i in range(n)])
        o = output.select(*[F.col(f"`{g}`").cast("string").alias(g) for g in groups],
                          *[zero.alias(f"_in{i}") for i in range(n)],
                          *[v.alias(f"_out{i}") for i, v in enumerate(out_vals)])
        return s.unionByName(o)
    if row_id not in source.columns or row_id not in output.columns:
        raise ValueError(f"lineage reconciliation needs {row_id} on both sides")
    s = source.select(F.col(row_id).alias("_sid"), *[v.alias(f"_in{i}") for i, v in enumerate(src_vals)])
    o = output.select(F.col(row_id).alias("_oid"), *[F.col(f"`{g}`").cast("string").alias(g) for g in groups],
                      *[v.alias(f"_out{i}") for i, v in enumerate(out_vals)])
    # full outer: rows dropped on either side still count, under a NULL group
    j = s.join(o, F.col("_sid") == F.col("_oid"), "full_outer")
    if source_groups == "raw":
        raw = [g for g in groups if g in source.columns]
        if raw:
            j = j.join(source.select(F.col(row_id).alias("_rid"), *[F.col(f"`{g}`").cast("string").alias(f"_raw_{g}")
                                                                    for g in raw]),
                       F.col("_sid") == F.col("_rid"), "left")
            return j.select(*[F.col(f"_raw_{g}").alias(g) if g in raw else F.col(g) for g in groups],
                            *[f"_in{i}" for i in range(n)], *[f"_out{i}" for i in range(n)])
    return j.select(*groups, *[f"_in{i}" for i in range(n)], *[f"_out{i}" for i in range(n)])


def reconcile_groups(source: DataFrame, output: DataFrame, source_measure: str, output_measure: str,
                     groups: list[str], tolerance: float = TOLERANCE, row_id: str = ROW_ID,
                     source_groups: str = "lineage", label: bool = False) -> DataFrame:
    """Per slice: groups..., input_total, output_total, difference, match
    (+ ``slice`` label 'a / b' when ``label``). Absent side counts as 0."""
    spark = source.sparkSession
    g = valid_groups(output, groups)
    if not g or source_measure not in source.columns or output_measure not in output.columns:
        return spark.createDataFrame([], "input_total double, output_total double, difference double, match boolean")
    rows = _paired(source, output, g, [measure_value(source, source_measure)], [measure_value(output, output_measure)],
                   row_id, source_groups)
    agg = rows.groupBy(*g).agg(*_sums("_in0", "in"), *_sums("_out0", "out"))
    extra = [slice_label(g).alias("slice")] if label else []
    return agg.select(*g, *extra, *_result(tolerance))


def slice_label(groups: list[str]) -> Column:
    return F.concat_ws(" / ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in groups])


def _cells(df: DataFrame, periods: list[str], keep: list[Column]) -> DataFrame:
    """Sparse long form: (keep..., _p, _v) with the period's place, for the parseable cells only.

    Only filled cells become rows, before any parsing, so the number reader
    runs once per filled cell on one long column instead of once per (row,
    period) in a wide expression.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = all(isinstance(types[p], NumericType) for p in periods)
    cast = "DOUBLE" if numeric else "STRING"
    names = [f"_keep{i}" for i in range(len(keep))]
    long = filled_cells(df, [f"CAST({ref(p)} AS {cast})" for p in periods], keep).select(
        *names, F.col("i").alias("_p"), F.col("v").alias("_raw"))
    value = F.expr("nullif(_raw, double('nan'))") if numeric else num_comma(F.col("_raw"))
    return long.select(*names, "_p", value.alias("_v"))


def reconcile_periods(source: DataFrame, output: DataFrame, periods: list[str] | None = None,
                      groups: list[str] | None = None, tolerance: float = TOLERANCE, row_id: str = ROW_ID,
                      source_groups: str = "lineage", zeros: bool = False, totals: bool = False) -> DataFrame:
    """Every period column at once: (groups..., period, input_total,
    output_total, difference, match). ``totals`` adds a column ``line`` and
    total lines: of each period, of each group, and the grand total, added up
    from the partial sums of the lines, one small row a line.

    Both sides are unpivoted to sparse cells and summed by (groups, period)
    in one hash aggregate (partial aggregation before the shuffle). A source
    cell gets its group from the output row with the same ``_row_id``: one
    join of filled cells with a narrow (_row_id, groups) projection, so no
    wide row is shuffled. ``zeros`` adds the (group, period) pairs without any cell.
    """
    if periods is None:
        periods = [c for c in source.columns if c in output.columns and c != row_id]
    periods = [p for p in periods if p in source.columns and p in output.columns]
    g = valid_groups(output, groups)
    spark = source.sparkSession
    if not periods:
        return spark.createDataFrame([], "period string, input_total double, output_total double, "
                                         "difference double, match boolean")
    none = F.lit(None).cast("double")
    gcols = [F.col(f"`{c}`").cast("string") for c in g]
    kept = [f"_keep{i}" for i in range(len(g))]
    raw = source_groups == "raw" and all(c in source.columns for c in g)
    if not g or raw:
        s = _cells(source, periods, gcols).select(*kept, "_p", F.col("_v").alias("_in"), none.alias("_out"))
    else:
        if row_id not in source.columns or row_id not in output.columns:
            raise ValueError(f"lineage reconciliation needs {row_id} on both sides")
        og = output.select(F.col(row_id).alias("_oid"), *[c.alias(f"_g{i}") for i, c in enumerate(gcols)])
        cells = _cells(source, periods, [F.col(row_id)]).select(F.col("_keep0").alias("_sid"), "_p", "_v")
        s = cells.join(og, F.col("_sid") == F.col("_oid"), "left").select(
            *[F.col(f"_g{i}").alias(k) for i, k in enumerate(kept)], "_p", F.col("_v").alias("_in"), none.alias("_out"))
    o = _cells(output, periods, gcols).select(*kept, "_p", none.alias("_in"), F.col("_v").alias("_out"))
    both = s.unionByName(o)
    if zeros:
        grid = output.select(*[c.alias(k) for c, k in zip(gcols, kept)]).distinct() if g else spark.range(1).select()
        both = both.unionByName(grid.select(*kept, F.explode(F.sequence(F.lit(0), F.lit(len(periods) - 1))).alias("_p"),
                                            none.alias("_in"), none.alias("_out")))
    agg = both.groupBy(*kept, "_p").agg(*_sums("_in", "in"), *_sums("_out", "out"))
    named = F.array(*[F.lit(p) for p in periods])[F.col("_p")].alias("period")
    agg = agg.select(*[F.col(k).alias(c) for k, c in zip(kept, g)], named, *[c for c in agg.columns if c not in kept and c != "_p"])
    if not totals:
        return agg.select(*g, "period", *_result(tolerance))
    of_groups = [F.col(ref(c)) for c in g]
    sets = [[*of_groups, F.col("period")], [F.col("period")], of_groups, []] if g else [[F.col("period")], []]
    lines = agg.groupingSets(sets, *of_groups, F.col("period")).agg(
        *_added("in"), *_added("out"), F.grouping("period").alias("_over_periods"), (F.grouping(g[0]) if g else F.lit(0)).alias("_over_groups"))
    over_groups, over_periods = F.col("_over_groups") == 1, F.col("_over_periods") == 1
    if not g:
        line = F.when(over_periods, LINE_GRAND).otherwise(LINE_CELL)
    else:
        line = F.when(over_groups & over_periods, LINE_GRAND).when(over_groups, LINE_PERIOD).when(over_periods, LINE_GROUP).otherwise(LINE_CELL)
    return lines.select(line.alias("line"), *g, "period", *_result(tolerance))


def slice_candidates(source: DataFrame, output: DataFrame, row_id: str = ROW_ID) -> list[str]:
    """Columns a reconciliation may be sliced by: the output's dimensions, then other columns both sides have."""
    dims = [c for c in DIM_COLUMNS.values() if c in output.columns]
    return dims + [c for c in source.columns if c in output.columns and c not in dims and c != row_id]


def measure_shares(output: DataFrame) -> DataFrame:
    """column_name, parsed, is_measure for every column: cells that are plain numbers (no commas), and whether their share
    of all rows is above ``OUTPUT_NUMERIC_SHARE``. Cells are unpivoted, empty ones dropped, each read once."""
    cols = output.columns
    long = filled_cells(output, ["'0'"] + [f"CAST({ref(c)} AS STRING)" for c in cols]).select((F.col("i") - 1).alias("i"), "v")
    text = F.btrim("v", F.lit(WS_CHARS))
    groups = long.select("i", F.when(text.rlike(PANDAS_NUMBER), text.try_cast("double")).alias("num")).groupBy("i").agg(
        F.count("num").alias("n"))
    found = groups.agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("found"))  # one entry a column
    listed = found.select(F.posexplode(F.array(*[F.lit(c) for c in cols])).alias("i", "column_name"),
                          F.coalesce(F.try_element_at("found", F.lit(-1)), F.lit(0)).alias("rows"), "found")
    parsed = F.coalesce(F.try_element_at("found", F.col("i")), F.lit(0))
    return listed.select("column_name", parsed.alias("parsed"),
                         F.coalesce(F.try_divide(parsed, "rows") > OUTPUT_NUMERIC_SHARE, F.lit(False)).alias("is_measure"))


def output_measures(output: DataFrame) -> list[str]:
    """Names of the output's measure columns."""
    names = {r["column_name"] for r in measure_shares(output).where("is_measure").collect()}
    return [c for c in output.columns if c in names]
