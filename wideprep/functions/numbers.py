"""The three number readers (Column -> Column of double).

* ``num_comma``  - remove commas, then parse the whole text (profiling,
  negatives, reconciliation).  ``'$1,234'`` is not a number here.
* ``num_filter`` - remove everything but digits, ``.`` and ``-``, then parse
  (period columns of the standardised output). ``'$1,234'`` -> 1234.
* ``is_float_text`` - would Python ``float()`` accept the text after comma
  removal (export formula guard)?

Spark's ``try_cast('1d' as double)`` is 1.0 and ``'nan'`` gives NaN, so every
cast is guarded by a strict pattern, and NaN / overflow become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wideprep.functions.text import WS, WS_CHARS, _col

# text accepted by a pandas numeric parse (after comma removal and strip)
_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_INF = r"[+-]?(?i:inf|infinity)"
PANDAS_NUMBER = rf"^(?:{_NUM}|{_INF})$"
# Python float() grammar: digit groups may use single underscores
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT = (
    rf"(?U)^{WS}*[+-]?(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?"
    rf"|(?i:nan|inf|infinity)){WS}*$"
)
_INFINITY = float("inf")


def num_comma(c, dtype=None) -> Column:
    """pandas ``to_numeric(str(x).replace(',', ''), errors='coerce')``.
    Numeric columns pass through (pass ``dtype`` from the schema)."""
    if dtype is not None and isinstance(dtype, NumericType):
        return _col(c).cast("double")
    t = F.btrim(F.replace(_col(c).cast("string"), F.lit(","), F.lit("")), F.lit(WS_CHARS))
    v = F.when(t.rlike(PANDAS_NUMBER), t.try_cast("double"))
    # an overflowing literal (1e400) is not a number to pandas; 'inf' is
    overflow = (F.abs(v) == F.lit(_INFINITY)) & ~F.lower(t).contains("inf")
    return F.when(overflow, F.lit(None)).otherwise(v).cast("double")


def num_filter(c, dtype=None) -> Column:
    """Keep only digits, '.' and '-' (commas first), then parse; else NULL.
    After the filter Spark's double cast accepts exactly what Python's
    float() accepts ('-', '.', '1.2.3', '5-' fail in both)."""
    if dtype is not None and isinstance(dtype, NumericType):
        return _col(c).cast("double")
    t = F.regexp_replace(_col(c).cast("string"), r"[^0-9.\-]", "")
    return t.try_cast("double")


def is_float_text(c) -> Column:
    """Python ``float(x.replace(',', ''))`` succeeds."""
    return F.replace(_col(c).cast("string"), F.lit(","), F.lit("")).rlike(PY_FLOAT)


# --- SQL-text forms -------------------------------------------------------------
# The same readers as Spark SQL text over a column reference. A wide table
# needs one expression per period column; building each from Python Column
# calls costs dozens of driver round trips, a parsed string costs one.


def sql_literal(text: str) -> str:
    """Spark SQL string literal (backslashes, quotes and controls escaped)."""
    out = []
    for ch in text:
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ord(ch) < 0x20 or ord(ch) > 0x7E:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def num_comma_array_sql(cells_sql: str) -> str:
    """:func:`num_comma` over an array of text cells, one reader for all
    cells, so the plan does not grow with the table's width. An empty cell
    (most of a wide table) costs one test, a plain number one more."""
    t = f"btrim(replace(x, ',', ''), {sql_literal(WS_CHARS)})"
    value = (f"CASE WHEN x IS NULL THEN NULL WHEN x RLIKE '^-?[0-9]{{1,15}}(?:[.][0-9]{{1,15}})?$' THEN try_cast(x AS DOUBLE) "
             f"WHEN {t} RLIKE {sql_literal(f'^(?:{_NUM})$')} THEN if(abs(try_cast({t} AS DOUBLE)) = double('infinity'), "
             f"NULL, try_cast({t} AS DOUBLE)) WHEN {t} RLIKE {sql_literal(f'^(?:{_INF})$')} THEN try_cast({t} AS DOUBLE) END")
    return f"transform({cells_sql}, x -> {value})"


def filled_cells_sql(cells_sql: list[str]) -> str:
    """Generator of (i, v): the cells of a row that are not NULL, with their
    place from 0. The empty ones of a wide table never become rows."""
    cells = ", ".join(f"named_struct('i', {i}, 'v', {c})" for i, c in enumerate(cells_sql))
    return f"inline(filter(array({cells}), x -> x.v IS NOT NULL))"


def filled_cells(df: DataFrame, cells_sql: list[str], keep: Sequence[Column] = ()) -> DataFrame:
    """(keep..., i, v): the cells of :func:`filled_cells_sql`. Only the places of filled cells become rows, and each looks its
    cell up, so an empty cell costs one test in compiled code. The cells must be of one type."""
    kept = [k.alias(f"_keep{n}") for n, k in enumerate(keep)]
    names = [f"_keep{n}" for n in range(len(kept))]
    places = ", ".join(f"if({c} IS NULL, NULL, {i})" for i, c in enumerate(cells_sql))
    packed = df.select(*kept, F.expr(f"array({', '.join(cells_sql)})").alias("_cells"),
                       F.expr(f"array_except(array({places}), array(CAST(NULL AS INT)))").alias("_places"))
    # outer: Spark would else test the places before the unpivot, and work them out twice
    long = packed.select(*names, "_cells", F.explode_outer("_places").alias("i")).where(F.col("i").isNotNull())
    return long.select(*names, "i", F.get("_cells", F.col("i")).alias("v"))


def num_filter_sql(col_sql: str) -> str:
    return f"try_cast(regexp_replace(CAST({col_sql} AS STRING), '[^0-9.-]', '') AS DOUBLE)"
