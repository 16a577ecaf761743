"""``shipments``: an untidy wide client table derived from the driver tables.

One row per ``lineitem`` row, joined to its order, customer, nation, region
and part. Every cell is text, the way a raw upload arrives; dirt is injected
by deterministic rules on the keys (NULLs, blank spellings, case and space
variants, thousands separators, four date spellings, sign flips for
returned lines), so the same table can be rebuilt in any SQL dialect.
Period columns are the line's extended price pivoted by ship month over an
explicit month list (a pivot without an explicit list would need an extra
pass to find the values, and its schema would depend on the data).

The joined, narrow rows are materialised once per session with a dense
``_row_id`` in lineitem key order (see ``operators.ordinal``) and reused by every
query; a large table is joined and sorted in ranges of its orders, so that the shuffle
files of one range at most lie on disk. The cells are made of them row by row where they are read, so a query pays
for the columns it reads, and the wide table is neither written nor shuffled.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideprep.operators.ordinal import ROW_ID, numbered, store_sorted
from wideprep.session import wide_rows
from wideprep.sources.tables import read_table

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
YEARS = tuple(range(1995, 2002))
# (header, year, month) for every period column, in calendar order
PERIODS = tuple((f"{MONTHS[m - 1]}_{y}", y, m) for y in YEARS for m in range(1, 13))
PERIOD_COLUMNS = tuple(p[0] for p in PERIODS)
DIM_HEADERS = (
    "COUNTRY_NAME", "SALES_ZONE", "TRADE_TYPE", "SHIP_TO_CITY", "PROD_GROUP",
    "BRAND_DESC", "ITEM_CODE", "MEASURE", "SHIP_DATE", "ORDER_NO", "LINE_NO",
)
HEADERS = DIM_HEADERS + PERIOD_COLUMNS
# unique order of lineitem rows (whole rows are distinct)
ORDER_KEYS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
SORT_ONLY = ("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus")
# what the cells read of the joined tables, besides the order keys
BASE_COLUMNS = ("c_custkey", "n_nationkey", "n_name", "r_name", "c_mktsegment", "p_name", "p_brand", "p_type")


def shipment_columns() -> list[Column]:
    """The text columns of ``shipments`` over the joined driver tables (``BASE_COLUMNS``)."""
    ck, ok, pk, ln = F.col("c_custkey"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    country = (
        F.when(ck % 97 == 0, F.lit(None).cast("string"))
        .when(ck % 89 == 0, F.lit(" N/A "))
        .when(F.col("n_nationkey") == 0, F.lit("IND"))
        .when(F.col("n_nationkey") == 1, F.lit("usa"))
        .when(F.col("n_nationkey") == 2, F.lit("United  Kingdom"))
        .when(ck % 7 == 0, F.lower("n_name"))
        .otherwise(F.col("n_name"))
    )
    zone = F.when(ok % 53 == 0, F.lit("-")).when(ck % 5 == 0, F.lower("r_name")).otherwise(F.col("r_name"))
    seg = F.col("c_mktsegment")
    trade = (
        F.when(ok % 59 == 0, F.lit(None).cast("string"))
        .when(seg == "AUTOMOBILE", F.lit("online"))
        .when(seg == "BUILDING", F.lit("Modern trade"))
        .when(seg == "FURNITURE", F.lit(" general  trade "))
        .when(seg == "HOUSEHOLD", F.lit("household"))
        .otherwise(F.lit("Cash and Carry"))
    )
    city = F.concat(F.lower("n_name"), F.lit(" city "), (ck % 4).cast("string"))
    group = F.when(pk % 31 == 0, F.lit("n/a")).otherwise(F.col("p_type"))
    brand = F.when(pk % 13 == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    item = F.when(ln == 2, F.concat(F.col("p_name"), F.lit(" / "), pk.cast("string"))).otherwise(
        F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.lit("-"), pk.cast("string"))
    )
    measure = F.when(ok % 101 == 0, F.lit(None).cast("string")).when(ln % 2 == 0, F.lit("Value")).otherwise(
        F.lit("sales value")
    )
    sd = F.col("l_shipdate")
    spelling = (ok + ln) % 4
    ship_date = (
        F.when(ok % 41 == 0, F.lit(None).cast("string"))
        .when(spelling == 0, F.date_format(sd, "yyyy-MM-dd"))
        .when(spelling == 1, F.date_format(sd, "dd/MM/yyyy"))
        .when(spelling == 2, F.date_format(sd, "yyyyMMdd"))
        .otherwise(F.datediff(F.to_date(sd), F.lit("1899-12-30").cast("date")).cast("string"))
    )
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    amount_text = F.when(ok % 3 == 0, F.format_number(amount, 2)).otherwise(
        amount.cast("decimal(18,2)").cast("string")
    )
    return [
        country.alias("COUNTRY_NAME"), zone.alias("SALES_ZONE"), trade.alias("TRADE_TYPE"),
        city.alias("SHIP_TO_CITY"), group.alias("PROD_GROUP"), brand.alias("BRAND_DESC"),
        item.alias("ITEM_CODE"), measure.alias("MEASURE"), ship_date.alias("SHIP_DATE"),
        ok.cast("string").alias("ORDER_NO"), ln.cast("string").alias("LINE_NO"),
        amount_text.alias("_amount"), F.year(sd).alias("_y"), F.month(sd).alias("_m"),
    ]


def period_columns() -> list[Column]:
    """Pivot of ``_amount`` by (``_y``, ``_m``) over the explicit month list;
    one parsed SQL expression per column keeps plan building cheap."""
    return [F.expr(f"CASE WHEN _y = {y} AND _m = {m} THEN _amount END AS {name}") for name, y, m in PERIODS]


def check_months(lineitem: DataFrame) -> None:
    """No line may fall outside the period columns, where its amount would be lost (minimum and maximum come from
    the file footers)."""
    span = lineitem.agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")).first()
    for day in (span["first"], span["last"]):
        if day is not None and day.year not in YEARS:
            raise ValueError(f"lines shipped on {day} have no period column; extend YEARS")


# lines that are joined and sorted at once; shuffle files of more than these never lie on disk together
LINES_A_SLICE = 24_000_000


def order_ranges(lineitem: DataFrame, lines: int | None = None) -> list[Column]:
    """Conditions that cut the lines, by ranges of the leading order key, into slices of about ``lines`` (all of an order lie in
    one, so a slice may be larger), in order. A line without an order key, which no join keeps, is in none."""
    count = lineitem.count()  # from the file footers
    n = -(-count // (lines or LINES_A_SLICE))
    if n <= 1:
        return [F.lit(True)]
    at = [i / n for i in range(1, n)]
    bounds = sorted(set(lineitem.agg(F.percentile_approx("l_orderkey", at, 1000)).first()[0] or []))
    key = F.col("l_orderkey")
    return [key < bounds[0], *[(key >= a) & (key < b) for a, b in zip(bounds, bounds[1:])], key >= bounds[-1]] if bounds else [F.lit(True)]


def joined_lines(spark: SparkSession, sf_dir: str, lines: Column | None = None) -> DataFrame:
    """The lineitem order keys and what ``shipment_columns`` reads (not yet ordinalled): narrow, typed rows, so that
    the sort never moves the wide table. ``lines``: a condition on the lines wanted, by default all.

    Orders meet their customers first, so the lines are shuffled twice, by order and by part; their names come last, by
    broadcast (nation, region). Catalyst/AQE choose shuffle joins for orders, customer and part once those outgrow the
    broadcast threshold.
    """
    t = lambda n: read_table(spark, sf_dir, n)
    li = t("lineitem") if lines is None else t("lineitem").where(lines)
    customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = t("orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        li.join(orders.drop("o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(F.broadcast(t("nation").select("n_nationkey", "n_name", "n_regionkey")),
              F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(t("region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(*ORDER_KEYS, *BASE_COLUMNS)


def widened(lines: DataFrame) -> DataFrame:
    """The dirty, wide table of :func:`joined_lines`, row by row; numbered if they are."""
    rid = [ROW_ID] if ROW_ID in lines.columns else []
    text = lines.select(*rid, *shipment_columns())
    return text.select(*rid, *DIM_HEADERS, *period_columns())


_CACHE: dict[tuple, DataFrame] = {}
_LOCK = threading.RLock()


def shipment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`shipments` in any order and without ``_row_id``, for readers that need neither: the joined lines are
    neither sorted nor stored. Where :func:`shipments` has stored them, they are read there."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        stored = _CACHE.get(key)
    if stored is not None:
        return stored.drop(ROW_ID)
    check_months(read_table(spark, sf_dir, "lineitem"))
    wide_rows(spark)
    return widened(joined_lines(spark, sf_dir))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_row_id`` + the text columns of ``HEADERS``; their rows are joined, sorted and numbered once per session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _CACHE:
            lineitem = read_table(spark, sf_dir, "lineitem")
            check_months(lineitem)
            wide_rows(spark)
            slices = (joined_lines(spark, sf_dir, some) for some in order_ranges(lineitem))
            stored = store_sorted(slices, [F.col(k) for k in ORDER_KEYS], name="shipments", drop=SORT_ONLY)
            _CACHE[key] = widened(numbered(stored))
        return _CACHE[key]
