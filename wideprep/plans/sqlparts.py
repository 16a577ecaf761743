"""DuckDB twins of the column expressions, used to write the oracle SQL.

Each helper takes SQL text and returns SQL text computing the same value as
the Spark expression of the same name (on ASCII data: DuckDB's regex
``\\s`` is ASCII only).
"""

from __future__ import annotations

from wideprep.constants import BLANK_TOKENS
from wideprep.sources.fixtures import ORDER_KEYS, PERIODS

BLANKS = ", ".join("'" + t + "'" for t in BLANK_TOKENS)


def q(s: str) -> str:
    """Quote a text literal."""
    return "'" + s.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR lower({strip_ws(x)}) IN ({BLANKS}))"


def clean_text(x: str) -> str:
    s = f"regexp_replace({strip_ws(x)}, '\\s+', ' ', 'g')"
    return f"(CASE WHEN {x} IS NULL OR lower({s}) IN ({BLANKS}) THEN '' ELSE {s} END)"


def py_title(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '') END)")


def sku_text(x: str) -> str:
    return f"upper(regexp_replace({clean_text(x)}, '[^A-Za-z0-9_-]', '', 'g'))"


def num_comma(x: str) -> str:
    t = f"replace({x}, ',', '')"
    return (f"(CASE WHEN regexp_matches({t}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') "
            f"THEN try_cast(trim({t}) AS DOUBLE) END)")


def num_filter(x: str) -> str:
    t = f"regexp_replace({x}, '[^0-9.\\-]', '', 'g')"
    return f"(CASE WHEN regexp_matches({t}, '^-?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast({t} AS DOUBLE) END)"


def money(x: str) -> str:
    """Exact sum of cent amounts, back to double."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,4))) AS DOUBLE)"


SHIPMENT_ORDER = ", ".join(ORDER_KEYS)


def shipments_cte() -> str:
    """``shipments`` as a CTE body with ``_row_id`` (same rules as the Spark builder)."""
    amount = "(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END)"
    amount_text = (f"(CASE WHEN o_orderkey % 3 = 0 THEN format('{{:,.2f}}', {amount}) "
                   f"ELSE CAST(CAST({amount} AS DECIMAL(18,2)) AS VARCHAR) END)")
    periods = ",\n    ".join(
        f"CASE WHEN year(l_shipdate) = {y} AND month(l_shipdate) = {m} THEN {amount_text} END AS {name}"
        for name, y, m in PERIODS
    )
    return f"""
SELECT
    row_number() OVER (ORDER BY {SHIPMENT_ORDER}) AS _row_id,
    CASE WHEN c_custkey % 97 = 0 THEN NULL
         WHEN c_custkey % 89 = 0 THEN ' N/A '
         WHEN n_nationkey = 0 THEN 'IND'
         WHEN n_nationkey = 1 THEN 'usa'
         WHEN n_nationkey = 2 THEN 'United  Kingdom'
         WHEN c_custkey % 7 = 0 THEN lower(n_name)
         ELSE n_name END AS COUNTRY_NAME,
    CASE WHEN o_orderkey % 53 = 0 THEN '-' WHEN c_custkey % 5 = 0 THEN lower(r_name) ELSE r_name END AS SALES_ZONE,
    CASE WHEN o_orderkey % 59 = 0 THEN NULL
         WHEN c_mktsegment = 'AUTOMOBILE' THEN 'online'
         WHEN c_mktsegment = 'BUILDING' THEN 'Modern trade'
         WHEN c_mktsegment = 'FURNITURE' THEN ' general  trade '
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'household'
         ELSE 'Cash and Carry' END AS TRADE_TYPE,
    lower(n_name) || ' city ' || CAST(c_custkey % 4 AS VARCHAR) AS SHIP_TO_CITY,
    CASE WHEN p_partkey % 31 = 0 THEN 'n/a' ELSE p_type END AS PROD_GROUP,
    CASE WHEN p_partkey % 13 = 0 THEN lower(p_brand) ELSE p_brand END AS BRAND_DESC,
    CASE WHEN l_linenumber = 2 THEN p_name || ' / ' || CAST(p_partkey AS VARCHAR)
         ELSE upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR) END AS ITEM_CODE,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'Value' ELSE 'sales value' END AS MEASURE,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL
         WHEN (o_orderkey + l_linenumber) % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
         WHEN (o_orderkey + l_linenumber) % 4 = 1 THEN strftime(l_shipdate, '%d/%m/%Y')
         WHEN (o_orderkey + l_linenumber) % 4 = 2 THEN strftime(l_shipdate, '%Y%m%d')
         ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR) END AS SHIP_DATE,
    CAST(o_orderkey AS VARCHAR) AS ORDER_NO,
    CAST(l_linenumber AS VARCHAR) AS LINE_NO,
    {periods}
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""


_ISO = r"^\d{4}-\d{1,2}(-\d{1,2})?([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"
_TEXT_FORMATS = ["%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%d-%B-%Y",
                 "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%b %Y", "%B %Y"]
_MONTH_FIRST = ["%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S"]
_DAY_FIRST = ["%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S"]


def parse_date(x: str, dayfirst: bool = False) -> str:
    """DATE from mixed text: 8 digits, spreadsheet serial, ISO, declared formats."""
    t = strip_ws(x)
    fmts = _TEXT_FORMATS + (_DAY_FIRST + _MONTH_FIRST if dayfirst else _MONTH_FIRST + _DAY_FIRST)
    flist = "[" + ", ".join(q(f) for f in fmts) + "]"
    return (f"(CASE WHEN regexp_full_match({t}, '\\d{{8}}') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) "
            f"WHEN regexp_full_match({t}, '\\d{{4,5}}(\\.0)?') THEN "
            f"DATE '1899-12-30' + CAST(regexp_extract({t}, '^(\\d{{4,5}})', 1) AS INTEGER) "
            f"ELSE CAST(coalesce(CASE WHEN regexp_matches({t}, {q(_ISO)}) THEN try_cast({t} AS TIMESTAMP) END, "
            f"try_strptime({t}, {flist})) AS DATE) END)")


def standardize_date(x: str, pattern: str, dayfirst: bool) -> str:
    return f"coalesce(strftime({parse_date(x, dayfirst)}, {q(pattern)}), {strip_ws(x)})"
