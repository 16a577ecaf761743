"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code path: the fixture, the mapping that
classification must arrive at, and every rule are spelled out in SQL over
the pre-registered driver tables.
"""

from __future__ import annotations

from wideprep.constants import (
    ALIASES,
    DIM_COLUMNS,
    DIMS,
    REQUIRED_DIMS,
    STANDARDS,
    TIME_PATTERNS,
)
from wideprep.plans.sqlparts import (
    parse_date,
    clean_text,
    ident,
    is_blank,
    money,
    num_comma,
    num_filter,
    py_title,
    q,
    shipments_cte,
    sku_text,
)
from wideprep.sources.fixtures import HEADERS, PERIOD_COLUMNS
from wideprep.sources.tables import TABLES

# the mapping the header rules give for the shipments headers
SHIPMENT_MAPPING = {
    "Country": "COUNTRY_NAME",
    "Region": "SALES_ZONE",
    "Channel": "TRADE_TYPE",
    "City/State": "SHIP_TO_CITY",
    "Category": "PROD_GROUP",
    "Brand": "BRAND_DESC",
    "SKU": "ITEM_CODE",
    "Fact": "MEASURE",
}


def _lookup(x: str, d: dict[str, str]) -> str:
    cleaned = clean_text(x)
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in d.items())
    return f"(CASE lower({cleaned}) {whens} ELSE {py_title(cleaned)} END)"


def output_cte() -> str:
    """CTE chain: shipments -> std -> output (with _row_id)."""
    m = SHIPMENT_MAPPING
    dims = {
        "Country": _lookup(m["Country"], STANDARDS["country"]),
        "Region": _lookup(m["Region"], STANDARDS["region"]),
        "Channel": _lookup(m["Channel"], STANDARDS["channel"]),
        "SKU": sku_text(m["SKU"]),
    }
    for d in ("City/State", "Category", "Brand", "Fact"):
        dims[d] = py_title(clean_text(m[d]))
    dim_sql = ",\n    ".join(f"{dims[d]} AS {DIM_COLUMNS[d]}" for d in DIMS)
    per_sql = ",\n    ".join(f"{num_filter(p)} AS {p}" for p in PERIOD_COLUMNS)
    filled = " + ".join(f"CAST({DIM_COLUMNS[d]} <> '' AS INTEGER)" for d in DIMS)
    complete = " AND ".join(f"{DIM_COLUMNS[d]} <> ''" for d in REQUIRED_DIMS)
    dcols = ", ".join(DIM_COLUMNS[d] for d in DIMS)
    pcols = ", ".join(PERIOD_COLUMNS)
    return f"""shipments AS ({shipments_cte()}),
std AS (
  SELECT _row_id,
    {dim_sql},
    {per_sql}
  FROM shipments
),
scored AS (
  SELECT *, CAST(round_even(100.0 * ({filled}) / 8, 0) AS INTEGER) AS confidence, ({complete}) AS _complete
  FROM std
),
output AS (
  SELECT _row_id, printf('REC-%07d', _row_id) AS record_id, {dcols}, {pcols}, confidence,
    CASE WHEN NOT _complete THEN 'Incomplete' WHEN confidence >= 90 THEN 'Approved' ELSE 'Needs Review' END AS status,
    CASE WHEN confidence >= 90 THEN 'Rules and Standards' WHEN confidence >= 70 THEN 'Rules and History'
         ELSE 'Unresolved / Manual' END AS recommendation_source,
    '' AS analyst_comment
  FROM scored
)"""


def _row_total() -> str:
    return " + ".join(f"coalesce(CAST({p} AS DECIMAL(38,6)), 0)" for p in PERIOD_COLUMNS)


def standardize_shipments() -> str:
    dcols = ", ".join(DIM_COLUMNS[d] for d in DIMS)
    return f"""WITH {output_cte()}
SELECT record_id, {dcols}, {", ".join(PERIOD_COLUMNS)}, confidence, status, recommendation_source, analyst_comment
FROM output"""


def shipments_by_channel_brand() -> str:
    return f"""WITH {output_cte()}
SELECT channel, brand, count(*) AS records, count(CASE WHEN status = 'Approved' THEN 1 END) AS approved,
       CAST(sum({_row_total()}) AS DOUBLE) AS total_value
FROM output GROUP BY channel, brand"""


def record_ids() -> str:
    return f"""WITH shipments AS ({shipments_cte()})
SELECT ORDER_NO, LINE_NO, printf('REC-%07d', _row_id) AS record_id FROM shipments"""


def quality_report() -> str:
    return f"WITH {output_cte()}\n{_report('output')}"


def _report(table: str) -> str:
    checks = []
    for d in REQUIRED_DIMS:
        checks.append(f"SELECT record_id, 'Error' AS severity, {q(d)} AS field, 'Required value missing' AS issue, "
                      f"{q(f'Provide or approve {d}.')} AS recommendation FROM {table} WHERE {is_blank(DIM_COLUMNS[d])}")
    checks.append("SELECT record_id, 'Warning', 'Region', 'Region unavailable', 'Derive from City/State or review.' "
                  f"FROM {table} WHERE {is_blank('region')}")
    return "\nUNION ALL\n".join(checks)


def status_counts() -> str:
    return f"""WITH {output_cte()}
SELECT count(*) AS total_rows,
  count(CASE WHEN status = 'Approved' THEN 1 END) AS approved,
  count(CASE WHEN status = 'Needs Review' THEN 1 END) AS needs_review,
  count(CASE WHEN status = 'Incomplete' THEN 1 END) AS incomplete,
  count(CASE WHEN status = 'Rejected' THEN 1 END) AS rejected
FROM output"""


def _exact(x: str) -> str:
    return f"CAST(coalesce({x}, 0) AS DECIMAL(38,6))"


def reconcile_total() -> str:
    m = "JAN_1998"
    return f"""WITH {output_cte()},
t AS (
  SELECT (SELECT sum({_exact(num_comma(m))}) FROM shipments) AS i,
         (SELECT sum({_exact(num_comma(f"CAST({m} AS VARCHAR)"))}) FROM output) AS o
)
SELECT {q(m)} AS source_measure, {q(m)} AS output_measure, CAST(coalesce(i, 0) AS DOUBLE) AS input_total,
       CAST(coalesce(o, 0) AS DOUBLE) AS output_total, CAST(coalesce(o, 0) - coalesce(i, 0) AS DOUBLE) AS difference,
       0.01 :: DOUBLE AS tolerance, abs(coalesce(o, 0) - coalesce(i, 0)) <= 0.01 AS match
FROM t"""


def reconcile_slices() -> str:
    m = "JAN_1998"
    return f"""WITH {output_cte()},
j AS (
  SELECT o.channel, o.brand, {_exact(num_comma('s.' + m))} AS vin,
         {_exact(num_comma(f"CAST(o.{m} AS VARCHAR)"))} AS vout
  FROM shipments s FULL OUTER JOIN output o ON s._row_id = o._row_id
),
g AS (SELECT channel, brand, sum(vin) AS i, sum(vout) AS o FROM j GROUP BY channel, brand)
SELECT channel, brand, concat_ws(' / ', coalesce(channel, 'None'), coalesce(brand, 'None')) AS slice,
       CAST(i AS DOUBLE) AS input_total, CAST(o AS DOUBLE) AS output_total, CAST(o - i AS DOUBLE) AS difference,
       abs(o - i) <= 0.01 AS match
FROM g"""


def reconcile_periods() -> str:
    ins = ", ".join(f"sum({_exact(num_comma('s.' + p))}) AS i_{p}" for p in PERIOD_COLUMNS)
    outs = ", ".join(f"sum({_exact(num_comma(f'CAST(o.{p} AS VARCHAR)'))}) AS o_{p}" for p in PERIOD_COLUMNS)
    unp = "\nUNION ALL ".join(
        f"SELECT region, {q(p)} AS period, i_{p} AS i, o_{p} AS o FROM g" for p in PERIOD_COLUMNS)
    return f"""WITH {output_cte()},
g AS (
  SELECT o.region, {ins}, {outs}
  FROM shipments s FULL OUTER JOIN output o ON s._row_id = o._row_id
  GROUP BY o.region
),
l AS ({unp})
SELECT region, period, CAST(i AS DOUBLE) AS input_total, CAST(o AS DOUBLE) AS output_total,
       CAST(o - i AS DOUBLE) AS difference, abs(o - i) <= 0.01 AS match
FROM l"""


def reconcile_period_totals() -> str:
    base = reconcile_periods()
    head, tail = base.rsplit("\nSELECT region, period,", 1)
    return f"""{head}
SELECT CASE WHEN grouping(region) = 0 AND grouping(period) = 0 THEN 'cell' WHEN grouping(period) = 0 THEN 'period total'
            WHEN grouping(region) = 0 THEN 'group total' ELSE 'grand total' END AS line,
       region, period, CAST(sum(i) AS DOUBLE) AS input_total, CAST(sum(o) AS DOUBLE) AS output_total,
       CAST(sum(o) - sum(i) AS DOUBLE) AS difference, abs(sum(o) - sum(i)) <= 0.01 AS match
FROM l GROUP BY GROUPING SETS ((region, period), (period), (region), ())"""


def _lcs(a: str, b: str) -> str:
    """LCS length of SQL strings a, b (DP rows with list_reduce)."""
    inner = (f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, "
             f"CASE WHEN ch = substr({b}, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0])")
    rows = f"list_reduce(split({a}, ''), lambda prev, ch: {inner}, list_resize([0], length({b}) + 1, 0))"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE {rows}[-1] END)"


def classify_headers() -> str:
    tables = ", ".join(q(t) for t in TABLES)
    ship = ", ".join(f"('shipments', {i + 1}, {q(h)})" for i, h in enumerate(HEADERS))
    return _classified(f"""SELECT DISTINCT table_name AS dataset, CAST(ordinal_position AS INTEGER) AS col_ordinal, column_name AS source_column
  FROM information_schema.columns WHERE table_name IN ({tables})
  UNION ALL SELECT * FROM (VALUES {ship}) v(dataset, col_ordinal, source_column)""")


def _classified(catalogue: str) -> str:
    alias_rows = ", ".join(f"({q(f)}, {q(a)})" for f, al in ALIASES.items() for a in al)
    time_re = "|".join(f"(?:{p})" for p in TIME_PATTERNS)
    ratio = f"(2.0 * {_lcs('c.n', 'a.alias')} / (length(c.n) + length(a.alias)))"
    return f"""WITH cat AS ({catalogue}),
h AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(trim(source_column)), '[_/\\\\|\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n
  FROM cat
),
c AS (SELECT DISTINCT n FROM h),
a AS (SELECT * FROM (VALUES {alias_rows}) v(field, alias)),
s AS (
  SELECT c.n, a.field,
    CASE WHEN c.n = a.alias THEN 1.0
         WHEN list_has_all(string_split(c.n, ' '), string_split(a.alias, ' ')) THEN 0.95
         WHEN {ratio} >= 0.70 THEN {ratio}
         ELSE 0.0 END AS score
  FROM c, a
),
b AS (SELECT n, max(score) AS score, arg_max(field, struct_pack(s := score, f := field)) AS field FROM s GROUP BY n)
SELECT dataset, col_ordinal, source_column,
  CASE WHEN regexp_matches(n, {q(time_re)}, 'i') THEN 'Time Period'
       WHEN score < 0.45 THEN 'Ignore' ELSE field END AS target_field,
  CASE WHEN regexp_matches(n, {q(time_re)}, 'i') THEN 1.0 ELSE round(score, 3) END :: DOUBLE AS confidence,
  CASE WHEN regexp_matches(n, {q(time_re)}, 'i') THEN 'Time rule'
       WHEN score < 0.45 THEN 'AI review' WHEN score >= 0.85 THEN 'Rule/Dictionary' ELSE 'AI candidate' END AS method,
  (regexp_matches(n, {q(time_re)}, 'i') OR score >= 0.9) AS user_confirmed
FROM h JOIN b USING (n)"""


ORACLE = {
    "shipments_by_channel_brand": shipments_by_channel_brand,
    "standardize_shipments": standardize_shipments,
    "record_ids": record_ids,
    "quality_report": quality_report,
    "status_counts": status_counts,
    "reconcile_total": reconcile_total,
    "reconcile_slices": reconcile_slices,
    "reconcile_periods": reconcile_periods,
    "reconcile_period_totals": reconcile_period_totals,
    "classify_headers": classify_headers,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}


# --- profiling ----------------------------------------------------------------------
_DATE_HINTS = ("date", "period", "month", "week", "year")


def _profile_cte() -> str:
    ords = ", ".join(f"({q(h)}, {i + 1})" for i, h in enumerate(HEADERS))
    hint = " OR ".join(f"contains(lower(column_name), {q(h)})" for h in _DATE_HINTS)
    return f"""shipments AS ({shipments_cte()}),
long AS (SELECT _row_id, column_name, v FROM shipments
         UNPIVOT INCLUDE NULLS (v FOR column_name IN ({", ".join(HEADERS)}))),
agg AS (
  SELECT column_name, count(*) AS n, count_if({is_blank('v')}) AS missing,
         count({num_comma('v')}) AS parsed, count_if({num_comma('v')} < 0) AS neg
  FROM long GROUP BY column_name
),
dates AS (
  SELECT column_name, avg(CASE WHEN {parse_date('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share
  FROM long WHERE v IS NOT NULL GROUP BY column_name
),
ords AS (SELECT * FROM (VALUES {ords}) o(column_name, col_ordinal)),
prof AS (
  SELECT a.column_name, CAST(o.col_ordinal AS INTEGER) AS col_ordinal, a.missing, a.parsed,
         (a.n > 0 AND a.parsed / a.n >= 0.7) AS is_numeric,
         CASE WHEN a.n > 0 AND a.parsed / a.n >= 0.7 THEN a.neg ELSE 0 END AS negatives,
         (({hint.replace('column_name', 'a.column_name')}) OR coalesce(d.share, 0) >= 0.7) AS is_date
  FROM agg a JOIN ords o ON a.column_name = o.column_name LEFT JOIN dates d ON a.column_name = d.column_name
)"""


def profile_columns() -> str:
    return f"WITH {_profile_cte()}\nSELECT * FROM prof"


def profile_table() -> str:
    cols = ", ".join(HEADERS)
    return f"""WITH {_profile_cte()},
dups AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM shipments GROUP BY {cols})),
s AS (
  SELECT (SELECT count(*) FROM shipments) AS rows, CAST(count(*) AS INTEGER) AS columns,
         (SELECT d FROM dups) AS exact_duplicates, sum(missing) AS missing_cells,
         CAST(count_if(is_numeric) AS INTEGER) AS numeric_columns, sum(negatives) AS negative_values,
         CAST(count_if(is_date) AS INTEGER) AS date_columns
  FROM prof
)
SELECT CAST(rows AS BIGINT) AS rows, columns, CAST(exact_duplicates AS BIGINT) AS exact_duplicates,
       CAST(missing_cells AS BIGINT) AS missing_cells, numeric_columns, CAST(negative_values AS BIGINT) AS negative_values,
       date_columns,
       greatest(20, least(100, CAST(trunc(100 - (missing_cells * 100.0 / (CASE WHEN rows > 0 AND columns > 0 THEN rows * columns ELSE 1 END) * 2
            + (CASE WHEN rows > 0 THEN exact_duplicates * 100.0 / rows ELSE 0 END) * 1.5
            + CASE WHEN negative_values > 0 THEN 5 ELSE 0 END)) AS INTEGER))) AS health_score
FROM s"""


# --- cleanup -------------------------------------------------------------------------
def _all_cols(replace: dict[str, str] | None = None) -> str:
    replace = replace or {}
    return ", ".join(f"{replace[h]} AS {h}" if h in replace else h for h in ("_row_id",) + HEADERS)


def _negatives(kind: str) -> str:
    def f(p: str) -> str:
        v = num_comma(p)
        if kind == "abs":
            return f"abs({v})"
        if kind == "none":
            return v
        if kind == "zero":
            return f"CASE WHEN {v} < 0 THEN 0.0::DOUBLE ELSE {v} END"
        return f"CASE WHEN {v} < 0 THEN NULL ELSE {v} END"

    return f"WITH shipments AS ({shipments_cte()})\nSELECT {_all_cols({p: f(p) for p in PERIOD_COLUMNS})} FROM shipments"


def negatives_abs() -> str:
    return _negatives("abs")


def negatives_zero() -> str:
    return _negatives("zero")


def negatives_none() -> str:
    return _negatives("none")


def plan_reset() -> str:
    return f"WITH shipments AS ({shipments_cte()})\nSELECT {_all_cols()} FROM shipments"


def negatives_null() -> str:
    return _negatives("null")


def duplicate_report() -> str:
    return f"""WITH shipments AS ({shipments_cte()})
SELECT {_all_cols()} FROM shipments
QUALIFY count(*) OVER (PARTITION BY ORDER_NO, LINE_NO) > 1"""


def _dedup(order: str, single: bool = False) -> str:
    cond = ("count(*) OVER (PARTITION BY ORDER_NO, LINE_NO) = 1" if single else
            f"row_number() OVER (PARTITION BY ORDER_NO, LINE_NO ORDER BY _row_id {order}) = 1")
    return f"WITH shipments AS ({shipments_cte()})\nSELECT {_all_cols()} FROM shipments QUALIFY {cond}"


def dedup_first() -> str:
    return _dedup("ASC")


def dedup_last() -> str:
    return _dedup("DESC")


def dedup_none() -> str:
    return _dedup("", single=True)


def dates_standardized() -> str:
    from wideprep.plans.sqlparts import standardize_date as sd

    d = "SHIP_DATE"
    return f"""WITH shipments AS ({shipments_cte()})
SELECT ORDER_NO, LINE_NO, SHIP_DATE,
  {sd(d, '%Y-%m-%d', True)} AS iso_dayfirst,
  {sd(d, '%Y-%m-%d', False)} AS iso_monthfirst,
  {sd(d, '%d/%m/%Y', True)} AS dmy,
  {sd(d, '%m/%d/%Y', True)} AS mdy,
  {sd(d, '%d %B %Y', True)} AS long_date,
  {sd(d, '%b %Y', True)} AS month_text
FROM shipments"""


def manage_columns() -> str:
    rest = [h for h in HEADERS if h not in ("LINE_NO", "ITEM_CODE", "ORDER_NO")]
    return f"""WITH shipments AS ({shipments_cte()})
SELECT _row_id, ITEM_CODE, ORDER_NO AS ORDER_REF, {", ".join(rest)} FROM shipments"""


def cleanup_plan() -> str:
    from wideprep.plans.sqlparts import standardize_date as sd

    cols = [("_row_id", None)] + [(h, None) for h in HEADERS if h != "LINE_NO"]
    sel = []
    for h, _ in cols:
        if h == "_row_id":
            continue
        if h in PERIOD_COLUMNS:
            sel.append(f"abs({num_comma(h)}) AS {h}")
        elif h == "SHIP_DATE":
            sel.append(f"{sd(h, '%d/%m/%Y', True)} AS SHIP_DATE")
        elif h == "ORDER_NO":
            sel.append("ORDER_NO AS ORDER_REF")
        else:
            sel.append(h)
    return f"""WITH shipments AS ({shipments_cte()}),
kept AS (SELECT * FROM shipments QUALIFY row_number() OVER (PARTITION BY ORDER_NO, LINE_NO ORDER BY _row_id) = 1)
SELECT row_number() OVER (ORDER BY _row_id) AS _row_id, {", ".join(sel)} FROM kept"""


ORACLE.update({
    "profile_columns": profile_columns,
    "profile_table": profile_table,
    "negatives_abs": negatives_abs,
    "negatives_zero": negatives_zero,
    "negatives_null": negatives_null,
    "duplicate_report": duplicate_report,
    "dedup_first": dedup_first,
    "dedup_last": dedup_last,
    "dedup_none": dedup_none,
    "dates_standardized": dates_standardized,
    "manage_columns": manage_columns,
    "cleanup_plan": cleanup_plan,
    "plan_reset": plan_reset,
    "plan_replayed": cleanup_plan,
    "negatives_none": negatives_none,
})


# --- samples, overlay ---------------------------------------------------------------------
def unresolved_samples() -> str:
    cols = ["SHIP_DATE", "ORDER_NO", "LINE_NO"]
    return f"""WITH shipments AS ({shipments_cte()}),
long AS (SELECT _row_id, source_column, raw FROM shipments UNPIVOT (raw FOR source_column IN ({", ".join(cols)}))),
firsts AS (SELECT source_column, raw, min(_row_id) AS f FROM long WHERE raw IS NOT NULL GROUP BY source_column, raw),
vals AS (SELECT source_column, trim(raw) AS value, f FROM firsts WHERE trim(raw) <> ''),
ranked AS (SELECT source_column, value, row_number() OVER (PARTITION BY source_column ORDER BY f) AS sample_rank FROM vals)
SELECT source_column, CAST(sample_rank AS INTEGER) AS sample_rank, value
FROM ranked WHERE sample_rank <= 4"""


def overlay_recommendations() -> str:
    return _overlaid(classify_headers())


def _overlaid(base: str) -> str:
    from wideprep.plans.queries import RECOMMENDATION_RULES

    fld = "CASE " + " ".join(f"WHEN contains(lower(source_column), {q(w)}) THEN {q(f)}"
                             for w, f, _, _ in RECOMMENDATION_RULES) + " END"
    conf = "CASE " + " ".join(f"WHEN contains(lower(source_column), {q(w)}) THEN {q(c)}"
                              for w, _, c, _ in RECOMMENDATION_RULES) + " ELSE 'n/a' END"
    targets = ", ".join(q(t) for t in ("Ignore",) + DIMS + ("Time Period",))
    lenient = ("(CASE WHEN regexp_full_match(trim(replace(rc, '%', '')), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
               "THEN CAST(trim(replace(rc, '%', '')) AS DOUBLE) ELSE 0.85 END)")
    scaled = f"(CASE WHEN {lenient} > 1.0 AND {lenient} <= 100.0 THEN {lenient} / 100.0 ELSE {lenient} END)"
    clamp = f"least(1.0, greatest(0.0, {scaled}))"
    return f"""WITH m AS ({base}),
r AS (
  SELECT dataset, source_column, coalesce({fld}, 'Ignore') AS rf, {conf} AS rc FROM m
  WHERE NOT user_confirmed AND (confidence < 0.85 OR target_field = 'Ignore')
),
j AS (SELECT m.*, r.rf, {clamp} AS rconf, r.source_column IS NOT NULL AND r.rf IN ({targets}) AS hit
      FROM m LEFT JOIN r ON m.dataset = r.dataset AND m.source_column = r.source_column)
SELECT dataset, col_ordinal, source_column,
  CASE WHEN hit THEN rf ELSE target_field END AS target_field,
  CASE WHEN hit THEN rconf ELSE confidence END AS confidence,
  CASE WHEN hit THEN 'Model recommendation' ELSE method END AS method,
  CASE WHEN hit THEN rconf >= 0.9 ELSE user_confirmed END AS user_confirmed
FROM j"""


# --- review / audit ----------------------------------------------------------------------------
def _edits_cte() -> str:
    return """edits AS (
  SELECT record_id, 'status' AS field, 'Rejected' AS value FROM output WHERE status = 'Incomplete'
  UNION ALL SELECT record_id, 'analyst_comment', 'required fields missing' FROM output WHERE status = 'Incomplete'
  UNION ALL SELECT record_id, 'region', 'Unknown' FROM output WHERE region = ''
  UNION ALL SELECT record_id, 'city_state', split_part(city_state, ' ', 1) FROM output
            WHERE status = 'Approved' AND contains(city_state, ' ')
  UNION ALL SELECT record_id, 'fact', ' Value ' FROM output WHERE fact = 'Value'
),
ed AS (SELECT record_id AS ek,
  max(CASE WHEN field = 'status' THEN value END) AS e_status,
  max(CASE WHEN field = 'analyst_comment' THEN value END) AS e_comment,
  max(CASE WHEN field = 'region' THEN value END) AS e_region,
  max(CASE WHEN field = 'city_state' THEN value END) AS e_city,
  max(CASE WHEN field = 'fact' THEN value END) AS e_fact
  FROM edits GROUP BY record_id),
edited AS (
  SELECT o.record_id, o.country, coalesce(e_region, o.region) AS region, o.channel,
         coalesce(e_city, o.city_state) AS city_state, o.category, o.brand, o.sku, coalesce(e_fact, o.fact) AS fact,
         """ + ", ".join(f"o.{p}" for p in PERIOD_COLUMNS) + """, o.confidence,
         coalesce(e_status, o.status) AS status, o.recommendation_source,
         coalesce(e_comment, o.analyst_comment) AS analyst_comment
  FROM output o LEFT JOIN ed ON o.record_id = ed.ek
)"""


def apply_edits() -> str:
    return f"WITH {output_cte()},\n{_edits_cte()}\nSELECT * FROM edited"


def audit_log() -> str:
    cols = [DIM_COLUMNS[d] for d in DIMS] + list(PERIOD_COLUMNS) + ["confidence", "status", "recommendation_source",
                                                                     "analyst_comment"]
    parts = []
    for c in cols:
        b, a = f"CAST(b.{c} AS VARCHAR)", f"CAST(a.{c} AS VARCHAR)"
        parts.append(f"SELECT a.record_id, {q(c)} AS field, {b} AS original_value, {a} AS final_value "
                     f"FROM output b JOIN edited a ON b.record_id = a.record_id "
                     f"WHERE b.{c} IS DISTINCT FROM a.{c} AND {clean_text(b)} <> {clean_text(a)}")
    return f"WITH {output_cte()},\n{_edits_cte()}\n" + "\nUNION ALL ".join(parts)


# --- delivery ---------------------------------------------------------------------------------
_PY_FLOAT = ("^\\s*[+-]?(((\\d(_?\\d)*)?\\.\\d(_?\\d)*|\\d(_?\\d)*\\.?)([eE][+-]?\\d(_?\\d)*)?"
             "|(?i:nan|inf|infinity))\\s*$")


def formula_guard() -> str:
    def g(c: str) -> str:
        return (f"CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(replace({c}, ',', ''), "
                f"{q(_PY_FLOAT)}) THEN '''' || {c} ELSE {c} END AS {c}")

    return f"WITH shipments AS ({shipments_cte()})\nSELECT _row_id, {', '.join(g(h) for h in HEADERS)} FROM shipments"


def delivery_manifest() -> str:
    return f"""WITH {output_cte()}
SELECT 'wideprep' AS application, 'shipments' AS source,
       count(*) AS rows, {len(DIMS) + len(PERIOD_COLUMNS) + 5} AS columns,
       count(*) <= 1048576 AS excel_allowed, true AS time_periods_preserved_as_columns
FROM output"""


def redact_text() -> str:
    slot = 'token = "([0-9a-f]{40})"'
    msg = (f"CASE WHEN doc_id % 2 = 1 THEN regexp_replace(text, {q(slot)}, 'Authorization: Bearer \\1', 'g') "
           f"ELSE regexp_replace(text, {q(slot)}, 'api_key=\\1', 'g') END")
    secret = f"(SELECT coalesce(min(nullif(regexp_extract(text, {q(slot)}, 1), '')), '(none)') FROM documents)"
    red = f"replace({msg}, {secret}, '[REDACTED_KEY]')"
    red = f"regexp_replace({red}, '(?i)(Bearer\\s+)[A-Za-z0-9_\\-.]{{8,}}', '\\1[REDACTED_TOKEN]', 'g')"
    red = f"regexp_replace({red}, '(?i)(api[-_]key[:=]\\s*)[A-Za-z0-9_\\-.]{{8,}}', '\\1[REDACTED_KEY]', 'g')"
    return f"""SELECT doc_id, t AS text, CAST((length(t) - length(replace(t, '[REDACTED_', ''))) / 10 AS INTEGER) AS redactions
FROM (SELECT doc_id, {red} AS t FROM documents)"""


ORACLE.update({
    "unresolved_samples": unresolved_samples,
    "overlay_recommendations": overlay_recommendations,
    "apply_edits": apply_edits,
    "audit_log": audit_log,
    "formula_guard": formula_guard,
    "delivery_manifest": delivery_manifest,
    "redact_text": redact_text,
})


# --- scans ----------------------------------------------------------------------------------
def scan_union_lineage() -> str:
    return """SELECT 'customer' AS "Source Sheet", CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment,
       NULL::VARCHAR AS s_suppkey, NULL::VARCHAR AS s_name, NULL::VARCHAR AS s_nationkey, NULL::VARCHAR AS s_acctbal
FROM customer
UNION ALL
SELECT 'supplier', NULL, NULL, NULL, NULL, NULL, CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR),
       CAST(s_acctbal AS VARCHAR)
FROM supplier"""


def largest_table() -> str:
    parts = [f"SELECT {q(t)} AS table_name, count(*) AS rows, {i} AS table_ordinal FROM {t}" for i, t in enumerate(TABLES)]
    return "\nUNION ALL ".join(parts)


ORACLE.update({"scan_union_lineage": scan_union_lineage, "largest_table": largest_table})


def scan_messy_files() -> str:
    short, moved = "c_custkey % 11 = 0", "c_nationkey % 3 = 1"
    return f"""SELECT CAST(c_nationkey AS VARCHAR) AS "Source Sheet", CAST(c_custkey AS VARCHAR) AS "KEY",
       CASE WHEN NOT ({short} AND {moved}) THEN 'é "' || c_name || '", a;b' || CASE WHEN c_nationkey % 5 > 0 OR c_custkey % 7 > 0 THEN ''
            WHEN c_custkey % 2 = 0 THEN chr(13) || chr(10) || 'next' ELSE chr(10) || 'next' END END AS "NAME",
       CASE WHEN NOT (c_custkey % 5 = 0 OR {short}) THEN c_mktsegment END AS "SEGMENT",
       CASE WHEN NOT {short} THEN CAST(c_acctbal AS VARCHAR) END AS "BALANCE",
       CASE WHEN NOT {short} OR {moved} THEN (c_custkey % 9) || '" x 3"' END AS "SIZE",
       CASE WHEN c_nationkey % 3 = 2 AND NOT {short} THEN 'again, ' || c_name END AS "NAME_1"
FROM customer WHERE c_custkey % 13 <> 0"""


def scan_rejects() -> str:
    return "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 13 = 0"


ORACLE.update({"scan_messy_files": scan_messy_files, "scan_rejects": scan_rejects})


# --- many uploads -------------------------------------------------------------------------------
def _uploads() -> str:
    from wideprep.plans.queries import UPLOAD_HEADERS

    values = ", ".join(f"({i}, {q(h)})" for i, h in enumerate(UPLOAD_HEADERS))
    return f"""SELECT 'upload_' || c_custkey AS dataset, CAST(i + 1 AS INTEGER) AS col_ordinal,
       CASE (c_custkey + i) % 5 WHEN 0 THEN upper(h) WHEN 1 THEN lower(replace(h, ' ', '_'))
            WHEN 2 THEN h || ' ' || (c_custkey % 10) WHEN 3 THEN replace(h, ' ', '-') ELSE h END AS source_column
  FROM customer, (VALUES {values}) v(i, h)"""


def classify_uploads() -> str:
    return _classified(_uploads())


def overlay_uploads() -> str:
    return _overlaid(_classified(_uploads()))


def override_uploads() -> str:
    edit = "(col_ordinal = 10 AND CAST(substr(dataset, 8) AS BIGINT) % 3 = 0)"
    return f"""WITH m AS ({_classified(_uploads())})
SELECT dataset, col_ordinal, source_column, CASE WHEN {edit} THEN 'SKU' ELSE target_field END AS target_field, confidence, method,
       {edit} OR user_confirmed AS user_confirmed
FROM m"""


def overlaid_sources() -> str:
    return f"""WITH {output_cte()}
SELECT record_id, confidence,
       CASE WHEN recommendation_source = 'Rules and Standards' THEN 'Model recommendation' ELSE recommendation_source END AS recommendation_source
FROM output"""


def dictionary_joined() -> str:
    country, region, channel = (clean_text(SHIPMENT_MAPPING[d]) for d in ("Country", "Region", "Channel"))
    return f"""WITH shipments AS ({shipments_cte()}),
names AS (SELECT lower(n_name) AS alias, min(n_name || ' #' || n_nationkey) AS said FROM nation GROUP BY 1),
zones AS (SELECT lower(r_name) AS alias, min(r_name[1:3]) AS said FROM region GROUP BY 1),
segments AS (SELECT lower(c_mktsegment) AS alias, min('seg ' || c_mktsegment) AS said FROM customer GROUP BY 1),
dims AS (SELECT _row_id, {country} AS a, {region} AS b, {channel} AS c, {clean_text(SHIPMENT_MAPPING["City/State"])} AS d,
  {clean_text(SHIPMENT_MAPPING["Category"])} AS e, {clean_text(SHIPMENT_MAPPING["Brand"])} AS f,
  {sku_text(SHIPMENT_MAPPING["SKU"])} AS g, {clean_text(SHIPMENT_MAPPING["Fact"])} AS h FROM shipments),
said AS (SELECT dims.*, coalesce(names.said, {py_title("a")}) AS country, coalesce(zones.said, {py_title("b")}) AS region,
  coalesce(segments.said, {py_title("c")}) AS channel
  FROM dims LEFT JOIN names ON lower(a) = names.alias LEFT JOIN zones ON lower(b) = zones.alias
  LEFT JOIN segments ON lower(c) = segments.alias),
scored AS (SELECT *, CAST(round_even(100.0 * len(list_filter([country, region, channel, d, e, f, g, h], lambda x: x <> '')) / 8, 0)
  AS INTEGER) AS confidence FROM said)
SELECT printf('REC-%07d', _row_id) AS record_id, country, region, channel, confidence,
  CASE WHEN {" OR ".join(f"{x} = ''" for x in ("country", "channel", "e", "f", "g", "h"))} THEN 'Incomplete' WHEN confidence >= 90 THEN 'Approved'
       ELSE 'Needs Review' END AS status
FROM scored"""


# --- reconciliation that finds differences --------------------------------------------------------
_PLAIN_CELL = "(CASE WHEN CAST(s.ORDER_NO AS BIGINT) % 7 = 0 THEN NULL ELSE s.JAN_1998 END)"


def _difference_cells() -> str:
    """j: one row a record with what either number reader makes of its JAN_1998 cell."""
    return f"""{output_cte()},
j AS (SELECT o.channel, o.region, {_exact(num_comma(_PLAIN_CELL))} AS vin, {_exact(num_comma('CAST(o.JAN_1998 AS VARCHAR)'))} AS vout
  FROM shipments s FULL OUTER JOIN output o ON s._row_id = o._row_id)"""


def reconcile_differences() -> str:
    return f"""WITH {_difference_cells()}
SELECT 'JAN_1998' AS source_measure, 'JAN_1998' AS output_measure, CAST(sum(vin) AS DOUBLE) AS input_total,
       CAST(sum(vout) AS DOUBLE) AS output_total, CAST(sum(vout) - sum(vin) AS DOUBLE) AS difference, 0.01::DOUBLE AS tolerance,
       abs(sum(vout) - sum(vin)) <= 0.01 AS match
FROM j
UNION ALL SELECT 'NO_MEASURE', 'JAN_1998', 0, 0, 0, 0.01, false"""


def reconcile_slice_differences() -> str:
    return f"""WITH {_difference_cells()}
SELECT channel, region, CAST(sum(vin) AS DOUBLE) AS input_total, CAST(sum(vout) AS DOUBLE) AS output_total,
       CAST(sum(vout) - sum(vin) AS DOUBLE) AS difference, abs(sum(vout) - sum(vin)) <= 0.01 AS match
FROM j GROUP BY channel, region"""


def slice_sizes() -> str:
    dims = [DIM_COLUMNS[d] for d in DIMS]
    columns = dims + list(PERIOD_COLUMNS)
    rows = " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS place, {q(c)} AS column_name, count(DISTINCT {c}) AS slices FROM output"
                              for i, c in enumerate(columns))
    return f"WITH {output_cte()}\n{rows}"


def duplicate_keys_suggested() -> str:
    return f"""SELECT dataset, col_ordinal, source_column,
       CAST(row_number() OVER (PARTITION BY dataset ORDER BY col_ordinal) AS INTEGER) AS key_rank
FROM ({_uploads()}) WHERE regexp_matches(source_column, '(?i)sku|item|product|country|date|period|channel') QUALIFY key_rank <= 4"""


def quality_report_empty() -> str:
    return f"{quality_report()} LIMIT 0"


def _output_columns() -> list[str]:
    return ["record_id", *[DIM_COLUMNS[d] for d in DIMS], *PERIOD_COLUMNS, "confidence", "status", "recommendation_source",
            "analyst_comment"]


def output_measures() -> str:
    plain = "'\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*'"
    rows = " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, coalesce(count_if(regexp_full_match(CAST({c} AS VARCHAR), {plain})), 0) AS parsed, count(*) AS n FROM output"
        for c in _output_columns())
    return f"""WITH {output_cte()}
SELECT column_name, CAST(parsed AS BIGINT) AS parsed, n > 0 AND parsed / n > 0.7 AS is_measure FROM ({rows})"""


# --- review of stored versions --------------------------------------------------------------------
def locked_column_changes() -> str:
    return f"""WITH {output_cte()}
SELECT record_id, 'confidence' AS field, CAST(confidence AS VARCHAR) AS original_value,
       CAST(confidence + 1 AS VARCHAR) AS final_value
FROM output WHERE status = 'Incomplete'"""


def version_records() -> str:
    gone = "FROM output WHERE status = 'Incomplete' AND record_id LIKE '%0'"
    return f"""WITH {output_cte()}
SELECT record_id, '(record)' AS field, 'present' AS original_value, CAST(NULL AS VARCHAR) AS final_value {gone}
UNION ALL SELECT record_id || '-B', '(record)', NULL, 'present' {gone}"""


def appended_log() -> str:
    return f"SELECT *, CASE WHEN field = 'region' THEN '1' ELSE '2' END AS save_id FROM ({audit_log()})"


def rejected_edits() -> str:
    return f"""WITH {output_cte()}
SELECT record_id, field, value FROM output,
  (VALUES ('status', 'Done'), ('confidence', '100'), ('JAN_1998', 'abc')) v(field, value)
WHERE status = 'Incomplete'"""


def quality_after_edits() -> str:
    return f"WITH {output_cte()},\n{_edits_cte()}\n{_report('edited')}"


# --- delivery read back -----------------------------------------------------------------------------
def quality_preview() -> str:
    order = ", ".join(f"WHEN {q(d)} THEN {i}" for i, d in enumerate(REQUIRED_DIMS)).replace(", ", " ")
    return f"""WITH {output_cte()}, r AS ({_report('output')})
SELECT CAST(row_number() OVER (ORDER BY record_id, severity, CASE field {order} ELSE 99 END) AS INTEGER) AS place, record_id, severity, field
FROM r QUALIFY place <= 100"""


def delivered_csv() -> str:
    from wideprep.sources.fixtures import DIM_HEADERS

    def cell(c: str) -> str:
        return (f"nullif(CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(replace({c}, ',', ''), "
                f"{q(_PY_FLOAT)}) THEN chr(39) || {c} ELSE {c} END, '') AS {c}")

    return f"WITH shipments AS ({shipments_cte()})\nSELECT {', '.join(map(cell, DIM_HEADERS))} FROM shipments"


def delivered_output() -> str:
    return standardize_shipments()


def delivered_bundle() -> str:
    counts = {"standardized_output": record_ids(), "data_quality_report": quality_report(), "duplicate_report": duplicate_report(),
              "reconciliation_detail": reconcile_slices(), "user_change_audit": audit_log(), "profiling_report": "SELECT 1",
              "reconciliation_summary": "SELECT 1", "column_classification": f"SELECT unnest(range({len(HEADERS)}))"}
    split = ("data_quality_report", "user_change_audit")
    parts = [f"SELECT {q(m)} AS member, field, count(*) AS rows FROM ({sql}) GROUP BY field" if m in split
             else f"SELECT {q(m)} AS member, '' AS field, count(*) AS rows FROM ({sql})" for m, sql in counts.items()]
    parts += [f"SELECT 'manifest', {q(m)}, count(*) FROM ({sql})" for m, sql in counts.items()]
    parts.append(f"SELECT 'run_manifest', 'shipments', count(*) FROM ({record_ids()})")
    return "\nUNION ALL ".join(parts)


def profile_dense() -> str:
    return """WITH t AS (
  SELECT CAST(c_custkey - CASE WHEN c_custkey % 20 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS account,
         CASE WHEN c_custkey % 20 <= 1 THEN 'n/a' ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 20 <= 1 THEN '0' ELSE CAST(c_acctbal AS VARCHAR) END AS balance, 'x' AS kind
  FROM customer
),
f AS (
  SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dups,
         count_if(segment = 'n/a') AS missing, count_if(CAST(balance AS DOUBLE) < 0) AS negatives,
         count_if(regexp_full_match(account, '\\d{4,5}')) * 1.0 / count(*) AS serials
  FROM t
)
SELECT rows, 4 AS columns, dups AS exact_duplicates, missing AS missing_cells, 2 AS numeric_columns, negatives AS negative_values,
       CASE WHEN serials >= 0.7 THEN 1 ELSE 0 END AS date_columns,
       greatest(20, least(100, CAST(trunc(100 - (missing * 100.0 / (rows * 4) * 2 + dups * 100.0 / rows * 1.5
         + CASE WHEN negatives > 0 THEN 5 ELSE 0 END)) AS INTEGER))) AS health_score
FROM f"""


ORACLE.update({f.__name__: f for f in (
    classify_uploads, overlay_uploads, override_uploads, overlaid_sources, dictionary_joined, reconcile_differences, reconcile_slice_differences,
    output_measures, locked_column_changes, rejected_edits, quality_after_edits, quality_preview, delivered_csv, delivered_output,
    delivered_bundle, profile_dense, version_records, appended_log, slice_sizes, duplicate_keys_suggested, quality_report_empty)})
ORACLE.update({"version_changes": audit_log})
