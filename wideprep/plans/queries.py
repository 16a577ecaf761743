"""Registered queries: one per operator group of the inventory.

Each takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables (or data Spark derives from them). Column names match the oracle SQL
in ``plans.oracle``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideprep.operators import quality as Q
from wideprep.operators import reconcile as R
from wideprep.operators.ordinal import ROW_ID
from wideprep.functions.numbers import filled_cells, filled_cells_sql, ref
from wideprep.plans import pipeline as P


def standardize_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical output (without the internal ordinal)."""
    out = P.output(spark, sf_dir)
    return out.drop(ROW_ID)


def shipments_by_channel_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the whole chain (standardise + aggregate) by channel x brand.

    One pass: each output row is unpivoted to one marker row (a zero) plus its
    filled period cells, then one hash aggregate counts records and sums the
    cells exactly (partial aggregation before the shuffle; no per-row 84-term
    decimal sum).
    """
    out = P.output_rows(spark, sf_dir)
    periods = P.period_columns(spark, sf_dir)
    long = filled_cells(out, ["0D"] + [ref(p) for p in periods], [F.col("channel"), F.col("brand"), F.col("status") == "Approved"]).toDF(
        "channel", "brand", "_ok", "_i", "_v")
    row = F.col("_i") == 0
    return long.groupBy("channel", "brand").agg(
        F.count_if(row).alias("records"),
        F.count_if(row & F.col("_ok")).alias("approved"),
        F.coalesce(F.sum(F.col("_v").cast("decimal(38,6)")), F.lit(0).cast("decimal(38,6)")).cast("double")
        .alias("total_value"),
    )


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense sequential ids in declared row order, tied to the source keys."""
    from wideprep.operators.standardize import record_id

    src = P.source(spark, sf_dir)
    return src.select("ORDER_NO", "LINE_NO", record_id(F.col(ROW_ID)).alias("record_id"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q3: exception rows."""
    return Q.quality_report(P.output_read(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    return Q.status_counts(P.output_narrow(spark, sf_dir))


def reconcile_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global totals of one measure pair (the analyst's pick: JAN_1998)."""
    src, out = P.source_rows(spark, sf_dir), P.output_rows(spark, sf_dir)
    return R.reconcile_total(src, out, "JAN_1998", "JAN_1998")


def reconcile_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JAN_1998 by channel x brand, source groups by lineage."""
    src, out = P.source(spark, sf_dir), P.output_narrow(spark, sf_dir)
    return R.reconcile_groups(src, out, "JAN_1998", "JAN_1998", ["channel", "brand"], label=True)


def reconcile_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All period columns at once, by region."""
    src, out = P.source(spark, sf_dir), P.output_read(spark, sf_dir)
    return R.reconcile_periods(src, out, P.period_columns(spark, sf_dir), groups=["region"], zeros=True)


def reconcile_period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 with its total lines: by region and period, by either, and over all."""
    src, out = P.source(spark, sf_dir), P.output_read(spark, sf_dir)
    return R.reconcile_periods(src, out, P.period_columns(spark, sf_dir), groups=["region"], zeros=True, totals=True)


def classify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C4 over the headers of every driver table and of ``shipments``."""
    from wideprep.operators.classify import classify_columns, header_catalogue
    from wideprep.sources.fixtures import HEADERS
    from wideprep.sources.tables import TABLES, read_table

    tables = {t: read_table(spark, sf_dir, t) for t in TABLES}
    tables["shipments"] = list(HEADERS)
    return classify_columns(header_catalogue(spark, tables))


REGISTRY = {
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


# --- profiling ---------------------------------------------------------------------
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-column figures of the raw shipments table."""
    from wideprep.operators.profile import profile_columns as run

    return run(P.source_rows(spark, sf_dir))


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-table figures and health score."""
    from wideprep.operators.profile import profile_table as run

    return run(P.source(spark, sf_dir))


# --- cleanup -------------------------------------------------------------------------
DUP_KEYS = ["ORDER_NO", "LINE_NO"]


def _negative_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    """The analyst's pick: every period column (sparse, so the profile's
    numeric share rule does not flag them, but they hold the negatives)."""
    return list(P.period_columns(spark, sf_dir))


def _negatives(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    from wideprep.operators.cleanup import apply_negative_actions

    return apply_negative_actions(P.source(spark, sf_dir), {c: action for c in _negative_columns(spark, sf_dir)})


def negatives_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column with negatives -> absolute values."""
    return _negatives(spark, sf_dir, "Convert to positive")


def negatives_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives -> 0."""
    return _negatives(spark, sf_dir, "Replace with zero")


def negatives_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: negatives -> NULL."""
    return _negatives(spark, sf_dir, "Replace with blank")


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of repeated (ORDER_NO, LINE_NO) keys."""
    from wideprep.operators.cleanup import duplicate_report as run

    return run(P.source(spark, sf_dir), DUP_KEYS)


def _dedup(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    from wideprep.operators.cleanup import remove_duplicates

    return remove_duplicates(P.source(spark, sf_dir), DUP_KEYS, keep)


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    return _dedup(spark, sf_dir, "Keep first")


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7."""
    return _dedup(spark, sf_dir, "Keep last")


def dedup_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return _dedup(spark, sf_dir, "Delete all duplicates")


def dates_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHIP_DATE in every output format, day-first and month-first."""
    from wideprep.functions.dates import standardize_date

    src = P.source(spark, sf_dir)
    d = F.col("SHIP_DATE")
    return src.select(
        "ORDER_NO", "LINE_NO", "SHIP_DATE",
        standardize_date(d, "YYYY-MM-DD", True).alias("iso_dayfirst"),
        standardize_date(d, "YYYY-MM-DD", False).alias("iso_monthfirst"),
        standardize_date(d, "DD/MM/YYYY", True).alias("dmy"),
        standardize_date(d, "MM/DD/YYYY", True).alias("mdy"),
        standardize_date(d, "Long date", True).alias("long_date"),
        standardize_date(d, "Month text", True).alias("month_text"),
    )


def manage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop, rename, reorder."""
    from wideprep.operators.cleanup import manage_columns as run

    return run(P.source(spark, sf_dir), delete=["LINE_NO", "NOT_A_COLUMN"], rename={"ORDER_NO": "ORDER_REF"},
               order=["ITEM_CODE", "ORDER_REF"])


def _plan(spark: SparkSession, sf_dir: str):
    from wideprep.operators.cleanup import CleanupPlan

    return CleanupPlan(
        negatives={c: "Convert to positive" for c in _negative_columns(spark, sf_dir)},
        duplicate_keys=DUP_KEYS, duplicate_policy="Keep first",
        date_columns=["SHIP_DATE"], date_format="DD/MM/YYYY", dayfirst=True,
        delete=["LINE_NO"], rename={"ORDER_NO": "ORDER_REF"},
    )


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives -> dedup -> dates -> columns, rows renumbered densely."""
    from wideprep.operators.cleanup import apply_plan

    return apply_plan(P.source(spark, sf_dir), _plan(spark, sf_dir), renumber=True)


def _kept_plans(spark: SparkSession, sf_dir: str) -> str:
    """A folder of plan versions: the plan, a reset, the plan again."""
    from wideprep.operators.cleanup import save_plan
    from wideprep.session import new_table_path

    path = new_table_path(spark, "plans")
    for version, plan in enumerate((_plan(spark, sf_dir), None, _plan(spark, sf_dir))):
        save_plan(spark, path, version + 1, plan)
    return path


def plan_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version, a reset: the raw table."""
    from wideprep.operators.cleanup import replay

    return replay(P.source(spark, sf_dir), spark, _kept_plans(spark, sf_dir), 2)


def plan_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version replayed after the reset."""
    from wideprep.operators.cleanup import replay

    return replay(P.source(spark, sf_dir), spark, _kept_plans(spark, sf_dir), renumber=True)


def negatives_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period columns read as numbers and nothing done to them; a column that is not there changes nothing."""
    from wideprep.operators.cleanup import apply_negative_actions

    actions = {c: "Do nothing" for c in _negative_columns(spark, sf_dir)}
    return apply_negative_actions(P.source(spark, sf_dir), actions | {"NOT_A_COLUMN": "Replace with zero"})


REGISTRY.update({
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
    "plan_replayed": plan_replayed,
    "negatives_none": negatives_none,
})


# --- classification: samples and recommendation overlay --------------------------------
def unresolved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 4 distinct values of every column the rules left open."""
    from wideprep.operators.classify import unresolved_samples as run

    return run(P.source(spark, sf_dir), P.mapping(spark, sf_dir), dataset=P.DATASET)


# --- FIXED VALUES: stand-in recommendation rules by header word -------------------------
# (the external recommender is not part of this engine; its JSON reply is
# produced from the catalogue by these rules so that parsing, lenient
# confidence and the overlay run on data of the right shape)
RECOMMENDATION_RULES = (
    ("date", "Ignore", "95%", "transaction date"),
    ("price", "Fact", "88", "money amount"),
    ("name", "Brand", "0.6", "free text name"),
    ("key", "Unknown Field", "0.99", "identifier"),
)


def recommendation_payload(mapping: DataFrame) -> DataFrame:
    """One fenced JSON reply per dataset for its unresolved columns."""
    from wideprep.operators.classify import unresolved

    u = unresolved(mapping)
    lower = F.lower(F.col("source_column"))
    field, conf, reason = F.lit(None), F.lit("n/a"), F.lit("no rule")
    for word, f, c, r in reversed(RECOMMENDATION_RULES):
        hit = lower.contains(word)
        field, conf, reason = (F.when(hit, F.lit(f)).otherwise(field), F.when(hit, F.lit(c)).otherwise(conf),
                               F.when(hit, F.lit(r)).otherwise(reason))
    rec = F.struct(field.alias("field"), conf.alias("confidence"), reason.alias("reason"))
    per_ds = u.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("source_column", rec))).alias("m"))
    return per_ds.select("dataset", F.concat(F.lit("```json\n"), F.to_json("m"), F.lit("\n```")).alias("payload"))


def overlay_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse the replies, read confidences leniently, overlay the
    allowed fields on the mapping of every catalogue table."""
    from wideprep.operators.classify import overlay_recommendations as overlay
    from wideprep.operators.classify import parse_recommendations

    mapping = classify_headers(spark, sf_dir)
    recs = parse_recommendations(recommendation_payload(mapping), "payload", keep=("dataset",))
    return overlay(mapping, recs)


# --- review / audit -------------------------------------------------------------------
def analyst_edits(out: DataFrame) -> DataFrame:
    """Edits derived from the output as an analyst would make them: reject
    incomplete records with a comment, fill a missing region, cut an
    approved record's city to its first word, and one no-op edit (same text
    up to spacing) that must not reach the log. One pass over the output."""
    def edit(cond, field, value):
        return F.when(cond, F.struct(F.lit(field).alias("field"), value.alias("value")))

    inc = F.col("status") == "Incomplete"
    cells = F.array(
        edit(inc, "status", F.lit("Rejected")),
        edit(inc, "analyst_comment", F.lit("required fields missing")),
        edit(F.col("region") == "", "region", F.lit("Unknown")),
        edit((F.col("status") == "Approved") & F.col("city_state").contains(" "), "city_state",
             F.substring_index(F.col("city_state"), " ", 1)),
        edit(F.col("fact") == "Value", "fact", F.lit(" Value ")),
    )
    return out.select("record_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select(
        "record_id", "x.field", "x.value")


def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the edited output."""
    from wideprep.operators.audit import apply_edits as run

    # the edits read few columns, several times; the whole rows are read once
    return run(P.output_read(spark, sf_dir).drop(ROW_ID), analyst_edits(P.output_narrow(spark, sf_dir)))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: cell-level change log of the analyst's edits."""
    from wideprep.operators.audit import edit_log

    out = P.output_narrow(spark, sf_dir).drop(ROW_ID)
    return edit_log(out, analyst_edits(out))


# --- delivery ---------------------------------------------------------------------------
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the raw shipments table guarded for spreadsheet export."""
    from wideprep.operators.deliver import sanitize

    return sanitize(P.source(spark, sf_dir))


def delivery_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2/K4: run manifest of the standardised output (time stamp left out)."""
    from wideprep.operators.deliver import manifest

    return manifest(P.output_rows(spark, sf_dir), "shipments", stamp=False)


# --- redaction ------------------------------------------------------------------------------
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-R1..3: secrets in whole document texts. The documents' ``token =
    "<hex>"`` lines are rewritten into header form first (bearer for odd ids,
    api-key for even ids), so every rule has something to find."""
    from wideprep.functions.redact import redact
    from wideprep.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    slot = r'token = "([0-9a-f]{40})"'
    msg = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", slot, "Authorization: Bearer $1")).otherwise(
        F.regexp_replace("text", slot, "api_key=$1"))
    found = docs.agg(F.min(F.nullif(F.regexp_extract("text", slot, 1), F.lit(""))).alias("secret")).first()["secret"]
    red = redact(msg, secrets=[found] if found else [])
    marks = (F.length(red) - F.length(F.replace(red, F.lit("[REDACTED_"), F.lit("")))) / len("[REDACTED_")
    return docs.select("doc_id", red.alias("text"), marks.cast("int").alias("redactions"))


REGISTRY.update({
    "unresolved_samples": unresolved_samples,
    "overlay_recommendations": overlay_recommendations,
    "apply_edits": apply_edits,
    "audit_log": audit_log,
    "formula_guard": formula_guard,
    "delivery_manifest": delivery_manifest,
    "redact_text": redact_text,
})


# --- scans ----------------------------------------------------------------------------
def scan_union_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier read as text, appended by column name
    with the source name first; all-NULL columns and rows dropped."""
    from wideprep.sources.tables import append_tables, as_text_table, drop_empty, read_table

    tables = {t: drop_empty(as_text_table(read_table(spark, sf_dir, t)), keep=()) for t in ("customer", "supplier")}
    return append_tables(tables)


def largest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every driver table with its row count, largest first."""
    from wideprep.sources.tables import TABLES, largest_table as run, read_table

    return run({t: read_table(spark, sf_dir, t) for t in TABLES})


#: Header cells of the untidy uploads, by nation modulo 3: another order, a repeated and an unnamed column.
MESSY_LAYOUTS = (("KEY", "NAME", "SEGMENT", "BALANCE", "SIZE"), ("KEY", "SIZE", "NAME", "SEGMENT", "BALANCE"),
                 ("KEY", "NAME", "SEGMENT", "BALANCE", "SIZE", "NAME", "Unnamed: 6"))


def messy_files(spark: SparkSession, sf_dir: str) -> str:
    """``customer`` written as one untidy upload a nation, in three layouts; returns the folder. A title stands above the header, header
    cells are quoted, names hold quotes and delimiters, sizes hold inch marks, every 5th segment is spelled NA, every 11th record
    has two cells, every 13th a blank cell too many; odd nations use ``;`` and Windows-1252; in every 5th nation names hold line ends."""
    from wideprep.session import new_table_path
    from wideprep.sources.tables import read_table

    odd = F.col("c_nationkey") % 2 == 1
    d = F.when(odd, ";").otherwise(",")

    def joined(cells):
        return F.concat(cells[0], *[x for c in cells[1:] for x in (d, c)])

    def by_layout(make):
        lines = [make(columns) for columns in MESSY_LAYOUTS]
        return F.when(F.col("c_nationkey") % 3 == 0, lines[0]).when(F.col("c_nationkey") % 3 == 1, lines[1]).otherwise(lines[2])

    k = F.col("c_custkey")
    ends = F.when((F.col("c_nationkey") % 5 > 0) | (k % 7 > 0), "").when(k % 2 == 0, "\r\nnext").otherwise("\nnext")
    cells = {
        "KEY": k.cast("string"), "NAME": F.concat(F.lit('"é ""'), "c_name", F.lit('"", a;b'), ends, F.lit('"')),
        "SEGMENT": F.when(k % 5 == 0, "NA").otherwise(F.col("c_mktsegment")), "BALANCE": F.col("c_acctbal").cast("string"),
        "SIZE": F.concat((k % 9).cast("string"), F.lit('" x 3"')), "Unnamed: 6": F.lit("n/a"),
    }

    def record(columns):
        own = [cells[c] if c not in columns[:i] else F.concat(F.lit('"again, '), "c_name", F.lit('"')) for i, c in enumerate(columns)]
        return F.when(k % 13 == 0, joined([*own, F.lit("")])).when(k % 11 == 0, joined(own[:2])).otherwise(joined(own))

    rows = read_table(spark, sf_dir, "customer").select("c_nationkey", k.alias("n"), by_layout(record).alias("line"))
    header = by_layout(lambda columns: joined([F.lit(f'"{c}"') for c in columns]))
    tops = rows.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("n"), F.lit("Customer report").alias("line")),
        F.struct(F.lit(-1).cast("long").alias("n"), header.alias("line")))).alias("x"))
    lines = rows.unionAll(tops.select("c_nationkey", "x.n", "x.line"))
    written = F.when(odd, F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line")).alias("value")
    lines = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "n").select("c_nationkey", written)
    path = new_table_path(spark, "messy-files")
    lines.write.partitionBy("c_nationkey").text(path)
    return path


def scan_messy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy uploads scanned back, appended by column name, the nation as lineage; all-NULL columns go."""
    from wideprep.constants import SOURCE_COLUMN
    from wideprep.sources.delimited import scan_delimited
    from wideprep.sources.tables import drop_empty

    def nation(file):
        return F.regexp_extract(file, "c_nationkey=([0-9]+)", 1)

    return drop_empty(scan_delimited(spark, messy_files(spark, sf_dir) + "/*/*", source=nation), keep=(SOURCE_COLUMN,))


def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with too many fields, by their key."""
    from wideprep.sources.delimited import rejected_records

    found = rejected_records(spark, messy_files(spark, sf_dir) + "/*/*")
    return found.select(F.regexp_extract("record", "^[0-9]+", 0).alias("key"))


REGISTRY.update({
    "scan_messy_files": scan_messy_files,
    "scan_rejects": scan_rejects,
    "scan_union_lineage": scan_union_lineage,
    "largest_table": largest_table,
})


# --- classification of many uploads ---------------------------------------------------------
UPLOAD_HEADERS = ("Country Name", "Sales Zone", "Trade Type", "Ship To City", "Prod Group", "Brand Desc", "Item Code",
                  "Measure", "Invoice Date", "Unit Price", "Jan 2026", "Contact Name")


def uploads_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of one upload a ``customer`` row, spelled in five ways by its key."""
    from wideprep.sources.tables import read_table

    headers = F.posexplode(F.array(*[F.lit(h) for h in UPLOAD_HEADERS])).alias("i", "h")
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), headers)
    style, h = (F.col("k") + F.col("i")) % 5, F.col("h")
    spelled = (F.when(style == 0, F.upper(h)).when(style == 1, F.lower(F.replace(h, F.lit(" "), F.lit("_"))))
               .when(style == 2, F.concat(h, F.lit(" "), (F.col("k") % 10).cast("string")))
               .when(style == 3, F.replace(h, F.lit(" "), F.lit("-"))).otherwise(h))
    return rows.select(F.concat(F.lit("upload_"), F.col("k").cast("string")).alias("dataset"),
                       (F.col("i") + 1).cast("int").alias("col_ordinal"), spelled.alias("source_column"))


def classify_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C4 over the headers of one upload a customer."""
    from wideprep.operators.classify import classify_columns

    return classify_columns(uploads_catalogue(spark, sf_dir))


def overlay_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply an upload, laid over its mapping."""
    from wideprep.operators.classify import overlay_recommendations as overlay
    from wideprep.operators.classify import parse_recommendations

    mapping = classify_uploads(spark, sf_dir)
    return overlay(mapping, parse_recommendations(recommendation_payload(mapping), "payload", keep=("dataset",)))


def override_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyst takes the tenth column of every third upload for its SKU."""
    from wideprep.operators.classify import override_mapping

    mapping = classify_uploads(spark, sf_dir)
    third = F.regexp_extract("dataset", "[0-9]+$", 0).cast("long") % 3 == 0
    edits = uploads_catalogue(spark, sf_dir).filter(third & (F.col("col_ordinal") == 10)).select(
        "dataset", "source_column", F.lit("SKU").alias("target_field"), F.lit(True).alias("user_confirmed"))
    return override_mapping(mapping, edits)


def overlaid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: recommendation sources of the output when the mapping carries a recommendation."""
    from wideprep.constants import STANDARDS
    from wideprep.operators.classify import overlay_recommendations as overlay
    from wideprep.operators.classify import parse_recommendations
    from wideprep.operators.standardize import standardize

    mapping = P.mapping(spark, sf_dir)
    mapping = overlay(mapping, parse_recommendations(recommendation_payload(mapping), "payload", keep=("dataset",)))
    out = standardize(P.source(spark, sf_dir), mapping, STANDARDS, dataset=P.DATASET)
    return out.select("record_id", "confidence", "recommendation_source")


def table_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from rows: every country by its name, regions in short, and a customer segment for the channel."""
    from wideprep.sources.tables import read_table

    def entries(dimension, table, alias, canonical):
        return read_table(spark, sf_dir, table).select(F.lit(dimension).alias("dimension"), alias.alias("alias"), canonical.alias("canonical"))

    nation = entries("country", "nation", F.col("n_name"), F.concat("n_name", F.lit(" #"), F.col("n_nationkey").cast("string")))
    region = entries("region", "region", F.col("r_name"), F.substring("r_name", 1, 3))
    segment = entries("channel", "customer", F.col("c_mktsegment"), F.concat(F.lit("seg "), F.col("c_mktsegment")))
    return nation.unionAll(region).unionAll(segment)


def dictionary_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised with a dictionary that is a table, joined whatever its size."""
    from wideprep.operators.standardize import standardize

    out = standardize(P.source(spark, sf_dir), P.mapping(spark, sf_dir), table_standards(spark, sf_dir), dataset=P.DATASET)
    return out.select("record_id", "country", "region", "channel", "confidence", "status")


# --- reconciliation that finds differences ----------------------------------------------------
def _marked(source: DataFrame) -> DataFrame:
    """``shipments`` with a currency sign on every 7th order's cell, which the two number readers read differently."""
    marked = F.when(F.col("ORDER_NO").cast("long") % 7 == 0, F.concat(F.lit("$"), F.col("JAN_1998"))).otherwise(F.col("JAN_1998"))
    return source.withColumn("JAN_1998", marked)


def reconcile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that differ, and a measure that is not there."""
    src, out = _marked(P.source_rows(spark, sf_dir)), P.output_rows(spark, sf_dir)
    return R.reconcile_total(src, out, "JAN_1998", "JAN_1998").unionByName(R.reconcile_total(src, out, "NO_MEASURE", "JAN_1998"))


def reconcile_slice_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that differ; a group that is no output column is left out."""
    return R.reconcile_groups(_marked(P.source(spark, sf_dir)), P.output_read(spark, sf_dir), "JAN_1998", "JAN_1998",
                              ["channel", "no_group", "region", "channel"])


def slice_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns a reconciliation may be sliced by, in order, each with its number of slices."""
    src, out = P.source(spark, sf_dir), P.output_stored(spark, sf_dir)
    columns = R.slice_candidates(src, out)
    # filled cells only; a marker cell a row keeps an output without rows apart from one without values
    cells = F.expr(filled_cells_sql(["''"] + [f"CAST({ref(c)} AS STRING)" for c in columns])).alias("i", "v")
    found = out.select(cells).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("found")).where(F.expr("try_element_at(found, 0)").isNotNull())
    listed = found.select("found", F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("i", "column_name"))
    return listed.select((F.col("i") + 1).alias("place"), "column_name",
                         F.coalesce(F.try_element_at("found", F.col("i") + 1), F.lit(0)).alias("slices"))


def duplicate_keys_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 over the headers of one upload a customer."""
    from wideprep.operators.profile import suggested_keys

    return suggested_keys(uploads_catalogue(spark, sf_dir))


def quality_report_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the exception report of the records that lack nothing: no row, the report's columns."""
    out = P.output_read(spark, sf_dir)
    complete = [F.col(c) != "" for c in ("country", "region", "channel", "category", "brand", "sku", "fact")]
    return Q.quality_report(out.where(reduce(lambda a, b: a & b, complete)))


def output_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 over the whole standardised output."""
    return R.measure_shares(P.output_stored(spark, sf_dir).drop(ROW_ID))


# --- review of stored versions -----------------------------------------------------------------
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the cells in which two stored versions differ."""
    from wideprep.operators.audit import change_log

    return change_log(P.version(spark, sf_dir), P.edited_version(spark, sf_dir))


def version_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: records that were removed (every tenth incomplete one) and added (its copy under another id) between versions."""
    from wideprep.operators.audit import RECORD_FIELD, change_log

    before = P.version(spark, sf_dir)
    tenth = (F.col("status") == "Incomplete") & (F.col("record_id").substr(-1, 1) == "0")
    after = before.where(~tenth).unionByName(before.where(tenth).withColumn("record_id", F.concat("record_id", F.lit("-B"))))
    return change_log(before, after).where(F.col("field") == RECORD_FIELD)


def locked_column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a version in which somebody changed the confidence of incomplete records."""
    from wideprep.operators.audit import locked_changes

    out = P.output_narrow(spark, sf_dir).drop(ROW_ID)
    touched = F.when(F.col("status") == "Incomplete", F.col("confidence") + 1).otherwise(F.col("confidence"))
    return locked_changes(out, out.withColumn("confidence", touched))


def rejected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A4: of the analyst's edits and three misfits a record, those that are not taken."""
    from wideprep.operators.audit import rejected_edits as run

    out = P.output_narrow(spark, sf_dir).drop(ROW_ID)
    misfits = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (
        ("status", "Done"), ("confidence", "100"), ("JAN_1998", "abc"))])
    wrong = out.filter(F.col("status") == "Incomplete").select("record_id", F.explode(misfits).alias("x")).select("record_id", "x.*")
    return run(out, analyst_edits(out).unionByName(wrong))


def quality_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, Q1-Q3: the exception report of the edited output."""
    from wideprep.operators.audit import apply_edits as run

    out = P.output_narrow(spark, sf_dir).drop(ROW_ID)
    return Q.quality_report(run(out, analyst_edits(out)))


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the log of two saves, the second one tried twice, read back from its folder."""
    from wideprep.operators.audit import append_log, read_log
    from wideprep.session import new_table_path, stored_table

    path = new_table_path(spark, "audit-trail")
    log = stored_table(audit_log(spark, sf_dir), "audit-log")  # worked out once, saved three times
    append_log(log.filter("field = 'region'"), path, "1")
    for _ in range(2):
        append_log(log.filter("field <> 'region'"), path, "2")
    return read_log(spark, path)


# --- delivery read back ---------------------------------------------------------------------------
def quality_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows of the ordered report with their place (a top-k)."""
    from pyspark.sql import Window

    report = Q.quality_report(P.output_read(spark, sf_dir), keep_order_columns=True)
    order = [ROW_ID, "severity", "field_ordinal"]
    first = report.orderBy(*order).limit(100)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "record_id", "severity", "field")


def delivered_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K5: the raw dimension columns written as guarded CSV and read back."""
    from wideprep.operators.deliver import read_csv_member, write_csv
    from wideprep.session import new_table_path
    from wideprep.sources.fixtures import DIM_HEADERS

    path = new_table_path(spark, "csv")
    write_csv(P.source(spark, sf_dir).select(*DIM_HEADERS), path)
    return read_csv_member(spark, path)


def delivered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K5: the standardised output, periods included, written as guarded CSV and read back in its types."""
    from wideprep.operators.deliver import read_csv_member, write_csv
    from wideprep.session import new_table_path

    out = P.output(spark, sf_dir).drop(ROW_ID)
    path = new_table_path(spark, "csv")
    write_csv(out, path)
    kinds = dict(out.dtypes)
    back = read_csv_member(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if kinds[c] == "string" else F.col(c).cast(kinds[c]).alias(c) for c in out.columns])


def bundle_members(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every member of the delivered bundle."""
    return {
        "standardized_output": P.output_stored(spark, sf_dir), "data_quality_report": quality_report(spark, sf_dir),
        "column_classification": P.mapping(spark, sf_dir), "duplicate_report": duplicate_report(spark, sf_dir).select("ORDER_NO", "LINE_NO", "ITEM_CODE"),
        "reconciliation_detail": reconcile_slices(spark, sf_dir), "user_change_audit": audit_log(spark, sf_dir),
        "profiling_report": profile_table(spark, sf_dir), "reconciliation_summary": reconcile_total(spark, sf_dir)}


def delivered_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2-K4: a bundle of all nine members published, and the figures of its members read back."""
    from wideprep.operators.deliver import BUNDLE_TABLES, publish_bundle, published_manifest, read_member
    from wideprep.session import new_table_path

    path = new_table_path(spark, "bundle")
    names = publish_bundle(path, bundle_members(spark, sf_dir), reconcile_slices(spark, sf_dir), P.DATASET, stamp=False)
    parts = []
    for name in names:
        if name == "run_manifest":
            parts.append(published_manifest(spark, path).select(F.lit(name).alias("member"), F.col("source").alias("field"), "rows"))
            continue
        member = read_member(spark, path, name)
        field = F.col("field") if name in BUNDLE_TABLES and "field" in member.columns else F.lit("")
        parts.append(member.groupBy(field.alias("field")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("member"), "field", "rows"))
    listed = published_manifest(spark, path).select(F.inline("members")).select(F.lit("manifest").alias("member"), F.col("member").alias("field"), "rows")
    return reduce(DataFrame.unionByName, [*parts, listed])


def profile_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4-P9 over ``customer`` as text, with gaps: a dense table with negatives, repeated rows and a score inside its range."""
    from wideprep.operators.profile import profile_table as run
    from wideprep.sources.tables import read_table

    k = F.col("c_custkey")
    segment = F.when(k % 20 <= 1, "n/a").otherwise(F.col("c_mktsegment")).alias("segment")
    rows = read_table(spark, sf_dir, "customer").select(
        (k - F.when(k % 20 == 1, 1).otherwise(0)).cast("string").alias("account"), segment,
        F.when(k % 20 <= 1, "0").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.lit("x").alias("kind"))
    return run(rows)


REGISTRY.update({f.__name__: f for f in (
    classify_uploads, overlay_uploads, override_uploads, overlaid_sources, dictionary_joined, reconcile_differences, reconcile_slice_differences,
    slice_sizes, duplicate_keys_suggested, quality_report_empty, output_measures, version_changes, version_records, locked_column_changes, rejected_edits, quality_after_edits, appended_log, quality_preview,
    delivered_csv, delivered_output, delivered_bundle, profile_dense)})
