"""Date parsing and formatting for mixed spellings.

A cell is read by its shape, and parsed once:

1. 4-5 digits, optional ``.0`` -> spreadsheet serial day from 1899-12-30;
2. a time of day at the end (24-hour or AM/PM, optional zone) is cut: the
   date is the one written, whatever the zone;
3. day, month name and year in either order, or month name and year;
4. otherwise a chain of rewrites brings year-first, eight-digit and numeric
   day/month spellings to ``y-m-d``. Numeric order follows ``dayfirst``; a
   month above 12 means the other order, so ``13/01/2026`` parses either
   way. Two-digit years 69-99 are 19xx, others 20xx.

A cell that begins like none of these is settled by one look at its
beginning. Each step reads its input once, so the expression stays linear, and what is
no date fails one cast without an exception per tried format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wideprep.constants import DATE_OUTPUT_FORMATS, EXCEL_EPOCH
from wideprep.functions.text import _col, strip_ws

_TIME = (r"[ T]\s*(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d+)?)?(?:\s*[AaPp][Mm])?"
         r"(?:\s*(?:Z|UTC|[+-]\d{2}:?\d{2}))?$")
_SERIAL = r"^(\d{4,5})(?:\.0)?$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_NAME = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?"
         r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
# groups: day, separator, name, day, year; the day stands on one side, a two-digit year only after day and name
_NAMED = rf"(?i)^(?:(\d{{1,2}})([ -])(?=[a-z]+[ -]\d+$)|(?=[a-z]+ (?:\d{{1,2}},? )?\d{{4}}$)){_NAME}(?: (\d{{1,2}}),?)?[ -](\d{{4}}|\d{{2}})$"
_CENTURY = ((r"^(\d{1,2}[/.-]\d{1,2}[/.-])(?=(?:69|[7-9]\d)$)", "$119"),
            (r"^(\d{1,2}[/.-]\d{1,2}[/.-])(?=\d{2}$)", "$120"))
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
# the first characters that every spelling below shares with no other text: most cells of a table stop here
_BEGINS = (rf"(?i)^(?:\d{{4,5}}(?:\.0)?$|\d{{8}}(?!\d)|\d{{4}}-\d{{1,2}}(?!\d)|\d{{4}}[/.]\d{{1,2}}[/.]\d"
           rf"|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d|(?:\d{{1,2}}[ -])?{_MONTH})")
_YMD = r"^\d{4}-\d{1,2}(?:-\d{1,2})?$"


def _numeric(d: Column, dayfirst: bool) -> Column:
    """Year-first, eight-digit and numeric day/month text -> ``y-m-d`` text."""
    d = F.regexp_replace(d, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    d = F.regexp_replace(d, r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4")
    for shape, full in _CENTURY:
        d = F.regexp_replace(d, shape, full)
    d = F.regexp_replace(d, r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$", "$4/$3/$1" if dayfirst else "$4/$1/$3")
    # slashes mark the rewritten ones: only those may change their order
    d = F.regexp_replace(d, r"^(\d{4})/(1[3-9]|[2-9]\d)/(\d{1,2})$", "$1/$3/$2")
    return F.regexp_replace(d, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3")


def _named(d: Column) -> Column:
    """Text with a month name -> ``y-m-d`` text (the first of the month where no day is given)."""
    def part(i):
        return F.regexp_extract(d, _NAMED, i)

    month = (F.instr(F.lit(_MONTHS), F.lower(F.left(part(3), F.lit(3)))) + 2) / 3
    day = F.coalesce(F.nullif(F.concat(part(1), part(4)), F.lit("")), F.lit("1"))
    year = part(5)
    century = F.when(F.length(year) == 4, "").when(year.rlike("^(?:69|[7-9])"), "19").otherwise("20")
    return F.concat(century, year, F.lit("-"), month.cast("int").cast("string"), F.lit("-"), day)


def parse_date(c, dayfirst: bool = False) -> Column:
    """Text cell -> DATE (NULL when nothing parses)."""
    t = strip_ws(_col(c).cast("string"))
    d = F.regexp_replace(t, _TIME, "")
    text = F.when(d.rlike(_NAMED), _named(d)).otherwise(_numeric(d, dayfirst))
    serial = F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.regexp_extract(t, _SERIAL, 1).try_cast("int"))
    found = F.when(t.rlike(_SERIAL), serial).otherwise(F.regexp_extract(text, _YMD, 0).try_cast("date"))
    return F.when(t.rlike(_BEGINS), found)


def format_date(d: Column, fmt: str) -> Column:
    """Render with one of the named output formats; unknown names -> ISO."""
    pattern = DATE_OUTPUT_FORMATS.get(fmt, DATE_OUTPUT_FORMATS["YYYY-MM-DD"])
    return F.date_format(d, pattern)


def standardize_date(c, fmt: str = "YYYY-MM-DD", dayfirst: bool = False) -> Column:
    """Parsed and re-rendered date text; unparseable text -> the trimmed
    original; NULL stays NULL."""
    raw = strip_ws(_col(c).cast("string"))
    return F.coalesce(format_date(parse_date(c, dayfirst), fmt), raw)
