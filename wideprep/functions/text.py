"""Text expressions (Column -> Column), all native Spark functions.

Python's ``str.strip``/``\\s`` treat Unicode white space (and the four
information separators U+001C..U+001F) as blank, while Spark's ``trim``
strips only the space character; ``WS`` spells the Python class for Java
regexes so the results agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wideprep.constants import BLANK_TOKENS

# white space as Python's str.isspace() sees it, spelled out: Java's
# (?U)\s lacks the four information separators U+001C..U+001F, and a plain
# character class is much cheaper than a Unicode property lookup
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WS_CHARS) + "]"
_RUNS = WS + "+"
_OTHER_WS = WS_CHARS.replace(" ", "")
# a whole cell that spells a missing value (the tokens are ASCII, so an
# ASCII case-insensitive match equals lower-casing first)
_BLANK_RE = "(?i)^(?:" + "|".join(t.replace("/", "/").replace("-", "\\-") for t in BLANK_TOKENS if t) + ")?$"
_BLANK_LENGTH = max(map(len, BLANK_TOKENS))
_BLANK_STARTS = sorted({ord(x) for t in BLANK_TOKENS if t for x in (t[0].lower(), t[0].upper())})
_CLEAN = r"^[!-~]++(?: [!-~]++)*+\z"
# a cased letter (upper, lower or title case)
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# split point: between a non-cased character and a cased one
_WORD_START = rf"(?<=[^{_CASED}])(?=[{_CASED}])"
# ASCII text in which no letter follows anything but a letter or a space: one pass over plain character classes
_PLAIN = r"^[A-Za-z ]*+(?:[!-@\[-`{-~]++(?![A-Za-z])[A-Za-z ]*+)*+\z"
# text where Python's title() differs from initcap(): a cased letter after
# something that is neither a cased letter nor a space
_NEEDS_SPLIT = rf"[^{_CASED} ][{_CASED}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """Cell as text; NULL stays NULL."""
    return _col(c).cast("string")


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (character-set trim, no regex)."""
    return F.btrim(as_text(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Runs of white space -> one space (Python ``re.sub(r'\\s+', ' ', x)``).
    Every white-space character is first mapped to a space by ``translate``
    (a character map, no Unicode-class regex), then space runs are folded."""
    spaced = F.translate(as_text(c), _OTHER_WS, " " * len(_OTHER_WS))
    return F.regexp_replace(spaced, " {2,}", " ")


def is_blank(c) -> Column:
    """NULL, or trimmed lower-case text that spells a missing value. Never NULL.
    Text whose first character is visible ASCII that no such spelling begins with needs no second look."""
    first = F.ascii(as_text(c))
    other = first.between(0x21, 0x7E) & ~first.isin(*_BLANK_STARTS)
    return F.when(other, F.lit(False)).otherwise(F.coalesce(strip_ws(c).rlike(_BLANK_RE), F.lit(True)))


def clean_text(c) -> Column:
    """Trim, collapse white space, blank spellings -> ''. NULL -> ''. Never NULL.
    Visible ASCII words with single spaces between them, as most cells are, are
    already clean; only short text can spell a missing value."""
    t = as_text(c)
    long = F.length(t) > _BLANK_LENGTH
    cleaned = F.regexp_replace(collapse_ws(strip_ws(t)), _BLANK_RE, "")
    return F.coalesce(F.when(long & t.rlike(_CLEAN), t).otherwise(cleaned), F.lit(""))


def py_title(c) -> Column:
    """Python ``str.title()``: upper-case the first cased letter after any
    non-cased character, lower-case the others (``initcap`` only splits on
    spaces)."""
    t = as_text(c)
    parts = F.split(F.lower(t), _WORD_START)
    cap = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    # initcap splits on spaces only; it agrees with title() unless a cased
    # letter follows another non-cased character, so split only then; most cells are plain
    return F.when(~t.rlike(_PLAIN) & t.rlike(_NEEDS_SPLIT), F.array_join(cap, "")).otherwise(F.initcap(t))


def sku_form(c) -> Column:
    """Everything but ``A-Za-z0-9_-`` removed, upper-cased. Most codes hold nothing else, which one look tells."""
    t = as_text(c)
    return F.upper(F.when(t.rlike(r"^[A-Za-z0-9_\-]*+\z"), t).otherwise(F.regexp_replace(t, r"[^A-Za-z0-9_\-]", "")))


def sku_text(c) -> Column:
    """Cleaned text in the form of :func:`sku_form`."""
    return sku_form(clean_text(c))


def header_norm(c) -> Column:
    """Header normalisation for classification: trim, lower, runs of
    ``_ / \\ | -`` -> space, collapse spaces, trim."""
    s = F.lower(strip_ws(c))
    s = F.regexp_replace(s, r"[_/\\|\-]+", " ")
    return strip_ws(collapse_ws(s))


def header_tokens(c) -> Column:
    """Distinct space-separated tokens of a normalised header."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def truncate(c, n: int) -> Column:
    return F.substring(as_text(c), 1, n)
